"""Operator 9: nearest neighbours by inner product from randomly rotated one-bit codes.

A block of vectors keeps its centre; each vector is stored as the signs of its
rotated, normalised residual, packed to one bit per dimension, with two correction
scalars: the residual's length and the inner product of residual and code. From these
the inner product with a query is estimated, with an error bound that holds for
nearly all vectors. The vectors of the largest estimates are scored on the original
numbers; then every vector whose upper bound reaches the k-th largest of these scores
is ranked again on them. The others are never touched.

Blocks of queries meet blocks of vectors, so a task holds one block of each whatever the
tables' sizes; every block gives each query at most k rows to merge.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from mixloom.session import materialize

NEAREST = 20
BLOCK_ROWS = 8192
QUERY_ROWS = 1024
# Width of the error bound in standard deviations; 4 leaves out a few in a hundred thousand.
BOUND = 4.0
# Times k vectors of a block are scored first.
FIRST = 4
_QUERIES_AT_ONCE = 128


def rotation(dim: int, seed: int = 0) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    normal = np.random.default_rng([seed, dim]).standard_normal((dim, dim))
    q, r = np.linalg.qr(normal)
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """Centre, packed signs, residual lengths and code products of a block."""
    dim = vectors.shape[1]
    centre = vectors.mean(axis=0)
    residual = vectors - centre
    length = np.sqrt((residual * residual).sum(axis=1))
    rotated = residual @ rotation(dim, seed).T / np.where(length > 0, length, 1.0)[:, None]
    product = np.abs(rotated).sum(axis=1) / math.sqrt(dim)
    # A vector at the centre has no direction: its estimate is exact whatever the code.
    product = np.where(length > 0, product, 1.0)
    return {"centre": centre, "bits": np.packbits(rotated > 0, axis=1), "length": length, "product": product}


def estimate(queries: np.ndarray, code: dict[str, np.ndarray], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products and their error bounds, one row per query."""
    dim = queries.shape[1]
    signs = np.unpackbits(code["bits"], axis=1, count=dim).astype(np.float32) * 2 - 1
    turned = (queries @ rotation(dim, seed).T / math.sqrt(dim)).astype(np.float32)
    scale = code["length"] / code["product"]
    estimated = (turned @ signs.T) * scale + (queries @ code["centre"])[:, None]
    spread = np.sqrt(np.maximum(0.0, 1 - code["product"] ** 2)) * scale / math.sqrt(max(1, dim - 1))
    size = np.sqrt((queries * queries).sum(axis=1))
    return estimated, BOUND * size[:, None] * spread


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray,
    code: dict[str, np.ndarray], k: int, seed: int = 0,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, vector ids and exact scores of each query's k best of a block."""
    found_q, found_v, found_s = [], [], []
    for start in range(0, len(queries), _QUERIES_AT_ONCE):
        some, some_ids = queries[start : start + _QUERIES_AT_ONCE], query_ids[start : start + _QUERIES_AT_ONCE]
        estimated, error = estimate(some, code, seed)
        other = ids[None, :] != some_ids[:, None]
        # The most alike by estimate are scored first: their k-th score is one to be reached.
        least = np.full(len(some), -np.inf)
        if len(ids) > FIRST * k:
            likely = np.argpartition(np.where(other, -estimated, np.inf), FIRST * k - 1, axis=1)[:, : FIRST * k]
            scored = np.einsum("qmd,qd->qm", vectors[likely], some)
            scored[~np.take_along_axis(other, likely, axis=1)] = -np.inf
            least = np.partition(scored, -k, axis=1)[:, -k]
        # Sums in another order differ by less than this.
        slack = 1e-9 * (1 + np.abs(some).sum(axis=1) * np.abs(vectors).max(initial=0.0))
        reached = other & (estimated + error >= (least - slack)[:, None])
        for row, own in enumerate(some_ids):
            chosen = np.flatnonzero(reached[row])
            if len(chosen) > k:
                chosen = chosen[vectors[chosen] @ some[row] >= least[row] - slack[row]]
            scores = (vectors[chosen] * some[row]).sum(axis=1)
            best = np.lexsort((ids[chosen], -scores))[:k]
            found_q.append(np.full(len(best), own))
            found_v.append(ids[chosen][best])
            found_s.append(scores[best])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    return join(found_q, np.int64), join(found_v, np.int64), join(found_s, np.float64)


def valid_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id``, ``v`` (doubles) and ``dim`` of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    return (
        df.select(F.col(key).cast("bigint").alias("id"), v.alias("v"))
        .filter(F.col("id").isNotNull() & F.col("v").isNotNull())
        .filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
        .filter(F.exists("v", lambda x: x != 0))
        .withColumn("dim", F.size("v"))
    )


def _stacked(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["v"].to_numpy()).astype(np.float64)


def _blocks(vectors: DataFrame, rows: int, coded: bool, seed: int) -> DataFrame:
    """Vectors packed to rows of about so many, per dimension."""
    per_dim = vectors.groupBy("dim").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        stacked = _stacked(frame)
        row = {
            "dim": int(frame["dim"].iloc[0]), "block": int(frame["block"].iloc[0]),
            "ids": frame["id"].to_numpy(np.int64).tobytes(), "vectors": stacked.tobytes(),
        }
        if coded:
            row |= {name: np.ascontiguousarray(a).tobytes() for name, a in encode(stacked, seed).items()}
        return pd.DataFrame([row])

    schema = "dim int, block int, ids binary, vectors binary"
    if coded:
        schema += ", centre binary, bits binary, length binary, product binary"
    placed = vectors.join(per_dim, "dim").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return placed.groupBy("dim", "block").applyInPandas(pack, schema)


def nearest(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = NEAREST, seed: int = 0,
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest other rows of every query.

    Queries are the rows whose id is divisible by ``every``; the measure is the inner
    product in double precision of the original numbers; ties go to the smaller id.
    Rows without an id, and vectors that are NULL, empty, zero or hold NULL or
    non-finite components, take no part. Only vectors of one length are compared. Rows
    that share an id are each candidates (but not for their own id); as a query
    such an id stands for its smallest vector. An empty table gives an empty result.
    """
    vectors = materialize(valid_vectors(df, key, vector), "vectors")
    asked = vectors.filter(F.col("id") % every == 0).groupBy("id", "dim").agg(F.min("v").alias("v"))
    index = materialize(_blocks(vectors, block_rows, True, seed), "vector-blocks")
    queries = materialize(_blocks(asked, query_rows, False, seed), "query-blocks")
    many = index.groupBy("dim").agg(F.max("block").alias("last"))
    spread = (
        queries.join(many, "dim")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .select("dim", "block", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    )

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                table = lambda raw: np.frombuffer(raw, np.float64).reshape(-1, row.dim)  # noqa: B023, E731
                bits = np.frombuffer(row.bits, np.uint8)
                vectors = table(row.vectors)
                code = {
                    "centre": np.frombuffer(row.centre, np.float64), "bits": bits.reshape(len(vectors), -1),
                    "length": np.frombuffer(row.length, np.float64),
                    "product": np.frombuffer(row.product, np.float64),
                }
                q, v, s = search_block(
                    np.frombuffer(row.query_ids, np.int64), table(row.queries),
                    np.frombuffer(row.ids, np.int64), vectors, code, k, seed,
                )
                yield pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    found = spread.join(index, ["dim", "block"]).mapInPandas(search, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order).cast("int"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
