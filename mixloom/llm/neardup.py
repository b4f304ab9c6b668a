"""Operator 10: near-duplicate documents by bottom-k sketches of one hash function.

A document is the set of its word shingles, each a 64-bit hash. Its sketch is the k
smallest hashes. How many values the sketches of two sets of similarity 0.8 share at
least is known up to five standard deviations (and exactly for sets no larger than the
sketch). So if every document indexes its sketch from the rarest retained value on, and
leaves out as many as must be shared less one, such a pair still meets in an inverted
list. A document with too few shared values has no partner and leaves at once.

No list is turned into all of its pairs. First every member meets the smallest
member; confirmed links give components. Then only members outside a list's
largest component meet the members of other components, which loses no link
between components: pair by pair in short lists, and in long ones by blocks of
full sets inside a task. Pairs of short lists are filtered again by the estimate from
the union of two sketches, and the full sets decide. A task of blocks does both itself,
and hands on only similar pairs that join what it has not joined yet, fewer than its
rows. Equal sets count once throughout.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from mixloom.llm.components import connected_components
from mixloom.session import materialize

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80
SKETCH = 128
# Of these values, the smallest are indexed.
INDEXED = 64
# Bounds on shared values lie this many standard deviations below the mean at 0.8.
DEVIATIONS = 5.0
# Longer lists are compared in blocks of about so many bytes of sets, and so many rows.
SHORT_LIST = 64
BLOCK_BYTES = 8 << 20
BLOCK_ROWS = 8192
# So many rows of a block at once.
BLOCK = 512
# So many ids are sent to every task; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: bytes | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a UTF-8 text.

    Words are runs other than ASCII white space, A-Z lower-cased. Fewer words than
    the width make one shingle; no words make none.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.int64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    span = min(width, len(words))
    with np.errstate(over="ignore"):
        mixed = hashes[: len(words) - span + 1].copy()
        for i in range(1, span):
            mixed = (mixed ^ (mixed >> np.uint64(32))) * _MULTIPLIER
            mixed += hashes[i : len(words) - span + 1 + i]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed.view(np.int64))


def _as_binary(column: str, name: str):
    """A sorted array of longs as the bytes that numpy reads in place."""

    @F.pandas_udf("binary")
    def pack(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: np.asarray(a, dtype=np.int64).tobytes())

    return pack(column).alias(name)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def _with_text_key(docs: DataFrame) -> DataFrame:
    """Two hashes of the text, ``t1`` and ``t2``, which with the ``doc_id`` tell a row from all but its repetitions."""
    return docs.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return (a["t1"] == b["t1"]) & (a["t2"] == b["t2"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def sketches(docs: DataFrame, width: int = SHINGLE_WORDS, k: int = SKETCH) -> DataFrame:
    """``doc_id``, the text's key, set size ``n``, digest of the set ``same`` and ``sketch`` of every document."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, smallest = [], [], []
            for text in batch.column(3):
                hashes = shingle_set(text.as_py(), width)
                sizes.append(len(hashes))
                digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
                smallest.append(hashes[:k])
            made = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(smallest)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["doc_id", "t1", "t2", "n", "same", "sketch"])

    key = docs.schema["doc_id"].dataType.simpleString()
    texts = _with_text_key(docs).select("doc_id", "t1", "t2", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(make, f"doc_id {key}, t1 bigint, t2 bigint, n bigint, same binary, sketch array<bigint>")


def least_common(kept: int) -> int:
    """Values that the union's ``kept`` smallest share at least at a similarity of 0.8."""
    share = SIMILAR_PERCENT / 100
    return math.floor(share * kept - DEVIATIONS * math.sqrt(kept * share * (1 - share)))


def _inverted(distinct: DataFrame, k: int) -> DataFrame:
    """``value``, ``id``, ``n``: the retained values by which similar sets must meet."""
    kept = min(k, INDEXED)
    values = distinct.select("id", "n", F.explode(F.slice("sketch", 1, kept)).alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    shared = values.join(common, "value")
    # Rarest first; those of one document alone come before all of these.
    ordered = shared.groupBy("id", "n").agg(F.array_sort(F.collect_set(F.struct("df", "value"))).alias("list"))
    # A set no larger than its sketch shares 80 % of its values, less those that a
    # larger partner may have beyond its own sketch.
    beyond = F.greatest(F.lit(0), F.floor(F.col("n") * 100 / SIMILAR_PERCENT) - kept)
    exact = F.greatest(F.lit(1), F.ceil(F.col("n") * SIMILAR_PERCENT / 100) - beyond)
    needed = F.when(F.col("n") <= kept, exact).otherwise(F.lit(max(1, least_common(kept)))).cast("int")
    entries = F.size("list") - needed + 1
    return (
        ordered.filter(entries >= 1)
        .select("id", "n", F.explode(F.slice("list", F.lit(1), entries)).alias("e"))
        .select(F.col("e.value").alias("value"), "id", "n")
    )


def _similar_size(a: str, b: str):
    return (F.col(a) * 100 >= F.col(b) * SIMILAR_PERCENT) & (F.col(b) * 100 >= F.col(a) * SIMILAR_PERCENT)


def _alike_sketches(x: np.ndarray, y: np.ndarray, k: int) -> bool:
    """Whether the similarity estimated from the union of two sketches may be 0.8."""
    both = np.intersect1d(x, y, assume_unique=True)
    if len(x) < k and len(y) < k:
        return 100 * len(both) >= SIMILAR_PERCENT * (len(x) + len(y) - len(both))
    last = np.union1d(x, y)[k - 1]
    return np.searchsorted(both, last, side="right") >= least_common(k)


def _alike_sets(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= SIMILAR_PERCENT * (len(x) + len(y) - both)


def _keep_pairs(alike):
    """An Arrow function that keeps the pairs whose two sorted arrays are alike."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda cell: np.frombuffer(cell.as_py(), np.int64)
        for batch in batches:
            keep = [bool(alike(read(x), read(y))) for x, y in zip(batch.column(2), batch.column(3))]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    return check


def _only(df: DataFrame, ids: DataFrame, on: list[str] | str = "id") -> DataFrame:
    """The rows whose ``id`` is among the written ``ids``, whose number is checked before they are sent."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, on, "left_semi")


def _ids_of(pairs: DataFrame) -> DataFrame:
    return materialize(pairs.select("a").union(pairs.select("b")).toDF("id").distinct(), "pair-ids")


def _with_both(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    second = of.select(F.col("id").alias("b"), F.col(column).alias("_y"))
    first = of.select(F.col("id").alias("a"), F.col(column).alias("_x"))
    return pairs.join(second, "b").join(first, "a").select("a", "b", "_x", "_y")


def _full_sets(ids: DataFrame, sets: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``id`` and ``set``, its sorted hashes as bytes, made again from the texts of the written ``ids``."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), width).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "set"])

    wanted = materialize(_only(sets, ids).select("id", "doc_id", "t1", "t2"), "wanted-texts")
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = _with_text_key(docs)
    texts = texts.join(F.broadcast(wanted) if few else wanted, _same_row(texts, wanted)).select(
        wanted["id"], texts["text"].cast("binary").alias("text")
    )
    return materialize(texts.mapInArrow(whole, "id bigint, set binary").dropDuplicates(["id"]), "full-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, docs: DataFrame, width: int, k: int) -> DataFrame:
    """The pairs whose full sets are similar, after the estimate has filtered them."""
    schema = "a bigint, b bigint"
    own = _only(sets, _ids_of(pairs)).select("id", _as_binary("sketch", "sketch"))
    likely = materialize(
        _with_both(pairs, own, "sketch").mapInArrow(_keep_pairs(lambda x, y: _alike_sketches(x, y, k)), schema),
        "likely-pairs",
    )
    if likely.isEmpty():
        return likely

    full = _full_sets(_ids_of(likely), sets, docs, width)
    return materialize(_with_both(likely, full, "set").mapInArrow(_keep_pairs(_alike_sets), schema), "confirmed-pairs")


def _rest_of_short(lists: DataFrame) -> DataFrame:
    """Pairs of members of different components, one of them outside the largest."""
    outside = lists.filter(F.col("label") != F.col("major")).select("value", "id", "n", "label")
    member = lists.select(
        "value", F.col("id").alias("b"), F.col("n").alias("_n"), F.col("label").alias("_label"), "major"
    )
    return (
        outside.join(member, "value")
        .filter(F.col("label") != F.col("_label"))
        .filter((F.col("_label") == F.col("major")) | (F.col("id") < F.col("b")))
        .filter(_similar_size("n", "_n"))
        .select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"))
        .distinct()
    )


def _may_be_similar(x: pd.DataFrame, y: pd.DataFrame, k: int) -> np.ndarray:
    """Which pairs of two tables of sorted sets share enough of their ``k`` smallest values."""
    sketch_x, sketch_y = [h[:k] for h in x["set"]], [h[:k] for h in y["set"]]
    values_x, values_y = np.concatenate(sketch_x), np.concatenate(sketch_y)
    both = np.intersect1d(values_x, values_y)

    def incidence(sketched: list[np.ndarray], values: np.ndarray) -> np.ndarray:
        rows = np.repeat(np.arange(len(sketched)), [len(h) for h in sketched])
        at = np.minimum(np.searchsorted(both, values), max(len(both) - 1, 0))
        found = both[at] == values if len(both) else np.zeros(len(values), bool)
        table = np.zeros((len(sketched), len(both)), np.float32)
        table[rows[found], at[found]] = 1.0
        return table

    common = incidence(sketch_x, values_x) @ incidence(sketch_y, values_y).T
    n_x, n_y = x["n"].to_numpy(float)[:, None], y["n"].to_numpy(float)[None, :]
    least, most = np.minimum(n_x, n_y), np.maximum(n_x, n_y)
    share = SIMILAR_PERCENT / 100
    # At this similarity the larger set has at least this part of its values in the other.
    part = np.minimum(1.0, share / (1 + share) * (least + most) / most)
    # Drawn without putting back: the more of a set its sketch holds, the less it strays.
    strays = np.sqrt(k * part * (1 - part) * np.maximum(0.0, 1 - k / most))
    enough = common >= np.floor(k * part - DEVIATIONS * strays)
    whole = (n_x < k) & (n_y < k)
    enough = np.where(whole, 100 * common >= SIMILAR_PERCENT * (n_x + n_y - common), enough)
    return enough & (least * 100 >= most * SIMILAR_PERCENT)


def _links_of_blocks(x: pd.DataFrame, y: pd.DataFrame, k: int) -> list[tuple[int, int]]:
    """Pairs of similar sets of two blocks, as many as join all components that have one.

    A pair of sets that earlier ones have joined is not looked at.
    """
    above: dict[int, int] = {}

    def root(label: int) -> int:
        while (up := above.get(label, label)) != label:
            above[label] = above.get(up, up)
            label = up
        return label

    links = []
    for i in range(0, len(x), BLOCK):
        rows = x.iloc[i : i + BLOCK]
        for j in range(0, len(y), BLOCK):
            others = y.iloc[j : j + BLOCK]
            roots_x = np.array([root(v) for v in rows["label"]])
            roots_y = np.array([root(v) for v in others["label"]])
            apart = roots_x[:, None] != roots_y[None, :]
            if not apart.any():
                continue
            likely = apart & _may_be_similar(rows, others, k)
            sets_x, sets_y = rows["set"].to_list(), others["set"].to_list()
            ids_x, ids_y = rows["id"].to_list(), others["id"].to_list()
            for p, q in np.argwhere(likely).tolist():
                one, two = root(int(roots_x[p])), root(int(roots_y[q]))
                if one != two and _alike_sets(sets_x[p], sets_y[q]):
                    above[one] = two
                    links.append((min(ids_x[p], ids_y[q]), max(ids_x[p], ids_y[q])))
    return links


def _links_of_long(lists: DataFrame, sets: DataFrame, docs: DataFrame, width: int, k: int) -> DataFrame:
    """Links between the components of long lists, from blocks; lists that share members are one group.

    They join whatever the similar pairs of outsiders and members of other components join.
    """
    hubs = lists.groupBy("value").agg(F.min("id").alias("b"))
    groups = connected_components(lists.join(hubs, "value").select(F.col("id").alias("a"), "b").distinct())
    members = materialize(
        lists.select("id", "n", "label").distinct()
        .join(groups.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id"),
        "long-list-members",
    )
    blocks_of = lambda rows, values: F.ceil(F.greatest(
        F.col(rows) / BLOCK_ROWS, F.col(values) * 8 / BLOCK_BYTES
    )).cast("int")
    major = (
        members.groupBy("cluster", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("values"))
        .groupBy("cluster")
        .agg(
            F.max(F.struct("rows", "label", "values")).alias("top"), F.sum("rows").alias("members"),
            F.sum("values").alias("values"),
        )
        .select(
            "cluster", F.col("top.label").alias("major"), "members", "values",
            (F.col("members") - F.col("top.rows")).alias("outside"),
            (F.col("values") - F.col("top.values")).alias("outside_values"),
        )
        .filter("outside > 0")
        .select(
            "cluster", "major", blocks_of("members", "values").alias("blocks"),
            blocks_of("outside", "outside_values").alias("outside_blocks"),
        )
    )
    ids = materialize(members.join(major, "cluster", "left_semi").select("id").distinct(), "block-ids")
    placed = members.join(major, "cluster").join(_full_sets(ids, sets, docs, width), "id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    columns = ["id", "n", "label", "set"]
    first = placed.filter("label != major").select(
        "cluster", own("outside_blocks").alias("i"), every("blocks").alias("j"), F.lit(True).alias("outside"), *columns
    )
    second = placed.select(
        "cluster", every("outside_blocks").alias("i"), own("blocks").alias("j"), F.lit(False).alias("outside"), *columns
    )

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(set=[np.frombuffer(h, np.int64) for h in frame["set"]])
        outside = frame["outside"].to_numpy(bool)
        links = _links_of_blocks(frame[outside], frame[~outside], k) if outside.any() and not outside.all() else []
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return first.unionByName(second).groupBy("cluster", "i", "j").applyInPandas(compare, "a bigint, b bigint").distinct()


def _apart(lists: DataFrame, links: DataFrame) -> DataFrame:
    """The lists whose members are in several components, with each one's largest component."""
    linked = connected_components(links).withColumnRenamed("node", "id")
    label = F.coalesce("component", "id").alias("label")
    labelled = materialize(lists.join(linked, "id", "left").select("value", "id", "n", label), "labelled-lists")
    largest = (
        labelled.groupBy("value", "label").agg(F.count("*").alias("rows"))
        .groupBy("value")
        .agg(
            F.max(F.struct("rows", "label")).alias("top"), F.count("*").alias("labels"),
            F.sum("rows").alias("members"),
        )
        .filter("labels > 1")
        .select("value", F.col("top.label").alias("major"), "members")
    )
    return materialize(labelled.join(largest, "value"), "split-lists")


def _components(docs: DataFrame, width: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Sketched rows, and the component of every set of shingles (``same``, ``component``).

    Rows of one set are one node, named by the number of one of them.
    """
    numbered = sketches(docs, width, k).withColumn("row", F.monotonically_increasing_id())
    made = materialize(numbered, "sketches")
    nodes = made.filter("n > 0").groupBy("same").agg(F.min("row").alias("id"))
    nodes = materialize(nodes, "distinct-sets")
    sketched = made.withColumnRenamed("row", "id")
    sets = _only(sketched, nodes.select("id"))
    lists = materialize(_inverted(sets, k), "inverted-lists")
    hubs = lists.groupBy("value").agg(F.min(F.struct("id", "n")).alias("hub")).select(
        "value", F.col("hub.id").alias("a"), F.col("hub.n").alias("_n")
    )
    with_hub = (
        lists.join(hubs, "value")
        .filter((F.col("a") != F.col("id")) & _similar_size("n", "_n"))
        .select("a", F.col("id").alias("b"))
        .distinct()
    )
    first_pairs = materialize(with_hub, "hub-pairs")
    first_links = _confirmed(first_pairs, sketched, docs, width, k)
    links = first_links
    apart = _apart(lists, links)
    long_lists = apart.filter(F.col("members") > SHORT_LIST)
    short_lists = apart.filter(F.col("members") <= SHORT_LIST)
    if not long_lists.isEmpty():
        links = links.unionByName(materialize(_links_of_long(long_lists, sketched, docs, width, k), "block-links"))
        short_lists = _apart(short_lists.select("value", "id", "n"), links)
    rest = _rest_of_short(short_lists)
    rest = materialize(rest.join(first_pairs, ["a", "b"], "left_anti"), "rest-pairs")
    more_links = _confirmed(rest, sketched, docs, width, k)
    linked = connected_components(links.unionByName(more_links)).withColumnRenamed("node", "id")
    of_set = nodes.join(linked, "id", "left").select("same", F.coalesce("component", "id").alias("component"))
    return made, materialize(of_set, "set-components")


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, k: int = SKETCH) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row of the documents.

    Rows are linked when their shingle sets have a Jaccard similarity of 0.8 or
    more; a component is named by its smallest ``doc_id``, and rows of that id in it are
    kept. A text without words (NULL, empty, white space) is linked with nothing and
    kept. Rows of one ``doc_id`` with different texts are documents of their own. A row
    with a NULL ``doc_id`` is linked like any other, and kept if no row of its
    component has an id. An empty table gives an empty result. Only ``doc_id`` and
    ``text`` are read.
    """
    made, of_set = _components(docs.select("doc_id", "text"), width, k)
    placed = made.select("doc_id", "n", "same").join(of_set, "same", "left")
    names = placed.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("name"))
    return placed.join(names, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("name")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """The documents with one row of every component, all columns as they are.

    It is the row of the smallest ``doc_id`` (NULL last); of several by a hash of
    the text; of repeated rows, which may differ in other columns, any one. Rows
    without words all stay.
    """
    made, of_set = _components(docs.select("doc_id", "text"), width, SKETCH)
    key = ["doc_id", "t1", "t2"]
    rows = made.filter("n > 0").groupBy("same", *key).agg(F.count("*").alias("rows")).join(of_set, "same")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), *key)
    first = rows.groupBy("component").agg(F.min(order).alias("first"))
    marked = rows.join(first, "component").select(*key, (order != F.col("first")).alias("gone"), (F.col("rows") > 1).alias("twice"))
    marks = materialize(marked.filter("gone OR twice"), "near-duplicate-marks")
    keyed = _with_text_key(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text"))
    placed = keyed.join(marks, _same_row(keyed, marks), "left").select("row", keyed["doc_id"], keyed["t1"], keyed["t2"], "gone", "twice")
    kept = placed.filter("gone IS NULL")
    twice = marks.filter("twice AND NOT gone")
    if not twice.isEmpty():
        kept = kept.unionByName(placed.filter("twice AND NOT gone").dropDuplicates(key))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
