"""Connected components of links between documents, by stars that shrink round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mixloom.session import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for every linked node.

    ``links`` holds pairs ``a``, ``b`` in any order, repeated or not. Each round ties
    every node to the smallest of its neighbours, first among larger ones, then
    among smaller ones, until all point straight at their smallest node. The
    number of rounds grows with the logarithm of the longest path; every round is
    written to the shared folder, so a lost executor costs one round. Minima
    combine before the shuffle, and the join back is one that Spark may split.
    """
    edges = materialize(_downwards(links.select("a", "b")), "links")
    before = _state(edges)
    while before[0]:
        larger = _tie(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), True)
        edges = materialize(_tie(_downwards(larger), False), "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    tied = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return tied.unionByName(roots).distinct()


def _downwards(edges: DataFrame) -> DataFrame:
    """Each link once, from its larger to its smaller node."""
    return (
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _tie(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Neighbours of every node ``a`` tied to the smallest of them and itself."""
    least = edges.groupBy("a").agg(F.min("b").alias("_b")).select(
        "a", F.least("a", "_b").alias("_least")
    )
    joined = edges.join(least, "a")
    if larger_only:
        return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_least").alias("b"))
    others = joined.select(F.col("b").alias("a"), F.col("_least").alias("b"))
    own = least.select("a", F.col("_least").alias("b"))
    return _downwards(others.unionByName(own))


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row["n"], row["h"] or 0
