"""Operator 1: mixing sources to target weights by pivotal dependent rounding.

Every source gets a share of all words by its weight, at most a multiple of its own
size. A document is then copied 'target / source size' times on average: the whole
copies are certain, the fractions are rounded together. Two documents with fractions
meet; words move at random from one to the other until one of them is whole. That
keeps the words of the source exactly and every document's chance on average. The
other one meets the next document: inside a group of bounded size first, then the
survivors of the groups, up a tree whose levels are written tables, until one
document per source is left, which is drawn.

All of it is DataFrame expressions; the random numbers are hashes of the documents
that meet, so reruns and retried tasks agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mixloom.llm.common import let, number_rows, word_count
from mixloom.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2.0
# Documents that meet in one group of a level.
GROUP = 32
# Documents above these parts of their source's words are settled first, class by
# class. Each later class makes up for what the last of a class got too much or too
# little, so the mix misses a target by little more than a document of the last class.
LARGE_PARTS = (1 / 16, 1 / 64, 1 / 256)

_UNIT = "struct<key:bigint,size:double,p:double>"
_DONE = "array<struct<key:bigint,up:int>>"


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS,
            most: float = MOST_COPIES) -> DataFrame:
    """``source``, ``source_size``, ``target``, ``rate`` and ``n`` for every source.

    Sources in code point order, NULL last, take the weights in turn. What a source
    may not take above ``most`` times its size is shared again by weight: each pass
    caps the sources above, until no further one is, and only sums reach the driver.
    """
    by_source = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n"), F.max("size").alias("largest")
    )
    ranked = number_rows(by_source, F.col("source").asc_nulls_last(), name="sources")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = materialize(
        ranked.select(
            "source", "source_size", "n", "largest",
            F.element_at(cycle, (F.col("_number") % len(weights) + 1).cast("int")).alias("weight"),
            (F.col("source_size") * most).alias("cap"),
        ),
        "weighted-sources",
    )
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        is_capped = F.lit(level) * F.col("weight") >= F.col("cap")
        row = weighted.agg(
            F.count_if(is_capped).alias("n"),
            F.sum(F.when(is_capped, F.col("cap")).otherwise(0.0)).alias("used"),
            F.sum(F.when(is_capped, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if row["n"] == capped or not row["open"]:
            break
        capped = row["n"]
        level = (share * total - row["used"]) / row["open"]
    target = F.least(F.lit(level) * F.col("weight"), F.col("cap")) if total else F.lit(0.0)
    return weighted.withColumn("target", target).withColumn(
        "rate",
        F.when(F.col("target") >= F.col("cap"), F.lit(float(most)))
        .otherwise(F.col("target") / F.col("source_size")),
    ).select("source", "source_size", "n", "largest", "target", "rate")


def _meet(state: Column, unit: Column, seed: int, level: int) -> Column:
    """The next document meets the one still open; one of the two becomes whole."""

    def settled(s: Column) -> Column:
        i, j, done = s["i"], s["j"], s["done"]
        rise = F.least(i["size"] * (1 - i["p"]), j["size"] * j["p"])  # words that i may take from j
        fall = F.least(i["size"] * i["p"], j["size"] * (1 - j["p"]))
        draw = _uniform(F.lit(seed), F.lit(level), i["key"], j["key"])
        def moved(words: Column, i_whole: Column, i_up: int, sign: int) -> Column:
            i_p = i["p"] + sign * words / i["size"]
            j_p = j["p"] - sign * words / j["size"]
            inside = lambda p: F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
            unit_of = lambda u, p: F.struct(u["key"].alias("key"), u["size"].alias("size"), inside(p).alias("p"))
            whole = lambda u, up: F.array(F.struct(u["key"].alias("key"), F.lit(up).alias("up")))
            return F.when(
                i_whole,
                F.struct(unit_of(j, j_p).alias("open"), F.concat(done, whole(i, i_up)).alias("done")),
            ).otherwise(
                F.struct(unit_of(i, i_p).alias("open"), F.concat(done, whole(j, 1 - i_up)).alias("done")),
            )

        up = moved(rise, i["size"] * (1 - i["p"]) <= j["size"] * j["p"], 1, 1)
        down = moved(fall, i["size"] * i["p"] <= j["size"] * (1 - j["p"]), 0, -1)
        return F.when(draw * (rise + fall) < fall, up).otherwise(down)

    first = F.struct(unit.alias("open"), state["done"].alias("done"))
    both = F.struct(state["open"].alias("i"), unit.alias("j"), state["done"].alias("done"))
    return F.when(state["open"].isNull(), first).otherwise(let(both, settled))


def _level(units: DataFrame, group: list[str], seed: int, level: int) -> DataFrame:
    """Each group's settled documents ``done`` and the one left ``open``, written."""
    listed = units.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct(
            _uniform(F.lit(seed), F.lit(level), "key").alias("order"), F.col("key"),
            F.col("size").cast("double").alias("size"), F.col("p"),
        ))).alias("units")
    )
    plain = F.transform("units", lambda u: F.struct(u["key"].alias("key"), u["size"].alias("size"), u["p"].alias("p")))
    start = F.struct(F.lit(None).cast(_UNIT).alias("open"), F.array().cast(_DONE).alias("done"))
    folded = F.aggregate(plain, start, lambda state, unit: _meet(state, unit, seed, level))
    return materialize(
        listed.select(*group, folded.alias("f")).select(*group, "f.open", "f.done"), f"pivot-{level}"
    )


def _settled(level: DataFrame) -> DataFrame:
    return level.select("source", F.explode("done").alias("d")).select("source", "d.key", "d.up")


def pivotal_rounding(units: DataFrame, seed: int = 0) -> DataFrame:
    """``source``, ``key``, ``up`` (0 or 1) for units with ``source, key, size, p, n``.

    ``n`` is the number of units of the source. The words of a source change by no
    more than the size of its last unit; a unit goes up with probability ``p``.
    """
    groups = F.ceil(F.col("n") / F.lit(GROUP / 2)).cast("bigint")
    placed = units.withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "key"), groups))
    row = placed.agg(F.max("g")).first()
    if row[0] is None:
        return units.select("source", "key", F.lit(0).alias("up")).limit(0)
    most, depth = row[0], 0
    level = _level(placed, ["source", "g"], seed, depth)
    settled = _settled(level)
    while most > 0:
        most, depth = most // GROUP, depth + 1
        opened = level.filter(F.col("open").isNotNull()).select(
            "source", F.call_function("div", F.col("g"), F.lit(GROUP).cast("bigint")).alias("g"), "open.*"
        )
        level = _level(opened, ["source", "g"], seed, depth)
        settled = settled.unionByName(_settled(level))
    drawn = _uniform(F.lit(seed), F.lit("last"), F.col("open.key")) < F.col("open.p")
    return settled.unionByName(level.select("source", F.col("open.key").alias("key"), drawn.cast("int").alias("up")))


def mix_sources(docs: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS,
                most: float = MOST_COPIES, seed: int = 0) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken, source`` of every document.

    The size is the number of words, 0 for a NULL text. ``copies`` is how often the
    mix takes the document and ``taken`` its words times that. A document without
    words is copied at its source's rate by a draw of its own; a source without
    words is at its limit at once. A NULL source is a source of its own, the last one.
    Rows alike in ``doc_id``, source and size (NULLs included) are one unit with the
    words of all: they get the same number of copies, and each row is returned. An
    empty table gives an empty result. Only ``doc_id``, ``text`` and ``source`` are read.
    """
    sizes = materialize(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "document-sizes"
    )
    by_source = materialize(targets(sizes, share, weights, most), "targets").select(
        F.col("source").alias("_s"), "source_size", "target",
        F.coalesce("rate", F.lit(0.0)).alias("rate"),
    )
    units = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    placed = materialize(
        units.join(by_source, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("key", F.xxhash64("doc_id", "size", F.coalesce("source", F.lit("")), F.col("source").isNull()))
        .withColumn("whole", F.floor("rate").cast("int"))
        .withColumn("p", F.col("rate") - F.col("whole"))
        .withColumn("words", (F.col("size") * F.col("rows")).cast("double"))
        .drop("_s", "rate"),
        "units",
    )
    ups = materialize(_rounded_by_class(placed.filter("p > 0 and words > 0"), seed), "ups")
    own_draw = (_uniform(F.lit(seed), F.lit("empty"), F.col("key")) < F.col("p")).cast("int")
    copies = F.col("whole") + F.coalesce("up", F.when(F.col("words") == 0, own_draw), F.lit(0))
    return (
        placed.join(ups, "key", "left")
        .withColumn("copies", copies)
        .select(
            "doc_id", "source", "size", "source_size", "target", "copies",
            (F.col("copies") * F.col("size")).cast("bigint").alias("taken"),
            F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_row"),
        )
        .drop("_row")
    )


def _rounded_by_class(units: DataFrame, seed: int) -> DataFrame:
    """``key`` and ``up`` of all units, the large ones of each source settled first."""
    part = F.col("words") / F.col("source_size")
    bounds = [float("inf"), *LARGE_PARTS, 0.0]
    settled = units.select("source", "key", "words", F.lit(0).alias("up")).limit(0)
    for i, (above, below) in enumerate(zip(bounds[1:], bounds[:-1])):
        wanted = units.groupBy("source").agg(
            F.sum(F.col("words") * F.col("p")).alias("wanted"),
            F.sum(F.when(part <= below, F.col("words"))).alias("open"),
            F.count_if((part <= below) & (part > above)).alias("n"),
        ).filter("n > 0")
        got = settled.groupBy(F.col("source").alias("_g")).agg(F.sum(F.col("words") * F.col("up")).alias("got"))
        left = F.col("wanted") - F.coalesce("got", F.lit(0.0))
        chance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), left / F.col("open")))
        # The first class starts from the rate itself, later ones from what is left.
        of_class = wanted.join(got, F.col("source").eqNullSafe(F.col("_g")), "left").select(
            F.col("source").alias("_s"), "n", chance.alias("chance")
        )
        members = units.filter((part <= below) & (part > above)).join(
            of_class, F.col("source").eqNullSafe(F.col("_s"))
        )
        n = F.col("n") if above == 0 else F.lit(1)
        rounded = pivotal_rounding(
            members.select("source", "key", F.col("words").alias("size"), F.col("chance").alias("p"), n.alias("n")),
            seed + i,
        )
        rounded = rounded.select("key", "up").join(units.select("key", "source", "words"), "key")
        settled = materialize(settled.unionByName(rounded.select("source", "key", "words", "up")), "settled")
    return settled.select("key", "up")


def mixed_documents(docs: DataFrame, seed: int = 0, **parameters) -> DataFrame:
    """Every document as often as the mix takes it, with the columns it came with."""
    mixed = mix_sources(docs, seed=seed, **parameters)
    taken = mixed.groupBy("doc_id", "source", "size").agg(F.first("copies").alias("_copies")).select(
        F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_n"), "_copies"
    )
    joined = docs.join(
        taken,
        docs["doc_id"].eqNullSafe(F.col("_d")) & docs["source"].eqNullSafe(F.col("_s"))
        & (word_count(docs["text"]) == F.col("_n")),
    )
    repeated = joined.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return repeated.select(*docs.columns)
