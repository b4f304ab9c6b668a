"""Operator 8: document fingerprints as invertible Bloom lookup sketches of paragraphs.

A paragraph is a line, long lines in pieces of a fixed number of characters. A document is
the set of its paragraph digests; its fingerprint is a small table of cells, each
with a count and the XORs of the digests and of their checks that fall into it, three
cells per digest. Subtracting two fingerprints leaves only what differs, and peeling
cells that hold one digest recovers it. A table too small for the difference fails
visibly, and is made anew at twice the size.

Large documents are compared bucket by bucket (digests dealt by their value), so the
work grows with the paragraphs and not with their square.

All of it is DataFrame expressions over the arrays of one row; text crosses the
network once, to meet the part of another document that an edit brings in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mixloom.llm.common import let, number_rows
from mixloom.session import materialize

PARAGRAPH_CHARS = 256
TABLES = 3
# Cells per hash function of a fingerprint.
FINGERPRINT_CELLS = 8
# Cells for each digest of a first attempt, and the least per hash function.
ROOM = 1.5
LEAST_CELLS = 8
# Digests of both sides together that are compared in one table, at most on average.
BUCKET_DIGESTS = 256
ATTEMPTS = 10
ROUNDS = 24


def paragraph_digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraphs; none for a NULL or blank text."""
    trim = F.lit(" \t\x0b\x0c\r")
    lines = F.filter(
        F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, trim)), lambda x: x != ""
    )

    def pieces(line: Column) -> Column:
        last = F.ceil(F.length(line) / PARAGRAPH_CHARS).cast("int") - 1
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.xxhash64(F.substring(line, i * PARAGRAPH_CHARS + 1, F.lit(PARAGRAPH_CHARS))),
        )

    return F.array_distinct(F.flatten(F.transform(lines, pieces)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check"))


def _cells_of(key: Column, count: Column, attempt: Column, per_table: Column) -> Column:
    """The digest's cell in every table: place ``i``, count ``n``, digest ``k``, check ``c``."""
    return F.array(*[
        F.struct(
            (F.pmod(F.xxhash64(key, F.lit(t), attempt), per_table.cast("bigint")) + F.lit(t) * per_table)
            .cast("int").alias("i"),
            count.cast("int").alias("n"), key.alias("k"), _check(key).alias("c"),
        )
        for t in range(TABLES)
    ])


def _added(cells: Column) -> Column:
    """Cells in order of their place, those of one place added up, empty ones left out."""
    cell = "struct<i:int,n:int,k:bigint,c:bigint>"
    start = F.struct(F.array().cast(f"array<{cell}>").alias("done"), F.lit(None).cast(cell).alias("last"))

    def closed(state: Column) -> Column:
        last = state["last"]
        empty = last.isNull() | ((last["n"] == 0) & (last["k"] == 0) & (last["c"] == 0))
        return F.when(empty, state["done"]).otherwise(F.concat(state["done"], F.array(last)))

    def add(state: Column, x: Column) -> Column:
        last = state["last"]
        both = F.struct(
            x["i"].alias("i"), (last["n"] + x["n"]).alias("n"),
            last["k"].bitwiseXOR(x["k"]).alias("k"), last["c"].bitwiseXOR(x["c"]).alias("c"),
        )
        return F.when(last["i"] == x["i"], F.struct(state["done"].alias("done"), both.alias("last"))).otherwise(
            F.struct(closed(state).alias("done"), x.alias("last"))
        )

    return F.aggregate(F.sort_array(cells), start, add, closed)


def sketch(keys: Column, attempt: Column, per_table: Column, sign: int = 1) -> Column:
    """The cells of a set of digests, unsorted and not yet added up."""
    return F.flatten(F.transform(keys, lambda k: _cells_of(k, F.lit(sign), attempt, per_table)))


def _peel(cells: Column, attempt: Column, per_table: Column) -> Column:
    """How many digests peeling recovers, and whether it emptied every cell.

    A round takes out all digests that are alone in a cell.
    """
    state = F.struct(cells.alias("cells"), F.lit(0).alias("found"), F.lit(True).alias("more"))

    def round_of(s: Column, _: Column) -> Column:
        alone = F.array_distinct(F.transform(
            F.filter(s["cells"], lambda x: (F.abs(x["n"]) == 1) & (_check(x["k"]) == x["c"])),
            lambda x: F.struct(x["k"].alias("k"), x["n"].alias("n")),
        ))

        def without(pure: Column) -> Column:
            taken = F.flatten(F.transform(pure, lambda x: _cells_of(x["k"], -x["n"], attempt, per_table)))
            return F.struct(
                _added(F.concat(s["cells"], taken)).alias("cells"),
                (s["found"] + F.size(pure)).alias("found"), (F.size(pure) > 0).alias("more"),
            )

        return F.when(s["more"] & (F.size(s["cells"]) > 0), let(alone, without)).otherwise(s)

    peeled = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state, round_of)
    return let(peeled, lambda s: F.struct(s["found"].alias("found"), (F.size(s["cells"]) == 0).alias("ok")))


def differing_digests(a: Column, b: Column) -> Column:
    """How many digests are in one of two sets only, recovered by subtracting and peeling."""

    def attempts(mine: Column) -> Column:
        start = F.struct(F.lit(0).alias("found"), F.lit(False).alias("ok"))
        first = F.greatest(F.lit(LEAST_CELLS), F.ceil((F.size(mine["a"]) + F.size(mine["b"])) * ROOM / TABLES))

        def attempt(state: Column, i: Column) -> Column:
            def tried(cells: Column) -> Column:
                difference = F.concat(sketch(mine["a"], i, cells, 1), sketch(mine["b"], i, cells, -1))
                return _peel(_added(difference), i, cells)

            return F.when(state["ok"], state).otherwise(let((first * F.pow(F.lit(2), i)).cast("int"), tried))

        ended = F.aggregate(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), start, attempt)
        failed = F.raise_error(F.lit(f"not peeled in {ATTEMPTS} attempts")).cast("int")
        return let(ended, lambda x: F.when(x["ok"], x["found"]).otherwise(failed))

    def all_buckets(both: Column) -> Column:
        total = F.size(both["a"]) + F.size(both["b"])
        buckets = F.ceil(total / BUCKET_DIGESTS).cast("int")

        def split(n: Column) -> Column:
            def in_bucket(bucket: Column) -> Column:
                own = lambda keys: F.filter(keys, lambda k: F.pmod(k, n.cast("bigint")) == bucket)
                return let(F.struct(own(both["a"]).alias("a"), own(both["b"]).alias("b")), attempts)

            return F.aggregate(
                F.sequence(F.lit(0), n - 1), F.lit(0), lambda found, bucket: found + in_bucket(bucket)
            )

        return F.when(total <= BUCKET_DIGESTS, attempts(both)).otherwise(let(buckets, split))

    return let(F.struct(a.alias("a"), b.alias("b")), all_buckets)


def likeness(a: Column, b: Column) -> Column:
    """Twice the common digests over all digests of two sets; two empty sets are alike."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise((total - differing_digests(a, b)) / total)


def fingerprint(digests: Column) -> Column:
    """The filled cells of a fingerprint in hexadecimal: place, count, digests, checks."""
    hexadecimal = lambda x, digits: F.lpad(F.hex(x), digits, "0")
    cells = _added(sketch(digests, F.lit(0), F.lit(FINGERPRINT_CELLS)))
    return F.lower(F.array_join(F.transform(cells, lambda x: F.concat(
        hexadecimal(x["i"], 2), hexadecimal(x["n"], 4), hexadecimal(x["k"], 16), hexadecimal(x["c"], 16)
    )), ""))


def _row_key() -> Column:
    """128 bits of the id, a NULL one unlike any other, and the text."""
    key = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    return F.unhex(F.md5(F.concat(key, F.lit("\n"), F.col("text"))))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edit replaces the last floor(n_chars / 3) code points by the first as many (or
    all) of the next document in descending ``doc_id``, the first after the last; a
    single document is its own next. Gives ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``. A NULL text is empty; blank texts
    have an empty fingerprint and are like each other. Rows alike in ``doc_id`` and
    text are one document in the order, and each of them has its result; texts that
    share a ``doc_id`` follow each other by a hash, a NULL ``doc_id`` comes last. An empty table gives an empty
    result. Only ``doc_id`` and ``text`` are read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", text.alias("text")).withColumn("_key", _row_key())
    # The only exchange of whole texts: both joins below are on the same key.
    whole = own.select("_key", "text").dropDuplicates(["_key"])
    sizes = own.select("doc_id", "_key", F.length("text").alias("n")).groupBy("doc_id", "_key", "n").agg(
        F.count("*").alias("rows")
    )
    ordered = materialize(
        number_rows(sizes, F.col("doc_id").desc_nulls_last(), F.col("_key"), name="document-order"), "documents-numbered"
    )
    count = ordered.count()
    following = ordered.select(
        ((F.col("_number") + count - 1) % max(count, 1)).alias("_number"), F.col("_key").alias("next_key")
    )
    wanted = materialize(
        ordered.join(following, "_number").select(
            F.col("_key").alias("for_key"), "doc_id", "n", "rows", F.floor(F.col("n") / 3).cast("int").alias("part"),
            "next_key",
        ),
        "next-documents",
    )
    brought = whole.join(wanted, F.col("_key") == F.col("next_key")).select(
        "for_key", "doc_id", "n", "rows", "part", "next_key",
        F.substring(F.col("text"), F.lit(1), F.col("part")).alias("tail"),
    )
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - F.col("part")), F.col("tail"))
    digested = materialize(
        whole.join(brought, F.col("_key") == F.col("for_key"))
        .withColumn("_edited", edited)
        .select(
            "doc_id", "_key", "next_key", "rows", F.col("n").cast("bigint").alias("n_chars"),
            F.sha2("_edited", 256).alias("edited_sha256"),
            paragraph_digests(F.col("text")).alias("a"), paragraph_digests(F.col("_edited")).alias("e"),
        ),
        "paragraph-digests",
    )
    next_digests = digested.select(F.col("_key").alias("next_key"), F.col("a").alias("b"))
    compared = digested.join(next_digests, "next_key").select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("a")).alias("fingerprint"),
        fingerprint(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("e")).alias("near_edited"), likeness(F.col("a"), F.col("b")).alias("near_next"),
        "rows",
    )
    # One row for each input row; nothing above is computed twice for them.
    copies = F.sequence(F.lit(1).cast("bigint"), F.col("rows"))
    return compared.withColumn("_copy", F.explode(copies)).drop("rows", "_copy")
