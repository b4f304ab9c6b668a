"""Operator 4: repeated runs of lines, found by prefix doubling over line numbers.

A line with several sentences is as many units, so that a passage may begin and end
inside a line; every other line is one unit. Every unit has a name: two 64-bit hashes of
its text. Units that occur once break a run and leave at the start.
The suffixes of a document's unit sequence are then named by their first unit, eight
units, 64 units and so on: doubling by a factor of ``STEP`` (a-tupling, Dementiev et al.
2008), which takes a third of the rounds. A round names tuples of names, as Karp, Miller
and Rosenberg do; a name is two hashes of the tuple and not its place in a sorted list, as
only equal names are asked for, so that no tuple moves. Suffixes of one name after k
rounds are an interval of the suffix array whose longest common prefix is at least STEP**k
units. A run of any length between two powers is up to STEP names of the lower one, the
last ending with it: suffixes with equal names there share the run.

A document's names are arrays in one row: tuples are formed and runs looked up inside it,
and only runs move. A run matters when it has ``min_words`` words. For every unit the
shortest such run that starts there and the shortest that ends there are looked up;
together they cover exactly the units of all maximal repeated runs of that many words. The
first copy in corpus order stays, later ones are deleted.

All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mixloom.llm.common import WORD, let, number_rows
from mixloom.session import materialize

MIN_WORDS = 50
# A round names suffixes by so many times the units of the round before.
STEP = 8
# More than the units of any text.
PLACES = 1 << 31
# Where a sentence begins inside a line: after an end mark, a closing quote or bracket if
# any, and blanks, or right after a full-width mark.
SENTENCE_START = (
    r"(?<=[ \t\u3002\uff01\uff1f])(?=\S)"
    r"(?:(?<=[.!?\u2026][\"'\u201d\u2019)\]]?[ \t]{1,2})|(?<=[\u3002\uff01\uff1f]))"
)
# The same from the end mark on, which is faster to look for.
SENTENCE_END = (
    r"[.!?\u2026\u3002\uff01\uff1f]"
    r"(?:(?<=[\u3002\uff01\uff1f])|(?<=[.!?\u2026])[\"'\u201d\u2019)\]]?[ \t]{1,2})(?=\S)"
)
# The same in a text without the marks beyond ASCII, faster still.
WIDE_MARKS = "\u2026\u3002\uff01\uff1f"
PLAIN_END = r"[.!?][\"'\u201d\u2019)\]]?[ \t]{1,2}(?=\S)"
# White space inside a line, and line ends with all of it on either side.
BLANKS = " \t\x0b\x0c\r"
AROUND_END = f"(?<![{BLANKS}])[{BLANKS}]*+\\n[{BLANKS}\\n]*+"
# Put after every such end; a text that holds it already is cut at sentence starts.
MARK = "\x1e"


def _key() -> Column:
    return F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")))


def _ends_followed_by(text: Column, mark: str) -> Column:
    """The text with ``mark`` after every sentence end inside a line."""
    wide = F.lit(False)
    for end in WIDE_MARKS:
        wide |= F.contains(text, F.lit(end))
    return F.regexp_replace(text, F.when(wide, SENTENCE_END).otherwise(PLAIN_END), F.lit(f"$0{mark}"))


def _units(text: Column) -> Column:
    """Lines cut at sentence starts, ``line, text`` each; a line's units make it up unchanged.

    A cut is followed by a character that is no white space, so of a line with a word
    every unit has one.
    """
    def by(cut: str, texts: Column) -> Column:
        return F.flatten(F.transform(F.split(texts, "\n"), lambda line, i: F.transform(
            F.split(line, cut), lambda unit: F.struct(i.alias("line"), unit.alias("text"))
        )))

    # One pass marks the ends in the whole text, and a single character is a cheap cut.
    marked = _ends_followed_by(text, MARK)
    return F.when(F.contains(text, F.lit(MARK)), by(SENTENCE_START, text)).otherwise(by(MARK, marked))


def _odd_blanks(text: Column) -> Column:
    """Whether words may be parted by anything but single blanks."""
    odd = F.contains(text, F.lit("  "))
    for space in "\t\x0b\x0c\r":
        odd |= F.contains(text, F.lit(space))
    return odd


def _word_count(trimmed: Column, odd: Column) -> Column:
    """Words of a unit with a word at either end; cheap where single blanks part them.

    ``odd`` is :func:`_odd_blanks` of the whole text, which spares its units the look.
    """
    blanks = F.octet_length(trimmed) - F.octet_length(F.replace(trimmed, F.lit(" "), F.lit("")))
    return F.when(odd & _odd_blanks(trimmed), F.regexp_count(trimmed, F.lit(WORD))).otherwise(blanks + 1).cast("int")


def _unit_texts(text: Column) -> Column:
    """The texts of :func:`_units` alone, cut in one go: a sentence end becomes a line end too."""
    return F.split(_ends_followed_by(text, "\n"), "\n")


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def document_units(docs: DataFrame) -> DataFrame:
    """``key, doc_id, row, nth, words, h1, h2`` of every unit that has a word.

    ``nth`` counts the units of a text that have a word, from 0; ``key`` is a hash of the id
    and the text, so rows alike in both are one document and NULL ids have a key too;
    ``row`` tells such rows apart. Two 64-bit hashes stand for the unit without
    the white space around it.
    """
    text, odd = F.coalesce(F.col("text"), F.lit("")), _odd_blanks(F.col("text"))
    # Where single blanks part the words, a unit has a blank at either end at most; else the
    # text loses what is around its units in one go, which no function per unit does as cheaply.
    ended = _ends_followed_by(text, "\n")
    bare = F.when(odd, _trimmed(F.regexp_replace(ended, AROUND_END, "\n"))).otherwise(ended)
    worded = F.array_remove(F.array_remove(F.split(bare, "\n"), ""), " ")
    # The key is computed with the units, once for a text and not once for every unit of it.
    cut = docs.select(
        _key().alias("key"), "doc_id", F.monotonically_increasing_id().alias("row"),
        worded.alias("_units"), odd.alias("_odd"),
    )
    units = cut.select("key", "doc_id", "row", "_odd", F.posexplode("_units").alias("nth", "_text"))
    return units.withColumn("_text", F.trim("_text")).select(
        "key", "doc_id", "row", "nth", _word_count(F.col("_text"), F.col("_odd")).alias("words"),
        F.xxhash64("_text").alias("h1"), F.xxhash64(F.lit(1), "_text").alias("h2"),
    )


def _repeating_units(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The units that occur more than once; and each key's place in corpus order, ``doc``.

    A unit of the same first hash as another counts as repeated: it may only be looked up in
    vain, as runs are told apart by both.
    """
    units = materialize(document_units(docs), "units")
    # Rows alike in id and text are one document: the first of them stands for all.
    heads = materialize(units.filter("nth = 0").select("key", "doc_id", "row"), "document-keys")
    rows = heads.groupBy("key").agg(F.min("row").alias("_first"), F.count("*").alias("_n"))
    again = materialize(rows.filter("_n > 1").select("key", "_first"), "repeated-rows")
    if not again.isEmpty():
        units, heads = (
            df.join(again, "key", "left").filter("_first IS NULL OR row = _first").drop("_first") for df in (units, heads)
        )
    repeated = units.groupBy("h1").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    slim = units.select("h1", "h2", "key", "nth", "words")
    # The hashed side is the smaller one, and the units need no sorting.
    repeating = slim.join(repeated.hint("shuffle_hash"), "h1", "left_semi")
    order = number_rows(heads.drop("row"), F.col("doc_id").asc_nulls_first(), "key", name="document-order")
    return repeating, order.select("key", F.col("_number").alias("doc"))


def _stretches(repeating: DataFrame, order: DataFrame, min_words: int) -> DataFrame:
    """One row a document that has stretches long enough, with its repeated units.

    Gives ``key``, ``doc`` and arrays of one length, in the order of the text: ``nth``,
    ``h1_0`` and ``h2_0`` (the unit's name), and ``ahead``, the units of the shortest run of
    ``min_words`` words that starts there; without one, the units left of the stretch, below
    zero. A stretch is a sequence of neighbouring repeated units.

    A shortest run that ends at a unit starts at the last unit whose own run does not reach
    beyond it. So the runs to look up from a unit have ``ahead`` units and more, until the
    next unit's run fits (``upto``, NULL where no run starts): one less than would end where
    that does, or all that is left of the stretch.
    """
    in_doc = Window.partitionBy("key").orderBy("nth")
    counted = repeating.withColumns({
        "stretch": F.col("nth") - F.row_number().over(in_doc),
        "after": F.sum("words").over(in_doc.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"),
    })
    # A stretch starts so many words further on that no frame reaches from one into another.
    placed = counted.withColumn("to", F.col("after") + F.col("stretch").cast("bigint") * min_words)
    placed = placed.withColumn("from", F.col("to") - F.col("words"))
    # Units that start within the words wanted: every unit has a word, so a frame holds at
    # most min_words units. The last of them ends furthest.
    frame = Window.partitionBy("key").orderBy("from").rangeBetween(0, min_words - 1)
    spans = placed.withColumns({"_n": F.count("*").over(frame).cast("int"), "_end": F.max("to").over(frame)})
    enough = F.col("_end") - F.col("from") >= min_words
    spans = spans.withColumn("ahead", F.when(enough, F.col("_n")).otherwise(-F.col("_n")))
    in_order = Window.partitionBy("key").orderBy("from")
    after, joined = F.lead("ahead").over(in_order), F.lead("nth").over(in_order) == F.col("nth") + 1
    upto = F.when(joined, F.greatest("ahead", after, 1 - after)).otherwise(F.col("ahead"))
    spans = spans.withColumns({"h1_0": F.col("h1"), "h2_0": F.col("h2"), "upto": F.when(F.col("ahead") > 0, upto)})
    columns = ["nth", "h1_0", "h2_0", "ahead", "upto"]
    rows = spans.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct(*columns))).alias("_units"), F.max("upto").alias("_most")
    ).filter("_most > 0")
    # The numbers are hashed, so that no array is sorted.
    numbered = rows.join(order.hint("shuffle_hash"), "key")
    return materialize(
        numbered.select("key", "doc", *[F.col(f"_units.{c}").alias(c) for c in columns]), "line-stretches"
    )


def _times(stretches: DataFrame, level: int) -> DataFrame:
    """The stretches with names by ``STEP`` times as many units; NULL where a stretch ends before."""
    size = STEP**level

    def names(name: str, *seed: Column) -> Column:
        own = f"{name}_{level}"

        def suffix(nth: Column, i: Column) -> Column:
            # Places are numbered without gaps inside a stretch, and with one between two.
            last = F.get("nth", i + (STEP * size - 1)) == nth + (STEP * size - 1)
            return F.when(last, F.xxhash64(*seed, *[F.get(own, i + j * size) for j in range(STEP)]))

        # None are asked for in a document without runs of that many units.
        asked = F.array_max("upto") >= STEP * size
        return F.when(asked, F.transform("nth", suffix)).alias(f"{name}_{level + 1}")

    return materialize(stretches.select("*", names("h1"), names("h2", F.lit(1))), "suffix-ranks")


def _runs(stretches: DataFrame, levels: int) -> DataFrame:
    """``key, place, length, h1, h2`` of the runs to look up, alike where the units are.

    A run is the names of the highest level that fit into it, side by side, the last one
    ending with it. ``place`` is one number for document and first unit, that needs no sorting
    to find the least: a text has fewer than ``PLACES`` units.
    """
    def names(name: str, start: Column, length: Column, level: int) -> Column:
        if level == 0:
            return F.transform(F.sequence(start, start + length - 1), lambda i: F.get(f"{name}_0", i))
        size = STEP**level
        last = F.ceil(length / size).cast("int") - 1
        at = lambda j: start + F.least(j * size, length - size)
        own = F.transform(F.sequence(F.lit(0), last), lambda j: F.get(f"{name}_{level}", at(j)))
        return F.when(length >= size, own).otherwise(names(name, start, length, level - 1))

    def run(start: Column, length: Column) -> Column:
        return F.struct(
            F.get("nth", start).alias("start"), length.alias("length"),
            F.xxhash64(names("h1", start, length, levels)).alias("h1"),
            F.xxhash64(F.lit(1), names("h2", start, length, levels)).alias("h2"),
        )

    def lengths(i: Column) -> Column:
        return F.transform(F.sequence(F.get("ahead", i), F.get("upto", i)), lambda length: run(i, length))

    places = F.filter(F.sequence(F.lit(0), F.size("nth") - 1), lambda i: F.get("ahead", i) > 0)
    found = stretches.select("key", "doc", F.explode(F.flatten(F.transform(places, lengths))).alias("_run"))
    place = F.col("doc") * PLACES + F.col("_run.start")
    return found.select("key", place.alias("place"), "_run.length", "_run.h1", "_run.h2")


def _repeated_spans(docs: DataFrame, min_words: int) -> DataFrame:
    """``key, from, end``: the units of later copies as spans, apart from each other; ``end`` is outside."""
    if min_words < 1:
        raise ValueError(f"min_words={min_words} must be at least 1")
    stretches = _stretches(*_repeating_units(docs), min_words)
    longest = stretches.agg(F.max(F.array_max("upto"))).first()[0]
    if longest is None:
        return stretches.select("key", F.explode("nth").alias("from")).withColumn("end", F.col("from")).limit(0)
    levels = 0
    while STEP ** (levels + 1) <= longest:
        stretches = _times(stretches, levels)
        levels += 1
    runs = materialize(_runs(stretches, levels), "runs")
    interval = ["length", "h1", "h2"]
    first = runs.groupBy(*interval).agg(F.min("place").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    later = runs.join(first.drop("_n").hint("shuffle_hash"), interval).filter("place <> _first")
    start = (F.col("place") % PLACES).cast("int")
    later = later.select("key", start.alias("from"), (start + F.col("length")).alias("end"))
    # A span begins at a run that those before it do not reach, and ends where they end.
    runs_of = Window.partitionBy("key").orderBy("from")
    before = F.max("end").over(runs_of.rowsBetween(Window.unboundedPreceding, -1))
    last = F.max("end").over(Window.partitionBy("key"))
    begun = later.withColumns({"_before": before, "_last": last}).filter("_before IS NULL OR from > _before")
    ends = F.coalesce(F.lead("_before").over(runs_of), F.col("_last"))
    return begun.select("key", "from", ends.alias("end"))


def _places(span: Column) -> Column:
    return F.sequence(span["from"], span["end"] - 1)


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``key, nth``: the units of every later copy of a repeated run.

    A run is a sequence of neighbouring units of one document, units without a word
    left out. It counts when it has at least ``min_words`` words and the same sequence
    occurs earlier: in a document with a smaller ``doc_id`` (NULL first), or in the
    same one further up, where the two may overlap.
    """
    spans = _repeated_spans(docs, min_words)
    return spans.select("key", F.explode(_places(F.struct("from", "end"))).alias("nth"))


def _worded(units: Column) -> Column:
    """Places of the units that have a word."""
    places = F.sequence(F.lit(0), F.size(units) - 1)
    # Any letter but a blank will do, so that most units need no second look.
    first = lambda text: F.substring(text, 1, 1)
    text = lambda i: F.get(units, i)["text"]
    return F.filter(places, lambda i: (first(text(i)) > " ") | (_trimmed(text(i)) != ""))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``key, doc_id, line``: the lines that lie, as a whole or in part, in a later copy."""
    gone = repeated_units(docs, min_words)
    units = _units(F.coalesce(F.col("text"), F.lit("")))
    lines = let(units, lambda u: F.transform(_worded(u), lambda i: F.get(u, i)["line"]))
    rows = docs.select(_key().alias("key"), "doc_id", F.posexplode(lines).alias("nth", "line"))
    return rows.join(gone, ["key", "nth"]).select("key", "doc_id", "line").distinct()


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without the later copies of repeated runs, all columns kept.

    Adds ``lines_deleted``, the lines that went or lost sentences. What is left stays as it
    is, blank lines too; a text that loses nothing is unchanged, NULL stays NULL, and a
    text that was a copy as a whole becomes empty. Rows alike in ``doc_id`` and ``text``
    are one document and change alike; a NULL ``doc_id`` comes first in the order. Line
    ends are line feeds. An ``n_chars`` column is counted anew. An empty table gives an
    empty result.
    """
    spans = _repeated_spans(docs, min_words).groupBy(F.col("key").alias("_key"))
    gone = spans.agg(F.collect_list(F.struct("from", "end")).alias("_spans"))
    gone = gone.select("_key", F.flatten(F.transform("_spans", _places)).alias("_nth"))
    # The places are hashed, so that no text is sorted.
    joined = docs.withColumn("_key", _key()).join(gone.hint("shuffle_hash"), "_key", "left")
    gone_places = lambda units: let(_worded(units), lambda w: F.transform("_nth", lambda n: F.get(w, n)))

    def in_lines(units: Column) -> Column:
        new_line = lambda u, j: (j > 0) & (F.get(units, j - 1)["line"] != u["line"])
        return F.array_join(
            F.transform(units, lambda u, j: F.concat(F.when(new_line(u, j), "\n").otherwise(""), u["text"])), ""
        )

    def cut(units: Column, gone: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(units) - 1), gone)
        return F.struct(
            let(F.transform(places, lambda i: F.get(units, i)), in_lines).alias("text"),
            F.size(F.array_distinct(F.transform(gone, lambda i: F.get(units, i)["line"]))).alias("lines"),
        )

    # A text is cut once for all columns that its units give.
    left = let(_units(F.col("text")), lambda units: let(gone_places(units), lambda gone: cut(units, gone)))
    joined = joined.withColumn("_left", F.when(F.col("_nth").isNotNull(), left))
    by_cut = lambda column, value: F.when(F.col("_nth").isNull(), column).otherwise(value)
    own = {
        "text": by_cut(F.col("text"), F.col("_left.text")), "lines_deleted": by_cut(F.lit(0), F.col("_left.lines")),
    }
    if "n_chars" in docs.columns:
        own["n_chars"] = by_cut(F.col("n_chars"), F.length("_left.text")).cast(docs.schema["n_chars"].dataType)
    return joined.withColumns(own).drop("_nth", "_key", "_left")
