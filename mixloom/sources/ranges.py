"""Large JSON arrays and quoted CSV files read by many tasks, each a range of bytes.

What a byte means depends on all bytes before it: whether it lies in a string, and how deep.
Every range is first read for every state it may begin in, which gives one small
row per range; a prefix pass over these rows tells the state that each range does
begin in, and the ranges are read again from it. Ranges are those that Spark's text
reader cuts, so nothing but Spark opens a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

# Range states are sent to every task: some 100 bytes each, with a range for every 128 MB or so.
BROADCAST_RANGES = 1_000_000

PLACES = ("_file", "_block", "_row")

# What opens and closes a JSON value, and what stands between two.
_STEPS = np.zeros(256, dtype=np.int8)
_STEPS[[ord("{"), ord("[")]] = 1
_STEPS[[ord("}"), ord("]")]] = -1
_IS_MARK = _STEPS != 0
_IS_MARK[ord(",")] = True


def largest_file(spark: SparkSession, path: str | list[str]) -> int:
    """Bytes of the largest file of a path; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.max("length")).first()[0] or 0


def splits(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether some file of a path is larger than what one task reads."""
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    units = {"b": 1, "k": 2**10, "m": 2**20, "g": 2**30, "t": 2**40}
    text = size.lower().removesuffix("b") or "0"
    limit = int(text[:-1]) * units[text[-1]] if text[-1] in units else int(text)
    return largest_file(spark, path) > limit


def _pieces(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """The files cut behind every ``separator``, which is dropped, in order within a range."""
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", separator)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.xxhash64(F.col("_metadata.file_path")).alias("_file_hash"), F.col("value").cast("binary").alias("value"),
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The stretches of a batch that belong to one range of one file."""
    hashes, blocks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_file_hash", "_block"))
    edges = np.flatnonzero((hashes[1:] != hashes[:-1]) | (blocks[1:] != blocks[:-1])) + 1
    for start, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
        if end > start:
            yield batch.column("_file")[start].as_py(), int(blocks[start]), batch.slice(start, end - start)


def _with_starts(pieces: DataFrame, starts: DataFrame) -> DataFrame:
    """Every piece with the state its range begins in."""
    if starts.limit(BROADCAST_RANGES + 1).count() > BROADCAST_RANGES:
        raise ValueError("too many ranges; raise spark.sql.files.maxPartitionBytes")
    return pieces.join(F.broadcast(starts), ["_file", "_block"], "left")


def _before(column: Column) -> Column:
    """The sum over all earlier ranges of a file."""
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(earlier), F.lit(0))


# --- JSON -----------------------------------------------------------------------------------


def _json_text(pieces: pa.Array) -> bytes:
    return b"}".join(pieces.to_pylist()) + b"}"


def _marks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of brackets and commas, their bytes, quotes before each (0 or 1), and all quotes.

    A quote behind an odd number of backslashes is none. The text ends in a brace, so no
    backslash reaches beyond it.
    """
    raw = np.frombuffer(text, dtype=np.uint8)
    quotes = np.flatnonzero(raw == ord('"'))
    slashes = np.flatnonzero(raw == ord("\\"))
    if len(slashes) and len(quotes):
        starts = np.concatenate([[True], slashes[1:] != slashes[:-1] + 1])
        run = slashes - np.maximum.accumulate(np.where(starts, slashes, 0)) + 1
        last = np.searchsorted(slashes, quotes) - 1
        behind = (last >= 0) & (slashes[np.maximum(last, 0)] == quotes - 1)
        quotes = quotes[~(behind & (run[np.maximum(last, 0)] % 2 == 1))]
    places = np.flatnonzero(_IS_MARK[raw])
    return places, raw[places], np.searchsorted(quotes, places) & 1, len(quotes)


def _json_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every range: quotes, and the change of depth if it begins outside or inside a string."""
    effects: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for file, block, rows in _runs(batch):
            effect = effects.setdefault((file, block), [0, 0, 0])
            _, marks, quoted, quotes = _marks(_json_text(rows.column("value")))
            steps, inside = _STEPS[marks], quoted ^ (effect[0] & 1)
            effect[1] += int(steps[inside == 0].sum(dtype=np.int64))
            effect[2] += int(steps[inside == 1].sum(dtype=np.int64))
            effect[0] += quotes
    rows = [(*at, *effect) for at, effect in effects.items()]
    yield pa.RecordBatch.from_pylist(
        [dict(zip(("_file", "_block", "quotes", "outside", "inside"), row)) for row in rows],
        schema=pa.schema([("_file", pa.string()), *[(c, pa.int64()) for c in ("_block", "quotes", "outside", "inside")]]),
    )


def _json_starts(pieces: DataFrame) -> DataFrame:
    """Whether each range begins in a string, and how deep."""
    effects = pieces.mapInArrow(_json_effects, "_file string, _block long, quotes long, outside long, inside long")
    quoted = effects.withColumn("quoted", _before(F.col("quotes")) % 2 == 1)
    change = F.when(F.col("quoted"), F.col("inside")).otherwise(F.col("outside"))
    return quoted.select("_file", "_block", "quoted", _before(change).alias("depth"))


class _Depths:
    """The marks outside strings of a range, with the depth before each, batch by batch."""

    def __init__(self, quoted: bool, depth: int):
        self.quoted, self.depth = int(quoted), depth

    def take(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        places, marks, quoted, quotes = _marks(text)
        outside = (quoted ^ self.quoted) == 0
        places, marks = places[outside], marks[outside]
        after = self.depth + np.cumsum(_STEPS[marks], dtype=np.int64)
        before = after - _STEPS[marks]
        self.quoted ^= quotes & 1
        self.depth = int(after[-1]) if len(after) else self.depth
        return places, marks, before


def _lists_opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every range, how many lists open right under the root."""
    opened: dict[tuple[str, int], int] = {}
    states: dict[tuple[str, int], _Depths] = {}
    for batch in batches:
        for file, block, rows in _runs(batch):
            state = states.setdefault((file, block), _Depths(*_start(rows, "quoted", "depth")))
            _, marks, before = state.take(_json_text(rows.column("value")))
            lists = int(((marks == ord("[")) & (before == 1)).sum())
            opened[file, block] = opened.get((file, block), 0) + lists
    yield pa.RecordBatch.from_pylist(
        [{"_file": f, "_block": b, "lists": n} for (f, b), n in opened.items()],
        schema=pa.schema([("_file", pa.string()), ("_block", pa.int64()), ("lists", pa.int64())]),
    )


def _start(rows: pa.RecordBatch, *names: str) -> list:
    values = [rows.column(name)[0].as_py() for name in names]
    if None in values:
        raise ValueError("the files were cut differently when they were read again")
    return values


class _Cutter:
    """The values of one list in a range, and what of them reaches over its borders."""

    def __init__(self, quoted: bool, depth: int, lists: int, level: int):
        self.state, self.level, self.lists = _Depths(quoted, depth), level, lists
        # Only the first list under the root counts, or the root itself.
        self.open = depth >= level and lists == (1 if level > 1 else 0)
        self.carried = self.open
        self.pending: list[bytes] = []

    def take(self, text: bytes) -> Iterator[tuple[str, bytes]]:
        """Whole values, and the end of one that began before the range."""
        places, marks, before = self.state.take(text)
        level, at = self.level, 0
        opening = (marks == ord("[")) & (before == level - 1)
        ending = ((marks == ord(",")) | (marks == ord("]"))) & (before == level)
        for k in np.flatnonzero(opening | ending).tolist():
            place = int(places[k])
            if opening[k]:
                self.lists += level > 1
                if self.lists == (1 if level > 1 else 0) and not self.open:
                    self.open, self.carried, at = True, False, place + 1
            elif self.open:
                value = b"".join([*self.pending, text[at:place]])
                if self.carried:
                    yield "end", value
                elif value.strip():
                    yield "whole", value
                self.pending, self.carried, at = [], False, place + 1
                if marks[k] == ord("]"):
                    self.open = False
                    self.lists += level == 1
        if self.open:
            self.pending.append(text[at:])

    def rest(self) -> Iterator[tuple[str, bytes]]:
        if self.open:
            yield "middle" if self.carried else "start", b"".join(self.pending)


_CUT = pa.schema([("_file", pa.string()), ("_block", pa.int64()), ("_row", pa.int64()), ("part", pa.string()), ("value", pa.string())])
# Values handed on at once.
CUT_ROWS = 5_000


def _cut(level: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, cutter, row, held = None, None, 0, []

        def hold(found: Iterator[tuple[str, bytes]]) -> None:
            nonlocal row
            for part, value in found:
                held.append((*current, row, part, value.decode()))
                row += 1

        def handed() -> pa.RecordBatch:
            columns = list(zip(*held)) or [()] * len(_CUT)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CUT)], schema=_CUT)

        for batch in batches:
            for file, block, rows in _runs(batch):
                if (file, block) != current:
                    if cutter is not None:
                        hold(cutter.rest())
                    current, row = (file, block), 0
                    cutter = _Cutter(*_start(rows, "quoted", "depth", "lists"), level)
                hold(cutter.take(_json_text(rows.column("value"))))
            if len(held) >= CUT_ROWS:
                yield handed()
        if cutter is not None:
            hold(cutter.rest())
        yield handed()

    return cut


def json_elements(spark: SparkSession, path: str | list[str], of_root_object: bool = False) -> DataFrame:
    """The elements of JSON arrays as texts: ``value``, and its place ``_file``, ``_block``, ``_row``.

    A file is an array, or with ``of_root_object`` an object whose first list (in source order)
    gives the elements. Files of any size are read by many tasks at once; an
    element may be larger than a range. Places order the elements of a file. An element
    is not parsed here, so malformed JSON inside one is told by who parses it.
    """
    pieces = _pieces(spark, path, "}")
    starts = _json_starts(pieces)
    level = 2 if of_root_object else 1
    if of_root_object:
        opened = _with_starts(pieces, starts).mapInArrow(_lists_opened, "_file string, _block long, lists long")
        starts = starts.join(opened.withColumn("lists", _before(F.col("lists"))), ["_file", "_block"])
    else:
        starts = starts.withColumn("lists", F.lit(0).cast("long"))
    cut = _with_starts(pieces, starts).mapInArrow(_cut(level), "_file string, _block long, _row long, part string, value string")
    elements = _put_together(cut, "")
    return elements.filter(F.length(F.btrim("value", F.lit(" \t\r\n"))) > 0)


def files_without_list(spark: SparkSession, path: str | list[str]) -> list[str]:
    """JSON object files in which no list lies right under the root."""
    pieces = _pieces(spark, path, "}")
    opened = _with_starts(pieces, _json_starts(pieces)).mapInArrow(_lists_opened, "_file string, _block long, lists long")
    return [r["_file"] for r in opened.groupBy("_file").agg(F.sum("lists").alias("n")).filter("n = 0").collect()]


def _put_together(cut: DataFrame, between: str) -> DataFrame:
    """Whole values, and those over several ranges from their parts, of which a range has at most two."""
    whole = cut.filter("part = 'whole'").drop("part")
    order = Window.partitionBy("_file").orderBy("_block", "_row")
    parts = cut.filter("part <> 'whole'").withColumn("_of", F.sum(F.expr("int(part = 'start')")).over(order))
    joined = parts.groupBy("_file", "_of").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_row", "value"))).alias("parts")
    )
    first = F.get("parts", F.lit(0))
    value = F.array_join(F.transform("parts", lambda p: p["value"]), between)
    return whole.unionByName(
        joined.select("_file", first["_block"].alias("_block"), first["_row"].alias("_row"), value.alias("value"))
    )


def parse_elements(elements: DataFrame, schema: str | T.StructType | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Element texts as rows; a malformed one raises.

    Without a schema it is inferred as Spark's JSON reader does, in a pass of its own.
    """
    spark = elements.sparkSession
    if schema is None:
        # Only the schema comes from here; the reader takes texts as an RDD alone.
        texts = elements.select("value").rdd.map(lambda row: row[0])
        schema = spark.read.option("mode", "FAILFAST").json(texts).schema
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    row = F.from_json("value", schema, {"mode": "FAILFAST"})
    return elements.select(*keep, row.alias("row")).select(*keep, "row.*")


# --- CSV ------------------------------------------------------------------------------------


def _quoted_after(line: bytes, quoted: bool) -> bool:
    """Whether a quoted field is open after a line, if one was or was not open before it.

    A quote opens a field at its beginning only; inside, a doubled quote is a character.
    """
    at, size = 0, len(line)
    while True:
        if quoted:
            while True:
                at = line.find(b'"', at)
                if at < 0:
                    return True
                if line[at + 1:at + 2] != b'"':
                    break
                at += 2
            at += 1
        elif line[at:at + 1] == b'"':
            quoted, at = True, at + 1
            continue
        quoted = False
        at = line.find(b",", at)
        if at < 0 or at >= size:
            return False
        at += 1


def _csv_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every range: whether a quoted field is open after it, if none or one was before."""
    effects: dict[tuple[str, int], list[bool]] = {}
    for batch in batches:
        for file, block, rows in _runs(batch):
            effect = effects.setdefault((file, block), [False, True])
            for line in rows.column("value").to_pylist():
                if b'"' in line:
                    alike = effect[0] == effect[1]
                    effect[0] = _quoted_after(line, effect[0])
                    effect[1] = effect[0] if alike else _quoted_after(line, effect[1])
    yield pa.RecordBatch.from_pylist(
        [{"_file": f, "_block": b, "closed": e[0], "open": e[1]} for (f, b), e in effects.items()],
        schema=pa.schema([("_file", pa.string()), ("_block", pa.int64()), ("closed", pa.bool_()), ("open", pa.bool_())]),
    )


def _csv_starts(pieces: DataFrame) -> DataFrame:
    """Whether each range begins in a quoted field.

    The last range before it whose outcome does not depend on its beginning decides, turned
    round by every range since that swaps the two.
    """
    effects = pieces.mapInArrow(_csv_effects, "_file string, _block long, closed boolean, open boolean")
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    swaps = effects.withColumn("swaps", F.sum(F.expr("int(closed and not open)")).over(
        Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ))
    decided = F.last(F.when(F.col("closed") == F.col("open"), F.struct("closed", "swaps")), True).over(earlier)
    last = F.coalesce(F.lag("swaps").over(Window.partitionBy("_file").orderBy("_block")), F.lit(0))
    since = last - F.coalesce(decided["swaps"], F.lit(0))
    return swaps.select("_file", "_block", (F.coalesce(decided["closed"], F.lit(False)) != (since % 2 == 1)).alias("quoted"))


# The row number of a file's header.
HEADER_ROW = -1


def _csv_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records, and the lines at a range's borders that belong to records over several ranges."""
    current, quoted, carried, row, pending, held = None, False, False, 0, [], []

    def hold(part: str) -> None:
        nonlocal row
        value = b"\n".join(line.removesuffix(b"\r") for line in pending)
        pending.clear()
        if value or part != "whole":
            held.append((*current, row, part, value.decode()))
            row += 1

    def handed() -> pa.RecordBatch:
        columns = list(zip(*held)) or [()] * len(_CUT)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CUT)], schema=_CUT)

    for batch in batches:
        for file, block, rows in _runs(batch):
            if (file, block) != current:
                if pending:
                    hold("middle" if carried else "start")
                (quoted,) = _start(rows, "quoted")
                current, row, carried = (file, block), 0 if block else HEADER_ROW, quoted
            for line in rows.column("value").to_pylist():
                pending.append(line)
                if quoted or b'"' in line:
                    quoted = _quoted_after(line, quoted)
                if not quoted:
                    hold("end" if carried else "whole")
                    carried = False
        if len(held) >= CUT_ROWS:
            yield handed()
    if pending:
        hold("middle" if carried else "start")
    yield handed()


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The records of CSV files as texts, headers and blank lines included: ``value`` and its place.

    Quoted fields may hold line feeds; files of any size are read by many tasks at once.
    """
    pieces = _pieces(spark, path, "\n")
    cut = _with_starts(pieces, _csv_starts(pieces)).mapInArrow(
        _csv_records, "_file string, _block long, _row long, part string, value string"
    )
    return _put_together(cut, "\n")


def parse_records(records: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Record texts as rows of strings, the first of each file, its header, left out."""
    body = records.filter((F.col("_block") != 0) | (F.col("_row") != HEADER_ROW))
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    row = F.from_csv("value", F.lit(schema.toDDL()), {"escape": '"', "mode": "FAILFAST"})
    return body.select(*keep, row.alias("row")).select(*keep, "row.*")
