"""Readers for JSON, JSON lines, CSV, text and Parquet files."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from mixloom.operators.sampling import DRIVER_ROWS
from mixloom.session import materialize
from mixloom.sources import ranges

CORRUPT = "_corrupt_record"

# File pieces whose offsets are broadcast: some 100 bytes each.
BROADCAST_PIECES = 1_000_000


def json_shapes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file`` and ``lines`` of every JSON file: whether it holds one value per line.

    That is so when its first line that is not blank is a JSON object as it stands;
    an array, or an object that goes on in the next line, is one value per file. Only
    that line is parsed, and no line of an array is ever held: files are looked at brace by
    brace first.
    """
    def first_of(separator: str, value: Column) -> DataFrame:
        rows = spark.read.options(recursiveFileLookup=True, lineSep=separator).text(path).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"), F.btrim("value", F.lit(" \t\r\n")).alias("value"),
        )
        return rows.filter("value != ''").groupBy("file").agg(F.min_by(value, F.struct("block", "at")).alias("first"))

    begins = first_of("}", F.substring("value", 1, 1))
    if begins.filter("first <> '['").isEmpty():
        return begins.select("file", F.lit(False).alias("lines"))
    is_object = F.col("first").startswith("{") & F.coalesce(F.json_object_keys("first").isNotNull(), F.lit(False))
    return first_of("\n", F.col("value")).select("file", is_object.alias("lines"))


def holds_lines(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether all JSON files of a path hold one value per line; files of both kinds raise."""
    shapes = json_shapes(spark, path).agg(F.bool_and("lines").alias("all"), F.bool_or("lines").alias("any")).first()
    if shapes["all"] != shapes["any"]:
        raise ValueError(f"{path} holds JSON lines and JSON arrays; read them apart")
    return bool(shapes["all"])


def read_json(
    spark: SparkSession, path: str | list[str], field: str | None = None,
    schema: str | T.StructType | None = None,
) -> DataFrame:
    """A JSON file as rows, an array or one object per line; with ``field``, that list's rows.

    The shape is that of the files' first lines. A large array is read by many tasks; with
    ``field``, or an object that goes over several lines, a file is one task.
    """
    if field is None and holds_lines(spark, path):
        return read_jsonl(spark, path, schema)
    if field is None and ranges.splits(spark, path) and _all_arrays(spark, path):
        return ranges.parse_elements(ranges.json_elements(spark, path), schema)
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    df = (reader.schema(schema) if schema else reader).json(path)
    if field is None:
        return df
    items = df.schema[field].dataType
    if not isinstance(items, T.ArrayType):
        raise ValueError(f"'{field}' is not a list")
    if isinstance(items.elementType, T.StructType):
        return df.select(F.inline(field))
    return df.select(F.explode(field).alias("value"))


def _all_arrays(spark: SparkSession, path: str | list[str]) -> bool:
    pieces = spark.read.options(recursiveFileLookup=True, lineSep="}").text(path)
    first = pieces.filter(F.col("_metadata.file_block_start") == 0).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"),
        F.substring(F.btrim("value", F.lit(" \t\r\n")), 1, 1).alias("begin"),
    ).filter("begin != ''").groupBy("file").agg(F.min_by("begin", "at").alias("begin"))
    return first.filter("begin <> '['").isEmpty()


def read_json_root(spark: SparkSession, path: str) -> DataFrame:
    """Object files as the rows of each one's first list, in source order; else as one row.

    The JSON reader sorts keys by name, so the order is taken from the text. Large files
    are read by many tasks and their lists' rows parsed together; of small ones, those
    whose first lists have one name.
    """
    if ranges.splits(spark, path):
        return _read_large_root(spark, path)
    text = spark.read.text(path, wholetext=True)
    value_of = lambda k: F.call_function("get_json_object", "value", F.concat(F.lit("$['"), k, F.lit("']")))
    lists = F.filter(F.json_object_keys("value"), lambda k: F.ltrim(value_of(k)).startswith("["))
    found = text.select(F.col("_metadata.file_path").alias("file"), F.get(lists, 0).alias("field")).collect()
    files: dict[str | None, list[str]] = {}
    for row in sorted(found, key=lambda r: r["file"]):
        files.setdefault(row["field"], []).append(unquote(row["file"]))
    tables = [read_json(spark, chosen, field=field) for field, chosen in files.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _read_large_root(spark: SparkSession, path: str) -> DataFrame:
    """The same, cut into elements by many tasks; files without a list are one row each."""
    elements = ranges.json_elements(spark, path, of_root_object=True)
    plain = elements.filter(~F.btrim("value", F.lit(" \t\r\n")).startswith("{"))
    if not plain.isEmpty():
        elements = elements.withColumn("value", F.concat(F.lit('{"value":'), "value", F.lit("}")))
    tables = [ranges.parse_elements(elements)]
    without = ranges.files_without_list(spark, path)
    if without:
        tables.append(read_json(spark, [unquote(f) for f in without]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_jsonl(
    spark: SparkSession, path: str | list[str], schema: str | T.StructType | None = None,
    quarantine: bool = False,
) -> DataFrame:
    """JSON lines, blank lines skipped. A malformed line raises.

    With ``quarantine`` malformed lines are kept as text in ``_corrupt_record``.
    Without a schema the files are read twice, the first time to infer it.
    """
    reader = spark.read.option("mode", "PERMISSIVE" if quarantine else "FAILFAST")
    if schema is None:
        return reader.json(path)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if quarantine and CORRUPT not in schema.names:
        schema = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    return reader.schema(schema).json(path)


def read_csv(
    spark: SparkSession, path: str | list[str], multiline: bool = True, keep_nulls: bool = False
) -> DataFrame:
    """CSV with a header, every value a string, empty values kept as empty strings.

    Quoted fields may hold line breaks unless ``multiline`` is off. Large files
    are read by many tasks either way; without ``multiline`` in one pass.
    """
    if multiline and ranges.splits(spark, path):
        names = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False).columns
        df = ranges.parse_records(ranges.csv_records(spark, path), names)
        return df if keep_nulls else df.na.fill("")
    df = spark.read.csv(
        path, header=True, multiLine=multiline, escape='"', inferSchema=False, mode="FAILFAST"
    )
    return df if keep_nulls else df.na.fill("")


def read_text(spark: SparkSession, path: str | list[str], drop_empty: bool = True) -> DataFrame:
    """One row per line in ``text``; empty lines dropped unless asked for."""
    df = spark.read.text(path).withColumnRenamed("value", "text")
    return df.filter(F.length("text") > 0) if drop_empty else df


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    return spark.read.parquet(*paths)


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table just read, spread over the cores when it came in fewer pieces.

    For costly per-row work on small files. A table of many splits is returned
    as it is, so nothing large is ever shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


READERS: dict[str, Callable[..., DataFrame]] = {
    ".json": read_json,
    ".jsonl": read_jsonl,
    ".csv": read_csv,
    ".txt": read_text,
    ".parquet": read_parquet,
}


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """A file or directory by the suffix of its name."""
    if suffix(path) not in READERS:
        raise ValueError(f"no reader for files of type {suffix(path)!r}")
    return READERS[suffix(path)](spark, path)


def load_custom(
    spark: SparkSession, loader: Callable[[SparkSession, dict], DataFrame], options: dict
) -> DataFrame:
    """A user's loader; its table is taken as it is, no sample limit applied."""
    return loader(spark, options)


def with_places(df: DataFrame) -> tuple[DataFrame, bool]:
    """Add where every row of a table just read from files lies: file, piece and row.

    Also tells whether reading again gives the same places. Parquet knows its
    row numbers; rows of other formats are numbered as they are read, and file
    pieces may be cut differently the next time. Rows of large files bring their places.
    """
    if set(ranges.PLACES) <= set(df.columns):
        return df, False
    file = F.col("_metadata.file_path")
    try:
        return df.withColumns({"_file": file, "_block": F.lit(0).cast("bigint"), "_row": F.col("_metadata.row_index")}), True
    except AnalysisException:
        block = F.col("_metadata.file_block_start")
        return df.withColumns({"_file": file, "_block": block, "_row": F.monotonically_increasing_id()}), False


def number_rows(placed: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Places replaced by the row's position in source order, counted within ``by``.

    Files come in path order. The running sizes of the file pieces, a small
    written table, are joined back. The places must be the same when read again.
    """
    piece = [*by, "_file", "_block"]
    size = F.max("_row") - F.min("_row") + 1
    pieces = materialize(
        placed.groupBy(*piece).agg(size.alias("_n"), F.min("_row").alias("_first")), "file-pieces"
    )
    earlier = Window.partitionBy(*by).orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")
    shifts = pieces.select(*piece, shift.alias("_shift"))
    if pieces.limit(BROADCAST_PIECES + 1).count() <= BROADCAST_PIECES:
        shifts = F.broadcast(shifts)
    numbered = placed.join(shifts, piece).withColumn(name, F.col("_shift") + F.col("_row"))
    return numbered.drop("_file", "_block", "_row", "_shift")


def with_positions(df: DataFrame, name: str = "_id") -> DataFrame:
    """Add every row's position in source order to a table just read from files.

    Formats without row numbers are written to the shared folder once, with
    their places, and go on from there.
    """
    placed, stable = with_places(df)
    numbered = number_rows(placed if stable else materialize(placed, "placed"), name)
    return numbered.select(*[c for c in df.columns if c not in ranges.PLACES], name)


def first_in_source(df: DataFrame, n: int | None) -> DataFrame:
    """The first n rows in source order of a table just read from files.

    Few rows are a top-n over (file, piece, row number); many are a filter on
    the rows' positions, so that no task has to hold them.
    """
    if not n:
        return df
    if n > DRIVER_ROWS:
        return with_positions(df, "_position").filter(F.col("_position") < n).drop("_position")
    kept = [c for c in df.columns if c not in ranges.PLACES]
    return with_places(df)[0].orderBy("_file", "_block", "_row").limit(n).select(*kept)


def concat_datasets(spark: SparkSession, paths: list[str], source: str = "source") -> DataFrame:
    """Files of one shape as one table, with the file or folder each row came from.

    Paths of one format are one scan, so the plan does not grow with their
    number; CSV headers may differ, so CSV files are read one by one.
    """
    tables = []
    for kind in dict.fromkeys(suffix(p) for p in paths):
        if kind not in READERS:
            raise ValueError(f"no reader for files of type {kind!r}")
        chosen = [p for p in paths if suffix(p) == kind]
        if kind == ".csv":
            tables += [read_csv(spark, p).withColumn(source, F.lit(p)) for p in chosen]
            continue
        if kind == ".parquet":
            df = spark.read.option("mergeSchema", True).parquet(*chosen)
        else:
            df = READERS[kind](spark, chosen)
        # Paths come encoded; a plus is no space in them.
        place = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        longest_first = [p.rstrip("/") for p in sorted(chosen, key=len, reverse=True)]
        under = lambda p: place.endswith(p) | place.contains(p + "/")
        origin = F.coalesce(*[F.when(under(p), F.lit(p)) for p in longest_first], place)
        tables.append(df.withColumn(source, origin))
    whole = tables[0]
    for other in tables[1:]:
        whole = whole.unionByName(other, allowMissingColumns=True)
    return whole
