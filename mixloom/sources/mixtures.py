"""Catalogue entries read into one records table ``(dataset, record)``."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from mixloom.session import materialize
from mixloom.sources import ranges
from mixloom.sources.readers import (
    BROADCAST_PIECES, DRIVER_ROWS, first_in_source, holds_lines, number_rows, read_csv, read_parquet, read_text, suffix, with_places,
)

# Room for the row positions of one entry inside a mixture's keys: a million million
# rows each, and more than eight million entries.
POSITIONS_PER_ENTRY = 2**40

# Fixed value: the split of an entry that names none.
DEFAULT_SPLIT = "train"


def read_partitioned(
    spark: SparkSession, path: str, split: str | None = None,
    subset: str | None = None, folder: str | None = None,
) -> DataFrame:
    """A Parquet dataset directory laid out as ``[folder/][subset=…/]split=…``.

    Split and subset are directory partitions, so other ones are never listed
    into the scan. A split or subset that is asked for must be in the layout; with
    none asked for, the train split is read where there are splits.
    """
    df = read_parquet(spark, f"{path.rstrip('/')}/{folder}" if folder else path)
    for column, wanted in (("subset", subset), ("split", split)):
        if wanted is not None and column not in df.columns:
            raise ValueError(f"the dataset at {path} has no {column} folders, so no {column} {wanted!r}")
        if wanted is None and column == "split" and column in df.columns:
            wanted = DEFAULT_SPLIT
        if wanted is not None:
            df = df.filter(F.col(column) == wanted)
    return df


def _records(spark: SparkSession, path: str | list[str], multiline: bool = True, kind: str | None = None) -> DataFrame:
    """A local file's rows as one variant column ``record``.

    JSON lines are parsed straight into variants, in one pass. The records of a
    JSON array get every field of the file, as a JSON null where one is missing.
    Text files keep their empty lines. Large arrays and CSV files bring their rows' places.
    """
    kind = kind or suffix(path)
    if kind == ".jsonl":
        return spark.read.option("singleVariantColumn", "record").option("mode", "FAILFAST").json(path)
    if kind == ".json" and holds_lines(spark, path):
        return spark.read.options(singleVariantColumn="record", mode="FAILFAST", recursiveFileLookup=True).json(path)
    if kind == ".json" and ranges.splits(spark, path):
        elements = ranges.json_elements(spark, path)
        names = elements.select(F.explode(F.json_object_keys("value")).alias("name")).distinct().orderBy("name").collect()
        fields = T.StructType([T.StructField(r["name"], T.VariantType()) for r in names])
        return _as_variant(ranges.parse_elements(elements, fields, keep=ranges.PLACES))
    if kind == ".json":
        reader = spark.read.options(multiLine=True, mode="FAILFAST", recursiveFileLookup=True)
        fields = [T.StructField(name, T.VariantType()) for name in reader.json(path).columns]
        return _as_variant(reader.schema(T.StructType(fields)).json(path))
    if kind == ".txt":
        return _as_variant(read_text(spark, path, drop_empty=False))
    if kind == ".csv" and multiline and ranges.splits(spark, path):
        names = read_csv(spark, path).columns
        return _as_variant(ranges.parse_records(ranges.csv_records(spark, path), names, keep=ranges.PLACES).na.fill("", names))
    if kind == ".csv":
        return _as_variant(read_csv(spark, path, multiline))
    readers = {".parquet": read_parquet}
    if kind not in readers:
        raise ValueError(f"no reader for files of type {kind!r}")
    return _as_variant(readers[kind](spark, path))


def _as_variant(df: DataFrame) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in ranges.PLACES])
    return df.withColumn("record", F.to_variant_object(row))


def _places(name: str, root: str) -> list[str]:
    """Where a local file may lie: as named, beside the catalogue, or under ``data``."""
    if name.startswith(("/", "data/")) or "://" in name:
        return [name]
    return [f"{root.rstrip('/')}/{name}", f"data/{name}"]


def _first_found(spark: SparkSession, places: list[str], multiline: bool) -> DataFrame:
    for place in places:
        try:
            return _records(spark, place, multiline)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"no dataset file at {' or '.join(places)}")


def _entry_records(spark: SparkSession, name: str, entry: dict, root: str, hub_root: str | None) -> DataFrame:
    repo = entry.get("hf_hub_url") or entry.get("ms_hub_url")
    if repo:
        if hub_root is None:
            raise ValueError(f"hub_root must name the folder that mirrors '{repo}'")
        return _as_variant(read_partitioned(
            spark, f"{hub_root.rstrip('/')}/{repo}", entry.get("split"),
            entry.get("subset"), entry.get("folder"),
        ))
    if not entry.get("file_name"):
        raise ValueError(f"dataset {name!r} names neither a hub nor a file")
    return _first_found(spark, _places(entry["file_name"], root), entry.get("multiline", True))


def load_mixture(
    spark: SparkSession, entries: dict[str, dict], names: list[str] | None = None,
    root: str = ".", hub_root: str | None = None, max_samples: int | None = None, row_ids: bool = False,
) -> DataFrame:
    """The files of the named entries as ``(dataset, record)``.

    Hub entries are read from a mirrored directory, honouring split, subset and
    folder. ``num_samples`` of an entry, or else ``max_samples``, keeps its
    first rows in source order. ``row_ids`` adds a whole-number key ``_id`` that
    follows the order of the names and the rows' source order.
    """
    names = list(entries) if names is None else names
    unknown = [n for n in names if n not in entries]
    if unknown:
        raise ValueError(f"unknown dataset names: {', '.join(unknown)}")
    limits = {n: entries[n].get("num_samples") or max_samples for n in names}
    lined = _lined_entries(spark, entries, names, root)
    found = {n: _entry_records(spark, n, entries[n], root, hub_root) for n in names if n not in lined}
    groups = _lined_groups(spark, names, lined, limits)
    if row_ids:
        return _numbered(names, found, limits, groups)
    tables = [first_in_source(df, limits[name]).select(F.lit(name).alias("dataset"), "record") for name, df in found.items()]
    for rows, limit in groups:
        if limit and limit > DRIVER_ROWS:
            rows = _within_limit(number_rows(materialize(rows, "placed"), "_position", by=("_entry",)))
        tables.append(rows.select("dataset", "record"))
    return reduce(DataFrame.unionByName, tables)


# Formats whose rows are lines: any number of their files is one scan.
LINED = (".jsonl", ".txt")
# Spark spells local paths with one slash or three.
LOCAL = "^file:/+"


def _lined_entries(spark: SparkSession, entries: dict[str, dict], names: list[str], root: str) -> dict[str, tuple[str, list[str]]]:
    """Format and files of the entries read as lines, by name; files are listed, not opened."""
    lined = {}
    for name in names:
        entry = entries[name]
        local = entry.get("file_name") if not (entry.get("hf_hub_url") or entry.get("ms_hub_url")) else None
        if not local or suffix(local) not in LINED:
            continue
        for place in _places(local, root):
            try:
                lined[name] = suffix(local), spark.read.text(place).inputFiles()
                break
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
        else:
            raise FileNotFoundError(f"no dataset file at {' or '.join(_places(local, root))}")
    return lined


def _lined_groups(
    spark: SparkSession, names: list[str], lined: dict[str, tuple[str, list[str]]], limits: dict[str, int | None]
) -> list[tuple[DataFrame, int | None]]:
    """Rows of all lined entries, one scan for each format and kind of limit, and the group's largest limit.

    Which entries a file belongs to is a table joined on the file's path, so the plan does not
    grow with the entries. Small limits are met by a rank of which every task keeps the first
    rows only; rows under a large one, or none, come as they are.
    """
    groups: dict[tuple, list[str]] = {}
    for name, (kind, _) in lined.items():
        size = "none" if not limits[name] else "small" if limits[name] <= DRIVER_ROWS else "large"
        groups.setdefault((kind, size), []).append(name)
    schema = "_file string, dataset string, _entry bigint, _limit bigint"
    found = []
    for (kind, size), members in groups.items():
        rows = [(re.sub(LOCAL, "file:/", file), n, names.index(n), limits[n]) for n in members for file in lined[n][1]]
        files = spark.createDataFrame(rows, schema)
        paths = [unquote(f) for f in dict.fromkeys(r[0] for r in rows)]
        placed, _ = with_places(_records(spark, paths, kind=kind))
        placed = placed.withColumn("_file", F.regexp_replace("_file", LOCAL, "file:/"))
        own = placed.join(F.broadcast(files) if len(rows) <= BROADCAST_PIECES else files, "_file", "left").select(
            F.coalesce("dataset", F.raise_error(F.concat(F.lit("no entry for "), "_file"))).alias("dataset"), "record", "_entry", "_limit", "_file", "_block", "_row"
        )
        most = max((limits[n] or 0 for n in members), default=0) or None
        if size == "small":
            rank = F.row_number().over(Window.partitionBy("_entry").orderBy("_file", "_block", "_row"))
            own = own.withColumn("_rank", rank).filter((F.col("_rank") <= most) & (F.col("_rank") <= F.col("_limit"))).drop("_rank")
        found.append((own, most))
    return found


def _within_limit(numbered: DataFrame) -> DataFrame:
    return numbered.filter(F.col("_limit").isNull() | (F.col("_position") < F.col("_limit")))


def _numbered(
    names: list[str], found: dict[str, DataFrame], limits: dict[str, int | None], groups: list[tuple[DataFrame, int | None]]
) -> DataFrame:
    """Entries united with row keys; all that needs writing first is written at once."""
    stable, unstable = [], [rows for rows, _ in groups]
    for name, df in found.items():
        index = names.index(name)
        placed, is_stable = with_places(df)
        limit = limits[name]
        if limit and limit <= DRIVER_ROWS:
            placed, is_stable = placed.orderBy("_file", "_block", "_row").limit(limit), False
        (stable if is_stable else unstable).append(placed.select(
            F.lit(name).alias("dataset"), "record", F.lit(index).cast("bigint").alias("_entry"),
            F.lit(limit).cast("bigint").alias("_limit"), "_file", "_block", "_row",
        ))
    if unstable:
        stable.append(materialize(reduce(DataFrame.unionByName, unstable), "placed"))
    numbered = number_rows(reduce(DataFrame.unionByName, stable), "_position", by=("_entry",))
    # A key beyond an entry's room would be one of the next entry.
    beyond = F.raise_error(F.lit(f"an entry of more than {POSITIONS_PER_ENTRY} rows has no row keys"))
    inside = F.when(F.col("_position") < POSITIONS_PER_ENTRY, F.col("_position")).otherwise(beyond.cast("bigint"))
    kept = _within_limit(numbered.withColumn("_position", inside))
    key = F.col("_entry") * POSITIONS_PER_ENTRY + F.col("_position")
    return kept.select("dataset", "record", key.alias("_id"))
