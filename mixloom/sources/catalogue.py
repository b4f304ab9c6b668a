"""The dataset catalogue: named entries as a small table, with their defaults.

An entry says where a dataset lies (``hf_hub_url``, ``ms_hub_url`` or
``file_name``), its ``formatting``, which columns play which part
(``columns``), how chat messages are keyed (``tags``), and whether it holds
preferences (``ranking``).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mixloom.operators.render import DEFAULT_TAGS

# Column maps of an entry that gives none.
DEFAULT_COLUMNS = {
    "alpaca": {"instruction": "instruction", "input": "input", "output": "output"},
    "sharegpt": {"messages": "conversations"},
}

ENTRY_SCHEMA = (
    "name string, hf_hub_url string, ms_hub_url string, file_name string, split string, "
    "subset string, folder string, formatting string, ranking boolean, input_field string, "
    "num_samples bigint, columns map<string,string>, tags map<string,string>"
)

# Catalogues up to this many entries are broadcast.
BROADCAST_ENTRIES = 100_000


def load_entries(path: str) -> dict[str, dict]:
    """Catalogue entries by name from one JSON file."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def catalogue_table(spark: SparkSession, entries: dict[str, dict]) -> DataFrame:
    """Entries as declared, one row each."""
    names = [field.split()[0] for field in ENTRY_SCHEMA.split(", ")]
    rows = [tuple({**entry, "name": name}.get(c) for c in names) for name, entry in entries.items()]
    return spark.createDataFrame(rows, ENTRY_SCHEMA)


def _literal_map(pairs: dict[str, str]) -> Column:
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def with_defaults(catalogue: DataFrame, strict_columns: bool = False) -> DataFrame:
    """Entries with source, path, split, format, columns, tags and template resolved.

    The source is the first hub, else the second, else a local file; none
    raises. Chat entries get the default tags, overridden key by key. Unless
    ``strict_columns``, an entry that maps only a prompt and names no format is
    plain text.
    """
    maps = F.coalesce(F.col("columns"), F.create_map().cast("map<string,string>"))
    no_source = F.raise_error(
        F.concat(F.lit("dataset '"), F.col("name"), F.lit("' names neither a hub nor a file"))
    )
    formatting = F.coalesce("formatting", F.lit("alpaca"))
    if not strict_columns:
        prompt_only = F.map_contains_key(maps, "prompt") & (F.size(maps) == 1)
        formatting = F.coalesce(
            "formatting", F.when(prompt_only, F.lit("text")).otherwise(F.lit("alpaca"))
        )
    columns = F.coalesce(
        "columns",
        F.when(F.col("_format") == "alpaca", _literal_map(DEFAULT_COLUMNS["alpaca"]))
        .when(F.col("_format") == "sharegpt", _literal_map(DEFAULT_COLUMNS["sharegpt"]))
        .otherwise(_literal_map({})),
    )
    declared = F.coalesce("tags", _literal_map({}))
    tags = F.when(
        F.col("_format") == "sharegpt",
        F.map_zip_with(_literal_map(DEFAULT_TAGS), declared, lambda k, default, own: F.coalesce(own, default)),
    )
    maps_input = F.map_contains_key("_columns", "input")
    if not strict_columns:
        maps_input = maps_input | F.map_contains_key("_columns", "query")
    return (
        catalogue.withColumn("_format", formatting)
        .withColumn("_columns", columns)
        .select(
            "name",
            F.when(F.col("hf_hub_url").isNotNull(), "huggingface")
            .when(F.col("ms_hub_url").isNotNull(), "modelscope")
            .when(F.col("file_name").isNotNull(), "local")
            .otherwise(no_source).alias("source"),
            F.coalesce("hf_hub_url", "ms_hub_url", "file_name").alias("path"),
            F.coalesce("split", F.lit("train")).alias("split"),
            "subset",
            "folder",
            F.col("_format").alias("formatting"),
            F.col("_columns").alias("columns"),
            tags.alias("tags"),
            F.when(
                F.col("_format") == "alpaca", maps_input | F.col("input_field").isNotNull()
            ).alias("has_input"),
            F.coalesce("ranking", F.lit(False)).alias("ranking"),
            F.when(F.col("hf_hub_url").isNotNull(), "hf").otherwise("local").alias("label"),
            "num_samples",
        )
    )


def with_flags(catalogue: DataFrame) -> DataFrame:
    """Capability flags of resolved entries: which kinds of columns they map."""
    has = lambda key: F.map_contains_key("columns", key)
    return catalogue.withColumns({
        "kto": has("kto_tag"),
        "has_images": has("images"),
        "has_videos": has("videos"),
        "has_audios": has("audios"),
        "has_tools": has("tools"),
    })


def of_type(catalogue: DataFrame, kind: str) -> DataFrame:
    """Entries of a type: ``ranking``, ``sft`` (not ranking) or ``multimodal`` (images)."""
    ranking = F.coalesce("ranking", F.lit(False))
    tests = {
        "ranking": ranking,
        "sft": ~ranking,
        "multimodal": F.coalesce(F.map_contains_key("columns", "images"), F.lit(False)),
    }
    if kind not in tests:
        raise ValueError(f"unknown dataset type {kind!r}; one of {', '.join(tests)}")
    return catalogue.filter(tests[kind])


def dimension(catalogue: DataFrame) -> DataFrame:
    """The catalogue hinted for broadcast while it is within the bound.

    Beyond it the planner chooses; a dataset holding a large share of the
    records is then split by adaptive skew-join handling.
    """
    if catalogue.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES:
        return F.broadcast(catalogue)
    return catalogue
