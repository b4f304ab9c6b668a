"""A records table ``(dataset, record)`` joined with the catalogue.

Every record is a variant; which of its fields plays which part is data, read
from the catalogue row of its dataset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mixloom.operators.render import (
    INSTRUCTION_TEMPLATE, INSTRUCTION_TEMPLATE_NO_INPUT, TURN_SEPARATOR, fill_template, variant_chat_text,
)
from mixloom.sources.catalogue import DEFAULT_TAGS, dimension, of_type, with_defaults, with_flags

# Names that an error spells out; ``unknown_names`` gives all of them as a table.
NAMES_IN_ERROR = 1_000


def unknown_names(df: DataFrame, catalogue: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Dataset names of the records that the catalogue does not have."""
    names = df.select(F.col(dataset).alias("name")).distinct()
    return names.join(dimension(catalogue.select("name")), "name", "left_anti")


def resolve_mixture(
    df: DataFrame, catalogue: DataFrame, unknown: str = "error", dataset: str = "dataset",
    strict_columns: bool = False,
) -> DataFrame:
    """Every record with its catalogue row: source, format, column map, tags, flags.

    Unknown dataset names raise, naming them; with ``unknown="quarantine"``
    their records are kept, with no catalogue values and ``known`` false.
    """
    if unknown not in ("error", "quarantine"):
        raise ValueError(f"unknown must be 'error' or 'quarantine', not {unknown!r}")
    entries = with_flags(with_defaults(catalogue, strict_columns)).withColumnRenamed("name", dataset)
    if unknown == "quarantine":
        marked = entries.withColumn("known", F.lit(True))
        return df.join(dimension(marked), dataset, "left").withColumn(
            "known", F.coalesce("known", F.lit(False))
        )
    missing = [r["name"] for r in unknown_names(df, catalogue, dataset).limit(NAMES_IN_ERROR + 1).collect()]
    if missing:
        listed = ", ".join(sorted(map(str, missing[:NAMES_IN_ERROR])))
        more = " and more, see unknown_names()" if len(missing) > NAMES_IN_ERROR else ""
        raise ValueError(f"datasets not found in catalogue: {listed}{more}")
    return df.join(dimension(entries), dataset)


def record_fields(record: Column) -> Column:
    """A record's fields by name."""
    return record.try_cast("map<string,variant>")


def mapped_value(fields: Column, columns: Column, part: str) -> Column:
    """The field a dataset's column map names for a part, as a variant."""
    return F.try_element_at(fields, F.try_element_at(columns, F.lit(part)))


def variant_text(value: Column, null_text: str = "") -> Column:
    """A field as rendered text: missing is empty, JSON null is ``null_text``."""
    absent = F.when(value.isNull(), "").otherwise(null_text) if null_text else F.lit("")
    return F.coalesce(value.cast("string"), absent)


def with_mapped_columns(df: DataFrame, parts: tuple[str, ...], null_text: str = "") -> DataFrame:
    """The text of mapped fields as ordinary columns named by part."""
    opened = df.withColumn("_fields", record_fields(F.col("record")))
    texts = {p: variant_text(mapped_value(F.col("_fields"), F.col("columns"), p), null_text) for p in parts}
    return opened.select(*df.columns, *[text.alias(part) for part, text in texts.items()])


def render_mixture(
    df: DataFrame, null_text: str = "", strict_columns: bool = False, keep: tuple[str, ...] = ("dataset",)
) -> DataFrame:
    """Resolved records of any format rendered to ``text`` in one pass."""
    opened = df.withColumn("_fields", record_fields(F.col("record")))
    fields, columns = F.col("_fields"), F.col("columns")
    named = lambda part: F.try_element_at(columns, F.lit(part))
    field = lambda name: F.try_element_at(fields, name)
    text = lambda value: variant_text(value, null_text)

    if strict_columns:
        instruction = F.coalesce(named("instruction"), F.lit("instruction"))
        input_name = named("input")
        output = F.coalesce(
            field(F.coalesce(named("output"), F.lit("output"))),
            field(F.coalesce(named("response"), F.lit("response"))),
        )
    else:
        instruction = F.coalesce(named("instruction"), named("prompt"), F.lit("instruction"))
        input_name = F.coalesce(named("input"), named("query"))
        output = F.coalesce(
            field(F.coalesce(named("output"), named("response"))),
            field(F.lit("output")),
            field(F.lit("response")),
        )
    slots = {
        "instruction": text(field(instruction)),
        "input": text(field(input_name)),
        "output": text(output),
    }
    instruct = F.when(F.col("has_input"), fill_template(INSTRUCTION_TEMPLATE, slots)).otherwise(
        fill_template(INSTRUCTION_TEMPLATE_NO_INPUT, slots)
    )
    tags = {tag: F.try_element_at(F.col("tags"), F.lit(tag)) for tag in DEFAULT_TAGS}
    messages = field(F.coalesce(named("messages"), F.lit("conversations")))
    prompt = text(field(F.coalesce(named("prompt"), F.lit("text"))))
    plain = F.when(
        named("response").isNotNull(),
        F.concat(prompt, F.lit(TURN_SEPARATOR), text(field(named("response")))),
    ).otherwise(prompt)
    rendered = (
        F.when(F.col("formatting") == "alpaca", instruct)
        .when(F.col("formatting") == "sharegpt", variant_chat_text(messages, tags, null_text))
        .otherwise(plain)
    )
    return opened.select(*keep, rendered.alias("text"))


def keep_type(df: DataFrame, catalogue: DataFrame, kind: str, dataset: str = "dataset") -> DataFrame:
    """Records whose dataset is of a type (``ranking``, ``sft``, ``multimodal``)."""
    names = of_type(catalogue, kind).select(F.col("name").alias(dataset))
    return df.join(dimension(names), dataset, "left_semi")


def keep_named(df: DataFrame, term: str, dataset: str = "dataset") -> DataFrame:
    """Records whose dataset name contains a term, ignoring case, taken literally."""
    return df.filter(F.contains(F.lower(F.col(dataset)), F.lit(term.lower())))


def mixture_summary(df: DataFrame, catalogue: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Datasets and records per source label, format and type.

    Records are counted per dataset before the join, so only counts meet the
    catalogue.
    """
    counts = df.groupBy(F.col(dataset).alias("name")).agg(F.count("*").alias("_records"))
    entries = with_defaults(catalogue).select("name", "label", "formatting", "ranking")
    kind = F.when(F.col("ranking"), "Ranking").otherwise("SFT")
    return (
        counts.join(dimension(entries), "name")
        .groupBy("label", "formatting", kind.alias("type"))
        .agg(F.count("*").alias("datasets"), F.sum("_records").alias("records"))
    )
