"""From source files or a table to train and evaluation texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mixloom.operators import mixture, render, sampling
from mixloom.sources.catalogue import catalogue_table
from mixloom.sources.mixtures import load_mixture

Splits = tuple[DataFrame, DataFrame | None]


def _split(texts: DataFrame, key: str, test_size: float | int, seed: int, shuffle: bool) -> Splits:
    """Train and test rows (None without a split), both in seeded order when shuffled.

    Unshuffled, the test rows are the last in key order.
    """
    ordered = lambda df: sampling.shuffle(df, key, seed) if shuffle else df
    if test_size <= 0:
        return ordered(texts), None
    tagged = sampling.split(texts, key, test_size, seed, shuffle)
    part = lambda name: tagged.filter(F.col("split") == name).drop("split")
    return ordered(part("train")), ordered(part("test"))


def prepare_datasets(
    spark: SparkSession, entries: dict[str, dict], names: list[str] | None = None, root: str = ".",
    hub_root: str | None = None, max_samples: int | None = None, test_size: float | int = 0.1,
    seed: int = 42, shuffle: bool = True, null_text: str = "", strict_columns: bool = False,
) -> Splits:
    """Catalogue entries loaded, rendered to ``text`` and split.

    Rows are keyed by their place in the sources, so the split and the order
    are the same on every cluster, and splitting counts over the keys alone.
    """
    chosen = {n: e for n, e in entries.items() if names is None or n in names}
    records = load_mixture(spark, entries, names, root, hub_root, max_samples, row_ids=True)
    # The names come from the catalogue itself, so no pass looks for unknown ones.
    resolved = mixture.resolve_mixture(
        records, catalogue_table(spark, chosen), unknown="quarantine", strict_columns=strict_columns
    )
    texts = mixture.render_mixture(resolved, null_text, strict_columns, keep=("_id", "dataset"))
    return _split(texts, "_id", test_size, seed, shuffle)


def prepare_table(
    df: DataFrame, key: str, text_field: str | None = None, template: str | None = None,
    instruction_field: str | None = None, input_field: str | None = None, output_field: str | None = None,
    max_samples: int | None = None, test_size: float | int = 0.1, seed: int = 42, shuffle: bool = True,
    null_text: str = "",
) -> Splits:
    """A keyed table rendered by a template, or from one text field, and split.

    With neither, the table keeps its columns.
    """
    df = sampling.head(df, max_samples, key)
    if instruction_field and output_field:
        df = render.render_template(
            df, template or render.INSTRUCTION_TEMPLATE, instruction_field, output_field, input_field,
            keep=(key,), null_text=null_text,
        )
    elif text_field:
        df = render.project_text(df, text_field, keep=(key,))
    return _split(df, key, test_size, seed, shuffle)
