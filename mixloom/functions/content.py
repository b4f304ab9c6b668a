"""Chat content (plain string, list of blocks, or variant) flattened to text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from mixloom.functions.text import as_text


def _string_in_variant(value: Column) -> Column:
    """The string held by a variant, NULL when it holds anything else."""
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))


def _variant_block(block: Column) -> Column:
    return F.coalesce(
        _string_in_variant(block),
        _string_in_variant(F.try_variant_get(block, "$.value", "variant")),
        _string_in_variant(F.try_variant_get(block, "$.text", "variant")),
    )


def _struct_block(block: Column, dtype: T.StructType) -> Column:
    usable = [
        block[name]
        for name in ("value", "text")
        if name in dtype.names and isinstance(dtype[name].dataType, T.StringType)
    ]
    return F.coalesce(*usable, F.lit(None).cast("string"))


def _join_blocks(blocks: Column, whole: Column) -> Column:
    """Usable blocks one per line; the JSON of the content when there is none."""
    usable = F.filter(blocks, lambda b: b.isNotNull())
    return F.when(F.size(usable) > 0, F.array_join(usable, "\n")).otherwise(whole)


def flatten_content(content: Column, dtype: T.DataType, null_text: str = "") -> Column:
    """Message content of any of the supported shapes as one string."""
    if isinstance(dtype, T.VariantType):
        blocks = F.transform(content.try_cast("array<variant>"), _variant_block)
        text = F.when(
            content.try_cast("array<variant>").isNotNull(),
            _join_blocks(blocks, F.to_json(content)),
        ).otherwise(content.cast("string"))
        return F.coalesce(text, F.lit(null_text))
    if isinstance(dtype, T.ArrayType):
        item = dtype.elementType
        if isinstance(item, T.StringType):
            blocks = content
        elif isinstance(item, T.StructType):
            blocks = F.transform(content, lambda b: _struct_block(b, item))
        elif isinstance(item, T.VariantType):
            blocks = F.transform(content, _variant_block)
        else:
            return F.coalesce(F.to_json(content), F.lit(null_text))
        return F.coalesce(_join_blocks(blocks, F.to_json(content)), F.lit(null_text))
    if isinstance(dtype, (T.StructType, T.MapType)):
        return F.coalesce(F.to_json(content), F.lit(null_text))
    return as_text(content, null_text)
