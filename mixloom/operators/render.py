"""Instruction, chat and plain-text records rendered into one ``text`` column."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from string import Formatter

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from mixloom.functions.content import flatten_content
from mixloom.functions.text import as_text

# The two instruction templates.
INSTRUCTION_TEMPLATE = """Below is an instruction that describes a task. Write a response that appropriately completes the request.

### Instruction:
{instruction}

### Input:
{input}

### Response:
{output}"""
INSTRUCTION_TEMPLATE_NO_INPUT = """Below is an instruction that describes a task. Write a response that appropriately completes the request.

### Instruction:
{instruction}

### Response:
{output}"""

# Default message keys and role names of chat records.
DEFAULT_TAGS = {
    "role_tag": "from",
    "content_tag": "value",
    "user_tag": "human",
    "assistant_tag": "gpt",
    "system_tag": "system",
}

# Speaker labels of rendered chat, in the order roles are tested.
SPEAKERS = (("system_tag", "System: "), ("user_tag", "User: "), ("assistant_tag", "Assistant: "))

# Catalogue keys that may name each part of an instruction record.
COLUMN_ALIASES = {"instruction": "prompt", "input": "query", "output": "response"}

TURN_SEPARATOR = "\n\n"
# Turns of a conversation that are sorted together.
CHUNK_TURNS = 10_000


def fill_template(template: str, slots: dict[str, Column]) -> Column:
    """The template as one concatenation; braces inside values are never read."""
    pieces = []
    for literal, slot, spec, conversion in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if slot is not None:
            if spec or conversion:
                raise ValueError(f"format options are not supported in slot {slot!r}")
            if slot not in slots:
                raise KeyError(f"unknown template slot: {slot!r}")
            pieces.append(slots[slot])
    return F.concat(*pieces) if pieces else F.lit("")


def project_text(df: DataFrame, text_field: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The named field as ``text``; other columns are dropped unless kept."""
    if text_field not in df.columns:
        raise ValueError(f"no column {text_field!r} to take the text from")
    return df.select(*keep, F.col(text_field).alias("text"))


def format_text(
    df: DataFrame,
    prompt: str,
    response: str | None = None,
    keep: tuple[str, ...] = (),
    null_text: str = "",
) -> DataFrame:
    """Plain-text records: the prompt alone, or prompt, blank line, response."""
    if response is None:
        return project_text(df, prompt, keep)
    text = F.concat(
        as_text(F.col(prompt), null_text),
        F.lit(TURN_SEPARATOR),
        as_text(F.col(response), null_text),
    )
    return df.select(*keep, text.alias("text"))


def _present(df: DataFrame, names: list[str | None], null_text: str) -> Column:
    """The first named column the table has; an absent column renders as nothing."""
    for name in names:
        if name is not None and name in df.columns:
            return as_text(F.col(f"`{name}`"), null_text)
    return F.lit("")


def instruction_slots(
    df: DataFrame, columns: dict[str, str], null_text: str = "", strict_columns: bool = False
) -> dict[str, Column]:
    """Columns behind the template slots, chosen from the catalogue's column map.

    With ``strict_columns`` only the slot names themselves are looked up in the
    map; otherwise their catalogue aliases (prompt, query, response) count too.
    """
    def mapped(slot: str) -> str | None:
        alias = None if strict_columns else columns.get(COLUMN_ALIASES[slot])
        return columns.get(slot, alias)

    output = [mapped("output"), "output", columns.get("response", "response")]
    if strict_columns:
        output = [columns.get("output", "output"), columns.get("response", "response")]
    has_input = mapped("input") is not None
    return {
        "instruction": _present(df, [mapped("instruction") or "instruction"], null_text),
        "input": _present(df, [mapped("input")], null_text) if has_input else F.lit(""),
        "output": _present(df, output, null_text),
        "system": _present(df, [columns.get("system")], null_text),
    }


def render_instruction(
    df: DataFrame,
    columns: dict[str, str] | None = None,
    keep: tuple[str, ...] = (),
    null_text: str = "",
    strict_columns: bool = False,
    input_field: bool = False,
    plain: bool = False,
) -> DataFrame:
    """Instruction records in the template with or without an input section.

    The template is chosen once per dataset: an input that is mapped but empty
    keeps its (empty) section. ``plain`` gives the short untemplated form, where
    an empty input leaves its line out row by row.
    """
    if columns is None:
        columns = {"instruction": "instruction", "input": "input", "output": "output"}
    slots = instruction_slots(df, columns, null_text, strict_columns)
    if plain:
        text = F.concat(
            F.lit("Instruction: "),
            slots["instruction"],
            F.when(F.length(slots["input"]) > 0, F.concat(F.lit("\nInput: "), slots["input"]))
            .otherwise(""),
            F.lit("\nResponse: "),
            slots["output"],
        )
    else:
        with_input = (
            input_field or "input" in columns or (not strict_columns and "query" in columns)
        )
        template = INSTRUCTION_TEMPLATE if with_input else INSTRUCTION_TEMPLATE_NO_INPUT
        text = fill_template(template, slots)
    return df.select(*keep, text.alias("text"))


def render_template(
    df: DataFrame,
    template: str,
    instruction: str,
    output: str,
    input: str | None = None,
    keep: tuple[str, ...] = (),
    null_text: str = "",
) -> DataFrame:
    """Records in a user's template with slots for instruction, input and output."""
    slots = {
        "instruction": _present(df, [instruction], null_text),
        "input": _present(df, [input], null_text),
        "output": _present(df, [output], null_text),
    }
    return df.select(*keep, fill_template(template, slots).alias("text"))


def map_text(
    df: DataFrame, to_text: Callable[[pd.DataFrame], pd.Series], keep: tuple[str, ...] = ()
) -> DataFrame:
    """A user's own rendering, applied to Arrow batches of rows."""
    def render_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows[list(keep)].assign(text=to_text(rows))

    fields = [df.schema[c] for c in keep] + [T.StructField("text", T.StringType())]
    return df.mapInPandas(render_batches, T.StructType(fields))


def chat_line(role: Column, content: Column, tags: dict[str, Column]) -> Column:
    """One labelled turn, NULL for a role that is not rendered."""
    label = F.coalesce(*[F.when(role == tags[tag], label) for tag, label in SPEAKERS])
    return F.when(label.isNotNull(), F.concat(label, content))


def render_chat(
    df: DataFrame,
    messages: str = "conversations",
    tags: dict[str, str] | None = None,
    keep: tuple[str, ...] = (),
    null_text: str = "",
) -> DataFrame:
    """Message arrays as labelled turns joined by a blank line, in array order."""
    tags = {**DEFAULT_TAGS, **(tags or {})}
    dtype = df.schema[messages].dataType
    if isinstance(dtype, T.VariantType):
        return df.select(
            *keep, variant_chat_text(F.col(messages), _literal_tags(tags), null_text).alias("text")
        )
    message = dtype.elementType
    role_tag, content_tag = tags["role_tag"], tags["content_tag"]
    if isinstance(message, T.MapType):
        content_type = message.valueType
    else:
        content_type = message[content_tag].dataType
    lines = F.transform(
        F.col(messages),
        lambda m: chat_line(
            m[role_tag].cast("string"),
            flatten_content(m[content_tag], content_type, null_text),
            _literal_tags(tags),
        ),
    )
    return df.select(*keep, F.array_join(lines, TURN_SEPARATOR).alias("text"))


def _literal_tags(tags: dict[str, str]) -> dict[str, Column]:
    return {key: F.lit(value) for key, value in tags.items()}


def variant_chat_text(messages: Column, tags: dict[str, Column], null_text: str = "") -> Column:
    """Chat text of a variant message list whose keys and role names are columns."""
    def line(message: Column) -> Column:
        content = F.try_element_at(message, tags["content_tag"])
        return chat_line(
            F.try_element_at(message, tags["role_tag"]).cast("string"),
            flatten_content(content, T.VariantType(), null_text),
            tags,
        )

    return F.array_join(
        F.transform(messages.try_cast("array<map<string,variant>>"), line), TURN_SEPARATOR
    )


def collect_ordered(df: DataFrame, key: str, order: str, value: Column, chunk: int = CHUNK_TURNS) -> DataFrame:
    """``key`` and ``items``: its values in the order given, gathered in two steps.

    ``order`` is a whole number. Values are sorted in chunks of neighbouring positions
    first, so a key with very many rows is spread over tasks; then a key's few
    sorted chunks are put one after another. The chunk size changes no result.
    """
    chunks = (
        df.select(key, F.floor(F.col(order) / chunk).alias("_chunk"), F.col(order).alias("_at"), value.alias("_value"))
        .groupBy(key, "_chunk")
        .agg(F.sort_array(F.collect_list(F.struct("_at", "_value"))).alias("_items"))
        .select(key, "_chunk", F.col("_items._value").alias("_values"))
    )
    whole = chunks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_chunk", "_values"))).alias("_chunks"))
    return whole.select(key, F.flatten(F.col("_chunks._values")).alias("items"))


def assemble_turns(
    df: DataFrame, key: str, order: str, role: str = "role", content: str = "text", chunk_turns: int = CHUNK_TURNS
) -> DataFrame:
    """Flat ``(key, order, role, content)`` rows as one message array per conversation."""
    message = F.struct(F.col(role).alias("role"), F.col(content).alias("content"))
    return collect_ordered(df, key, order, message, chunk_turns).withColumnRenamed("items", "messages")


def render_turns(
    df: DataFrame,
    key: str,
    order: str,
    role: str = "role",
    content: str = "text",
    tags: dict[str, str] | None = None,
    chunk_turns: int = CHUNK_TURNS,
    null_text: str = "",
) -> DataFrame:
    """Flat turns straight to chat text: ``assemble_turns`` and ``render_chat`` in one.

    Turns are labelled before the shuffle, so only the finished lines travel.
    """
    tags = _literal_tags({**DEFAULT_TAGS, **(tags or {})})
    line = chat_line(F.col(role), as_text(F.col(content), null_text), tags)
    lined = collect_ordered(df, key, order, line, chunk_turns)
    return lined.select(key, F.array_join("items", TURN_SEPARATOR).alias("text"))
