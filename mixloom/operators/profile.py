"""Format detection for every line of a corpus, and the corpus profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mixloom.functions.text import json_text, strip
from mixloom.operators.sampling import head
from mixloom.session import materialize

# Fields, keys and aliases that give a format away, first match first.
CHAT_FIELDS = ("messages", "conversations")
CHAT_STYLES = (
    ("from", "value", "human", "gpt", "system"),
    ("role", "content", "user", "assistant", "system"),
)
CHAT_EXTRAS = ("tools", "images", "videos", "audios")
INSTRUCTION_ALIASES = {
    "instruction": ("instruction", "prompt", "question", "query"),
    "output": ("output", "response", "answer", "completion", "target"),
    "input": ("input", "context"),
    "system": ("system", "system_prompt"),
}
TEXT_FIELDS = ("text", "content", "body")

# Profiles of up to this many groups are broadcast.
BROADCAST_GROUPS = 100_000


def _first_in(keys: Column, names: tuple[str, ...]) -> Column:
    """The first of the names that is among the keys."""
    return F.coalesce(*[F.when(F.array_contains(keys, n), n) for n in names])


def _first_message(fields: Column, field: str) -> Column:
    """The first object in a list field, as a map."""
    items = F.try_element_at(fields, F.lit(field)).try_cast("array<variant>")
    objects = F.transform(items, lambda x: x.try_cast("map<string,variant>"))
    return F.get(F.filter(objects, lambda m: m.isNotNull()), 0)


def _whole_record(line: Column) -> Column:
    """Keys and values, as JSON text, of a line in their order; repeated keys and NaN are taken.

    The line is read as the only element of an array, so that nothing may follow its object.
    """
    strict = {"allowSingleQuotes": "false"}
    read = F.from_json(F.concat(F.lit("["), line, F.lit("]")), "array<map<string,string>>", strict)
    return F.when(F.size(read) == 1, F.map_entries(F.get(read, 0)))


def _first_message_of(entries: Column, field: str) -> Column:
    """The first object in the last list of that name, as a map of JSON texts."""
    values = F.filter(entries, lambda e: e["key"] == field)
    value = F.get(values, F.size(values) - 1)["value"]
    items = F.when(F.startswith(F.ltrim(value), F.lit("[")), F.from_json(value, "array<string>"))
    objects = F.transform(items, lambda x: F.from_json(x, "map<string,string>"))
    return F.get(F.filter(objects, lambda m: m.isNotNull() & (F.size(m) > 0)), 0)


def _style(message: Column) -> Column:
    """The role key of a recognised message, NULL otherwise."""
    known = [
        F.when(F.map_contains_key(message, role) & F.map_contains_key(message, content), role)
        for role, content, *_ in CHAT_STYLES
    ]
    return F.coalesce(*known)


def _pairs(pairs: list[tuple[str, Column]]) -> Column:
    """The pairs with a value, in order, as a JSON object."""
    entries = [
        F.when(value.isNotNull(), F.struct(F.lit(key).alias("key"), value.alias("value")))
        for key, value in pairs
    ]
    return F.to_json(F.map_from_entries(F.array_compact(F.array(*entries))))


def _tags_of(style: Column) -> Column:
    """Tags to record for a style; none for the default one."""
    role, content, user, assistant, system = CHAT_STYLES[1]
    tags = _pairs([
        ("role_tag", F.lit(role)), ("content_tag", F.lit(content)), ("user_tag", F.lit(user)),
        ("assistant_tag", F.lit(assistant)), ("system_tag", F.lit(system)),
    ])
    return F.when(style == role, tags)


def detect_format(lines: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Format, column map and tags of every JSON line.

    A chat field wins over instruction aliases, these over a text field, else
    the first key is the text. Lines that are no JSON object, or an empty one,
    are ``invalid``. Blank lines are dropped. The parsed form sorts its keys, so
    a line is scanned again for its first key only when that decides. Lines it refuses (a
    key twice, of which the last counts, NaN and Infinity, over 128 MiB) are read as a
    map of texts instead.
    """
    parsed = lines.filter(strip(F.col(value)) != "").select(
        *keep, F.col(value).alias("_line"),
        F.try_parse_json(value).try_cast("map<string,variant>").alias("_fields"),
    )
    known = parsed.withColumn("_entries", F.when(F.col("_fields").isNull(), _whole_record(F.col("_line"))))
    names = F.array_distinct(F.transform("_entries", lambda e: e["key"]))
    styled = known.select(
        *keep, "_line", F.coalesce(F.map_keys("_fields"), names).alias("_keys"),
        F.get(names, 0).alias("_first_name"),
        *[
            F.when(F.col("_entries").isNull(), _style(_first_message(F.col("_fields"), f)))
            .otherwise(_style(_first_message_of(F.col("_entries"), f))).alias(f"_{f}")
            for f in CHAT_FIELDS
        ],
    )
    keys = F.col("_keys")
    chat_field = F.coalesce(*[F.when(F.col(f"_{f}").isNotNull(), f) for f in CHAT_FIELDS])
    style = F.coalesce(*[F.col(f"_{f}") for f in CHAT_FIELDS])
    named = styled.select(
        *keep, "_line", "_keys", "_first_name", chat_field.alias("_chat"), style.alias("_style"),
        *[_first_in(keys, names).alias(f"_{part}") for part, names in INSTRUCTION_ALIASES.items()],
    )
    valid = F.coalesce(F.size("_keys") > 0, F.lit(False))
    is_chat = F.col("_chat").isNotNull()
    is_instruction = F.col("_instruction").isNotNull() & F.col("_output").isNotNull()
    chat_columns = _pairs(
        [("messages", F.col("_chat"))] + [(x, F.when(F.array_contains(keys, x), x)) for x in CHAT_EXTRAS]
    )
    instruction_columns = _pairs([(p, F.col(f"_{p}")) for p in INSTRUCTION_ALIASES])
    scanned = F.when(F.size(keys) == 1, F.get(keys, 0)).otherwise(F.get(F.json_object_keys("_line"), 0))
    first_key = F.coalesce("_first_name", scanned)
    text_columns = _pairs([("prompt", F.coalesce(_first_in(keys, TEXT_FIELDS), first_key))])
    return named.select(
        *keep,
        F.when(~valid, "invalid")
        .when(is_chat, "sharegpt").when(is_instruction, "alpaca").otherwise("text").alias("format"),
        F.when(valid, F.when(is_chat, chat_columns).when(is_instruction, instruction_columns)
               .otherwise(text_columns)).alias("columns"),
        F.when(valid & is_chat, _tags_of(F.col("_style"))).alias("tags"),
    )


def require_valid(detected: DataFrame) -> DataFrame:
    """Raise when a line was neither a JSON object nor had any key."""
    raised = F.raise_error(F.lit("a line holds no JSON object with at least one key"))
    return detected.withColumn("format", F.when(F.col("format") == "invalid", raised).otherwise(F.col("format")))


def format_profile(lines: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Records per detected format and column map, with shares and the earliest record.

    ``like_first`` marks the group of the corpus's first record, whose share is
    the part of the corpus that one look at the first record would describe.
    Lines are parsed in one counting pass; the earliest records are then
    fetched by key, and shares come from the written counts.
    """
    detected = detect_format(lines, value, keep=(key,))
    groups = materialize(
        detected.groupBy("format", "columns", "tags").agg(
            F.count("*").alias("records"), F.min(key).alias("first_key")
        ),
        "format-profile",
    )
    whole = groups.agg(F.struct(F.sum("records").alias("n"), F.min("first_key").alias("k"))).scalar()
    firsts = F.broadcast(groups) if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else groups
    earliest = lines.select(F.col(key).alias("first_key"), F.col(value).alias("first_record"))
    # Rows may share a key: one record per group, whichever sorts first.
    found = earliest.join(firsts, "first_key").groupBy("format", "columns", "tags", "records", "first_key").agg(
        F.min("first_record").alias("first_record")
    )
    return found.select(
        "format", "columns", "tags", "records",
        (F.col("records") / whole["n"]).alias("share"),
        (F.col("first_key") == whole["k"]).alias("like_first"),
        "first_key", "first_record",
    )


def detect_table(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``detect_format`` for the rows of any table: CSV, Parquet, array elements.

    A row is looked at as a JSON line with its columns in order, NULL ones included;
    the columns kept are not part of it.
    """
    fields = [c for c in df.columns if c not in keep]
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in fields]), {"ignoreNullFields": "false"})
    return detect_format(df.select(*keep, line.alias("_row")), "_row", keep)


def format_samples(lines: DataFrame, key: str, value: str = "value", samples: int = 5) -> DataFrame:
    """The first records, in key order, of every detected format and column map.

    Each partition passes on at most so many records of a group, so a group of any
    size stays small. Rows that share a key come in the order of their text.
    """
    detected = detect_format(lines.withColumn("_record", F.col(value)), value, keep=(key, "_record"))
    place = Window.partitionBy("format", "columns", "tags").orderBy(key, "_record")
    ranked = detected.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= samples)
    return ranked.select("format", "columns", "tags", "place", key, F.col("_record").alias("record"))


def preview(df: DataFrame, key: str, n: int = 5, width: int = 500) -> DataFrame:
    """The first n records in key order as JSON text cut at a width."""
    record = json_text(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema)
    return head(df, n, key).select(key, F.left(record, F.lit(width)).alias("record"))
