"""Preference, feedback, media, tool-role and history records: projections and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from mixloom.functions.content import flatten_content
from mixloom.functions.text import as_text, strip
from mixloom.operators.render import DEFAULT_TAGS

# Role names of tool turns, and the media placeholders by column.
TOOL_TAGS = {"observation_tag": "observation", "function_tag": "function_call"}
MEDIA_TOKENS = {"images": "<image>", "videos": "<video>", "audios": "<audio>"}


def _answer(df: DataFrame, column: str, content_tag: str | None) -> Column:
    """An answer held as a string or as one message."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.StructType):
        tag = content_tag or next(c for c in ("content", "value") if c in dtype.names)
        return flatten_content(F.col(column)[tag], dtype[tag].dataType)
    return F.col(column).cast("string")


def preference_pairs(
    df: DataFrame, prompt: str = "instruction", chosen: str = "chosen", rejected: str = "rejected",
    content_tag: str | None = None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(prompt, chosen, rejected)`` with answers given as strings or messages."""
    return df.select(
        *keep,
        F.col(prompt).alias("prompt"),
        _answer(df, chosen, content_tag).alias("chosen"),
        _answer(df, rejected, content_tag).alias("rejected"),
    )


def preference_messages(
    df: DataFrame, chosen: str = "chosen_messages", rejected: str = "rejected_messages",
    content_tag: str = "content", keep: tuple[str, ...] = (),
) -> DataFrame:
    """Two full message lists as the shared prefix and the two last answers.

    ``same_prompt`` tells whether everything before the last message is equal.
    """
    content = df.schema[chosen].dataType.elementType[content_tag].dataType
    prefix = lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))
    last = lambda c: flatten_content(
        F.try_element_at(F.col(c), F.lit(-1))[content_tag], content
    )
    return df.select(
        *keep,
        prefix(chosen).alias("prompt_messages"),
        last(chosen).alias("chosen"),
        last(rejected).alias("rejected"),
        prefix(chosen).eqNullSafe(prefix(rejected)).alias("same_prompt"),
    )


def feedback_rows(
    df: DataFrame, prompt: str, completion: str, label: str = "kto_tag", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``(prompt, completion, label)`` with a boolean label."""
    return df.select(
        *keep,
        F.col(prompt).alias("prompt"),
        F.col(completion).alias("completion"),
        F.col(label).cast("boolean").alias("label"),
    )


def check_media(
    df: DataFrame, messages: str = "conversations", content_tag: str = "value",
    media: tuple[str, ...] | None = None,
) -> DataFrame:
    """Placeholder and path counts per media column, and ``media_ok`` when all agree."""
    media = media or tuple(c for c in MEDIA_TOKENS if c in df.columns)
    dtype = df.schema[messages].dataType.elementType[content_tag].dataType
    counts, agree = {}, []
    for column in media:
        token = F.lit(MEDIA_TOKENS[column])
        placeholders = F.aggregate(
            F.col(messages),
            F.lit(0),
            lambda n, m: n + F.regexp_count(flatten_content(m[content_tag], dtype), token),
        )
        counts[f"{column}_tokens"] = F.coalesce(placeholders, F.lit(0))
        counts[f"{column}_paths"] = F.when(F.col(column).isNull(), 0).otherwise(F.size(column))
        agree.append(F.col(f"{column}_tokens") == F.col(f"{column}_paths"))
    ok = reduce(lambda a, b: a & b, agree, F.lit(True))
    return df.withColumns(counts).withColumn("media_ok", ok)


def _misplaced(role: Column, position: Column, tags: dict[str, str]) -> Column:
    """Whether a role stands at a 1-based position it may not have."""
    odd = role.isin(tags["user_tag"], tags["observation_tag"])
    even = role.isin(tags["assistant_tag"], tags["function_tag"])
    return F.coalesce(~F.when(position % 2 == 1, odd).otherwise(even), F.lit(True))


def check_roles(
    df: DataFrame, messages: str = "conversations", tags: dict[str, str] | None = None
) -> DataFrame:
    """Roles alternate: user or observation at odd positions, assistant or function at even.

    Positions count from 1 after an optional leading system message. Adds
    ``roles_ok`` and ``first_bad``, the first offending position.
    """
    tags = {**DEFAULT_TAGS, **TOOL_TAGS, **(tags or {})}
    role = tags["role_tag"]
    roles = F.transform(F.col(messages), lambda m: m[role].cast("string"))
    lead = F.coalesce((F.get(roles, 0) == tags["system_tag"]).cast("int"), F.lit(0))
    body = F.slice(roles, lead + 1, F.size(roles))
    bad = F.transform(
        body, lambda r, i: F.when(_misplaced(r, i + 1, tags), i + 1)
    )
    first_bad = F.array_min(bad)
    ok = F.when(F.col(messages).isNotNull(), first_bad.isNull())
    return df.withColumns({"roles_ok": ok, "first_bad": first_bad})


def check_turn_roles(
    df: DataFrame, key: str, order: str, role: str = "role", tags: dict[str, str] | None = None
) -> DataFrame:
    """``check_roles`` over flat turns, ``order`` being the 0-based position.

    Both readings of every turn (with and without a leading system message) are
    aggregated, so a conversation of any length combines before the shuffle.
    """
    tags = {**DEFAULT_TAGS, **TOOL_TAGS, **(tags or {})}
    position = F.col(order)
    leads = (position == 0) & (F.col(role) == tags["system_tag"])
    plain, shifted = position + 1, position
    grouped = df.groupBy(key).agg(
        F.coalesce(F.max(leads), F.lit(False)).alias("_lead"),
        F.min(F.when(_misplaced(F.col(role), plain, tags), plain)).alias("_plain"),
        F.min(F.when((position > 0) & _misplaced(F.col(role), shifted, tags), shifted)).alias("_shifted"),
    )
    first_bad = F.when(F.col("_lead"), F.col("_shifted")).otherwise(F.col("_plain"))
    return grouped.select(key, first_bad.isNull().alias("roles_ok"), first_bad.alias("first_bad"))


def check_required(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """``reasons``: the required columns that are absent, NULL or blank in a row."""
    reasons = []
    for column in required:
        reason = F.lit(f"missing {column}")
        if column not in df.columns:
            reasons.append(reason)
            continue
        missing = F.col(column).isNull()
        if isinstance(df.schema[column].dataType, T.StringType):
            missing = missing | (strip(F.col(column)) == "")
        reasons.append(F.when(missing, reason))
    return df.withColumn("reasons", F.array_compact(F.array(*reasons)))


def loss_mask(
    df: DataFrame, messages: str = "messages", role_tag: str = "role", content_tag: str = "content",
    assistant: str = "assistant", keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per message with its loss weight: its own, else 1 for the assistant, 0 otherwise."""
    fields = df.schema[messages].dataType.elementType
    exploded = df.select(*keep, F.posexplode(messages).alias("pos", "_m"))
    by_role = F.coalesce((F.col("_m")[role_tag] == assistant).cast("double"), F.lit(0.0))
    weight = by_role
    if "loss_weight" in fields.names:
        weight = F.coalesce(F.col("_m")["loss_weight"].cast("double"), by_role)
    return exploded.select(
        *keep,
        "pos",
        F.col("_m")[role_tag].alias("role"),
        flatten_content(F.col("_m")[content_tag], fields[content_tag].dataType).alias("content"),
        weight.alias("loss_weight"),
    )


def expand_history(
    df: DataFrame, instruction: str = "instruction", output: str = "output", input: str | None = None,
    history: str = "history", system: str | None = None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Earlier (prompt, response) pairs as messages before the final turn.

    A system prompt, when given and not blank, leads; an input follows its
    instruction on a new line.
    """
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), as_text(content).alias("content"))

    earlier = F.flatten(F.transform(
        F.coalesce(F.col(history), F.array().cast("array<array<string>>")),
        lambda pair: F.array(message("user", F.get(pair, 0)), message("assistant", F.get(pair, 1))),
    ))
    prompt = F.col(instruction)
    if input is not None:
        has_input = F.length(F.coalesce(F.col(input), F.lit(""))) > 0
        prompt = F.when(has_input, F.concat(as_text(prompt), F.lit("\n"), F.col(input))).otherwise(prompt)
    parts = [earlier, F.array(message("user", prompt), message("assistant", F.col(output)))]
    if system is not None:
        lead = F.array(message("system", F.col(system)))
        parts.insert(0, F.when(F.length(as_text(F.col(system))) > 0, lead).otherwise(F.slice(lead, 1, 0)))
    return df.select(*keep, F.concat(*parts).alias("messages"))
