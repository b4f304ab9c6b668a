"""Inputs of the registered queries, derived from the whole test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mixloom.session import scratch_path
from mixloom.sources.readers import spread

# Keys and role names of the chat table.
CHAT_TAGS = {
    "role_tag": "role", "content_tag": "content",
    "user_tag": "user", "assistant_tag": "assistant", "system_tag": "system",
}
ROWS_PER_ARRAY_FILE = 5_000
N_SOURCES = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, spread over the cores for work on their whole texts."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def instruction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn with the assistant turn after it, NULL if there is none.

    The pairs come from an equi-join on (conversation, turn), which spreads the
    turns of one conversation over all partitions.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("instruction"),
        F.when(F.col("turn") % 2 == 0, "").otherwise(F.concat_ws("/", "conv_id", "turn")).alias("input"),
    )
    answered = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output")
    )
    return asked.join(answered, ["conv_id", "turn"], "left")


def without_fifth_words(text: Column) -> Column:
    kept = F.filter(F.split(text, " "), lambda _, i: (i + 1) % 5 != 0)
    return F.array_join(kept, " ")


def prediction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a reference, predicted by its words but every fifth."""
    return documents(spark, sf_dir).select(
        "doc_id", F.col("text").alias("reference"), without_fifth_words(F.col("text")).alias("prediction")
    )


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a run-metric log: the user is the run, the event number the step."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("step"), "ts",
        F.sqrt(F.col("value") / 100).alias("loss"), (1 + F.col("event_id") % 50).alias("n_tokens"),
    )


def entries() -> dict[str, dict]:
    """A catalogue of the document sources, with every kind of entry."""
    made: dict[str, dict] = {}
    for i in range(N_SOURCES):
        name = f"src{i}"
        made[name] = [
            {"file_name": f"{name}.json", "columns": {"prompt": "q", "response": "a"}},
            {"hf_hub_url": f"org/{name}"},
            {"ms_hub_url": f"org/{name}", "formatting": "sharegpt",
             "columns": {"messages": "messages", "images": "images"},
             "tags": {k: v for k, v in CHAT_TAGS.items() if k != "system_tag"}},
            {"file_name": f"{name}.txt", "columns": {"prompt": "text"}},
            {"file_name": f"{name}.json", "split": "validation",
             "columns": {"prompt": "q", "query": "ctx", "response": "a"}},
            {"hf_hub_url": f"org/{name}", "ranking": True,
             "columns": {"prompt": "instruction", "response": "output", "tools": "input"}},
            {"file_name": f"{name}.json", "formatting": "sharegpt"},
            {"file_name": f"{name}.txt", "formatting": "text",
             "columns": {"prompt": "instruction", "response": "output"}},
        ][i % 8]
    return made


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a record of its source, shaped as that source's entry says."""
    docs = documents(spark, sf_dir)
    kind = F.substring("source", 4, 9).cast("int") % 8
    asked = F.concat_ws(" ", "lang", "doc_id")
    named = lambda **fields: F.to_variant_object(
        F.struct(*[value.alias(name) for name, value in fields.items()])
    )
    message = lambda role_tag, role, content_tag, content: F.struct(
        F.lit(role).alias(role_tag), content.alias(content_tag)
    )
    source, text = F.col("source"), F.col("text")
    record = (
        F.when(kind.isin(0, 4), named(q=asked, a=text, ctx=source))
        .when(kind.isin(1, 5, 7), named(instruction=asked, input=source, output=text))
        .when(kind == 2, named(
            messages=F.array(
                message("role", "user", "content", asked), message("role", "assistant", "content", text)
            ),
            images=F.array(source),
        ))
        .when(kind == 6, named(conversations=F.array(
            message("from", "system", "value", source),
            message("from", "human", "value", asked),
            message("from", "gpt", "value", text),
        )))
        .otherwise(named(text=text))
    )
    return docs.select("doc_id", F.col("source").alias("dataset"), record.alias("record"))


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a JSON line of one of nine record shapes."""
    docs = documents(spark, sf_dir)
    kind, text, source = F.col("doc_id") % 9, F.col("text"), F.col("source")
    line = lambda *fields: F.to_json(F.struct(*[v.alias(n) for n, v in fields]))
    turn = lambda a, b: F.array(F.struct(F.lit("user").alias(a), text.alias(b)))
    no_turns = F.array().cast("array<string>")
    value = (
        F.when(kind == 0, line(("messages", turn("role", "content")), ("tools", source)))
        .when(kind == 1, line(("conversations", turn("from", "value"))))
        .when(kind == 2, line(("instruction", source), ("output", text)))
        .when(kind == 3, line(("question", source), ("context", source), ("answer", text)))
        .when(kind == 4, line(("lang", source), ("text", text)))
        .when(kind == 5, line(("foo", text)))
        .when(kind == 6, line(("zeta", text), ("alpha", source)))
        .when(kind == 7, F.to_json(F.array(text)))
        .otherwise(line(
            ("conversations", no_turns), ("system_prompt", source), ("prompt", source), ("response", text)
        ))
    )
    return docs.select("doc_id", value.alias("value"))


def refused_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a line with a repeated key or NaN, or as one that is no JSON."""
    docs = documents(spark, sf_dir)
    # The JSON of an array of one text, without the brackets.
    listed = F.to_json(F.array("text"))
    text = F.substring(listed, F.lit(2), F.length(listed) - 2)
    line = lambda before, after: F.concat(F.lit(before), text, F.lit(after))
    lines = [
        line('{"tools":NaN,"conversations":4,"conversations":[1,{"from":"human","value":', "}]}"),
        line('{"lang":NaN,"text":', "}"),
        line('{"zeta":-Infinity,"alpha":1,"zeta":', "}"),
        line('{"question":1,"answer":[{"text":NaN}],"question":', "}"),
        line('{"text":NaN,"text":', '} {"a":1}'),
    ]
    return docs.select("doc_id", F.get(F.array(*lines), F.col("doc_id") % 5).alias("value"))


def write_array_files(df: DataFrame, key: str, path: str, before: str = "[", after: str = "]") -> None:
    """Rows as JSON array files of a bounded number of rows each."""
    row = F.to_json(F.struct(*df.columns))
    files = df.groupBy(F.floor(F.col(key) / ROWS_PER_ARRAY_FILE).alias("file")).agg(
        F.concat(F.lit(before), F.array_join(F.collect_list(row), ",\n"), F.lit(after)).alias("value")
    )
    files.write.partitionBy("file").text(path)


def written(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)
