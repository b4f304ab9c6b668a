"""Registered queries: one or more per operator, each over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from mixloom import prepare
from mixloom.functions.content import flatten_content
from mixloom.operators import batching, metrics, mixture, profile, records, render, runs, sampling
from mixloom.plans import inputs
from mixloom.plans.inputs import CHAT_TAGS, table, written
from mixloom.sources import catalogue, mixtures, ranges, readers, sinks
from mixloom.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PAGES_SCHEMA = "page_id bigint, url string, html string"


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


# Sources

@query
def scan_json_array(spark, sf_dir):
    path = written(spark, "array")
    inputs.write_array_files(table(spark, sf_dir, "pages"), "page_id", path)
    return readers.read_json(spark, f"{path}/*", schema=PAGES_SCHEMA)


@query
def scan_json_array_ranges(spark, sf_dir):
    path = written(spark, "array-ranges")
    inputs.write_array_files(table(spark, sf_dir, "pages"), "page_id", path)
    return ranges.parse_elements(ranges.json_elements(spark, f"{path}/*"), PAGES_SCHEMA)


@query
def scan_json_root_ranges(spark, sf_dir):
    path = written(spark, "root-ranges")
    inputs.write_array_files(
        table(spark, sf_dir, "pages"), "page_id", path, '{"version": {"of": ["v1"]}, "rows": [', '], "extra": [1]}'
    )
    return ranges.parse_elements(ranges.json_elements(spark, f"{path}/*", of_root_object=True), PAGES_SCHEMA)


@query
def scan_json_lines_in_json(spark, sf_dir):
    path = written(spark, "lines")
    table(spark, sf_dir, "pages").write.json(f"{path}/pages.json")
    return readers.read_file(spark, f"{path}/pages.json").select("page_id", "url", "html")


@query
def scan_json_root(spark, sf_dir):
    path = written(spark, "root")
    inputs.write_array_files(
        table(spark, sf_dir, "pages"), "page_id", path, '{"version": "v1", "rows": [', '], "extra": []}'
    )
    return readers.read_json_root(spark, f"{path}/*").select("page_id", "url", "html")


@query
def scan_jsonl(spark, sf_dir):
    path = written(spark, "jsonl")
    table(spark, sf_dir, "pages").write.json(path)
    return readers.read_jsonl(spark, path, schema=PAGES_SCHEMA)


@query
def scan_csv(spark, sf_dir):
    path = written(spark, "csv")
    table(spark, sf_dir, "pages").write.csv(path, header=True, quoteAll=True, escape='"')
    return readers.read_csv(spark, path)


@query
def scan_csv_ranges(spark, sf_dir):
    path = written(spark, "csv-ranges")
    table(spark, sf_dir, "documents").select("doc_id", "text").write.csv(path, header=True, quoteAll=True, escape='"')
    return ranges.parse_records(ranges.csv_records(spark, path), ["doc_id", "text"])


@query
def scan_parquet(spark, sf_dir):
    return readers.read_parquet(spark, f"{sf_dir}/pages.parquet")


@query
def scan_text(spark, sf_dir):
    path = written(spark, "text")
    table(spark, sf_dir, "documents").select("text").write.text(path)
    return readers.read_text(spark, path)


def _written_entries(spark, sf_dir):
    """The documents as four datasets of different formats, with their catalogue."""
    base = written(spark, "mixture")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    of = lambda lang: docs.filter(F.col("lang") == lang)
    of("en").write.json(f"{base}/en.jsonl")
    of("fr").write.csv(f"{base}/fr.csv", header=True, quoteAll=True, escape='"')
    of("de").write.parquet(f"{base}/hub/org/de")
    inputs.write_array_files(
        docs.filter(~F.col("lang").isin("en", "fr", "de")), "doc_id", f"{base}/rest.json"
    )
    plain = {"formatting": "text", "columns": {"prompt": "text"}}
    return base, {
        "en": {"file_name": "en.jsonl", **plain},
        "fr": {"file_name": "fr.csv", **plain},
        "de": {"hf_hub_url": "org/de", **plain},
        "rest": {"file_name": "rest.json", **plain},
    }


@query
def load_mixture(spark, sf_dir):
    base, entries = _written_entries(spark, sf_dir)
    loaded = mixtures.load_mixture(spark, entries, root=base, hub_root=f"{base}/hub")
    return loaded.select(
        "dataset",
        F.try_variant_get("record", "$.doc_id", "bigint").alias("doc_id"),
        F.try_variant_get("record", "$.text", "string").alias("text"),
    )


@query
def prepare_datasets(spark, sf_dir):
    base, entries = _written_entries(spark, sf_dir)
    train, test = prepare.prepare_datasets(
        spark, entries, root=base, hub_root=f"{base}/hub", test_size=0.1, shuffle=True
    )
    parts = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return parts.groupBy("split").agg(
        F.count("*").alias("rows"), F.countDistinct("_id").alias("ids")
    )


@query
def scan_partitioned(spark, sf_dir):
    path = written(spark, "partitioned")
    held_out = F.when(F.col("n_chars") % 10 == 0, "test").otherwise("train")
    table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("lang").alias("subset"), held_out.alias("split")
    ).write.partitionBy("subset", "split").parquet(f"{path}/texts")
    return mixtures.read_partitioned(spark, path, split="train", subset="en", folder="texts")


@query
def concat_datasets(spark, sf_dir):
    path = written(spark, "labels") + ".jsonl"
    table(spark, sf_dir, "labels").write.json(path)
    paths = [f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", path]
    whole = readers.concat_datasets(spark, paths, source="origin")
    name = F.regexp_extract("origin", r"([a-z]+)[^/]*$", 1)
    return whole.select("doc_id", "item_id", "text", "quality", "toxic", name.alias("origin"))


@query
def load_custom(spark, sf_dir):
    def loader(session, options):
        return session.read.parquet(options["path"]).select("doc_id", "lang", "n_chars")

    return readers.load_custom(spark, loader, {"path": f"{sf_dir}/documents.parquet", "max_samples": 1})


# Sinks

@query
def write_metrics(spark, sf_dir):
    path = written(spark, "results")
    sinks.write_metrics(perplexity_by_run(spark, sf_dir), path)
    return readers.read_jsonl(spark, path, schema="run bigint, perplexity double")


@query
def metrics_append(spark, sf_dir):
    path = written(spark, "metrics")
    rows = inputs.metric_rows(spark, sf_dir)
    is_eval = F.col("n_tokens") > 25
    sinks.append_metrics(rows.filter(is_eval), path, "step", "ts")
    sinks.append_metrics(rows.filter(~is_eval), path, "step", "ts")
    return readers.read_jsonl(
        spark, path, schema="step bigint, timestamp string, run bigint, loss double, n_tokens bigint"
    )


@query
def write_splits(spark, sf_dir):
    path = written(spark, "splits")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sinks.write_splits(sampling.split(docs, "doc_id"), path)
    return readers.read_parquet(spark, path)


# Projections

@query
def project_text(spark, sf_dir):
    return render.project_text(table(spark, sf_dir, "pages"), "html")


@query
def format_text_prompt(spark, sf_dir):
    return render.format_text(table(spark, sf_dir, "documents"), "text", keep=("doc_id",))


@query
def format_text_pair(spark, sf_dir):
    rows = inputs.instruction_rows(spark, sf_dir)
    return render.format_text(rows, "instruction", "output", keep=("conv_id", "turn"))


@query
def preview(spark, sf_dir):
    return profile.preview(table(spark, sf_dir, "documents"), "doc_id")


# Rendering

@query
def alpaca_input(spark, sf_dir):
    return render.render_instruction(
        inputs.instruction_rows(spark, sf_dir), keep=("conv_id", "turn")
    )


@query
def alpaca_no_input(spark, sf_dir):
    rows = inputs.instruction_rows(spark, sf_dir).withColumnsRenamed({"instruction": "q", "output": "a"})
    return render.render_instruction(rows, {"prompt": "q", "response": "a"}, keep=("conv_id", "turn"))


@query
def alpaca_plain(spark, sf_dir):
    return render.render_instruction(
        inputs.instruction_rows(spark, sf_dir), keep=("conv_id", "turn"), plain=True
    )


@query
def alpaca_response_col(spark, sf_dir):
    rows = inputs.instruction_rows(spark, sf_dir).withColumnRenamed("output", "response")
    return render.render_instruction(rows, keep=("conv_id", "turn"), strict_columns=True)


@query
def custom_template(spark, sf_dir):
    template = "{{Q}} {instruction}\n[{input}]\n{{A}} {output} ({instruction})"
    return render.render_template(
        inputs.instruction_rows(spark, sf_dir), template, "instruction", "output", "input",
        keep=("conv_id", "turn"),
    )


@query
def user_map(spark, sf_dir):
    rows = inputs.instruction_rows(spark, sf_dir)
    return render.map_text(
        rows, lambda r: r["instruction"] + " -> " + r["output"].fillna(""), keep=("conv_id", "turn")
    )


@query
def chat_render(spark, sf_dir):
    return render.render_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", tags=CHAT_TAGS)


@query
def chat_assemble(spark, sf_dir):
    nested = render.assemble_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return nested.select("conv_id", F.inline("messages"))


@query
def chat_render_tags(spark, sf_dir):
    nested = render.assemble_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    renamed = F.transform("messages", lambda m: F.struct(
        m["role"].alias("speaker"), m["content"].alias("value")
    ))
    tags = {"role_tag": "speaker", "user_tag": "user", "assistant_tag": "assistant"}
    return render.render_chat(
        nested.withColumn("messages", renamed), "messages", tags, keep=("conv_id",)
    )


@query
def chat_unknown_roles(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    called = F.when(F.col("turn") % 3 == 2, "function_call").otherwise(F.col("role"))
    return render.render_turns(turns.withColumn("role", called), "conv_id", "turn", tags=CHAT_TAGS)


@query
def content_blocks(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    text, role, kind = F.col("text"), F.col("role"), F.col("turn") % 6
    variant = lambda value: F.to_variant_object(value)
    content = (
        F.when(kind == 0, text.cast("variant"))
        .when(kind == 1, variant(F.array(role, text)))
        .when(kind == 2, variant(F.array(F.struct(F.lit("text").alias("type"), text.alias("value")))))
        .when(kind == 3, variant(F.array(
            F.struct(F.lit(5).alias("value"), role.alias("text")), F.struct(F.lit(6).alias("value"), text.alias("text"))
        )))
        .when(kind == 4, variant(F.array(F.struct(F.col("conv_id").alias("image")))))
        .otherwise(variant(F.struct(role.alias("value"))))
    )
    flat = turns.withColumn("content", content)
    flattened = flatten_content(F.col("content"), flat.schema["content"].dataType)
    return flat.select("conv_id", "turn", flattened.alias("text"))


# Preference, feedback, media and tool records

@query
def preference_pairs(spark, sf_dir):
    rows = inputs.instruction_rows(spark, sf_dir)
    answer = lambda content: F.struct(F.lit("gpt").alias("from"), content.alias("value"))
    pairs = rows.select(
        "conv_id", "turn", "instruction", answer(F.col("output")).alias("chosen"),
        answer(inputs.without_fifth_words(F.col("output"))).alias("rejected"),
    )
    return records.preference_pairs(pairs, keep=("conv_id", "turn"))


@query
def preference_messages(spark, sf_dir):
    rows = inputs.instruction_rows(spark, sf_dir)
    message = lambda role, text: F.struct(
        F.lit(role).alias("role"),
        F.array(F.struct(F.lit("text").alias("type"), text.alias("value"))).alias("content"),
    )
    prompt = message("user", F.col("instruction"))
    changed = message("user", F.when(F.col("turn") % 4 == 0, F.col("instruction")).otherwise(F.col("input")))
    lists = rows.select(
        "conv_id", "turn",
        F.array(prompt, message("assistant", F.col("output"))).alias("chosen_messages"),
        F.array(changed, message("assistant", inputs.without_fifth_words(F.col("output")))).alias("rejected_messages"),
    )
    pairs = records.preference_messages(lists, keep=("conv_id", "turn"))
    return pairs.select(
        "conv_id", "turn", F.size("prompt_messages").alias("n_prompt"), "chosen", "rejected", "same_prompt"
    )


@query
def feedback_rows(spark, sf_dir):
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return records.feedback_rows(labelled, "source", "text", "quality", keep=("doc_id",))


@query
def check_media(spark, sf_dir):
    nested = render.assemble_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    marked = F.transform("messages", lambda m, i: F.struct(
        m["role"].alias("from"),
        F.concat(F.repeat(F.lit("<image>"), (i % 3).cast("int")), m["content"]).alias("value"),
    ))
    paths = F.transform(
        F.slice("messages", 1, (F.size("messages") - F.col("conv_id") % 2).cast("int")),
        lambda m: m["role"],
    )
    media = nested.select("conv_id", marked.alias("conversations"), paths.alias("images"))
    return records.check_media(media).drop("conversations", "images")


@query
def check_roles(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    broken = (F.col("conv_id") % 5 == 0) & (F.col("turn") == 3)
    role = F.when(broken, "tool").otherwise(F.col("role"))
    return records.check_turn_roles(turns.withColumn("role", role), "conv_id", "turn", tags=CHAT_TAGS)


@query
def check_roles_nested(spark, sf_dir):
    nested = render.assemble_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    broken = F.transform("messages", lambda m, i: F.struct(
        F.when((F.col("conv_id") % 5 == 0) & (i == 3), "tool").otherwise(m["role"]).alias("role"),
        m["content"].alias("content"),
    ))
    checked = records.check_roles(nested.withColumn("messages", broken), "messages", CHAT_TAGS)
    return checked.select("conv_id", "roles_ok", "first_bad")


@query
def check_required(spark, sf_dir):
    rows = inputs.instruction_rows(spark, sf_dir)
    checked = records.check_required(rows, ("instruction", "input", "output"))
    return checked.select("conv_id", "turn", F.array_join("reasons", ",").alias("reasons"))


@query
def loss_mask(spark, sf_dir):
    nested = render.assemble_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    weighted = F.transform("messages", lambda m, i: F.struct(
        m["role"].alias("role"), m["content"].alias("content"), F.when(i % 3 == 2, 0.5).alias("loss_weight")
    ))
    return records.loss_mask(nested.withColumn("messages", weighted), keep=("conv_id",))


@query
def history_messages(spark, sf_dir):
    pair = F.struct("instruction", "output")
    grouped = render.collect_ordered(inputs.instruction_rows(spark, sf_dir), "conv_id", "turn", pair)
    last = F.element_at("items", -1)
    earlier = F.transform(
        F.slice("items", 1, F.size("items") - 1), lambda p: F.array(p["instruction"], p["output"])
    )
    rows = grouped.select(
        "conv_id", last["instruction"].alias("instruction"), last["output"].alias("output"),
        F.when(F.size("items") > 1, earlier).alias("history"),
        F.when(F.col("conv_id") % 2 == 0, "Be brief.").alias("system"),
    )
    messages = records.expand_history(rows, system="system", keep=("conv_id",))
    return messages.select("conv_id", F.posexplode("messages").alias("pos", "m")).select(
        "conv_id", "pos", "m.role", "m.content"
    )


# Limits, shuffle, split

@query
def max_samples(spark, sf_dir):
    return sampling.head(table(spark, sf_dir, "documents").select("doc_id", "text"), 100, "doc_id")


@query
def shuffle_rank(spark, sf_dir):
    return sampling.shuffle_rank(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def _keys_with_nulls(spark, sf_dir):
    """Documents of which every seventh has no key, and its number."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")).alias("key"), "n_chars")


@query
def rank_null_keys(spark, sf_dir):
    ranked = sampling.shuffle_rank(_keys_with_nulls(spark, sf_dir).select("key"), "key")
    return ranked.select("key", "rank")


@query
def head_ties(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "n_chars")
    return sampling.head(docs, 75, "source").select("source")


@query
def split_ordered_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("name"))
    return sampling.split(docs, "name", 0.25, shuffle=False)


@query
def split_fraction(spark, sf_dir):
    return sampling.split(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 0.1)


@query
def split_count(spark, sf_dir):
    return sampling.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, seed=7)


@query
def split_ordered(spark, sf_dir):
    return sampling.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.25, shuffle=False)


@query
def split_repeated_keys(spark, sf_dir):
    """A key that many rows share: whole rows, each conversation's turns under one key."""
    tagged = sampling.split(table(spark, sf_dir, "conversations"), "conv_id", 0.3, shuffle=False)
    return sampling.split_counts(tagged)


@query
def split_none(spark, sf_dir):
    return sampling.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0)


@query
def eval_subset(spark, sf_dir):
    return metrics.perplexity(sampling.head(inputs.metric_rows(spark, sf_dir), 100, "step")).select(
        F.round("perplexity", 6).alias("perplexity")
    )


@query
def split_counts(spark, sf_dir):
    texts = render.render_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", tags=CHAT_TAGS)
    return sampling.split_counts(sampling.split(texts, "conv_id"))


# Metrics

@query
def perplexity(spark, sf_dir):
    rows = inputs.metric_rows(spark, sf_dir)
    return metrics.perplexity(rows).select(F.round("perplexity", 6).alias("perplexity"))


@query
def perplexity_by_run(spark, sf_dir):
    rows = inputs.metric_rows(spark, sf_dir)
    return metrics.perplexity(rows, by=("run",)).select("run", F.round("perplexity", 6).alias("perplexity"))


@query
def perplexity_null(spark, sf_dir):
    rows = inputs.metric_rows(spark, sf_dir)
    some = rows.withColumn("loss", F.when(F.col("step") % 3 != 0, F.col("loss")))
    return metrics.perplexity(some, by=("run",)).select("run", F.round("perplexity", 6).alias("perplexity"))


@query
def bleu(spark, sf_dir):
    scored = metrics.bleu(inputs.prediction_pairs(spark, sf_dir))
    doubles = ["bleu", "precision_1", "precision_2", "precision_3", "precision_4", "brevity_penalty"]
    return scored.select(
        *[F.round(c, 6).alias(c) for c in doubles], "translation_length", "reference_length"
    )


def _rouge_n(spark, sf_dir, kind):
    pairs = inputs.prediction_pairs(spark, sf_dir)
    return metrics.rouge(pairs, kinds=(kind,)).select(F.round(kind, 6).alias(kind))


@query
def rouge1(spark, sf_dir):
    return _rouge_n(spark, sf_dir, "rouge1")


@query
def rouge2(spark, sf_dir):
    return _rouge_n(spark, sf_dir, "rouge2")


@query
def rouge_l(spark, sf_dir):
    pairs = inputs.prediction_pairs(spark, sf_dir)
    scores = metrics.rouge_scores(pairs, kinds=("rougeL",), keep=("doc_id",))
    return scores.select("doc_id", F.round("rougeL", 6).alias("rouge_l"))


@query
def rouge_rows(spark, sf_dir):
    scores = metrics.rouge_scores(inputs.prediction_pairs(spark, sf_dir), keep=("doc_id",))
    return scores.select("doc_id", *[F.round(k, 6).alias(k.lower()) for k in ("rouge1", "rouge2", "rougeL")])


@query
def rouge_bootstrap(spark, sf_dir):
    found = metrics.rouge_bootstrap(inputs.prediction_pairs(spark, sf_dir), "doc_id", replicates=200, seed=5)
    return found.select("metric", *[F.round(c, 6).alias(c) for c in ("low", "mid", "high")])


@query
def evaluate_metrics(spark, sf_dir):
    rows = inputs.prediction_pairs(spark, sf_dir)
    share = F.sum(F.length("prediction")) / F.sum(F.length("reference"))
    parts = metrics.MetricParts((share.alias("length_share"),), (F.col("length_share"),))
    metrics.register_parts("length_share", lambda: parts)
    values = metrics.evaluate(rows, ["length_share", "rouge"])
    return values.withColumn("value", F.round("value", 6))


@query
def evaluate_generation(spark, sf_dir):
    def make_model():
        return lambda prompts: [f"{p} {p.lower()}" for p in prompts]

    kinds = ("rouge1", "rouge2")
    metrics.register_metric("rouge_n", lambda df: metrics.rouge(df, kinds=kinds))
    values = metrics.evaluate_generation(
        inputs.documents(spark, sf_dir), make_model, ["rouge_n"], keep=("doc_id",), path=written(spark, "generation")
    )
    return values.select("metric", F.round("value", 6).alias("value"))


@query
def planned_steps(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"))
    return runs.planned_steps(docs, batch=2, accum=4, epochs=3)


@query
def run_metrics(spark, sf_dir):
    summary = runs.run_metrics(inputs.metric_rows(spark, sf_dir), "run", "step", "loss")
    return summary.withColumn("mean_loss", F.round("mean_loss", 6))


@query
def run_metrics_by_epoch(spark, sf_dir):
    rows = inputs.metric_rows(spark, sf_dir).withColumn("epoch", F.floor(F.col("step") / 1000))
    summary = runs.run_metrics(rows, "run", "step", "loss", epoch="epoch")
    return summary.withColumn("mean_loss", F.round("mean_loss", 6))


@query
def latest_checkpoint(spark, sf_dir):
    name = F.concat(F.lit("checkpoint-"), F.col("step") * 100)
    return runs.latest_checkpoint(inputs.metric_rows(spark, sf_dir).withColumn("name", name), "run", "name")


@query
def run_eta(spark, sf_dir):
    return runs.run_eta(inputs.metric_rows(spark, sf_dir), "run", "step", "ts", 1_000_000)


# Evaluation preparation and batches

@query
def prompt_target(spark, sf_dir):
    return metrics.cut_prompt(inputs.documents(spark, sf_dir), keep=("doc_id",))


@query
def strip_prompt(spark, sf_dir):
    cut = metrics.cut_prompt(inputs.documents(spark, sf_dir), keep=("doc_id", "source"))
    echoed = F.concat("prompt", F.lit(" \t "), "target", F.lit(" \n"))
    return metrics.strip_prompt(cut.withColumn("output", echoed), keep=("doc_id",))


@query
def batch_predict(spark, sf_dir):
    def make_model():
        return lambda prompts: [f"{len(p)}:{p.split(' ')[0]}" for p in prompts]

    prompts = inputs.documents(spark, sf_dir).select("doc_id", F.col("text").alias("prompt"))
    return batching.batch_predict(prompts, "prompt", make_model).select("doc_id", "response")


@query
def token_truncate(spark, sf_dir):
    cut = batching.truncate_tokens(inputs.documents(spark, sf_dir), keep=("doc_id",))
    return cut.select("doc_id", "n_tokens", F.array_join("tokens", " ").alias("text"))


@query
def token_truncate_plugged(spark, sf_dir):
    def tokenizer():
        import re
        return re.compile("[a-z]+").findall

    cut = batching.truncate_tokens(
        inputs.documents(spark, sf_dir), max_tokens=512, tokenizer=tokenizer, keep=("doc_id",)
    )
    return cut.select("doc_id", "n_tokens", F.array_join("tokens", " ").alias("text"))


@query
def length_batches(spark, sf_dir):
    sized = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("length"))
    return batching.length_batches(sized, "doc_id", "length", batch=8, step=256)


@query
def length_batches_null(spark, sf_dir):
    long = F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).otherwise(F.col("n_chars") * 1_000_000)
    length = F.when(F.col("doc_id") % 5 != 0, long)
    sized = table(spark, sf_dir, "documents").select("doc_id", length.alias("length"))
    return batching.length_batches(sized, "doc_id", "length", batch=8, step=256)


@query
def padding_report(spark, sf_dir):
    sized = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("length"))
    return batching.padding_report(batching.length_batches(sized, "doc_id", "length", batch=8, step=256), "length")


# Mixtures

def _resolved(spark, sf_dir, **options):
    declared = catalogue.catalogue_table(spark, inputs.entries())
    return mixture.resolve_mixture(inputs.mixture(spark, sf_dir), declared, **options)


@query
def mixture_resolve(spark, sf_dir):
    known = {k: v for k, v in inputs.entries().items() if k != "src11"}
    records_ = inputs.mixture(spark, sf_dir)
    resolved = mixture.resolve_mixture(
        records_, catalogue.catalogue_table(spark, known), unknown="quarantine"
    )
    return resolved.select("doc_id", "dataset", "known", "source", "path", "split", "formatting")


@query
def catalogue_defaults(spark, sf_dir):
    by_key = lambda m: F.to_json(F.map_from_entries(F.sort_array(F.map_entries(m))))
    return _resolved(spark, sf_dir).select(
        "doc_id", "source", "path", "split", "formatting", "has_input",
        by_key("columns").alias("columns"), by_key("tags").alias("tags"),
    )


@query
def mixture_flags(spark, sf_dir):
    return _resolved(spark, sf_dir).select(
        "doc_id", "ranking", "kto", "has_images", "has_videos", "has_audios", "has_tools"
    )


@query
def mixture_columns(spark, sf_dir):
    return mixture.with_mapped_columns(
        _resolved(spark, sf_dir).select("doc_id", "record", "columns"), ("prompt", "query", "response")
    ).select("doc_id", "prompt", "query", "response")


@query
def mixture_render(spark, sf_dir):
    return mixture.render_mixture(_resolved(spark, sf_dir), keep=("doc_id", "dataset"))


@query
def mixture_by_type(spark, sf_dir):
    declared = catalogue.catalogue_table(spark, inputs.entries())
    records_ = inputs.mixture(spark, sf_dir)
    kept = [
        mixture.keep_type(records_, declared, kind).select("doc_id", F.lit(kind).alias("type"))
        for kind in ("ranking", "sft", "multimodal")
    ]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


@query
def mixture_search(spark, sf_dir):
    return mixture.keep_named(inputs.mixture(spark, sf_dir), "RC1").select("doc_id", "dataset")


@query
def mixture_summary(spark, sf_dir):
    declared = catalogue.catalogue_table(spark, inputs.entries())
    return mixture.mixture_summary(inputs.mixture(spark, sf_dir), declared)


@query
def detect_format(spark, sf_dir):
    return profile.detect_format(inputs.mixed_lines(spark, sf_dir), keep=("doc_id",))


@query
def detect_refused_lines(spark, sf_dir):
    return profile.detect_format(inputs.refused_lines(spark, sf_dir), keep=("doc_id",)).drop("tags")


@query
def format_profile(spark, sf_dir):
    groups = profile.format_profile(inputs.mixed_lines(spark, sf_dir), "doc_id")
    return groups.withColumn("share", F.round("share", 6))


@query
def format_samples(spark, sf_dir):
    found = profile.format_samples(inputs.mixed_lines(spark, sf_dir), "doc_id")
    return found.select("format", "columns", "tags", "place", "doc_id")


@query
def detect_format_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).withColumnsRenamed({"text": "body"})
    return profile.detect_table(rows, keep=("doc_id",))


# Streams

@query
def chat_render_stream(spark, sf_dir):
    base = written(spark, "chat-stream")
    turns = table(spark, sf_dir, "conversations")
    render.assemble_turns(turns, "conv_id", "turn").write.json(f"{base}/in")
    schema = "conv_id bigint, messages array<struct<role string, content string>>"
    streams.render_chat_stream(
        spark, f"{base}/in", schema, "messages", CHAT_TAGS, ("conv_id",), f"{base}/out", f"{base}/state"
    ).awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query
def metrics_append_stream(spark, sf_dir):
    base = written(spark, "metric-log-stream")
    inputs.metric_rows(spark, sf_dir).write.parquet(f"{base}/in")
    arriving = spark.readStream.schema("run bigint, step bigint, ts timestamp, loss double, n_tokens bigint").parquet(f"{base}/in")
    streams.append_metrics_stream(arriving, f"{base}/log", f"{base}/state", "step", "ts").awaitTermination()
    schema = "step bigint, timestamp string, run bigint, loss double, n_tokens bigint"
    return readers.read_jsonl(spark, f"{base}/log", schema=schema).drop("batch")


@query
def run_metrics_stream(spark, sf_dir):
    base = written(spark, "metric-stream")
    sinks.append_metrics(inputs.metric_rows(spark, sf_dir), f"{base}/in", "step", "ts")
    schema = "step bigint, timestamp string, run bigint, loss double, n_tokens bigint"
    streams.run_metrics_stream(
        spark, f"{base}/in", schema, "run", "step", "loss", f"{base}/out", f"{base}/state"
    ).awaitTermination()
    return streams.latest_summary(spark, f"{base}/out").withColumn("mean_loss", F.round("mean_loss", 6))
