"""Registered queries of the operators for training data, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from mixloom.llm import ann, bpe, decontaminate, fingerprints, langid, linededup, lm, mixing, neardup, sharding, spelling, toxicity, turns
from mixloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SHARDS = 40


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


@query
def op3_sharding(spark, sf_dir):
    rows = sharding.document_rows(table(spark, sf_dir, "documents"))
    placed = sharding.shard_rows(rows, SHARDS, ["doc_id", "text_crc32", "size"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "number",
    )


@query
def op7_bpe(spark, sf_dir):
    return bpe.encode_documents(table(spark, sf_dir, "documents"), keep_ids=False)


@query
def op10_near_dedup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


@query
def op1_mixing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query
def op4_line_dedup(spark, sf_dir):
    cleaned = linededup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "lines_deleted", "n_chars", F.sha2("text", 256).alias("text_sha256"))


@query
def op9_ann(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query
def op2_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, ~toxicity.held_out())
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query
def op5_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    languages, chance = langid.train(docs, ~langid.held_out())
    predicted = langid.predict_language(docs.select("doc_id", "text"), languages, chance)
    return predicted.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query
def op8_fingerprints(spark, sf_dir):
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op6_lm_scoring(spark, sf_dir):
    scored = lm.score_documents(table(spark, sf_dir, "documents"), ~lm.held_out())
    return scored.withColumn("held_out", ~F.col("trained")).drop("trained")


@query
def op12_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_conversations(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return turns.conversation_reports(turns.repair_turns(turns.damage(conversations)), conversations)


@query
def op11_spelling(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


# The checksum's table is built by its rule; texts up to U+07FF are spelt out in UTF-8.
_CRC_TABLE = """SELECT list(v ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) AS r(i))"""


def _crc32(text: str) -> str:
    spelt = (
        f"flatten(list_transform(string_split({text}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] "
        "ELSE [192 + (unicode(ch) >> 6), 128 + (unicode(ch) & 63)]::BIGINT[] END))"
    )
    step = "lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {spelt}), {step}), 4294967295)"


_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_ITEM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '{decontaminate.ITEM_WORD}')"

ORACLES["op12_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_ITEM_WORDS} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
    FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
places AS (
    SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
    FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
),
found AS (SELECT rid, i, n, item FROM places JOIN windows USING (n, phrase)),
hits AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM found) GROUP BY rid),
held AS (
    SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN held USING (rid)
"""

ORACLES["op11_spelling"] = f"""
WITH RECURSIVE crc_table AS ({_CRC_TABLE}),
runs AS (
    SELECT id, run, count(*) AS c FROM (
        SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, {_FOLD}), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run
        FROM documents) WHERE length(run) >= 7 GROUP BY ALL
),
summed AS (SELECT run, c, {_crc32("id || ':' || run")} AS h FROM runs, crc_table),
words AS (
    SELECT word, sum(c)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM summed
    ) WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2
),
shorter AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
    SELECT a.word AS word, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b USING (rest, i) WHERE a.word <> b.word
    UNION SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.rest = w.word
    UNION SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.rest = w.word
),
best AS (
    SELECT word, count(*) AS n_near, min({{'less': -near_n, 'form': near}}) AS b FROM pairs GROUP BY word
),
known AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 10 * w.n THEN b.form END AS form,
           CASE WHEN -b.less >= 10 * w.n THEN -b.less END AS form_n
    FROM words w LEFT JOIN best USING (word)
),
ways AS (
    SELECT word, word AS root, 0 AS steps FROM known
    UNION ALL SELECT ways.word, known.form, steps + 1 FROM ways JOIN known ON known.word = ways.root WHERE known.form IS NOT NULL
),
roots AS (SELECT word, arg_max(root, steps) AS root FROM ways GROUP BY word)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM known JOIN roots USING (word)
"""


def _least_edits(state: str, after: dict[str, str], given: str) -> str:
    """Cheapest of deleting, keeping and reroling a turn in a state, as (cost, audit, lines)."""
    options = [f"{{'c': 3 + x.{state}.c, 'a': 'D' || x.{state}.a, 'l': x.{state}.l}}"]
    options += [
        f"CASE WHEN NOT gone AND initial = '{letter}' THEN "
        f"{{'c': late + x.{to}.c, 'a': 'K' || x.{to}.a, 'l': chr(10) || role || ':' || text || x.{to}.l}} END"
        for letter, to in after.items()
    ]
    to = {"user": "u", "assistant": "a"}[given]
    options.append(
        f"CASE WHEN NOT gone THEN {{'c': 2 + late + x.{to}.c, 'a': 'R' || x.{to}.a, "
        f"'l': chr(10) || '{given}:' || text || x.{to}.l}} END"
    )
    return f"list_min([{', '.join(options)}]) AS {state}"


def _or_insert(state: str, given: str) -> str:
    to = {"user": "u", "assistant": "a"}[given]
    return (
        f"list_min([{state}, {{'c': 2 + {to}.c, 'a': 'I' || {to}.a, 'l': chr(10) || '{given}:' || {to}.l}}]) AS {state}"
    )


_NO_LINES = "{'c': 0::BIGINT, 'a': '', 'l': ''}"
_DAMAGED_TEXT = "CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END"
_TRIMMED = "trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

ORACLES["op13_conversations"] = f"""
WITH RECURSIVE crc_table AS ({_CRC_TABLE}),
summed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
    FROM conversations, crc_table
),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, {_DAMAGED_TEXT} AS text,
           unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM summed WHERE kind <> 0
),
numbered AS (
    SELECT *, coalesce(CAST(conv_id AS VARCHAR), '') AS conv, left(role, 1) AS initial, {_TRIMMED} AS trimmed,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
    FROM damaged
),
marked AS (
    SELECT *, trimmed = '' OR again AS gone, (trimmed <> '' AND NOT again AND right(trimmed, 1) NOT IN ('.', '!', '?'))::BIGINT AS late,
           coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial NOT IN ('su', 'ua', 'au'), false) AS odd
    FROM numbered
),
least_cost AS (
    SELECT conv, count(*) + 1 AS pos, {_NO_LINES} AS n, {{'c': 4::BIGINT, 'a': 'II', 'l': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s,
           {{'c': 2::BIGINT, 'a': 'I', 'l': chr(10) || 'assistant:'}} AS u, {_NO_LINES} AS a
    FROM marked GROUP BY conv
    UNION ALL
    SELECT conv, pos, {_or_insert("n", "user")}, {_or_insert("s", "user")}, u, a FROM (
        SELECT conv, pos, n, s, {_or_insert("u", "assistant")}, {_or_insert("a", "user")} FROM (
            SELECT m.conv, m.pos, {_least_edits("n", {"s": "s", "u": "u"}, "user")}, {_least_edits("s", {"u": "u"}, "user")},
                   {_least_edits("u", {"a": "a"}, "assistant")}, {_least_edits("a", {"u": "u"}, "user")}
            FROM least_cost x JOIN marked m ON m.conv = x.conv AND m.pos = x.pos - 1
        )
    )
),
counts AS (
    SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (trimmed = '') AS blank,
           count(*) FILTER (trimmed <> '' AND again) AS duplicate, sum(late) AS truncated, count(*) FILTER (odd) AS illegal
    FROM marked GROUP BY conv
),
whole AS (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS conv FROM conversations)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(n.c, 0)::BIGINT AS cost,
       coalesce(n.a, '') AS audit, sha256(coalesce(n.l[2:], '')) AS repaired_sha256
FROM whole LEFT JOIN counts USING (conv) LEFT JOIN (SELECT conv, n FROM least_cost WHERE pos = 1) USING (conv)
"""
