"""The SQL counterpart of every registered query, for DuckDB over the same tables."""

from __future__ import annotations

from collections.abc import Callable

ORACLES: dict[str, str] = {}

# White space for trim() and for regular expressions, and the 13a tokeniser, spelled in SQL.
SPACE_CLASS = (
    r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
SPACES = "(" + " || ".join(
    f"chr({c})" for c in [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
) + ")"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SPACE_CLASS}+'), lambda t: t <> '')"


def _tokens_13a(text: str) -> str:
    line = f"replace(replace(replace({text}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        line = f"replace({line}, '{entity}', '{char}')"
    line = f"' ' || {line} || ' '"
    for pattern, replacement in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        line = f"regexp_replace({line}, '{pattern}', '{replacement}', 'g')"
    return _words(line)


def _hash(key: str, seed: str) -> str:
    return f"('0x' || left(md5('{seed}:' || {key}), 15))::BIGINT"


FIFTH = "array_to_string(list_filter(string_split({0}, ' '), lambda w, i: i % 5 <> 0), ' ')"

PAIRS = """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS instruction,
         CASE WHEN u.turn % 2 = 0 THEN '' ELSE u.conv_id || '/' || u.turn END AS input,
         a.text AS output
  FROM conversations u
  LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""

ANSWER = "coalesce(output, '')"
# A message without any text is shown as its JSON.
NO_TEXT = '[{"type":"text"}]'

RUNS = """runs AS (
  SELECT user_id AS run, event_id AS step, ts, sqrt(value / 100) AS loss, 1 + event_id % 50 AS n_tokens
  FROM events)"""

PREAMBLE = (
    "'Below is an instruction that describes a task. "
    "Write a response that appropriately completes the request.' || chr(10) || chr(10) || "
)
HEAD = "'### {0}:' || chr(10) || "
GAP = " || chr(10) || chr(10) || "


def _instruct(instruction: str, output: str, input: str | None = None) -> str:
    middle = f"'### Input:' || chr(10) || {input}{GAP}" if input else ""
    return (
        f"{PREAMBLE}'### Instruction:' || chr(10) || {instruction}{GAP}{middle}"
        f"'### Response:' || chr(10) || {output}"
    )


def _chat(role: str) -> str:
    return (
        f"CASE {role} WHEN 'system' THEN 'System: ' WHEN 'user' THEN 'User: ' "
        "WHEN 'assistant' THEN 'Assistant: ' END || text"
    )


def _chat_query(role: str = "role") -> str:
    return f"""
SELECT conv_id,
       coalesce(string_agg({_chat(role)}, chr(10) || chr(10) ORDER BY turn), '') AS text
FROM conversations GROUP BY ALL"""


# Sources and sinks: what was written comes back.
for name in ("scan_json_array", "scan_json_array_ranges", "scan_json_lines_in_json", "scan_json_root", "scan_json_root_ranges", "scan_jsonl", "scan_parquet"):
    ORACLES[name] = "SELECT page_id, url, html FROM pages"
ORACLES["scan_csv_ranges"] = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents"
ORACLES["scan_csv"] = "SELECT CAST(page_id AS VARCHAR) AS page_id, url, html FROM pages"
ORACLES["scan_text"] = """
SELECT text FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM documents) WHERE length(text) > 0"""
ORACLES["load_mixture"] = """
SELECT CASE WHEN lang IN ('en', 'fr', 'de') THEN lang ELSE 'rest' END AS dataset, doc_id, text FROM documents"""
ORACLES["scan_partitioned"] = """
SELECT doc_id, text, lang AS subset, 'train' AS split FROM documents WHERE lang = 'en' AND n_chars % 10 <> 0"""
ORACLES["concat_datasets"] = """
SELECT doc_id, NULL AS item_id, text, NULL AS quality, NULL AS toxic, 'documents' AS origin FROM documents
UNION ALL SELECT NULL, item_id, text, NULL, NULL, 'benchmark' FROM benchmark
UNION ALL SELECT doc_id, NULL, NULL, CAST(quality AS BIGINT), CAST(toxic AS BIGINT), 'labels' FROM labels"""
ORACLES["load_custom"] = "SELECT doc_id, lang, n_chars FROM documents"
ORACLES["metrics_append"] = f"""
WITH {RUNS} SELECT step, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, run, loss, n_tokens FROM runs"""


def _split(columns: str, key: str, size: str, seed: int = 42, table: str = "documents") -> str:
    return f"""
SELECT {columns}, CASE WHEN row_number() OVER (ORDER BY {_hash(key, f'{seed}:split')}, {key}) <= {size}
       THEN 'test' ELSE 'train' END AS split
FROM {table}"""


TENTH = "(SELECT ceil(CAST(0.1 AS DOUBLE) * count(*)) FROM {0})"
ORACLES["write_splits"] = _split("doc_id, text", "doc_id", TENTH.format("documents"))

# Projections
ORACLES["project_text"] = "SELECT html AS text FROM pages"
ORACLES["format_text_prompt"] = "SELECT doc_id, text FROM documents"
ORACLES["format_text_pair"] = f"WITH {PAIRS} SELECT conv_id, turn, instruction{GAP}coalesce(output, '') AS text FROM pairs"
ORACLES["preview"] = """
SELECT doc_id, left('{"doc_id": ' || doc_id || ', "text": ' || CAST(to_json(text) AS VARCHAR)
       || ', "lang": "' || lang || '", "source": "' || source || '", "n_chars": ' || n_chars || '}', 500) AS record
FROM documents ORDER BY doc_id LIMIT 5"""

# Rendering
ORACLES["alpaca_input"] = f"""
WITH {PAIRS} SELECT conv_id, turn, {_instruct('instruction', ANSWER, 'input')} AS text FROM pairs"""
ORACLES["alpaca_response_col"] = ORACLES["alpaca_input"]
ORACLES["alpaca_no_input"] = f"""
WITH {PAIRS} SELECT conv_id, turn, {_instruct('instruction', ANSWER)} AS text FROM pairs"""
ORACLES["alpaca_plain"] = f"""
WITH {PAIRS} SELECT conv_id, turn, 'Instruction: ' || instruction
  || CASE WHEN input <> '' THEN chr(10) || 'Input: ' || input ELSE '' END
  || chr(10) || 'Response: ' || coalesce(output, '') AS text FROM pairs"""
ORACLES["custom_template"] = f"""
WITH {PAIRS} SELECT conv_id, turn, '{{Q}} ' || instruction || chr(10) || '[' || input || ']' || chr(10)
  || '{{A}} ' || coalesce(output, '') || ' (' || instruction || ')' AS text FROM pairs"""
ORACLES["user_map"] = f"""
WITH {PAIRS} SELECT conv_id, turn, instruction || ' -> ' || coalesce(output, '') AS text FROM pairs"""
ORACLES["chat_render"] = _chat_query()
ORACLES["chat_render_tags"] = _chat_query()
ORACLES["chat_render_stream"] = _chat_query()
ORACLES["chat_unknown_roles"] = _chat_query("(CASE WHEN turn % 3 = 2 THEN 'function_call' ELSE role END)")
ORACLES["chat_assemble"] = "SELECT conv_id, role, text AS content FROM conversations"
ORACLES["content_blocks"] = """
SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN text WHEN 1 THEN role || chr(10) || text WHEN 2 THEN text
  WHEN 3 THEN role || chr(10) || text WHEN 4 THEN '[{"image":' || conv_id || '}]'
  ELSE '{"value":"' || role || '"}' END AS text
FROM conversations"""

# Preference, feedback, media and tool records
ORACLES["preference_pairs"] = f"""
WITH {PAIRS} SELECT conv_id, turn, instruction AS prompt, {ANSWER} AS chosen,
  coalesce({FIFTH.format('output')}, '') AS rejected FROM pairs"""
ORACLES["preference_messages"] = f"""
WITH {PAIRS} SELECT conv_id, turn, 1 AS n_prompt, coalesce(output, '{NO_TEXT}') AS chosen,
  coalesce({FIFTH.format('output')}, '{NO_TEXT}') AS rejected,
  turn % 4 = 0 OR instruction = input AS same_prompt FROM pairs"""
ORACLES["feedback_rows"] = """
SELECT d.doc_id, d.source AS prompt, d.text AS completion, l.quality = 1 AS label
FROM documents d JOIN labels l USING (doc_id)"""
ORACLES["check_media"] = """
SELECT conv_id, CAST(sum(turn % 3) AS INTEGER) AS images_tokens,
  CAST(count(*) - max(conv_id) % 2 AS INTEGER) AS images_paths,
  sum(turn % 3) = count(*) - max(conv_id) % 2 AS media_ok
FROM conversations GROUP BY conv_id"""
ROLES = """
WITH turns AS (
  SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 AND turn = 3 THEN 'tool' ELSE role END AS role FROM conversations),
placed AS (
  SELECT t.conv_id, t.role, t.turn + 1 - CASE WHEN s.role = 'system' THEN 1 ELSE 0 END AS position
  FROM turns t LEFT JOIN turns s ON s.conv_id = t.conv_id AND s.turn = 0),
checked AS (
  SELECT conv_id, min(position) FILTER (WHERE position > 0 AND
    role <> CASE WHEN position % 2 = 1 THEN 'user' ELSE 'assistant' END) AS first_bad
  FROM placed GROUP BY conv_id)"""
ORACLES["check_roles"] = f"{ROLES} SELECT conv_id, first_bad IS NULL AS roles_ok, first_bad FROM checked"
ORACLES["check_roles_nested"] = (
    f"{ROLES} SELECT conv_id, first_bad IS NULL AS roles_ok,"
    " CAST(first_bad AS INTEGER) AS first_bad FROM checked"
)
ORACLES["check_required"] = f"""
SELECT u.conv_id, u.turn, concat_ws(',',
  CASE WHEN trim(u.text, {SPACES}) = '' THEN 'missing instruction' END,
  CASE WHEN u.turn % 2 = 0 THEN 'missing input' END,
  CASE WHEN a.text IS NULL OR trim(a.text, {SPACES}) = '' THEN 'missing output' END) AS reasons
FROM conversations u
LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'"""
ORACLES["loss_mask"] = """
SELECT conv_id, CAST(turn AS INTEGER) AS pos, role, text AS content,
  CASE WHEN turn % 3 = 2 THEN 0.5 WHEN role = 'assistant' THEN 1.0 ELSE 0.0 END::DOUBLE AS loss_weight
FROM conversations"""
ORACLES["history_messages"] = f"""
WITH {PAIRS}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n,
    CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END AS lead
  FROM pairs)
SELECT conv_id, CAST(lead + 2 * n AS INTEGER) AS pos, 'user' AS role, instruction AS content FROM numbered
UNION ALL SELECT conv_id, CAST(lead + 2 * n + 1 AS INTEGER), 'assistant', {ANSWER} FROM numbered
UNION ALL SELECT DISTINCT conv_id, 0, 'system', 'Be brief.' FROM numbered WHERE lead = 1"""

# Limits, shuffle, split
ORACLES["max_samples"] = "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 100"
ORACLES["shuffle_rank"] = f"""
SELECT doc_id, row_number() OVER (ORDER BY {_hash('doc_id', '42')}, doc_id) - 1 AS rank FROM documents"""
ORACLES["rank_null_keys"] = f"""
WITH keyed AS (SELECT CASE WHEN doc_id % 7 <> 0 THEN doc_id END AS key FROM documents)
SELECT key, row_number() OVER (ORDER BY {_hash("coalesce(CAST(key AS VARCHAR), '')", '42')}, key) - 1 AS rank FROM keyed"""
ORACLES["head_ties"] = "SELECT source FROM documents ORDER BY source LIMIT 75"
ORACLES["split_ordered_text"] = """
WITH named AS (SELECT sha256(CAST(doc_id AS VARCHAR)) AS name FROM documents)
SELECT name, CASE WHEN row_number() OVER (ORDER BY name DESC) <=
  (SELECT ceil(CAST(0.25 AS DOUBLE) * count(*)) FROM named) THEN 'test' ELSE 'train' END AS split
FROM named"""
ORACLES["split_fraction"] = _split("doc_id, n_chars", "doc_id", TENTH.format("documents"))
ORACLES["split_count"] = _split("doc_id", "doc_id", "50", seed=7)
ORACLES["split_repeated_keys"] = """
SELECT CASE WHEN place <= ceil(0.3 * n) THEN 'test' ELSE 'train' END AS split, count(*) AS rows
FROM (SELECT row_number() OVER (ORDER BY conv_id DESC) AS place, count(*) OVER () AS n FROM conversations) GROUP BY 1"""
ORACLES["split_none"] = "SELECT doc_id, 'train' AS split FROM documents"
ORACLES["split_ordered"] = """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id DESC) <=
  (SELECT ceil(CAST(0.25 AS DOUBLE) * count(*)) FROM documents) THEN 'test' ELSE 'train' END AS split
FROM documents"""
ORACLES["eval_subset"] = f"""
WITH {RUNS}, firsts AS (SELECT * FROM runs ORDER BY step LIMIT 100)
SELECT round(exp(sum(loss * n_tokens) / sum(n_tokens)), 6) AS perplexity FROM firsts"""
ORACLES["split_counts"] = f"""
WITH texts AS (SELECT DISTINCT conv_id FROM conversations),
tagged AS ({_split('conv_id', 'conv_id', TENTH.format('texts'), table='texts')})
SELECT split, count(*) AS rows FROM tagged GROUP BY split"""

ORACLES["prepare_datasets"] = f"""
WITH sized AS (SELECT count(*) AS n, CAST({TENTH.format('documents')} AS BIGINT) AS k FROM documents)
SELECT 'test' AS split, k AS rows, k AS ids FROM sized UNION ALL SELECT 'train', n - k, n - k FROM sized"""

# Metrics
ORACLES["perplexity"] = f"""
WITH {RUNS} SELECT round(exp(sum(loss * n_tokens) / sum(n_tokens)), 6) AS perplexity FROM runs"""
ORACLES["perplexity_by_run"] = f"""
WITH {RUNS} SELECT run, round(exp(sum(loss * n_tokens) / sum(n_tokens)), 6) AS perplexity FROM runs GROUP BY run"""


ORACLES["perplexity_null"] = f"""
WITH {RUNS} SELECT run, round(exp(sum(loss * n_tokens) / sum(n_tokens)), 6) AS perplexity
FROM runs WHERE step % 3 <> 0 GROUP BY run"""
ORACLES["write_metrics"] = ORACLES["perplexity_by_run"]


def _matches(tokens: Callable[[str], str], orders: str, table: str, key: str, p: str, r: str) -> str:
    """Per row, side and order: n-gram counts, from which the clipped matches follow."""
    return f"""
toks AS (
  SELECT {key} AS id, {tokens(r)} AS r, {tokens(p)} AS p FROM {table}),
grams AS (
  SELECT id, n, array_to_string(list_slice(p, i, i + n - 1), ' ') AS gram, 1 AS ps, 0 AS rs
  FROM (SELECT id, p, n, unnest(range(1, len(p) - n + 2)) AS i FROM toks, (SELECT unnest({orders}) AS n))
  UNION ALL
  SELECT id, n, array_to_string(list_slice(r, i, i + n - 1), ' '), 0, 1
  FROM (SELECT id, r, n, unnest(range(1, len(r) - n + 2)) AS i FROM toks, (SELECT unnest({orders}) AS n))),
counted AS (SELECT id, n, gram, sum(ps) AS ps, sum(rs) AS rs FROM grams GROUP BY ALL)"""


DOCUMENT_PAIRS = ("documents", "doc_id", FIFTH.format("text"), "text")


ORACLES["bleu"] = f"""
WITH {_matches(_tokens_13a, '[1, 2, 3, 4]', *DOCUMENT_PAIRS)},
sizes AS (SELECT sum(len(p)) AS np, sum(len(r)) AS nr FROM toks),
orders AS (SELECT n, sum(least(ps, rs)) / sum(ps) AS prec FROM counted GROUP BY n),
wide AS (SELECT exp(avg(ln(prec))) AS mean, max(prec) FILTER (WHERE n = 1) AS p1, max(prec) FILTER (WHERE n = 2) AS p2,
  max(prec) FILTER (WHERE n = 3) AS p3, max(prec) FILTER (WHERE n = 4) AS p4 FROM orders),
whole AS (SELECT *, CASE WHEN np > nr THEN 1.0 ELSE exp(1 - nr / np) END AS bp FROM wide, sizes)
SELECT round(mean * bp, 6) AS bleu, round(p1, 6) AS precision_1, round(p2, 6) AS precision_2,
  round(p3, 6) AS precision_3, round(p4, 6) AS precision_4, round(bp, 6) AS brevity_penalty,
  CAST(np AS BIGINT) AS translation_length, CAST(nr AS BIGINT) AS reference_length FROM whole"""


def _tokens_rouge(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+')"


F1 = """CASE WHEN coalesce({m}, 0) = 0 THEN 0.0
    ELSE 2 * ({m} / {p}) * ({m} / {r}) / ({m} / {p} + {m} / {r}) END"""


def _rouge(n: int) -> str:
    return f"""
WITH {_matches(_tokens_rouge, f'[{n}]', *DOCUMENT_PAIRS)},
hits AS (SELECT id, sum(least(ps, rs)) AS m, sum(ps) AS np, sum(rs) AS nr FROM counted GROUP BY id),
scores AS (SELECT d.doc_id, {F1.format(m='m', p='np', r='nr')} AS f
  FROM documents d LEFT JOIN hits ON hits.id = d.doc_id)
SELECT round(avg(f), 6) AS rouge{n} FROM scores"""


ORACLES["rouge1"] = _rouge(1)
ORACLES["rouge2"] = _rouge(2)
# The prediction is the reference without some words, so it is itself the longest
# common subsequence; tests hold the operator against a table of lengths as well.
ROUGE_ROWS = f"""
WITH {_matches(_tokens_rouge, '[1, 2]', *DOCUMENT_PAIRS)},
hits AS (SELECT id, sum(least(ps, rs)) FILTER (WHERE n = 1) AS m1, sum(least(ps, rs)) FILTER (WHERE n = 2) AS m2
  FROM counted GROUP BY id)
SELECT id AS doc_id, {F1.format(m='m1', p='len(p)', r='len(r)')} AS rouge1,
  {F1.format(m='m2', p='(len(p) - 1)', r='(len(r) - 1)')} AS rouge2,
  {F1.format(m='len(p)', p='len(p)', r='len(r)')} AS rougel
FROM toks LEFT JOIN hits USING (id)"""
ORACLES["rouge_rows"] = f"""
SELECT doc_id, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2, round(rougel, 6) AS rougel FROM ({ROUGE_ROWS})"""
ORACLES["rouge_l"] = f"""
WITH toks AS (SELECT doc_id, len({_tokens_rouge(FIFTH.format('text'))}) AS p, len({_tokens_rouge('text')}) AS r FROM documents)
SELECT doc_id, round({F1.format(m='p', p='p', r='r')}, 6) AS rouge_l FROM toks"""
ORACLES["evaluate_metrics"] = f"""
WITH scored AS ({ROUGE_ROWS})
SELECT 'length_share' AS metric, round(sum(length({FIFTH.format('text')})) / sum(length(text)), 6) AS value FROM documents
UNION ALL SELECT 'rouge1', round(avg(rouge1), 6) FROM scored
UNION ALL SELECT 'rouge2', round(avg(rouge2), 6) FROM scored
UNION ALL SELECT 'rougeL', round(avg(rougel), 6) FROM scored"""
STEPS = "['5e2d', 'bc5b', 'eb71', 'fb24', 'ff10', 'ffd9', 'fffb', 'ffff']"
ORACLES["rouge_bootstrap"] = f"""
WITH scored AS ({ROUGE_ROWS}),
long AS (
  SELECT doc_id, metric, CAST(round(value * 1e9) AS BIGINT) AS units
  FROM (UNPIVOT scored ON rouge1, rouge2, rougel INTO NAME metric VALUE value)),
drawn AS (
  SELECT metric, units, r, substring(md5('5:' || doc_id || ':' || (r // 8)), CAST(4 * (r % 8) + 1 AS BIGINT), 4) AS digits
  FROM long, range(200) AS t(r)),
weighted AS (SELECT metric, units, r, len(list_filter({STEPS}, lambda x: digits >= x)) AS w FROM drawn),
means AS (SELECT metric, r, sum(units * w) / nullif(sum(w), 0) / 1e9 AS f FROM weighted GROUP BY metric, r)
SELECT CASE metric WHEN 'rougel' THEN 'rougeL' ELSE metric END AS metric, round(quantile_cont(f, 0.025), 6) AS low,
  round(quantile_cont(f, 0.5), 6) AS mid, round(quantile_cont(f, 0.975), 6) AS high FROM means GROUP BY metric"""
HALVES = ("documents", "doc_id", f"trim(lower(left(text, length(text) // 2)), {SPACES})",
          f"trim(substring(text, length(text) // 2 + 1), {SPACES})")


def _generated(n: int) -> str:
    return f"""
WITH {_matches(_tokens_rouge, f'[{n}]', *HALVES)},
hits AS (SELECT id, sum(least(ps, rs)) AS m, sum(ps) AS np, sum(rs) AS nr FROM counted GROUP BY id),
scores AS (SELECT d.doc_id, {F1.format(m='m', p='np', r='nr')} AS f FROM documents d LEFT JOIN hits ON hits.id = d.doc_id)
SELECT 'rouge{n}' AS metric, round(avg(f), 6) AS value FROM scores"""


ORACLES["evaluate_generation"] = f"SELECT * FROM ({_generated(1)}) UNION ALL SELECT * FROM ({_generated(2)})"
ORACLES["planned_steps"] = """
SELECT source AS dataset, count(*) AS rows, count(*) // 8 * 3 AS steps FROM documents GROUP BY source"""


def _run_metrics(keys: str) -> str:
    return f"""
WITH {RUNS} SELECT {keys}, max(step) AS last_step, max_by(loss, step) AS last_loss,
  round(avg(loss), 6) AS mean_loss, min(loss) AS min_loss, min(loss) AS best_value,
  min_by(step, (loss, step)) AS best_step FROM runs GROUP BY ALL"""


ORACLES["run_metrics"] = _run_metrics("run")
ORACLES["metrics_append_stream"] = ORACLES["metrics_append"]
ORACLES["run_metrics_stream"] = _run_metrics("run")
ORACLES["run_metrics_by_epoch"] = _run_metrics("run, step // 1000 AS epoch")
ORACLES["latest_checkpoint"] = f"""
WITH {RUNS} SELECT run, 'checkpoint-' || max(step * 100) AS checkpoint, max(step * 100) AS number
FROM runs GROUP BY run"""
ORACLES["run_eta"] = f"""
WITH {RUNS}, ends AS (
  SELECT run, max(step) AS step, CAST(1000000 AS BIGINT) AS total, epoch_us(max(ts)) - epoch_us(min(ts)) AS us
  FROM runs GROUP BY run),
paced AS (SELECT *, CAST(round_even(us / nullif(step, 0), 0) AS BIGINT) * (total - step) // 1000000 AS s FROM ends)
SELECT run, step, total, s AS seconds_left, CASE WHEN s IS NULL THEN 'Unknown' ELSE
  CASE WHEN s >= 172800 THEN s // 86400 || ' days, ' WHEN s >= 86400 THEN '1 day, ' ELSE '' END
  || s % 86400 // 3600 || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0')
  || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS remaining FROM paced"""

# Evaluation preparation and batches
ORACLES["prompt_target"] = f"""
SELECT doc_id, left(text, length(text) // 2) AS prompt,
  trim(substring(text, length(text) // 2 + 1), {SPACES}) AS target FROM documents"""
ORACLES["strip_prompt"] = f"""
SELECT doc_id, trim(substring(text, length(text) // 2 + 1), {SPACES}) AS prediction FROM documents"""
ORACLES["batch_predict"] = """
SELECT doc_id, length(text) || ':' || split_part(text, ' ', 1) AS response FROM documents"""
ORACLES["token_truncate"] = f"""
WITH toks AS (SELECT doc_id, {_words('text')} AS t FROM documents)
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t[1:2048], ' ') AS text FROM toks"""
ORACLES["token_truncate_plugged"] = """
WITH toks AS (SELECT doc_id, regexp_extract_all(text, '[a-z]+') AS t FROM documents)
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t[1:512], ' ') AS text FROM toks"""
BATCHES = f"""
WITH banded AS (SELECT doc_id, n_chars AS length, n_chars // 256 AS band FROM documents),
batched AS (SELECT *, (row_number() OVER (PARTITION BY band ORDER BY {_hash('doc_id', '42')}, doc_id) - 1) // 8 AS batch
  FROM banded)"""
ORACLES["length_batches"] = f"{BATCHES} SELECT doc_id, length, band, batch FROM batched"
ORACLES["length_batches_null"] = f"""
WITH sized AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN
    CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE n_chars * 1000000 END END AS length FROM documents),
banded AS (SELECT *, length // 256 AS band FROM sized)
SELECT *, (row_number() OVER (PARTITION BY band ORDER BY {_hash('doc_id', '42')}, doc_id) - 1) // 8 AS batch FROM banded"""
ORACLES["padding_report"] = f"""{BATCHES}
SELECT band, batch, count(*) AS rows, CAST(sum(length) AS BIGINT) AS tokens, max(length) AS longest,
  CAST(count(*) * max(length) - sum(length) AS BIGINT) AS padding FROM batched GROUP BY band, batch"""

# Mixtures: the entry of a source follows from its number.
KIND = "CAST(source[4:] AS INT) % 8"
SOURCE = f"CASE WHEN {KIND} IN (1, 5) THEN 'huggingface' WHEN {KIND} = 2 THEN 'modelscope' ELSE 'local' END"
PATH = f"CASE WHEN {KIND} IN (1, 2, 5) THEN 'org/' || source WHEN {KIND} IN (3, 7) THEN source || '.txt' ELSE source || '.json' END"
SPLIT = f"CASE WHEN {KIND} = 4 THEN 'validation' ELSE 'train' END"
FORMAT = f"CASE WHEN {KIND} IN (2, 6) THEN 'sharegpt' WHEN {KIND} IN (3, 7) THEN 'text' ELSE 'alpaca' END"
ASKED = "lang || ' ' || doc_id"
ORACLES["mixture_resolve"] = f"""
WITH entries AS (SELECT *, source <> 'src11' AS known, {SOURCE} AS s, {PATH} AS p, {SPLIT} AS sp, {FORMAT} AS f FROM documents)
SELECT doc_id, source AS dataset, known, CASE WHEN known THEN s END AS source, CASE WHEN known THEN p END AS path,
  CASE WHEN known THEN sp END AS split, CASE WHEN known THEN f END AS formatting FROM entries"""
ORACLES["catalogue_defaults"] = f"""
SELECT doc_id, {SOURCE} AS source, {PATH} AS path, {SPLIT} AS split, {FORMAT} AS formatting,
  CASE WHEN {KIND} IN (1, 4) THEN true WHEN {KIND} IN (0, 5) THEN false END AS has_input,
  CASE {KIND} WHEN 0 THEN '{{"prompt":"q","response":"a"}}'
    WHEN 1 THEN '{{"input":"input","instruction":"instruction","output":"output"}}'
    WHEN 2 THEN '{{"images":"images","messages":"messages"}}'
    WHEN 3 THEN '{{"prompt":"text"}}'
    WHEN 4 THEN '{{"prompt":"q","query":"ctx","response":"a"}}'
    WHEN 5 THEN '{{"prompt":"instruction","response":"output","tools":"input"}}'
    WHEN 6 THEN '{{"messages":"conversations"}}'
    ELSE '{{"prompt":"instruction","response":"output"}}' END AS columns,
  CASE {KIND} WHEN 2 THEN '{{"assistant_tag":"assistant","content_tag":"content","role_tag":"role","system_tag":"system","user_tag":"user"}}'
    WHEN 6 THEN '{{"assistant_tag":"gpt","content_tag":"value","role_tag":"from","system_tag":"system","user_tag":"human"}}'
    END AS tags
FROM documents"""
ORACLES["mixture_flags"] = f"""
SELECT doc_id, {KIND} = 5 AS ranking, false AS kto, {KIND} = 2 AS has_images, false AS has_videos,
  false AS has_audios, {KIND} = 5 AS has_tools FROM documents"""
ORACLES["mixture_columns"] = f"""
SELECT doc_id, CASE WHEN {KIND} IN (0, 4) THEN {ASKED} WHEN {KIND} IN (5, 7) THEN {ASKED}
    WHEN {KIND} = 3 THEN text ELSE '' END AS prompt,
  CASE WHEN {KIND} = 4 THEN source ELSE '' END AS query,
  CASE WHEN {KIND} IN (0, 4, 5, 7) THEN text ELSE '' END AS response FROM documents"""
ORACLES["mixture_render"] = f"""
SELECT doc_id, source AS dataset, CASE
  WHEN {KIND} IN (0, 5) THEN {_instruct(ASKED, 'text')}
  WHEN {KIND} IN (1, 4) THEN {_instruct(ASKED, 'text', 'source')}
  WHEN {KIND} = 2 THEN 'User: ' || {ASKED}{GAP}'Assistant: ' || text
  WHEN {KIND} = 6 THEN 'System: ' || source{GAP}'User: ' || {ASKED}{GAP}'Assistant: ' || text
  WHEN {KIND} = 3 THEN text ELSE {ASKED}{GAP}text END AS text
FROM documents"""
ORACLES["mixture_by_type"] = f"""
SELECT doc_id, 'ranking' AS type FROM documents WHERE {KIND} = 5
UNION ALL SELECT doc_id, 'sft' FROM documents WHERE {KIND} <> 5
UNION ALL SELECT doc_id, 'multimodal' FROM documents WHERE {KIND} = 2"""
ORACLES["mixture_search"] = """
SELECT doc_id, source AS dataset FROM documents WHERE contains(lower(source), 'rc1')"""
ORACLES["mixture_summary"] = f"""
WITH typed AS (SELECT source, CASE WHEN {KIND} IN (1, 5) THEN 'hf' ELSE 'local' END AS label,
  {FORMAT} AS formatting, CASE WHEN {KIND} = 5 THEN 'Ranking' ELSE 'SFT' END AS type FROM documents)
SELECT label, formatting, type, count(DISTINCT source) AS datasets, count(*) AS records FROM typed
GROUP BY label, formatting, type"""
DETECTED = """
detected AS (SELECT doc_id, text, source, CASE WHEN doc_id % 9 IN (0, 1) THEN 'sharegpt' WHEN doc_id % 9 IN (2, 3, 8) THEN 'alpaca'
    WHEN doc_id % 9 = 7 THEN 'invalid' ELSE 'text' END AS format,
  CASE doc_id % 9 WHEN 0 THEN '{"messages":"messages","tools":"tools"}'
    WHEN 1 THEN '{"messages":"conversations"}'
    WHEN 2 THEN '{"instruction":"instruction","output":"output"}'
    WHEN 3 THEN '{"instruction":"question","output":"answer","input":"context"}'
    WHEN 4 THEN '{"prompt":"text"}' WHEN 5 THEN '{"prompt":"foo"}' WHEN 6 THEN '{"prompt":"zeta"}'
    WHEN 8 THEN '{"instruction":"prompt","output":"response","system":"system_prompt"}' END AS columns,
  CASE WHEN doc_id % 9 = 0 THEN '{"role_tag":"role","content_tag":"content","user_tag":"user","assistant_tag":"assistant","system_tag":"system"}'
    END AS tags, CAST(to_json(text) AS VARCHAR) AS t, '"' || source || '"' AS s FROM documents)"""
ORACLES["detect_format"] = f"WITH {DETECTED} SELECT doc_id, format, columns, tags FROM detected"
ORACLES["format_samples"] = f"""
WITH {DETECTED}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY format, columns, tags ORDER BY doc_id) AS place FROM detected)
SELECT format, columns, tags, place, doc_id FROM placed WHERE place <= 5"""
ORACLES["detect_refused_lines"] = """
SELECT doc_id, ['sharegpt', 'text', 'text', 'alpaca', 'invalid'][doc_id % 5 + 1] AS format,
  ['{"messages":"conversations","tools":"tools"}', '{"prompt":"text"}', '{"prompt":"zeta"}',
   '{"instruction":"question","output":"answer"}', NULL][doc_id % 5 + 1] AS columns FROM documents"""
ORACLES["detect_format_table"] = """
SELECT doc_id, 'text' AS format, '{"prompt":"body"}' AS columns, NULL AS tags FROM documents"""
ORACLES["format_profile"] = f"""
WITH {DETECTED}, lines AS (SELECT *, CASE doc_id % 9
    WHEN 0 THEN '{{"messages":[{{"role":"user","content":' || t || '}}],"tools":' || s || '}}'
    WHEN 1 THEN '{{"conversations":[{{"from":"user","value":' || t || '}}]}}'
    WHEN 2 THEN '{{"instruction":' || s || ',"output":' || t || '}}'
    WHEN 3 THEN '{{"question":' || s || ',"context":' || s || ',"answer":' || t || '}}'
    WHEN 4 THEN '{{"lang":' || s || ',"text":' || t || '}}'
    WHEN 5 THEN '{{"foo":' || t || '}}'
    WHEN 6 THEN '{{"zeta":' || t || ',"alpha":' || s || '}}'
    WHEN 7 THEN '[' || t || ']'
    ELSE '{{"conversations":[],"system_prompt":' || s || ',"prompt":' || s || ',"response":' || t || '}}' END AS line
  FROM detected)
SELECT format, columns, tags, count(*) AS records, round(count(*) / (SELECT count(*) FROM documents), 6) AS share,
  min(doc_id) = (SELECT min(doc_id) FROM documents) AS like_first, min(doc_id) AS first_key,
  min_by(line, doc_id) AS first_record
FROM lines GROUP BY format, columns, tags"""
