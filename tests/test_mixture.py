"""Mixtures joined with the catalogue, and format detection."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mixloom.operators import mixture, profile
from mixloom.sources import mixtures
from mixloom.sources.catalogue import catalogue_table, of_type

ENTRIES = {
    "ask": {"file_name": "a.json", "columns": {"prompt": "q", "response": "a"}},
    "full": {"hf_hub_url": "o/full"},
    "chat": {"ms_hub_url": "o/chat", "formatting": "sharegpt", "columns": {"messages": "m", "images": "i"},
             "tags": {"role_tag": "r", "content_tag": "c", "user_tag": "u", "assistant_tag": "b"}},
    "plain": {"file_name": "p.jsonl", "columns": {"prompt": "body"}},
    "pref_1%": {"hf_hub_url": "o/pref", "ranking": True, "columns": {"prompt": "q", "chosen": "w", "rejected": "l"}},
}
RECORDS = [
    (0, "ask", {"q": "Q", "a": "A"}),
    (1, "ask", {"q": None}),
    (2, "full", {"instruction": "I", "input": "", "output": True}),
    (3, "full", {"instruction": "{x}", "response": "R"}),
    (4, "chat", {"m": [{"r": "u", "c": ["x", {"text": "y"}]}, {"r": "zz", "c": "no"}, {"r": "b", "c": 5}]}),
    (5, "chat", {"m": []}),
    (6, "chat", {"n": 1}),
    (7, "plain", {"body": "B"}),
    (8, "pref_1%", {"q": "Q", "w": "W", "l": "L"}),
]


def records(spark, rows=RECORDS):
    lines = [(i, name, json.dumps(r)) for i, name, r in rows]
    return spark.createDataFrame(lines, "id int, dataset string, line string").select(
        "id", "dataset", F.parse_json("line").alias("record")
    )


def rendered(spark, **options):
    strict = options.get("strict_columns", False)
    whole = mixture.resolve_mixture(records(spark), catalogue_table(spark, ENTRIES), strict_columns=strict)
    return {r["id"]: r["text"] for r in mixture.render_mixture(whole, keep=("id",), **options).collect()}


def test_render_mixture(spark):
    texts = rendered(spark)
    assert texts[0].endswith("### Instruction:\nQ\n\n### Response:\nA")
    assert texts[1].endswith("### Instruction:\n\n\n### Response:\n")
    assert texts[2].endswith("### Input:\n\n\n### Response:\ntrue")
    assert texts[3].endswith("### Instruction:\n{x}\n\n### Input:\n\n\n### Response:\nR")
    assert texts[4] == "User: x\ny\n\nAssistant: 5"
    assert texts[5] == "" and texts[6] is None
    assert texts[7] == "B"


def test_render_mixture_parity(spark):
    texts = rendered(spark, null_text="None", strict_columns=True)
    assert texts[0].endswith("### Instruction:\n\n\n### Response:\nA")
    assert texts[7].endswith("### Instruction:\n\n\n### Response:\n")
    assert rendered(spark, null_text="None")[1].endswith("### Instruction:\nNone\n\n### Response:\n")


def test_unknown_datasets(spark):
    odd = records(spark, RECORDS + [(9, "lost", {}), (10, "gone", {})])
    with pytest.raises(ValueError, match="gone, lost"):
        mixture.resolve_mixture(odd, catalogue_table(spark, ENTRIES))
    kept = mixture.resolve_mixture(odd, catalogue_table(spark, ENTRIES), unknown="quarantine")
    assert {r["id"] for r in kept.filter("not known").collect()} == {9, 10}
    assert kept.count() == 11


def test_mapped_columns(spark):
    whole = mixture.resolve_mixture(records(spark), catalogue_table(spark, ENTRIES)).select("id", "record", "columns")
    rows = {r["id"]: (r["prompt"], r["chosen"]) for r in
            mixture.with_mapped_columns(whole, ("prompt", "chosen")).collect()}
    assert rows[0] == ("Q", "") and rows[8] == ("Q", "W") and rows[4] == ("", "")


@pytest.mark.parametrize("kind, ids", [("ranking", {8}), ("sft", set(range(8))), ("multimodal", {4, 5, 6})])
def test_keep_type(spark, kind, ids):
    kept = mixture.keep_type(records(spark), catalogue_table(spark, ENTRIES), kind)
    assert {r["id"] for r in kept.collect()} == ids
    with pytest.raises(ValueError):
        of_type(catalogue_table(spark, ENTRIES), "other")


@pytest.mark.parametrize("term, names", [("A", {"ask", "chat", "plain"}), ("_", {"pref_1%"}), ("%", {"pref_1%"}), (".", set())])
def test_keep_named_is_literal(spark, term, names):
    assert {r["dataset"] for r in mixture.keep_named(records(spark), term).collect()} == names


def test_summary(spark):
    rows = mixture.mixture_summary(records(spark), catalogue_table(spark, ENTRIES)).collect()
    assert {(r["label"], r["formatting"], r["type"]): (r["datasets"], r["records"]) for r in rows} == {
        ("local", "alpaca", "SFT"): (1, 2), ("hf", "alpaca", "SFT"): (1, 2), ("local", "sharegpt", "SFT"): (1, 3),
        ("local", "text", "SFT"): (1, 1), ("hf", "alpaca", "Ranking"): (1, 1),
    }


OPENAI = '{"role_tag":"role","content_tag":"content","user_tag":"user","assistant_tag":"assistant","system_tag":"system"}'
SHAPES = [
    ('{"messages":[{"role":"user","content":"x"}],"instruction":"i","output":"o"}', "sharegpt", '{"messages":"messages"}', OPENAI),
    ('{"images":["p"],"conversations":[{"from":"human","value":"x"}],"tools":"t"}', "sharegpt",
     '{"messages":"conversations","tools":"tools","images":"images"}', None),
    ('{"conversations":["s",{"from":"human","value":"x"}]}', "sharegpt", '{"messages":"conversations"}', None),
    ('{"messages":[{"who":"x"}],"conversations":[{"from":"a","value":"b"}]}', "sharegpt", '{"messages":"conversations"}', None),
    ('{"messages":[{"from":"a","value":"b","role":"c","content":"d"}]}', "sharegpt", '{"messages":"messages"}', None),
    ('{"conversations":[],"prompt":"p","response":"r"}', "alpaca", '{"instruction":"prompt","output":"response"}', None),
    ('{"messages":"text","question":"q","answer":"a"}', "alpaca", '{"instruction":"question","output":"answer"}', None),
    ('{"target":"t","completion":"c","query":"q","prompt":"p","context":"x","system_prompt":"s"}', "alpaca",
     '{"instruction":"prompt","output":"completion","input":"context","system":"system_prompt"}', None),
    ('{"instruction":"i","text":"t"}', "text", '{"prompt":"text"}', None),
    ('{"body":"b","content":"c"}', "text", '{"prompt":"content"}', None),
    ('{"foo":1}', "text", '{"prompt":"foo"}', None),
    ('{"zeta":1,"alpha":2}', "text", '{"prompt":"zeta"}', None),
    ('[1,2]', "invalid", None, None),
    ('"x"', "invalid", None, None),
    ('{}', "invalid", None, None),
    ('{"a":', "invalid", None, None),
]


def lines(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id int, value string")


def test_detect_format(spark):
    found = profile.detect_format(lines(spark, [s[0] for s in SHAPES] + ["", "  \t"]), keep=("id",)).orderBy("id").collect()
    assert [(r["format"], r["columns"], r["tags"]) for r in found] == [s[1:] for s in SHAPES]


@pytest.mark.parametrize("line, found, columns", [
    ('{"messages":[{"role":"user","content":"x"}],"a":1,"a":2}', "sharegpt", '{"messages":"messages"}'),
    ('{"messages":3,"messages":["s",{"from":"h","value":NaN}]}', "sharegpt", '{"messages":"messages"}'),
    ('{"messages":[{"role":"u","content":"x"}],"messages":4}', "text", '{"prompt":"messages"}'),
    ('{"z":Infinity,"b":[1,{"c":-Infinity}]}', "text", '{"prompt":"z"}'),
    ('{"instruction":NaN,"output":"x","output":"y"}', "alpaca", '{"instruction":"instruction","output":"output"}'),
    ('{"text":NaN}', "text", '{"prompt":"text"}'),
    *[(line, "invalid", None) for line in (
        '{"a":1,"a":2} x', '{"a":1,"a":2}{"b":1}', '{"a":NaN},{"b":1}', "{'a':1}", '{"a":NaN', '[{"a":NaN}]', "NaN", '{"a":nan}'
    )],
])
def test_lines_the_parsed_form_refuses(spark, line, found, columns):
    row = profile.detect_format(lines(spark, [line])).first()
    assert (row["format"], row["columns"]) == (found, columns)


def test_require_valid(spark):
    detected = profile.detect_format(lines(spark, ["[1]"]))
    with pytest.raises(PySparkException, match="no JSON object"):
        profile.require_valid(detected).collect()


def test_format_profile(spark):
    values = ['{"text":"a"}', '{"q":1,"z":2}', '{"text":"b"}', '{"text":"c"}']
    rows = {r["columns"]: r for r in profile.format_profile(lines(spark, values), "id").collect()}
    text = rows['{"prompt":"text"}']
    assert (text["records"], text["share"], text["like_first"], text["first_record"]) == (3, 0.75, True, '{"text":"a"}')
    assert not rows['{"prompt":"q"}']["like_first"]


def test_preview(spark):
    df = spark.createDataFrame([(i, "é" * 600) for i in range(8)], "id int, t string")
    rows = profile.preview(df, "id").orderBy("id").collect()
    assert [r["id"] for r in rows] == [0, 1, 2, 3, 4]
    assert rows[0]["record"] == json.dumps({"id": 0, "t": "é" * 600}, ensure_ascii=False)[:500]


def test_scans_do_not_grow_with_entries(spark, tmp_path):
    entries = {}
    for i in range(1_000):
        kind = ("jsonl", "txt")[i % 2]
        text = f"line {i} a\nline {i} b\n" if kind == "txt" else "".join('{"text": "%s"}\n' % f"json {i} {c}" for c in "abc")
        (tmp_path / f"e {i}.{kind}").write_text(text)
        entries[f"n{i}"] = {"file_name": f"e {i}.{kind}"} | ({"num_samples": 1 + i % 3} if i % 5 == 0 else {})
    entries["again"] = {"file_name": "e 1.txt"}
    rows = mixtures.load_mixture(spark, entries, root=str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 4
    found = {}
    for r in rows.select("dataset", F.variant_get("record", "$.text", "string").alias("text")).collect():
        found.setdefault(r["dataset"], []).append(r["text"])
    want = {"again": ["line 1 a", "line 1 b"]}
    for i in range(1_000):
        all_rows = [f"line {i} {c}" for c in "ab"] if i % 2 else [f"json {i} {c}" for c in "abc"]
        want[f"n{i}"] = all_rows[: 1 + i % 3] if i % 5 == 0 else all_rows
    assert {k: sorted(v) for k, v in found.items()} == want
    keyed = mixtures.load_mixture(spark, entries, root=str(tmp_path), row_ids=True)
    ordered = [(r["dataset"], r["text"]) for r in keyed.select(
        "dataset", "_id", F.variant_get("record", "$.text", "string").alias("text")).orderBy("_id").collect()]
    assert ordered == [(name, text) for name in entries for text in want[name]]
