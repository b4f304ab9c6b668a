"""Rendering: templates, column choices, nulls, chat tags and content shapes."""

import pytest
from pyspark.sql import functions as F, types as T

from mixloom.functions.content import flatten_content
from mixloom.functions.text import json_text, strip, tokens_13a, tokens_rouge, words
from mixloom.operators import records, render

HEAD = (
    "Below is an instruction that describes a task. "
    "Write a response that appropriately completes the request.\n\n"
)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]["text"]


def table(spark, row, schema):
    return spark.createDataFrame([row], schema)


def test_template_with_input_keeps_an_empty_section(spark):
    df = table(spark, ("do", "", "done"), "instruction string, input string, output string")
    assert one(render.render_instruction(df)) == (
        HEAD + "### Instruction:\ndo\n\n### Input:\n\n\n### Response:\ndone"
    )


def test_template_without_input(spark):
    df = table(spark, ("do", "x", "done"), "instruction string, input string, output string")
    columns = {"instruction": "instruction", "output": "output"}
    assert one(render.render_instruction(df, columns)) == HEAD + "### Instruction:\ndo\n\n### Response:\ndone"


def test_input_field_alone_chooses_the_template_but_fills_nothing(spark):
    df = table(spark, ("do", "x", "done"), "instruction string, input string, output string")
    columns = {"instruction": "instruction", "output": "output"}
    text = one(render.render_instruction(df, columns, input_field=True))
    assert "### Input:\n\n\n### Response:" in text


@pytest.mark.parametrize("value, expected", [("", "Instruction: do\nResponse: ok"),
                                             ("in", "Instruction: do\nInput: in\nResponse: ok")])
def test_plain_form_leaves_out_an_empty_input(spark, value, expected):
    df = table(spark, ("do", value, "ok"), "instruction string, input string, output string")
    assert one(render.render_instruction(df, plain=True)) == expected


def test_null_output_is_empty_or_the_parity_word(spark):
    df = table(spark, ("a", None), "instruction string, output string")
    columns = {"instruction": "instruction", "output": "output"}
    assert one(render.render_instruction(df, columns)).endswith("### Response:\n")
    assert one(render.render_instruction(df, columns, null_text="None")).endswith("### Response:\nNone")


def test_prompt_and_response_map_to_the_slots_unless_strict(spark):
    df = table(spark, ("ask", "tell"), "q string, a string")
    columns = {"prompt": "q", "response": "a"}
    assert one(render.render_instruction(df, columns)) == HEAD + "### Instruction:\nask\n\n### Response:\ntell"
    strict = one(render.render_instruction(df, columns, strict_columns=True))
    assert strict == HEAD + "### Instruction:\n\n\n### Response:\ntell"


def test_absent_output_falls_back_to_response(spark):
    df = table(spark, ("do", "", "said"), "instruction string, input string, response string")
    assert one(render.render_instruction(df)).endswith("### Response:\nsaid")
    both = table(spark, ("do", "", None, "said"), "instruction string, input string, output string, response string")
    assert one(render.render_instruction(both)).endswith("### Response:\n")
    neither = table(spark, ("do",), "instruction string")
    assert one(render.render_instruction(neither, {"instruction": "instruction"})).endswith("### Response:\n")


def test_user_template_ignores_braces_in_values(spark):
    df = table(spark, ("{x}", "I am {{name}} {x}"), "i string, o string")
    assert one(render.render_template(df, "{{{instruction}}} > {output}{input}", "i", "o")) == (
        "{{x}} > I am {{name}} {x}"
    )


def test_unknown_slot_raises(spark):
    df = table(spark, ("a", "b"), "i string, o string")
    with pytest.raises(KeyError):
        render.render_template(df, "{foo}", "i", "o")


def test_missing_template_field_renders_empty(spark):
    df = table(spark, ("a",), "i string")
    assert one(render.render_template(df, "{instruction}|{output}", "i", "gone")) == "a|"


def test_project_text_needs_its_column(spark):
    df = table(spark, ("a", "b"), "body string, other string")
    assert render.project_text(df, "body").columns == ["text"]
    with pytest.raises(ValueError, match="missing"):
        render.project_text(df, "missing")


def test_text_pair(spark):
    df = table(spark, ("p", None), "p string, r string")
    assert one(render.format_text(df, "p", "r")) == "p\n\n"
    assert one(render.format_text(df, "p", "r", null_text="None")) == "p\n\nNone"


CHAT = "conversations array<struct<`from`:string, value:string>>"


def test_chat_default_tags_and_dropped_roles(spark):
    messages = [("system", "s"), ("human", "h"), ("function_call", "f"), ("observation", "o"), ("gpt", "g"), (None, "n")]
    df = table(spark, (messages,), CHAT)
    assert one(render.render_chat(df)) == "System: s\n\nUser: h\n\nAssistant: g"


def test_chat_null_and_empty(spark):
    assert one(render.render_chat(table(spark, (None,), CHAT))) is None
    assert one(render.render_chat(table(spark, ([],), CHAT))) == ""
    assert one(render.render_chat(table(spark, ([("human", None)],), CHAT))) == "User: "
    assert one(render.render_chat(table(spark, ([("human", None)],), CHAT), null_text="None")) == "User: None"


def test_chat_roles_are_tested_system_first(spark):
    df = table(spark, ([("x", "1")],), CHAT)
    assert one(render.render_chat(df, tags={"system_tag": "x", "user_tag": "x"})) == "System: 1"
    assert one(render.render_chat(df, tags={"assistant_tag": "x", "user_tag": "x"})) == "User: 1"


def test_chat_partial_tags_keep_the_other_defaults(spark):
    df = table(spark, ([("me", "1"), ("gpt", "2")],), "m array<struct<who:string, value:string>>")
    tags = {"role_tag": "who", "user_tag": "me"}
    assert one(render.render_chat(df, "m", tags)) == "User: 1\n\nAssistant: 2"


def test_variant_chat_equals_typed_chat(spark):
    text = '[{"from":"human","value":[{"type":"text","value":"A"},"B",{"text":"C"},{"image":"x"}]},"skip",{"from":"gpt","value":"D"}]'
    df = spark.createDataFrame([(text,)], "t string").select(F.parse_json("t").alias("conversations"))
    assert one(render.render_chat(df)) == "User: A\nB\nC\n\nAssistant: D"


@pytest.mark.parametrize("json, expected", [
    ('"plain"', "plain"),
    ('["a","b"]', "a\nb"),
    ('[{"type":"text","value":"A"},"B",{"text":"C"},{"image":"x"}]', "A\nB\nC"),
    ('[{"value":5,"text":"t"}]', "t"),
    ('[{"image":"x"}]', '[{"image":"x"}]'),
    ('[]', "[]"),
    ('{"a":1}', '{"a":1}'),
    ('7', "7"),
    ('null', ""),
    ('"null"', "null"),
    ('["", "x"]', "\nx"),
])
def test_variant_content(spark, json, expected):
    df = spark.createDataFrame([(json,)], "t string").select(F.parse_json("t").alias("c"))
    assert one(df.select(flatten_content(F.col("c"), T.VariantType()).alias("text"))) == expected


@pytest.mark.parametrize("schema, value, expected", [
    ("string", "x", "x"),
    ("string", None, ""),
    ("array<string>", ["a", None, "b"], "a\nb"),
    ("array<struct<type:string,value:string,text:string>>", [("t", None, "x"), ("t", "y", "z")], "x\ny"),
    ("array<struct<value:int,text:string>>", [(5, "t")], "t"),
    ("array<struct<image:string>>", [("p",)], '[{"image":"p"}]'),
    ("boolean", True, "true"),
])
def test_typed_content(spark, schema, value, expected):
    df = table(spark, (value,), f"c {schema}")
    assert one(df.select(flatten_content(F.col("c"), df.schema["c"].dataType).alias("text"))) == expected


TURNS = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "tool", "t")]
TAGS = {"user_tag": "user", "assistant_tag": "assistant"}


def test_turns_render_like_assembled_messages(spark):
    turns = spark.createDataFrame(TURNS, "conv bigint, turn bigint, role string, text string")
    flat = render.render_turns(turns, "conv", "turn", tags=TAGS).orderBy("conv").collect()
    nested = render.render_chat(
        render.assemble_turns(turns, "conv", "turn"), "messages",
        {**TAGS, "role_tag": "role", "content_tag": "content"}, keep=("conv",),
    ).orderBy("conv").collect()
    assert [tuple(r) for r in flat] == [tuple(r) for r in nested]
    assert [r["text"] for r in flat] == ["User: a\n\nAssistant: b\n\nUser: c", ""]


@pytest.mark.parametrize("chunk", [3, 10])
def test_chunks_change_no_conversation(spark, chunk):
    turns = spark.range(25).selectExpr(
        "1 as conv", "id as turn", "if(id = 0, 'system', if(id % 2 = 1, 'user', 'assistant')) as role",
        "cast(id as string) as text",
    ).repartition(5)
    whole = render.render_turns(turns, "conv", "turn", tags=TAGS).collect()
    assert [tuple(r) for r in render.render_turns(turns, "conv", "turn", tags=TAGS, chunk_turns=chunk).collect()] == [
        tuple(r) for r in whole
    ]
    nested = render.assemble_turns(turns, "conv", "turn", chunk_turns=chunk)
    assert [m["content"] for m in nested.first()["messages"]] == [str(i) for i in range(25)]
    tags = {**TAGS, "role_tag": "role", "content_tag": "content"}
    assert records.check_roles(nested, "messages", tags).first()["roles_ok"]


@pytest.mark.parametrize("raw", ["\t x \n", " x ", "x", "", " \x1f ", "a　b "])
def test_strip_and_words_match_python(spark, raw):
    row = table(spark, (raw,), "t string").select(
        strip(F.col("t")).alias("s"), words(F.col("t")).alias("w")
    ).first()
    assert row["s"] == raw.strip()
    assert row["w"] == raw.split()


def test_tokenisers(spark):
    row = table(spark, ("He said: \"1,000.5 &amp; 3-4\" it's\nend.",), "t string").select(
        tokens_13a(F.col("t")).alias("b"), tokens_rouge(F.col("t")).alias("r")
    ).first()
    assert row["b"] == ["He", "said", ":", '"', "1,000.5", "&", "3", "-", "4", '"', "it's", "end", "."]
    assert row["r"] == ["he", "said", "1", "000", "5", "amp", "3", "4", "it", "s", "end"]


def test_json_text_matches_python(spark):
    import json
    df = spark.createDataFrame(
        [(1, 'é "q"\n', None, [("x", 2.5)], True)],
        "a int, b string, c string, d array<struct<k:string,v:double>>, e boolean",
    )
    got = one(df.select(json_text(F.struct("*"), df.schema).alias("text")))
    assert got == json.dumps(
        {"a": 1, "b": 'é "q"\n', "c": None, "d": [{"k": "x", "v": 2.5}], "e": True}, ensure_ascii=False
    )
