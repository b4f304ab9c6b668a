"""Preference, feedback, media, role, loss and history records."""

import pytest
from pyspark.sql import functions as F

from mixloom.operators import records


def test_preference_pairs_from_strings_and_messages(spark):
    strings = spark.createDataFrame([("p", "c", "r")], "instruction string, chosen string, rejected string")
    assert tuple(records.preference_pairs(strings).first()) == ("p", "c", "r")
    message = "struct<`from`:string,value:string>"
    messages = spark.createDataFrame([("p", ("gpt", "c"), ("gpt", "r"))], f"q string, w {message}, l {message}")
    assert tuple(records.preference_pairs(messages, "q", "w", "l").first()) == ("p", "c", "r")


def test_preference_messages(spark):
    blocks = lambda t: [("text", t)]
    prompt = [("system", blocks("s"), 0.0), ("user", blocks("u"), 0.0)]
    other = [("system", blocks("s"), 0.0), ("user", blocks("v"), 0.0)]
    last = lambda t: ("assistant", blocks(t), 1.0)
    schema = "array<struct<role:string,content:array<struct<type:string,value:string>>,loss_weight:double>>"
    df = spark.createDataFrame(
        [(0, prompt + [last("c")], prompt + [last("r")]), (1, prompt + [last("c")], other + [last("r")]), (2, [], [])],
        f"id int, chosen_messages {schema}, rejected_messages {schema}",
    )
    rows = records.preference_messages(df, keep=("id",)).orderBy("id").collect()
    assert [(r["chosen"], r["rejected"], r["same_prompt"]) for r in rows[:2]] == [("c", "r", True), ("c", "r", False)]
    assert [m["role"] for m in rows[0]["prompt_messages"]] == ["system", "user"]
    assert rows[2]["prompt_messages"] == []


def test_feedback_label_is_boolean(spark):
    df = spark.createDataFrame([("p", "c", 1), ("p", "c", 0)], "p string, c string, kto_tag int")
    assert [r["label"] for r in records.feedback_rows(df, "p", "c").collect()] == [True, False]


def test_check_media(spark):
    schema = "conversations array<struct<`from`:string,value:string>>, images array<string>, videos array<string>"
    df = spark.createDataFrame([
        ([("human", "<image>a<image>"), ("gpt", "b<video>")], ["1", "2"], ["v"]),
        ([("human", "<image><image>")], ["1"], None),
        (None, None, None),
    ], schema)
    rows = records.check_media(df).collect()
    assert [r["media_ok"] for r in rows] == [True, False, True]
    assert (rows[1]["images_tokens"], rows[1]["images_paths"]) == (2, 1)


ROLES = [
    (["human", "gpt"], True, None),
    (["system", "human", "gpt"], True, None),
    (["human", "function_call", "observation", "gpt"], True, None),
    (["human", "human"], False, 2),
    (["system", "gpt"], False, 1),
    (["human", "gpt", "system"], False, 3),
    (["human", "critic"], False, 2),
    ([], True, None),
]


def test_check_roles(spark):
    df = spark.createDataFrame(
        [(i, [(r, "x") for r in roles]) for i, (roles, *_) in enumerate(ROLES)] + [(99, None)],
        "id int, conversations array<struct<`from`:string,value:string>>",
    )
    rows = {r["id"]: (r["roles_ok"], r["first_bad"]) for r in records.check_roles(df).collect()}
    assert rows.pop(99) == (None, None)
    assert list(rows.values()) == [tuple(expected) for _, *expected in ROLES]


def test_check_turn_roles_agrees(spark):
    turns = spark.createDataFrame(
        [(i, t, r) for i, (roles, *_) in enumerate(ROLES) for t, r in enumerate(roles)], "id int, turn int, role string"
    )
    rows = {r["id"]: (r["roles_ok"], r["first_bad"]) for r in records.check_turn_roles(turns, "id", "turn").collect()}
    assert rows == {i: tuple(e) for i, (roles, *e) in enumerate(ROLES) if roles}


def test_check_required(spark):
    df = spark.createDataFrame([("a", "b", []), (None, "  ", None)], "instruction string, output string, messages array<string>")
    rows = records.check_required(df, ("instruction", "output", "messages", "label")).collect()
    assert [r["reasons"] for r in rows] == [
        ["missing label"], ["missing instruction", "missing output", "missing messages", "missing label"]
    ]


def test_loss_mask(spark):
    df = spark.createDataFrame(
        [([("user", "a", None), ("assistant", "b", None), ("assistant", "c", 0.25), (None, "d", None)],)],
        "messages array<struct<role:string,content:string,loss_weight:double>>",
    )
    assert [r["loss_weight"] for r in records.loss_mask(df).orderBy("pos").collect()] == [0.0, 1.0, 0.25, 0.0]
    bare = df.select(F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
    assert [r["loss_weight"] for r in records.loss_mask(bare).orderBy("pos").collect()] == [0.0, 1.0, 1.0, 0.0]


@pytest.mark.parametrize("history, system, input, expected", [
    ([["h1", "r1"], ["h2", "r2"]], "s", "in",
     [("system", "s"), ("user", "h1"), ("assistant", "r1"), ("user", "h2"), ("assistant", "r2"),
      ("user", "do\nin"), ("assistant", "ok")]),
    (None, None, "", [("user", "do"), ("assistant", "ok")]),
    ([], "", None, [("user", "do"), ("assistant", "ok")]),
])
def test_history(spark, history, system, input, expected):
    df = spark.createDataFrame([("do", input, "ok", history, system)],
                               "instruction string, input string, output string, history array<array<string>>, system string")
    row = records.expand_history(df, input="input", system="system").first()
    assert [tuple(m) for m in row["messages"]] == expected
