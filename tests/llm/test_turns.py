"""Repaired conversations against a plain search over all edits."""

import hashlib
import zlib
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from mixloom.llm import turns as t

WHITE = " \t\n\x0b\x0c\r"


def step(state, letter):
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, letter))


def plain_cost(rows):
    """Least cost and least audit by a table over rows and states, right to left."""
    after = {"": 0, "a": 0, "s": 4, "u": 2}
    audits = {"": "", "a": "", "s": "II", "u": "I"}
    lines = {"": (), "a": (), "s": ("user:", "assistant:"), "u": ("assistant:",)}
    for role, text, fault in reversed(rows):
        late, now = int(fault == "truncated"), {}
        for q in ("", "s", "u", "a"):
            options = [(3 + after[q], "D" + audits[q], lines[q])]
            if fault not in ("blank", "duplicate"):
                for cost, edit, own in ((0, "K", role), (2, "R", "user"), (2, "R", "assistant")):
                    to = step(q, own[:1])
                    if to is not None:
                        options.append((cost + late + after[to], edit + audits[to], (f"{own}:{text}", *lines[to])))
            now[q] = min(options, key=lambda o: o[:2])
        for _ in range(3):
            for q in ("", "s", "u", "a"):
                for own in ("user", "assistant"):
                    to = step(q, own[0])
                    if to is not None:
                        c, a, l = now[to]
                        now[q] = min(now[q], (c + 2, "I" + a, (f"{own}:", *l)), key=lambda o: o[:2])
        after, audits, lines = ({q: now[q][i] for q in now} for i in range(3))
    return after[""], audits[""], lines[""]


def every_edit(rows):
    """Least (cost, audit) over all strings of edits that fit."""
    found = []
    for size in range(len(rows), len(rows) + 4):
        for edits in product("DIKR", repeat=size):
            at, state, cost = 0, "", 0
            for edit in edits:
                if edit == "I":
                    state, cost = {"": "u", "s": "u", "u": "a", "a": "u"}[state], cost + 2
                    continue
                if at == len(rows):
                    break
                role, _, fault = rows[at]
                at += 1
                if edit == "D":
                    cost += 3
                    continue
                state = step(state, role[:1]) if edit == "K" else {"": "u", "s": "u", "u": "a", "a": "u"}[state]
                cost += (edit == "R") * 2 + (fault == "truncated")
                if fault == "blank" or state is None:
                    break
            else:
                if at == len(rows) and state in ("", "a"):
                    found.append((cost, "".join(edits)))
    return min(found)


def report(conversations, damaged=True):
    """The contract's rows, conversation by conversation."""
    kept = {}
    for conv, turn, role, text in conversations:
        rows = kept.setdefault(conv, [])
        sp = lambda x: " " if x is None else x
        role, text = sp(role), sp(text)
        kind = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20 if damaged else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        role = "user" if kind == 4 else role
        rows += [(turn, role, text)] * (2 if kind == 3 else 1)
    found = {}
    for conv, rows in kept.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, marked, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rows:
            trimmed = text.strip(WHITE)
            fault = "blank" if not trimmed else "duplicate" if (role, text) in seen else None if trimmed[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
            if fault:
                faults[fault] += 1
        numbers = {r[0] for r in rows if r[0] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        letters = [m[0][:1] for m in marked]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        cost, audit, lines = plain_cost(marked)
        found[conv] = (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def reports(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=14), st.integers(1, 4), st.integers(0, 14))
def test_tables_give_the_least_edits(symbols, size, cut):
    rows = [("sua?"[s // 2], "x", "truncated" if s % 2 else None) if s < 8 else ("u", "", "blank") for s in symbols]
    blocks, symbols = t.tables(size), np.array(symbols, dtype=np.int64)
    made, states = blocks.trace(symbols, 0, t.START)
    audit = "".join(made) + "I" * len(t._closing(states[-1]))
    assert audit == plain_cost(rows)[1]
    # The same in two stretches linked by their functions.
    left, right = symbols[:cut], symbols[cut:]
    between = blocks.function(right)[0][0]
    state = blocks.function(left)[1][between * 4 + t.START]
    first, _ = blocks.trace(left, between, t.START)
    second, _ = blocks.trace(right, 0, state)
    assert first + second == made


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 8), max_size=4))
def test_plain_counterpart_is_the_least_of_all(symbols):
    rows = [("sua?"[s // 2], "x", "truncated" if s % 2 else None) if s < 8 else ("u", "", "blank") for s in symbols]
    assert plain_cost(rows)[:2] == every_edit(rows)


ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Hello!"), (1, 3, "assistant", "Hello!"),
    (2, 0, "assistant", "no end"), (2, 5, "tool", "x."), (2, None, "user", "first."), (2, 2, None, "y."),
    (3, None, None, None), (3, None, "user", " \t\n"), (None, 1, "user", "a b."), (None, None, "assistant", "c."),
    (4, 7, "", "Odd role."), (4, 8, "user", "x" * 300_000), (4, 9, "User", "漢字."), (5, 0, "user", "Q?"),
    (5, 0, "user", "Q?"), (5, 0, "assistant", "A."), (5, 1, "system", "late."),
] + [(conv, turn, role, f"{role} {turn % 3}.") for conv in range(10, 60) for turn, role in enumerate(
    ["user", "assistant", "system", "user", "user", "assistant", "assistant"][: 2 + conv % 6])]


@pytest.mark.parametrize("damaged, piece", [(True, 100_000), (False, 100_000), (True, 9), (False, 2)])
def test_equal_to_plain_repair(spark, damaged, piece):
    rows = [(*r, "z", 1) for r in ROWS]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, name string, _at int")
    df = t.damage(conversations) if damaged else conversations
    repaired = t.repair_turns(df, piece_rows=piece)
    assert reports(t.conversation_reports(repaired, conversations)) == report(ROWS, damaged)


def test_one_conversation_over_many_pieces(spark):
    rows = [(7, i // 2, ["user", "assistant", "assistant", "tool", "user"][i * i % 5], f"text {i % 40}" + "." * (i % 3)) for i in range(400)]
    rows += [(8, 1, "user", "same.")] * 60 + [(9, 0, "user", "Q."), (9, 1, "assistant", "A.")]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    repaired = t.repair_turns(conversations, piece_rows=20)
    assert repaired.select("_piece").distinct().count() > 10
    assert reports(t.conversation_reports(repaired, conversations)) == report(rows, False)


def test_repaired_rows_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    conversations = spark.createDataFrame([(1, 0, "assistant", "A."), (1, 1, "tool", "B.")], schema)
    rows = t.repair_turns(conversations).orderBy("turn").collect()
    assert [(r["edits"], r["repaired_role"], r["lines"], r["cost"]) for r in rows] == [
        ("R", "user", ["user:A."], 2), ("R", "assistant", ["assistant:B."], 2)]
    none = conversations.limit(0)
    assert t.repair_turns(t.damage(none)).collect() == []
    assert t.conversation_reports(t.repair_turns(none), none).collect() == []
    gone = reports(t.conversation_reports(t.repair_turns(none), conversations))
    assert gone == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
