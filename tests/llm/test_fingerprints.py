"""Recovered differences and edited texts against plain sets."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from mixloom.llm import fingerprints


def paragraphs(text):
    lines = [x.strip(" \t\x0b\x0c\r") for x in (text or "").split("\n")]
    n = fingerprints.PARAGRAPH_CHARS
    return {x[i : i + n] for x in lines for i in range(0, len(x), n)}


def like(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


@pytest.mark.parametrize("bucket, cells", [(256, 8), (8, 1)])
def test_peeling_recovers_every_difference(spark, monkeypatch, bucket, cells):
    monkeypatch.setattr(fingerprints, "BUCKET_DIGESTS", bucket)
    monkeypatch.setattr(fingerprints, "LEAST_CELLS", cells)
    rnd = random.Random(0)
    rows = []
    for size in (0, 1, 2, 5, 30, 300):
        for other in (0, 1, 7, 60):
            common = [rnd.getrandbits(62) for _ in range(size)]
            rows.append((common + [rnd.getrandbits(62) for _ in range(other)], common + [rnd.getrandbits(62) for _ in range(other // 2)]))
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    found = df.select("a", "b", fingerprints.differing_digests(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r["n"] == len(set(r["a"]) ^ set(r["b"])) for r in found)


def test_a_difference_that_is_not_peeled_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ATTEMPTS", 1)
    monkeypatch.setattr(fingerprints, "ROUNDS", 1)
    df = spark.createDataFrame([(list(range(100)), [])], "a array<bigint>, b array<bigint>")
    with pytest.raises(Exception, match="not peeled"):
        df.select(fingerprints.differing_digests(F.col("a"), F.col("b"))).collect()


def test_documents_equal_plain_sets(spark):
    rnd = random.Random(1)
    line = lambda: "".join(rnd.choice("abcdé 漢") for _ in range(rnd.choice([0, 3, 40, 700])))
    rows = [(i * 3, "\n".join(line() for _ in range(rnd.randint(0, 12)))) for i in range(40)]
    rows += [(500, None), (501, ""), (502, " \n\t"), (503, rows[4][1]), (504, rows[4][1])]
    docs = spark.createDataFrame([(*r, "x") for r in rows + rows[:2]], "doc_id long, text string, fingerprint string")
    returned = fingerprints.edited_fingerprints(docs).collect()
    # Every row has its result, also those alike in id and text.
    assert sorted(r["doc_id"] for r in returned) == sorted(r[0] for r in rows + rows[:2])
    found = {r["doc_id"]: r for r in returned}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    assert len(found) == len(rows)
    for i, (key, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        part = len(text) // 3
        edited = text[: len(text) - part] + after[:part]
        r = found[key]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(like(paragraphs(text), paragraphs(edited)))
        assert r["near_next"] == pytest.approx(like(paragraphs(text), paragraphs(after)))
    assert found[503]["fingerprint"] == found[504]["fingerprint"] == found[rows[4][0]]["fingerprint"]


def test_one_document_null_keys_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "abcdef"), (None, "abcdef")], "doc_id long, text string")
    only = fingerprints.edited_fingerprints(docs).collect()
    assert len(only) == 2 and only[0] == only[1] and only[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    assert only[0]["near_next"] == 1.0
    assert fingerprints.edited_fingerprints(docs.limit(0)).collect() == []
