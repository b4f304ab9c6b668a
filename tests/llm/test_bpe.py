"""Encoding against the public library, and exact round trips."""

import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from mixloom.llm import bpe
from mixloom.llm.common import tokenizer_path

PATH = tokenizer_path(bpe.VOCABULARY)
PIECES = ["a", "aa", "the", " the", " ", "  ", "\n", " \n", "\t", "\x1c", "\x85", "é", "漢", "1", "²", "'s", "'ll",
          "!", "!!", "<|endoftext|>", "<|endof", "\U0001f600", "́", "​", "idiot", "ING"]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_vocabulary(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join) | st.text(max_size=60))
def test_ids_equal_the_library(encoder, library, text):
    text = text.encode("utf-8", "replace").decode()
    ids = library.encode(text, add_special_tokens=False).ids
    assert encoder.encode(text) == ids
    assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 5_000, " " * 3_000, "word " * 4_000, "x\n" * 2_000, "é漢" * 3_000])
def test_long_texts(encoder, library, text):
    assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    small = bpe.Encoder(bpe.read_vocabulary(PATH))
    text = "many different words that do not fit its memory at all"
    assert small.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_documents(spark, library):
    texts = [None, "", "Hello  world\n", "x <|endoftext|> y", "Hello  world\n", " lead", "trail "]
    docs = spark.createDataFrame(
        [(i if i else None, t, 9, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, ids string"
    )
    encoded = bpe.encode_documents(docs)
    rows = {r["doc_id"] or 0: r for r in encoded.collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert rows[i]["ids"] == ids and rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    decoded = {r["doc_id"] or 0: r["text"] for r in bpe.decode_documents(encoded).collect()}
    assert decoded == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode_documents(docs.limit(0)).collect() == []


def test_words_of_ascii_letters_need_no_pattern():
    encoder = bpe.Encoder(bpe.read_vocabulary(bpe.tokenizer_path(bpe.VOCABULARY)))
    texts = ["So Edingea, theandsh! inwh's x_y- un... do-it $5 (onha) _a_ b'", "a élan, naïf. Ünder\nThe end.\nIt z's", "one 't two 'll. three,''"]
    want = [[i for piece in encoder.pieces(t) for i in encoder.encode_piece(piece)] for t in texts]
    cut, asked = encoder.pieces, []
    encoder.pieces = lambda text: asked.append(text) or cut(text)
    assert [encoder.encode(t) for t in texts] == want
    asked.clear()
    encoder.encode("First theandshe, unthonre onha thonre!? Zinwhed, zinwhed.")
    assert asked == ["First"]


def test_a_worker_hands_on_few_rows_at_once(encoder):
    texts = [None if i % 7 == 0 else f"text {i} of many" for i in range(1_203)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(part))), pa.array(part, pa.string())], ["k", "t"])
               for part in (texts[:1_200], texts[1_200:], [])]
    made = list(bpe.encoded_batches(encoder, iter(batches), "k", True))
    assert max(b.num_rows for b in made) <= bpe.ROWS_AT_ONCE
    assert [i for b in made for i in b.column(0).to_pylist()] == [*range(1_200), *range(3)]
    assert [x for b in made for x in b.column(4).to_pylist()] == [encoder.encode(t or "") for t in texts]
    assert [b.schema.names for b in bpe.encoded_batches(encoder, iter(batches[1:]), "k", False)] == [made[0].schema.names[:4]]


def test_a_worker_remembers_a_word_once_and_no_line_ends(encoder, library):
    fresh = bpe.Encoder(bpe.parse_vocabulary(open(PATH, "rb").read()))
    text = "\n\nÜber été naïve größte.\nUn été,\n\n\nnaïve Ǆ über.\n\n"
    assert fresh.encode(text) == library.encode(text, add_special_tokens=False).ids
    remembered = [*fresh.word_ids, *fresh.first_ids, *fresh.piece_ids]
    assert len([w for w in remembered if w.strip() == "naïve"]) == 2  # after a space, and first of a line
    assert not [w for w in remembered if "\n" in w.strip("\n")]
    # Beside its encoder a worker holds the file's bytes, not a parsed copy.
    assert bpe.worker_encoder("bytes", open(PATH, "rb").read()).encode(text) == fresh.encode(text)
