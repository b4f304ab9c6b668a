"""Operator 7: byte-pair encoding and decoding by dynamic programming over prefixes.

Every prefix of a piece of text has exactly one last token in its encoding. It is
found left to right: among the vocabulary entries that end at the prefix (matches of
an automaton over the vocabulary), it is the one that may follow the last token of
what is left. Two tokens may stand side by side when undoing their merges, latest
first, meets no earlier merge across their border. Following the stored last tokens
back from the end gives the ids, the same ones that merging pairs by rank gives.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from mixloom.llm.common import tokenizer_path

# Fixed value: the public pattern that cuts text before byte-level merges. White
# space is the Unicode property, which leaves out the ASCII separators 1C to 1F.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
VOCABULARY = "byte_bpe_50k.json"
# ASCII marks that may end a word: together they are one piece, none begins one of its own.
WORD_ENDS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# Latin letters that every version of Unicode has: a run of them is one piece.
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u0217]+"
# Entries that each memory of a worker holds; beyond, it forgets all and starts anew.
REMEMBERED = 300_000
# Rows that a worker encodes and hands on at once.
ROWS_AT_ONCE = 500


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = [""] * 256, 256
    for byte in range(256):
        if byte in plain:
            letters[byte] = chr(byte)
        else:
            letters[byte] = chr(spare)
            spare += 1
    return letters


def read_vocabulary(path: str) -> dict:
    """Entries and merges of a byte-level vocabulary file, bounded by the vocabulary."""
    with open(path, "rb") as file:
        return parse_vocabulary(file.read())


def parse_vocabulary(content: bytes) -> dict:
    spec = json.loads(content)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {
        "vocab": {t: i for t, i in spec["model"]["vocab"].items() if t not in special},
        "merges": [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]],
        "special": special,
    }


class Memory(dict):
    """A dictionary that computes what it lacks and holds a bounded number of entries."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class Encoder:
    """Encodes and decodes texts with one vocabulary; built once per worker."""

    def __init__(self, vocabulary: dict):
        vocab, self.special = vocabulary["vocab"], vocabulary["special"]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made_at: dict[int, int] = {}
        for rank, (a, b) in enumerate(vocabulary["merges"]):
            pair, made = (vocab[a], vocab[b]), vocab[a + b]
            self.rank.setdefault(pair, rank)
            if made not in self.parts:
                self.parts[made], self.made_at[made] = pair, rank
        letters = byte_letters()
        byte_of = {letter: byte for byte, letter in enumerate(letters)}
        self.to_letters = {byte: letter for byte, letter in enumerate(letters)}
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.digits = {i: str(i) for i in self.bytes_of}
        self.pieces = regex.compile(PIECES).findall
        found = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.split_special = regex.compile(f"({found})").split if found else None
        self.size_of = {i: len(t) for t, i in vocab.items()}
        self.matches = ahocorasick.Automaton()
        for token, i in vocab.items():
            if len(token) == 1 or i in self.parts:
                self.matches.add_word(token, i)
        self.matches.make_automaton()
        self.adjacent = Memory(self._may_follow)
        self.word_ids = Memory(self._encode_word)
        self.first_ids = Memory(self._encode_first)
        self.piece_ids = Memory(self.encode_piece)
        # White space other than the space and the line feed; some letters more do no harm.
        self.line_feeds = re.compile("(\n+)").split
        self.letters_only = re.compile(LETTERS).fullmatch
        self.odd_space = re.compile("[\\x09\\x0b-\\x0d\\x1c-\\x1f\\x85\\xa0\u1680\u2000-\u3000]").search

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves the two tokens side by side."""
        return self.adjacent[left << 32 | right]

    def _may_follow(self, pair: int) -> bool:
        left, right = pair >> 32, pair & 0xFFFFFFFF
        limit = float("inf")
        while True:
            rank = self.rank.get((left, right))
            if rank is not None and rank < limit:
                return False
            made_left, made_right = self.made_at.get(left, -1), self.made_at.get(right, -1)
            if made_left < 0 and made_right < 0:
                return True
            # Undo the later of the two merges. At equal rank the left one came first.
            if made_left > made_right:
                limit, left = made_left, self.parts[left][1]
            else:
                limit, right = made_right + 1, self.parts[right][0]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece: the last token of every prefix, then the way back."""
        return self._encode_letters("".join(map(self.to_letters.__getitem__, piece.encode())))

    def _encode_letters(self, letters: str) -> tuple[int, ...]:
        # One place more, so that -1 stands for the empty prefix.
        last = [-1] * (len(letters) + 1)
        size_of, adjacent = self.size_of, self.adjacent
        for end, token in self.matches.iter(letters):
            if last[end] < 0:
                before = end - size_of[token]
                if before < 0 or (left := last[before]) >= 0 and adjacent[left << 32 | token]:
                    last[end] = token
        ids, end = [], len(letters) - 1
        while end >= 0:
            token = last[end]
            ids.append(token)
            end -= size_of[token]
        ids.reverse()
        return tuple(ids)

    def _encode_pieces(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.piece_ids.__getitem__, self.pieces(text))))

    def _encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of a word and the space before it; Latin letters are a piece without a look at the pattern."""
        if self.letters_only(body := word.rstrip(WORD_ENDS)):
            if len(body) < len(word):
                return self.word_ids[body] + self.piece_ids[word[len(body):]]
            # Remembered as a word, so not as a piece too.
            return self._encode_letters(self.to_letters[32] + word) if word.isascii() else self.encode_piece(" " + word)
        return self._encode_pieces(" " + word)

    def _encode_first(self, word: str) -> tuple[int, ...]:
        """Ids of a line's first word, which has no space before it."""
        return tuple(chain.from_iterable(map(self.encode_piece, self.pieces(word))))

    def _encode_plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens.

        A piece holds a space only in front, so a space between two visible
        characters starts one: words are looked up with the space before them.
        A text with other white space beside a space is cut by the pattern alone.
        Line feeds are cut off first: what stands around one is seldom met again.
        """
        if "  " in text or " \n" in text or "\n " in text or self.odd_space(text):
            return list(self._encode_pieces(text))
        if text.startswith(" ") or text.endswith(" "):
            return list(self._encode_pieces(text))
        ids: list[int] = []
        line, *more = self.line_feeds(text)
        self._encode_line(line, ids)
        for feeds, line in zip(more[::2], more[1::2]):
            # Before a visible character the last line feed is a piece of its own.
            if line:
                ids += self.piece_ids[feeds[1:]] + self.piece_ids["\n"]
                self._encode_line(line, ids)
            else:
                ids += self.piece_ids[feeds]
        return ids

    def _encode_line(self, line: str, ids: list[int]) -> None:
        first, *words = line.split(" ")
        ids += self.first_ids[first]
        ids += chain.from_iterable(map(self.word_ids.__getitem__, words))

    def encode(self, text: str) -> list[int]:
        if not self.split_special:
            return self._encode_plain(text)
        ids: list[int] = []
        for part in self.split_special(text):
            ids += [self.special[part]] if part in self.special else self._encode_plain(part)
        return ids

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def shared_vocabulary(spark: SparkSession, path: str | None) -> Broadcast:
    with open(path or tokenizer_path(VOCABULARY), "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def worker_encoder(name: str, vocabulary: bytes) -> Encoder:
    """The encoder of a call, kept by the worker from task to task."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(parse_vocabulary(vocabulary))
    return _ENCODERS[name]


def encoded_batches(
    encoder: Encoder, batches: Iterator[pa.RecordBatch], key: str, keep_ids: bool
) -> Iterator[pa.RecordBatch]:
    """The results for batches of a key and a text, few rows at once: ids take more room than their text."""
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]
    for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
        counts, id_sums, text_sums, all_ids = [], [], [], []
        for text_value in batch.column(1):
            ids = encoder.encode(text_value.as_py() or "")
            counts.append(len(ids))
            joined = ",".join(map(encoder.digits.__getitem__, ids))
            id_sums.append(hashlib.sha256(joined.encode()).hexdigest())
            text_sums.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
            if keep_ids:
                all_ids.append(np.array(ids, dtype=np.int32))
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()),
                   pa.array(text_sums, pa.string())]
        if keep_ids:
            columns.append(pa.array(all_ids, pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays(columns, names)


def encode_documents(
    docs: DataFrame, vocabulary_path: str | None = None, key: str = "doc_id", text: str = "text",
    keep_ids: bool = True,
) -> DataFrame:
    """Ids of every whole text, their count, and checksums of ids and decoded text.

    Gives ``key``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by
    commas), ``decoded_sha256`` (of the decoded text in UTF-8) and, with
    ``keep_ids``, the ``ids`` themselves. A NULL text counts as empty and has no
    tokens; strings of special tokens in a text become those tokens, as the
    public library does. Rows are independent: repeated rows give repeated
    results, other columns are not looked at. The vocabulary's file is read on the
    driver and broadcast as it is; a worker holds no parsed copy beside its encoder.
    """
    shared = shared_vocabulary(docs.sparkSession, vocabulary_path)
    name = uuid.uuid4().hex
    key_type = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", ids array<int>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encoded_batches(worker_encoder(name, shared.value), batches, key, keep_ids)

    return docs.select(key, text).mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, vocabulary_path: str | None = None, key: str = "doc_id") -> DataFrame:
    """Texts from the ``ids`` of :func:`encode_documents`; NULL ids give a NULL text."""
    shared = shared_vocabulary(encoded.sparkSession, vocabulary_path)
    name = uuid.uuid4().hex

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(name, shared.value)
        for batch in batches:
            texts = [None if ids is None else encoder.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    key_type = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(decode, f"`{key}` {key_type}, text string")
