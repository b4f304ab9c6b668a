"""Spelling variants: one-edit neighbours among a corpus' words by composition of automata."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mixloom.session import materialize

# Fixed values of the contract: which checksums lose a code point, least length and count of a
# word, and how many times as frequent a form is.
DAMAGED = 31
MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10

# Words that share this many first code points form a partition; a partition of more than
# GROUP_WORDS is divided by STEP more code points, as often as it takes.
PREFIX = 3
STEP = 2
GROUP_WORDS = 5_000
# Word counts kept by a task before it hands them on.
HELD_WORDS = 300_000

# A letter in Latin-1, A to Z in lower case; every other byte, and what Latin-1 lacks, is a blank.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def _doc_words(text: str, doc_id: str) -> dict[bytes, int]:
    """Counts of a document's words of at least ``MIN_LENGTH``, in Latin-1, after the damage."""
    runs = Counter([w for w in text.encode("latin-1", "replace").translate(_LETTERS).split() if len(w) >= MIN_LENGTH])
    start, found = zlib.crc32(f"{doc_id}:".encode()), {}
    for run, n in runs.items():
        checksum = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if checksum % DAMAGED == 0:
            at = checksum % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < MIN_LENGTH:
                continue
        found[run] = found.get(run, 0) + n
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def handed() -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in held], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if text.is_valid:
                held.update(_doc_words(text.as_py(), doc_id))
            if len(held) >= HELD_WORDS:
                yield handed()
                held.clear()
    if held:
        yield handed()


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n`` of the words that occur at least ``MIN_COUNT`` times in all documents.

    Words are maximal runs of letters up to U+00FF, A to Z in lower case, some with a
    code point taken out as the checksum of document and run tells. Counted in every
    task before the shuffle. A NULL id counts as the empty text.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text"))
    counts = rows.mapInArrow(_counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= MIN_COUNT)


class Acceptor:
    """The smallest automaton of a sorted list of words, built word by word.

    States are numbers. ``arcs`` of a state are (label, state, words before this arc);
    ``final`` tells whether a word ends there, ``words`` how many words it accepts, so
    a path also gives its word's place in the list.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[tuple[tuple[str, int, int], ...]] = []
        self.final: list[bool] = []
        self.words: list[int] = []
        self._known: dict[tuple, int] = {}
        path: list[tuple[bool, list]] = [(False, [])]
        before = ""
        for word in words:
            common = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                common += 1
            self._close(path, before, common)
            path += [(False, []) for _ in range(len(word) - common)]
            path[-1] = (True, path[-1][1])
            before = word
        self._close(path, before, 0)
        self.start = self._state(*path[0])

    def _close(self, path: list, word: str, depth: int) -> None:
        while len(path) - 1 > depth:
            state = self._state(*path.pop())
            path[-1][1].append((word[len(path) - 1], state))

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        known = (final, *arcs)
        if known not in self._known:
            total, placed = int(final), []
            for label, state in arcs:
                placed.append((label, state, total))
                total += self.words[state]
            self._known[known] = len(self.arcs)
            self.arcs.append(tuple(placed))
            self.final.append(final)
            self.words.append(total)
        return self._known[known]

    def shared(self, left: int, right: int) -> list[tuple[int, int]]:
        """Places, under two states, of the words that both accept."""
        found, todo = [], [(left, right, 0, 0)]
        while todo:
            x, y, i, j = todo.pop()
            if x == y:
                found += [(i + k, j + k) for k in range(self.words[x])]
                continue
            if self.final[x] and self.final[y]:
                found.append((i, j))
            others = {label: (state, before) for label, state, before in self.arcs[y]}
            for label, state, before in self.arcs[x]:
                if label in others:
                    other, before_other = others[label]
                    todo.append((state, other, i + before, j + before_other))
        return found

    def one_edit_pairs(self, first: int, last: int | None) -> Iterator[tuple[int, int]]:
        """Places of the words that this automaton, one edit and it again accept as a pair.

        The states of the composition before its edit are a path of the automaton taken
        twice; the edit leaves it by two arcs (a replaced code point) or by one arc against
        staying (one put in, which is not the next one of the other word, so that a
        pair comes once); after it both sides read the same. Only edits after
        ``first`` and before ``last`` code points are made.
        """
        memory: dict[tuple[int, int], list[tuple[int, int]]] = {}

        def shared(x: int, y: int) -> list[tuple[int, int]]:
            if (x, y) not in memory:
                memory[x, y] = self.shared(x, y)
            return memory[x, y]

        todo = [(self.start, 0, 0)]
        while todo:
            state, depth, place = todo.pop()
            arcs = self.arcs[state]
            if depth >= first and (len(arcs) > 1 or self.final[state]):
                for k, (_, x, before_x) in enumerate(arcs):
                    for _, y, before_y in arcs[k + 1:]:
                        for i, j in shared(x, y):
                            yield place + before_x + i, place + before_y + j
                for label, x, before_x in arcs:
                    if self.final[state] and self.final[x]:
                        yield place + before_x, place
                    inner = {c: (s, b) for c, s, b in self.arcs[x]}
                    for other, y, before_y in arcs:
                        if other != label and other in inner:
                            z, before_z = inner[other]
                            for i, j in shared(z, y):
                                yield place + before_x + before_z + i, place + before_y + j
            if last is None or depth + 1 < last:
                todo += [(x, depth + 1, place + before) for _, x, before in arcs]


def near_in_group(words: list[tuple[str, int, bool]], first: int, last: int | None) -> list[tuple[str, int, int, str]]:
    """Near words of each word of a group: how many, and the most frequent one's count and text.

    The third value of a word tells whether its end is the group's as it stands, or
    only without one more code point; of words of one length both must be the former, else
    the shorter.
    """
    own: dict[str, tuple[int, bool]] = {}
    for word, n, is_own in words:
        own[word] = (n, is_own or own.get(word, (0, False))[1])
    if len(own) < 2:
        return []
    texts = sorted(own)
    counts, owned, sizes = [own[t][0] for t in texts], [own[t][1] for t in texts], [len(t) for t in texts]
    pairs = [
        (i, j) for i, j in Acceptor(texts).one_edit_pairs(first, last)
        if (owned[i] if sizes[i] <= sizes[j] else owned[j]) and (sizes[i] != sizes[j] or owned[j])
    ]
    if not pairs:
        return []
    pairs = np.array(pairs, dtype=np.int64)
    word, near = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    order = np.lexsort((near, -np.array(counts, dtype=np.int64)[near], word))
    word, near = word[order], near[order]
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    total = np.diff([*starts.tolist(), len(word)])
    return [
        (texts[w], int(n), counts[b], texts[b])
        for w, n, b in zip(word[starts].tolist(), total.tolist(), near[starts].tolist())
    ]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words group by group, the rows of a group following each other."""
    current, group, found = None, [], []

    def handed() -> pa.RecordBatch:
        names = ["word", "n_near", "form_n", "form"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

    def close() -> None:
        if len(group) > 1:
            first, last = current[0], None if current[1] < 0 else current[1]
            found.extend(near_in_group(group, first, last))

    for batch in batches:
        for first, last, key, word, n, own in zip(*[c.to_pylist() for c in batch.columns]):
            if (first, last, key) != current:
                close()
                current, group = (first, last, key), []
            group.append((word, n, own))
        if len(found) > 10_000:
            yield handed()
            found = []
    close()
    if found:
        yield handed()


def _cells(words: DataFrame, first: int, width: int) -> list[DataFrame]:
    """Rows for edits after ``first`` and before ``first + width`` code points, by what such words share.

    That is the code points before, and the end; the end of a word with one put in is
    one code point further on. A group has at most as many words as ``width + 1`` letters.
    """
    before = F.substring("word", 1, first)
    end = lambda skip: F.expr(f"substring(word, {first + width + skip + 1})")
    cell = lambda skip: words.select(
        F.lit(first).alias("first"), F.lit(first + width).alias("last"),
        F.concat(before, F.lit(" "), end(skip)).alias("key"), "word", "n", F.lit(skip == 0).alias("own"),
    )
    return [cell(0), cell(1)]


def near_words(vocabulary: DataFrame, prefix: int = PREFIX, group_words: int = GROUP_WORDS) -> DataFrame:
    """``word``, ``n_near``, and its most frequent near word ``form`` with ``form_n``; words without one are left out.

    ``vocabulary`` has distinct words and counts. An edit after the first ``prefix``
    code points leaves both words in one partition of the automaton's first arcs;
    an earlier one leaves their ends alike. A partition of too many words is divided in
    the same way by more code points, so no group grows with the corpus.
    """
    rows, left, depth = _cells(vocabulary, 0, prefix), vocabulary, prefix
    while True:
        start = F.substring("word", 1, depth)
        sizes = left.groupBy(start.alias("key")).agg(F.count("*").alias("_size"))
        large = materialize(sizes.filter(F.col("_size") > group_words).select("key"), "large-prefixes")
        keyed = left.withColumn("key", start)
        small = keyed.join(large, "key", "left_anti")
        rows.append(small.select(
            F.lit(depth).alias("first"), F.lit(-1).alias("last"), "key", "word", "n", F.lit(True).alias("own")
        ))
        if large.isEmpty():
            break
        left = materialize(keyed.join(large, "key", "left_semi").select("word", "n"), "large-partitions")
        rows += _cells(left, depth, STEP)
        depth += STEP
    united = rows[0]
    for more in rows[1:]:
        united = united.unionByName(more)
    group = ["first", "last", "key"]
    found = united.repartition(*group).sortWithinPartitions(*group).mapInArrow(
        _near, "word string, n_near bigint, form_n bigint, form string"
    )
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """The last word reached from each word by following ``form``; every round doubles the way gone.

    A form is ``RATIO`` times as frequent as its word, so the way is short and never closes.
    """
    roots = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = materialize(
            roots.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), "_next"), "roots"
        )
        roots = moved.select("word", "root")
        if moved.filter("_next IS NOT NULL").isEmpty():
            return roots


def spelling_variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", prefix: int = PREFIX, group_words: int = GROUP_WORDS,
    ratio: int = RATIO,
) -> DataFrame:
    """Every word with its count, near words, the form it is a variant of, and the root of its forms.

    Gives ``word``, ``n``, ``n_near``, ``form`` (the near word of largest count, the smallest in
    code-point order among equals, if ``ratio`` times as frequent; else NULL), ``form_n``
    and ``root``. NULL and empty texts have no words, repeated documents count again;
    no documents, or none with a word, give no rows. Other columns are not looked at.
    """
    words = materialize(count_words(docs, key, text), "words")
    near = near_words(words, prefix, group_words)
    frequent: Column = F.col("form_n") >= ratio * F.col("n")
    known = materialize(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(frequent, F.col("form")).alias("form"), F.when(frequent, F.col("form_n")).alias("form_n"),
    ), "near-words")
    roots = _roots(known.filter("form IS NOT NULL"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
