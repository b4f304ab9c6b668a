"""Corpus metrics over prediction tables: perplexity, BLEU, ROUGE, and user metrics."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from math import exp, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mixloom.functions.text import as_text, strip, tokens_13a, tokens_rouge
from mixloom.operators.batching import batch_predict
from mixloom.session import materialize
from mixloom.sources.sinks import write_metrics

MAX_ORDER = 4
ROUGE_KINDS = ("rouge1", "rouge2", "rougeL")

# Shares of a Poisson distribution of mean 1 up to each count, in four hexadecimal digits.
POISSON_STEPS = tuple(
    f"{round(65536 * sum(exp(-1) / factorial(i) for i in range(times + 1))):04x}" for times in range(8)
)

# Tokens counted together; rows are never split.
CHUNK_TOKENS = 2_000_000


def cut_prompt(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Text cut in half by characters: the prompt, and the target stripped."""
    half = F.floor(F.length(text) / 2).cast("int")
    return df.select(
        *keep,
        F.left(F.col(text), half).alias("prompt"),
        strip(F.substring(F.col(text), half + 1, F.length(text))).alias("target"),
    )


def strip_prompt(
    df: DataFrame, prompt: str = "prompt", output: str = "output", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Model output without the echoed prompt (by length), stripped, as ``prediction``."""
    rest = F.substring(F.col(output), F.length(prompt) + 1, F.length(output))
    return df.select(*keep, strip(rest).alias("prediction"))


def _perplexity(loss: str, tokens: str) -> Column:
    known = F.when(F.col(loss).isNotNull(), F.col(tokens))
    return F.exp(F.sum(F.col(loss) * F.col(tokens)) / F.nullif(F.sum(known), F.lit(0)))


def perplexity(df: DataFrame, loss: str = "loss", tokens: str = "n_tokens", by: tuple[str, ...] = ()) -> DataFrame:
    """exp of the token-weighted mean of the known losses; NULL without such tokens."""
    grouped = df.groupBy(*by) if by else df
    return grouped.agg(_perplexity(loss, tokens).alias("perplexity"))


def matched_grams(max_order: int, orders: Sequence[int] | None = None):
    """A vectorised function for the clipped n-gram matches of two token arrays, by order.

    An n-gram the two share counts as often as it occurs in both. Grams are
    numbered exactly (order n from the number of order n-1 and the next token)
    and counted with sorted arrays over a whole Arrow batch. Nothing is
    shuffled and memory is bounded by a batch: exploding the grams into a
    grouped count moves and hashes several times the text, and spilled on
    ordinary partitions. It is a closure so that executors need no copy of this
    package.
    """
    wanted = list(orders or range(1, max_order + 1))
    chunk_tokens = CHUNK_TOKENS

    def count(left, right):
        import numpy as np
        import pandas as pd
        import pyarrow as pa
        import pyarrow.compute as pc

        n_rows = len(left)
        sizes = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in (left, right)])
        tokens = pa.concat_arrays([left.flatten(), right.flatten()]).dictionary_encode()
        word = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        side = np.repeat(np.arange(2 * n_rows), sizes)
        to_end = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(word))
        out = np.zeros((n_rows, max_order), dtype=np.int64)
        gram = word
        for n in range(1, max_order + 1):
            if n > 1:
                pairs = gram[:-1] * len(tokens.dictionary) + word[n - 1:]
                gram = pd.factorize(pairs)[0]
            whole = to_end[:len(gram)] >= n
            if not whole.any():
                break
            if n not in wanted:
                continue
            key = side[:len(gram)][whole] * (gram.max() + 1) + gram[whole]
            seen, times = np.unique(key, return_counts=True)
            reference = np.searchsorted(seen, n_rows * (gram.max() + 1))
            _, p, r = np.intersect1d(
                seen[:reference], seen[reference:] - n_rows * (gram.max() + 1),
                assume_unique=True, return_indices=True,
            )
            shared = np.minimum(times[:reference][p], times[reference:][r])
            out[:, n - 1] = np.bincount(seen[p] // (gram.max() + 1), weights=shared, minlength=n_rows)
        return out

    def matches(predictions: pa.Array, references: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        sizes = pc.add(pc.list_value_length(predictions), pc.list_value_length(references))
        chunk = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64) // chunk_tokens
        starts = np.flatnonzero(np.diff(chunk, prepend=-1))
        ends = [*starts[1:], len(chunk)]
        parts = [count(predictions.slice(a, b - a), references.slice(a, b - a)) for a, b in zip(starts, ends)]
        found = np.concatenate(parts) if parts else np.zeros((0, max_order), dtype=np.int64)
        return pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), max_order).cast(pa.list_(pa.int64()))

    return F.arrow_udf(matches, "array<bigint>")


@dataclass(frozen=True)
class MetricParts:
    """A metric as parts that share one pass over the rows with other metrics.

    ``rows`` are steps of columns worked out for every row, each from the table and the
    steps before it; ``sums`` are aggregates over these, which combine before the shuffle;
    ``values`` are the results, from the sums. Begin names of columns and sums that are
    not results with the metric's own name.
    """

    sums: tuple[Column, ...]
    values: tuple[Column, ...]
    rows: tuple[dict[str, Column], ...] = ()


def in_one_pass(df: DataFrame, parts: Sequence[MetricParts]) -> DataFrame:
    """One row of the results of all parts, from one scan and one aggregate."""
    for step in range(max(len(part.rows) for part in parts)):
        df = df.withColumns({c: e for part in parts if step < len(part.rows) for c, e in part.rows[step].items()})
    return df.agg(*[x for part in parts for x in part.sums]).select(*[x for part in parts for x in part.values])


def bleu_parts(prediction: str = "prediction", reference: str = "reference", max_order: int = MAX_ORDER) -> MetricParts:
    """Corpus BLEU, its precisions, penalty and lengths."""
    orders = range(1, max_order + 1)
    tokens = {"_bleu_p": tokens_13a(as_text(F.col(prediction))), "_bleu_r": tokens_13a(as_text(F.col(reference)))}
    counts = {
        "_bleu_np": F.size("_bleu_p"), "_bleu_nr": F.size("_bleu_r"),
        "_bleu_m": matched_grams(max_order)("_bleu_p", "_bleu_r"),
    }
    sums = (
        F.sum("_bleu_np").alias("translation_length"),
        F.sum("_bleu_nr").alias("reference_length"),
        *[F.sum(F.col("_bleu_m")[n - 1]).alias(f"_bleu_m{n}") for n in orders],
        *[F.sum(F.greatest(F.col("_bleu_np") - (n - 1), F.lit(0))).alias(f"_bleu_t{n}") for n in orders],
    )

    def precision(n: int) -> Column:
        return F.when(F.col(f"_bleu_t{n}") > 0, F.col(f"_bleu_m{n}") / F.col(f"_bleu_t{n}")).otherwise(0.0)

    ratio = F.col("translation_length") / F.nullif(F.col("reference_length"), F.lit(0))
    penalty = F.when(ratio > 1, 1.0).when(ratio > 0, F.exp(1 - 1 / ratio)).when(ratio == 0, 0.0)
    log_sum = reduce(lambda a, b: a + b, [F.ln(F.nullif(precision(n), F.lit(0.0))) for n in orders])
    mean = F.coalesce(F.exp(log_sum / max_order), F.lit(0.0))
    values = (
        (mean * penalty).alias("bleu"),
        *[precision(n).alias(f"precision_{n}") for n in orders],
        penalty.alias("brevity_penalty"),
        F.col("translation_length"), F.col("reference_length"),
    )
    return MetricParts(sums, values, (tokens, counts))


def bleu(
    df: DataFrame, prediction: str = "prediction", reference: str = "reference", max_order: int = MAX_ORDER
) -> DataFrame:
    """Corpus BLEU: clipped n-gram precisions, brevity penalty, no smoothing.

    One scan with counts per row and one partial aggregate. No reference tokens
    give NULL; no matches of some order give 0.
    """
    return in_one_pass(df, [bleu_parts(prediction, reference, max_order)])


def _f1(matches: Column, predicted: Column, referred: Column) -> Column:
    precision = F.when(predicted > 0, matches / predicted).otherwise(0.0)
    recall = F.when(referred > 0, matches / referred).otherwise(0.0)
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def lcs_length(row_words: int = 25_000, step_cells: int = 4_000_000, mask_words: int = 4_000_000):
    """A function over Arrow batches for the longest common subsequence of two token arrays.

    Bit-parallel (Crochemore et al. 2001, Hyyrö 2004) over many rows at once: a row's state is
    an array of 64-bit words, one bit for each reference token, and one step adds the
    places of the next prediction token in all rows. A carry goes to the next word that
    is not full, found by a running maximum. Rows of about one size are taken
    together; long references in blocks of words that hand their carries on. Where too few
    rows share a step to pay for it, each row's state is one whole number instead, by the
    same steps. Rows go in chunks of so many tokens, and the bounds
    are on words of state, on steps times rows and on words of token places held at
    once; they change no result. It is a closure so that executors need no copy of this
    package.
    """
    import numpy as np

    chunk_tokens = CHUNK_TOKENS
    full_word = np.uint64(2**64 - 1)

    def spread(values: np.ndarray, start: np.ndarray, size: np.ndarray):
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return row, place, values[start[row] + place]

    def step(state: np.ndarray, hit: np.ndarray, carry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State plus places plus carry, the bits of other tokens kept; and the carry out of the last word."""
        total = state + hit
        over, full = total < hit, total == full_word
        words = state.shape[1]
        if words == 1:
            out = over | (full & carry[:, None])
        else:
            stop = np.maximum.accumulate(np.where(full, -1, np.arange(words)), axis=1)
            out = np.where(stop >= 0, np.take_along_axis(over, np.maximum(stop, 0), axis=1), carry[:, None])
            total[:, 1:] += out[:, :-1]
        total[:, 0] += carry
        return total | (state & ~hit), out[:, -1]

    def common(left, right, left_size, right_size, kinds: int) -> np.ndarray:
        """Lengths for rows in falling order of ``left_size``; tokens come as (row, place, number)."""
        rows, steps = len(left_size), int(left_size[0])
        alive = np.searchsorted(-left_size, -np.arange(steps), side="left")
        left_row, left_place, left_token = left
        right_row, right_place, right_token = right
        left_key, right_key = left_row * kinds + left_token, right_row * kinds + right_token
        carry = np.zeros((steps, rows), dtype=bool)
        length = np.zeros(rows, dtype=np.int64)
        words = -(-int(right_size.max()) // 64)
        block = min(max(mask_words // (rows * min(kinds, 4096)), 64), 1024)
        for first in range(0, words, block):
            held = min(block, words - first)
            here = (right_place >= first * 64) & (right_place < (first + held) * 64)
            keys, index = np.unique(right_key[here], return_inverse=True)
            place = right_place[here] - first * 64
            masks = np.zeros((len(keys) + 1, held), dtype=np.uint64)
            np.bitwise_or.at(masks, (index, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
            at = np.minimum(np.searchsorted(keys, left_key), len(keys) - 1)
            # Tokens that are not here have the last mask, without places.
            mask_of = np.full((steps, rows), len(keys), dtype=np.int64)
            mask_of[left_place, left_row] = np.where(keys[at] == left_key, at, len(keys))
            state = np.full((rows, held), full_word, dtype=np.uint64)
            for t in range(steps):
                n = int(alive[t])
                before = state[:n]
                state[:n], carry[t, :n] = step(before, before & masks[mask_of[t, :n]], carry[t, :n])
            bits = np.clip(right_size[:, None] - (first + np.arange(held)) * 64, 0, 64).astype(np.uint64)
            within = np.where(bits == 64, full_word, (np.uint64(1) << (bits & np.uint64(63))) - np.uint64(1))
            length += np.bitwise_count(~state & within).sum(axis=1, dtype=np.int64)
        return length

    def alone(left: list[int], right: list[int]) -> int:
        """The length for one row; its state is a whole number of one bit for each reference token."""
        masks: dict[int, int] = {}
        for place, token in enumerate(right):
            masks[token] = masks.get(token, 0) | 1 << place
        full = (1 << len(right)) - 1
        state = full
        for token in left:
            if token in masks:
                hit = state & masks[token]
                state = (state + hit | state & ~hit) & full
        return len(right) - state.bit_count()

    def together_pays(left_size: np.ndarray, right_size: np.ndarray) -> bool:
        """Whether one step over all rows takes less time than a step of each; microseconds as measured."""
        words = -(-int(right_size.max()) // 64)
        together = left_size.max() * (25 + 0.02 * len(left_size) * words)
        apart = left_size.sum() * (0.4 + 0.005 * words) + right_size.sum() * (0.3 + 0.002 * words)
        return words > 1024 or together < apart

    def found_in(predictions: pa.Array, references: pa.Array, sizes: list[np.ndarray]) -> np.ndarray:
        import pyarrow as pa

        flat = [lists.flatten() for lists in (predictions, references)]
        numbers = pa.concat_arrays(flat).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        tokens = [numbers[: len(flat[0])], numbers[len(flat[0]):]]
        starts = [np.cumsum(size) - size for size in sizes]
        kinds = int(numbers.max()) + 1 if len(numbers) else 1
        words = -(-sizes[1] // 64)
        found = np.zeros(len(predictions), dtype=np.int64)
        left = np.lexsort((-sizes[0], words))
        left = left[(sizes[0][left] > 0) & (sizes[1][left] > 0)]
        while len(left):
            # Rows of up to a quarter more words than the first, as many as the bounds allow.
            most = words[left[0]] + words[left[0]] // 4
            number = np.arange(1, len(left) + 1)
            fits = (words[left] <= most) & (number * min(most, 1024) <= row_words)
            fits &= number * np.maximum.accumulate(sizes[0][left]) <= step_cells
            count = max(1, int(np.argmin(fits)) if not fits.all() else len(left))
            rows, left = left[:count], left[count:]
            rows = rows[np.argsort(-sizes[0][rows], kind="stable")]
            if together_pays(sizes[0][rows], sizes[1][rows]):
                parts = [spread(tokens[i], starts[i][rows], sizes[i][rows]) for i in (0, 1)]
                found[rows] = common(*parts, sizes[0][rows], sizes[1][rows], kinds)
            else:
                for row in rows:
                    own = [tokens[i][starts[i][row] : starts[i][row] + sizes[i][row]].tolist() for i in (0, 1)]
                    found[row] = alone(*own)
        return found

    def lengths(predictions: pa.Array, references: pa.Array) -> pa.Array:
        import pyarrow as pa
        import pyarrow.compute as pc

        sizes = [
            pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lists in (predictions, references)
        ]
        chunk = np.cumsum(sizes[0] + sizes[1]) // chunk_tokens
        starts = np.flatnonzero(np.diff(chunk, prepend=-1))
        found = np.zeros(len(chunk), dtype=np.int64)
        for a, b in zip(starts, [*starts[1:], len(chunk)]):
            found[a:b] = found_in(predictions.slice(a, b - a), references.slice(a, b - a), [size[a:b] for size in sizes])
        return pa.array(found, pa.int64())

    return F.arrow_udf(lengths, "bigint")


def _rouge_steps(prediction: str, reference: str, kinds: tuple[str, ...]) -> tuple[dict[str, Column], ...]:
    """Columns of every row, step by step, the last one the scores ``_rouge_<kind>``."""
    orders = {kind: int(kind.removeprefix("rouge")) for kind in kinds if kind != "rougeL"}
    tokens = {"_rouge_p": tokens_rouge(as_text(F.col(prediction))), "_rouge_r": tokens_rouge(as_text(F.col(reference)))}
    sizes = ("_rouge_np", "_rouge_nr")
    counts = {"_rouge_np": F.size("_rouge_p"), "_rouge_nr": F.size("_rouge_r")}
    if orders:
        counts["_rouge_m"] = matched_grams(max(orders.values()), list(orders.values()))("_rouge_p", "_rouge_r")
    if "rougeL" in kinds:
        counts["_rouge_lcs"] = lcs_length()("_rouge_p", "_rouge_r")

    def score(kind: str) -> Column:
        if kind == "rougeL":
            return _f1(F.col("_rouge_lcs"), *map(F.col, sizes))
        n = orders[kind]
        return _f1(F.col("_rouge_m")[n - 1], *[F.greatest(F.col(c) - (n - 1), F.lit(0)) for c in sizes])

    return tokens, counts, {f"_rouge_{kind}": score(kind) for kind in kinds}


def rouge_scores(
    df: DataFrame, prediction: str = "prediction", reference: str = "reference",
    kinds: tuple[str, ...] = ROUGE_KINDS, keep: tuple[str, ...] = (),
) -> DataFrame:
    """F1 of every row for the chosen ROUGE kinds."""
    for step in _rouge_steps(prediction, reference, kinds):
        df = df.withColumns(step)
    return df.select(*keep, *[F.col(f"_rouge_{kind}").alias(kind) for kind in kinds])


def rouge_parts(
    prediction: str = "prediction", reference: str = "reference", kinds: tuple[str, ...] = ROUGE_KINDS
) -> MetricParts:
    """Mean ROUGE F1 over rows."""
    means = tuple(F.avg(f"_rouge_{kind}").alias(kind) for kind in kinds)
    return MetricParts(means, tuple(map(F.col, kinds)), _rouge_steps(prediction, reference, kinds))


def rouge(
    df: DataFrame, prediction: str = "prediction", reference: str = "reference",
    kinds: tuple[str, ...] = ROUGE_KINDS,
) -> DataFrame:
    """Mean ROUGE F1 over rows."""
    return in_one_pass(df, [rouge_parts(prediction, reference, kinds)])


def poisson_weight(digest: Column, place: int) -> Column:
    """How often a row is drawn, by four hexadecimal digits of its digest: Poisson of mean 1."""
    digits = F.substring(digest, 4 * place + 1, 4)
    weight = F.lit(len(POISSON_STEPS))
    for times, step in reversed(list(enumerate(POISSON_STEPS))):
        weight = F.when(digits < step, times).otherwise(weight)
    return weight


def rouge_bootstrap(
    df: DataFrame, key: str, prediction: str = "prediction", reference: str = "reference",
    kinds: tuple[str, ...] = ROUGE_KINDS, replicates: int = 1000, level: float = 0.95, seed: int = 0,
) -> DataFrame:
    """``metric, low, mid, high``: quantiles of the mean F1 over rows drawn again and again.

    A row is drawn a Poisson number of times in each replicate, by the MD5 digest of
    ``seed:key:block``, whose 32 digits serve a block of eight replicates. Scores count in
    whole billionths, so that the sums, and with them the results, are the same however
    the rows lie. One pass: a task hands on one row for each block. Rows of one key are
    drawn together, a NULL key counts as an empty text, and a replicate that draws no row has no
    mean; without rows all three are NULL.
    """
    if replicates < 1 or not 0 < level < 1:
        raise ValueError("replicates must be at least 1 and level between 0 and 1")
    scored = rouge_scores(df, prediction, reference, kinds, keep=(key,))
    blocks = F.sequence(F.lit(0), F.lit((replicates - 1) // 8))
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    units = [F.round(F.col(kind) * 1e9).cast("bigint").alias(kind) for kind in kinds]
    drawn = scored.select(name.alias("_key"), *units, F.explode(blocks).alias("_block")).withColumn(
        "_digest", F.md5(F.concat_ws(":", F.lit(seed), "_key", "_block"))
    )
    weighted = drawn.select("_block", *kinds, *[poisson_weight(F.col("_digest"), i).alias(f"_w{i}") for i in range(8)])
    summed = weighted.groupBy("_block").agg(
        *[F.sum(f"_w{i}").alias(f"_w{i}") for i in range(8)],
        *[F.sum(F.col(f"_w{i}") * F.col(kind)).alias(f"_{kind}{i}") for kind in kinds for i in range(8)],
    )
    means = summed.select(F.inline(F.array(*[
        F.struct(
            (F.col("_block") * 8 + i).alias("replicate"),
            *[(F.col(f"_{kind}{i}") / F.nullif(F.col(f"_w{i}"), F.lit(0)) / 1e9).alias(kind) for kind in kinds],
        )
        for i in range(8)
    ]))).filter(F.col("replicate") < replicates)
    points = F.array(F.lit((1 - level) / 2), F.lit(0.5), F.lit((1 + level) / 2))
    found = means.agg(*[F.percentile(kind, points).alias(kind) for kind in kinds])
    return found.select(F.inline(F.array(*[
        F.struct(F.lit(kind).alias("metric"), *[F.get(kind, i).alias(c) for i, c in enumerate(("low", "mid", "high"))])
        for kind in kinds
    ])))


def _bleu_alone() -> MetricParts:
    whole = bleu_parts()
    return replace(whole, values=whole.values[:1])


def _perplexity_alone() -> MetricParts:
    return MetricParts((_perplexity("loss", "n_tokens").alias("perplexity"),), (F.col("perplexity"),))


# Metrics that read the table on their own, and those of parts, made when they are asked for.
METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {}
IN_ONE_PASS: dict[str, Callable[[], MetricParts]] = {
    "bleu": _bleu_alone, "rouge": rouge_parts, "perplexity": _perplexity_alone
}


def register_metric(name: str, metric: Callable[[DataFrame], DataFrame]) -> None:
    """Add a metric: a table of predictions and references to a one-row table of values.

    It reads the table on its own; ``register_parts`` adds one that does not.
    """
    IN_ONE_PASS.pop(name, None)
    METRICS[name] = metric


def register_parts(name: str, parts: Callable[[], MetricParts]) -> None:
    """Add a metric made of parts, which is worked out in one pass with others of its kind."""
    METRICS.pop(name, None)
    IN_ONE_PASS[name] = parts


def evaluate(df: DataFrame | None, metrics: list[str]) -> DataFrame:
    """The chosen metrics as ``(metric, value)``; unknown names are skipped with a warning.

    All metrics made of parts share one scan of the table.
    """
    if df is None:
        raise ValueError("there is no evaluation split to evaluate")
    rows, parts = [], []
    for name in dict.fromkeys(metrics):
        if name in IN_ONE_PASS:
            parts.append(IN_ONE_PASS[name]())
        elif name in METRICS:
            rows.append(METRICS[name](df))
        else:
            warnings.warn(f"metric {name!r} is not registered and is left out", stacklevel=2)
    if parts:
        rows.insert(0, in_one_pass(df, parts))
    tables = []
    for row in rows:
        pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns]
        tables.append(row.select(F.inline(F.array(*pairs))))
    if not tables:
        return df.sparkSession.createDataFrame([], "metric string, value double")
    return reduce(DataFrame.unionByName, tables)


def evaluate_generation(
    df: DataFrame, make_predict_fn: Callable[[], Callable[[list], list]], metrics: list[str],
    text: str = "text", batch_size: int = 64, keep: tuple[str, ...] = (), path: str | None = None,
) -> DataFrame:
    """Texts cut to prompts, answered by a model, cleared of the echo and scored: ``(metric, value)``.

    The model's answers are written to the shared folder once and read by every
    metric. With ``path`` the values are written there as JSON lines as well.
    """
    prompts = cut_prompt(df, text, keep=keep).withColumnRenamed("target", "reference")
    answered = batch_predict(prompts, "prompt", make_predict_fn, batch_size)
    scored = strip_prompt(answered, output="response", keep=(*keep, "reference"))
    values = evaluate(materialize(scored, "predictions"), metrics)
    if path is None:
        return values
    write_metrics(values, path)
    return df.sparkSession.read.schema("metric string, value double").json(path)
