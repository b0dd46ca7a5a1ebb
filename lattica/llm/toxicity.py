"""Toxicity by discounted log ratios of class-conditional continuation counts with backoff.

An expression is a word or a beginning of one; the counts are continuation counts, the number of
documents of a class that an expression occurs in, so that a document which repeats itself counts
once. A word is scored at the longest of its expressions that differs between the classes or is
not rare: the class count less a discount (as large as the noise of the count) above or below what
the counts shared by both classes lead to expect. The score is the length-normalised sum of the log
ratios. In this it departs from interpolated Kneser-Ney models: no class probabilities are built,
and differences within the noise count as none instead of being smoothed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, sketch, written
from .words import ALNUM, U64, Words, mix, segments

#: Bytes of word beginnings, longest first; 0 stands for the whole word.
PREFIXES = (0, 9, 8, 7, 6, 5, 4)
#: Documents from which on an expression without a difference ends the search for one, and the discount in standard deviations.
RARE, DISCOUNT = 10, 3.0
#: Labelled rows that the final calibration is fitted on, at most.
CALIBRATION_ROWS = 4000


def _expressions(words: Words, take: np.ndarray) -> np.ndarray:
    """For each taken word its expressions' fingerprints, a column for each of PREFIXES (0: none)."""
    out = np.zeros((len(take), len(PREFIXES)), dtype=np.uint64)
    texts = [words.word(i) for i in take.tolist()]
    for c, size in enumerate(PREFIXES):
        cut = Words([t[:size] if size else t for t in texts], ALNUM)
        # every text is one word; shorter words have no such beginning
        long_enough = np.array([len(t) >= size for t in texts], dtype=bool)
        out[:, c] = np.where(long_enough, mix(cut.hashes() + U64(size)), U64(0)) if len(cut) == len(texts) else 0
    return out


def _distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct word, and each word's number among them."""
    _, first, number = np.unique(words.hashes(), return_index=True, return_inverse=True)
    return first, number


def _among(grams: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which fingerprints are in the sorted array `known`."""
    return known[np.minimum(np.searchsorted(known, grams), len(known) - 1)] == grams


def _counts(train: DataFrame, below: object = None) -> DataFrame:
    """Rows gram, toxic, ordinary: documents of each class by expression, summed within tasks.

    With `below`, a broadcast sorted array of expressions: only others that have a shorter beginning there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            gram, toxic = (np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
            unique, number = np.unique(gram, return_inverse=True)
            a = np.bincount(number, weights=toxic, minlength=len(unique)).astype(np.int64)
            n = np.bincount(number, minlength=len(unique)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(a), pa.array(n - a)], names=["gram", "toxic", "ordinary"])

        for batch, texts in segments(batches, "_text"):
            words = Words(texts, ALNUM, lower=True)
            if not len(words):
                continue
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            first, number = _distinct(words)
            grams = _expressions(words, first)
            if below is not None:
                hit = _among(grams, below.value)
                shorter = np.zeros_like(hit)
                for c in reversed(range(len(PREFIXES) - 1)):
                    shorter[:, c] = shorter[:, c + 1] | hit[:, c + 1]
                grams = np.where(shorter & ~hit, grams, U64(0))
            pair = np.unique(words.doc.astype(np.int64) * len(first) + number)
            doc, word = pair // len(first), pair % len(first)
            for c in range(len(PREFIXES)):
                g = grams[word, c]
                some = g != 0
                d, g = doc[some], g[some]
                order = np.lexsort((g, d))
                d, g = d[order], g[order]
                new = np.concatenate([[True], (d[1:] != d[:-1]) | (g[1:] != g[:-1])]) if len(g) else np.zeros(0, bool)
                held.append((g[new], toxic[d[new]]))
                size += int(new.sum())
            if size > 4_000_000:
                yield flush()
        if held:
            yield flush()

    return train.select("toxic", "_text").mapInArrow(run, "gram long, toxic long, ordinary long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


class Model:
    """Log-likelihood differences (toxic less ordinary) of the expressions that can change a score."""

    def __init__(self, grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, n_toxic: int, n_ordinary: int):
        order = np.argsort(grams)
        self.grams = grams[order]
        shared = (toxic + ordinary)[order].astype(np.float64)
        log = []
        for count, n in ((toxic[order], n_toxic), (ordinary[order], n_ordinary)):
            expected = shared * n / max(1, n_toxic + n_ordinary)
            away = count - expected
            kept = np.sign(away) * np.maximum(np.abs(away) - DISCOUNT * np.sqrt(expected + 0.5), 0)
            log.append(np.log((expected + kept + 0.5) / (expected + 0.5)))
        self.difference = np.where(log[0] * log[1] < 0, log[0] - log[1], np.where(log[0] > 0, log[0], 0.0) + np.where(log[0] < 0, log[0], 0.0))

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Per text the sum of differences over words, divided by their number and by its root."""
        words = Words(texts, ALNUM, lower=True)
        if not len(words) or not len(self.grams):
            return np.zeros((len(texts), 2))
        first, number = _distinct(words)
        grams = _expressions(words, first)
        score, open_ = np.zeros(len(first)), np.ones(len(first), dtype=bool)
        for c in range(len(PREFIXES)):
            at = np.minimum(np.searchsorted(self.grams, grams[:, c]), len(self.grams) - 1)
            hit = open_ & (self.grams[at] == grams[:, c])
            score[hit] = self.difference[at[hit]]
            open_ &= ~hit
        total = np.bincount(words.doc, weights=score[number], minlength=len(texts))
        n = np.maximum(words.count, 1)
        return np.stack([total / n, total / np.sqrt(n)], axis=1)


def _model(train: DataFrame, n_toxic: int, n_all: int) -> Model:
    """The model of all expressions, without those that leave all scores as they are.

    Only expressions with a difference add to a score, however few documents they are in. One without
    a difference is needed only if a shorter beginning has one and it is not rare, since it keeps the
    word from being scored there; a rare one leaves the word to its beginnings.
    """
    texts = written(train, "toxicity-train")
    shared = F.col("toxic") + F.col("ordinary")
    expected = shared * n_toxic / max(1, n_all)
    differs = F.abs(F.col("toxic") - expected) > DISCOUNT * F.sqrt(expected + 0.5)
    parts = [_counts(texts).filter(differs).toArrow()]
    if parts[0].num_rows:
        known = texts.sparkSession.sparkContext.broadcast(np.sort(parts[0].column(0).to_numpy().view(np.uint64)))
        parts.append(_counts(texts, known).filter(shared >= RARE).toArrow())
    drop_table(texts)
    rows = pa.concat_tables(parts)
    gram, toxic, ordinary = (rows.column(c).to_numpy() for c in range(3))
    return Model(gram.view(np.uint64), toxic, ordinary, n_toxic, n_all - n_toxic)


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on both features and 1, by Newton steps with a small ridge."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        ridge = np.array([1e-3, 1e-3, 1e-6])
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def scored(df: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: row_id, held_out, score, predicted.

    Learns from labelled rows whose crc32(id as text) mod 5 is not 0, nothing else of a row but
    its text. Null ids are not held out and have no label; null labels are no labels; an id
    labelled more than once counts as toxic if any label is. Null and empty texts get the score
    that no evidence leads to. Without a label of both classes every score is 0. Repeated rows
    each get a row; an empty table gives none. Extra columns are left out.
    """
    spark = df.sparkSession
    fold = F.coalesce(F.pmod(F.crc32(F.col(row_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    marked = labels.filter(F.col(row_id).isNotNull() & F.col("toxic").isNotNull() & ~fold).groupBy(F.col(row_id).alias("_id")).agg((F.max("toxic") > 0).cast("long").alias("toxic"))

    def tags(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield mix(batch.column(0).to_numpy().view(np.uint64))

    # a bitmap of labelled ids keeps other texts from being shuffled
    among, _ = sketch(marked.select(F.xxhash64("_id").alias("tag")), tags, 1 << 24, 1)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = among.value.holds(mix(batch.column(1).to_numpy().view(np.uint64)))
            if hit.any():
                part = batch.filter(pa.array(hit))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2)], names=["_row", "_text"])

    kind = df.schema[row_id].dataType.simpleString()
    picked = df.select(F.col(row_id).alias("_row"), F.xxhash64(row_id).alias("tag"), F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(pick, f"_row {kind}, _text string")
    # one plan at every size: labels grow with the input, so they are merged, never broadcast
    train = picked.join(marked.hint("merge"), F.col("_row") == F.col("_id")).select("toxic", "_text")
    sizes = marked.agg(F.sum("toxic"), F.count("*")).first()
    n_toxic, n_all = sizes[0] or 0, sizes[1]
    model = _model(train, n_toxic, n_all)
    weights = None
    if 0 < n_toxic < n_all:
        some = {r["_id"]: r["toxic"] for r in marked.orderBy(F.xxhash64("_id"), "_id").limit(CALIBRATION_ROWS).collect()}
        rows = df.filter(F.col(row_id).isin(list(some))).select(row_id, text).toArrow()
        x = [model.features(texts) for _, texts in segments(iter(rows.to_batches()), text)]
        y = np.array([some[i] for i in rows.column(0).to_pylist()], dtype=np.float64)
        if x and 0 < y.sum() < len(y):
            weights = _calibrate(np.concatenate(x), y)
    shared = spark.sparkContext.broadcast((model, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = shared.value
        for batch, texts in segments(batches, "_text"):
            x = known.features(texts)
            p = np.zeros(len(texts)) if w is None else 1 / (1 + np.exp(-np.clip(x @ w[:2] + w[2], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["_row", "held_out", "score", "predicted"])

    out = df.select(F.col(row_id).alias("_row"), fold.alias("held_out"), F.col(text).alias("_text")).mapInArrow(score, f"_row {kind}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("_row", row_id)
