"""Removal of word windows that occur more than once, behind a count-min prefilter.

A window of n words is keyed for the sketch by its minimiser: the first smallest fingerprint of
the k-word runs in it. Equal windows have their minimiser at the same offset, so the sketch
counts of minimiser places (about one in ten words) are never below those of the windows. The
first pass counts them: each partition's sketch is merged into one of fixed size. The second
pass takes the windows estimated repeated and groups them exactly (96-bit fingerprints); a key
goes to its reducer once per batch of documents, and a bit comes back, so a passage that a third
of all documents share is no large group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, sketch, written
from .words import NON_BLANK, U64, Words, covered, inside, minimiser_at, mix, rolling, runs, segments

GRAM = 16
#: Cells of the sketch; one bit each is broadcast (64 MB). More input than it suits only sends more windows to the exact pass.
CELLS = 1 << 29
#: Flagged windows of one batch.
BATCH = 1 << 20

TABLE = "route long, batch long, bucket long, n long, a binary, b binary, many binary, ids array<{kind}>, keys array<long>, words array<int>, counts array<int>, places binary, uids binary"


def minimisers(words: Words, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of k-word runs, each n-word window's minimiser place, and which windows lie in one text."""
    grams = rolling(words.hashes(), k)
    return grams, minimiser_at(grams, n - k + 1) if len(words) >= n else np.zeros(0, np.int64), inside(words, n)


def places_counted(n: int, k: int):
    """For sketch(): the fingerprints at the minimiser places of every segment."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, texts in segments(batches, "_text"):
            grams, at, ok = minimisers(Words(texts, NON_BLANK), n, k)
            at = at[ok]
            yield mix(grams[at[np.concatenate([[True], at[1:] != at[:-1]])]]) if len(at) else np.zeros(0, np.uint64)

    return values


def source(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """Columns _id, _key (hash of the text) and _text."""
    return df.select(F.col(row_id).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_key"), F.col(text).alias("_text"))


def by_bucket(bucket: np.ndarray) -> list[tuple[int, slice]]:
    """Runs of equal values of a sorted array."""
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    return [(int(bucket[a]), slice(a, b)) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _flagged(df: DataFrame, n: int, k: int, known: object, buckets: int, kind: str) -> DataFrame:
    """Per batch one row of documents with their flagged windows, and rows of distinct window keys by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        schema, turn = None, 0
        a, b, place, ids, keys, sizes, counts, held = [], [], [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal a, b, place, ids, keys, sizes, counts, held, turn
            x, y = np.concatenate(a), np.concatenate(b)
            bucket = (x % U64(buckets)).astype(np.int64)
            order = np.lexsort((y, x, bucket))
            x, y, bucket = x[order], y[order], bucket[order]
            new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            uid = np.empty(len(x), dtype=np.uint32)
            uid[order] = np.cumsum(new) - 1
            many = np.diff(np.concatenate([np.flatnonzero(new), [len(x)]])) > 1
            x, y, bucket = x[new], y[new], bucket[new]
            number = (part << 24) + turn
            rows = [dict(route=u, batch=number, bucket=u, n=s.stop - s.start, a=x[s].tobytes(), b=y[s].tobytes(), many=np.packbits(many[s]).tobytes()) for u, s in by_bucket(bucket)]
            rows.append(dict(route=-1 - number, batch=number, bucket=-1, n=0, ids=sum((i.to_pylist() for i in ids), []), keys=np.concatenate(keys).tolist(), words=np.concatenate(sizes).tolist(), counts=np.concatenate(counts).tolist(), places=np.concatenate(place).astype(np.uint32).tobytes(), uids=uid.tobytes()))
            a, b, place, ids, keys, sizes, counts, held, turn = [], [], [], [], [], [], [], 0, turn + 1
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch, texts in segments(batches, "_text"):
            schema = schema or pa.schema([("route", pa.int64()), ("batch", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("many", pa.binary()), ("ids", pa.list_(batch.column(0).type)), ("keys", pa.list_(pa.int64())), ("words", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("places", pa.binary()), ("uids", pa.binary())])
            words = Words(texts, NON_BLANK)
            grams, at, ok = minimisers(words, n, k)
            window = np.flatnonzero(ok)
            if not len(window):
                continue
            window = window[known.value.holds(mix(grams[at[window]]))]
            if not len(window):
                continue
            a.append(rolling(words.hashes(1), n, 21)[window])
            b.append((rolling(words.hashes(2), n, 22)[window] >> U64(32)).astype(np.uint32))
            doc = words.doc[window]
            place.append(window - words.first[doc])
            count = np.bincount(doc, minlength=len(texts))
            some = np.flatnonzero(count)
            ids.append(batch.column(0).take(pa.array(some)))
            keys.append(batch.column(1).to_numpy()[some])
            sizes.append(words.count[some])
            counts.append(count[some])
            held += len(window)
            if held >= BATCH:
                yield flush()
        if held:
            yield flush()

    return df.mapInArrow(run, TABLE.format(kind=kind))


def _grouped(flagged: DataFrame, tasks: int, kind: str) -> DataFrame:
    """Key rows become bits (in `many`): which keys occur more than once in all; document rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            bucket = batch.column(2).to_numpy()
            if (bucket < 0).any():
                yield batch.filter(pa.array(bucket < 0))
            for u, number, n, *arrays in batch.filter(pa.array(bucket >= 0)).select(["bucket", "batch", "n", "a", "b", "many"]).to_pandas().itertuples(index=False):
                held.setdefault(u, []).append((number, n, *arrays))
        while held:
            u, rows = held.popitem()
            sizes = [r[1] for r in rows]
            x = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
            y = np.concatenate([np.frombuffer(r[3], np.uint32) for r in rows])
            twice = np.concatenate([np.unpackbits(np.frombuffer(r[4], np.uint8), count=r[1]) for r in rows]).astype(bool)
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            same = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
            twice[order] |= np.concatenate([[False], same]) | np.concatenate([same, [False]])
            out, at = [], 0
            for (number, *_), n in zip(rows, sizes, strict=True):
                out.append(dict(route=-1 - number, batch=number, bucket=u, n=n, many=np.packbits(twice[at : at + n]).tobytes()))
                at += n
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return flagged.repartition(tasks, "route").mapInArrow(run, TABLE.format(kind=kind))


def repeated(df: DataFrame, n: int = 35, k: int = GRAM, cells: int = CELLS, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows _id, _key, removed: runs of words covered by repeated windows, for documents that have any.

    removed holds begins, then ends, as unsigned 32-bit numbers.
    """
    spark = df.sparkSession
    own = source(df, row_id, text)
    kind = df.schema[row_id].dataType.simpleString()
    known, counted = sketch(own, places_counted(n, k), cells, 2)
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(base, counted * 8 // 2_000_000)
    table = written(_grouped(_flagged(own, n, k, known, 4 * tasks, kind), tasks, kind), "window-groups")
    bits = table.filter("bucket >= 0").groupBy("batch").agg(F.collect_list(F.struct("bucket", "n", "many")).alias("bits"))  # one short row a bucket
    both = table.filter("bucket < 0").select("batch", "ids", "keys", "words", "counts", "places", "uids").join(bits, "batch").drop("batch")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].values
                keys, sizes, counts = (batch.column(c)[i].values.to_numpy() for c in (1, 2, 3))
                place, uid = (np.frombuffer(batch.column(c)[i].as_py(), np.uint32) for c in (4, 5))
                parts = sorted(batch.column(6)[i].as_py(), key=lambda x: x["bucket"])
                twice = np.concatenate([np.unpackbits(np.frombuffer(p["many"], np.uint8), count=p["n"]) for p in parts]).astype(bool)[uid]
                out, hit, at = [], [], 0
                for j, (m, c) in enumerate(zip(sizes.tolist(), counts.tolist(), strict=True)):
                    starts = place[at : at + c][twice[at : at + c]]
                    at += c
                    if len(starts):
                        out.append(np.concatenate(runs(covered(m, starts.astype(np.int64), n))).astype(np.uint32).tobytes())
                        hit.append(j)
                if hit:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(hit)), pa.array(keys[hit]), pa.array(out, pa.binary())], names=["_id", "_key", "removed"])

    return both.mapInArrow(mark, f"_id {kind}, _key long, removed binary").groupBy("_id", "_key").agg(F.first("removed").alias("removed"))


def beside(df: DataFrame, found: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the found columns of the row with its id and text (null: none)."""
    own, other = free_name(df, "found_id"), free_name(df, "found_key")
    right = found.withColumnRenamed("_id", own).withColumnRenamed("_key", other)
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return df.join(right, F.col(row_id).eqNullSafe(F.col(own)) & (key == F.col(other)), "left").drop(own, other)


def remove_repeated(df: DataFrame, n: int = 35, k: int = GRAM, cells: int = CELLS, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: row_id, n_words, n_removed, kept_text (the words left, joined by one space).

    Words are cut at ASCII white space and not changed. Null and empty texts have no words and an
    empty kept_text. A text of fewer than n words loses nothing. Repeated rows are copies of each
    other, so each loses all its windows; null and repeated ids are kept. An empty table gives no
    rows; extra columns are left out.
    """
    kind = df.schema[row_id].dataType.simpleString()
    small = df.select(F.col(row_id).alias("_row"), F.col(text).alias("_text"))
    both = beside(small, repeated(df, n, k, cells, row_id, text), "_row", "_text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in segments(batches, "_text"):
            total, gone, kept = [], [], []
            for t, r in zip(texts, batch.column(2).to_pylist(), strict=True):
                words = t.split()
                total.append(len(words))
                if r:
                    begin, end = np.frombuffer(r, np.uint32).reshape(2, -1).tolist()
                    left, at = [], 0
                    for b, e in zip(begin, end, strict=True):
                        left += words[at:b]
                        at = e
                    words = left + words[at:]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["_id", "n_words", "n_removed", "kept_text"])

    return both.select("_row", "_text", "removed").mapInArrow(cut, f"_id {kind}, n_words long, n_removed long, kept_text string").withColumnRenamed("_id", row_id)
