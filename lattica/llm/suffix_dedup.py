"""Repeated passages by a sparse suffix array over content-selected places.

Only suffixes that begin at minimisers are kept: of each n-word window the first smallest
fingerprint of its k-word runs. Any passage of n words has one, at the same place in each copy.
Each suffix goes with the words around it to where others meet it. There the suffixes are sorted
by their words, and neighbours are compared: from the lengths that neighbours have in common
follow all runs of suffixes that agree for a number of words. The same is done with what comes
before the suffixes, read backwards, so that matches are extended to the left. Places whose two
runs agree for n words in all hold a repeated passage; longer matches are the unions of those of
the minimisers within them, so n words around a place are enough whatever a match's length.

A suffix goes two ways: with the words to its right, for passages that have less than half of
their possible extension to the left, and with those to its left, for the others. So where a
few words are very common, what meets has about 30 words in common, not k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, sketch, written
from .substring_dedup import beside, by_bucket, minimisers, places_counted
from .words import NON_BLANK, U64, Words, covered, lean, mix, runs, segments

PASSAGE = 50
GRAM = 8
#: Cells of the sketch of minimisers (32 MB broadcast); more input than it suits only sends more suffixes to be sorted.
CELLS = 1 << 28
#: Suffixes of one batch, and suffixes that are sorted at once.
BATCH, SORTED = 50_000, 1 << 15

TABLE = "route long, batch long, bucket long, n long, suffixes binary, context binary, bits binary, ids array<{kind}>, keys array<long>, words array<int>, counts array<int>, places binary, uids binary"
#: A distinct suffix of a batch: way (0: by its right, 1: by its left words), fingerprint of the words that meet, least and most
#: left extension, whether it occurs twice, and its first occurrence.
SUFFIX = np.dtype([("way", "u1"), ("key", "<u8"), ("low", "u1"), ("high", "u1"), ("many", "u1"), ("doc", "<i8"), ("at", "<u4")])


class Ways:
    """Which left extensions and which words around a suffix each of both ways has."""

    def __init__(self, n: int, k: int):
        self.n, self.left = n, n - k
        self.half = (n - k) // 2
        self.width = max(self.half + n, self.left + n - self.half)
        #: for each way its extensions, the column of the suffix's first word, and the words that all its passages have
        self.extensions = range(self.half), range(self.half, self.left + 1)
        self.place = self.half, self.left
        self.common = range(n - self.half + 1), range(-self.half, k)

    def context(self, way: int, h: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """32 bits of each word around the places p that lies in a passage (else 0), and fingerprints of the words that all passages have."""
        offset = np.arange(self.width) - self.place[way]
        valid = (offset >= -high[:, None]) & (offset < self.n - low[:, None])
        words = np.where(valid, h[np.clip(p[:, None] + offset, 0, len(h) - 1)], 0).astype(np.uint32)
        at = self.place[way] + np.array(self.common[way])
        key = np.full(len(p), way, dtype=np.uint64)
        for column in at.tolist():
            key = mix(key + words[:, column].astype(np.uint64))
        return words, key


def _sorted(key: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's place in the order by key and words, and the words that each row of that order has in common with the one before (-1: another key)."""
    line = np.concatenate([key.astype(">u8")[:, None].view(np.uint8), np.ascontiguousarray(words.astype(">u4")).view(np.uint8)], axis=1)
    order = np.argsort(line.view(f"S{line.shape[1]}").ravel(), kind="stable")
    key, words = key[order], words[order]
    differ = words[1:] != words[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1])
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return place, np.concatenate([[-1], np.where(key[1:] == key[:-1], common, -1)])


def compared(s: np.ndarray, context: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the suffixes the left extensions (bits) whose n words occur again among them, and those whose first place it is."""
    ways = Ways(n, k)
    repeat, leads = np.zeros(len(s), np.uint64), np.zeros(len(s), np.uint64)
    order = np.lexsort((s["at"], s["doc"], s["key"], s["way"]))
    x = s[order]
    same = (x["key"][1:] == x["key"][:-1]) & (x["way"][1:] == x["way"][:-1])
    rows = order[np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (x["many"] > 0)]
    x = s[rows]
    begins = np.flatnonzero(np.concatenate([[True], (x["key"][1:] != x["key"][:-1]) | (x["way"][1:] != x["way"][:-1])])) if len(rows) else np.zeros(0, np.int64)
    turns = np.flatnonzero(np.concatenate([[True], (begins[1:] // SORTED != begins[:-1] // SORTED) | (x["way"][begins[1:]] != x["way"][begins[:-1]])])) if len(rows) else []
    cuts = [*begins[turns].tolist(), len(rows)] if len(rows) else [0]
    for b, e in zip(cuts[:-1], cuts[1:], strict=True):
        r, part = rows[b:e], x[b:e]
        way = int(part["way"][0])
        words, z = context[r], ways.place[way]
        right, after = _sorted(part["key"], words[:, z:])
        left, before = _sorted(part["key"], words[:, :z][:, ::-1])
        for o in ways.extensions[way]:
            use = np.flatnonzero((part["low"] <= o) & (part["high"] >= o))
            if not len(use):
                continue
            run = np.cumsum(after < n - o)[right[use]] * np.int64(len(r) + 1) + np.cumsum(before < o)[left[use]]
            by = np.argsort(run, kind="stable")  # rows are in the order of their first occurrences
            equal = run[by][1:] == run[by][:-1]
            twice = np.concatenate([[False], equal]) | np.concatenate([equal, [False]]) | (part["many"][use[by]] > 0)
            bit = np.uint64(1) << np.uint64(o)
            repeat[r[use[by[twice]]]] |= bit
            leads[r[use[by[np.concatenate([[True], ~equal])]]]] |= bit
    return repeat, leads


def _suffixes(df: DataFrame, n: int, k: int, known: object, buckets: int, kind: str) -> DataFrame:
    ways = Ways(n, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        factors = np.random.default_rng(5).integers(1, 2**63, ways.width, dtype=np.uint64) * U64(2) + U64(1)
        schema, turn = None, 0
        suffix, context, place, ids, keys, sizes, counts, held = [], [], [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal suffix, context, place, ids, keys, sizes, counts, held, turn
            s, c = np.concatenate(suffix), np.concatenate(context)
            bucket = (s["key"] % U64(buckets)).astype(np.int64)
            whole = mix((c.astype(np.uint64) * factors).sum(axis=1, dtype=np.uint64) + s["low"].astype(np.uint64) * U64(257) + s["high"])
            order = np.lexsort((s["at"], s["doc"], whole, s["way"], s["key"], bucket))
            s, c, bucket, whole = s[order], c[order], bucket[order], whole[order]
            new = np.concatenate([[True], (s["key"][1:] != s["key"][:-1]) | (s["way"][1:] != s["way"][:-1]) | (whole[1:] != whole[:-1]) | (c[1:] != c[:-1]).any(axis=1)])
            number_of = np.cumsum(new) - 1
            uid = np.empty(len(s), dtype=np.uint32)
            # the lowest bit: the first occurrence of its suffix in this batch
            uid[order] = (number_of << 1 | new).astype(np.uint32)
            s["many"][new] = np.diff(np.concatenate([np.flatnonzero(new), [len(s)]])) > 1
            s, c, bucket = s[new], c[new], bucket[new]
            number = (part << 24) + turn
            rows = [dict(route=u, batch=number, bucket=u, n=x.stop - x.start, suffixes=s[x].tobytes(), context=c[x].tobytes()) for u, x in by_bucket(bucket)]
            rows.append(dict(route=-1 - number, batch=number, bucket=-1, n=0, ids=sum((i.to_pylist() for i in ids), []), keys=np.concatenate(keys).tolist(), words=np.concatenate(sizes).tolist(), counts=np.concatenate(counts).tolist(), places=np.concatenate(place).astype(np.uint32).tobytes(), uids=uid.tobytes()))
            suffix, context, place, ids, keys, sizes, counts, held, turn = [], [], [], [], [], [], [], 0, turn + 1
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch, texts in segments(batches, "_text", 1 << 19):
            schema = schema or pa.schema([(x, pa.int64()) for x in ("route", "batch", "bucket", "n")] + [(x, pa.binary()) for x in ("suffixes", "context", "bits")] + [("ids", pa.list_(batch.column(0).type)), ("keys", pa.list_(pa.int64())), ("words", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("places", pa.binary()), ("uids", pa.binary())])
            words = Words(texts, NON_BLANK)
            grams, at, ok = minimisers(words, n, k)
            start = np.flatnonzero(ok)
            if not len(start):
                continue
            at = at[start]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            last = np.concatenate([first[1:], [len(at)]]) - 1
            p, high, low = at[first], at[first] - start[first], at[first] - start[last]
            hit = known.value.holds(mix(grams[p]))
            p, high, low = p[hit], high[hit], low[hit]
            if not len(p):
                continue
            h = (words.hashes() >> U64(32)).astype(np.uint32)
            each = []
            for way, extensions in enumerate(ways.extensions):
                some = np.flatnonzero((low < extensions.stop) & (high >= extensions.start))
                lo, hi = np.maximum(low[some], extensions.start), np.minimum(high[some], extensions.stop - 1)
                c, key = ways.context(way, h, p[some], lo, hi)
                s = np.zeros(len(some), dtype=SUFFIX)
                s["way"], s["key"], s["low"], s["high"] = way, key, lo, hi
                doc = words.doc[p[some]]
                s["doc"], s["at"] = batch.column(3).to_numpy()[doc], p[some] - words.first[doc]
                each.append((s, c, doc))
            s, c, doc = (np.concatenate(x) for x in zip(*each, strict=True))
            order = np.argsort(doc, kind="stable")
            s, c, doc = s[order], c[order], doc[order]
            suffix.append(s)
            context.append(c)
            place.append(s["at"])
            count = np.bincount(doc, minlength=len(texts))
            some = np.flatnonzero(count)
            ids.append(batch.column(0).take(pa.array(some)))
            keys.append(batch.column(1).to_numpy()[some])
            sizes.append(words.count[some])
            counts.append(count[some])
            held += len(s)
            if held >= BATCH:
                yield flush()
        if held:
            yield flush()

    return df.mapInArrow(lean(run), TABLE.format(kind=kind))


def _compared(suffixes: DataFrame, n: int, k: int, tasks: int, kind: str) -> DataFrame:
    """The bits of compared() for each batch's suffixes; rows of documents pass."""
    width = Ways(n, k).width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            bucket = batch.column(2).to_numpy()
            if (bucket < 0).any():
                yield batch.filter(pa.array(bucket < 0))
            for u, number, m, s, c in zip(*(x.to_pylist() for x in batch.filter(pa.array(bucket >= 0)).select(["bucket", "batch", "n", "suffixes", "context"]).columns), strict=True):
                held.setdefault(u, []).append((number, m, s, c))
        while held:
            u, rows = held.popitem()
            s = np.concatenate([np.frombuffer(r[2], SUFFIX) for r in rows])
            c = np.concatenate([np.frombuffer(r[3], np.uint32).reshape(-1, width) for r in rows])
            repeat, leads = compared(s, c, n, k)
            out, at = [], 0
            for number, m, *_ in rows:
                out.append(dict(route=-1 - number, batch=number, bucket=u, n=m, bits=np.stack([repeat[at : at + m], leads[at : at + m]]).tobytes()))
                at += m
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return suffixes.repartition(tasks, "route").mapInArrow(lean(run), TABLE.format(kind=kind))


def passages(df: DataFrame, n: int = PASSAGE, k: int = GRAM, cells: int = CELLS, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows _id, _key, repeated, removed for texts with passages of n words or more that occur elsewhere.

    repeated: runs of words in such passages; removed: those of them that aren't the passage's
    first occurrence (by row id, then place). Each holds begins, then ends, as unsigned 32-bit
    numbers. Words are cut at ASCII white space; null and empty texts and texts under n words have
    none; long texts are read whole. Repeated rows are copies of each other; null ids come last in
    the order, and ties of the order keep either. An empty table has none; extra columns are left out.
    """
    if not k < n < 64 + k:
        raise ValueError("passages of more than k and less than 64 + k words are compared")
    spark = df.sparkSession
    kind = df.schema[row_id].dataType.simpleString()
    rank = F.col(row_id).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(row_id)
    own = df.select(F.col(row_id).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_key"), F.col(text).alias("_text"), F.coalesce(rank, F.lit(2**63 - 1)).alias("_rank"))
    known, counted = sketch(own.select("_text"), places_counted(n, k), cells, 2)
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(base, counted // 25_000)
    table = written(_compared(_suffixes(own, n, k, known, 4 * tasks, kind), n, k, tasks, kind), "suffix-groups")
    bits = table.filter("bucket >= 0").groupBy("batch").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias("parts"))  # one row a bucket, of at most BATCH suffixes
    both = table.filter("bucket < 0").select("batch", "ids", "keys", "words", "counts", "places", "uids").join(bits, "batch").drop("batch")
    left = n - k

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].values
                keys, sizes, counts = (batch.column(c)[i].values.to_numpy() for c in (1, 2, 3))
                place, uid = (np.frombuffer(batch.column(c)[i].as_py(), np.uint32) for c in (4, 5))
                parts = sorted(batch.column(6)[i].as_py(), key=lambda x: x["bucket"])
                repeat, leads = np.concatenate([np.frombuffer(p["bits"], np.uint64).reshape(2, -1) for p in parts], axis=1)
                which = (uid >> 1).astype(np.int64)
                repeat = repeat[which]
                leads = np.where(uid & 1 == 1, leads[which], U64(0))
                doc = np.repeat(np.arange(len(counts)), counts)
                rows: list[list] = [[], [], []]
                some = np.flatnonzero(repeat)
                owner, at = [], []
                gone = []
                for o in range(left + 1):
                    b = U64(1) << U64(o)
                    hit = some[(repeat[some] & b) > 0]
                    owner.append(doc[hit])
                    at.append(place[hit].astype(np.int64) - o)
                    gone.append((leads[hit] & b) == 0)
                owner, at, gone = np.concatenate(owner), np.concatenate(at), np.concatenate(gone)
                by = np.argsort(owner, kind="stable")
                owner, at, gone = owner[by], at[by], gone[by]
                for d, x in by_bucket(owner) if len(owner) else []:
                    m = int(sizes[d])
                    rows[0].append(d)
                    rows[1].append(np.concatenate(runs(covered(m, at[x], n))).astype(np.uint32).tobytes())
                    rows[2].append(np.concatenate(runs(covered(m, at[x][gone[x]], n))).astype(np.uint32).tobytes())
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[0])), pa.array(keys[rows[0]]), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], names=["_id", "_key", "repeated", "removed"])

    return both.mapInArrow(lean(mark), f"_id {kind}, _key long, repeated binary, removed binary")


def spans(found: DataFrame, row_id: str = "doc_id") -> DataFrame:
    """One row per repeated passage: row_id, first_word, n_words, n_removed (its words that are not a first occurrence)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i, (r, g) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                b, e = np.frombuffer(r, np.uint32).reshape(2, -1).astype(np.int64)
                gb, ge = np.frombuffer(g, np.uint32).reshape(2, -1).astype(np.int64)
                gone = np.zeros(int(e[-1]) + 1, dtype=np.int64)
                for x, y in zip(gb.tolist(), ge.tolist(), strict=True):
                    gone[x:y] = 1
                sums = np.concatenate([[0], np.cumsum(gone)])
                for x, y in zip(b.tolist(), e.tolist(), strict=True):
                    for column, value in zip(out, (i, x, y - x, int(sums[y] - sums[x])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out[0], pa.int64())), *(pa.array(c, pa.int64()) for c in out[1:])], names=["_id", "first_word", "n_words", "n_removed"])

    kind = found.schema["_id"].dataType.simpleString()
    return found.select("_id", "repeated", "removed").mapInArrow(lean(run), f"_id {kind}, first_word long, n_words long, n_removed long").withColumnRenamed("_id", row_id)


def without_repeats(df: DataFrame) -> DataFrame:
    """The rows of df with later occurrences of repeated passages cut out of `text`; all columns stay.

    n_chars, where there is such a column, becomes the length of the text that is left. A text
    keeps its white space but for that after words which go. Rows without a removed passage are
    unchanged, nulls included; a text of which nothing is left stays as an empty one. Rows that
    repeat both id and text are one document, which keeps what its first row keeps. Long texts
    are read whole; an empty table stays empty; extra columns may have any names.
    """
    gone_words = free_name(df, "removed")
    # texts that occur twice give several equal-keyed rows: one whose words are all kept is the first
    found = passages(df).groupBy("_id", "_key").agg(F.min_by("removed", F.struct(F.length("removed"), "removed")).alias(gone_words))
    both = beside(df, found.filter(F.length(gone_words) > 0))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            gone = batch.column(batch.schema.get_field_index(gone_words)).to_pylist()
            texts = batch.column(at).to_pylist()
            for i, r in enumerate(gone):
                if r:
                    words = Words([texts[i].encode()], NON_BLANK)
                    b, e = np.frombuffer(r, np.uint32).reshape(2, -1).tolist()
                    edge = [*words.start.tolist(), len(words.data) - 1]
                    left, place = [], 0
                    for x, y in zip(b, e, strict=True):
                        left.append(words.data[place : edge[x]])
                        place = edge[y]
                    texts[i] = b"".join([*left, words.data[place:-1]]).decode()
            columns = [pa.array(texts, batch.schema.field(at).type) if j == at else c for j, c in enumerate(batch.columns) if batch.schema.names[j] != gone_words]
            yield pa.RecordBatch.from_arrays(columns, names=[x for x in batch.schema.names if x != gone_words])

    out = both.mapInArrow(lean(cut), df.schema)
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(df.schema["n_chars"].dataType))
    return out
