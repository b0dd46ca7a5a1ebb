"""Packing token sequences by minimum bin slack.

Documents are tokenised and cut at multiples of the capacity; what remains of each is an item.
Items are known to the driver only as counts by length (at most `capacity` numbers). Windows are
filled largest item first: a bitset subset-sum over the remaining lengths finds the multiset that
comes closest to the room left, and a pattern that is found is used as often as its counts allow.
Where no multiset fits exactly, one more item is cut to fill the gap. The last tokens, fewer than
a window, go to windows whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import bisect
import os
import string
import threading
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cells_for, drop_table, sketch, written
from .words import _give_back, lean, mix, segments

#: Pieces of one length that are ranked in one task, about.
RANKED = 20_000
#: Distinct words and parts of words whose ids a worker remembers before it starts afresh (about 170 MB).
REMEMBERED = 1_000_000
#: Seconds without a task after which a worker forgets them; workers live on when packing is over.
IDLE_SECONDS = 10.0
PUNCTUATION = string.punctuation.encode()


class WordIds:
    """Token ids of texts by a tokenizer that drops white space, so that words can be encoded one by one.

    ASCII white space never lies within a token here, so the ids of a text are those of its
    pieces between white space, in order; each distinct piece is encoded once.
    """

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # whether a token ends a run of letters (and so a word of letters alone), if the tokenizer marks that
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        self.end = np.array([end], dtype="<u4").tobytes()

    @staticmethod
    def _parts(word: bytes) -> tuple[bytes, ...]:
        """What the pre-tokenizer cuts a word into, as far as that is plain: letters, and punctuation after them."""
        core = word.rstrip(PUNCTUATION)
        last = word[len(core) :]
        if not core:
            return (word,)
        if not core.isascii():
            if not last or not core.decode("utf-8", "replace")[-1].lower().isalpha():  # lower-casing may end in a mark
                return (word,)
        elif core.isalpha():
            core = core.lower()
        else:
            return (word,)
        return (core, last) if last else (core,)

    def _learn(self, words: list[bytes]) -> None:
        """Remember the ids of words; those of letters alone are encoded many in one text, which their last tokens cut."""
        one_by_one = []
        lines: list[list[bytes]] = [[]]
        for w in words:
            if self.ends is None or not w.decode("utf-8", "replace").isalpha():
                one_by_one.append(w)
            elif len(lines[-1]) < 1000:
                lines[-1].append(w)
            else:
                lines.append([w])
        while lines:
            part = [x for x in lines[-20:] if x]
            del lines[-20:]
            for line, e in zip(part, self.tokenizer.encode_batch_fast([b" ".join(x).decode("utf-8") for x in part], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype="<u4")
                stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
                if len(stops) != len(line):  # some word is no single run of letters to the tokenizer
                    if len(line) > 50:
                        lines += [line[i : i + 50] for i in range(0, len(line), 50)]
                    else:
                        one_by_one += line
                    continue
                raw, begin = ids.tobytes(), 0
                for w, stop in zip(line, stops, strict=True):
                    self.known[w] = raw[begin:stop]
                    begin = stop
        for at in range(0, len(one_by_one), 20_000):
            part = one_by_one[at : at + 20_000]
            for word, e in zip(part, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False), strict=True):
                self.known[word] = np.array(e.ids, dtype="<u4").tobytes()

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """For each text its ids, little-endian unsigned 32-bit, and the end id."""
        split = [t.split() for t in texts]
        words = set().union(*split) if split else set()
        new = words.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = words
        cut = {w: self._parts(w) for w in new}
        self._learn(list({p for parts in cut.values() for p in parts}.difference(self.known)))
        for w, parts in cut.items():
            if w not in self.known:
                self.known[w] = self.known[parts[0]] if len(parts) == 1 else b"".join([self.known[p] for p in parts])
        get = self.known.__getitem__
        return [b"".join(map(get, words)) + self.end for words in split]


@lru_cache(maxsize=2)
def _word_ids(path: str | None, end: int) -> WordIds:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return WordIds(path, end)


_idle: threading.Timer | None = None


def _forget() -> None:
    """Drop the tokenizers and their words; a task that runs keeps its own."""
    _word_ids.cache_clear()
    _give_back()


def _remembering(path: str | None, end: int) -> WordIds:
    """The worker's tokenizer, with the words of its tasks before."""
    if _idle is not None:
        _idle.cancel()
    return _word_ids(path, end)


def _pause() -> None:
    """At a task's end: forget the words unless another task asks for them soon."""
    global _idle
    if _idle is not None:
        _idle.cancel()
    _idle = threading.Timer(IDLE_SECONDS, _forget)
    _idle.daemon = True
    _idle.start()


def pieces(df: DataFrame, capacity: int, path: str | None, end: int) -> DataFrame:
    """Rows doc_id, text_key, start, length, ids_crc32, doc_tokens: each document cut at multiples of capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _remembering(path, end)
        for batch, texts in segments(batches, "text"):
            out: list[list] = [[], [], [], [], []]
            for i, ids in enumerate(encode(texts)):
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for column, value in zip(out, (i, start, len(part) // 4, zlib.crc32(part), n), strict=True):
                        column.append(value)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(2).take(at), *(pa.array(c, pa.int64()) for c in out[1:])],
                names=["doc_id", "text_key", "start", "length", "ids_crc32", "doc_tokens"],
            )
        _pause()

    d = df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    return d.mapInArrow(lean(run), f"doc_id {df.schema['doc_id'].dataType.simpleString()}, text_key long, start long, length long, ids_crc32 long, doc_tokens long")


def closest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """A multiset of available lengths with the largest sum of at most room (bitset subset sums, backtracked)."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for l in reversed(lengths[: bisect.bisect_right(lengths, room)]):
        left, k = min(counts[l], room // l), 1
        while left > 0:
            k = min(k, left)
            more = reach | (reach << (l * k)) & mask
            if more != reach:
                steps.append((l, k, reach))
                reach = more
            left, k = left - k, 2 * k
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for l, k, before in reversed(steps):
        if not before >> total & 1:
            used[l] = used.get(l, 0) + k
            total -= l * k
    return used


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, ...]], int]:
    """Where items go, and the number of sequences, from the number of items of each length.

    A record (length, r0, r1, a, size, sequence, i0, k, at) sends tokens [a, a + size) of the
    items of that length with ranks r0..r1-1, numbered i = i0.. on, to sequence + i // k at
    offset at + (i % k) * size.
    """
    records: list[tuple[int, ...]] = []
    sequence = 0
    stock: dict[int, list[list[int]]] = {}  # by size: [item length, a, r0, r1] in turn
    counts: dict[int, int] = {}
    lengths: list[int] = []
    total = 0

    def put(size: int, item: list[int]) -> None:
        nonlocal total
        if size not in counts:
            bisect.insort(lengths, size)
            counts[size] = 0
            stock[size] = []
        stock[size].append(item)
        counts[size] += item[3] - item[2]
        total += size * (item[3] - item[2])

    def take(size: int, n: int) -> list[list[int]]:
        nonlocal total
        out, total = [], total - size * n
        counts[size] -= n
        while n:
            item = stock[size][-1]
            m = min(n, item[3] - item[2])
            out.append([item[0], item[1], item[2], item[2] + m])
            item[2] += m
            n -= m
            if item[2] == item[3]:
                stock[size].pop()
        if not counts[size]:
            del counts[size], stock[size]
            lengths.remove(size)
        return out

    def place(size: int, k: int, times: int, at: int) -> None:
        i = 0
        for length, a, r0, r1 in take(size, k * times):
            records.append((length, r0, r1, a, size, sequence, i, k, at))
            i += r1 - r0

    for length, n in sorted(histogram.items()):
        if length == capacity:
            records.append((length, 0, n, 0, capacity, sequence, 0, 1, 0))
            sequence += n
        else:
            put(length, [length, 0, 0, n])
    while total:
        room = capacity if total >= capacity else 1 << (total.bit_length() - 1)
        fits = bisect.bisect_right(lengths, room)
        used: dict[int, int] = {}
        if fits:
            seed = lengths[fits - 1]
            counts[seed] -= 1
            used = closest(lengths, counts, room - seed)
            counts[seed] += 1
            used[seed] = used.get(seed, 0) + 1
        gap = room - sum(l * k for l, k in used.items())
        cut = 0
        if gap:
            # the largest item left over beyond the pattern is cut; it is longer than the gap
            cut = next(l for l in reversed(lengths) if counts[l] > used.get(l, 0) and l > gap)
        times = min([counts[l] // (k + (l == cut)) for l, k in used.items()] + ([counts[cut] // (1 + used.get(cut, 0))] if cut else []))
        times = max(1, min(times, total // room if room == capacity else 1))
        at = 0
        for l, k in sorted(used.items()):
            place(l, k, times, at)
            at += l * k
        if cut:
            i = 0
            for length, a, r0, r1 in take(cut, times):
                records.append((length, r0, r1, a, gap, sequence, i, 1, at))
                put(cut - gap, [length, a + gap, r0, r1])
                i += r1 - r0
        sequence += times
    return records, sequence


def pack(df: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end: int = 2) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are documents of the end id alone. Repeated rows and ids are documents of
    their own; null ids stay null. An empty table gives no rows. Extra columns are left out.
    Every sequence is full but for the last few, whose lengths are powers of two.
    """
    cut = written(pieces(df, capacity, tokenizer, end), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    # ranks within a length: each length's rows are dealt to buckets, so a length that many share is no single task
    buckets = 1 + max(histogram.values(), default=0) // RANKED
    bucket = F.pmod(F.xxhash64("doc_id", "start", "text_key"), F.lit(buckets))
    by = cut.withColumn("bucket", bucket)
    sizes = by.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).select("length", "bucket", "before")
    local = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "text_key")) - 1
    ranked = by.withColumn("local", local).join(before, ["length", "bucket"]).withColumn("rank", (F.col("local") + F.col("before")).cast("long"))
    ranked = ranked.select("doc_id", "text_key", "start", "length", "ids_crc32", "doc_tokens", "rank")
    records, _ = plan(histogram, capacity)
    by_length: dict[int, np.ndarray] = {}
    for r in records:
        by_length.setdefault(r[0], []).append(r)
    table = df.sparkSession.sparkContext.broadcast({k: np.array(v, dtype=np.int64) for k, v in by_length.items()})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(6).to_numpy()
            rows, out = [], []
            order = np.argsort(length, kind="stable")
            bounds = np.flatnonzero(np.concatenate([[True], np.diff(length[order]) != 0, [True]])) if len(order) else []
            for b, e in zip(bounds[:-1], bounds[1:], strict=True):
                own = order[b:e]
                for _, r0, r1, a, size, sequence, i0, k, at in table.value[int(length[own[0]])]:
                    hit = own[(rank[own] >= r0) & (rank[own] < r1)]
                    if len(hit):
                        i = rank[hit] - r0 + i0
                        rows.append(hit)
                        out.append(np.stack([np.full(len(hit), a), np.full(len(hit), size), sequence + i // k, at + (i % k) * size]))
            if not rows:
                continue
            hit, (a, size, sequence, at) = np.concatenate(rows), np.concatenate(out, axis=1)
            take = pa.array(hit)
            whole = size == length[hit]
            crc = batch.column(4).to_numpy()[hit]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(batch.column(2).to_numpy()[hit] + a), pa.array(size), pa.array(crc, mask=~whole), batch.column(5).take(take), pa.array(sequence), pa.array(at)],
                names=["doc_id", "text_key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    kind = df.schema["doc_id"].dataType.simpleString()
    placed = ranked.mapInArrow(lean(assign), f"doc_id {kind}, text_key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if all(r[4] == r[0] for r in records):
        return placed.select(*columns)
    placed = written(placed, "placed")
    drop_table(cut)
    split = placed.filter(F.col("ids_crc32").isNull())
    spans = written(split.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "length")).alias("spans")), "cut-items")

    def tags(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield mix(batch.column(0).to_numpy().view(np.uint64))

    # only texts that an item was cut from are moved; the bitmap tells nearly all others apart where they are read
    marked, _ = sketch(spans.select(F.xxhash64("doc_id", "text_key")), tags, cells_for(spans.count()), 1)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked.value.holds(mix(batch.column(3).to_numpy().view(np.uint64)))))

    texts = df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    texts = texts.withColumn("tag", F.xxhash64("doc_id", "text_key"))
    # written, so that a task that joins few texts at once has one Python worker, not two; workers live on with what they hold
    texts = written(texts.mapInArrow(lean(pick), texts.schema).drop("tag"), "cut-texts")
    wanted = texts.join(spans.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_key", "_key"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))

    def crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _remembering(tokenizer, end)
        for batch, all_texts in segments(batches, "text"):
            out: list[list] = [[], [], [], []]
            for i, (ids, asked) in enumerate(zip(encode(all_texts), batch.column(3).to_pylist(), strict=True)):
                for x in asked:
                    for column, value in zip(out, (i, x["start"], x["length"], zlib.crc32(ids[4 * x["start"] : 4 * (x["start"] + x["length"])])), strict=True):
                        column.append(value)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), *(pa.array(c, pa.int64()) for c in out[1:])], names=["_id", "_key", "_start", "_length", "crc"])
        _pause()

    found = wanted.select("doc_id", "text", "text_key", "spans").mapInArrow(lean(crcs), f"_id {kind}, _key long, _start long, _length long, crc long").distinct()
    again = split.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")) & (F.col("start") == F.col("_start")) & (F.col("length") == F.col("_length")))
    return placed.filter(F.col("ids_crc32").isNotNull()).select(*columns).unionByName(again.drop("ids_crc32").withColumnRenamed("crc", "ids_crc32").select(*columns))
