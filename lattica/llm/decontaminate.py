"""Benchmark passages in documents by pigeonhole edit matching.

A test item of n words may have n // 5 word edits (similarity 0.8). It is split into one piece
more than that, so at least one piece stands unchanged in any copy within the budget. An item of fewer
than 8 words has no budget and is one piece. Hits of
piece beginnings are found by rolling word fingerprints; around each, Myers' bit-parallel
distance of the whole item verifies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .words import ALNUM, Words, inside, lean, rolling, segments

#: Items of fewer words are matched exactly: their pieces are too short to tell a leak from chance.
LEAST_WORDS = 8
#: Items handled in one pass over the documents; more are taken in further passes.
ITEMS_A_PASS = 20_000


def budget(n: int) -> int:
    return n // 5 if n >= LEAST_WORDS else 0


def myers(pattern: list, text: list) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of the text, and the first end of such a stretch.

    The columns of the dynamic programme are kept as bit vectors of vertical differences (Myers 1999).
    """
    m = len(pattern)
    if not m:
        return 0, 0
    where: dict = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << i
    ones, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = ones, 0, m
    best, best_end = m, 0
    for j, w in enumerate(text):
        equal = where.get(w, 0)
        diagonal = (((equal & plus) + plus) ^ plus) | equal | minus
        up = minus | (~(diagonal | plus) & ones)
        down = plus & diagonal
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        up = up << 1 & ones
        down = down << 1 & ones
        plus = down | (~((equal | minus) | up) & ones)
        minus = up & (equal | minus)
        if score < best:
            best, best_end = score, j + 1
    return best, best_end


class Items:
    """Piece beginnings of test items as sorted fingerprints, with their items and places."""

    def __init__(self, rows: list[tuple[object, str]]):
        self.ids, self.words = [], []
        starts: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in rows:
            w = Words([(text or "").encode()], ALNUM, lower=True)
            if len(w):
                n, parts = len(w), budget(len(w)) + 1
                # short items have beginnings of their own length, so that they don't shorten the others'
                starts.setdefault(n if n < LEAST_WORDS else 0, []).extend((len(self.ids), p * n // parts) for p in range(parts))
                self.ids.append(item_id)
                self.words.append(w.words(0))
        self.groups = [self._group(n, places) for n, places in sorted(starts.items())]

    def _group(self, n: int, starts: list[tuple[int, int]]) -> tuple[int, np.ndarray, list[tuple[int, int]]]:
        """Width, sorted fingerprints and places of beginnings; n is the length of short items, else 0."""
        # every piece has at least `width` words
        width = n or min(len(self.words[item]) // (budget(len(self.words[item])) + 1) for item, _ in starts)
        keys = []
        for item, at in starts:
            w = Words([b" ".join(self.words[item][at : at + width])], ALNUM)
            keys.append(rolling(w.hashes(), width)[0])
        order = np.argsort(np.array(keys, dtype=np.uint64), kind="stable")
        return width, np.array(keys, dtype=np.uint64)[order], [starts[i] for i in order]

    def hits(self, words: Words) -> Iterator[tuple[int, int, int]]:
        """(text, item, diagonal) of every piece hit; the diagonal is the item's first word's place."""
        h = words.hashes()
        for width, keys, starts in self.groups:
            grams = rolling(h, width)
            at = np.searchsorted(keys, grams)
            for p in np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == grams) & inside(words, width)):
                k = at[p]
                while k < len(keys) and keys[k] == grams[p]:
                    item, offset = starts[k]
                    yield int(words.doc[p]), item, int(p) - offset
                    k += 1


def leaks(df: DataFrame, benchmark: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows row_id, item_id, distance, first_word, last_word: each item's closest place in each text.

    Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. Null and
    empty texts and items match nothing; items under LEAST_WORDS words match exactly; long texts are
    searched whole. Of equally near places that whose piece comes first in the text is given. Repeated
    rows, of either table, give a row each; null ids are kept. An empty table of either kind gives no
    rows; extra columns are left out. Items are read in blocks of ITEMS_A_PASS, each broadcast.
    """
    spark = df.sparkSession
    source = df.select(F.col(row_id).alias("_id"), F.col(text).alias("_text"))
    items = benchmark.select("item_id", "text")
    passes = max(1, -(-items.count() // ITEMS_A_PASS))
    id_kind, item_kind = df.schema[row_id].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = None
    for p in range(passes):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p) if passes > 1 else items
        shared = spark.sparkContext.broadcast(Items([tuple(r) for r in block.collect()]))

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch, texts in segments(batches, "_text"):
                words = Words(texts, ALNUM, lower=True)
                best: dict[tuple[int, int], tuple[int, int, int]] = {}
                seen: set[tuple[int, int, int]] = set()
                for doc, item, diagonal in known.hits(words):
                    if (doc, item, diagonal) in seen or best.get((doc, item), (1,))[0] == 0:
                        continue
                    seen.add((doc, item, diagonal))
                    pattern = known.words[item]
                    edits = budget(len(pattern))
                    a = max(int(words.first[doc]), diagonal - edits)
                    b = min(int(words.first[doc + 1]), diagonal + len(pattern) + edits)
                    region = [words.word(i) for i in range(a, b)]
                    distance, end = myers(pattern, region)
                    if distance <= edits and distance < best.get((doc, item), (edits + 1,))[0]:
                        _, back = myers(pattern[::-1], region[:end][::-1])
                        first = int(words.first[doc])
                        best[doc, item] = (distance, a + end - back - first, a + end - 1 - first)
                if best:
                    at = pa.array([d for d, _ in best], pa.int64())
                    values = list(best.values())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), pa.array([known.ids[i] for _, i in best], item_type), *(pa.array([v[k] for v in values], pa.int64()) for k in range(3))],
                        names=["_id", "item_id", "distance", "first_word", "last_word"],
                    )

        part = source.mapInArrow(lean(match), f"_id {id_kind}, item_id {item_kind}, distance long, first_word long, last_word long")
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("_id", row_id)


def without_leaks(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text holds no benchmark item; all columns stay, whatever their names.

    No text is shuffled: each row is judged where it lies. Null and empty texts stay; repeated rows are
    judged each; long texts are searched whole; without items, or rows, the table stays as it is.
    """
    spark = df.sparkSession
    items = benchmark.select("item_id", "text")
    passes = max(1, -(-items.count() // ITEMS_A_PASS))
    schema = df.schema
    out = df
    for p in range(passes):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p) if passes > 1 else items
        shared = spark.sparkContext.broadcast(Items([tuple(r) for r in block.collect()]))

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch, texts in segments(batches, "text"):
                words = Words(texts, ALNUM, lower=True)
                leaked: set[int] = set()
                for doc, item, diagonal in known.hits(words):
                    if doc in leaked:
                        continue
                    pattern = known.words[item]
                    edits = budget(len(pattern))
                    a, b = max(int(words.first[doc]), diagonal - edits), min(int(words.first[doc + 1]), diagonal + len(pattern) + edits)
                    if myers(pattern, [words.word(i) for i in range(a, b)])[0] <= edits:
                        leaked.add(doc)
                if len(leaked) < batch.num_rows:
                    keep = np.ones(batch.num_rows, dtype=bool)
                    keep[list(leaked)] = False
                    yield batch.filter(pa.array(keep))

        out = out.mapInArrow(lean(clean), schema)
    return out
