"""Vectorised word segmentation and rolling fingerprints over UTF-8 bytes (numpy only).

All separators used by the operators are ASCII, so words can be cut on bytes: a byte of a
multi-byte character is never a separator.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once; a single longer text is still handled whole.
SEGMENT_BYTES = 1 << 20


def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: word bytes of [^\x20\x09-\x0D]+
NON_BLANK = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing A-Z)
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def lower_ascii(text: bytes) -> bytes:
    """Lower-case A-Z only."""
    return text.translate(_LOWER)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising bijection of 64-bit values (the public splitmix64 finaliser)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


@lru_cache(maxsize=8)
def _seeded(seed: int) -> tuple[int, int, int]:
    """An odd factor and two summands."""
    rng = np.random.default_rng(seed)
    return tuple(int(x) for x in rng.integers(1, 2**63, 3, dtype=np.uint64) * U64(2) + U64(1))


def joined(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """Fingerprints of pairs of fingerprints; their order counts."""
    factor, plus, _ = _seeded(seed)
    return mix(a * U64(factor) + (b ^ U64(plus)))


class Words:
    """The words of a few texts: byte spans, owning text, and each text's first word."""

    def __init__(self, texts: list[bytes], kind: np.ndarray, lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        if lower:
            joined = lower_ascii(joined)
        self.data = joined
        self.buf = np.frombuffer(joined, dtype=np.uint8)
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.text_at = np.concatenate([[0], np.cumsum(lengths + 1)])
        edges = np.diff(np.concatenate([[False], kind[self.buf], [False]]).view(np.int8))
        self.start = np.flatnonzero(edges == 1)
        self.end = np.flatnonzero(edges == -1)
        self.first = np.searchsorted(self.start, self.text_at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, seed: int = 1) -> np.ndarray:
        """64-bit fingerprint of every word, depending on its bytes and on the seed only.

        Each block of 8 bytes is mixed with its place in the word by a bijection before the sum, so
        no pattern of bytes or blocks cancels out (a polynomial modulo 2**64 would allow that).
        """
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        _, plus, step = _seeded(seed)
        size = self.end - self.start
        padded = self.data + bytes(8)
        at = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        rest = np.minimum(size, 8).astype(np.uint64)
        block = at[self.start] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - (rest << U64(3))))
        sums = mix(block + U64(plus))
        long = np.flatnonzero(size > 8)
        if len(long):
            more = (size[long] - 1) // 8
            owner = np.repeat(np.arange(len(long)), more)
            turn = np.arange(len(owner)) - np.repeat(np.cumsum(more) - more, more) + 1
            rest = np.minimum(size[long][owner] - 8 * turn, 8).astype(np.uint64)
            block = at[self.start[long][owner] + 8 * turn] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - (rest << U64(3))))
            mixed = mix(block + mix(turn.astype(np.uint64) * U64(step) + U64(plus)))
            sums[long] += np.add.reduceat(mixed, np.cumsum(more) - more)
        return mix(sums + size.astype(np.uint64) * U64(step))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]

    def words(self, doc: int) -> list[bytes]:
        return [self.data[s:e] for s, e in zip(self.start[self.first[doc] : self.first[doc + 1]].tolist(), self.end[self.first[doc] : self.first[doc + 1]].tolist(), strict=True)]


def rolling(h: np.ndarray, n: int, seed: int = 11) -> np.ndarray:
    """Fingerprints of all runs of n consecutive values, over text borders too.

    Runs of twice the length are made from pairs of runs; the last pair overlaps where n is no power of two.
    """
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    size = 1
    out = mix(h + U64(_seeded(seed)[2]))
    while size < n:
        step = min(size, n - size)
        out = joined(out[:-step], out[step:], seed + size)
        size += step
    return out


def inside(words: Words, n: int) -> np.ndarray:
    """Which runs of n words (as rolling() orders them) stay within one text."""
    if len(words) < n:
        return np.zeros(0, dtype=bool)
    return words.doc[: len(words) - n + 1] == words.doc[n - 1 :]


def minimiser_at(grams: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` consecutive gram fingerprints, the place of its first smallest one."""
    at = np.arange(len(grams), dtype=np.int64)
    done = 1
    while done < span:
        step = min(done, span - done)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(grams[b] < grams[a], b, a)
        done += step
    return at


def _give_back() -> None:
    """Return freed memory to the system: workers stay alive between tasks, and allocators keep what they once needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not every C library has it
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task, at whose end, when nothing of it is held any more, memory is given back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return task


def _bytes_of(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes (null: empty)."""
    if column.type not in (pa.binary(), pa.large_binary()):
        column = column.cast(pa.binary() if column.type == pa.string() else pa.large_binary())
    return [b"" if t is None else t for t in column.to_pylist()]


def segments(batches: Iterator[pa.RecordBatch], text: str, limit: int = SEGMENT_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with texts as UTF-8 bytes (null: empty), of about `limit` bytes each; only one slice's texts are copied at a time."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        begin, size = 0, 0
        for i, n in enumerate(pc.binary_length(column).to_pylist()):
            n = n or 0
            if size and size + n > limit:
                yield batch.slice(begin, i - begin), _bytes_of(column.slice(begin, i - begin))
                begin, size = i, 0
            size += n
        if begin < len(column):
            yield batch.slice(begin), _bytes_of(column.slice(begin))
        del batch, column
    _give_back()


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true values."""
    edges = np.diff(np.concatenate([[False], flag, [False]]).view(np.int8))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n places lie in [s, s + width) for a start s."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:n]) > 0
