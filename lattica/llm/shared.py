"""Tables written to the shared folder, and bounded sketches of hashed cells."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import U64, lean

#: Cells of one block of a sketch; a block's bitmap takes BLOCK / 8 bytes.
BLOCK = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset in local mode (tests), one is made and set.

    On a cluster a folder of one machine would lose rows, so there the setting must be given.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage is cut and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files below a table made by written(), once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}").lower() in taken:
        pass
    return name


#: Parts into which rows of a hot key are dealt.
SHARES = 64


def spread_join(left: DataFrame, right: DataFrame, key: str, other: str, hot: list, by: str, how: str = "inner") -> DataFrame:
    """left joined with right on key = other; rows of hot keys are dealt over SHARES parts by their column `by`.

    `right` has one row a key, and `hot` is a short list, such as keys with a thousandth of the rows each.
    """
    if not hot:
        return left.join(right, F.col(key) == F.col(other), how)
    dealt = left.withColumn("_share", F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(by), F.lit(SHARES))).otherwise(0))
    spread = right.withColumn("_part", F.explode(F.when(F.col(other).isin(hot), F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(spread, (F.col(key) == F.col(other)) & (F.col("_share") == F.col("_part")), how).drop("_share", "_part")


def cells_for(n: int) -> int:
    """Cells of a sketch of n values, 16 to 32 for each: 1 M at least, 2^28 (32 MB to broadcast) at most.

    Beyond that more values share a cell, which only lets more through to what follows the sketch.
    """
    return min(max(BLOCK, 1 << (16 * n).bit_length()), 1 << 28)


class Sketch:
    """Bitmap of the cells that were counted often enough; a value whose cell isn't set was not."""

    def __init__(self, bits: bytes, cells: int):
        self.bits, self.cells = bits, cells

    def holds(self, values: np.ndarray) -> np.ndarray:
        cell = values >> U64(64 - self.cells.bit_length() + 1)
        bits = np.frombuffer(self.bits, dtype=np.uint8)
        return (bits[(cell >> U64(3)).astype(np.int64)] >> (cell & U64(7)).astype(np.uint8)) & 1 == 1


def sketch(df: DataFrame, values_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], cells: int, least: int) -> tuple[object, int]:
    """Count hashed values in `cells` cells (a power of two of BLOCK at least) and keep which reach `least` (1 or 2).

    Every partition makes a sparse sketch of its own, saturating at `least`; blocks of cells are
    merged by a shuffle, each to a bitmap. Only bitmaps reach the driver, cells / 8 bytes in all,
    whatever the input's size, and are broadcast. Two values in one cell are counted together, so
    counts are never too small. Returns the broadcast Sketch and the number of values counted.
    """
    shift = 64 - (cells.bit_length() - 1)
    per_flush = 1 << 21

    def emit(parts: list[np.ndarray], n: int) -> pa.RecordBatch:
        cell = np.concatenate(parts)
        parts.clear()
        cell.sort()
        new = np.concatenate([[True], cell[1:] != cell[:-1]])
        several = np.concatenate([~new[1:], [False]])[new]
        unique = cell[new]
        del cell, new
        block = unique // np.uint32(BLOCK)
        cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
        once, more = [], []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            inside = unique[a:b] % np.uint32(BLOCK)
            once.append(inside.tobytes())
            more.append(inside[several[a:b]].tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(block[cut[:-1]].astype(np.int64)), pa.array(once, pa.binary()), pa.array(more, pa.binary()), pa.array([n] + [0] * (len(once) - 1), pa.int64())],
            names=["block", "once", "more", "n"],
        )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for values in values_of(batches):
            if len(values):
                parts.append((values >> U64(shift)).astype(np.uint32))  # there are 2^32 cells at most
                n += len(values)
            if n >= per_flush:
                yield emit(parts, n)
                parts, n = [], 0
        if parts:
            yield emit(parts, n)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task holds the counters of the few blocks dealt to it, one byte a cell
        counts: dict[int, np.ndarray] = {}
        total: dict[int, int] = {}
        for batch in batches:
            for block, once, more, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                c = counts.setdefault(block, np.zeros(BLOCK, dtype=np.uint8))
                total[block] = total.get(block, 0) + n
                for part in (once, more):
                    at = np.frombuffer(part, dtype=np.uint32)
                    c[at] = np.minimum(c[at] + 1, 2)
        for block, c in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([np.packbits(c >= least, bitorder="little").tobytes()], pa.binary()), pa.array([total[block]], pa.int64())],
                names=["block", "bits", "n"],
            )

    spark = df.sparkSession
    partials = df.mapInArrow(lean(partial), "block long, once binary, more binary, n long")
    merged = partials.repartition(min(cells // BLOCK, max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))), "block").mapInArrow(lean(merge), "block long, bits binary, n long")
    bits = bytearray(cells // 8)
    n = 0
    for row in merged.toLocalIterator() if cells > (1 << 30) else merged.collect():
        at = row["block"] * (BLOCK // 8)
        bits[at : at + BLOCK // 8] = row["bits"]
        n += row["n"]
    return spark.sparkContext.broadcast(Sketch(bytes(bits), cells)), n
