"""Candidate image pairs (P1 to P7): generated from positions, joined to images by equality later."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_for(n: int) -> int:
    if n <= 30:
        return min(8, n // 3 + 2)
    if n <= 100:
        return min(6, n // 10 + 3)
    return 5 if n <= 500 else 4


def smart_offsets(n: int) -> list[tuple[int, int]]:
    """(offset, step): every step-th image is paired with the one `offset` later."""
    cols = math.ceil(math.sqrt(1.3 * n))
    out = [(k, 1) for k in range(1, window_for(n) + 1)] + [(cols - 1, 1), (cols, 1), (cols + 1, 1)]
    if n > 50:
        out += [(k, max(10, n // 20)) for k in (2 * cols, n // 3, n // 2)]
    return out + [(k, max(1, n // 10)) for k in (1, 2, cols)]


def by_offsets(positions: DataFrame, n: int, offsets: list[tuple[int, int]], position: str = "i") -> DataFrame:
    """Pairs of positions below n; each image makes its own pairs, so nothing is joined."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in sorted(set(offsets)) if k > 0])
    i = F.col(position).cast("long")
    targets = F.array_distinct(F.transform(F.filter(table, lambda o: (i % o["s"] == 0) & (i + o["k"] < n)), lambda o: i + o["k"]))
    return positions.select(i.alias("image_i"), F.explode(targets).alias("image_j"))


def all_pairs(positions: DataFrame, n: int, position: str = "i") -> DataFrame:
    """Every pair i < j; meant for at most a few images (candidates() uses it up to 10)."""
    i = F.col(position).cast("long")
    return positions.filter(i < n - 1).select(i.alias("image_i"), F.explode(F.sequence(i + 1, F.lit(n - 1).cast("long"))).alias("image_j"))


def windowed(positions: DataFrame, n: int, position: str = "i") -> DataFrame:
    return by_offsets(positions, n, [(k, 1) for k in range(1, max(1, min(15, n // 2)) + 1)], position)


def chain(positions: DataFrame, n: int, position: str = "i") -> DataFrame:
    return by_offsets(positions, n, [(1, 1)], position)


def candidates(positions: DataFrame, n: int, position: str = "i") -> DataFrame:
    return all_pairs(positions, n, position) if n <= 10 else by_offsets(positions, n, smart_offsets(n), position)


def grid_pairs(cells: DataFrame, diagonals: bool = True) -> DataFrame:
    """Neighbouring cells (row, col, image_id) as pairs, smaller id first."""
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonals else [])
    near = cells.select(F.col("image_id").alias("a"), F.explode(F.array(*[F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r, c in steps])).alias("p")).select("a", "p.row", "p.col")
    return near.join(cells.withColumnRenamed("image_id", "b"), ["row", "col"]).select(F.least("a", "b").alias("image_i"), F.greatest("a", "b").alias("image_j")).filter("image_i < image_j").distinct()


def planned(positions: DataFrame, n: int, cells: DataFrame | None, confidence: float, clusters: DataFrame | None = None, position: str = "i") -> DataFrame:
    """Grid pairs if a grid is trusted; beyond 100 images pairs within clusters; else a window."""
    if cells is not None and confidence >= 0.7:
        return grid_pairs(cells)
    if n > 100 and clusters is not None:
        near = windowed(positions, n, position)
        a = clusters.select(F.col("image_id").alias("image_i"), F.col("cluster").alias("ci"))
        b = clusters.select(F.col("image_id").alias("image_j"), F.col("cluster").alias("cj"))
        return near.join(a, "image_i").join(b, "image_j").filter("ci = cj").select("image_i", "image_j")
    return windowed(positions, n, position)


#: Modes of matching by name; an unknown one is the plan for the number of images.
MODES = {"exhaustive": all_pairs, "sequential": windowed, "chain": chain, "planned": candidates}


def by_mode(positions: DataFrame, n: int, mode: str = "planned", cells: DataFrame | None = None) -> DataFrame:
    """Candidate pairs by a mode's name; `grid` needs the cells of a grid."""
    if mode == "grid" and cells is not None:
        return grid_pairs(cells)
    return MODES.get(mode, candidates)(positions, n)
