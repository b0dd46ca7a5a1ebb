"""Perceptual hashes, correlation, and near-duplicate removal (D1 to D9)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import tiles as t



def _bits(flags: Column, n: int) -> Column:
    """Flags as the bits of a long, the first one lowest."""
    return F.aggregate(F.zip_with(flags, F.sequence(F.lit(0), F.lit(n - 1)), lambda f, i: F.when(f, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, v: s.bitwiseOR(v))


def dhash(px: Column, width: int, height: int) -> Column:
    """Which pixels are darker than their right neighbour, width - 1 bits a row."""
    places = F.array(*[F.lit(y * width + x) for y in range(height) for x in range(width - 1)])
    return _bits(F.transform(places, lambda i: F.get(px, i + 1) > F.get(px, i)), height * (width - 1))


def dct_basis(n: int, k: int) -> list[list[float]]:
    """Rows of the orthonormal type-II cosine basis."""
    return [[(math.sqrt(1 / n) if u == 0 else math.sqrt(2 / n)) * math.cos(math.pi * (2 * x + 1) * u / (2 * n)) for x in range(n)] for u in range(k)]


def dct(px: Column, n: int, k: int) -> Column:
    """The k x k lowest coefficients of an n x n tile, rounded to 6 digits."""
    basis = F.array(*[F.array(*map(F.lit, row)) for row in dct_basis(n, k)])

    def coefficients(g: Column) -> Column:
        # rows first, then columns: 2 n^3 products instead of n^4
        def row(i: Column) -> Column:
            y, v = F.floor(i / k).cast("int"), (i % k).cast("int")
            return F.aggregate(F.zip_with(F.slice(g, y * n + 1, F.lit(n)), F.get(basis, v), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

        def both(r: Column) -> Column:
            def one(i: Column) -> Column:
                u, v = F.floor(i / k).cast("int"), (i % k).cast("int")
                column = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda y: F.get(r, y * k + v))
                return F.round(F.aggregate(F.zip_with(column, F.get(basis, u), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 6)

            return F.transform(F.sequence(F.lit(0), F.lit(k * k - 1)), one)

        return t.let(F.transform(F.sequence(F.lit(0), F.lit(n * k - 1)), row), both)

    return t.let(px, coefficients)


def phash_of(coefficients: Column, k: int = 8) -> Column:
    """Which coefficients exceed their median (the mean of the two middle ones)."""
    low, high = F.lit(k * k // 2 - 1), F.lit(k * k // 2)

    def bits(c: Column) -> Column:
        middle = t.let(F.sort_array(c), lambda o: (F.get(o, low) + F.get(o, high)) / 2)
        return t.let(middle, lambda m: _bits(F.transform(c, lambda v: v > m), k * k))

    return t.let(coefficients, bits)


def hash_similarity(a: Column, b: Column, bits: int = 64) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(bits))


def ncc_similarity(a: Column, b: Column) -> Column:
    return t.clip((t.correlation(a, b) + 1) / 2)


def combined(p: Column, d: Column, ncc: Column) -> Column:
    base = 0.3 * F.greatest(p, d) + 0.7 * ncc
    return F.when(ncc > 0.95, F.greatest(base, 0.98 * ncc)).otherwise(base)


def window_pairs(images: DataFrame, window: int, rank: str = "rk", image_id: str = "image_id") -> DataFrame:
    """Pairs whose ranks differ by at most `window`, the earlier first: an equi-join on blocks of ranks, not a cross product."""
    left = images.select([F.col(c).alias(f"{c}_i") for c in images.columns]).withColumn("_b", F.floor(F.col(f"{rank}_i") / window))
    right = images.select([F.col(c).alias(f"{c}_j") for c in images.columns]).withColumn("_b", F.explode(F.array(F.floor(F.col(f"{rank}_j") / window), F.floor(F.col(f"{rank}_j") / window) - 1)))
    step = F.col(f"{rank}_j") - F.col(f"{rank}_i")
    return left.join(right, "_b").filter((step >= 1) & (step <= window)).drop("_b")


def estimate_comparisons(n: int, window: int) -> int:
    return n * min(window, n // 2) if window > 0 else n * (n - 1) // 2


def greedy_survivors(ids: DataFrame, edges: DataFrame, rank: str = "rk") -> DataFrame:
    """Kept ranks: a row goes if an earlier kept row is similar to it (edges rank_i < rank_j).

    Rounds over the edge table: a row without open earlier neighbours is kept, its later
    neighbours go. Each round settles every row whose earlier neighbours are settled.
    """
    from lattica.plans.tables import written

    open_ = edges.select(F.col(f"{rank}_i").alias("i"), F.col(f"{rank}_j").alias("j"))
    gone = None
    while True:
        first = open_.select("i").distinct().join(open_.select(F.col("j").alias("i")).distinct(), "i", "left_anti")
        out = written(open_.join(first, "i", "left_semi").select(F.col("j")).distinct(), "gone")
        if out.isEmpty():
            break
        gone = out if gone is None else gone.unionByName(out)
        dropped = out.select(F.col("j").alias("i"))
        settled = first.withColumnRenamed("i", "s")
        open_ = written(open_.join(dropped, "i", "left_anti").join(out, "j", "left_anti").join(settled, F.col("i") == F.col("s"), "left_anti").select("i", "j"), "open")
    return ids if gone is None else ids.join(gone.select(F.col("j").alias(rank)), rank, "left_anti")


def exact_survivors(docs: DataFrame, content: str, order: str) -> DataFrame:
    """Of rows with equal content the first; equality is transitive, so one aggregate does."""
    return docs.groupBy(F.xxhash64(content).alias("_h"), F.md5(F.col(content).cast("binary")).alias("_m")).agg(F.min(order).alias(order)).select(order)
