"""Image quality: scores, filters and rankings (Q1 to Q11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import tiles as t


def laplacian_variance(px: Column, w, h) -> Column:
    return t.variance(t.convolve(px, w, h, t.LAPLACE))


def gradient_magnitude(px: Column, w, h) -> Column:
    return t.mean(F.zip_with(t.convolve(px, w, h, t.SOBEL_X), t.convolve(px, w, h, t.SOBEL_Y), lambda a, b: F.sqrt(a * a + b * b)))


def contrast(px: Column) -> Column:
    return t.clip(t.deviation(px) / 100)


def noise(px: Column, w, h) -> Column:
    return t.deviation(t.convolve(px, w, h, t.HIGH_PASS))


def combined(m: Column) -> Column:
    """Weighted sharpness, gradient, contrast and (inverse) noise of a struct of measures, 0 to 1."""
    return t.clip(0.4 * t.normalise(m["laplacian"], 0, 1000) + 0.3 * t.normalise(m["gradient"], 0, 100) + 0.2 * t.normalise(m["deviation"], 0, 100) + 0.1 * (1 - t.normalise(m["noise"], 0, 50)))


def assess(images: DataFrame, px: str = "px", width: str = "width", height: str = "height") -> DataFrame:
    """images with their quality; an empty image has 0."""
    measured = images.withColumn("_measures", t.measures(F.col(px), F.col(width), F.col(height)))
    empty = F.coalesce(F.size(px), F.lit(0)) <= 0
    return measured.withColumn("quality", F.when(empty, F.lit(0.0)).otherwise(combined(F.col("_measures")))).drop("_measures")


def is_blurry(quality: Column, threshold: float = 0.5) -> Column:
    return quality < threshold


def cleaned(quality: Column) -> Column:
    """Missing, undefined or negative scores count as 0.5."""
    return F.when(quality.isNull() | F.isnan(quality) | (quality < 0), 0.5).otherwise(quality)


def keep_good(images: DataFrame, threshold: float, fallback: float = 0.1) -> DataFrame:
    """Rows of at least the threshold; if there are none, those of at least the fallback.

    The number that pass is one aggregate, joined back as a single row, so no row is moved.
    """
    scored = images.withColumn("quality", cleaned(F.col("quality")))
    passing = scored.agg(F.count_if(F.col("quality") >= threshold).alias("_passing"))
    kept = scored.crossJoin(F.broadcast(passing))  # one row
    return kept.filter((F.col("quality") >= threshold) | ((F.col("_passing") == 0) & (F.col("quality") >= fallback))).drop("_passing")


def ranked(images: DataFrame, order: str = "image_id") -> DataFrame:
    """Descending by quality, ties in input order."""
    return images.orderBy(F.desc("quality"), F.asc(order))


def numbered(images: DataFrame, order: str, name: str, descending: str | None = None) -> DataFrame:
    """Global positions from 0 without one task seeing all rows: sort by range, count per partition, add offsets."""
    keys = ([F.desc(descending)] if descending else []) + [F.asc(order)]
    placed = images.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    placed = placed.withColumn("_i", F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_before")  # a row per partition
    return placed.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")
