"""Pixels on a shared canvas: each blender is an aggregate of the layers of a cell (W and G families).

Layers are rows x, y, value columns, and what the blender weighs by. One shuffle by cell; map-side
partial aggregates shrink it first, except for the median.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ("y", "x")


def bounds(boxes: DataFrame, padding: int = 50) -> DataFrame:
    """Canvas box of image boxes x0, y0, x1, y1 (a degenerate axis grows by 100)."""
    b = boxes.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    b = b.select("x0", "y0", F.when(F.col("x1") <= F.col("x0"), F.col("x0") + 100).otherwise(F.col("x1")).alias("x1"), F.when(F.col("y1") <= F.col("y0"), F.col("y0") + 100).otherwise(F.col("y1")).alias("y1"))
    return b.select((F.col("x0") - padding).alias("x0"), (F.col("y0") - padding).alias("y0"), (F.col("x1") + padding).alias("x1"), (F.col("y1") + padding).alias("y1"))


def edge_weight(x: Column, y: Column, width: Column | int, height: Column | int, feather: float) -> Column:
    """Distance to the border over the feather width, at most 1; the border itself weighs 0."""
    w, h = (F.lit(v) if isinstance(v, int) else v for v in (width, height))
    return F.least(F.least(x, w - 1 - x, y, h - 1 - y) / feather, F.lit(1.0))


def pixelstitch_weight(x: Column, y: Column, width: int, height: int) -> Column:
    cx, cy = (width - 1) / 2, (height - 1) / 2
    far = math.hypot(cx, cy)
    r = F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))
    return (1 - 0.3 * r / far) * 1.2 * edge_weight(x, y, width, height, 100)


def select_weight(x: Column, y: Column, width: int, height: int, boundary: Column) -> Column:
    cx, cy = width / 2, height / 2
    return (1 - F.abs(y - cy) / cy) * (1 - F.abs(x - cx) / cx) * (1 - 0.2 * boundary)


def clipped(layers: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    return layers.filter(F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1))


def zoomed(layers: DataFrame, width: int, height: int, zoom: float) -> DataFrame:
    """The central window of 1 / zoom of each side."""
    w, h = int(width / zoom), int(height / zoom)
    x0, y0 = (width - w) // 2, (height - h) // 2
    return clipped(layers, x0, y0, x0 + w, y0 + h).withColumn("x", F.col("x") - x0).withColumn("y", F.col("y") - y0)


def autocrop(cells: DataFrame, margin: int = 5) -> DataFrame:
    """Box of covered cells, widened by the margin."""
    return cells.agg((F.min("x") - margin).alias("x0"), (F.min("y") - margin).alias("y0"), (F.max("x") + margin).alias("x1"), (F.max("y") + margin).alias("y1"))


def weighted(layers: DataFrame, value: str = "value", weight: str = "weight", alpha: str | None = None) -> DataFrame:
    """Weighted mean per cell, clipped and truncated; alpha weighs twice, as in the mask and in the sum; no weight: 0."""
    w = F.col(weight) if alpha is None else F.col(weight) * F.col(alpha) * F.col(alpha)
    s = layers.groupBy(*CELL).agg(F.sum(w * F.col(value)).alias("s"), F.sum(w).alias("w"))
    mean = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(F.col("s") / F.col("w"), 6))))
    return s.select(*CELL, F.when(F.col("w") == 0, F.lit(0)).otherwise(mean).cast("long").alias("value"), F.col("w").alias("weight"))


def first_wins(layers: DataFrame, order: list[Column], value: str = "value") -> DataFrame:
    """The first layer of each cell in the given order."""
    return layers.groupBy(*CELL).agg(F.min_by(value, F.struct(*order)).alias("value"))


def strongest(layers: DataFrame, tie: list[Column], value: str = "value") -> DataFrame:
    """The largest value of each cell with its layer; the first wins ties."""
    return layers.groupBy(*CELL).agg(F.min_by(F.struct(value, *tie), F.struct((-F.col(value)), *tie)).alias("b")).select(*CELL, "b.*")


def extreme(layers: DataFrame, how: str, value: str = "value") -> DataFrame:
    return layers.groupBy(*CELL).agg((F.max if how == "max" else F.min)(value).alias("value"))


def median(layers: DataFrame, value: str = "value") -> DataFrame:
    return layers.groupBy(*CELL).agg(F.median(value).alias("value"))


def argmax(layers: DataFrame, weight: str, tie: list[Column], value: str = "value", background: int = 255) -> DataFrame:
    """The value of the layer of largest weight (above 0); strictly larger wins, so ties go to the first."""
    return layers.groupBy(*CELL).agg(F.min_by(F.struct(value, weight), F.struct(-F.col(weight), *tie)).alias("b")).select(*CELL, F.when(F.col(f"b.{weight}") > 0, F.col(f"b.{value}")).otherwise(F.lit(background)).alias("value"))


def top_two(layers: DataFrame, weight: str, tie: list[Column], value: str = "value", blank: float = 255) -> DataFrame:
    """Best layer's value per cell, replaced by the second's where it is exactly blank."""
    ranked = layers.withColumn("_r", F.row_number().over(Window.partitionBy(*CELL).orderBy(F.desc(weight), *tie))).filter("_r <= 2")
    return ranked.groupBy(*CELL).agg(F.max(F.when(F.col("_r") == 1, F.col(value))).alias("a"), F.max(F.when(F.col("_r") == 2, F.col(value))).alias("b")).select(*CELL, F.when((F.col("a") == blank) & F.col("b").isNotNull(), F.col("b")).otherwise(F.col("a")).alias("value"))


def coverage(layers: DataFrame) -> DataFrame:
    return layers.groupBy(*CELL).agg(F.count("*").alias("layers"))


def is_exploded(boxes: DataFrame) -> DataFrame:
    """Whether the canvas is far larger than its images: ratio and verdict (one row)."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    s = boxes.agg(F.count("*").alias("n"), F.sum(area).alias("area"), ((F.max("x1") - F.min("x0")) * (F.max("y1") - F.min("y0"))).alias("canvas"))
    ratio = F.col("canvas") / (F.col("area") * 0.7 * F.sqrt("n"))
    return s.select("n", F.round(ratio, 6).alias("ratio"), ((F.col("n") >= 5) & (ratio > 10)).alias("exploded"))


def tile_ramp(size: int, overlap: float) -> Column:
    """Linear ramp weight of a place along one side of a tile."""
    n = max(1, int(size * overlap))
    p = F.col("p")
    return F.least((p + 1) / n, (size - p) / n, F.lit(1.0))


def scaled(layers: DataFrame, factor: float) -> DataFrame:
    """Coordinates on a canvas scaled by a factor (caps and target sizes); cells that meet are blended later."""
    return layers.withColumn("x", F.floor(F.col("x") * factor).cast("int")).withColumn("y", F.floor(F.col("y") * factor).cast("int"))


#: Blenders by name and feather width; any other name is the linear one.
BLENDERS = {"autostitch": None, "multiband": 100.0, "feather": 50.0, "linear": 50.0}


def blend(layers: DataFrame, method: str, width: int, height: int, order: list[Column]) -> DataFrame:
    """Blend layers that also carry their place lx, ly in images of the given size."""
    feather = BLENDERS.get(method, 50.0)
    if feather is None:
        return first_wins(layers, order)
    return weighted(layers.withColumn("_w", edge_weight(F.col("lx"), F.col("ly"), width, height, feather)), weight="_w").select(*CELL, "value")
