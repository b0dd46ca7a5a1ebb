"""Placement of images: transforms to boxes, warps, grids and snakes (A7 to A15), as closed formulas over positions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.graph import grid_size


def placed(images: DataFrame) -> DataFrame:
    """Boxes of images (width, height, a, b, tx, ty): rounded translation, or the bounds of the warped corners."""
    rotation = F.abs(F.atan2("b", "a"))
    scale = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))
    plain = (F.abs(scale - 1) < 0.01) & (rotation < 0.01)

    def corner(x: Column, y: Column) -> tuple[Column, Column]:
        return F.col("a") * x - F.col("b") * y + F.col("tx"), F.col("b") * x + F.col("a") * y + F.col("ty")

    w, h, zero = F.col("width"), F.col("height"), F.lit(0)
    cs = [corner(x, y) for x, y in ((zero, zero), (w, zero), (zero, h), (w, h))]
    x0, y0 = F.bround("tx").cast("long"), F.bround("ty").cast("long")
    xs, ys = [c[0] for c in cs], [c[1] for c in cs]
    return images.select(
        "*", (~plain).alias("warped"),
        F.when(plain, x0).otherwise(F.floor(F.least(*xs))).alias("x0"), F.when(plain, y0).otherwise(F.floor(F.least(*ys))).alias("y0"),
        F.when(plain, x0 + w).otherwise(F.ceil(F.greatest(*xs))).alias("x1"), F.when(plain, y0 + h).otherwise(F.ceil(F.greatest(*ys))).alias("y1"),
    )


def warped(images: DataFrame) -> DataFrame:
    """Rows image_id, x, y, value of each image's canvas cells, bilinear with zero outside (px: gray values)."""
    p = placed(images)
    cell = p.select("image_id", "px", "width", "height", "a", "b", "tx", "ty", F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"), "x0", "x1").select("*", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"))
    q = F.col("a") * F.col("a") + F.col("b") * F.col("b")
    dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    cell = cell.withColumn("u", (F.col("a") * dx + F.col("b") * dy) / q).withColumn("v", (F.col("a") * dy - F.col("b") * dx) / q)
    u0, v0 = F.floor("u").cast("int"), F.floor("v").cast("int")

    def at(i: Column, j: Column) -> Column:
        inside = (i >= 0) & (i < F.col("width")) & (j >= 0) & (j < F.col("height"))
        return F.when(inside, F.get("px", (j * F.col("width") + i).cast("int"))).otherwise(0)

    fu, fv = F.col("u") - u0, F.col("v") - v0
    value = (1 - fv) * ((1 - fu) * at(u0, v0) + fu * at(u0 + 1, v0)) + fv * ((1 - fu) * at(u0, v0 + 1) + fu * at(u0 + 1, v0 + 1))
    return cell.select("image_id", "x", "y", value.alias("value"))


def at_origin(images: DataFrame) -> DataFrame:
    return images.select("*", F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"))


def looks_linear(positions: DataFrame, least: float = 0.15) -> DataFrame:
    s = positions.agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("xr"), (F.max("y") - F.min("y")).alias("yr"))
    return s.select("n", ((F.col("n") >= 4) & (F.col("yr") / F.greatest("xr", F.lit(1.0)) < least)).alias("linear"))


def snake(positions: DataFrame, n: int) -> DataFrame:
    """Positions x, y in rows of alternating direction, ordered by x; spacing is the median positive gap of the first ones.

    Position numbers come from one scene's images, so a single ordered window holds few rows.
    """
    cols = math.ceil(math.sqrt(1.5 * n))
    order = Window.orderBy("x", "image_id")
    numbered = positions.select("image_id", "x", (F.row_number().over(order) - 1).alias("i"), (F.col("x") - F.lag("x").over(order)).alias("gap"))
    spacing = numbered.filter((F.col("i") < 2 * cols) & (F.col("gap") > 0)).agg(F.coalesce(F.median("gap"), F.lit(1000.0)).alias("spacing"))
    row, col = F.floor(F.col("i") / cols).cast("int"), (F.col("i") % cols).cast("int")
    turned = F.when(row % 2 == 0, col).otherwise(cols - 1 - col)
    return numbered.crossJoin(F.broadcast(spacing)).select("image_id", row.alias("row"), turned.alias("col"), (turned * F.col("spacing")).alias("x"), (row * F.col("spacing")).alias("y"))


def exploded_view(images: DataFrame, factor: float = 1.3, padding: int = 50) -> DataFrame:
    """Grid layout from transformed centres (center_x, center_y, width, height): spread by the factor, from the padding on."""
    low = images.agg(F.min("center_x").alias("lx"), F.min("center_y").alias("ly"))
    s = images.crossJoin(F.broadcast(low))
    # rounded, so that the noise of fitted transforms doesn't move a box by a cell
    s = s.withColumn("cx", F.round((F.col("center_x") - F.col("lx")) * factor, 6)).withColumn("cy", F.round((F.col("center_y") - F.col("ly")) * factor, 6))
    s = s.withColumn("x", (F.col("cx") - F.col("width") / 2).cast("int")).withColumn("y", (F.col("cy") - F.col("height") / 2).cast("int"))
    first = s.agg(F.min("x").alias("mx"), F.min("y").alias("my"))
    return s.crossJoin(F.broadcast(first)).select("image_id", (F.col("x") - F.col("mx") + padding).alias("x"), (F.col("y") - F.col("my") + padding).alias("y"), F.round("cx", 6).alias("center_x"), F.round("cy", 6).alias("center_y"))


def simple_grid(images: DataFrame, n: int, position: str = "i") -> DataFrame:
    """Row-major grid with steps of the largest width and height plus 50."""
    _, cols = grid_size(n)
    step = images.agg((F.max("width") + 50).alias("dx"), (F.max("height") + 50).alias("dy"))
    row, col = F.floor(F.col(position) / cols).cast("int"), (F.col(position) % cols).cast("int")
    return images.crossJoin(F.broadcast(step)).select("image_id", row.alias("row"), col.alias("col"), (col * F.col("dx")).alias("x"), (row * F.col("dy")).alias("y"))


def disconnected(components: DataFrame, right: float) -> DataFrame:
    """Left edges of further components (component, n) to the right of the placed ones: running sums of their widths."""
    width = F.when(F.col("n") == 1, 1100.0).otherwise(1200.0)
    before = F.coalesce(F.sum(width).over(Window.orderBy("component").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return components.select("component", "n", (F.lit(right + 1200.0) + before).alias("x"))


def regrid(boxes: DataFrame, n: int, mean_w: float, mean_h: float) -> DataFrame:
    """Rows of 20 % overlapping images for an exploded layout, ordered by coarse rows, then by x."""
    cols = max(1, math.ceil(math.sqrt(n * mean_w / mean_h)))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    i = F.row_number().over(Window.orderBy(F.floor(cy / (2 * mean_h)), cx, "image_id")) - 1
    b = boxes.withColumn("i", i)
    return b.select("image_id", ((F.col("i") % cols) * (0.8 * mean_w)).cast("int").alias("x"), (F.floor(F.col("i") / cols) * (0.8 * mean_h)).cast("int").alias("y"))
