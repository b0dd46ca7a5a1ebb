"""Previews of a layout (V family): scaled, turned images on a white canvas, as a table of cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions import kernels as k
from lattica.plans.tables import written

#: Longest side of an image and of the canvas, and the angle in degrees from which images are turned.
IMAGE_SIDE, CANVAS_SIDE, TURNED = 600, 8000, 0.5


def rotated(m: np.ndarray, degrees: float, outside: float = 255.0) -> np.ndarray:
    """The image turned about its centre on a canvas that holds all of it."""
    h, w = m.shape[:2]
    t = np.radians(-degrees)
    cos, sin = np.cos(t), np.sin(t)
    new_w, new_h = int(h * abs(sin) + w * abs(cos)), int(h * abs(cos) + w * abs(sin))
    y, x = np.mgrid[:new_h, :new_w]
    dy, dx = y - new_h / 2, x - new_w / 2
    return k.bilinear(m, sin * dx + cos * dy + h / 2, cos * dx - sin * dy + w / 2, outside)


def normalised(m: np.ndarray) -> np.ndarray:
    """Three channels whatever the image has."""
    return k.three(m if m.ndim == 3 else m[:, :, None])


CELLS = T.StructType([T.StructField(n, T.LongType()) for n in ("seq", "y", "x")] + [T.StructField(n, T.IntegerType()) for n in ("b", "g", "r")] + [T.StructField("white", T.BooleanType())])


def scale(boxes: DataFrame) -> float:
    """By which an exploded layout (x0, y0, width, height) is scaled, so that images and canvas keep within their limits."""
    row = boxes.agg(F.max(F.greatest("width", "height")), F.max(F.col("x0") + F.col("width")) - F.min("x0"), F.max(F.col("y0") + F.col("height")) - F.min("y0")).first()
    if row[0] is None:
        return 1.0
    return float(min(1.0, IMAGE_SIDE / row[0], CANVAS_SIDE / max(row[1], row[2], 1)))


def canvas(images: DataFrame, border: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Cells y, x, b, g, r of a preview of placed colour images (x0, y0, angle, seq): later images lie over earlier ones.

    Turned images cover others only where they are not white; each has a border of one cell.
    Cells that no image covers are left out: they are white. An empty table gives no cells.
    """
    s = scale(images)

    def cells(r: dict) -> list[dict]:
        m = normalised(k.colour_of(r)).astype(np.float64)
        m = k.area_resized(m, max(1, int(m.shape[0] * s)), max(1, int(m.shape[1] * s))) if s < 1 else m
        turned = abs(r["angle"] or 0.0) > TURNED
        m = k.as_bytes(rotated(m, r["angle"]) if turned else m).astype(int)
        if not turned:
            m[[0, -1]] = m[:, [0, -1]] = border
        y0, x0 = int(r["y0"] * s), int(r["x0"] * s)
        white = (m >= 250).all(axis=2) & turned
        return [dict(seq=r["seq"], y=y0 + y, x=x0 + x, b=int(m[y, x, 0]), g=int(m[y, x, 1]), r=int(m[y, x, 2]), white=bool(white[y, x])) for y in range(m.shape[0]) for x in range(m.shape[1])]

    all_ = k.each_row(images.select("seq", "height", "width", "n_channels", "data", "x0", "y0", F.col("angle").cast("double")), cells, CELLS)
    return all_.filter("not white").groupBy("y", "x").agg(F.max_by(F.struct("b", "g", "r"), "seq").alias("_c")).select("y", "x", "_c.*")


def saved(images: DataFrame, path: str, quality: str = "high") -> int | None:
    """Write the preview as an image file; None if there is nothing to show."""
    from lattica.sources import sinks

    cells = written(canvas(images), "preview")
    return None if cells.isEmpty() else sinks.save(on_white(cells), path, quality)


def on_white(cells: DataFrame) -> DataFrame:
    """The cells and white ones for the rest of their box."""
    box = cells.agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    every = box.select(F.explode(F.sequence("y0", "y1")).alias("y"), "x0", "x1").select("y", F.explode(F.sequence("x0", "x1")).alias("x"))
    return every.join(cells, ["y", "x"], "left").select("y", "x", *[F.coalesce(c, F.lit(255)).alias(c) for c in "bgr"])
