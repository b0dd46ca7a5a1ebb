"""Column expressions on gray tiles: arrays of height * width values, row by row.

Every expression stays within its row, so scoring or filtering images moves no pixels between
executors. What looks at neighbouring pixels is vectorised over Arrow batches. Borders are reflected without repeating the edge (-1 is 1, n is n - 2).
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions import kernels

LAPLACE = ((0, 1, 0), (1, -4, 1), (0, 1, 0))
HIGH_PASS = ((-1, -1, -1), (-1, 8, -1), (-1, -1, -1))
SOBEL_X = ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1))
SOBEL_Y = ((-1, -2, -1), (0, 0, 0), (1, 2, 1))
#: Separable weights 1 2 1, a small Gaussian.
GAUSS = ((1 / 16, 2 / 16, 1 / 16), (2 / 16, 4 / 16, 2 / 16), (1 / 16, 2 / 16, 1 / 16))
BOX = ((1 / 9,) * 3,) * 3


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row, however often the body or its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def reflect(v: Column, n: Column | int) -> Column:
    last = (F.lit(n) if isinstance(n, int) else n) - 1
    return F.when(v < 0, -v).when(v > last, 2 * last - v).otherwise(v)


def gray_from_unit(vector: Column) -> Column:
    """Values around 0 as gray levels 0..255, truncated like an unsigned byte."""
    return F.transform(vector, lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (v.cast("double") + 0.5) * 255))).cast("int"))


def bgr_to_gray(b: Column, g: Column, r: Column) -> Column:
    return F.zip_with(F.zip_with(b, g, lambda x, y: 0.114 * x + 0.587 * y), r, lambda s, z: s + 0.299 * z)


def convolve(px: Column, width: Column | int, height: Column | int, kernel: Sequence[Sequence[float]]) -> Column:
    """3 x 3 correlation with reflected borders, vectorised over the images of an Arrow batch."""
    weights = tuple(tuple(float(k) for k in row) for row in kernel)

    @F.arrow_udf("array<double>")
    def run(values: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        return kernels.convolved(values, w, h, weights)

    return run(px, *[F.lit(n) if isinstance(n, int) else n for n in (width, height)])


def measures(px: Column, width: Column | int, height: Column | int) -> Column:
    """A struct of laplacian, gradient, deviation and noise, in one pass over each image."""

    @F.arrow_udf("laplacian double, gradient double, deviation double, noise double")
    def run(values: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        return kernels.measures(values, w, h)

    return run(px, *[F.lit(n) if isinstance(n, int) else n for n in (width, height)])


def _moments(a: Column, finish) -> Column:
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0.0).alias("n"))
    return F.aggregate(a, start, lambda t, v: F.struct((t["s"] + v.cast("double")).alias("s"), (t["q"] + v.cast("double") * v.cast("double")).alias("q"), (t["n"] + 1).alias("n")), finish)


def mean(a: Column) -> Column:
    return _moments(a, lambda t: t["s"] / t["n"])


def variance(a: Column) -> Column:
    """Population variance, in one pass over sums and squares."""
    return _moments(a, lambda t: F.greatest(F.lit(0.0), t["q"] / t["n"] - (t["s"] / t["n"]) * (t["s"] / t["n"])))


def deviation(a: Column) -> Column:
    return F.sqrt(variance(a))


def clip(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def normalise(v: Column, low: float, high: float) -> Column:
    return F.lit(0.0) if low == high else clip((v - low) / (high - low))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two equally long arrays; 0 where one is constant."""

    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return kernels.correlations(x, y)

    return run(a, b)
