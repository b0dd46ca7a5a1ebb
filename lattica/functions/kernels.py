"""Pixel kernels on whole images as numpy arrays, and how they are applied to tables of images.

Images are rows: gray ones with px, an array of height * width values, colour ones with data,
height * width * n_channels bytes in the order blue, green, red(, alpha). Each row is handled
where it lies, a batch of rows at a time; memory is that of a few images.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

GRAY = T.StructType([T.StructField("image_id", T.LongType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("px", T.ArrayType(T.DoubleType()))])
COLOUR = T.StructType([*GRAY.fields[:3], T.StructField("n_channels", T.IntegerType()), T.StructField("data", T.BinaryType())])

# ---- rows and arrays ---------------------------------------------------------------------------


def gray_of(row: dict) -> np.ndarray:
    return np.asarray(row["px"], dtype=np.float64).reshape(row["height"], row["width"])


def colour_of(row: dict) -> np.ndarray:
    """Height x width x channels, unsigned bytes."""
    return np.frombuffer(row["data"], dtype=np.uint8).reshape(row["height"], row["width"], row["n_channels"])


def gray_row(m: np.ndarray, **more) -> dict:
    return dict(more, height=m.shape[0], width=m.shape[1], px=m.ravel().astype(np.float64))


def colour_row(m: np.ndarray, **more) -> dict:
    m = as_bytes(m)
    m = m[:, :, None] if m.ndim == 2 else m
    return dict(more, height=m.shape[0], width=m.shape[1], n_channels=m.shape[2], data=m.tobytes())


def each_row(images: DataFrame, f: Callable[[dict], Iterator[dict] | dict | None], schema: T.StructType) -> DataFrame:
    """f of every row: a row, several, or none."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            columns = [batch.column(i) for i in range(len(names))]
            for i in range(batch.num_rows):
                # arrays of numbers stay numpy arrays
                row = {n: (c[i].values.to_numpy(zero_copy_only=False) if c[i].is_valid and pa.types.is_list(c.type) and pa.types.is_primitive(c.type.value_type) else c[i].as_py()) for n, c in zip(names, columns, strict=True)}
                out = f(row)
                rows = [] if out is None else [out] if isinstance(out, dict) else list(out)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return images.mapInArrow(run, schema)


def gray_images(images: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Gray images image_id, height, width, px with f applied to each."""
    return each_row(images.select("image_id", "height", "width", "px"), lambda r: gray_row(f(gray_of(r)), image_id=r["image_id"]), GRAY)


def colour_images(images: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Colour images image_id, height, width, n_channels, data with f applied to each (an alpha channel is kept apart).

    An image for which f fails stays as it was.
    """

    def run(r: dict) -> dict:
        m = colour_of(r)
        try:
            out = f(three(m))
        except (ValueError, ArithmeticError, IndexError, np.linalg.LinAlgError):
            return colour_row(m, image_id=r["image_id"])
        if m.shape[2] == 4 and out.shape[:2] == m.shape[:2]:
            out = np.concatenate([as_bytes(out), m[:, :, 3:]], axis=2)
        return colour_row(out, image_id=r["image_id"])

    return each_row(images.select("image_id", "height", "width", "n_channels", "data"), run, COLOUR)


def three(m: np.ndarray) -> np.ndarray:
    """Three channels: one is repeated, a fourth is left out."""
    return np.repeat(m, 3, axis=2) if m.shape[2] == 1 else m[:, :, :3]


def as_bytes(m: np.ndarray) -> np.ndarray:
    return m if m.dtype == np.uint8 else np.clip(np.rint(m), 0, 255).astype(np.uint8)


# ---- neighbourhoods ----------------------------------------------------------------------------


def bordered(m: np.ndarray, r: int) -> np.ndarray:
    """r reflected cells on each side, the edge not repeated (a single row or column is)."""
    pad = [(r, r), (r, r)] + [(0, 0)] * (m.ndim - 2)
    return np.pad(m, pad, mode="reflect") if min(m.shape[:2]) > 1 else np.pad(m, pad, mode="edge")


def correlate(m: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation with an odd kernel, cell by cell of the kernel."""
    r = kernel.shape[0] // 2
    p = bordered(m, r)
    out = np.zeros(m.shape, dtype=np.float64)
    for y, x in zip(*np.nonzero(kernel), strict=True):
        out += kernel[y, x] * p[y : y + m.shape[0], x : x + m.shape[1]]
    return out


def along(m: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    r = len(weights) // 2
    pad = [(0, 0)] * m.ndim
    pad[axis] = (r, r)
    p = np.pad(m, pad, mode="reflect" if m.shape[axis] > 1 else "edge")
    out = np.zeros(m.shape, dtype=np.float64)
    for i, w in enumerate(weights):
        part = [slice(None)] * m.ndim
        part[axis] = slice(i, i + m.shape[axis])
        out += w * p[tuple(part)]
    return out


def gaussian(m: np.ndarray, sigma: float, size: int = 0) -> np.ndarray:
    """Separable Gaussian; without a size it reaches three sigmas."""
    r = size // 2 if size else max(1, int(3 * sigma + 0.5))
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    return along(along(m.astype(np.float64), w, 1), w, 0)


SOBEL = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], dtype=np.float64)
LAPLACE = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], dtype=np.float64)
HIGH_PASS = np.array([[-1, -1, -1], [-1, 8, -1], [-1, -1, -1]], dtype=np.float64)


def sobel(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return correlate(m, SOBEL), correlate(m, SOBEL.T)


def greatest_near(m: np.ndarray, r: int, times: int = 1) -> np.ndarray:
    """Dilation by a square of 2 r + 1 cells, cells outside left out."""
    for _ in range(times):
        low = np.pad(m.astype(np.float64), r, constant_values=-np.inf)
        rows = np.max([low[:, i : i + m.shape[1]] for i in range(2 * r + 1)], axis=0)
        m = np.max([rows[i : i + m.shape[0]] for i in range(2 * r + 1)], axis=0)
    return m


def distance_inside(mask: np.ndarray) -> np.ndarray:
    """Chessboard distance of each cell of the mask to the nearest cell that isn't in it, or to the border."""
    out, inner = np.zeros(mask.shape), mask.astype(bool)
    while inner.any():
        out += inner
        p = np.pad(inner, 1)
        inner = np.all([p[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(3) for j in range(3)], axis=0)
    return out


# ---- sizes -------------------------------------------------------------------------------------


def _shares(n: int, m: int) -> np.ndarray:
    """Row i: the share of each of n cells in the i-th of m equal parts."""
    edges = np.linspace(0, n, m + 1)
    low, high = np.arange(n), np.arange(n) + 1
    inside = np.minimum(high[None], edges[1:, None]) - np.maximum(low[None], edges[:-1, None])
    return np.maximum(inside, 0) / (n / m)


def area_resized(m: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each new cell is the mean of the area that it covers."""
    rows = np.tensordot(_shares(m.shape[0], height), m.astype(np.float64), axes=(1, 0))
    return np.moveaxis(np.tensordot(_shares(m.shape[1], width), rows, axes=(1, 1)), 0, 1)


def bounded(m: np.ndarray, most: int) -> np.ndarray:
    """Scaled down by areas so that no side is longer than `most`; never up."""
    s = most / max(m.shape[:2])
    return m if s >= 1 else area_resized(m, max(1, int(m.shape[0] * s)), max(1, int(m.shape[1] * s)))


def bilinear(m: np.ndarray, y: np.ndarray, x: np.ndarray, outside: float = 0.0) -> np.ndarray:
    """Values at real places, with `outside` beyond the cells."""
    p = np.pad(m.astype(np.float64), [(1, 1), (1, 1)] + [(0, 0)] * (m.ndim - 2), constant_values=outside)
    y, x = np.clip(y + 1, 0, m.shape[0] + 1 - 1e-9), np.clip(x + 1, 0, m.shape[1] + 1 - 1e-9)
    i, j = np.floor(y).astype(int), np.floor(x).astype(int)
    v, u = y - i, x - j
    if m.ndim == 3:
        v, u = v[..., None], u[..., None]
    return (1 - v) * ((1 - u) * p[i, j] + u * p[i, j + 1]) + v * ((1 - u) * p[i + 1, j] + u * p[i + 1, j + 1])


def resized(m: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, cell centres on cell centres, edges repeated."""
    y = np.clip((np.arange(height) + 0.5) * m.shape[0] / height - 0.5, 0, m.shape[0] - 1)
    x = np.clip((np.arange(width) + 0.5) * m.shape[1] / width - 0.5, 0, m.shape[1] - 1)
    return bilinear(m, *np.meshgrid(y, x, indexing="ij"))


# ---- colour ------------------------------------------------------------------------------------

# Weights of blue, green, red in gray; linear sRGB to CIE XYZ (D65) and its white.
GRAY_WEIGHTS = np.array([0.114, 0.587, 0.299])
XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
WHITE = np.array([0.950456, 1.0, 1.088754])


def luma(m: np.ndarray) -> np.ndarray:
    return m[:, :, 0].astype(np.float64) if m.shape[2] == 1 else m[:, :, :3] @ GRAY_WEIGHTS


def lab(m: np.ndarray) -> np.ndarray:
    """CIE L*a*b* of blue, green, red bytes, each channel scaled to 0..255."""
    c = m[:, :, 2::-1] / 255.0
    linear = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    f = linear @ XYZ.T / WHITE
    g = np.where(f > 0.008856, np.cbrt(f), 7.787 * f + 16 / 116)
    lightness = np.where(f[..., 1] > 0.008856, 116 * np.cbrt(f[..., 1]) - 16, 903.3 * f[..., 1])
    return np.stack([lightness * 255 / 100, 500 * (g[..., 0] - g[..., 1]) + 128, 200 * (g[..., 1] - g[..., 2]) + 128], axis=-1)


def from_lab(v: np.ndarray) -> np.ndarray:
    """Blue, green, red values (0..255, not rounded) of scaled L*a*b*."""
    lightness = v[..., 0] * 100 / 255
    y = (lightness + 16) / 116
    f = np.stack([y + (v[..., 1] - 128) / 500, y, y - (v[..., 2] - 128) / 200], axis=-1)
    xyz = np.where(f > 0.206893, f**3, (f - 16 / 116) / 7.787)
    xyz[..., 1] = np.where(lightness > 7.9996, y**3, lightness / 903.3)
    linear = np.clip((xyz * WHITE) @ np.linalg.inv(XYZ).T, 0, 1)
    c = np.where(linear > 0.0031308, 1.055 * linear ** (1 / 2.4) - 0.055, 12.92 * linear)
    return c[..., ::-1] * 255


def with_lightness(m: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The image with f applied to its lightness."""
    v = lab(m)
    v[..., 0] = np.clip(f(v[..., 0]), 0, 255)
    return np.clip(from_lab(v), 0, 255)


def equalised(m: np.ndarray, limit: float, tiles: int) -> np.ndarray:
    """Contrast-limited histogram equalisation on tiles x tiles equal parts, blended bilinearly between their centres.

    Where the parts would not be equal the image is continued by reflection.
    """
    high, wide = m.shape
    tiles_y, tiles_x = min(tiles, high), min(tiles, wide)
    m = np.pad(m, [(0, -high % tiles_y), (0, -wide % tiles_x)], mode="symmetric")
    h, w = m.shape
    ys, xs = np.arange(h) * tiles_y // h, np.arange(w) * tiles_x // w
    level = np.clip(m, 0, 255).astype(int)
    part = ys[:, None] * tiles_x + xs[None]
    count = np.bincount((part * 256 + level).ravel(), minlength=tiles_y * tiles_x * 256).reshape(-1, 256).astype(np.float64)
    size = count.sum(axis=1, keepdims=True)
    most = np.maximum(1, limit * size / 256)
    over = np.maximum(count - most, 0).sum(axis=1, keepdims=True)
    table = (np.cumsum(np.minimum(count, most) + over / 256, axis=1) * 255 / size).reshape(tiles_y, tiles_x, 256)
    y = np.clip((np.arange(h) + 0.5) * tiles_y / h - 0.5, 0, tiles_y - 1)
    x = np.clip((np.arange(w) + 0.5) * tiles_x / w - 0.5, 0, tiles_x - 1)
    i, j = np.minimum(y.astype(int), max(0, tiles_y - 2)), np.minimum(x.astype(int), max(0, tiles_x - 2))
    i2, j2 = np.minimum(i + 1, tiles_y - 1), np.minimum(j + 1, tiles_x - 1)
    v, u = (y - i)[:, None], (x - j)[None]
    at = lambda a, b: table[a[:, None], b[None], level]
    return ((1 - v) * ((1 - u) * at(i, j) + u * at(i, j2)) + v * ((1 - u) * at(i2, j) + u * at(i2, j2)))[:high, :wide]


# ---- columns of gray images ---------------------------------------------------------------------

#: Cells of equally large images that are handled at once.
STACKED = 1 << 22


def stacks(px: pa.Array, width: pa.Array, height: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and images (n x height x width) of each size; rows without pixels, or not as many as their size says, are left out."""
    size = np.asarray(px.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    w, h = (np.asarray(c.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64) for c in (width, height))
    flat = px.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(size) - size
    fit = (size > 0) & (size == w * h)
    for key in np.unique(h[fit] << 32 | w[fit]).tolist():
        rows = np.flatnonzero(fit & ((h << 32 | w) == key))
        high, wide = key >> 32, key & 0xFFFFFFFF
        step = max(1, STACKED // (high * wide))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            yield part, flat[begin[part][:, None] + np.arange(high * wide)].reshape(-1, high, wide)


def _around(m: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """The nine neighbours of each cell of stacked images, borders reflected."""
    p = np.pad(m, [(0, 0), (1, 1), (1, 1)], mode="reflect") if min(m.shape[1:]) > 1 else np.pad(m, [(0, 0), (1, 1), (1, 1)], mode="edge")
    return {(y, x): p[:, y : y + m.shape[1], x : x + m.shape[2]] for y in range(3) for x in range(3)}


def convolved(px: pa.Array, width: pa.Array, height: pa.Array, kernel: tuple[tuple[float, ...], ...]) -> pa.Array:
    """3 x 3 correlation of each row's image (null or ill-sized images: null)."""
    rows, parts = [], []
    for part, m in stacks(px, width, height):
        near = _around(m)
        out = sum(k * near[y, x] for y, line in enumerate(kernel) for x, k in enumerate(line) if k)
        rows.append(part)
        parts.append(out.reshape(len(part), -1))
    size = np.zeros(len(px), dtype=np.int64)
    for part, out in zip(rows, parts, strict=True):
        size[part] = out.shape[1]
    begin = np.concatenate([[0], np.cumsum(size)])
    flat = np.empty(begin[-1])
    for part, out in zip(rows, parts, strict=True):
        flat[begin[part][:, None] + np.arange(out.shape[1])] = out
    known = size > 0
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32), mask=np.concatenate([~known, [False]])), pa.array(flat))


def measures(px: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
    """Structs laplacian (its variance), gradient (mean), deviation, noise (deviation of the high pass) of each row's image; zeros without one."""
    out = np.zeros((4, len(px)))
    for rows, m in stacks(px, width, height):
        near = _around(m)
        cross = near[0, 1] + near[1, 0] + near[1, 2] + near[2, 1]
        corners = near[0, 0] + near[0, 2] + near[2, 0] + near[2, 2]
        gx = near[0, 2] - near[0, 0] + 2 * (near[1, 2] - near[1, 0]) + near[2, 2] - near[2, 0]
        gy = near[2, 0] - near[0, 0] + 2 * (near[2, 1] - near[0, 1]) + near[2, 2] - near[0, 2]
        each = (1, 2)
        out[:, rows] = (cross - 4 * m).var(axis=each), np.hypot(gx, gy).mean(axis=each), m.std(axis=each), (8 * m - cross - corners).std(axis=each)
    return pa.StructArray.from_arrays([pa.array(v) for v in out], names=["laplacian", "gradient", "deviation", "noise"])


def correlations(a: pa.Array, b: pa.Array) -> pa.Array:
    """Pearson correlation of each row's two arrays of one length; 0 where one is constant, null where one is missing or of another length."""
    size = np.asarray(a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    other = np.asarray(b.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ones = pa.array(np.ones(len(a), dtype=np.int32))
    out = np.full(len(a), np.nan)
    right = {int(r): m for rows, ms in stacks(b, pa.array(other), ones) for r, m in zip(rows, ms, strict=True)}
    for rows, m in stacks(a, pa.array(size), ones):
        rows, m = rows[size[rows] == other[rows]], m[size[rows] == other[rows]][:, 0]
        if not len(rows):
            continue
        n = np.stack([right[r][0] for r in rows.tolist()])
        x, y = m - m.mean(axis=1, keepdims=True), n - n.mean(axis=1, keepdims=True)
        scale = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
        out[rows] = np.where(scale > 0, (x * y).sum(axis=1) / np.where(scale > 0, scale, 1), 0.0)
    return pa.array(out, mask=np.isnan(out))
