"""Object-aware blending (G family): boundary maps, foreground, weights, and the weighted mean.

Maps are arrays of 0..255 of an image's size. Models are not part of the library: segmenting
functions are handed in (`model`), and without one the modes fall back to classical maps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions import kernels as k

#: Pairs of Canny thresholds, Gabor frequencies, and weights of the hybrid map.
CANNY = ((30, 100), (50, 150), (100, 200))
GABOR = (0.1, 0.2, 0.3)
HYBRID = {"edge": 0.7, "texture": 0.5, "colour": 0.3, "superpixel": 0.4}
MODES = ("sam", "deeplab", "hybrid", "edge")


def resolved(mode: str, available: tuple[str, ...] = ("hybrid", "edge")) -> str:
    """The mode, or the best one after it that is available; `auto` starts with the best, an unknown one with edge."""
    start = 0 if mode == "auto" else MODES.index(mode) if mode in MODES else len(MODES) - 1
    return next((m for m in MODES[start:] if m in available), "edge")


def label_boundary(label: np.ndarray, r: int = 2, times: int = 2) -> np.ndarray:
    """Where the label differs from the one below or to the right, widened."""
    out = np.zeros(label.shape)
    out[:-1] = np.maximum(out[:-1], 255 * (label[1:] != label[:-1]))
    out[:, :-1] = np.maximum(out[:, :-1], 255 * (label[:, 1:] != label[:, :-1]))
    return k.greatest_near(out, r, times) if times else out


def canny(gray: np.ndarray, low: float, high: float) -> np.ndarray:
    """Ridges of the gradient (sum of both absolute values) above `high`, and those above `low` that touch them."""
    gx, gy = k.sobel(gray)
    size = np.abs(gx) + np.abs(gy)
    p = np.pad(size, 1)
    around = lambda y, x: p[1 + y : 1 + y + gray.shape[0], 1 + x : 1 + x + gray.shape[1]]
    turn = np.rint(np.degrees(np.arctan2(gy, gx)) / 45).astype(int) % 4
    steps = ((0, 1), (1, 1), (1, 0), (1, -1))
    ridge = np.zeros(gray.shape, bool)
    for d, (y, x) in enumerate(steps):
        ridge |= (turn == d) & (size > around(-y, -x)) & (size >= around(y, x))
    weak, strong = ridge & (size > low), ridge & (size > high)
    while True:
        grown = weak & (k.greatest_near(strong, 1) > 0)
        if (grown == strong).all():
            return 255.0 * strong
        strong = grown


def _stretched(m: np.ndarray) -> np.ndarray:
    return np.floor(m / m.max() * 255) if m.max() > 0 else np.zeros(m.shape)


def edge_map(image: np.ndarray) -> np.ndarray:
    gray = np.rint(k.luma(image))
    found = [canny(gray, low, high) for low, high in CANNY]
    return k.greatest_near(np.max([*found, _stretched(np.hypot(*k.sobel(gray)))], axis=0), 1, 2)


def gabor(gray: np.ndarray, frequency: float, angle: float) -> np.ndarray:
    """Size of the response to a complex Gabor filter of one octave of bandwidth."""
    sigma = np.sqrt(np.log(2) / 2) / np.pi * 3 / frequency
    r = int(np.ceil(3 * sigma))
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    window = np.exp(-0.5 * (x**2 + y**2) / sigma**2) / (2 * np.pi * sigma**2)
    wave = np.exp(2j * np.pi * frequency * (x * np.cos(angle) + y * np.sin(angle)))
    size = [a + 2 * r for a in gray.shape]
    p = np.pad(gray, r, mode="reflect" if min(gray.shape) > r else "edge")
    out = np.fft.ifft2(np.fft.fft2(p) * np.fft.fft2(np.roll(np.pad(window * wave, [(0, size[0] - 2 * r - 1), (0, size[1] - 2 * r - 1)]), (-r, -r), (0, 1))))
    return np.abs(out)[r : r + gray.shape[0], r : r + gray.shape[1]]


def binary_pattern(gray: np.ndarray) -> np.ndarray:
    """Uniform local binary pattern of the eight neighbours: the number of ones if they are one run, else 9."""
    p = np.pad(gray, 1, mode="edge")
    ring = [(0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0), (0, 0)]
    bits = np.stack([p[y : y + gray.shape[0], x : x + gray.shape[1]] >= gray for y, x in ring]).astype(int)
    turns = np.abs(np.diff(np.concatenate([bits, bits[:1]]), axis=0)).sum(axis=0)
    return np.where(turns <= 2, bits.sum(axis=0), 9).astype(np.float64)


def texture_map(image: np.ndarray) -> np.ndarray:
    gray = np.rint(k.luma(image))
    mean = np.mean([gabor(gray / 255, f, a * np.pi / 4) for f in GABOR for a in range(4)], axis=0)
    return np.maximum(_stretched(np.hypot(*k.sobel(mean))), _stretched(np.abs(k.sobel(binary_pattern(gray))[0])))


def superpixels(image: np.ndarray, segments: int = 500, compactness: float = 10.0, rounds: int = 10) -> np.ndarray:
    """Labels by local k-means over L*a*b* and place; centres start on a lattice and see the cells around them only."""
    colour = k.lab(k.as_bytes(k.gaussian(image.astype(np.float64), 1.0)))
    h, w = colour.shape[:2]
    step = max(1.0, np.sqrt(h * w / segments))
    cy, cx = (np.arange(step / 2, n, step) for n in (h, w))
    centres = np.array([(y, x) for y in cy for x in cx])
    tones = colour[centres[:, 0].astype(int), centres[:, 1].astype(int)]
    label = np.zeros((h, w), dtype=int)
    for _ in range(rounds):
        best = np.full((h, w), np.inf)
        for n, (y, x) in enumerate(centres):
            a, b, c, d = max(0, int(y - step)), min(h, int(y + step) + 1), max(0, int(x - step)), min(w, int(x + step) + 1)
            place = (np.arange(a, b)[:, None] - y) ** 2 + (np.arange(c, d)[None] - x) ** 2
            far = ((colour[a:b, c:d] - tones[n]) ** 2).sum(axis=2) + place * (compactness / step) ** 2
            near = far < best[a:b, c:d]
            best[a:b, c:d][near], label[a:b, c:d][near] = far[near], n
        count = np.maximum(np.bincount(label.ravel(), minlength=len(centres)), 1)
        mean = lambda v: np.bincount(label.ravel(), weights=v.ravel(), minlength=len(centres)) / count
        used = np.bincount(label.ravel(), minlength=len(centres)) > 0
        moved = np.stack([mean(np.repeat(np.arange(h), w).astype(float)), mean(np.tile(np.arange(w), h).astype(float))], axis=1)
        centres = np.where(used[:, None], moved, centres)
        tones = np.where(used[:, None], np.stack([mean(colour[:, :, c]) for c in range(3)], axis=1), tones)
    return label


def superpixel_map(image: np.ndarray, segments: int = 500) -> np.ndarray:
    return label_boundary(superpixels(image, segments), 1, 1)


def colour_labels(image: np.ndarray, clusters: int = 8, rounds: int = 20) -> np.ndarray:
    """Clusters of L*a*b* values; centres start at quantiles of the lightness, so that the result is always the same."""
    v = k.lab(image).reshape(-1, 3)
    order = np.argsort(v[:, 0], kind="stable")
    centres = v[order[(np.arange(clusters) * 2 + 1) * len(v) // (2 * clusters)]]
    label = np.zeros(len(v), dtype=int)
    for _ in range(rounds):
        new = ((v[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        count = np.bincount(new, minlength=clusters)
        means = np.stack([np.bincount(new, weights=v[:, c], minlength=clusters) for c in range(3)], axis=1) / np.maximum(count, 1)[:, None]
        centres = np.where(count[:, None] > 0, means, centres)
        if (new == label).all():
            break
        label = new
    return label.reshape(image.shape[:2])


def colour_map(image: np.ndarray) -> np.ndarray:
    return label_boundary(colour_labels(image), 0, 0)


def hybrid_map(image: np.ndarray) -> np.ndarray:
    return _stretched(HYBRID["edge"] * edge_map(image) + HYBRID["texture"] * texture_map(image) + HYBRID["colour"] * colour_map(image) + HYBRID["superpixel"] * superpixel_map(image))


MAPS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"edge": edge_map, "texture": texture_map, "superpixel": superpixel_map, "colour": colour_map, "hybrid": hybrid_map}


def foreground(label: np.ndarray) -> np.ndarray:
    """1 on labelled objects, 0 on the background, smoothed over 15 cells."""
    return k.gaussian((label > 0).astype(np.float64), 2.6, 15)


def weight(height: int, width: int, boundary: np.ndarray | None = None, front: np.ndarray | None = None, alpha: np.ndarray | None = None, boost: float = 1.5, mode: str = "hybrid") -> np.ndarray:
    """Weights that fall towards the border and at boundaries, and rise on the foreground."""
    y, x = np.minimum(np.arange(height), np.arange(height)[::-1]), np.minimum(np.arange(width), np.arange(width)[::-1])
    near = np.minimum(y[:, None], x[None])
    out = np.clip(near / 10.0, 0.5, 1.0) if mode == "sam" else np.clip(near / 100.0, 0.0, 1.0)
    if boundary is not None:
        out = out * (1 - 0.3 * boundary / 255.0)
    if front is not None:
        out = out * (1 + (boost - 1) * front)
    return out if alpha is None else out * alpha


def boundaries(images: DataFrame, kind: str = "hybrid") -> DataFrame:
    """Gray images image_id, height, width, px of colour images' boundary maps."""
    return k.each_row(images.select("image_id", "height", "width", "n_channels", "data"), lambda r: k.gray_row(MAPS[kind](k.three(k.colour_of(r))), image_id=r["image_id"]), k.GRAY)


CELLS = T.StructType([T.StructField(n, T.LongType()) for n in ("image_id", "y", "x")] + [T.StructField(n, T.DoubleType()) for n in ("b", "g", "r", "weight")])


def layers(images: DataFrame, mode: str = "auto", model: Callable[[np.ndarray], np.ndarray] | None = None, boost: float = 1.5) -> DataFrame:
    """Canvas cells image_id, y, x, b, g, r, weight of placed colour images (x0, y0 on the canvas).

    `model` gives an image's labels (0: background) where there is one; else a classical map is used.
    """
    chosen = resolved(mode, ("sam", "deeplab", "hybrid", "edge") if model else ("hybrid", "edge"))

    def cells(r: dict) -> list[dict]:
        whole = k.colour_of(r)
        m, alpha = k.three(whole), whole[:, :, 3] / 255.0 if whole.shape[2] == 4 else None
        label = model(m) if model and chosen in ("sam", "deeplab") else None
        edge = label_boundary(label) if label is not None else MAPS[chosen](m)
        w = weight(*m.shape[:2], edge, None if label is None else foreground(label), alpha, boost, chosen)
        ys, xs = np.indices(w.shape)
        return [dict(image_id=r["image_id"], y=int(y), x=int(x), b=float(v[0]), g=float(v[1]), r=float(v[2]), weight=float(u)) for y, x, v, u in zip((ys + r["y0"]).ravel(), (xs + r["x0"]).ravel(), m.reshape(-1, 3), w.ravel(), strict=True)]

    return k.each_row(images.select("image_id", "height", "width", "n_channels", "data", "x0", "y0"), cells, CELLS)


def blend(cells: DataFrame) -> DataFrame:
    """Weighted mean of each canvas cell's layers; where all weights are 0, their plain mean."""
    sums = cells.groupBy("y", "x").agg(F.sum("weight").alias("_w"), *[F.sum(F.col(c) * F.col("weight")).alias(f"_{c}") for c in "bgr"], *[F.avg(c).alias(f"_p{c}") for c in "bgr"])
    return sums.select("y", "x", *[F.when(F.col("_w") > 0, F.col(f"_{c}") / F.col("_w")).otherwise(F.col(f"_p{c}")).alias(c) for c in "bgr"])
