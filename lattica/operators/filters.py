"""Per-image filters (E and O families, F3): column expressions where the formula allows, Arrow batches of numpy where it is spectral or iterative."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import tiles as t

#: Levels of enhancement: clip limit, tiles a side, denoising h, sharpening, colour normalisation.
LEVELS = {"light": (1.5, 4, 3, 0.1, False), "balanced": (2.5, 8, 5, 0.2, True), "aggressive": (4.0, 16, 7, 0.3, True)}


def byte(v: Column) -> Column:
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(v, 6)))).cast("int")


def unsharp(px: Column, w: int, h: int, strength: float) -> Column:
    return F.zip_with(px, t.convolve(px, w, h, t.GAUSS), lambda v, b: byte((1 + strength) * v - strength * b))


def laplacian_sharpen(px: Column, w: int, h: int, strength: float) -> Column:
    return F.zip_with(px, t.convolve(px, w, h, t.LAPLACE), lambda v, l: byte(v - strength * l))


def shadow_normalised(px: Column, w: int, h: int, strength: float) -> Column:
    """Value over its surroundings, times 128, mixed with the value by strength."""
    near = F.transform(t.convolve(px, w, h, t.BOX), lambda b: F.greatest(F.round(b, 9), F.lit(1.0)))
    return F.zip_with(px, near, lambda v, b: byte(F.round((1 - strength) * v + strength * F.least(F.lit(255.0), v / b * 128), 5)))


def minmax(px: Column, low: float, high: float) -> Column:
    def scaled(p: Column) -> Column:
        ends = F.struct(F.array_min(p).alias("a"), F.array_max(p).alias("b"))
        return t.let(ends, lambda e: F.transform(p, lambda v: F.when(e["b"] > e["a"], F.round(low + (v - e["a"]) * (high - low) / (e["b"] - e["a"]), 6)).otherwise(F.lit(float(low)))))

    return t.let(px, scaled)


def percentile(px: Column, q: float) -> Column:
    """Linear interpolation between the two nearest ranks."""

    def between(s: Column) -> Column:
        at = (F.size(s) - 1) * F.lit(q)
        lo = F.floor(at).cast("int")
        a, b = F.get(s, lo).cast("double"), F.get(s, F.least(lo + 1, F.size(s) - 1)).cast("double")
        return a + (b - a) * (at - lo)

    return t.let(F.sort_array(px), between)


def percentile_stretch(images: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    def stretched(p: Column) -> Column:
        ends = F.struct(percentile(p, low).alias("lo"), percentile(p, high).alias("hi"))
        return t.let(ends, lambda e: F.transform(p, lambda v: F.when(e["hi"] > e["lo"], byte((v - e["lo"]) * 255 / (e["hi"] - e["lo"]))).otherwise(v)))

    return images.withColumn("px", t.let(F.col("px"), stretched))


def gray_world(a: Column) -> Column:
    """Half of the channel's distance from 128 taken off."""
    return t.let(a, lambda p: t.let(t.mean(p), lambda m: F.transform(p, lambda v: F.round(v - (m - 128) / 2, 6))))


def histogram(px: Column, bins: int = 16) -> Column:
    """Normalised histogram of values 0..255."""
    size = 256 // bins
    return t.let(px, lambda p: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(p, lambda v: F.floor(v / size) == b)) / F.size(p)))


def upscale_nearest(px: Column, w: int, h: int, factor: int) -> Column:
    return t.let(px, lambda p: F.transform(F.sequence(F.lit(0), F.lit(w * h * factor * factor - 1)), lambda i: F.get(p, (F.floor(F.floor(i / (w * factor)) / factor) * w + F.floor((i % (w * factor)) / factor)).cast("int"))))


def applied(images: DataFrame, run: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Filter every image (image_id, width, height, px) with a numpy function of its matrix; images are independent rows."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                m = run(np.asarray(r.px, dtype=np.float64).reshape(r.height, r.width))
                out.append((r.image_id, m.shape[1], m.shape[0], np.floor(np.clip(np.round(m, 6), 0, 255)).astype(np.int32).ravel().tolist()))
            yield pd.DataFrame(out, columns=["image_id", "width", "height", "px"])

    return images.select("image_id", "width", "height", "px").mapInPandas(batches, "image_id long, width int, height int, px array<int>")


def clahe(m: np.ndarray, limit: float = 2.0, tiles: int = 2) -> np.ndarray:
    """Clip-limited equalisation of each tile, blended bilinearly between tile centres."""
    h, w = m.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    v = m.astype(int)
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            part = v[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            hist = np.bincount(part.ravel(), minlength=256).astype(float)
            cap = max(1.0, limit * part.size / 256)
            over = np.maximum(hist - cap, 0).sum()
            maps[i, j] = np.cumsum(np.minimum(hist, cap) + over / 256) * 255 / max(1, part.size)

    def mix(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = np.clip((np.arange(n) + 0.5) * tiles / n - 0.5, 0, tiles - 1)
        lo = np.floor(p).astype(int)
        return lo, np.minimum(lo + 1, tiles - 1), p - lo

    y0, y1, fy = mix(h)
    x0, x1, fx = mix(w)
    at = lambda a, b: maps[a[:, None], b[None], v]
    top = (1 - fx) * at(y0, x0) + fx * at(y0, x1)
    low = (1 - fx) * at(y1, x0) + fx * at(y1, x1)
    return (1 - fy[:, None]) * top + fy[:, None] * low


def nl_means(m: np.ndarray, h: float = 10.0, template: int = 1, search: int = 3) -> np.ndarray:
    """Mean of surrounding pixels, weighted by how alike their neighbourhoods are."""
    pad = template + search
    p = np.pad(m, pad, mode="reflect") if min(m.shape) > pad else np.pad(m, pad, mode="edge")
    rows, cols = m.shape
    total, weights = np.zeros_like(m), np.zeros_like(m)
    for dy in range(-search, search + 1):
        for dx in range(-search, search + 1):
            d = np.zeros_like(m)
            for ty in range(-template, template + 1):
                for tx in range(-template, template + 1):
                    a = p[pad + ty : pad + ty + rows, pad + tx : pad + tx + cols]
                    b = p[pad + ty + dy : pad + ty + dy + rows, pad + tx + dx : pad + tx + dx + cols]
                    d += (a - b) ** 2
            w = np.exp(-d / ((2 * template + 1) ** 2 * h * h))
            total += w * p[pad + dy : pad + dy + rows, pad + dx : pad + dx + cols]
            weights += w
    return total / weights


def wiener(m: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Deconvolution of a Gaussian blur with a constant noise term."""
    h, w = m.shape
    y, x = np.minimum(np.arange(h), h - np.arange(h)), np.minimum(np.arange(w), w - np.arange(w))
    psf = np.exp(-(y[:, None] ** 2 + x[None] ** 2) / (2 * sigma * sigma))
    f = np.fft.fft2(psf / psf.sum())
    return np.real(np.fft.ifft2(np.fft.fft2(m) * np.conj(f) / (np.abs(f) ** 2 + 0.01 + 1e-10)))


def inpaint(m: np.ndarray, low: float = 5, high: float = 250) -> np.ndarray:
    """Gaps (almost black or white) filled from their borders inwards with the mean of known neighbours."""
    known, out = (m >= low) & (m <= high), m.copy()
    while not known.all() and known.any():
        p, k = np.pad(out * known, 1), np.pad(known.astype(float), 1)
        n = sum(k[dy : dy + m.shape[0], dx : dx + m.shape[1]] for dy in range(3) for dx in range(3))
        s = sum(p[dy : dy + m.shape[0], dx : dx + m.shape[1]] for dy in range(3) for dx in range(3))
        new = ~known & (n > 0)
        out[new] = s[new] / n[new]
        known |= new
    return out


#: Filters of the output by name, in the order in which they apply.
STEPS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"denoise": nl_means, "deblur": wiener, "clahe": clahe}


def post_process(images: DataFrame, w: int, h: int, shadow: float = 0, denoise: bool = False, deblur: bool = False, equalise: bool = False, sharpen: float = 0, upscale: int = 1) -> DataFrame:
    """Shadow, denoise, deblur, equalise, sharpen, upscale, in this order; all off by default."""
    out = images
    if shadow:
        out = out.withColumn("px", shadow_normalised(F.col("px"), w, h, shadow))
    for name, on in (("denoise", denoise), ("deblur", deblur), ("clahe", equalise)):
        if on:
            out = applied(out, STEPS[name])
    if sharpen:
        out = out.withColumn("px", unsharp(F.col("px"), w, h, sharpen))
    if upscale > 1:
        out = out.withColumn("px", upscale_nearest(F.col("px"), w, h, upscale)).withColumn("width", F.col("width") * upscale).withColumn("height", F.col("height") * upscale)
    return out
