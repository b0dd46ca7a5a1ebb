"""Keypoints and descriptors (F family): a gradient-based detector in Arrow batches, selection by windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions import kernels

SCHEMA = "image_id long, kp_id long, x double, y double, size double, angle double, response double, descriptor array<float>"


def _describe(m: np.ndarray, ys: np.ndarray, xs: np.ndarray, radius: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Dominant angles, and 4 x 4 cells of 8 orientation sums around each point (128 values, unit length)."""
    gy, gx = np.gradient(np.pad(m, radius, mode="edge"))
    size, turn = np.hypot(gx, gy), np.arctan2(gy, gx)
    out, angles = [], []
    for y, x in zip(ys, xs, strict=True):
        s, t = size[y : y + 2 * radius, x : x + 2 * radius], turn[y : y + 2 * radius, x : x + 2 * radius]
        angle = np.arctan2((s * np.sin(t)).sum(), (s * np.cos(t)).sum())
        octant = (np.floor((t - angle) / (np.pi / 4)) % 8).astype(int)
        cell = (np.arange(2 * radius) * 4 // (2 * radius))
        d = np.zeros((4, 4, 8))
        np.add.at(d, (cell[:, None], cell[None, :], octant), s)
        d = d.ravel()
        out.append(d / max(1e-9, np.linalg.norm(d)))
        angles.append(np.degrees(angle))
    return np.array(angles), np.array(out, dtype=np.float32).reshape(-1, 128)


def detect(images: DataFrame, grid: int | None = None) -> DataFrame:
    """Corner keypoints (or a lattice with steps of `grid`) of images image_id, width, height, px."""

    def rows(r: dict) -> list[dict]:
        ys, xs, size, angles, response, d = _dense(kernels.gray_of(r), grid) if grid else _corners(kernels.gray_of(r))
        return [dict(image_id=r["image_id"], kp_id=k, x=float(x), y=float(y), size=float(z), angle=float(a), response=float(v), descriptor=e.tolist()) for k, (y, x, z, a, v, e) in enumerate(zip(ys, xs, size, angles, response, d, strict=True))]

    return kernels.each_row(images.select("image_id", "height", "width", "px"), rows, T._parse_datatype_string(SCHEMA))


def top_by_response(keypoints: DataFrame, n: int, by: str = "image_id", order: str = "response", tie: str = "kp_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(order), F.asc(tie))
    return keypoints.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def adaptive_cap(n_images: int, cap: int) -> int:
    return min(cap, 2000) if n_images > 100 else min(cap, 3000) if n_images > 50 else cap


def with_fallback(images: DataFrame, least: int = 50) -> DataFrame:
    """Keypoints of each image; images with fewer than `least` are detected again after equalisation."""
    from lattica.operators.filters import applied, clahe

    first = detect(images)
    few = images.join(first.groupBy("image_id").agg(F.count("*").alias("_n")), "image_id", "left").filter(F.coalesce("_n", F.lit(0)) < least)
    again = detect(applied(few, clahe))
    return first.join(few.select("image_id"), "image_id", "left_anti").unionByName(again)


def _peaks(response: np.ndarray, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Cells that are the greatest of their neighbours and above `least`."""
    return np.nonzero((response == kernels.greatest_near(response, 1)) & (response > least))


def _circle(m: np.ndarray) -> np.ndarray:
    """The 16 cells at distance 3 around each cell, in order."""
    ring = [(0, 3), (1, 3), (2, 2), (3, 1), (3, 0), (3, -1), (2, -2), (1, -3), (0, -3), (-1, -3), (-2, -2), (-3, -1), (-3, 0), (-3, 1), (-2, 2), (-1, 3)]
    p = np.pad(m, 3, mode="edge")
    return np.stack([p[3 + y : 3 + y + m.shape[0], 3 + x : 3 + x + m.shape[1]] for y, x in ring])


def fast_corners(m: np.ndarray, threshold: float = 20.0) -> np.ndarray:
    """Corner strength of cells with nine consecutive cells around them that are all brighter or all darker (else 0)."""
    ring = _circle(m) - m
    out = np.zeros(m.shape)
    for sign in (1, -1):
        far = sign * ring - threshold
        arc = np.concatenate([far, far[:8]])
        run = np.max([np.min(arc[i : i + 9], axis=0) for i in range(16)], axis=0)
        out = np.maximum(out, np.where(run > 0, run + threshold, 0))
    return out


def binary_descriptors(m: np.ndarray, ys: np.ndarray, xs: np.ndarray, bits: int = 256, radius: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Angles towards the centre of brightness, and comparisons of smoothed cells at seeded places turned by them (0 or 1)."""
    smooth = kernels.gaussian(m, 2.0)
    p = np.pad(m, radius, mode="edge")
    y, x = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    disc = x**2 + y**2 <= radius**2
    patches = np.stack([p[b : b + 2 * radius + 1, a : a + 2 * radius + 1] for b, a in zip(ys, xs, strict=True)])
    angle = np.arctan2((patches * (y * disc)).sum((1, 2)), (patches * (x * disc)).sum((1, 2)))
    places = np.clip(np.random.default_rng(11).normal(0, radius / 2, (bits, 2, 2)), -radius, radius)
    cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    dx, dy = places[None, :, :, 0] * cos - places[None, :, :, 1] * sin, places[None, :, :, 0] * sin + places[None, :, :, 1] * cos
    v = smooth[np.clip(np.rint(ys[:, None, None] + dy).astype(int), 0, m.shape[0] - 1), np.clip(np.rint(xs[:, None, None] + dx).astype(int), 0, m.shape[1] - 1)]
    return np.degrees(angle), (v[:, :, 0] < v[:, :, 1]).astype(np.float32)


def _orb(m: np.ndarray) -> tuple[np.ndarray, ...]:
    response = fast_corners(m)
    ys, xs = _peaks(response)
    angles, d = binary_descriptors(m, ys, xs) if len(ys) else (np.zeros(0), np.zeros((0, 256), np.float32))
    return ys, xs, np.full(len(ys), 31.0), angles, response[ys, xs], d


def _akaze(m: np.ndarray, scales: tuple[float, ...] = (1.2, 2.0, 3.2)) -> tuple[np.ndarray, ...]:
    """Peaks of the scale-normalised determinant of second derivatives, over places and scales."""
    stack = []
    for sigma in scales:
        g = kernels.gaussian(m, sigma)
        gy, gx = np.gradient(g)
        (yy, yx), xx = np.gradient(gy), np.gradient(gx)[1]
        stack.append(sigma**4 * (xx * yy - yx * yx))
    best, level = np.max(stack, axis=0), np.argmax(stack, axis=0)
    ys, xs = _peaks(best, 1.0)
    angles, d = _describe(m, ys, xs) if len(ys) else (np.zeros(0), np.zeros((0, 128), np.float32))
    return ys, xs, 2 * np.array(scales)[level[ys, xs]], angles, best[ys, xs], d


def _dense(m: np.ndarray, grid: int) -> tuple[np.ndarray, ...]:
    ys, xs = (v.ravel() for v in np.mgrid[grid // 2 : m.shape[0] : grid, grid // 2 : m.shape[1] : grid])
    angles, d = _describe(m, ys, xs) if len(ys) else (np.zeros(0), np.zeros((0, 128), np.float32))
    return ys, xs, np.full(len(ys), float(grid)), angles, np.zeros(len(ys)), d


def _corners(m: np.ndarray) -> tuple[np.ndarray, ...]:
    gy, gx = np.gradient(m)
    box = lambda a: sum(np.pad(a, 1)[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3))
    xx, yy, xy = box(gx * gx), box(gy * gy), box(gx * gy)
    response = xx * yy - xy * xy - 0.04 * (xx + yy) ** 2
    ys, xs = _peaks(response)
    angles, d = _describe(m, ys, xs) if len(ys) else (np.zeros(0), np.zeros((0, 128), np.float32))
    return ys, xs, np.full(len(ys), 8.0), angles, response[ys, xs], d


def _lp_sift(m: np.ndarray, most: int = 4000) -> tuple[np.ndarray, ...]:
    """Corners of the equalised image, found on at most `most` cells a side and scaled back."""
    small = kernels.bounded(m, most)
    ys, xs, size, angles, response, d = _corners(np.rint(kernels.equalised(small, 2.0, 8)))
    fy, fx = m.shape[0] / small.shape[0], m.shape[1] / small.shape[1]
    return ys * fy, xs * fx, size * fx, angles, response, d


def _enhanced(m: np.ndarray, least: int = 500) -> tuple[np.ndarray, ...]:
    """Corners; if there are few, those of the image enhanced; then its determinant peaks; then a lattice added."""
    from lattica.operators.enhance import for_detection

    found = _corners(m)
    if len(found[0]) >= least:
        return found
    better = for_detection(m)
    for f in (_corners, _akaze):
        other = f(better)
        found = other if len(other[0]) > len(found[0]) else found
        if len(found[0]) >= least:
            return found
    if len(found[0]) < least // 2:
        found = tuple(np.concatenate(x) for x in zip(found, _dense(m, 20), strict=True))
    return found


#: Detectors by name; unknown names give the first.
DETECTORS = {"lp_sift": _lp_sift, "sift": _corners, "orb": _orb, "akaze": _akaze, "enhanced": _enhanced, "dense": lambda m: _dense(m, 4)}


def detector(name: str, most: int | None = None):
    """A function from gray images to their keypoints by a detector's name, the `most` strongest of each image."""
    points = DETECTORS.get(name, _lp_sift)
    schema = T._parse_datatype_string(SCHEMA)

    def rows(r: dict) -> list[dict]:
        ys, xs, size, angles, response, d = points(kernels.gray_of(r))
        order = np.lexsort((np.arange(len(ys)), -response))[:most] if most else np.arange(len(ys))
        return [dict(image_id=r["image_id"], kp_id=int(k), x=float(xs[i]), y=float(ys[i]), size=float(size[i]), angle=float(angles[i]), response=float(response[i]), descriptor=d[i].tolist()) for k, i in enumerate(np.sort(order).tolist())]

    return lambda images: kernels.each_row(images.select("image_id", "height", "width", "px"), rows, schema)


def colour_histograms(keypoints: DataFrame, images: DataFrame, radius: int = 5) -> DataFrame:
    """Per keypoint the normalised 16-bin histogram of the values around it in its gray image (px), clipped to the image."""
    return _histograms(keypoints, images.select("image_id", "height", "width", "px"), radius, lambda r: kernels.gray_of(r)[:, :, None])


def lab_histograms(keypoints: DataFrame, images: DataFrame, radius: int = 5) -> DataFrame:
    """Per keypoint three such histograms one after another, of the L*a*b* values of its colour image."""
    return _histograms(keypoints, images.select("image_id", "height", "width", "n_channels", "data"), radius, lambda r: kernels.lab(kernels.three(kernels.colour_of(r))))


def _histograms(keypoints: DataFrame, images: DataFrame, radius: int, values) -> DataFrame:
    """An image and its keypoints meet in one row; patches are slices of the image."""
    points = keypoints.groupBy("image_id").agg(F.collect_list(F.struct("kp_id", F.floor("x").cast("long").alias("x"), F.floor("y").cast("long").alias("y"))).alias("k"))

    def rows(r: dict) -> list[dict]:
        bins = np.clip(np.floor(values(r) / 16), 0, 15).astype(int)
        out = []
        for p in r["k"]:
            part = bins[max(0, p["y"] - radius) : max(0, p["y"] + radius + 1), max(0, p["x"] - radius) : max(0, p["x"] + radius + 1)]
            share = [np.bincount(part[:, :, c].ravel(), minlength=16) / max(1, part[:, :, c].size) for c in range(bins.shape[2])]
            out.append(dict(image_id=r["image_id"], kp_id=p["kp_id"], histogram=np.concatenate(share).tolist()))
        return out

    return kernels.each_row(images.join(points, "image_id"), rows, T._parse_datatype_string("image_id long, kp_id long, histogram array<double>"))


def with_colour(keypoints: DataFrame, images: DataFrame) -> DataFrame:
    """Keypoints whose descriptors end in the 48 values of their L*a*b* histograms."""
    return keypoints.join(lab_histograms(keypoints, images), ["image_id", "kp_id"]).withColumn("descriptor", F.concat("descriptor", F.transform("histogram", lambda v: v.cast("float")))).drop("histogram")
