"""Seams and repair (N family) and bundle adjustment (B family)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import kernels


def seam_path(cost: np.ndarray) -> np.ndarray:
    """Row of the cheapest left-to-right path in each column; steps to the three neighbouring rows, the same row first on ties, then the upper."""
    rows, cols = cost.shape
    total = cost[:, 0].astype(float)
    back = np.zeros((cols, rows), dtype=np.int64)
    for x in range(1, cols):
        p = np.pad(total, 1, constant_values=np.inf)
        options = np.stack([p[1:-1], p[:-2], p[2:]])
        pick = options.argmin(0)
        back[x] = np.arange(rows) + np.array([0, -1, 1])[pick]
        total = cost[:, x] + options[pick, np.arange(rows)]
    out = np.zeros(cols, dtype=np.int64)
    out[-1] = total.argmin()
    for x in range(cols - 1, 0, -1):
        out[x - 1] = back[x, out[x]]
    return out


def seams(costs: DataFrame) -> DataFrame:
    """Rows image_id, x, y of each cost image's seam (image_id, width, height, px)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples(index=False):
                path = seam_path(np.asarray(r.px, dtype=np.float64).reshape(r.height, r.width))
                yield pd.DataFrame({"image_id": r.image_id, "x": np.arange(r.width), "y": path})

    return costs.select("image_id", "width", "height", "px").mapInPandas(run, "image_id long, x long, y long")


def seam_cost(first: np.ndarray, second: np.ndarray, overlap: np.ndarray) -> np.ndarray:
    """Colour distance of two images plus half of both mixed second derivatives; 0 outside the overlap."""
    mixed = np.array([[1, 0, -1], [0, 0, 0], [-1, 0, 1]], dtype=np.float64)
    away = np.sqrt(((kernels.lab(first) - kernels.lab(second)) ** 2).sum(axis=2))
    slope = sum(np.abs(kernels.correlate(np.rint(kernels.luma(m)), mixed)) for m in (first, second))
    return np.where(overlap, away + 0.5 * slope, 0.0)


def seam_feather(first: np.ndarray, second: np.ndarray, mask: np.ndarray, width: int = 10) -> np.ndarray:
    """Both images mixed by the mask (1: the first), smoothed over 2 width + 1 cells."""
    size = 2 * width + 1
    soft = kernels.gaussian(mask.astype(np.float64), 0.3 * ((size - 1) * 0.5 - 1) + 0.8, size)[:, :, None]
    return kernels.as_bytes(np.floor(first * soft + second * (1 - soft)))


def joined_at_seam(pairs: DataFrame, width: int = 10) -> DataFrame:
    """Pairs of colour images on one frame (height, width, first, second, overlap as bytes), joined along the cheapest seam.

    Rows image_id, height, width, n_channels, data: above the seam the first image, below it the
    second, feathered. Where nothing overlaps the first image stays.
    """

    def run(r: dict) -> dict:
        h, w = r["height"], r["width"]
        first, second = (np.frombuffer(r[c], np.uint8).reshape(h, w, 3) for c in ("first", "second"))
        overlap = np.frombuffer(r["overlap"], np.uint8).reshape(h, w) > 0
        if not overlap.any():
            return kernels.colour_row(first, image_id=r["image_id"])
        path = seam_path(seam_cost(first, second, overlap))
        return kernels.colour_row(seam_feather(first, second, np.arange(h)[:, None] <= path[None], width), image_id=r["image_id"])

    return kernels.each_row(pairs.select("image_id", "height", "width", "first", "second", "overlap"), run, kernels.COLOUR)


def tiles_at_seams(cells: DataFrame, size: int = 1024, overlap: float = 0.25) -> DataFrame:
    """Rows tile_y, tile_x (corners) of overlapping tiles, the last partial ones too, that hold a seam cell (y, x, overlap)."""
    step = int(size * (1 - overlap))

    def corners(v: Column) -> Column:
        # tiles from the first that reaches the cell to the one that begins at or before it
        low = F.greatest(F.lit(0), F.ceil((v - size + 1) / step)).cast("long")
        return F.transform(F.sequence(low, F.greatest(low, F.floor(v / step).cast("long"))), lambda i: i * step)

    seam = cells.filter("overlap").select(corners(F.col("y")).alias("ys"), corners(F.col("x")).alias("xs"))
    return seam.select(F.explode("ys").alias("tile_y"), "xs").select("tile_y", F.explode("xs").alias("tile_x")).distinct()


def tile_weights(size: int, overlap: float = 0.25) -> np.ndarray:
    """Linear ramps towards all four sides, 1 in the middle."""
    ramp = max(1, int(size * overlap))
    one = np.minimum(1, np.minimum(np.arange(1, size + 1), np.arange(size, 0, -1)) / ramp)
    return one[:, None] * one[None]


def overlap_mask(layers: DataFrame) -> DataFrame:
    """Mean of each cell's layers and whether several meet there."""
    return layers.groupBy("y", "x").agg((F.sum("value") / F.count("*")).alias("value"), (F.count("*") > 1).alias("overlap"))


def problem_regions(images: DataFrame, mask_above: float = 200, least_area: int = 4, sharp: float = 500, uneven: float = 300, most: int = 10) -> DataFrame:
    """Connected bright regions (8 neighbours) whose Laplacian or level variance is high, the `most` severest of each image."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                m = np.asarray(r.px, dtype=np.float64).reshape(r.height, r.width)
                p = np.pad(m, 1, mode="reflect") if min(m.shape) > 1 else np.pad(m, 1, mode="edge")
                lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * m
                label = np.where(m > mask_above, np.arange(m.size).reshape(m.shape) + 1, 0)
                while True:
                    q = np.pad(label, 1)
                    best = np.max([q[i : i + m.shape[0], j : j + m.shape[1]] for i in range(3) for j in range(3)], axis=0)
                    new = np.where(label > 0, best, 0)
                    if (new == label).all():
                        break
                    label = new
                found = []
                for v in np.unique(label[label > 0]):
                    ys, xs = np.nonzero(label == v)
                    a, b = lap[ys, xs].var(), m[ys, xs].var()
                    if len(ys) >= least_area and (a > sharp or b > uneven):
                        found.append((r.image_id, int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1, float(a + b)))
                out += sorted(found, key=lambda f: (-f[-1], f[1], f[2]))[:most]
            yield pd.DataFrame(out, columns=["image_id", "x", "y", "w", "h", "severity"])

    return images.select("image_id", "width", "height", "px").mapInPandas(run, "image_id long, x int, y int, w int, h int, severity double")


def bundle_adjust(observations: DataFrame, rounds: int = 20, delta: float = 5.0, tolerance: float = 1e-9, loss: str = "huber", start: pd.DataFrame | None = None) -> pd.DataFrame:
    """Transforms (image, a, b, tx, ty) of one scene that bring observed points of image pairs together.

    A similarity is linear in its four numbers, so a robust fit is a weighted least-squares
    problem solved again and again (Huber or soft L1 weights); the first image stays where it is,
    or where `start` has it.
    Executors add up an 8 x 8 block for each pair of images; the driver gets the pairs' blocks and
    solves their sparse system by conjugate gradients. A scene's pairs are few, whatever the number
    of points.
    """
    spark = observations.sparkSession
    obs = observations.select("image_i", "image_j", "x1", "y1", "x2", "y2")
    ids = sorted({v for r in obs.select("image_i", "image_j").distinct().collect() for v in r})
    at = {v: n for n, v in enumerate(ids)}
    solution = np.tile([1.0, 0.0, 0.0, 0.0], (len(ids), 1))
    if start is not None:
        for r in start.itertuples(index=False):
            if r.image in at:
                solution[at[r.image]] = r.a, r.b, r.tx, r.ty
    if len(ids) < 2:
        return pd.DataFrame(np.column_stack([solution]), columns=["a", "b", "tx", "ty"]).assign(image=ids)[["image", "a", "b", "tx", "ty"]]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((solution, at))

        def sums(it: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            now, where = shared.value
            blocks: dict[tuple, np.ndarray] = {}
            for pdf in it:
                for pair, p in pdf.groupby(["image_i", "image_j"]):
                    zero, one = np.zeros(len(p)), np.ones(len(p))
                    x1, y1, x2, y2 = (p[c].to_numpy() for c in ("x1", "y1", "x2", "y2"))
                    first = np.stack([x1, -y1, one, zero, -x2, y2, -one, zero], axis=1)
                    second = np.stack([y1, x1, zero, one, -y2, -x2, zero, -one], axis=1)
                    both = np.concatenate([now[where[pair[0]]], now[where[pair[1]]]])
                    away = np.hypot(first @ both, second @ both)
                    # distances in the images' own scale, else a scene could fit by shrinking
                    scale = (both[:2] ** 2).sum() / 2 + (both[4:6] ** 2).sum() / 2
                    away = away / np.sqrt(scale)
                    w = (np.where(away <= delta, 1.0, delta / np.maximum(away, 1e-12)) if loss == "huber" else 1 / np.sqrt(1 + (away / delta) ** 2)) / scale
                    blocks[pair] = blocks.get(pair, 0) + (first * w[:, None]).T @ first + (second * w[:, None]).T @ second
            if blocks:
                yield pd.DataFrame([(i, j, m.ravel().tolist()) for (i, j), m in blocks.items()], columns=["image_i", "image_j", "m"])

        parts = obs.mapInPandas(sums, "image_i long, image_j long, m array<double>")
        total = parts.groupBy("image_i", "image_j").agg(F.array(*[F.sum(F.get("m", F.lit(n))) for n in range(64)]).alias("m")).collect()
        pairs = np.array([(at[r["image_i"]], at[r["image_j"]]) for r in total])
        blocks = np.array([r["m"] for r in total]).reshape(-1, 8, 8)
        new = _solved(pairs, blocks, len(ids), solution)
        moved = np.abs(new - solution).max()
        solution = new
        if moved < tolerance:
            break
    return pd.DataFrame({"image": ids, "a": solution[:, 0], "b": solution[:, 1], "tx": solution[:, 2], "ty": solution[:, 3]})


def _solved(pairs: np.ndarray, blocks: np.ndarray, n: int, start: np.ndarray) -> np.ndarray:
    """Minimum of the sum of the blocks' quadratic forms with the first image fixed: preconditioned conjugate gradients."""

    def product(v: np.ndarray) -> np.ndarray:
        both = np.concatenate([v[pairs[:, 0]], v[pairs[:, 1]]], axis=1)
        out, add = np.zeros_like(v), np.einsum("kij,kj->ki", blocks, both)
        np.add.at(out, pairs[:, 0], add[:, :4])
        np.add.at(out, pairs[:, 1], add[:, 4:])
        return out

    own = np.zeros((n, 4, 4))
    np.add.at(own, pairs[:, 0], blocks[:, :4, :4])
    np.add.at(own, pairs[:, 1], blocks[:, 4:, 4:])
    inverse = np.linalg.inv(own + 1e-9 * np.eye(4))
    v = start.copy()
    r = -product(v)
    r[0] = 0
    z = np.einsum("kij,kj->ki", inverse, r)
    p, rz = z.copy(), (r * z).sum()
    goal = 1e-24 * max(rz, 1e-300)
    for _ in range(40 * n):
        if rz <= goal:
            break
        q = product(p)
        q[0] = 0
        step = rz / max((p * q).sum(), 1e-300)
        v += step * p
        r -= step * q
        z = np.einsum("kij,kj->ki", inverse, r)
        rz, before = (r * z).sum(), rz
        p = z + rz / before * p
    return v


def two_stage(observations: DataFrame, start: pd.DataFrame | None = None) -> pd.DataFrame:
    """A coarse fit from the start on, points that it leaves far apart taken out, and a fine fit from there on.

    Points that the start leaves far apart take no part: a least-squares step could else shrink the scene to meet them.
    """
    if start is not None:
        near = refine(observations, observations.sparkSession.createDataFrame(start.rename(columns={"image": "image_id"})))
        observations = observations if near.isEmpty() else near
    coarse = bundle_adjust(observations, 50, 5.0, 1e-4, "huber", start)
    table = observations.sparkSession.createDataFrame(coarse.rename(columns={"image": "image_id"}))
    good = refine(observations, table)
    if good.isEmpty():
        return coarse
    fine = bundle_adjust(good, 200, 5.0, 1e-8, "soft", coarse)
    return pd.concat([fine, coarse[~coarse.image.isin(fine.image)]], ignore_index=True)


def refine(points: DataFrame, transforms: DataFrame, most: float = 5.0, least: int = 4) -> DataFrame:
    """Points whose images under both transforms are closer than `most`; pairs left with fewer than `least` go."""
    cols = ("a", "b", "tx", "ty")
    i = transforms.select(F.col("image_id").alias("image_i"), *[F.col(c).alias(c + "i") for c in cols])
    j = transforms.select(F.col("image_id").alias("image_j"), *[F.col(c).alias(c + "j") for c in cols])
    p = points.join(i, "image_i").join(j, "image_j")
    dx = F.expr("ai * x1 - bi * y1 + txi - (aj * x2 - bj * y2 + txj)")
    dy = F.expr("bi * x1 + ai * y1 + tyi - (bj * x2 + aj * y2 + tyj)")
    good = p.filter(F.sqrt(dx * dx + dy * dy) < most).select(*points.columns)
    enough = good.groupBy("image_i", "image_j").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select("image_i", "image_j")
    return good.join(enough, ["image_i", "image_j"], "left_semi")
