"""Descriptor matching (M1 to M14): packed descriptors meet by image pair, distances are matrix products.

A pair's descriptors are bounded by the feature cap of an image, so a task holds two such
matrices at a time; a row is a query and its nearest neighbours, never all combinations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.plans.tables import written

MIN_MATCHES, RATIO, COLOUR_DIMS, COLOUR_LEAST = 10, 0.75, 48, 0.3


def packed(descriptors: DataFrame) -> DataFrame:
    """One row per image: its keypoint ids and descriptors."""
    rows = F.sort_array(F.collect_list(F.struct("kp_id", F.transform("descriptor", lambda v: v.cast("double")).alias("d"))))
    return descriptors.filter("descriptor is not null").groupBy("image_id").agg(rows.alias("f")).select("image_id", F.transform("f", lambda x: x["kp_id"]).alias("kp"), F.transform("f", lambda x: x["d"]).alias("d"))


def closest(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of x and y and distances (9 digits) of all that may be among the k closest, ties included.

    A matrix product gives squared distances but for rounding; what comes within that of the k-th is
    measured again exactly, so the result is the same whatever the sizes are.
    """
    squares = (x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T
    slack = 1e-9 * (1 + (x**2).sum(1).max() + (y**2).sum(1).max())
    row, col = np.nonzero(squares <= np.partition(squares, k - 1, axis=1)[:, k - 1 : k] + 2 * slack)
    return row, col, np.round(np.sqrt(((x[row] - y[col]) ** 2).sum(1)), 9)


def nearest(descriptors: DataFrame, pairs: DataFrame, k: int = 2) -> DataFrame:
    """Rows image_i, image_j, kp_i, kp_j, distance, rank: the k nearest of each of i's keypoints in j (exact, ties by id)."""
    p = packed(descriptors)
    a = p.select(F.col("image_id").alias("image_i"), F.col("kp").alias("ka"), F.col("d").alias("da"))
    b = p.select(F.col("image_id").alias("image_j"), F.col("kp").alias("kb"), F.col("d").alias("db"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                x, y = np.stack(r.da), np.stack(r.db)
                if x.ndim != 2 or x.shape[1] != y.shape[1]:
                    continue
                kb, top = np.asarray(r.kb), min(k, len(y))
                for at in range(0, len(x), 1024):
                    row, col, d = closest(x[at : at + 1024], y, top)
                    order = np.lexsort((kb[col], d, row))
                    row, col, d = row[order], col[order], d[order]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    row, col, d, place = (v[place < top] for v in (row, col, d, place))
                    yield pd.DataFrame({"image_i": r.image_i, "image_j": r.image_j, "kp_i": np.asarray(r.ka)[at + row], "kp_j": kb[col], "distance": d, "rank": place + 1})

    joined = pairs.select("image_i", "image_j").join(a, "image_i").join(b, "image_j").select("image_i", "image_j", "ka", "da", "kb", "db")
    return joined.mapInPandas(run, "image_i long, image_j long, kp_i long, kp_j long, distance double, rank int")


def nearest_overall(descriptors: DataFrame, k: int = 2, block: int = 2000) -> DataFrame:
    """Rows kp_i, kp_j, distance, rank: the k nearest of each descriptor (kp_id, descriptor) among all others, exact.

    Descriptors are dealt to blocks by a hash; pairs of blocks are compared, and their best merged.
    """
    n = descriptors.count()
    blocks = max(1, -(-n // block))
    dealt = descriptors.select(F.pmod(F.xxhash64("kp_id"), F.lit(blocks)).alias("image_id"), "kp_id", "descriptor")
    ids = descriptors.sparkSession.range(blocks)
    pairs = ids.select(F.col("id").alias("image_i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("image_j"))
    near = nearest(dealt, pairs, k + 1).filter("kp_i <> kp_j")
    best = near.groupBy("kp_i").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "kp_j"))), 1, k).alias("b"))  # k + 1 of each block
    return best.select("kp_i", F.posexplode("b").alias("p", "x")).select("kp_i", "x.kp_j", "x.distance", (F.col("p") + 1).alias("rank"))


def hashed_pairs(left: DataFrame, right: DataFrame, within: float, width: float, tables: int = 4, seed: int = 7, block: int = 16384) -> DataFrame:
    """Rows kp_i, kp_j, distance: descriptors (kp_id, descriptor) closer than `within` that share a bucket of random projections.

    Rows meet by table and bucket, in blocks, so nothing is written for a pair that is too far apart. A pair is found in
    the first table where its buckets are the same and left out of the others, so no pairs are shuffled to be told apart.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    left, right = (v.filter("descriptor is not null").select("kp_id", "descriptor", array_to_vector(F.transform("descriptor", lambda x: x.cast("double"))).alias("v")) for v in (left, right))
    schema = "kp_i long, kp_j long, distance double"
    if left.isEmpty() or right.isEmpty():
        return left.sparkSession.createDataFrame([], schema)
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=width, numHashTables=tables, seed=seed).fit(left)
    buckets = F.array(*[vector_to_array(F.col("h")[k])[0].cast("long") for k in range(tables)])
    a, b = (model.transform(v).select("kp_id", "descriptor", buckets.alias("h")).select("*", F.posexplode("h").alias("t", "bucket")) for v in (left, right))
    blocks = [v.groupBy("t", "bucket").agg(F.ceil(F.count("*") / block).alias(n)) for v, n in ((a, "_p"), (b, "_q"))]
    blocks = written(blocks[0].join(blocks[1], ["t", "bucket"]), "buckets")
    place = lambda n: F.pmod(F.xxhash64("kp_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = a.join(blocks, ["t", "bucket"]).select("kp_id", "descriptor", "h", "t", "bucket", place("_p").alias("p"), every("_q").alias("q"))
    b = b.join(blocks, ["t", "bucket"]).select("kp_id", "descriptor", "h", "t", "bucket", every("_p").alias("p"), place("_q").alias("q"))
    b = b.select(*[F.col(c).alias(c) for c in b.columns])  # columns of its own, where both sides come from one table

    def rows_of(table: pa.Table, name: str, kind: type) -> np.ndarray:
        return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(table.num_rows, -1)

    def run(key: tuple, one: pa.Table, other: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if one.num_rows and other.num_rows:
            (x, y), (hx, hy) = ([rows_of(v, "descriptor", np.float64) for v in (one, other)], [rows_of(v, "h", np.int64)[:, : key[0].as_py()] for v in (one, other)])
            ids, jds = (v.column("kp_id").to_numpy() for v in (one, other))
            squares = (y**2).sum(1)
            slack = 1e-9 * (1 + (x**2).sum(1).max() + squares.max())
            for at in range(0, len(x), 512):
                z = x[at : at + 512]
                row, col = np.nonzero((z**2).sum(1)[:, None] + squares[None] - 2 * z @ y.T < within * within + slack)
                new = ~(hx[at + row] == hy[col]).any(1)
                row, col = row[new], col[new]
                d = np.sqrt(((z[row] - y[col]) ** 2).sum(1))
                near = d < within
                for column, values in zip(found, (ids[at + row[near]], jds[col[near]], d[near]), strict=True):
                    column.append(values)
        return pa.table({n: np.concatenate(v) for n, v in zip(("kp_i", "kp_j", "distance"), found, strict=True)})

    keys = ["t", "bucket", "p", "q"]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(run, schema)


def ratio_test(near: DataFrame, ratio: float = RATIO) -> DataFrame:
    """First neighbours closer than `ratio` times the second; both must exist."""
    two = near.groupBy("image_i", "image_j", "kp_i").agg(F.min_by("kp_j", "rank").alias("kp_j"), F.min(F.when(F.col("rank") == 1, F.col("distance"))).alias("distance"), F.min(F.when(F.col("rank") == 2, F.col("distance"))).alias("second"))
    return two.filter(F.col("second").isNotNull() & (F.col("distance") < ratio * F.col("second"))).select("image_i", "image_j", "kp_i", "kp_j", "distance")


def cross_check(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Mutual nearest neighbours: firsts of i in j that are firsts of j in i."""
    b = backward.filter("rank = 1").select(F.col("image_j").alias("image_i"), F.col("image_i").alias("image_j"), F.col("kp_j").alias("kp_i"), F.col("kp_i").alias("kp_j"))
    return forward.filter("rank = 1").join(b, ["image_i", "image_j", "kp_i", "kp_j"]).select("image_i", "image_j", "kp_i", "kp_j", "distance")


def cosine(a: Column, b: Column) -> Column:
    """Clamped at 0; vectors next to zero agree."""
    from lattica.functions.tiles import dot

    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na < 1e-6) | (nb < 1e-6), 1.0).otherwise(F.greatest(F.lit(0.0), dot(a, b) / (na * nb)))


def colour_verified(matches: DataFrame, descriptors: DataFrame, dims: int = COLOUR_DIMS, least: float = COLOUR_LEAST) -> DataFrame:
    """Matches whose last `dims` descriptor values agree."""
    tail = F.slice(F.col("descriptor"), -dims, dims)
    a = descriptors.select(F.col("image_id").alias("image_i"), F.col("kp_id").alias("kp_i"), tail.alias("ca"))
    b = descriptors.select(F.col("image_id").alias("image_j"), F.col("kp_id").alias("kp_j"), tail.alias("cb"))
    return matches.join(a, ["image_i", "kp_i"]).join(b, ["image_j", "kp_j"]).withColumn("colour", cosine(F.col("ca"), F.col("cb"))).filter(F.col("colour") >= least).drop("ca", "cb")


def confidence(matches: DataFrame, descriptors: DataFrame, least: int = MIN_MATCHES) -> DataFrame:
    """Per pair the number of matches over the larger number of keypoints; 0 below `least`."""
    n = descriptors.groupBy("image_id").agg(F.count("*").alias("n"))
    c = matches.groupBy("image_i", "image_j").agg(F.count("*").alias("num_matches"))
    return (
        c.join(n.select(F.col("image_id").alias("image_i"), F.col("n").alias("ni")), "image_i")
        .join(n.select(F.col("image_id").alias("image_j"), F.col("n").alias("nj")), "image_j")
        .select("image_i", "image_j", "num_matches", F.when(F.col("num_matches") < least, 0.0).otherwise(F.col("num_matches") / F.greatest("ni", "nj")).alias("confidence"))
    )


def similarity_fit(points: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares similarity (a, b, tx, ty) from columns x1, y1 to x2, y2 of each group: sums only, so it combines before the shuffle."""
    s = points.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in ("x1", "y1", "x2", "y2")],
        F.sum(F.col("x1") * F.col("x1") + F.col("y1") * F.col("y1")).alias("q"),
        F.sum(F.col("x1") * F.col("x2") + F.col("y1") * F.col("y2")).alias("p"),
        F.sum(F.col("x1") * F.col("y2") - F.col("y1") * F.col("x2")).alias("r"),
    )
    n = F.col("n")
    q = F.col("q") - (F.col("s_x1") ** 2 + F.col("s_y1") ** 2) / n
    a = (F.col("p") - (F.col("s_x1") * F.col("s_x2") + F.col("s_y1") * F.col("s_y2")) / n) / q
    b = (F.col("r") - (F.col("s_x1") * F.col("s_y2") - F.col("s_y1") * F.col("s_x2")) / n) / q
    s = s.filter(q > 1e-9).withColumn("a", a).withColumn("b", b)
    return s.select(*keys, "n", "a", "b", ((F.col("s_x2") - F.col("a") * F.col("s_x1") + F.col("b") * F.col("s_y1")) / n).alias("tx"), ((F.col("s_y2") - F.col("b") * F.col("s_x1") - F.col("a") * F.col("s_y1")) / n).alias("ty"))


def translation_fit(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(F.median(F.col("x2") - F.col("x1")).alias("tx"), F.median(F.col("y2") - F.col("y1")).alias("ty"))


def ransac(points: DataFrame, threshold: float = 3.0, tries: int = 200, least: int = 6, share: float = 0.25) -> DataFrame:
    """Verified pairs: image_i, image_j, a, b, tx, ty, num_matches, num_inliers, inlier_ratio, inliers (kp_i, kp_j).

    Two correspondences make a hypothesis; which two follows from the pair and the try's number
    alone. The best is refitted by least squares. Needs 4 matches, `least` inliers and `share`.
    """
    grouped = points.groupBy("image_i", "image_j").agg(F.sort_array(F.collect_list(F.struct("kp_i", "kp_j", "x1", "y1", "x2", "y2"))).alias("m"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                m = np.array([[p["x1"], p["y1"], p["x2"], p["y2"]] for p in r.m], dtype=np.float64)
                if len(m) < 4 or not np.isfinite(m).all():  # a pair that can't be fitted costs no other
                    continue
                z, w = m[:, 0] + 1j * m[:, 1], m[:, 2] + 1j * m[:, 3]
                pick = np.random.default_rng([int(r.image_i) & 0x7FFFFFFF, int(r.image_j) & 0x7FFFFFFF]).integers(0, len(m), (tries, 2))
                pick = pick[np.abs(z[pick[:, 0]] - z[pick[:, 1]]) > 1e-9]
                if not len(pick):
                    continue
                s = (w[pick[:, 0]] - w[pick[:, 1]]) / (z[pick[:, 0]] - z[pick[:, 1]])
                t = w[pick[:, 0]] - s * z[pick[:, 0]]
                inside = np.abs(s[:, None] * z[None] + t[:, None] - w[None]) < threshold
                best = inside[inside.sum(1).argmax()]
                if best.sum() < least or best.mean() < share:
                    continue
                zc, wc = z[best] - z[best].mean(), w[best] - w[best].mean()
                s1 = (zc.conj() * wc).sum() / (np.abs(zc) ** 2).sum()
                t1 = w[best].mean() - s1 * z[best].mean()
                out.append((r.image_i, r.image_j, s1.real, s1.imag, t1.real, t1.imag, len(m), int(best.sum()), float(best.mean()), [{"kp_i": p["kp_i"], "kp_j": p["kp_j"]} for p, ok in zip(r.m, best, strict=True) if ok]))
            if out:
                yield pd.DataFrame(out, columns=["image_i", "image_j", "a", "b", "tx", "ty", "num_matches", "num_inliers", "inlier_ratio", "inliers"])

    return grouped.mapInPandas(run, "image_i long, image_j long, a double, b double, tx double, ty double, num_matches long, num_inliers long, inlier_ratio double, inliers array<struct<kp_i:bigint,kp_j:bigint>>")


def accepted(verified: DataFrame, confidences: DataFrame, least: int = MIN_MATCHES) -> DataFrame:
    """Edges: pairs with enough raw matches, confidence scaled by the inlier ratio (0.1 at least)."""
    c = confidences.select("image_i", "image_j", "confidence")
    return verified.filter(F.col("num_matches") >= least).join(c, ["image_i", "image_j"]).withColumn("confidence", F.col("confidence") * F.greatest("inlier_ratio", F.lit(0.1)))


def early_stop(edges: DataFrame, n: int, order: str = "pair_index") -> DataFrame:
    """Edges up to where 1.5 (n - 1) of them exist (the intended early end, in pair order)."""
    return edges.withColumn("_r", F.row_number().over(Window.orderBy(order))).filter(F.col("_r") <= int(np.ceil(1.5 * (n - 1)))).drop("_r")


#: Matchers by name: ratio (None: mutual nearest neighbours).
MATCHERS = {"flann": 0.75, "bf": 0.75, "loftr": 0.75, "superglue": 0.75, "disk": None}


def match(descriptors: DataFrame, pairs: DataFrame, method: str = "flann", ratio: float | None = None) -> DataFrame:
    """Matches by a matcher's name; an unknown name is the default."""
    wanted = MATCHERS.get(method, RATIO)
    if wanted is None:
        swapped = pairs.select(F.col("image_j").alias("image_i"), F.col("image_i").alias("image_j"))
        return cross_check(nearest(descriptors, pairs, 1), nearest(descriptors, swapped, 1))
    return ratio_test(nearest(descriptors, pairs, 2), wanted if ratio is None else ratio)
