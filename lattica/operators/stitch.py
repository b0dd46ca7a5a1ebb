"""From images to a panorama or a layout: the operators chained (D9, A15 to A17, B5, B6, O13)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import control_points, duplicates, features, graph, layout, matching, pairs, quality, raster, seams
from lattica.plans.tables import written


@dataclass(frozen=True)
class Options:
    """How a scene is stitched. Named bundles are in PRESETS."""

    detector: str = "sift"
    most_features: int = 5000
    matcher: str = "flann"
    ratio: float = 0.75
    least_quality: float = 0.3
    drop_duplicates: bool = False
    similarity: float = 0.95
    window: int = 30
    adjust: bool = False
    blend: str = "feather"
    feather: float = 100.0


#: Bundles for scenes of a few, many, and very many images.
PRESETS = {
    "few": Options(most_features=8000),
    "medium": Options(most_features=5000, drop_duplicates=True),
    "large": Options(most_features=3000, drop_duplicates=True, blend="linear"),
    "gigapixel": Options(most_features=2000, drop_duplicates=True, blend="first"),
}


def without_duplicates(images: DataFrame, similarity: float = 0.95, window: int = 30) -> DataFrame:
    """Of images (with rk, their place in the order) that look alike within the window the first; up to two images stay as they are.

    Images of different sizes are never alike.
    """
    if len(images.limit(3).collect()) <= 2:
        return images
    p = duplicates.window_pairs(images.select("image_id", "rk", "width", "height", "px"), window).filter("width_i = width_j and height_i = height_j")
    alike = written(p.filter(duplicates.ncc_similarity(F.col("px_i"), F.col("px_j")) >= similarity).select("rk_i", "rk_j"), "alike")
    return duplicates.greedy_survivors(images, alike)


def linked(images: DataFrame, how: Options) -> DataFrame:
    """Verified pairs of images (image_id, rk, width, height, px): transforms, matches, inliers, confidence."""
    n = images.count()
    cap = features.adaptive_cap(n, how.most_features)
    found = written(features.detector(how.detector, cap)(images), "keypoints")
    places = images.select("image_id", F.col("rk").alias("i"))
    wanted = pairs.candidates(places.select("i"), n)
    named = wanted.join(places.select(F.col("i").alias("image_i"), F.col("image_id").alias("_i")), "image_i").join(places.select(F.col("i").alias("image_j"), F.col("image_id").alias("_j")), "image_j")
    named = written(named.select(F.col("_i").alias("image_i"), F.col("_j").alias("image_j")), "pairs")
    matches = written(matching.match(found, named, how.matcher, how.ratio if how.matcher != "disk" else None), "matches")
    spot = found.select("image_id", "kp_id", "x", "y")
    points = matches.join(spot.select(F.col("image_id").alias("image_i"), F.col("kp_id").alias("kp_i"), F.col("x").alias("x1"), F.col("y").alias("y1")), ["image_i", "kp_i"])
    points = points.join(spot.select(F.col("image_id").alias("image_j"), F.col("kp_id").alias("kp_j"), F.col("x").alias("x2"), F.col("y").alias("y2")), ["image_j", "kp_j"])
    points = written(points.select("image_i", "image_j", "kp_i", "kp_j", "x1", "y1", "x2", "y2"), "points")
    verified = written(matching.ransac(points), "verified")
    sure = matching.confidence(matches, found)
    return written(matching.accepted(verified, sure), "edges")


def aligned(images: DataFrame, edges: DataFrame) -> DataFrame:
    """Absolute transforms (image_id, a, b, tx, ty) of the largest connected part of the scene; a single image stays where it is."""
    if edges.isEmpty():
        first = images.orderBy("rk").limit(1)
        return first.select("image_id", F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty"))
    part = written(graph.largest_component(edges).select("image_id"), "part")
    inside = edges.join(part.withColumnRenamed("image_id", "image_i"), "image_i", "left_semi").select("image_i", "image_j", "a", "b", "tx", "ty", "num_matches", "num_inliers", "confidence")
    inside = written(inside, "inside")
    tree = written(graph.bfs(inside, graph.reference(inside)), "tree")
    return graph.propagate(inside, tree)


def align_with_points(points: DataFrame) -> DataFrame:
    """Absolute transforms from control points alone; images that no chain of points reaches are left out."""
    t = written(control_points.transforms(points), "point-transforms")
    if t.isEmpty():
        return t.select(F.col("image_i").alias("image_id"), "a", "b", "tx", "ty")
    tree = written(graph.bfs(t, graph.reference(t)), "tree")
    return graph.propagate(t, tree)


def prepared(images: DataFrame, how: Options) -> DataFrame:
    """Images good enough, without near-copies, numbered in their order (rk)."""
    scored = written(quality.assess(images), "scored")
    good = quality.numbered(quality.keep_good(scored, how.least_quality), "image_id", "rk")
    good = written(good, "good")
    if not how.drop_duplicates:
        return good
    kept = without_duplicates(good, how.similarity, how.window).drop("rk")
    return written(quality.numbered(kept, "image_id", "rk"), "kept")


def placed(images: DataFrame, how: Options = Options()) -> DataFrame:
    """Images of the scene with their transforms and boxes on the canvas, shifted so that the canvas begins at 0, 0."""
    ready = prepared(images, how)
    edges = linked(ready, how)
    where = aligned(ready, edges)
    boxes = written(layout.placed(ready.join(where, "image_id")), "boxes")
    low = boxes.agg(F.min("x0").alias("_x"), F.min("y0").alias("_y"))
    shifted = boxes.crossJoin(F.broadcast(low))  # one row
    columns = {c: F.col(c) - F.col("_x") for c in ("x0", "x1", "tx")} | {c: F.col(c) - F.col("_y") for c in ("y0", "y1", "ty")}
    return shifted.withColumns(columns).drop("_x", "_y")


def stitched(images: DataFrame, how: Options = Options(), enhance: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Canvas cells y, x, value of the panorama of gray images (image_id, width, height, px).

    An empty table gives no cells, a single image itself. Images that are not connected with the
    largest part of the scene are left out.
    """
    scene = placed(enhance(images) if enhance else images, how)
    cells = layout.warped(scene.drop("warped", "x0", "y0", "x1", "y1"))
    lay = cells.join(scene.select("image_id", "rk", "x0", "y0", "x1", "y1"), "image_id")
    lx, ly = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    lay = lay.withColumn("weight", raster.edge_weight(lx, ly, F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), how.feather) + 1e-3)
    if how.blend == "first":
        return raster.first_wins(lay, [F.asc("rk")])
    return lay.groupBy("y", "x").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value"))


def grid_aligned(images: DataFrame, how: Options = Options(), low: float = 0.1, high: float = 1.0, factor: float = 1.3) -> DataFrame:
    """Layout image_id, x, y, center_x, center_y of a scene, images spread apart and not merged; pairs outside the band of overlaps don't count."""
    ready = prepared(images, how)
    edges = linked(ready, how)
    areas = ready.select("image_id", (F.col("width") * F.col("height")).alias("area"))
    band = written(graph.overlap_band(graph.overlap_estimate(edges, areas), low, high), "band")
    kept = graph.kept_images(ready, band)
    where = aligned(kept, band)
    c = kept.join(where, "image_id").select("image_id", "width", "height", (F.expr("a * width / 2 - b * height / 2") + F.col("tx")).alias("center_x"), (F.expr("b * width / 2 + a * height / 2") + F.col("ty")).alias("center_y"))
    return layout.exploded_view(c, factor)


def adjusted(observations: DataFrame) -> DataFrame:
    """Transforms image_id, a, b, tx, ty after the two-stage adjustment of observed points (image_i, image_j, x1, y1, x2, y2).

    It starts from the pairs' own robust fits, put together from the smallest image on.
    """
    spark = observations.sparkSession
    named = observations.withColumn("kp_i", F.xxhash64("x1", "y1")).withColumn("kp_j", F.xxhash64("x2", "y2"))
    fits = written(matching.ransac(named.select("image_i", "image_j", "kp_i", "kp_j", "x1", "y1", "x2", "y2")), "fits")
    start = None
    if not fits.isEmpty():
        first = fits.select(F.least("image_i", "image_j").alias("image_id")).orderBy("image_id").limit(1)
        tree = written(graph.bfs(fits, first), "tree")
        start = graph.propagate(fits.select("image_i", "image_j", "a", "b", "tx", "ty"), tree).withColumnRenamed("image_id", "image").toPandas()
    return spark.createDataFrame(seams.two_stage(observations, start).rename(columns={"image": "image_id"}))
