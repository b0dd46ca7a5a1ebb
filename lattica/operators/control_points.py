"""Control points (H family): a plain table of corresponding places in two images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import matching

SCHEMA = "image1_idx long, image2_idx long, x1 double, y1 double, x2 double, y2 double, confidence double, manual boolean"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def read(spark: SparkSession, path: str) -> DataFrame:
    """JSON rows; confidence is 1 and manual false where missing."""
    return spark.read.schema(SCHEMA).json(path).fillna({"confidence": 1.0, "manual": False})


def write(points: DataFrame, path: str) -> None:
    points.write.mode("overwrite").json(path)


def add(points: DataFrame, more: DataFrame) -> DataFrame:
    return points.unionByName(more)


def remove(points: DataFrame, gone: DataFrame) -> DataFrame:
    return points.join(gone.select("image1_idx", "image2_idx", "x1", "y1", "x2", "y2").distinct(), ["image1_idx", "image2_idx", "x1", "y1", "x2", "y2"], "left_anti")


def of_pair(points: DataFrame, i: int, j: int) -> DataFrame:
    a, b = F.col("image1_idx"), F.col("image2_idx")
    return points.filter(((a == i) & (b == j)) | ((a == j) & (b == i)))


def oriented(points: DataFrame) -> DataFrame:
    """Every point from the smaller to the larger image."""
    turn = F.col("image1_idx") > F.col("image2_idx")
    pick = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a))
    return points.select(pick("image1_idx", "image2_idx").alias("image_i"), pick("image2_idx", "image1_idx").alias("image_j"), *[pick(a, b).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))])


def transforms(points: DataFrame, allow_scale: bool = True) -> DataFrame:
    """Per pair a similarity from three points on (scale within 0.5 to 2), else the median translation."""
    p = oriented(points)
    keys = ["image_i", "image_j"]
    shift = matching.translation_fit(p, keys)
    if not allow_scale:
        return shift.select(*keys, F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), "tx", "ty")
    fit = matching.similarity_fit(p, keys).filter((F.col("n") >= 3) & F.sqrt(F.col("a") ** 2 + F.col("b") ** 2).between(0.5, 2.0))
    return shift.withColumnsRenamed({"tx": "sx", "ty": "sy"}).join(fit, keys, "left").select(*keys, F.coalesce("a", F.lit(1.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"), F.coalesce("tx", "sx").alias("tx"), F.coalesce("ty", "sy").alias("ty"))


def within_bounds(points: DataFrame, images: DataFrame) -> DataFrame:
    """Points inside both images (image_id, width, height)."""
    one = images.select(F.col("image_id").alias("image1_idx"), F.col("width").alias("w1"), F.col("height").alias("h1"))
    two = images.select(F.col("image_id").alias("image2_idx"), F.col("width").alias("w2"), F.col("height").alias("h2"))
    ok = "x1 >= 0 and x1 < w1 and y1 >= 0 and y1 < h1 and x2 >= 0 and x2 < w2 and y2 >= 0 and y2 < h2"
    return points.join(one, "image1_idx").join(two, "image2_idx").filter(ok).drop("w1", "h1", "w2", "h2")


def detected(descriptors: DataFrame, keypoints: DataFrame, pairs: DataFrame, most: int = 50) -> DataFrame:
    """Matches at ratio 0.7, the closest `most` of each pair, as points; confidence falls with distance."""
    from lattica.operators.features import top_by_response

    m = matching.match(descriptors, pairs, "flann", 0.7).withColumn("pair", F.struct("image_i", "image_j")).withColumn("near", -F.col("distance"))
    m = top_by_response(m, most, "pair", "near", "kp_i")
    a = keypoints.select(F.col("image_id").alias("image_i"), F.col("kp_id").alias("kp_i"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = keypoints.select(F.col("image_id").alias("image_j"), F.col("kp_id").alias("kp_j"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    j = m.join(a, ["image_i", "kp_i"]).join(b, ["image_j", "kp_j"])
    return j.select(F.col("image_i").alias("image1_idx"), F.col("image_j").alias("image2_idx"), "x1", "y1", "x2", "y2", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("distance") / 300)).alias("confidence"), F.lit(False).alias("manual"))
