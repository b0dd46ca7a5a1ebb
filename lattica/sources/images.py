"""Image files as tables (S family): Spark's own readers, so any store they reach will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions import kernels

#: Fixed sets of file suffixes: plain scans take the first, interactive ones both cases of all.
PLAIN = ("jpg", "png", "tif", "tiff")
ALL = ("jpg", "jpeg", "png", "tif", "tiff", "bmp")


def pattern(suffixes=PLAIN, any_case: bool = False) -> str:
    wanted = [s for x in suffixes for s in ((x, x.upper()) if any_case else (x,))]
    return "*.{" + ",".join(wanted) + "}"


def listed(paths: DataFrame, column: str = "path") -> DataFrame:
    """Each path once, by lower-cased file name."""
    name = F.lower(F.element_at(F.split(column, "/"), -1))
    return paths.dropDuplicates([column]).orderBy(name, F.col(column))


def row_cap(rows: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows: a top-n, no full sort."""
    return rows.orderBy(order).limit(n)


def files(spark: SparkSession, folder: str, suffixes=PLAIN, any_case: bool = False) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern(suffixes, any_case)).load(folder)


def images(spark: SparkSession, folder: str, suffixes=PLAIN, any_case: bool = False) -> DataFrame:
    """Rows image_id, path, height, width, n_channels, data (BGR), alpha; unreadable files are left out.

    The id is a hash of the path, so it does not depend on what else is in the folder.
    """
    raw = spark.read.format("image").option("dropInvalid", "true").option("pathGlobFilter", pattern(suffixes, any_case)).load(folder).select("image.*")
    return raw.select(F.xxhash64("origin").alias("image_id"), F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("n_channels"), "data")


GRAY = T.StructType([T.StructField("image_id", T.LongType()), T.StructField("path", T.StringType()), *kernels.GRAY.fields[1:], T.StructField("alpha", T.ArrayType(T.IntegerType()))])


def gray(images_: DataFrame) -> DataFrame:
    """Gray values px of decoded images: weighted channels, or the single one; alpha where there is one."""

    def run(r: dict) -> dict:
        m = kernels.colour_of(r)
        return kernels.gray_row(kernels.luma(m), image_id=r["image_id"], path=r["path"], alpha=m[:, :, 3].ravel().tolist() if m.shape[2] == 4 else None)

    return kernels.each_row(images_.select("image_id", "path", "height", "width", "n_channels", "data"), run, GRAY)


def thumbnails(images_: DataFrame, most: int = 512) -> DataFrame:
    """Gray images scaled down (never up) by areas to at most `most` cells a side."""
    return kernels.gray_images(images_, lambda m: kernels.bounded(m, most))


def proxies(images_: DataFrame, most: int = 512) -> DataFrame:
    """Colour images scaled down (never up) by areas to at most `most` cells a side, without alpha, with their path."""
    schema = T.StructType([kernels.COLOUR.fields[0], T.StructField("path", T.StringType()), *kernels.COLOUR.fields[1:]])
    return kernels.each_row(images_.select("image_id", "path", "height", "width", "n_channels", "data"), lambda r: kernels.colour_row(kernels.bounded(kernels.three(kernels.colour_of(r)), most), image_id=r["image_id"], path=r["path"]), schema)


def cached_proxies(images_: DataFrame, cache: str, most: int = 512) -> DataFrame:
    """Proxies kept as a table at `cache`, by path: only images that aren't there yet are read and scaled."""
    spark = images_.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        known = spark.read.parquet(cache)
        new = images_.join(known.select("path"), "path", "left_anti")
    else:
        new = images_
    proxies(new, most).write.mode("append").parquet(cache)
    return spark.read.parquet(cache).join(images_.select("path"), "path", "left_semi")


def loaded(images_: DataFrame, most: int = 2000) -> DataFrame:
    """Gray images of bounded size for finding features."""
    return thumbnails(gray(images_), most)


def reloaded(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Images of the given files at full size, decoded again, without alpha."""
    raw = spark.read.format("image").option("dropInvalid", "true").load(paths).select("image.*")
    named = raw.select(F.xxhash64("origin").alias("image_id"), "height", "width", F.col("nChannels").alias("n_channels"), "data")
    return kernels.each_row(named, lambda r: kernels.colour_row(kernels.three(kernels.colour_of(r)), image_id=r["image_id"]), kernels.COLOUR)


def or_half(quality: Column) -> Column:
    """Missing and zero scores count as one half."""
    return F.when(quality.isNull() | (quality == 0), 0.5).otherwise(quality)


def memory_estimate(images_: DataFrame, features: int = 5000) -> DataFrame:
    """Bytes of all images decoded, of cached and of bare thumbnails, and of descriptors."""
    full = F.col("height") * F.col("width") * F.col("n_channels")
    thumb = F.least(full.cast("double"), F.lit(512.0 * 512 * 3))
    return images_.agg(F.count("*").alias("n"), F.sum(full.cast("long")).alias("decoded"), F.sum(thumb + full / 15).alias("cached"), F.sum(thumb).alias("thumbnails"), (F.count("*") * features * 128).alias("features"))
