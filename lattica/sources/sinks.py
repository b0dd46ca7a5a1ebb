"""Writing canvases (K family): as tiles of a table, or encoded by the JVM's ImageIO where one image fits a driver."""

from __future__ import annotations

import base64
import logging
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed presets by name: TIFF compression, PNG level, JPEG quality.
PRESETS = {
    "ultra_high": ("none", 0, 100),
    "high": ("lzw", 3, 95),
    "medium": ("lzw", 6, 85),
    "low": ("lzw", 8, 70),
    "minimum": ("lzw", 9, 50),
}
FORMATS = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg", "tif": "tiff", "tiff": "tiff", "bmp": "bmp"}
#: Cells of the largest canvas that the driver encodes; larger ones are written as tiles.
LARGEST = 100_000_000


def preset(name: str) -> tuple[str, int, int]:
    return PRESETS.get(name, PRESETS["high"])


def write_tiles(cells: DataFrame, path: str, size: int = 256) -> None:
    """Cells x, y, value as a table of tiles, each a sorted array; any canvas size."""
    tiles = cells.groupBy(F.floor(F.col("y") / size).alias("tile_y"), F.floor(F.col("x") / size).alias("tile_x")).agg(F.sort_array(F.collect_list(F.struct("y", "x", "value"))).alias("cells"))
    tiles.write.mode("overwrite").parquet(path)


def rows_of(cells: DataFrame) -> tuple[int, int, int, DataFrame]:
    """Width, height, channels and the byte rows (y, data) of cells x, y, value, or x, y, b, g, r; cells without a value are 0.

    Rows are made by executors; values up to 1 in all are taken as shares of 255.
    """
    names = ["b", "g", "r"] if "b" in cells.columns else ["value"]
    box = cells.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.max(F.greatest(*[F.col(c) for c in names], F.lit(0)))).first()
    if box[0] is None:
        raise ValueError("an empty canvas")
    x0, y0, w, h, n = box[0], box[1], int(box[2] - box[0] + 1), int(box[3] - box[1] + 1), len(names)
    if w * h > LARGEST:
        raise ValueError("the canvas is too large for one image; use write_tiles()")
    share = 255.0 if box[4] <= 1.0 and dict(cells.dtypes)[names[0]] in ("double", "float") else 1.0

    def row(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        line = np.zeros((w, n), dtype=np.uint8)
        line[part["x"].to_numpy() - x0] = np.clip(np.floor(part[names].to_numpy(dtype=np.float64) * share + 1e-9), 0, 255)
        return pd.DataFrame({"y": [key[0] - y0], "data": [line.tobytes()]})

    return w, h, n, cells.select(F.col("y").cast("long"), F.col("x").cast("long"), *names).groupBy("y").applyInPandas(row, "y long, data binary")


def _lines(w: int, h: int, n: int, rows: DataFrame) -> Iterator[bytes]:
    """All rows from the top, empty ones too."""
    at = 0
    for r in rows.orderBy("y").toLocalIterator():
        while at < r["y"]:
            yield bytes(w * n)
            at += 1
        yield bytes(r["data"])
        at += 1
    for _ in range(at, h):
        yield bytes(w * n)


def png(w: int, h: int, n: int, lines: Iterable[bytes], level: int, dpi: int) -> bytes:
    """A PNG file of gray or blue-green-red rows."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    squeeze = zlib.compressobj(level)
    body = b"".join(squeeze.compress(b"\0" + (np.frombuffer(line, np.uint8).reshape(w, 3)[:, ::-1].tobytes() if n == 3 else line)) for line in lines) + squeeze.flush()
    metre = round(dpi / 0.0254)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if n == 3 else 0, 0, 0, 0)) + chunk(b"pHYs", struct.pack(">IIB", metre, metre, 1)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def _by_java(spark: SparkSession, w: int, h: int, n: int, lines: Iterable[bytes], kind: str, quality: str, dpi: int) -> bytes:
    """A file by the JVM's ImageIO: rows are handed over one at a time."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(w, h, 5 if n == 3 else 10)  # TYPE_3BYTE_BGR, TYPE_BYTE_GRAY
    raster = image.getRaster()
    for y, line in enumerate(lines):
        # a raster takes red first
        data = np.frombuffer(line, np.uint8).reshape(w, 3)[:, ::-1].tobytes() if n == 3 else line
        raster.setDataElements(0, y, w, 1, data)
    out = jvm.java.io.ByteArrayOutputStream()
    writers = jvm.javax.imageio.ImageIO.getImageWritersByFormatName(kind)
    if not writers.hasNext():
        raise ValueError(f"no writer for {kind}")
    writer = writers.next()
    param = writer.getDefaultWriteParam()
    packing, _, strength = preset(quality)
    if kind == "jpeg":
        param.setCompressionMode(2)
        param.setCompressionQuality(strength / 100)
    elif kind == "tiff" and packing != "none":
        param.setCompressionMode(2)
        param.setCompressionType("LZW")
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    stream.close()
    writer.dispose()
    found = bytes(out.toByteArray())
    if kind == "jpeg" and found[6:10] == b"JFIF":
        found = found[:13] + struct.pack(">BHH", 1, dpi, dpi) + found[18:]
    return found


def encode(cells: DataFrame, kind: str = "png", quality: str = "high", dpi: int = 300) -> bytes:
    """One image of cells x, y and value, or b, g, r (0..255), as the bytes of a file; refuses canvases over LARGEST cells.

    The preset gives PNG's level, JPEG's quality, and TIFF's compression; PNG and JPEG files carry the resolution.
    """
    if kind not in FORMATS:
        raise ValueError(f"no writer for .{kind}")
    w, h, n, rows = rows_of(cells)
    lines = _lines(w, h, n, rows)
    if kind == "png":
        return png(w, h, n, lines, preset(quality)[1], dpi)
    return _by_java(cells.sparkSession, w, h, n, lines, FORMATS[kind], quality, dpi)


def save(cells: DataFrame, path: str, quality: str = "high", dpi: int = 300) -> int:
    """Encode by the path's suffix and write through Hadoop's file systems; returns the bytes written (a warning below 1 KB)."""
    data = encode(cells, path.rpartition(".")[2].lower(), quality, dpi)
    if len(data) < 1024:
        logging.getLogger("lattica").warning("%s has %d bytes only", path, len(data))
    spark = cells.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(data))
    stream.close()
    return len(data)


def to_base64(data: bytes) -> str:
    return base64.b64encode(data).decode()


def from_base64(text: str) -> bytes:
    return base64.b64decode(text)
