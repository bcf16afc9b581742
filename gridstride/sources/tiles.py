"""Map and elevation tiles as pixel rows, and checks of uploaded images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def image_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(path, y, x, r, g, b, a) of every pixel of the PNG or JPEG files under a path, decoded by Spark's image source.

    Each image becomes arrays once; its bytes are not copied to its pixels' rows.
    """
    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin, height, width, channels, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                raw = np.repeat(raw, 3, axis=2) if channels == 1 else raw  # the source gives blue, green, red, and alpha if there is one
                alpha = raw[:, :, 3] if channels == 4 else np.full((height, width), 255, np.uint8)
                for lo in range(0, height, 256):
                    part, y, x = raw[lo : lo + 256], *np.mgrid[lo : min(lo + 256, height), 0:width]
                    values = [y, x, part[:, :, 2], part[:, :, 1], part[:, :, 0], alpha[lo : lo + 256]]
                    columns = [pa.array(v.ravel().astype(np.int64 if k < 2 else np.int32)) for k, v in enumerate(values)]
                    yield pa.RecordBatch.from_arrays([pa.array([origin] * len(columns[0]), pa.string()), *columns], names=["path", "y", "x", "r", "g", "b", "a"])

    return images.mapInArrow(pixels, "path string, y long, x long, r int, g int, b int, a int")


def elevation(r: str, g: str, b: str, a: str) -> Column:
    """Metres from the three bytes of an elevation pixel; null where it is transparent."""
    return F.when(F.col(a) >= 128, F.col(r) * 256.0 + F.col(g) + F.col(b) / 256.0 - 32768)


def valid_upload(url: str, width: str, height: str) -> Column:
    """Whether a data URL holds a PNG whose header states the declared size, 512 to 2048 a side."""
    body = F.regexp_extract(url, r"^data:image/png;base64,([A-Za-z0-9+/]+={0,2})$", 1)
    whole = (F.length(body) >= 32) & (F.length(body) % 4 == 0)
    head = F.hex(F.unbase64(F.when(whole, F.substring(body, 1, 32))))
    size = lambda at: F.conv(F.substring(head, at, 8), 16, 10).cast("long")
    in_range = F.col(width).between(512, 2048) & F.col(height).between(512, 2048)
    return F.coalesce(whole & in_range & F.startswith(head, F.lit("89504E470D0A1A0A")) & (size(33) == F.col(width)) & (size(41) == F.col(height)), F.lit(False))
