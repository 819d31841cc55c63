"""Image files, folder inventories, and blobs as files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.errors import LAYOUT
from framelake.operators.provenance import content_hash
from framelake.session import ship_package
from framelake.sources import files

# Extensions by asset kind.
STILLS = "png jpg jpeg tiff tif bmp webp heic heif jxl avif dng cr2 cr3 nef nrw arw raf orf rw2 pef srw iiq 3fr x3f".split()
VIDEOS = "mp4 mov mkv webm avi m4v mpg mpeg ts wmv flv".split()


def kind_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin(STILLS), "still_image").when(ext.isin(VIDEOS), "video").otherwise("other")


def binary_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row per file: size, time, content hash, kind.

    Files are hashed as they are read, in steps, whatever their size. Where only Spark's own reader can open the place, a file's
    content is one value, which ends at 2 GB.
    """
    if files.reachable(path):
        files.register(spark)
        rows = spark.read.format("framelake_digests").option("pattern", pattern).load(path)
        return rows.select("uri", "size", "modified", F.concat(F.lit("sha256:"), "sha256").alias("hash"), kind_of(F.col("uri")).alias("kind"))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return read.select(
        F.col("path").alias("uri"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
        content_hash(F.col("content")).alias("hash"), kind_of(F.col("path")).alias("kind"),
    )


def file_blocks(spark: SparkSession, path: str, pattern: str = "*", block_bytes: int = files.STEP_BYTES) -> DataFrame:
    """``uri, size, block, start, content, hash``: every file in blocks, read in parallel by byte range, each with its hash."""
    files.register(spark)
    rows = spark.read.format("framelake_blocks").option("pattern", pattern).option("stepBytes", str(block_bytes)).load(path)
    return rows.withColumn("hash", content_hash(F.col("content")))


def write_blobs(blobs: DataFrame, path: str, path_col: str = "path", content_col: str = "content", mode: str = "append") -> None:
    """One file per row below a folder. The files appear when all tasks are done; a failed job leaves none."""
    files.register(blobs.sparkSession)
    rows = blobs.select(F.col(path_col).cast("string").alias("path"), F.col(content_col).cast("binary").alias("content"))
    rows.write.format("framelake_blobs").mode(mode).save(path)


def _images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(path).select("image.*")


def image_errors(spark: SparkSession, path: str) -> DataFrame:
    """One row ``uri, code, reason`` per file that is not a readable image."""
    return _images(spark, path).where("width <= 0").select(
        F.col("origin").alias("uri"), F.lit(LAYOUT).alias("code"), F.lit("the file does not decode as an image").alias("reason")
    )


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded stills as packed RGBA rows for ``layout.to_pixels``; ``image_errors`` lists files that do not decode.

    Spark's decoder yields blue-green-red rows of one, three or four bytes per pixel.
    """
    ship_package(spark)

    def to_rgba(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):  # one image at a time: an image is the unit that the decoder yields
                part = batch.slice(row, 1)
                n, data = part.column("nChannels")[0].as_py(), np.frombuffer(part.column("data")[0].as_buffer(), np.uint8)
                cells = data.reshape(-1, n)
                rgba = np.full((len(cells), 4), 255, np.int32)
                rgba[:, :3] = cells[:, :1] if n == 1 else cells[:, 2::-1]
                if n == 4:
                    rgba[:, 3] = cells[:, 3]
                packed = pa.ListArray.from_arrays(pa.array([0, rgba.size], pa.int32()), pa.array(rgba.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("origin"), pa.array([0], pa.int32()), part.column("width"), part.column("height"), packed],
                    names=["asset_id", "frame_no", "width", "height", "data"],
                )

    decoded = _images(spark, path).where("width > 0").select("origin", "width", "height", "nChannels", "data")
    return decoded.mapInArrow(to_rgba, "asset_id STRING, frame_no INT, width INT, height INT, data ARRAY<INT>")
