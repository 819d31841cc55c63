"""Rendered frames in a fixed number of buckets: files follow bytes, not frames, and a frame is replaced without touching other buckets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.errors import INVALID_PARAMETER, LAYOUT, OperatorError
from framelake.schemas import FRAME, PIXEL
from framelake.session import cut_lineage

BUCKETS = 64
_BUCKET = re.compile(r"bucket_of_(\d+)$")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*FRAME), F.lit(buckets)).cast("int")


def _write(px: DataFrame, path: str, buckets: int, replace: str) -> None:
    """Whole buckets per task; adaptive execution splits large ones and joins small ones, so that files have about its advisory size.

    Files are sorted, so the ranges kept for each row group find a frame inside a bucket. ``replace`` is ``static`` for all old
    content or ``dynamic`` for the buckets written.
    """
    name = f"bucket_of_{buckets}"
    dealt = px.withColumn(name, _bucket(buckets)).hint("rebalance", F.col(name)).sortWithinPartitions(name, *PIXEL)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", replace).partitionBy(name).parquet(path)


def buckets_of(spark: SparkSession, path: str) -> int | None:
    """How many buckets a folder of frames has; None where there is none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return None
    for entry in system.listStatus(folder):
        if found := _BUCKET.match(entry.getPath().getName().split("=")[0]):
            return int(found[1])
    return None


def write_render(px: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store frames, replacing a folder's content. The committer shows files only when the job is done; a lost task leaves none."""
    if buckets < 1:
        raise OperatorError(INVALID_PARAMETER, "buckets must be at least 1")
    _write(px, path, buckets, "static")


def replace_frames(px: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store frames in place of their old versions; frames that ``px`` does not hold stay.

    Only the buckets of new frames are read and written again. The new content of these buckets is complete before the
    old one goes.
    """
    spark = px.sparkSession
    now = buckets_of(spark, path)
    if now is None:
        _write(px, path, buckets, "static")
        return
    name = f"bucket_of_{now}"
    px = cut_lineage(px)
    frames = px.select(*FRAME).distinct()
    touched = [r[0] for r in frames.select(_bucket(now)).distinct().collect()]  # at most one number per bucket
    kept = spark.read.parquet(path).where(F.col(name).isin(touched)).drop(name).join(frames, FRAME, "left_anti")
    _write(cut_lineage(px.unionByName(kept)), path, now, "dynamic")


def read_render(spark: SparkSession, path: str, asset_id: str | None = None, frame_no: int | None = None) -> DataFrame:
    """Stored frames, or one of them: its bucket is the only one read."""
    now = buckets_of(spark, path)
    if now is None:
        raise OperatorError(LAYOUT, f"no frames at {path}")
    name, px = f"bucket_of_{now}", spark.read.parquet(path)
    if asset_id is not None and frame_no is not None:
        one = spark.range(1).select(F.lit(asset_id).alias("asset_id"), F.lit(frame_no).cast("int").alias("frame_no"))
        px = px.where(F.col(name) == one.select(_bucket(now)).first()[0])
    if asset_id is not None:
        px = px.where(F.col("asset_id") == asset_id)
    if frame_no is not None:
        px = px.where(F.col("frame_no") == frame_no)
    return px.drop(name)
