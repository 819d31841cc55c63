"""Structured Streaming jobs. Each has a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelake.operators.provenance import GENESIS, expected_link
from framelake.session import staging_path


def file_stream(spark: SparkSession, folder: str, pattern: str, like: DataFrame, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of a folder, each read once."""
    return (
        spark.readStream.schema(like.schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all data present, into Parquet under the shared folder, and read it back."""
    spark = stream.sparkSession
    out = staging_path(spark, name)
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def ingest(stream: DataFrame, target: str, progress: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Incremental inventory: every micro-batch lands in its own partition, so a replayed batch overwrites itself."""

    def land(batch: DataFrame, batch_id: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", progress).trigger(availableNow=True).start()


def sliding_energy(signal: DataFrame, size: str, step: str, late: str) -> DataFrame:
    """Mean square per sliding event-time window; rows later than the watermark are dropped."""
    return (
        signal.withWatermark("ts", late).groupBy(F.window("ts", size, step), "asset_id")
        .agg(F.avg(F.col("v") * F.col("v")).alias("energy"), F.count(F.lit(1)).alias("n"))
        .select("asset_id", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "energy", "n")
    )


def tumbling_stats(signal: DataFrame, size: str, late: str) -> DataFrame:
    return (
        signal.withWatermark("ts", late).groupBy(F.window("ts", size), "asset_id")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))
        .select("asset_id", F.col("window.start").alias("start"), "n", "mean", "low", "high")
    )


def session_review(entries: DataFrame, gap: str, late: str) -> DataFrame:
    """Runs of an operator's entries with no pause longer than ``gap``."""
    return (
        entries.withWatermark("at", late).groupBy(F.session_window("at", gap), "operator_key").agg(F.count(F.lit(1)).alias("entries"))
        .select("operator_key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "entries")
    )


def dedup_hash(blobs: DataFrame, late: str) -> DataFrame:
    """First sight of every content hash within the watermark."""
    return blobs.withWatermark("at", late).dropDuplicatesWithinWatermark(["hash"])


TAIL_OUT = "case_id STRING, seq BIGINT, ok BOOLEAN, reason STRING"
TAIL_STATE = "next_seq BIGINT, link STRING, broken BOOLEAN"


def chain_tail(entries: DataFrame, key: bytes) -> DataFrame:
    """Verify links as entries arrive; state per case is the last link, the next position and a broken flag.

    Content is checked row by row in the JVM before the state. A trigger's entries of one case are
    put in order here, so bound a trigger with ``maxFilesPerTrigger``.
    """
    slim = entries.select("case_id", "seq", "prev_link", "link", (F.col("link") == expected_link(key)).alias("genuine"))

    def follow(case: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, link, broken = state.get if state.exists else (0, GENESIS, False)
        rows = pd.concat(list(batches)).sort_values("seq")
        verdicts = []
        for seq, prev, own, genuine in zip(rows["seq"], rows["prev_link"], rows["link"], rows["genuine"]):
            reason = ""
            if seq != expected:
                reason = "seq mismatch"
            elif prev != link:
                reason = "broken link"
            elif not genuine:
                reason = "link does not verify"
            broken = broken or bool(reason)
            verdicts.append((case[0], int(seq), not broken, reason))
            expected, link = int(seq) + 1, own
        state.update((expected, link, bool(broken)))
        yield pd.DataFrame(verdicts, columns=["case_id", "seq", "ok", "reason"])

    return slim.groupBy("case_id").applyInPandasWithState(follow, TAIL_OUT, TAIL_STATE, "append", GroupStateTimeout.NoTimeout)
