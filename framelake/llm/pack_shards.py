"""Shards of nearly equal bytes, tokens and rows by vector bin packing.

Rows with equal texts form a group and stay together. A group is a vector (bytes, tokens, rows), each as a share of the total; groups
are placed, largest first, on the shard whose residual capacity has the highest dot product with the vector, among those it fits
in; a group that fits nowhere goes where most bytes are left.

Three sizes of groups are told apart by shares of the total, so that neither the driver nor a task sees all groups:

* groups above ``1 / (shards * 4)`` in any measure are split by id hash into chunks below that share: kept whole they
  could not be balanced;
* units (chunks and groups) above ``1 / (shards * 25)`` are placed first, together: there are at most ``3 * 25 * shards`` groups of
  that size, whatever the input;
* all others are dealt to partitions by hash, and each partition fills its part of the capacity that is left.

Defined results: a null text counts as empty, with no bytes but the fixed 16 of every row; repeated rows are placed
each; null ids are ordered first; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.ordering import positions
from framelake.session import cut_lineage, ship_package

ROW_BYTES = 16
MEASURES = ["size", "tokens", "rows"]


@dataclass(frozen=True)
class Packing:
    """Sizes of the packing."""

    shards: int = 40
    split_above: float = 0.25  #: share of one shard above which a group is split
    place_first: float = 0.04  #: share of one shard above which a unit is placed before the partitions
    units_per_task: int = 8192
    slots_per_task: int = 20_000


def place(units: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Shard of each unit (rows of ``units``: shares), largest first; ``residual`` (shards x measures) is used up."""
    out = np.empty(len(units), np.int64)
    for k in np.lexsort((np.arange(len(units)), -units.max(axis=1) if len(units) else [])):
        dot = residual @ units[k]
        fits = (residual >= units[k]).all(axis=1)
        if fits.any():
            at = int(np.argmax(np.where(fits, dot, -np.inf)))
        else:  # full in some measure everywhere: the shard with most bytes left
            at = int(np.argmax(residual[:, 0]))
        out[k] = at
        residual[at] -= units[k]
    return out


def words(text: Column) -> Column:
    """Space-separated words, a cheap stand-in for tokens."""
    n = F.octet_length(text)
    return F.when(n > 0, n - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) + 1).otherwise(0)


def pack(docs: DataFrame, law: Packing = Packing(), id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    ``tokens`` measures a row's tokens (default: its words). ``slot`` numbers a shard's rows without gaps.
    """
    spark = docs.sparkSession
    ship_package(spark)
    text = F.col(f"`{text_col}`")
    count = words(text) if tokens is None else tokens
    rows = cut_lineage(docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("bigint").alias("size"),
        F.coalesce(count, F.lit(0)).cast("bigint").alias("tokens"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("group"),
    ))
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    groups = cut_lineage(groups)
    n_groups, *sums = groups.agg(F.count(F.lit(1)), *[F.sum(c) for c in MEASURES]).first()
    if not n_groups:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    totals = np.maximum(np.array(sums, float), 1)
    share = F.greatest(*[F.col(c) / float(t) for c, t in zip(MEASURES, totals, strict=True)])

    # At most 3 * shards / place_first groups, by the shares they hold.
    first = groups.withColumn("share", share).where(F.col("share") > law.place_first / law.shards).toPandas()
    first["chunks"] = np.maximum(1, np.ceil(first["share"] * law.shards / law.split_above)).astype(int)
    large = spark.createDataFrame([(bytes(g), int(c)) for g, c in zip(first["group"], first["chunks"], strict=True)], "group BINARY, chunks INT")
    rows = rows.join(F.broadcast(large), "group", "left").withColumn("chunk", F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("doc_id"), "chunks")).otherwise(0).cast("int"))
    whole = first[first["chunks"] == 1].assign(chunk=0)
    parts = rows.where(F.col("chunks") > 1).groupBy("group", "chunk").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).toPandas()
    units = pd.concat([whole[["group", "chunk", *MEASURES]], parts], ignore_index=True)
    units["group"] = units["group"].map(bytes)
    units = units.sort_values(["group", "chunk"], ignore_index=True)
    residual = np.full((law.shards, 3), 1 / law.shards)
    units["shard"] = place(units[MEASURES].to_numpy(float) / totals, residual)
    placed = spark.createDataFrame(
        [(g, int(c), int(s)) for g, c, s in zip(units["group"], units["chunk"], units["shard"], strict=True)], "group BINARY, chunk INT, shard INT"
    )

    tasks = max(1, -(-int(n_groups) // law.units_per_task))
    left = np.maximum(residual, 0)
    left /= np.maximum(left.sum(axis=0), 1e-300)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group", ignore_index=True)
        shares = pdf[MEASURES].to_numpy(float)
        shares /= np.maximum(shares.sum(axis=0), 1)
        turn = int(pdf["task"].iloc[0]) % law.shards  # partitions start at different shards, so that small excesses spread
        pdf["shard"] = (place(shares, np.roll(left, -turn, axis=0).copy()) + turn) % law.shards
        return pdf[["group", "shard"]]

    small = (
        groups.join(F.broadcast(large), "group", "left_anti").withColumn("task", F.pmod(F.xxhash64("group"), F.lit(tasks)).cast("int"))
        .groupBy("task").applyInPandas(fill, "group BINARY, shard INT")
    )
    with_first = rows.where(F.col("chunks").isNotNull()).join(F.broadcast(placed), ["group", "chunk"])
    with_small = rows.where(F.col("chunks").isNull()).join(small, "group")
    names = ["doc_id", "size", "text_crc32", "shard"]
    spread = max(1, -(-int(sums[2]) // (law.shards * law.slots_per_task)))
    done = with_first.select(*names).unionByName(with_small.select(*names)).withColumn("spread", F.pmod(F.xxhash64("doc_id"), F.lit(spread)))
    slotted = positions(done, ["shard"], ["doc_id", "size", "text_crc32"], F.col("spread"), "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, packed: DataFrame, path: str, rows_per_file: int = 100_000, id_col: str = "doc_id") -> None:
    """Write ``docs`` in a folder per shard, ordered by slot inside files of about ``rows_per_file``; ids must be unique and not null."""
    plan = packed.select(F.col("doc_id").alias("_packed_id"), F.col("shard").alias("shard_no"), F.col("slot").alias("_slot"))
    joined = docs.join(plan, F.col(f"`{id_col}`") == F.col("_packed_id")).drop("_packed_id")
    stretch = F.floor(F.col("_slot") / rows_per_file)
    dealt = joined.repartition("shard_no", stretch).sortWithinPartitions("shard_no", "_slot")
    dealt.drop("_slot").write.partitionBy("shard_no").parquet(path)
