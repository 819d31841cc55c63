"""Positions and order statistics that do not put one key's rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.session import cut_lineage


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str) -> DataFrame:
    """Zero-based position of every row within ``keys`` under ``order``.

    ``bucket`` must not decrease along ``order``. Rows are ranked inside ``(keys, bucket)`` and
    shifted by the row count of all earlier buckets, so the work of a hot key spreads over its
    buckets; only the per-bucket counts meet in one task per key.
    """
    keys = list(keys)
    bucketed = df.withColumn("_bucket", bucket)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        bucketed.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "_bucket"])
        .withColumn(name, (F.col("_offset") + F.col("_rank")).cast("bigint"))
        .drop("_bucket", "_offset", "_rank")
    )


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float], bins: int = 65536,
    lo: float = 0.0, hi: float = 1.0,
) -> DataFrame:
    """Values at index ``floor(q*(n-1))`` of each key's sorted values, one column per fraction.

    Equal values collapse to counts before the shuffle. Bins over ``[lo, hi]`` spread the distinct
    values of one key over many tasks; running counts over the bins (at most ``bins + 2`` rows per
    key) place each bin, and a second running count inside the bin finds the exact value.
    """
    keys = list(keys)
    slot = F.floor((F.col(value) - lo) / (hi - lo) * bins).cast("int")
    slot = F.least(F.greatest(slot, F.lit(-1)), F.lit(bins))
    counts = df.groupBy(*keys, slot.alias("_bin"), F.col(value).alias("_value")).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    all_bins = Window.partitionBy(*keys)
    upto_bin = all_bins.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        counts.groupBy(*keys, "_bin").agg(F.sum("_rows").alias("_in_bin"))
        .withColumns(
            {
                "_before": F.coalesce(F.sum("_in_bin").over(upto_bin), F.lit(0)),
                "_total": F.sum("_in_bin").over(all_bins),
            }
        )
    )
    wanted = F.array(*[F.floor(F.lit(q) * (F.col("_total") - 1)) for q in fractions.values()])
    placed = placed.withColumn(
        "_wanted",
        F.filter(wanted, lambda i: (i >= F.col("_before")) & (i < F.col("_before") + F.col("_in_bin"))),
    ).where(F.size("_wanted") > 0)
    inside = Window.partitionBy(*keys, "_bin").orderBy("_value")
    hits = (
        counts.join(placed.select(*keys, "_bin", "_before", "_total"), [*keys, "_bin"])
        .withColumn("_end", F.col("_before") + F.sum("_rows").over(inside))
        .withColumn("_start", F.col("_end") - F.col("_rows"))
    )
    picks = {}
    for name, q in fractions.items():
        index = F.floor(F.lit(q) * (F.col("_total") - 1))
        picks[name] = F.max(F.when((index >= F.col("_start")) & (index < F.col("_end")), F.col("_value")))
    return hits.groupBy(*keys).agg(*[c.alias(n) for n, c in picks.items()])


def top_share(
    df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str], share: float, bins: int = 65536
) -> DataFrame:
    """The ``max(1, ceil(share*n))`` best rows per key by ``(score desc, ties)``, score in ``[0, 1]``.

    Whole score bins above the cut pass by their count alone; only the bin holding the cut is
    ranked, and there first by line (``ties[0]``) so that one flat region cannot fill one task.
    """
    keys = list(keys)
    first, *rest = ties
    slot = F.floor(F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)) * bins).cast("int")
    binned = df.withColumn("_bin", slot)
    everything = Window.partitionBy(*keys)
    above = everything.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_in_bin"))
        .withColumns(
            {
                "_above": F.coalesce(F.sum("_in_bin").over(above), F.lit(0)),
                "_keep": F.greatest(F.ceil(F.sum("_in_bin").over(everything) * F.lit(share)), F.lit(1)),
            }
        )
        .where(F.col("_above") < F.col("_keep"))
        .withColumn("_whole", F.col("_above") + F.col("_in_bin") <= F.col("_keep"))
    )
    # Few rows beyond the answer get here; they are read twice below.
    candidates = cut_lineage(binned.join(cut, [*keys, "_bin"]))
    # In the cut bin, counts per (score, line) give each line its offset; rows rank inside the line.
    order = [F.desc(score), F.asc(first)]
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    lines = (
        candidates.where(~F.col("_whole")).groupBy(*keys, score, first).agg(F.count(F.lit(1)).alias("_in_line"))
        .withColumn("_line_offset", F.coalesce(F.sum("_in_line").over(before), F.lit(0))).drop("_in_line")
    )
    inside = Window.partitionBy(*keys, score, first).orderBy(*rest)
    ranked = candidates.withColumn("_rank", F.row_number().over(inside)).join(lines, [*keys, score, first], "left")
    fits = F.col("_above") + F.col("_line_offset") + F.col("_rank") <= F.col("_keep")
    return ranked.where(F.col("_whole") | fits).select(*df.columns)
