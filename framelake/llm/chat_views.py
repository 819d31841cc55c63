"""Multi-party dialogues rendered once from every participant's point of view.

For each participant of a dialogue its own turns become the assistant's and are trained on; every other speaker is a named
user; narrator turns (``system``) stay what they are in all views. A view is kept as its segments, one row per turn with the
place it takes in the rendered text, because one dialogue may be longer than a task should hold; ``assemble`` joins segments into
text parts of bounded size.

The running length of a view is summed inside buckets of neighboring turns and shifted by the totals of the earlier buckets, so a very long
dialogue spreads over many tasks.

Defined results: turns without a dialogue id take no part; a null role is the speaker ``unknown``, a null text is empty; turns are ordered by turn
number (null first), then role, then text; repeated turns are rendered each; a dialogue with narrator turns alone has no
view; markers inside texts are written with one more bar, so they stay text; empty tables give empty tables; other columns
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm import common

#: Consecutive turn numbers that are summed together.
TURNS_PER_BUCKET = 64


@dataclass(frozen=True)
class Template:
    """The written form of a turn."""

    begin: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    narrators: tuple[str, ...] = ("system",)


def escaped(text: Column) -> Column:
    """``<|`` written as ``<||``, so that no text can look like a marker; replacing it back restores the text."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def render_views(
    turns: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id, speaker, seq, turn, role, name, segment, start_at, end_at, train_from, train_to`` per view and turn.

    Offsets count code points of the view's rendered text. ``train_from`` and ``train_to`` bound what the view is trained on: the speaker's
    own words with the end marker; both are null on other turns.
    """
    slim = common.only(turns, {"conv_id": conv_col, "turn": turn_col, "role": role_col, "text": text_col})
    slim = slim.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("by"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / TURNS_PER_BUCKET), F.lit(-(1 << 62))).alias("bucket"),
    )
    speaks = ~F.col("by").isin(*template.narrators)
    # Speakers meet buckets, not turns, so that the join with turns has no key as large as a dialogue.
    speakers = slim.where(speaks).select("conv_id", F.col("by").alias("speaker")).distinct()
    views = slim.select("conv_id", "bucket").distinct().join(speakers, "conv_id")
    own = F.col("by") == F.col("speaker")
    head = (
        F.when(~speaks, F.concat(F.lit(template.begin), F.col("by"), F.lit("\n")))
        .when(own, F.lit(f"{template.begin}assistant\n"))
        .otherwise(F.concat(F.lit(f"{template.begin}user name="), escaped(F.replace(F.col("by"), F.lit("\n"), F.lit(" "))), F.lit("\n")))
    )
    rows = slim.join(views, ["conv_id", "bucket"]).select(
        "conv_id", "speaker", "bucket", "turn", "by", "text", own.alias("own"),
        F.when(~speaks, F.col("by")).when(own, F.lit("assistant")).otherwise(F.lit("user")).alias("role"),
        F.when(speaks & ~own, F.col("by")).alias("name"), F.length(head).cast("bigint").alias("head"),
        F.concat(head, escaped(F.col("text")), F.lit(template.end)).alias("segment"),
    ).withColumn("size", F.length("segment").cast("bigint"))
    view, part = ["conv_id", "speaker"], ["conv_id", "speaker", "bucket"]
    earlier = Window.partitionBy(*view).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        rows.groupBy(*part).agg(F.sum("size").alias("chars"), F.count(F.lit(1)).alias("turns"))
        .select(*part, F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars"), F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("turns"))
    )
    inside = Window.partitionBy(*part).orderBy(F.col("turn").asc_nulls_first(), "by", "text")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumns({"in_rank": F.row_number().over(inside), "in_end": F.sum("size").over(upto)})
    end = F.col("chars") + F.col("in_end")
    start = end - F.col("size")
    return ranked.join(before, part).select(
        "conv_id", "speaker", (F.col("turns") + F.col("in_rank") - 1).alias("seq"), "turn", "role", "name", "segment",
        start.alias("start_at"), end.alias("end_at"), F.when(F.col("own"), start + F.col("head")).alias("train_from"), F.when(F.col("own"), end).alias("train_to"),
    )


def assemble(views: DataFrame, part_chars: int = 1_000_000) -> DataFrame:
    """``conv_id, speaker, part, start_at, text`` from rendered segments: segments that start in one stretch of ``part_chars`` code points
    are joined, so no row outgrows that by more than its last segment."""
    part = F.floor(F.col("start_at") / part_chars).cast("bigint")
    pieces = F.array_sort(F.collect_list(F.struct("start_at", "segment")))
    return (
        views.groupBy("conv_id", "speaker", part.alias("part")).agg(pieces.alias("pieces"))
        .select("conv_id", "speaker", "part", F.col("pieces")[0]["start_at"].alias("start_at"), F.array_join("pieces.segment", "").alias("text"))
    )
