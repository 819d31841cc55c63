"""Audit logs, projects, frame ranges and bundles as tables, and the sinks that write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.errors import INVALID_PARAMETER, LAYOUT, OperatorError
from framelake.schemas import AUDIT, PROJECT

PROJECT_TAG = "framelake.project/v1"


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Newline JSON audit logs; blank lines are skipped, a malformed line fails the read."""
    return parse_audit(spark.read.text(path))


def parse_audit(lines: DataFrame) -> DataFrame:
    kept = lines.where(F.trim("value") != "")
    return kept.select(F.from_json("value", AUDIT, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def parse_projects(raw: DataFrame) -> DataFrame:
    """Project JSON documents; a wrong schema tag fails the read."""
    p = raw.select(F.from_json("json", PROJECT, {"mode": "FAILFAST"}).alias("p")).select("p.*")
    tag = F.assert_true(F.coalesce(F.col("schema") == PROJECT_TAG, F.lit(False)), F.lit("unsupported project schema"))
    return p.withColumn("_ok", tag).where("_ok is null").drop("_ok")


def project_tables(projects: DataFrame) -> dict[str, DataFrame]:
    """One table per project collection."""
    pid = F.col("id").alias("project_id")
    one = lambda c: projects.select(pid, F.explode(c).alias("e")).select("project_id", "e.*")
    return {
        "assets": one("assets"), "nodes": one("nodes"), "presets": one("presets"), "history": one("history"),
        "sinks": projects.select(pid, F.explode("sinks").alias("node_id")),
        "models": projects.select(pid, F.explode("models").alias("model", "hash")),
    }


def project_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of every collection per project, counted in one shuffle."""
    tagged = None
    for name, df in tables.items():
        part = df.select("project_id", F.lit(name).alias("what"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("project_id").agg(*[F.count_if(F.col("what") == n).alias(f"{n}_count") for n in tables])


def frame_extract(frames: DataFrame, start: int, end: int, stride: int = 1, prefix: str = "frame_", ext: str = "png") -> DataFrame:
    """Frames of a range at a stride with their zero-padded output names."""
    if end <= start:
        raise OperatorError(INVALID_PARAMETER, f"end ({end}) must be > start ({start})")
    ext = ext.lower()
    if ext not in ("png", "jpg", "jpeg"):
        raise OperatorError(INVALID_PARAMETER, f"format must be png or jpg, got {ext!r}")
    width = max(6, len(str(end - 1)))
    name = F.concat(F.lit(prefix), F.lpad(F.col("frame_no").cast("string"), width, "0"), F.lit(".png" if ext == "png" else ".jpg"))
    kept = frames.where((F.col("frame_no") >= start) & (F.col("frame_no") < end) & ((F.col("frame_no") - start) % max(stride, 1) == 0))
    return kept.withColumn("output_name", name)


def bundle_export(assets: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blobs to embed, one per project and distinct content, and a manifest row per project.

    Assets that are not local files or have no blob are left out. ``hash_set`` tells whether two bundles hold the same
    contents without listing them: the count, and the sum of 60 bits of every hash.
    """
    local = assets.where(F.col("uri").startswith("file://"))
    found = local.join(blobs.select("blob_id", F.col("hash").alias("content_hash"), "size"), local.blob_id == blobs.blob_id).drop(blobs.blob_id)
    embed = found.groupBy("project_id", "content_hash").agg(F.count(F.lit(1)).alias("assets"), F.max("size").alias("size"))
    bits = F.conv(F.substring(F.regexp_replace("content_hash", "^[a-z0-9]+:", ""), 1, 15), 16, 10).cast("decimal(38,0)")
    manifest = embed.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("embedded"), F.sum("assets").alias("assets"), F.sum("size").alias("bytes"),
        F.concat_ws(":", F.count(F.lit(1)), F.sum(bits)).alias("hash_set"),
    )
    return embed, manifest


def write_bundle(assets: DataFrame, blobs: DataFrame, path: str) -> None:
    """A self-contained export below ``path``: ``entries`` (every project's hashes), ``contents`` (each hash's bytes, once) and ``manifest``.

    ``blobs`` holds ``blob_id, hash, size, content``. Adaptive execution sizes the content files by bytes.
    """
    embed, manifest = bundle_export(assets, blobs)
    embed.withColumn("archive_path", F.concat(F.lit("assets/"), F.regexp_replace("content_hash", "^[a-z0-9]+:", ""))).write.parquet(f"{path}/entries")
    entries = assets.sparkSession.read.parquet(f"{path}/entries")
    wanted = entries.select("content_hash").distinct()
    # The smallest id stands for equal contents, so bytes are joined for one row per hash only.
    first = blobs.groupBy(F.col("hash").alias("content_hash")).agg(F.min("blob_id").alias("blob_id")).join(wanted, "content_hash")
    contents = blobs.select("blob_id", "content").join(first, "blob_id").select("content_hash", "content")
    contents.hint("rebalance").write.parquet(f"{path}/contents")
    manifest.write.parquet(f"{path}/manifest")


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``entries``, ``contents`` and ``manifest`` of a written bundle."""
    return tuple(spark.read.parquet(f"{path}/{part}") for part in ("entries", "contents", "manifest"))


def bundle_faults(spark: SparkSession, path: str) -> DataFrame:
    """``content_hash, code, reason`` where contents are missing or differ from their hash."""
    entries, contents, _ = read_bundle(spark, path)
    seen = contents.select("content_hash", (F.concat(F.lit("sha256:"), F.sha2("content", 256)) == F.col("content_hash")).alias("_same"))
    joined = entries.select("content_hash").distinct().join(seen, "content_hash", "left").where("_same IS NULL OR NOT _same")
    return joined.select("content_hash", F.lit(LAYOUT).alias("code"), F.when(F.col("_same").isNull(), "content is missing").otherwise("content differs from its hash").alias("reason"))


def bundle_import(entries: DataFrame, assets: DataFrame) -> DataFrame:
    """Embedded blobs linked to every asset with the same digest; unlinked blobs keep a nil id."""
    safe = entries.where(~F.col("archive_path").contains("..") & ~F.col("archive_path").startswith("/"))
    digest = F.regexp_replace("archive_path", "^assets/", "")
    bare = assets.select("asset_id", F.regexp_replace("hash", "^[a-z0-9]+:", "").alias("digest"))
    return safe.where(F.col("archive_path").startswith("assets/") & (F.length(digest) > 0)).withColumn("digest", digest).join(bare, "digest", "left").withColumn(
        "asset_id", F.coalesce("asset_id", F.lit("00000000-0000-0000-0000-000000000000"))
    )


def bundle_errors(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("archive_path").contains("..") | F.col("archive_path").startswith("/")).select(
        "archive_path", F.lit(INVALID_PARAMETER).alias("code"), F.lit("rejected suspicious bundle entry").alias("reason")
    )


def write_stages(stages: DataFrame, path: str) -> None:
    stages.write.mode("overwrite").partitionBy("stage_no").parquet(path)


def batch_stats(runs: DataFrame) -> DataFrame:
    """Processed, skipped and failed counts."""
    return runs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("processed", "skipped", "failed")])
