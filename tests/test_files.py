"""Files by byte range, digests, the blob sink, stored frames and bundles."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.errors import OperatorError
from framelake.sources import files, images, renders
from framelake.sources import tables as src


def test_blocks_cover_every_file(spark, tmp_path):
    rng = np.random.default_rng(0)
    whole = {f"f{n}.bin": rng.bytes(n) for n in (0, 1, 999, 1000, 1001, 12_345)}
    (tmp_path / "sub").mkdir()
    for name, content in whole.items():
        (tmp_path / "sub" / name).write_bytes(content)
    (tmp_path / "_hidden").write_bytes(b"x")
    files.register(spark)
    read = spark.read.format("framelake_blocks").option("stepBytes", "1000").option("taskBytes", "4000").load(str(tmp_path))
    assert read.rdd.getNumPartitions() >= 5  # the largest file is dealt to several tasks
    got = {}
    for r in read.orderBy("uri", "block").collect():
        assert r["start"] == 1000 * r["block"]
        got[r["uri"].rsplit("/", 1)[1]] = got.get(r["uri"].rsplit("/", 1)[1], b"") + bytes(r["content"])
    assert got == whole
    listed = {r["uri"].rsplit("/", 1)[1]: (r["size"], r["hash"]) for r in images.binary_inventory(spark, str(tmp_path)).collect()}
    assert listed == {k: (len(v), "sha256:" + hashlib.sha256(v).hexdigest()) for k, v in whole.items()}


def test_files_above_two_gigabytes(spark, tmp_path):
    size = (2 << 30) + 12_345
    with (tmp_path / "long.mkv").open("wb") as f:
        f.truncate(size)  # sparse: takes no disk
    want = hashlib.sha256()
    for _ in range(size // (1 << 20)):
        want.update(bytes(1 << 20))
    want.update(bytes(size % (1 << 20)))
    row = images.binary_inventory(spark, str(tmp_path)).first()
    assert (row["size"], row["hash"], row["kind"]) == (size, "sha256:" + want.hexdigest(), "video")
    blocks = images.file_blocks(spark, f"file://{tmp_path}", block_bytes=64 << 20).agg(F.count("*"), F.sum(F.length("content"))).first()
    assert tuple(blocks) == (33, size)


def blobs(spark, names):
    return spark.createDataFrame([(n, n.encode() if n else None) for n in names], "path STRING, content BINARY").repartition(4)


def test_blob_sink_commits_all_or_nothing(spark, tmp_path):
    images.write_blobs(blobs(spark, ["a/x.txt", "b.txt", "c/d/e.txt"]), str(tmp_path))
    found = lambda: {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()}
    assert found() == {n: n for n in ("a/x.txt", "b.txt", "c/d/e.txt")}
    for bad in (["n1", "n2", None], ["n1", "../up"], ["n1", "/root"], ["n1", "n1"], ["n1", "_x"]):
        with pytest.raises(Exception):  # noqa: B017
            images.write_blobs(blobs(spark, bad), str(tmp_path))
        assert len(found()) == 3 and not [p for p in tmp_path.iterdir() if p.name.startswith("_temporary")]
    images.write_blobs(blobs(spark, ["b.txt", "new.txt"]), str(tmp_path), mode="overwrite")
    assert set(found()) == {"b.txt", "new.txt"}


def frames(spark, n, side=4, value=0.25):
    return spark.range(n * side * side).select(
        F.lit("a").alias("asset_id"), (F.col("id") / (side * side)).cast("int").alias("frame_no"), (F.col("id") / side % side).cast("int").alias("y"),
        (F.col("id") % side).cast("int").alias("x"), *[F.lit(value).alias(c) for c in "rgba"],
    )


def test_render_files_follow_bytes(spark, tmp_path):
    path = str(tmp_path / "r")
    renders.write_render(frames(spark, 500), path, buckets=4)
    assert len(list(tmp_path.rglob("*.parquet"))) <= 8  # not one per frame
    assert renders.buckets_of(spark, path) == 4
    one = renders.read_render(spark, path, "a", 77)
    assert one.count() == 16 and len(one.inputFiles()) >= 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket_of_4" in plan


def test_replaced_frames_leave_others(spark, tmp_path):
    path = str(tmp_path / "r")
    renders.replace_frames(frames(spark, 40), path, buckets=8)  # a first version
    renders.replace_frames(frames(spark, 3, value=0.75), path, buckets=99)  # the folder's own number of buckets counts
    got = renders.read_render(spark, path).groupBy("frame_no").agg(F.count("*").alias("n"), F.max("r").alias("r")).collect()
    assert {(r["frame_no"], r["n"], r["r"]) for r in got} == {(k, 16, 0.75 if k < 3 else 0.25) for k in range(40)}
    with pytest.raises(OperatorError):
        renders.read_render(spark, str(tmp_path / "none"))


def test_bundle_round_trip_and_faults(spark, tmp_path):
    path = str(tmp_path / "b")
    rows = [("1", b"one"), ("2", b"two"), ("3", b"one"), ("4", b"web only")]
    made = spark.createDataFrame([(i, "sha256:" + hashlib.sha256(c).hexdigest(), len(c), c) for i, c in rows], "blob_id STRING, hash STRING, size INT, content BINARY")
    assets = spark.createDataFrame([("p", "1", "file://1"), ("p", "2", "file://2"), ("q", "3", "file://3"), ("q", "4", "https://4"), ("q", "9", "file://9")], "project_id STRING, blob_id STRING, uri STRING")
    src.write_bundle(assets, made, path)
    entries, contents, manifest = src.read_bundle(spark, path)
    assert sorted(bytes(r["content"]) for r in contents.collect()) == [b"one", b"two"]
    sums = {r["project_id"]: (r["embedded"], r["assets"], r["bytes"]) for r in manifest.collect()}
    assert sums == {"p": (2, 2, 6), "q": (1, 1, 3)}
    linked = src.bundle_import(entries.select("archive_path").distinct(), made.select(F.concat(F.lit("a"), "blob_id").alias("asset_id"), "hash"))
    assert {r["asset_id"] for r in linked.collect()} == {"a1", "a2", "a3"}
    assert src.bundle_faults(spark, path).isEmpty()
    broken = contents.withColumn("content", F.when(F.col("content") == b"two", F.lit(b"other")).otherwise(F.col("content"))).where(F.col("content") != b"one")
    other = str(tmp_path / "c")
    for name, part in (("entries", entries), ("contents", broken), ("manifest", manifest)):
        part.write.parquet(f"{other}/{name}")
    assert {r["reason"] for r in src.bundle_faults(spark, other).collect()} == {"content is missing", "content differs from its hash"}
