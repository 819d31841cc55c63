"""Content hashes, tamper-evident audit logs, sign-off and audit gates.

Digests are SHA-256 with a ``sha256:`` prefix. A log entry's link is an HMAC-SHA-256 over its
canonical JSON including the previous link: evident to whoever holds the key, not a public signature.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.errors import INVALID_PARAMETER, OperatorError

GENESIS = "sha256:" + "0" * 64  # fixed value: the link before the first entry
ZEROS = "0" * 16  # fixed value: hashes holding this run are placeholders
DEFAULT_KEY = b"framelake-test-key"
KEY_CONF = "spark.framelake.audit.key"

# Canonical field order is alphabetical; prev_link falls between these two groups.
BEFORE_LINK = ["action", "at", "case_id", "input_hash", "input_sha256", "note", "operator_key", "output_hash", "output_sha256"]
AFTER_LINK = ["recipe_hash", "recipe_sha256", "seq"]


def audit_key(df: DataFrame, key: bytes | None = None) -> bytes:
    """The link key: the caller's own, or the one from the session's configuration, never from data.

    Only sessions on one machine, as in tests, may do without one; anywhere else a missing key is an error.
    """
    if key is not None:
        return key
    key = df.sparkSession.conf.get(KEY_CONF, None)
    if key is None:
        if not df.sparkSession.sparkContext.master.split("[")[0].startswith("local"):
            raise OperatorError(INVALID_PARAMETER, f"set {KEY_CONF}")
        return DEFAULT_KEY
    return key.encode()


# Kinds of a case's files by folder.
ARTIFACT_KINDS = {"inputs": "input", "outputs": "output", "stages": "stage", "recipes": "recipe"}


def content_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def canonical_json(*cols: str) -> Column:
    """Key-sorted JSON of a record; nulls are left out."""
    return F.to_json(F.struct(*sorted(cols)))


def sorted_map(c: str) -> Column:
    """A map with its keys in order, for canonical JSON."""
    return F.map_from_entries(F.array_sort(F.map_entries(c)))


def _head() -> Column:
    return F.concat(F.regexp_replace(canonical_json(*BEFORE_LINK), r"\}$", ""), F.lit(',"prev_link":"'))


def _tail() -> Column:
    return F.concat(F.lit('",'), F.substr(canonical_json(*AFTER_LINK), F.lit(2)))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC (RFC 2104) from built-in hashing, so checking a log never leaves the JVM."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.unhex(F.lit(bytes(b ^ 0x36 for b in block).hex()))
    outer = F.unhex(F.lit(bytes(b ^ 0x5C for b in block).hex()))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def expected_link(key: bytes) -> Column:
    return hmac_sha256(key, F.concat(_head(), F.col("prev_link"), _tail()))


def chain_append(entries: DataFrame, last: DataFrame | None = None, key: bytes | None = None) -> DataFrame:
    """Link entries (``case_id, seq, ...``) into per-case chains, after ``last`` links if given.

    A link needs the link before it, so one case is inherently sequential; it streams in batches
    through a task in ``seq`` order with one link of state and is never held whole.
    """
    key = audit_key(entries, key)
    staged = entries.withColumns({"_head": _head(), "_tail": _tail()})
    if last is not None:
        staged = staged.join(last.select("case_id", F.col("link").alias("_last")), "case_id", "left")
    else:
        staged = staged.withColumn("_last", F.lit(None).cast("string"))
    ordered = staged.repartition("case_id").sortWithinPartitions("case_id", "seq")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        case, prev = None, GENESIS
        for pdf in batches:
            prevs, links = [], []
            for c, head, tail, start in zip(pdf["case_id"], pdf["_head"], pdf["_tail"], pdf["_last"]):
                if c != case:
                    case, prev = c, start if isinstance(start, str) else GENESIS
                prevs.append(prev)
                prev = hmac.new(key, (head + prev + tail).encode(), "sha256").hexdigest()
                links.append(prev)
            yield pdf.drop(columns=["_head", "_tail", "_last"]).assign(prev_link=prevs, link=links)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema)
    return ordered.mapInPandas(link, f"{fields}, prev_link STRING, link STRING")


TAIL_BITS = 16


def checked_entries(audit: DataFrame, key: bytes | None = None) -> DataFrame:
    """Every entry with its fault, if any: broken link, wrong position, or altered content.

    Each entry stores its own predecessor's link, so entries check in parallel: a case is cut into
    runs of ``2**16`` positions and the last entry of a run is also sent to the next run.
    """
    key = audit_key(audit, key)
    run = F.shiftright("seq", TAIL_BITS)
    runs = F.when(run != F.shiftright(F.col("seq") + 1, TAIL_BITS), F.array(run, run + 1)).otherwise(F.array(run))
    spread = audit.withColumn("_run", F.explode(runs)).repartition("case_id", "_run")
    line = Window.partitionBy("case_id", "_run").orderBy("seq", "link")
    before = F.lag(F.struct("seq", "link")).over(line)
    own = spread.withColumn("_prev", before).where(F.col("_run") == run)
    first = F.col("seq") == 0
    placed = F.when(first, F.col("_prev").isNull()).otherwise(F.coalesce(F.col("_prev.seq") == F.col("seq") - 1, F.lit(False)))
    linked = F.col("prev_link") == F.when(first, F.lit(GENESIS)).otherwise(F.coalesce(F.col("_prev.link"), F.lit("")))
    fault = (
        F.when(~placed, "seq mismatch").when(~linked, "broken link").when(F.col("link") != expected_link(key), "link does not verify")
    )
    return own.withColumn("fault", fault).drop("_run", "_prev")


def chain_verify(audit: DataFrame, key: bytes | None = None) -> DataFrame:
    """One row per case: entry count, whether the chain holds, and its first failure."""
    bad = F.col("fault").isNotNull()
    return checked_entries(audit, key).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("entries"), (F.count_if(bad) == 0).alias("ok"),
        F.coalesce(F.min(F.when(bad, F.col("seq"))), F.lit(-1).cast("bigint")).alias("first_bad_seq"),
        F.coalesce(F.min_by(F.when(bad, F.col("fault")), F.when(bad, F.col("seq"))), F.lit("")).alias("reason"),
    )


def tamper_propagation(audit: DataFrame, key: bytes | None = None) -> DataFrame:
    """Entries from the first failure of their case on are untrusted."""
    checked = checked_entries(audit, key)
    first = checked.where(F.col("fault").isNotNull()).groupBy("case_id").agg(F.min("seq").alias("first_bad"))
    return checked.join(first, "case_id", "left").withColumn(
        "trusted", F.col("first_bad").isNull() | (F.col("seq") < F.col("first_bad"))
    ).drop("first_bad")


HASHES = ["input", "output", "recipe"]


def claimed_hashes(audit: DataFrame) -> DataFrame:
    """One row per hash an entry claims, placeholders left out."""
    claims = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_hash").alias("hash")) for k in HASHES]))
    return audit.select("case_id", "seq", claims.alias("c")).select("case_id", "seq", "c.*").where(
        F.col("hash").isNotNull() & ~F.col("hash").contains(ZEROS)
    )


def artifact_hash(audit: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Each claimed hash against the files present in its case."""
    present = artifacts.groupBy("case_id", "hash").agg(F.min("path").alias("path"))
    return claimed_hashes(audit).join(present, ["case_id", "hash"], "left").withColumn("ok", F.col("path").isNotNull())


def strict_audit(audit: DataFrame, artifacts: DataFrame, key: bytes | None = None) -> DataFrame:
    """Chain check plus artifact check per case."""
    files = artifact_hash(audit, artifacts).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("artifact_count"), F.count_if(~F.col("ok")).alias("missing")
    )
    zero = F.lit(0).cast("bigint")
    return chain_verify(audit, key).join(files, "case_id", "left").withColumns(
        {"artifact_count": F.coalesce("artifact_count", zero), "missing": F.coalesce("missing", zero)}
    ).withColumn("all_match", F.col("missing") == 0)


def independent_reviewer(audit: DataFrame, cases: DataFrame) -> DataFrame:
    """Sign-offs by someone other than the operator who opened the case."""
    signed = audit.where(F.col("action") == "sign-off")
    return signed.join(cases.select("case_id", "creator_key"), "case_id").where(F.col("operator_key") != F.col("creator_key"))


def signoff_status(audit: DataFrame, cases: DataFrame) -> DataFrame:
    """Sign-off counts and distinct independent approvers per case; the note's wording decides."""
    text = F.lower("note")
    signed = F.col("action") == "sign-off"
    approves = signed & text.contains("decision: approve")
    rejects = signed & text.contains("decision: reject")
    joined = audit.join(cases.select("case_id", "creator_key"), "case_id")
    independent = F.when(approves & (F.col("operator_key") != F.col("creator_key")), F.col("operator_key"))
    return joined.groupBy("case_id").agg(
        F.count_if(signed).alias("signoffs"), F.count_if(approves).alias("approvals"), F.count_if(rejects).alias("rejections"),
        F.sort_array(F.collect_set(independent)).alias("reviewers"),
    ).withColumn("independent", F.size("reviewers") > 0)


def fips_summary(audit: DataFrame) -> DataFrame:
    """Artifact entries and how many carry a SHA-256 for every hash; false when there are none."""
    has = F.col("input_hash").isNotNull() | F.col("output_hash").isNotNull() | F.col("recipe_hash").isNotNull()
    full = has
    for k in HASHES:
        full = full & (F.col(f"{k}_hash").isNull() | F.col(f"{k}_sha256").isNotNull())
    return audit.groupBy("case_id").agg(
        F.count_if(has).alias("artifact_entries"), F.count_if(full).alias("covered_entries")
    ).withColumn("fips_ok", (F.col("artifact_entries") > 0) & (F.col("artifact_entries") == F.col("covered_entries")))


def audit_gate(
    audit: DataFrame, cases: DataFrame, artifacts: DataFrame, require_fips: bool = False, require_signoff: bool = False, key: bytes | None = None
) -> DataFrame:
    """Verdict per case with the first reason it fails."""
    joined = strict_audit(audit, artifacts, key).join(signoff_status(audit, cases), "case_id", "left").join(fips_summary(audit), "case_id", "left")
    reason = F.when(~F.col("ok"), "audit log broken").when(~F.col("all_match"), "artifact missing")
    if require_fips:
        reason = reason.when(~F.coalesce("fips_ok", F.lit(False)), "sha-256 missing")
    if require_signoff:
        reason = reason.when(~F.coalesce("independent", F.lit(False)), "no independent approval")
    return joined.select("case_id", F.coalesce(reason, F.lit("ok")).alias("reason")).withColumn("passed", F.col("reason") == "ok")


def case_rollup(audit: DataFrame) -> DataFrame:
    """Entries and first and last time per case and action, per case, and overall."""
    audit = audit.select("case_id", "action", "at")
    return audit.groupingSets([["case_id", "action"], ["case_id"], []], "case_id", "action").agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("entries"), F.min("at").alias("first_at"), F.max("at").alias("last_at")
    )


def artifact_rollup(artifacts: DataFrame) -> DataFrame:
    """Files per case and kind, per case, and overall; the kind follows from the first folder of ``path``, the stage from the second."""
    folder = F.split("path", "/")
    kind = F.coalesce(*[F.when(folder[0] == name, word) for name, word in ARTIFACT_KINDS.items()], F.lit("other"))
    slim = artifacts.select("case_id", kind.alias("kind"), F.when(kind == "stage", folder[1]).alias("_stage"))
    return slim.groupingSets([["case_id", "kind"], ["case_id"], []], "case_id", "kind").agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("artifacts"), F.countDistinct("_stage").alias("stage_runs")
    )


def manifest(renders: DataFrame, hashes: DataFrame) -> DataFrame:
    """Input, output and recipe digests of each render, looked up by path; its ``rendered_at``, where given, also as ``render_time`` text in UTC."""
    out = renders
    if "rendered_at" in renders.columns:
        out = out.withColumn("render_time", F.date_format("rendered_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    for k in HASHES:
        named = hashes.select(F.col("path").alias(f"{k}_path"), F.col("hash").alias(f"{k}_hash"))
        out = out.join(named, f"{k}_path", "left")
    return out


def project_digest(nodes: DataFrame) -> DataFrame:
    """One hash per project over its nodes' canonical rows, in any order.

    Row digests fold up a fixed tree of digest prefixes (six hex digits, three, none). A group is the rows
    sharing six digits, or at most 4096 hashes above that, so one huge project is no huge group.
    """
    rows = nodes.withColumn("params", sorted_map("params"))
    cols = [c for c in nodes.columns if c != "project_id"]
    level = rows.select("project_id", F.sha2(canonical_json(*cols), 256).alias("h")).withColumn("p", F.col("h"))
    for digits in (6, 3, 0):
        members = F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda s: s["h"])
        level = level.groupBy("project_id", F.substring("p", 1, digits).alias("q")).agg(F.sha2(F.array_join(members, ""), 256).alias("h")).withColumnRenamed("q", "p")
    return level.select("project_id", F.concat(F.lit("sha256:"), "h").alias("project_hash"))


def share_token(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Whether each link's recorded hash still equals its project's."""
    now = project_digest(nodes).withColumnRenamed("project_hash", "current_hash")
    return links.join(now, "project_id", "left").withColumn("valid", F.col("project_hash").eqNullSafe(F.col("current_hash")))


def dedup_content(blobs: DataFrame) -> DataFrame:
    """One row per distinct content, the smallest id kept, copies counted."""
    return blobs.groupBy("hash").agg(F.min("blob_id").alias("blob_id"), F.max("size").alias("size"), F.count(F.lit(1)).alias("copies"))


def tail_of(audit: DataFrame) -> DataFrame:
    """Last link and next position per case."""
    return audit.groupBy("case_id").agg(F.max_by("link", "seq").alias("link"), (F.max("seq") + 1).alias("next_seq"))



def _draft(df: DataFrame) -> DataFrame:
    """Fill the entry columns a caller does not set."""
    have = set(df.columns)
    for c in [*BEFORE_LINK, *AFTER_LINK]:
        if c not in have and c != "seq":
            df = df.withColumn(c, F.lit("") if c == "note" else F.lit(None).cast("string"))
    return df


def append_to(audit: DataFrame, drafts: DataFrame, key: bytes | None = None) -> DataFrame:
    """New linked entries for cases whose chain holds; cases with a broken log get none.

    Only the last link and length of each log are read, so appending costs one aggregate however
    long the logs are. Drafts carry ``case_id, draft_no`` with ``draft_no`` counting from 0 per case.
    """
    intact = chain_verify(audit, key).where("ok").select("case_id")
    tails = tail_of(audit).join(intact, "case_id", "left_semi")
    placed = _draft(drafts).join(tails, "case_id").withColumn("seq", F.col("next_seq") + F.col("draft_no"))
    return chain_append(placed.select(*BEFORE_LINK, *AFTER_LINK), tails, key)


def record_run(audit: DataFrame, runs: DataFrame, key: bytes | None = None) -> DataFrame:
    """Finished renders as log entries with their hash triple."""
    return append_to(audit, runs.withColumn("action", F.lit("render")), key)


def super_resolve_drafts(runs: DataFrame, shifts: DataFrame) -> DataFrame:
    """Log drafts of fused frames whose note carries each frame's measured shift.

    ``runs`` holds ``case_id, draft_no, at, operator_key, asset_id, scale, fuse, remark`` and hashes; ``shifts`` is the output of
    ``phase_correlate``. The first frame's hash stands for the input, the report names every frame. Runs without shifts are
    left out (``super_resolve_errors``).
    """
    frame = F.struct("frame_no", "dx", "dy", "peak")
    reports = shifts.groupBy("asset_id").agg(F.count(F.lit(1)).alias("_n"), F.to_json(F.array_sort(F.collect_list(frame))).alias("_report"))
    text = F.format_string("super-resolve of %d frames at scale %d by %s; shifts: %s", "_n", "scale", "fuse", "_report")
    remark = F.coalesce("remark", F.lit(""))
    note = F.when(remark == "", text).otherwise(F.concat(remark, F.lit(" | "), text))
    done = runs.join(reports, "asset_id").withColumns({"action": F.lit("super-resolve"), "note": note})
    return done.drop("asset_id", "scale", "fuse", "remark", "_n", "_report")


def super_resolve_errors(runs: DataFrame, shifts: DataFrame) -> DataFrame:
    """Runs whose frames were not registered."""
    return runs.join(shifts.select("asset_id"), "asset_id", "left_anti").select(
        "case_id", F.lit("INVALID_PARAMETER").alias("code"), F.concat(F.lit("no measured shifts for "), "asset_id").alias("reason")
    )


def record_super_resolve(audit: DataFrame, runs: DataFrame, shifts: DataFrame, key: bytes | None = None) -> DataFrame:
    """Fused frames as log entries with their shift report; nothing is added to a broken log."""
    return append_to(audit, super_resolve_drafts(runs, shifts), key)


def decision_errors(decisions: DataFrame) -> DataFrame:
    return decisions.where(~F.lower("decision").isin("approve", "reject")).select(
        "case_id", F.lit("INVALID_PARAMETER").alias("code"),
        F.concat(F.lit("decision must be 'approve' or 'reject', got '"), F.col("decision"), F.lit("'")).alias("reason"),
    )


def decision_drafts(decisions: DataFrame, cases: DataFrame) -> DataFrame:
    """Sign-off drafts with the fixed note wording, flagged when signed by the case's opener."""
    word = F.lower("decision")
    text = F.when(F.coalesce("remark", F.lit("")) == "", F.concat(F.lit("decision: "), word)).otherwise(
        F.concat(F.lit("decision: "), word, F.lit(" — "), F.col("remark"))
    )
    return (
        decisions.where(word.isin("approve", "reject")).join(cases.select("case_id", "creator_key"), "case_id")
        .withColumns({"action": F.lit("sign-off"), "note": text, "self_signoff": F.col("operator_key") == F.col("creator_key")})
    )


def open_case(existing: DataFrame, new: DataFrame, key: bytes | None = None) -> DataFrame:
    """First entries of cases not open yet."""
    fresh = new.join(existing.select("case_id"), "case_id", "left_anti")
    first = fresh.select("case_id", "at", F.col("creator_key").alias("operator_key"), F.lit("case-init").alias("action"), F.lit(0).cast("bigint").alias("seq"))
    return chain_append(_draft(first).select(*BEFORE_LINK, *AFTER_LINK), key=key)


def open_case_errors(existing: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(existing.select("case_id"), "case_id", "left_semi").select(
        "case_id", F.lit("INVALID_PARAMETER").alias("code"), F.lit("case already open").alias("reason")
    )
