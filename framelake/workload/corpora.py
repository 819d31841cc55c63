"""Recipe, decision, golden, user-function and streaming queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from framelake import tables as t
from framelake.operators import layout, metrics, provenance, udfs
from framelake.plans import catalogue, chain, decisions
from framelake.schemas import FRAME, PIXEL, RGB
from framelake.session import staging_path
from framelake.sources import renders
from framelake.sources import tables as src
from framelake.streaming import jobs
from framelake.workload.pixels import pair
from framelake.workload.registry import pixels, query, r9
from framelake.workload.sql import (
    AUDIT_BAD,
    DIMS,
    KEY,
    LUMA,
    PX_EMB,
    PX_PAIR,
    PX_U8,
    checked,
    clamp01,
    conv,
    rgb,
    taps,
    values,
)
from framelake.workload.stencils import _SE, CAST, STATS, ssim_sql

TEMPLATES = f"tpl AS (SELECT * FROM {values(decisions.template_rows(), 'tpl(recipe, step_no, effect, label, params)')})"

# Decisions from frame statistics


def _stats(spark, sf):
    return metrics.frame_stats(t.px_emb(spark, sf))


_AUTO = f"""a1 AS (SELECT *, least(greatest(0.90/greatest(p99-p01,0.02),0.7),2.5) AS c FROM stats), a2 AS (SELECT *, least(greatest(0.05-(p01-0.5)*c-0.5,-0.4),0.4) AS br FROM a1),
  a3 AS (SELECT *, least(greatest((p50-0.5)*c+0.5+br,0.02),0.98) AS mid FROM a2), a4 AS (SELECT *, least(greatest(ln(mid)/ln(0.5),0.5),2.0) AS pw,
    CASE WHEN chroma_mean < 0.05 THEN 1.15 WHEN chroma_mean < 0.10 THEN 1.30 WHEN chroma_mean < 0.20 THEN 1.20 WHEN chroma_mean > 0.40 THEN 0.92 ELSE 1.0 END AS am,
    CASE WHEN edge_mean < 0.04 THEN '"amount":0.9,"radius":1.2' WHEN edge_mean < 0.08 THEN '"amount":0.6,"radius":1.1' WHEN edge_mean > 0.18 THEN '"amount":0.25,"radius":0.9' ELSE '"amount":0.5,"radius":1.0' END AS us FROM a3),
  st AS (SELECT asset_id, frame_no, 0 AS o, 'exposure.brightness_contrast' AS effect, '{{"brightness":' || round(br,3) || ',"contrast":' || round(c,2) || '}}' AS params FROM a4 WHERE abs(c-1) > 0.04 OR abs(br) > 0.02
    UNION ALL SELECT asset_id, frame_no, 1, 'exposure.gamma', '{{"gamma":' || round(pw,2) || '}}' FROM a4 WHERE abs(mid-0.5) > 0.04 AND abs(pw-1) > 0.03
    UNION ALL SELECT asset_id, frame_no, 2, 'color.saturation', '{{"amount":' || am || '}}' FROM a4 WHERE abs(am-1) > 0.03
    UNION ALL SELECT asset_id, frame_no, 3, 'sharpen.unsharp_mask', '{{' || us || ',"threshold":0.0}}' FROM a4)"""


@query("rec.auto_chain", f"WITH {PX_EMB}, {STATS}, {_AUTO} SELECT asset_id, frame_no, CAST(row_number() OVER (PARTITION BY asset_id, frame_no ORDER BY o) - 1 AS INTEGER) AS step_no, effect, regexp_replace(params, '([0-9]\\.[0-9]*[1-9])0+([,}}])', '\\1\\2', 'g') AS params FROM st")
def auto_chain(spark, sf):
    return decisions.auto_chain(_stats(spark, sf)).select(*FRAME, "step_no", "effect", "params")


_SCORE = "(edge_mean < 0.06)::INT + (edge_mean < 0.03)::INT + (p99-p01 < 0.5)::INT + (p99-p01 < 0.3)::INT + (chroma_mean < 0.10)::INT + (chroma_mean < 0.05)::INT"
_STRATEGY = f"CASE WHEN {_SCORE} >= 4 THEN 'clarify-aggressive' WHEN {_SCORE} >= 2 THEN 'clarify-standard' ELSE 'auto-enhance' END"


@query("rec.smart_strategy", f"WITH {PX_EMB}, {STATS} SELECT asset_id, frame_no, CAST({_SCORE} AS INTEGER) AS score, {_STRATEGY} AS strategy FROM stats")
def smart(spark, sf):
    return decisions.smart_strategy(_stats(spark, sf)).select(*FRAME, "score", "strategy")


@query("rec.diagnose", f"""WITH {PX_EMB}, {STATS}, {CAST}, pr AS (SELECT *, list_filter([CASE WHEN p99-p01 < 0.30 THEN 'Low dynamic range' WHEN p99-p01 < 0.50 THEN 'Compressed range' END, CASE WHEN p99 < 0.85 THEN 'Highlights underexposed' END,
    CASE WHEN p01 > 0.10 THEN 'Shadows lifted' END, CASE WHEN p50 < 0.30 THEN 'Midtones dark' END, CASE WHEN p50 > 0.70 THEN 'Midtones bright' END, CASE WHEN chroma_mean < 0.05 THEN 'Near-monochrome' WHEN chroma_mean < 0.10 THEN 'Low chroma' END,
    CASE WHEN edge_mean < 0.03 THEN 'Very blurry / soft' WHEN edge_mean < 0.06 THEN 'Some softness' END, CASE WHEN cast_mag > 0.06 THEN 'Color cast detected' END], lambda z: z IS NOT NULL) AS ps FROM tags)
  SELECT asset_id, frame_no, array_to_string(ps, '; ') AS problems, CAST(len(ps) AS INTEGER) AS problem_count, CASE WHEN {_SCORE} >= 4 THEN 'clarify-aggressive' WHEN {_SCORE} >= 2 THEN 'clarify-standard' WHEN p99-p01 < 0.85 OR abs(p50-0.5) > 0.10 OR cast_mag > 0.08 THEN 'auto-enhance' ELSE 'none' END AS recommendation FROM pr""")
def diagnose(spark, sf):
    return decisions.diagnose(_stats(spark, sf))


def _assigned(spark, sf, names):
    pick = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % len(names)).cast("int") + 1)
    return t.read(spark, sf, "part").select("p_partkey", pick.alias("recipe"))


def _chosen(names) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"WITH {TEMPLATES} SELECT p_partkey, recipe, CAST(step_no AS INTEGER) AS step_no, effect, label, params FROM (SELECT p_partkey, ([{listed}])[p_partkey % {len(names)} + 1] AS recipe FROM part) JOIN tpl USING (recipe)"


def _templates(name: str, family: str):
    names = [r for r in decisions.templates() if r.startswith(family + "-")]
    query(name, _chosen(names))(lambda spark, sf: decisions.steps_for(_assigned(spark, sf, names)).select("p_partkey", "recipe", "step_no", "effect", "label", "params"))


_templates("rec.clarify_chain", "clarify")
_templates("rec.style_chain", "style")
_templates("rec.palette_chain", "palette")


# Recipes over corpora


_BC = lambda c: clamp01(f"({c}-0.5)*1.2+0.5+0.05")
_SAT = lambda c: clamp01(f"({LUMA}) + ({c}-({LUMA}))*1.3")
_P = ", ".join("p." + c.strip() for c in KEY.split(","))
_PICK = "CAST(substr(asset_id, 4) AS BIGINT) % 3"


@query("rec.apply_chain", f"""WITH {PX_EMB}, {DIMS}, s0 AS (SELECT {KEY}, a, {rgb(_BC)} FROM px_emb WHERE {_PICK} = 0), r0 AS (SELECT {KEY}, {rgb(_SAT)} FROM s0),
  p1 AS (SELECT * FROM px_emb WHERE {_PICK} = 1), {taps('k', 1.0, 3)}, {conv('p1', 'g1x', 'k', 'x', 'rgb')}, {conv('g1x', 'g1', 'k', 'y', 'rgb')}, {conv('g1', 'g2x', 'k', 'x', 'rgb')}, {conv('g2x', 'g2', 'k', 'y', 'rgb')},
  r1 AS (SELECT {_P}, {", ".join(f"{clamp01(f'p.{c} + 0.6*CASE WHEN abs(p.{c}-s.{c}) < 0.01 THEN 0.0 ELSE p.{c}-s.{c} END')} AS {c}" for c in "rgb")} FROM g1 p JOIN g2 s USING ({KEY})),
  r2 AS (SELECT {KEY}, {LUMA} AS r, {LUMA} AS g, {LUMA} AS b FROM px_emb WHERE {_PICK} = 2)
  SELECT {KEY}, {", ".join(f"round({c}, 9) AS {c}" for c in "rgb")} FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2)""")
def apply_chain(spark, sf):
    px = t.px_emb(spark, sf)
    recipe = (F.substring("asset_id", 4, 9).cast("bigint") % 3).cast("string").alias("recipe_id")
    assigned = px.select("asset_id").distinct().select("asset_id", recipe)
    return pixels(chain.apply_recipes(px, assigned, {str(k): v for k, v in t.RECIPES.items()}), RGB)


SNAPSHOT_STEPS = [
    ("exposure.brightness_contrast", None, {"brightness": 0.05, "contrast": 1.2}), ("color.saturation", None, {"amount": 1.3}),
    ("geometric.rotate_ortho", None, {"turns": 0}), ("modalities.channel_isolate", None, {"channel": "g"}),
]


@query("sink.stage_snapshots", f"""WITH {PX_EMB}, s1 AS (SELECT {KEY}, {rgb(_BC)} FROM px_emb), s2 AS (SELECT {KEY}, {rgb(_SAT)} FROM s1), s4 AS (SELECT {KEY}, {clamp01('g')} AS r, {clamp01('g')} AS g, {clamp01('g')} AS b FROM s2)
  SELECT stage_no, stage_label, {KEY}, round(r,9) AS r, round(g,9) AS g, round(b,9) AS b FROM (SELECT 0 AS stage_no, '00-input' AS stage_label, {KEY}, r, g, b FROM px_emb UNION ALL SELECT 1, '01-brightness_contrast', * FROM s1 UNION ALL SELECT 2, '02-saturation', * FROM s2 UNION ALL SELECT 3, '03-rotate_ortho', * FROM s2 UNION ALL SELECT 4, '04-channel_isolate', * FROM s4)""")
def stage_snapshots(spark, sf):
    done = chain.stage_snapshots(t.px_emb(spark, sf), SNAPSHOT_STEPS)
    return done.select("stage_no", "stage_label", *PIXEL, *[r9(c) for c in RGB])


@query("sink.partitioned_render", f"WITH {PX_EMB} SELECT {KEY}, {', '.join(f'round({_BC(c)}, 9) AS {c}' for c in 'rgb')} FROM px_emb")
def partitioned_render(spark, sf):
    path = staging_path(spark, "render")
    renders.write_render(chain.apply_chain(t.px_emb(spark, sf), SNAPSHOT_STEPS[:1]), path)
    return pixels(renders.read_render(spark, path), RGB)


@query("sink.replaced_frames", f"WITH {PX_EMB} SELECT {KEY}, {', '.join(f'round(CASE WHEN frame_no % 3 = 0 THEN {_BC(c)} ELSE {c} END, 9) AS {c}' for c in 'rgb')} FROM px_emb")
def replaced_frames(spark, sf):
    path, px = staging_path(spark, "render"), t.px_emb(spark, sf)
    renders.write_render(px, path)
    renders.replace_frames(chain.apply_chain(px.where("frame_no % 3 = 0"), SNAPSHOT_STEPS[:1]), path)
    return pixels(renders.read_render(spark, path), RGB)


GOLDEN_STEPS = [("exposure.brightness_contrast", None, {"brightness": 0.02, "contrast": 1.0})]


def _golden(spark, sf):
    px = t.px_emb(spark, sf)
    worse = F.when(F.col("frame_no") % 2 == 0, 0.01).otherwise(0.2)
    golden = px.where("frame_no <> 3").withColumns({c: F.least(F.col(c) + worse, F.lit(1.0)) for c in RGB})
    cases = px.select(*FRAME).distinct().select(
        F.concat(F.lit("case"), F.col("frame_no").cast("string")).alias("name"), *FRAME,
        F.when(F.col("frame_no") == 4, 0.99999).alias("ssim_min"), F.lit(None).cast("double").alias("psnr_min"))
    return chain.golden_run(px, golden, cases, GOLDEN_STEPS)


_GOLDEN = f"""{PX_EMB}, pair AS (SELECT asset_id, frame_no, y, x, {rgb(lambda c: clamp01(f"({c}-0.5)*1.0+0.5+0.02"))}, {", ".join(f"least({c} + CASE WHEN frame_no % 2 = 0 THEN 0.01 ELSE 0.2 END, 1.0) AS {c}2" for c in "rgb")} FROM px_emb WHERE frame_no <> 3),
  {ssim_sql()}, e AS (SELECT asset_id, frame_no, sum(se)/(3.0*count(*)) AS mse FROM pl GROUP BY ALL),
  j AS (SELECT 'case' || frame_no AS name, ssim, -10*log10(mse) AS psnr, CASE WHEN frame_no = 4 THEN 0.99999 ELSE 0.99 END AS smin FROM (SELECT DISTINCT asset_id, frame_no FROM px_emb) LEFT JOIN sm USING (asset_id, frame_no) LEFT JOIN e USING (asset_id, frame_no)),
  res AS (SELECT name, round(coalesce(ssim, 'nan'::DOUBLE), 9) AS ssim, round(coalesce(psnr, 'nan'::DOUBLE), 9) AS psnr, ssim IS NOT NULL AND ssim >= smin AND psnr >= 35 AS passed,
    CASE WHEN ssim IS NULL THEN 'dims differ or no golden' WHEN ssim >= smin AND psnr >= 35 THEN 'ok' WHEN ssim < smin THEN 'ssim below threshold' ELSE 'psnr below threshold' END AS message FROM j)"""


@query("qa.golden_run", f"WITH {_GOLDEN} SELECT * FROM res")
def golden_run(spark, sf):
    return _golden(spark, sf).select("name", r9("ssim"), r9("psnr"), "passed", "message")


@query("agg.qa_summary", f"WITH {_GOLDEN} SELECT count(*) FILTER (passed) AS passed, count(*) AS total FROM res")
def qa_summary(spark, sf):
    return metrics.qa_summary(_golden(spark, sf))


@query("qa.golden_refresh", f"WITH {PX_EMB} SELECT {KEY}, {', '.join(f'round({_BC(c)}, 9) AS {c}' for c in 'rgb')} FROM px_emb")
def golden_refresh(spark, sf):
    path = staging_path(spark, "golden")
    px = t.px_emb(spark, sf)
    chain.golden_refresh(px, [], path)
    chain.golden_refresh(px, SNAPSHOT_STEPS[:1], path)
    return pixels(renders.read_render(spark, path), RGB)


# User functions


@query("ml.batch_predict", f"WITH {PX_U8} SELECT asset_id, frame_no, CAST(ch*1100 + y*22 + x AS INTEGER) AS i, round(CAST(CAST(1 AS FLOAT) - CAST(v/255.0 AS FLOAT) AS DOUBLE), 6) AS v FROM px_u8, LATERAL (SELECT unnest([0,1,2]) AS ch, unnest([r,g,b]) AS v) u")
def batch_predict(spark, sf):
    tensors = layout.frame_to_chw(t.px_emb_u8(spark, sf), 255.0)
    done = udfs.batch_predict(tensors, udfs.invert_model, (3, t.FRAME_ROWS, t.FRAME_COLS))
    cells = done.select(*FRAME, "height", "width", F.posexplode("tensor").alias("i", "v"))
    own = (F.floor(F.col("i") / t.FRAME_COLS) % t.FRAME_ROWS < F.col("height")) & (F.col("i") % t.FRAME_COLS < F.col("width"))
    return cells.where(own).select(*FRAME, "i", F.round(F.col("v").cast("double"), 6).alias("v"))


def _posterize(pdf: pd.DataFrame, levels: int) -> pd.DataFrame:
    out = pdf.copy()
    for c in RGB:
        out[c] = (pdf[c] * levels + 0.5).floordiv(1) / levels
    return out


@query("udf.register_effect", f"WITH {PX_EMB} SELECT {KEY}, {', '.join(f'floor({c}*5 + 0.5)/5 AS {c}' for c in 'rgb')} FROM px_emb")
def register_effect(spark, sf):
    reg = catalogue.Registry()
    reg.register(catalogue.per_pixel("user.posterize", _posterize, (catalogue.Param("levels", "int", 4, 2, 64),)))
    return chain.apply_chain(t.px_emb(spark, sf), [("user.posterize", None, {"levels": 5})], reg).drop("a")


@query("udaf.metric", f"WITH {PX_PAIR} SELECT asset_id, frame_no, round(sum({_SE})/(3.0*count(*)), 12) AS mse FROM pair GROUP BY ALL")
def udaf_metric(spark, sf):
    return udfs.metric_udaf(*pair(spark, sf)).select(*FRAME, r9("mse", 12))


# Streams


def _signal(spark, sf):
    ev = jobs.file_stream(spark, sf, "events.parquet", t.read(spark, sf, "events"))
    return ev.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("asset_id"), (F.col("value") / 500.0 * 2 - 1).alias("v"))


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


_SIG = "sig AS (SELECT ts, event_type AS asset_id, value/500.0*2 - 1 AS v FROM events), wm AS (SELECT max(ts) - INTERVAL 2 HOUR AS w FROM events)"
_FMT = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


@query("stream.sliding_energy", f"""WITH {_SIG}, e AS (SELECT asset_id, v, time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS s FROM sig, (SELECT unnest(range(4)) AS k))
  SELECT asset_id, {_FMT.format('s')} AS start, {_FMT.format('s + INTERVAL 4 HOUR')} AS "end", round(avg(v*v), 9) AS energy, count(*) AS n FROM e WHERE s + INTERVAL 4 HOUR <= (SELECT w FROM wm) GROUP BY asset_id, s""")
def sliding_energy(spark, sf):
    done = jobs.drain(jobs.sliding_energy(_signal(spark, sf), "4 hours", "1 hour", "2 hours"), "sliding")
    return done.select("asset_id", _stamp("start"), _stamp("end"), r9("energy"), "n")


@query("stream.tumbling_stats", f"""WITH {_SIG} SELECT asset_id, {_FMT.format("time_bucket(INTERVAL 6 HOUR, ts)")} AS start, count(*) AS n, round(avg(v), 9) AS mean, round(min(v), 9) AS low, round(max(v), 9) AS high FROM sig
  WHERE time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= (SELECT w FROM wm) GROUP BY asset_id, time_bucket(INTERVAL 6 HOUR, ts)""")
def tumbling(spark, sf):
    done = jobs.drain(jobs.tumbling_stats(_signal(spark, sf), "6 hours", "2 hours"), "tumbling")
    return done.select("asset_id", _stamp("start"), "n", r9("mean"), r9("low"), r9("high"))


@query("stream.session_review", f"""WITH {_SIG}, e AS (SELECT 'op' || (event_id % 7) AS op, ts FROM events), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY op ORDER BY ts) <= INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS fresh FROM e), s AS (SELECT *, sum(fresh) OVER (PARTITION BY op ORDER BY ts) AS sid FROM g),
  z AS (SELECT op, sid, min(ts) AS s0, max(ts) + INTERVAL 20 MINUTE AS e0, count(*) AS n FROM s GROUP BY op, sid) SELECT op AS operator_key, {_FMT.format('s0')} AS start, {_FMT.format('e0')} AS "end", n AS entries FROM z WHERE e0 <= (SELECT w FROM wm)""")
def session_review(spark, sf):
    ev = jobs.file_stream(spark, sf, "events.parquet", t.read(spark, sf, "events"))
    entries = ev.select(F.col("ts").cast("timestamp").alias("at"), F.concat(F.lit("op"), (F.col("event_id") % 7).cast("string")).alias("operator_key"))
    return jobs.drain(jobs.session_review(entries, "20 minutes", "2 hours"), "sessions").select("operator_key", _stamp("start"), _stamp("end"), "entries")


@query("stream.dedup_hash", "SELECT DISTINCT 'sha256:' || sha256(printf('%.2f', value)) AS hash FROM events")
def dedup_hash(spark, sf):
    ev = jobs.file_stream(spark, sf, "events.parquet", t.read(spark, sf, "events"))
    blobs = ev.select(F.col("ts").cast("timestamp").alias("at"), provenance.content_hash(F.format_string("%.2f", "value")).alias("hash"))
    return jobs.drain(jobs.dedup_hash(blobs, "60 days"), "dedup").select("hash")


@query("stream.chain_tail", f"""WITH RECURSIVE {AUDIT_BAD}, {checked('bad')} SELECT case_id, seq, coalesce(fault, '') AS reason, max(CASE WHEN fault IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY seq) = 0 AS ok FROM checked""")
def chain_tail(spark, sf):
    log = t.case_ev_bad(spark, sf)
    folder = staging_path(spark, "audit-log")
    log.write.parquet(folder)
    stored = spark.read.parquet(folder)
    stream = jobs.file_stream(spark, folder, "*.parquet", stored)
    return jobs.drain(jobs.chain_tail(stream, t.AUDIT_KEY), "tail")


@query("stream.ingest", "SELECT event_id, 'sha256:' || sha256(CAST(event_id AS VARCHAR)) AS hash FROM events")
def ingest(spark, sf):
    ev = jobs.file_stream(spark, sf, "events.parquet", t.read(spark, sf, "events"))
    out = staging_path(spark, "inventory")
    listed = lambda df: df.select("event_id", provenance.content_hash(F.col("event_id").cast("string")).alias("hash"))
    jobs.ingest(ev, f"{out}/data", f"{out}/progress", listed).awaitTermination()
    return spark.read.parquet(f"{out}/data").select("event_id", "hash")

