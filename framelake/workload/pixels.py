"""Pointwise, layout and join queries over pixel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake import tables as t
from framelake.operators import layout, metrics, pointwise, resample
from framelake.schemas import FRAME, PIXEL, RGB
from framelake.sources import tables as src
from framelake.workload.registry import pixels, query, r9
from framelake.workload.sql import DIMS, KEY, LUMA, PX_EMB, PX_LI, PX_PAIR, PX_U8, clamp01, rgb, rounded


def _point(body: str, cols: str = "rgba", source: str = PX_EMB, table: str = "px_emb", digits: int = 9) -> str:
    return f"WITH {source}, o AS (SELECT {KEY}, {body} FROM {table}) SELECT {KEY}, {rounded(cols, digits)} FROM o"


_LIFT = lambda c: f"CASE WHEN {c}/255.0 <= 0.04045 THEN {c}/255.0/12.92 ELSE pow(({c}/255.0+0.055)/1.055, 2.4) END"


@query("px.lift_linear", _point(f"{rgb(_LIFT)}, a/255.0 AS a", source=PX_U8, table="px_u8"))
def lift(spark, sf):
    return pixels(pointwise.lift_linear(t.px_emb_u8(spark, sf)))


_ENC = lambda c: f"CAST(floor({clamp01(f'CASE WHEN {c} <= 0.0031308 THEN {c}*12.92 ELSE 1.055*pow({c}, 1.0/2.4) - 0.055 END')}*255.0 + 0.5) AS INTEGER)"


@query("px.encode_u8", f"WITH {PX_EMB} SELECT {KEY}, {rgb(_ENC)}, CAST(floor(a*255.0+0.5) AS INTEGER) AS a FROM px_emb")
def encode(spark, sf):
    return pointwise.encode_u8(t.px_emb(spark, sf))


@query("px.brightness_contrast", _point(rgb(lambda c: clamp01(f"({c}-0.5)*1.3+0.5+0.1")) + ", a", source=PX_LI, table="px_li", digits=12))
def brightness_contrast(spark, sf):
    return pixels(pointwise.brightness_contrast(t.px_li(spark, sf), 0.1, 1.3), digits=12)


@query("px.gamma", _point(rgb(lambda c: clamp01(f"pow(greatest({c},0.0), 1.0/1.8)")) + ", a"))
def gamma(spark, sf):
    return pixels(pointwise.gamma(t.px_emb(spark, sf), 1.8))


@query("px.saturation", _point(rgb(lambda c: clamp01(f"({LUMA}) + ({c} - ({LUMA}))*1.4")) + ", a"))
def saturation(spark, sf):
    return pixels(pointwise.saturation(t.px_emb(spark, sf), 1.4))


_WHEELS = {"r": (0.02, 1.1, 1.2), "g": (-0.01, 0.9, 1.0), "b": (0.0, 1.3, 0.8)}


@query("px.primary_wheels", _point(rgb(lambda c: clamp01("pow(greatest({0}*{3}+({1}),0.0), 1.0/{2})".format(c, *_WHEELS[c]))) + ", a"))
def primary_wheels(spark, sf):
    lift_, gamma_, gain_ = zip(*[_WHEELS[c] for c in RGB])
    return pixels(pointwise.primary_wheels(t.px_emb(spark, sf), lift_, gamma_, gain_))


def _segments(table: str, c: str) -> str:
    """Piecewise-linear value by finding the segment that holds the input."""
    return f"""CASE WHEN {c} <= (SELECT min(x0) FROM {table}) THEN (SELECT arg_min(y0, x0) FROM {table}) WHEN {c} >= (SELECT max(x1) FROM {table}) THEN (SELECT arg_max(y1, x1) FROM {table})
      ELSE (SELECT y0 + ({c}-x0)/(x1-x0)*(y1-y0) FROM {table} WHERE {c} >= x0 AND {c} < x1) END"""


_CURVE = "seg(x0,y0,x1,y1) AS (VALUES (0.2,0.1,0.5,0.6),(0.5,0.6,0.8,0.9))"
_TONE = "tone(x0,y0,x1,y1) AS (VALUES (0.0,0.0,0.4,0.5),(0.4,0.5,1.0,1.0))"


@query("px.curves", f"""WITH {PX_EMB}, {_CURVE}, {_TONE}, c1 AS (SELECT {KEY}, a, {clamp01(_segments('seg', 'r'))} AS r, {clamp01('g')} AS g, {clamp01('b')} AS b FROM px_emb),
  c2 AS (SELECT *, {LUMA} AS lum FROM c1), c3 AS (SELECT *, ({_segments('tone', 'lum')})/greatest(lum, 1e-6) AS s FROM c2)
  SELECT {KEY}, {", ".join(f"round({clamp01(f'{c}*s')}, 9) AS {c}" for c in "rgb")}, a FROM c3""")
def curves(spark, sf):
    return pixels(pointwise.curves(t.px_emb(spark, sf), points_r="0.2:0.1,0.5:0.6,0.8:0.9", points_luma="0:0,0.4:0.5,1:1"))


_DUO = {"r": (0.04, 0.95), "g": (0.07, 0.78), "b": (0.18, 0.42)}


@query("px.duotone", _point(rgb(lambda c: clamp01("{0}*(1.0-0.85) + ({1} + ({2}-{1})*({3}))*0.85".format(c, *_DUO[c], LUMA))) + ", a"))
def duotone(spark, sf):
    return pixels(pointwise.duotone(t.px_emb(spark, sf)))


@query("px.channel_isolate", _point(rgb(lambda c: clamp01(f"1.0 - ({LUMA})")) + ", a"))
def channel_isolate(spark, sf):
    return pixels(pointwise.channel_isolate(t.px_emb(spark, sf), "luma", True))


@query("px.invert", _point(rgb(lambda c: f"(1.0-{c})*0.7 + {c}*(1.0-0.7)") + ", a"))
def invert(spark, sf):
    return pixels(pointwise.invert(t.px_emb(spark, sf), 0.7))


_DIST = "least(x+0.5-3, 3+10-(x+0.5), y+0.5-5, 5+20-(y+0.5))"


@query("px.alpha_rect", _point(f"r, g, b, {clamp01(f'a*(0.2 + (0.9-0.2)*{clamp01(f'({_DIST}+2.5)/5.0')})')} AS a"))
def alpha_rect(spark, sf):
    return pixels(pointwise.alpha_rect(t.px_emb(spark, sf), 3, 5, 10, 20, 0.9, 0.2, 2.5))


@query("px.alpha_polygon", f"""WITH {PX_EMB}, seg(sax,say,sbx,sby) AS (VALUES (6.0,40.0,2.0,4.0),(2.0,4.0,18.0,8.0),(18.0,8.0,12.0,22.0),(12.0,22.0,19.0,45.0),(19.0,45.0,6.0,40.0)),
  j AS (SELECT {KEY}, a, x+0.5 AS cx, y+0.5 AS cy, sax, say, sbx, sby, least(greatest(((x+0.5-sax)*(sbx-sax)+(y+0.5-say)*(sby-say))/((sbx-sax)*(sbx-sax)+(sby-say)*(sby-say)),0.0),1.0) AS tt FROM px_emb CROSS JOIN seg),
  m AS (SELECT {KEY}, a, sum(CASE WHEN (sby > cy) <> (say > cy) AND cx < sbx + (cy-sby)*(sax-sbx)/(say-sby) THEN 1 ELSE 0 END) % 2 = 1 AS inside,
    min(sqrt((cx-(sax+tt*(sbx-sax)))*(cx-(sax+tt*(sbx-sax))) + (cy-(say+tt*(sby-say)))*(cy-(say+tt*(sby-say))))) AS dist FROM j GROUP BY ALL)
  SELECT {KEY}, round({clamp01(f"a*(0.1 + (1.0-0.1)*{clamp01('((CASE WHEN inside THEN dist ELSE -dist END)+2.0)/4.0')})")}, 9) AS a FROM m""")
def alpha_polygon(spark, sf):
    return pixels(pointwise.alpha_polygon(t.px_emb(spark, sf), "2,4; 18,8; 12,22; 19,45; 6,40", 1.0, 0.1, 2.0), ["a"])


@query("px.crop", f"WITH {PX_EMB} SELECT asset_id, frame_no, y-10 AS y, x-4 AS x, r, g, b FROM px_emb WHERE x >= 4 AND x < 16 AND y >= 10 AND y < 40")
def crop(spark, sf):
    return pointwise.crop(t.px_emb(spark, sf), 4, 10, 12, 30, t.px_emb_frames(spark, sf)).drop("a")


@query("px.crop_errors", f"WITH {PX_LI} SELECT asset_id, frame_no, 'INVALID_PARAMETER' AS code, 'crop 12x30+4+10 exceeds 11x50' AS reason FROM px_li GROUP BY asset_id, frame_no")
def crop_errors(spark, sf):
    return pointwise.crop_errors(pointwise.frame_dims(t.px_li(spark, sf)), 4, 10, 12, 30)


@query("px.rotate_ortho", f"WITH {PX_EMB}, {DIMS} SELECT asset_id, frame_no, x AS y, CAST(h-1-y AS INTEGER) AS x, r, g, b FROM px_emb JOIN dims USING (asset_id, frame_no)")
def rotate(spark, sf):
    return pointwise.rotate_ortho(t.px_emb(spark, sf), 1).drop("a")


_SPACE = "CASE s_suppkey % 5 WHEN 0 THEN 'srgb' WHEN 1 THEN 'aces_cg' WHEN 2 THEN 'rec2020_pq' WHEN 3 THEN 's_log3' ELSE 'vendor-x' END"


@query("px.color_space_info", f"""WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS asset_id, {_SPACE} AS color_space FROM supplier)
  SELECT asset_id, color_space, color_space = 'aces_cg' AS is_linear, CAST(CASE color_space WHEN 'srgb' THEN 100 WHEN 'rec2020_pq' THEN 10000 END AS DOUBLE) AS nominal_nits FROM s""")
def color_space(spark, sf):
    s = t.read(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("asset_id"), F.expr(_SPACE).alias("color_space"))
    return pointwise.color_space_info(s)


_PTS = "SELECT o_orderkey, o_orderkey * 1001 AS v, 1 + o_custkey % 3 AS tn, 30000 + o_orderkey % 7 AS td, 24000 AS fn, 1001 AS fd FROM orders"


def _pts(spark, sf):
    o = t.read(spark, sf, "orders")
    return o.select("o_orderkey", (F.col("o_orderkey") * 1001).alias("v"), (1 + F.col("o_custkey") % 3).alias("tn"), (30000 + F.col("o_orderkey") % 7).alias("td"), F.lit(24000).cast("bigint").alias("fn"), F.lit(1001).cast("bigint").alias("fd"))


@query("time.pts_seconds", f"SELECT o_orderkey, round(CAST(v AS DOUBLE)*tn/td, 6) AS seconds FROM ({_PTS})")
def pts_seconds(spark, sf):
    return _pts(spark, sf).select("o_orderkey", r9(pointwise.pts_seconds(F.col("v"), F.col("tn"), F.col("td")), 6).alias("seconds"))


@query("time.frame_index", f"SELECT o_orderkey, CAST((CAST(v AS HUGEINT)*tn*fn) // (CAST(td AS HUGEINT)*fd) AS BIGINT) AS frame_index FROM ({_PTS})")
def frame_index(spark, sf):
    return _pts(spark, sf).select("o_orderkey", pointwise.frame_index(*[F.col(c) for c in ("v", "tn", "td", "fn", "fd")]).cast("bigint").alias("frame_index"))


@query("time.rational_normalize", """WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey - 1000 AS num, (l_suppkey - 50) * 6 AS den FROM lineitem)
  SELECT num, den, count(*) AS n, CASE WHEN den = 0 THEN 0 ELSE CAST(num*sign(den) AS BIGINT) // greatest(gcd(num, den), 1) END AS norm_num,
    CASE WHEN den = 0 THEN 1 ELSE abs(den) // greatest(gcd(num, den), 1) END AS norm_den FROM q GROUP BY num, den""")
def rational(spark, sf):
    q = t.read(spark, sf, "lineitem").select((F.col("l_partkey") - 1000).alias("num"), ((F.col("l_suppkey") - 50) * 6).alias("den"))
    return pointwise.rational_normalize(q).groupBy("num", "den", "norm_num", "norm_den").agg(F.count(F.lit(1)).alias("n"))


# Layout


@query("layout.to_pixels", """SELECT 'e' || vec_id AS asset_id, 0 AS frame_no, CAST(i // 4 AS INTEGER) AS y, CAST(i % 4 AS INTEGER) AS x,
  CAST(embedding[4*i+1] AS DOUBLE) AS r, CAST(embedding[4*i+2] AS DOUBLE) AS g, CAST(embedding[4*i+3] AS DOUBLE) AS b, CAST(embedding[4*i+4] AS DOUBLE) AS a
  FROM embeddings, (SELECT unnest(range(16)) AS i)""")
def to_pixels(spark, sf):
    return layout.to_pixels(_packed(spark, sf))


def _packed(spark, sf):
    """Each vector read as a packed 4x4 RGBA buffer."""
    return t.read(spark, sf, "embeddings").select(
        F.concat(F.lit("e"), F.col("vec_id").cast("string")).alias("asset_id"), F.lit(0).alias("frame_no"), F.lit(4).alias("width"),
        F.lit(4).alias("height"), F.transform("embedding", lambda v: v.cast("double")).alias("data"))


@query("layout.to_scanline", f"""WITH {PX_LI}, l AS (SELECT asset_id, frame_no, x AS idx, list(r ORDER BY y) AS rr, list(g ORDER BY y) AS gg FROM px_li GROUP BY ALL)
  SELECT asset_id, frame_no, 'column' AS axis, idx, len(rr) AS n, round(rr[1],9) AS r_first, round(rr[50],9) AS r_last, round(gg[17],9) AS g_16 FROM l""")
def to_scanline(spark, sf):
    lines = layout.to_scanlines(t.px_li(spark, sf), "column")
    return lines.select(*FRAME, "axis", "idx", F.size("r").cast("bigint").alias("n"), F.round(F.get("r", 0), 9).alias("r_first"), F.round(F.get("r", 49), 9).alias("r_last"), F.round(F.get("g", 16), 9).alias("g_16"))


@query("layout.from_scanline", f"WITH {PX_LI} SELECT {KEY}, {rounded()} FROM px_li")
def from_scanline(spark, sf):
    return pixels(layout.from_scanlines(layout.to_scanlines(t.px_li(spark, sf), "row")))


@query("layout.densify", f"WITH {PX_LI} SELECT {KEY}, {rounded('rgb')} FROM px_li")
def densify(spark, sf):
    sparse = t.px_li(spark, sf).where("r > 0")
    frames = t.read(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("asset_id"), F.lit(0).alias("frame_no"), F.lit(11).alias("width"), F.lit(50).alias("height"))
    return pixels(layout.densify(sparse, frames), RGB)


_FRAMES = "SELECT CAST(conv_id AS VARCHAR) AS asset_id, CAST(turn AS INTEGER) AS frame_no, CAST(640 + 16*(length(text) % 2) AS INTEGER) AS width, 480 AS height FROM conversations"


def conv_frames(spark, sf):
    return t.read(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("asset_id"), F.col("turn").cast("int").alias("frame_no"),
        (640 + 16 * (F.length("text") % 2)).cast("int").alias("width"), F.lit(480).alias("height"))


@query("layout.dims_check", f"""WITH f AS ({_FRAMES}), k AS (SELECT *, first_value(width) OVER (PARTITION BY asset_id ORDER BY frame_no) AS w0 FROM f)
  SELECT asset_id, frame_no, 'LAYOUT' AS code, 'frame is ' || width || 'x480, expected ' || w0 || 'x480' AS reason FROM k WHERE width <> w0""")
def dims_check(spark, sf):
    return layout.dims_check(conv_frames(spark, sf))


@query("src.frame_extract", """SELECT CAST(user_id AS VARCHAR) AS asset_id, CAST(event_id AS INTEGER) AS frame_no, 'f_' || lpad(CAST(event_id AS VARCHAR), 6, '0') || '.jpg' AS output_name
  FROM events WHERE event_id >= 100 AND event_id < 9000 AND (event_id - 100) % 7 = 0""")
def frame_extract(spark, sf):
    frames = t.read(spark, sf, "events").select(F.col("user_id").cast("string").alias("asset_id"), F.col("event_id").cast("int").alias("frame_no"))
    return src.frame_extract(frames, 100, 9000, 7, "f_", "jpeg")


@query("src.asset_probe", f"""WITH {PX_EMB} SELECT asset_id, CAST(max(x)+1 AS INTEGER) AS width, CAST(max(y)+1 AS INTEGER) AS height, count(DISTINCT frame_no) AS stored_frames,
  CAST(round(12.34*30000/1001) AS BIGINT) AS frame_count FROM px_emb GROUP BY asset_id""")
def asset_probe(spark, sf):
    px = t.px_emb(spark, sf)
    rates = px.select("asset_id").distinct().select("asset_id", F.lit(None).cast("bigint").alias("frame_count"), F.lit(12.34).alias("duration_secs"), F.lit(30000).alias("fps_num"), F.lit(1001).alias("fps_den"))
    return layout.asset_probe(px, rates).select("asset_id", "width", "height", "stored_frames", "frame_count")


@query("ml.frame_to_chw", f"""WITH {PX_U8}, c AS (SELECT frame_no, asset_id, u.ch, y, x, CAST(u.v/255.0 AS FLOAT) AS v FROM px_u8,
    LATERAL (SELECT unnest([0,1,2]) AS ch, unnest([r,g,b]) AS v) u),
  l AS (SELECT asset_id, frame_no, list(v ORDER BY ch, y, x) AS tensor FROM c GROUP BY ALL)
  SELECT asset_id, frame_no, CAST(i-1 AS INTEGER) AS i, round(CAST(tensor[i] AS DOUBLE), 6) AS v FROM l, LATERAL (SELECT unnest(range(1, len(tensor)+1)) AS i)""")
def frame_to_chw(spark, sf):
    done = layout.frame_to_chw(t.px_emb_u8(spark, sf), 255.0)
    return done.select(*FRAME, F.posexplode("tensor").alias("i", "v")).select(*FRAME, "i", F.round(F.col("v").cast("double"), 6).alias("v"))


@query("ml.chw_to_frame", f"WITH {PX_EMB} SELECT {KEY}, {', '.join(f'round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 6) AS {c}' for c in 'rgb')}, a FROM px_emb")
def chw_to_frame(spark, sf):
    px = t.px_emb(spark, sf)
    return pixels(layout.chw_to_frame(layout.frame_to_chw(px), px), digits=6)


# Joins


def pair(spark, sf):
    px = t.px_emb(spark, sf)
    return px, px.withColumn("frame_no", F.col("frame_no") - 1)


@query("join.frame_pair", f"WITH {PX_PAIR} SELECT * FROM pair")
def frame_pair(spark, sf):
    return metrics.frame_pair(*pair(spark, sf)).drop("a")


def lut_warm(spark, sf, n: int):
    """A warming lattice of n points, over the lattice positions the pixel table spans."""
    axis = lambda c: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c)
    grid = spark.range(1).select(axis("ri")).select("ri", axis("gi")).select("ri", "gi", axis("bi"))
    top = n - 1
    return grid.select("ri", "gi", "bi", F.pow(F.col("ri") / top, F.lit(0.9)).alias("r"), (F.col("gi") / top).alias("g"), (F.col("bi") / top * 0.9).alias("b"))


_CORNERS = " + ".join(
    f"(CASE WHEN {i & 1} = 1 THEN fr ELSE 1-fr END)*(CASE WHEN {i >> 1 & 1} = 1 THEN fg ELSE 1-fg END)*(CASE WHEN {i >> 2 & 1} = 1 THEN fb ELSE 1-fb END)*k{i}.{{c}}" for i in range(8)
)
_LUT_JOINS = " ".join(f"JOIN lut k{i} ON k{i}.ri = least(r0+{i & 1},4) AND k{i}.gi = least(g0+{i >> 1 & 1},4) AND k{i}.bi = least(b0+{i >> 2 & 1},4)" for i in range(8))


@query("join.lut_trilinear", f"""WITH {PX_EMB}, ax AS (SELECT unnest(range(5)) AS i), lut AS (SELECT a1.i AS ri, a2.i AS gi, a3.i AS bi, pow(a1.i/4.0, 0.9) AS r, a2.i/4.0 AS g, a3.i/4.0*0.9 AS b FROM ax a1 CROSS JOIN ax a2 CROSS JOIN ax a3),
  p AS (SELECT *, floor(r*4) AS r0, floor(g*4) AS g0, floor(b*4) AS b0, r*4-floor(r*4) AS fr, g*4-floor(g*4) AS fg, b*4-floor(b*4) AS fb FROM px_emb)
  SELECT {", ".join("p." + c.strip() for c in KEY.split(","))}, {", ".join(f"round(p.{c}*(1-0.75) + ({_CORNERS.format(c=c)})*0.75, 9) AS {c}" for c in "rgb")} FROM p {_LUT_JOINS}""")
def lut_trilinear(spark, sf):
    return pixels(resample.lut_trilinear(t.px_emb(spark, sf), lut_warm(spark, sf, 5), 5, 0.75), RGB)


@query("join.segment_range", f"""WITH {PX_LI}, seg(k, x0, x1, y0, y1) AS (VALUES (0,0.0,0.25,0.0,0.1),(1,0.25,0.5,0.1,0.5),(2,0.5,1.0,0.5,1.0))
  SELECT {KEY}, round(b, 9) AS b, coalesce(round(y0 + (b-x0)/(x1-x0)*(y1-y0), 9), 1.0) AS v FROM px_li LEFT JOIN seg ON b >= x0 AND b < x1""")
def segment_range(spark, sf):
    px = t.px_li(spark, sf)
    return px.select(*PIXEL, r9("b"), r9(pointwise.curve_value(F.col("b"), [(0.0, 0.0), (0.25, 0.1), (0.5, 0.5), (1.0, 1.0)])).alias("v"))
