"""Neighborhood, resampling and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake import tables as t
from framelake.functions.color import luma
from framelake.functions.ordering import top_share
from framelake.operators import metrics, pointwise, resample, spectral, stencil
from framelake.schemas import FRAME, PIXEL, RGB
from framelake.workload.pixels import pair
from framelake.workload.registry import pixels, query, r9
from framelake.workload.sql import DIMS, KEY, LUMA, MIXED, MOTION, PX_EMB, PX_LI, PX_SAME, clamp01, conv, rounded, taps

BASE = f"{PX_EMB}, {DIMS}"


def _gauss(sigma: float, half: int, out: str = "soft", cols: str = "rgba", tag: str = "k") -> str:
    return f"{taps(tag, sigma, half)}, {conv('px_emb', out + '_x', tag, 'x', cols)}, {conv(out + '_x', out, tag, 'y', cols)}"


@query("st.gaussian", f"WITH {BASE}, {_gauss(1.0, 3)} SELECT {KEY}, {rounded()} FROM soft")
def gaussian(spark, sf):
    return pixels(stencil.gaussian(t.px_emb(spark, sf), 1.0))


@query("st.gaussian_wide", f"WITH {BASE}, {_gauss(4.0, 12)} SELECT {KEY}, {rounded()} FROM soft")
def gaussian_wide(spark, sf):
    return pixels(stencil.gaussian(t.px_emb(spark, sf), 4.0))


@query("st.unsharp_mask", f"""WITH {BASE}, {_gauss(1.0, 3, cols='rgb')}
  SELECT {KEY}, {", ".join(f"round({clamp01(f'p.{c} + 0.8*CASE WHEN abs(p.{c}-s.{c}) < 0.02 THEN 0.0 ELSE p.{c}-s.{c} END')}, 9) AS {c}" for c in "rgb")} FROM px_emb p JOIN soft s USING ({KEY})""")
def unsharp(spark, sf):
    return pixels(stencil.unsharp_mask(t.px_emb(spark, sf), 0.8, 1.0, 0.02), RGB)


@query("st.laplacian_dog", f"""WITH {BASE}, {_gauss(1.0, 3, 'inner_', 'rgb', 'k1')}, {_gauss(1.6, 5, 'outer_', 'rgb', 'k2')}
  SELECT {KEY}, {", ".join(f"round({clamp01(f'p.{c} + i.{c} - o.{c}')}, 9) AS {c}" for c in "rgb")} FROM px_emb p JOIN inner_ i USING ({KEY}) JOIN outer_ o USING ({KEY})""")
def dog(spark, sf):
    return pixels(stencil.laplacian_dog(t.px_emb(spark, sf)), RGB)


def _around(radius: int, cols: str) -> str:
    """Every pixel with its clamped square neighborhood."""
    return f"""o AS (SELECT a1.i AS dy, a2.i AS dx FROM (SELECT unnest(range(-{radius},{radius}+1)) AS i) a1 CROSS JOIN (SELECT unnest(range(-{radius},{radius}+1)) AS i) a2),
  nb AS (SELECT p.asset_id, p.frame_no, p.y, p.x, p.r AS r0, p.g AS g0, p.b AS b0, o.dy, o.dx, {", ".join(f"q.{c} AS {c}" for c in cols)} FROM px_emb p JOIN dims d USING (asset_id, frame_no) CROSS JOIN o
    JOIN px_emb q ON q.asset_id=p.asset_id AND q.frame_no=p.frame_no AND q.y=least(greatest(p.y+o.dy,0),d.h-1) AND q.x=least(greatest(p.x+o.dx,0),d.w-1))"""


@query("st.median", f"WITH {BASE}, {_around(2, 'rgb')} SELECT {KEY}, {', '.join(f'median({c}) AS {c}' for c in 'rgb')} FROM nb GROUP BY ALL")
def median(spark, sf):
    return stencil.median(t.px_emb(spark, sf), 2).drop("a")


_L = lambda r, g, b: f"(0.2126*{r} + 0.7152*{g} + 0.0722*{b})"


@query("st.bilateral", f"""WITH {BASE}, {_around(3, 'rgb')}, w AS (SELECT *, exp(-(dx*dx+dy*dy)/8.0) * exp(-pow({_L('r', 'g', 'b')} - {_L('r0', 'g0', 'b0')}, 2)/(2*0.1*0.1)) AS wt FROM nb)
  SELECT {KEY}, {", ".join(f"round(sum({c}*wt)/sum(wt), 9) AS {c}" for c in "rgb")} FROM w GROUP BY ALL""")
def bilateral(spark, sf):
    return pixels(stencil.bilateral(t.px_emb(spark, sf)), RGB)


def _near(pos: str, extent: str, block: int, half: int) -> str:
    return f"EXISTS (SELECT 1 FROM (SELECT unnest(range(1, 100)) AS m) WHERE m*{block} < {extent} AND p.{pos} >= m*{block}-{half} AND p.{pos} < least(m*{block}+{half}, {extent}))"


@query("st.deblock", f"""WITH {BASE}, {taps('k', 0.6, 2)}, {conv('px_emb', 'cy', 'k', 'y')},
  s1 AS (SELECT {", ".join("p." + c.strip() for c in KEY.split(","))}, {", ".join(f"CASE WHEN {_near('y', 'd.h', 8, 2)} THEN c.{c} ELSE p.{c} END AS {c}" for c in "rgba")} FROM px_emb p JOIN cy c USING ({KEY}) JOIN dims d USING (asset_id, frame_no)),
  {conv('s1', 'cx', 'k', 'x')}
  SELECT {", ".join("p." + c.strip() for c in KEY.split(","))}, {", ".join(f"round(CASE WHEN {_near('x', 'd.w', 8, 2)} THEN c.{c} ELSE p.{c} END, 9) AS {c}" for c in "rgba")} FROM s1 p JOIN cx c USING ({KEY}) JOIN dims d USING (asset_id, frame_no)""")
def deblock(spark, sf):
    return pixels(stencil.deblock(t.px_emb(spark, sf)))


def _pool(src: str, col: str, radius: int, out: str) -> str:
    return f"""{out}_x AS (SELECT {KEY}, min({col}) OVER (PARTITION BY asset_id, frame_no, y ORDER BY x ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS m FROM {src}),
  {out} AS (SELECT {KEY}, min(m) OVER (PARTITION BY asset_id, frame_no, x ORDER BY y ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS m FROM {out}_x)"""


@query("st.min_pool", f"WITH {PX_EMB}, s AS (SELECT {KEY}, least(r,g,b) AS dark FROM px_emb), {_pool('s', 'dark', 3, 'mp')} SELECT {KEY}, m AS dark FROM mp")
def min_pool(spark, sf):
    return stencil.min_pool(t.px_emb(spark, sf).select(*PIXEL, F.least(*RGB).alias("dark")), "dark", 3)


@query("st.dehaze_dcp", f"""WITH {PX_EMB}, s AS (SELECT {KEY}, least(r,g,b) AS dark FROM px_emb), {_pool('s', 'dark', 3, 'd1')},
  rk AS (SELECT p.*, m, row_number() OVER (PARTITION BY p.asset_id, p.frame_no ORDER BY m DESC, y, x) AS rn, count(*) OVER (PARTITION BY p.asset_id, p.frame_no) AS n FROM px_emb p JOIN d1 USING ({KEY})),
  best AS (SELECT asset_id, frame_no, r, g, b, row_number() OVER (PARTITION BY asset_id, frame_no ORDER BY r+g+b DESC, m DESC, y, x) AS k FROM rk WHERE rn <= greatest(1, ceil(n*0.001))),
  lt AS (SELECT asset_id, frame_no, {", ".join(f"least(greatest({c},1e-3),1.0) AS l{c}" for c in "rgb")} FROM best WHERE k = 1),
  v AS (SELECT {KEY}, least(r/lr, g/lg, b/lb) AS veil FROM px_emb JOIN lt USING (asset_id, frame_no)), {_pool('v', 'veil', 3, 'd2')},
  tt AS (SELECT {KEY}, greatest(1.0-0.95*m, 0.1) AS t FROM d2)
  SELECT {KEY}, {", ".join(f"round({clamp01(f'({c}-l{c})/t + l{c}')}, 9) AS {c}" for c in "rgb")} FROM px_emb JOIN lt USING (asset_id, frame_no) JOIN tt USING ({KEY})""")
def dehaze(spark, sf):
    return pixels(stencil.dehaze_dcp(t.px_emb(spark, sf), patch_radius=3), RGB)


_HIST = f"""lumped AS (SELECT p.*, {LUMA} AS lum, w, h FROM px_emb p JOIN dims USING (asset_id, frame_no)),
  hist AS (SELECT asset_id, frame_no, CAST(((y+1)*4-1)//h AS INTEGER) AS grid_y, CAST(((x+1)*4-1)//w AS INTEGER) AS grid_x, CAST(round({clamp01('lum')}*255) AS INTEGER) AS bin, count(*) AS n FROM lumped GROUP BY ALL)"""


@query("agg.histogram", f"WITH {BASE}, {_HIST} SELECT * FROM hist")
def histogram(spark, sf):
    return stencil.histogram(t.px_emb(spark, sf), 4, 4)


def _axis(pos: str, extent: str, tiles: int) -> str:
    return f"least(greatest(({pos}+0.5)/({extent}/{tiles}.0)-0.5, 0.0), {tiles - 1}.0)"


@query("st.clahe", f"""WITH {BASE}, {_HIST}, tl AS (SELECT asset_id, frame_no, grid_y, grid_x, sum(n) AS total FROM hist GROUP BY ALL),
  h0 AS (SELECT tl.*, b.bin, coalesce(n,0) AS n, CAST(floor(greatest(2.5*total/256.0, 1.0)) AS BIGINT) AS lim FROM tl CROSS JOIN (SELECT unnest(range(256)) AS bin) b LEFT JOIN hist USING (asset_id, frame_no, grid_y, grid_x, bin)),
  h1 AS (SELECT *, sum(greatest(n-lim,0)) OVER (PARTITION BY asset_id, frame_no, grid_y, grid_x) AS ex FROM h0),
  h2 AS (SELECT *, least(n,lim) + ex//256 + CASE WHEN ex%256 > 0 AND bin % (256//greatest(ex%256,1)) = 0 AND bin // (256//greatest(ex%256,1)) < ex%256 THEN 1 ELSE 0 END AS c FROM h1),
  h3 AS (SELECT *, sum(c) OVER (PARTITION BY asset_id, frame_no, grid_y, grid_x ORDER BY bin) AS cum, count(*) FILTER (c > 0) OVER (PARTITION BY asset_id, frame_no, grid_y, grid_x) AS used FROM h2),
  h4 AS (SELECT *, min(CASE WHEN c > 0 THEN cum END) OVER (PARTITION BY asset_id, frame_no, grid_y, grid_x) / CAST(total AS DOUBLE) AS low FROM h3),
  cdf AS (SELECT asset_id, frame_no, grid_y, grid_x, bin, CASE WHEN used = 1 THEN bin/255.0 ELSE {clamp01('(cum/CAST(total AS DOUBLE)-low)/greatest(1.0-low,1e-6)')} END AS v FROM h4),
  q AS (SELECT *, CAST(round({clamp01('lum')}*255) AS INTEGER) AS bin, {_axis('x', 'w', 4)} AS u, {_axis('y', 'h', 4)} AS vv FROM lumped),
  q2 AS (SELECT *, floor(u) AS gx, floor(vv) AS gy, u-floor(u) AS fx, vv-floor(vv) AS fy FROM q),
  s AS (SELECT q2.*, ((c00.v*(1-fx)+c10.v*fx)*(1-fy) + (c01.v*(1-fx)+c11.v*fx)*fy)/greatest(lum,1e-6) AS sc FROM q2
    {" ".join(f"JOIN cdf c{i}{j} ON c{i}{j}.asset_id=q2.asset_id AND c{i}{j}.frame_no=q2.frame_no AND c{i}{j}.bin=q2.bin AND c{i}{j}.grid_x=least(gx+{i},3) AND c{i}{j}.grid_y=least(gy+{j},3)" for i in (0, 1) for j in (0, 1))})
  SELECT {KEY}, {", ".join(f"round({clamp01(f'{c}*sc')}, 9) AS {c}" for c in "rgb")} FROM s""")
def clahe(spark, sf):
    return pixels(stencil.clahe(t.px_emb(spark, sf), 4, 4, 2.5), RGB)


_COVER = clamp01("(least(x+0.5-3, 3+10-(x+0.5), y+0.5-5, 5+20-(y+0.5))+4.0)/8.0")


@query("st.skin_smooth_rect", f"""WITH {BASE}, {_gauss(2.0, 6)}, m AS (SELECT {KEY}, {_COVER}*0.5 AS mix FROM px_emb)
  SELECT {KEY}, {", ".join(f"round(p.{c} + (s.{c}-p.{c})*mix, 9) AS {c}" for c in "rgba")} FROM px_emb p JOIN soft s USING ({KEY}) JOIN m USING ({KEY})""")
def skin_smooth(spark, sf):
    return pixels(stencil.skin_smooth_rect(t.px_emb(spark, sf), 3, 5, 10, 20))


def _bilinear(sx: str, sy: str, out: str, extra: str = "", source: str = "px_emb") -> str:
    """Samples at ``(sx, sy)`` given as columns of ``src``; coordinates clamp before the four reads."""
    return f"""{out} AS (SELECT s.*, {", ".join(f"(p00.{c}*(1-fx)+p10.{c}*fx)*(1-fy) + (p01.{c}*(1-fx)+p11.{c}*fx)*fy AS {c}" for c in "rgba")} FROM {source} s
    {" ".join(f"JOIN px_emb p{i}{j} ON p{i}{j}.asset_id=s.asset_id AND p{i}{j}.frame_no=s.frame_no AND p{i}{j}.x=least(greatest(x0+{i},0),w-1) AND p{i}{j}.y=least(greatest(y0+{j},0),h-1)" for i in (0, 1) for j in (0, 1))})"""


@query("st.motion_blur", f"""WITH {BASE}, a AS (SELECT asset_id, frame_no, p.y, p.x, w, h, {clamp01('0')} AS z, least(greatest(p.x + (-2.5+k/7.0*5.0)*cos(radians(30.0)),0.0),w-1.0) AS cx, least(greatest(p.y + (-2.5+k/7.0*5.0)*sin(radians(30.0)),0.0),h-1.0) AS cy
    FROM px_emb p JOIN dims USING (asset_id, frame_no) CROSS JOIN (SELECT unnest(range(8)) AS k)),
  s AS (SELECT *, floor(cx) AS x0, floor(cy) AS y0, cx-floor(cx) AS fx, cy-floor(cy) AS fy FROM a), {_bilinear('', '', 'o', source='s')}
  SELECT {KEY}, {", ".join(f"round(avg({c}), 9) AS {c}" for c in "rgba")} FROM o GROUP BY ALL""")
def motion_blur(spark, sf):
    return pixels(stencil.motion_blur(t.px_emb(spark, sf), 5.0, 30.0, 8))


_TRANSLATED = f"""a AS (SELECT asset_id, frame_no, y, x, w, h, x-dx AS sx, y-dy AS sy FROM px_emb JOIN dims USING (asset_id, frame_no) JOIN motion USING (asset_id, frame_no)),
  s AS (SELECT *, floor(sx) AS x0, floor(sy) AS y0, sx-floor(sx) AS fx, sy-floor(sy) AS fy FROM a), {_bilinear('', '', 'o', source='s')}"""


@query("st.translate", f"WITH {BASE}, {MOTION}, {_TRANSLATED} SELECT {KEY}, {rounded()} FROM o")
def translate(spark, sf):
    px = t.px_emb(spark, sf)
    return pixels(resample.translate(px, t.motion(px), True))


@query("st.translate_nearest", f"""WITH {BASE}, {MOTION} SELECT p.asset_id, p.frame_no, p.y, p.x, q.r, q.g, q.b FROM px_emb p JOIN dims d USING (asset_id, frame_no) JOIN motion m USING (asset_id, frame_no)
  JOIN px_emb q ON q.asset_id=p.asset_id AND q.frame_no=p.frame_no AND q.x=least(greatest(p.x-round(m.dx),0),d.w-1) AND q.y=least(greatest(p.y-round(m.dy),0),d.h-1)""")
def translate_nearest(spark, sf):
    px = t.px_emb(spark, sf)
    return resample.translate(px, t.motion(px), False).drop("a")


def _targets(w: str, h: str) -> str:
    return f"SELECT asset_id, frame_no, CAST(ty AS INTEGER) AS y, CAST(tx AS INTEGER) AS x, w, h, (tx+0.5)*w/CAST({w} AS DOUBLE)-0.5 AS sx, (ty+0.5)*h/CAST({h} AS DOUBLE)-0.5 AS sy FROM dims, LATERAL (SELECT unnest(range(CAST({w} AS BIGINT))) AS tx) , LATERAL (SELECT unnest(range(CAST({h} AS BIGINT))) AS ty)"


@query("st.resize_bilinear", f"""WITH {BASE}, a AS ({_targets('15', '70')}), b1 AS (SELECT *, least(greatest(floor(sx),0),w-1) AS x0, least(greatest(floor(sy),0),h-1) AS y0 FROM a),
  s AS (SELECT *, least(greatest(sx-x0,0.0),1.0) AS fx, least(greatest(sy-y0,0.0),1.0) AS fy FROM b1), {_bilinear('', '', 'o', source='s')} SELECT {KEY}, {rounded()} FROM o""")
def resize(spark, sf):
    return pixels(resample.resize_bilinear(t.px_emb(spark, sf), 15, 70))


def _cubic(b: float, c: float):
    def w(d: str) -> str:
        near = f"(({12 - 9 * b - 6 * c})*pow(abs({d}),3) + ({-18 + 12 * b + 6 * c})*pow(abs({d}),2) + ({6 - 2 * b}))/6"
        far = f"(({-b - 6 * c})*pow(abs({d}),3) + ({6 * b + 30 * c})*pow(abs({d}),2) + ({-12 * b - 48 * c})*abs({d}) + ({8 * b + 24 * c}))/6"
        return f"CASE WHEN abs({d}) < 1 THEN {near} WHEN abs({d}) < 2 THEN {far} ELSE 0.0 END"

    return w


def _lanczos(d: str) -> str:
    return f"CASE WHEN abs({d}) < 1e-8 THEN 1.0 WHEN abs({d}) < 3 THEN sin(pi()*{d})/(pi()*{d})*sin(pi()*{d}/3)/(pi()*{d}/3) ELSE 0.0 END"


def _scaled(weight, lo: int, hi: int, scale: float, normalize: bool, clip: bool = True, source: str = "px_emb", out: str = "rs") -> str:
    """Separable resampling by joining every target line with its taps."""
    tap = f"(SELECT unnest(range({lo}, {hi}+1)) AS k)"
    div = "/sum(wt)" if normalize else ""
    sx, sy = (f"(t+0.5)*{e}/CAST(greatest(round({e}*{scale}),1) AS DOUBLE)-0.5" for e in "wh")
    edge = (lambda e: clamp01(e)) if clip else (lambda e: e)
    return f"""{out}_tx AS (SELECT asset_id, frame_no, t, w, {sx} AS s FROM dims, LATERAL (SELECT unnest(range(CAST(greatest(round(w*{scale}),1) AS BIGINT))) AS t)),
  {out}_wx AS (SELECT asset_id, frame_no, t, least(greatest(floor(s)+k,0),w-1) AS x, {weight('(floor(s)+k-s)')} AS wt FROM {out}_tx CROSS JOIN {tap}),
  {out}_x AS (SELECT p.asset_id, p.frame_no, p.y, t AS x, {", ".join(f"sum({c}*wt){div} AS {c}" for c in "rgba")} FROM {source} p JOIN {out}_wx q ON q.asset_id=p.asset_id AND q.frame_no=p.frame_no AND q.x=p.x GROUP BY ALL),
  {out}_ty AS (SELECT asset_id, frame_no, t, h, {sy} AS s FROM dims, LATERAL (SELECT unnest(range(CAST(greatest(round(h*{scale}),1) AS BIGINT))) AS t)),
  {out}_wy AS (SELECT asset_id, frame_no, t, least(greatest(floor(s)+k,0),h-1) AS y, {weight('(floor(s)+k-s)')} AS wt FROM {out}_ty CROSS JOIN {tap}),
  {out} AS (SELECT p.asset_id, p.frame_no, CAST(t AS INTEGER) AS y, CAST(p.x AS INTEGER) AS x, {", ".join(edge(f"sum({c}*wt){div}") + f" AS {c}" for c in "rgba")} FROM {out}_x p JOIN {out}_wy q ON q.asset_id=p.asset_id AND q.frame_no=p.frame_no AND q.y=p.y GROUP BY p.asset_id, p.frame_no, t, p.x)"""


@query("st.upscale_mitchell", f"WITH {BASE}, {_scaled(_cubic(1 / 3, 1 / 3), -1, 2, 2.0, False)} SELECT {KEY}, {rounded()} FROM rs")
def mitchell(spark, sf):
    return pixels(resample.upscale_mitchell(t.px_emb(spark, sf), 2.0))


@query("st.upscale_catmull", f"WITH {BASE}, {_scaled(_cubic(0.0, 0.5), -1, 2, 1.5, False)} SELECT {KEY}, {rounded()} FROM rs")
def catmull(spark, sf):
    return pixels(resample.upscale_catmull(t.px_emb(spark, sf), 1.5))


@query("st.upscale_lanczos", f"WITH {BASE}, {_scaled(_lanczos, -2, 3, 2.0, True)} SELECT {KEY}, {rounded()} FROM rs")
def lanczos(spark, sf):
    return pixels(resample.upscale_lanczos(t.px_emb(spark, sf), 2.0, 3))


@query("st.downscale_lanczos", f"WITH {BASE}, {_scaled(_lanczos, -2, 3, 0.4, True)} SELECT {KEY}, {rounded()} FROM rs")
def lanczos_down(spark, sf):
    return pixels(resample.upscale_lanczos(t.px_emb(spark, sf), 0.4, 3))


@query("join.kernel_gather", f"WITH {BASE}, {_scaled(_cubic(1 / 3, 1 / 3), -1, 2, 2.0, False)} SELECT asset_id, frame_no, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {rounded()} FROM rs_x")
def kernel_gather(spark, sf):
    return pixels(resample.kernel_gather(t.px_emb(spark, sf), "x", 2.0))


@query("st.demosaic_bilinear", f"""WITH {PX_EMB}, cfa AS (SELECT {KEY}, CASE WHEN y%2=0 AND x%2=0 THEN 'r' WHEN y%2=1 AND x%2=1 THEN 'b' ELSE 'g' END AS site, {clamp01("(CASE WHEN y%2=0 AND x%2=0 THEN r WHEN y%2=1 AND x%2=1 THEN b ELSE g END - 0.1)/0.8")} AS v FROM px_emb)
  SELECT p.asset_id, p.frame_no, p.y, p.x, {", ".join(f"round(coalesce(avg(q.v) FILTER (q.site='{c}'), min(p.v)), 9) AS {c}" for c in "rgb")} FROM cfa p JOIN cfa q ON q.asset_id=p.asset_id AND q.frame_no=p.frame_no AND abs(q.y-p.y) <= 1 AND abs(q.x-p.x) <= 1 GROUP BY ALL""")
def demosaic(spark, sf):
    return pixels(stencil.demosaic_bilinear(t.px_cfa(spark, sf), 0.1, 0.9), RGB)


@query("st.edge_step", f"WITH {PX_LI}, e AS (SELECT {KEY}, abs(({LUMA}) - lag({LUMA}) OVER (PARTITION BY asset_id, frame_no, y ORDER BY x)) AS edge FROM px_li) SELECT {KEY}, round(edge, 13) AS edge FROM e WHERE edge IS NOT NULL")
def edge_step(spark, sf):
    return stencil.edge_step(t.px_li(spark, sf)).select(*PIXEL, r9("edge", 13))


@query("win.top_fraction", f"""WITH {PX_LI}, k AS (SELECT {KEY}, round(g, 12) AS g, row_number() OVER (PARTITION BY asset_id, frame_no ORDER BY round(g, 12) DESC, y, x) AS rn, count(*) OVER (PARTITION BY asset_id, frame_no) AS n FROM px_li)
  SELECT {KEY}, g FROM k WHERE rn <= greatest(1, ceil(n*0.05))""")
def top_fraction(spark, sf):
    px = t.px_li(spark, sf).select(*PIXEL, F.round("g", 12).alias("g"))
    return top_share(px, FRAME, "g", ["y", "x"], 0.05)


# Metrics


_SE = "(r-r2)*(r-r2)+(g-g2)*(g-g2)+(b-b2)*(b-b2)"


@query("agg.mse", f"WITH {PX_SAME} SELECT asset_id, frame_no, round(sum({_SE})/(3.0*count(*)), 12) AS mse FROM same GROUP BY ALL")
def mse(spark, sf):
    return metrics.mse(*pair(spark, sf)).select(*FRAME, r9("mse", 12))


_PSNR = "CASE WHEN mse <= 0 THEN CAST('inf' AS DOUBLE) ELSE -10*log10(mse) END"


@query("agg.psnr", f"WITH {PX_SAME}, e AS (SELECT asset_id, frame_no, sum({_SE})/(3.0*count(*)) AS mse FROM same GROUP BY ALL) SELECT asset_id, frame_no, round({_PSNR}, 9) AS psnr FROM e")
def psnr(spark, sf):
    return metrics.psnr(*pair(spark, sf)).select(*FRAME, r9("psnr"))


def ssim_sql(source: str = "pair", right: str = "21", bottom: str = "49", sizes: str = "") -> str:
    """``right`` and ``bottom`` are the last column and line, from the join ``sizes`` where frames differ."""
    cols = ["ma", "mb", "aa", "bb", "ab"]
    plane = f"""lm AS (SELECT asset_id, frame_no, y, x, {_L('r', 'g', 'b')} AS ma, {_L('r2', 'g2', 'b2')} AS mb, {_SE} AS se FROM {source}),
  pl AS (SELECT *, ma*ma AS aa, mb*mb AS bb, ma*mb AS ab FROM lm), {taps('k5', 1.5, 5)}"""

    def one(src, out, axis, limit):
        other = "y" if axis == "x" else "x"
        return f"""{out} AS (SELECT p.asset_id, p.frame_no, p.y, p.x, {", ".join(f"sum(q.{c}*w) AS {c}" for c in cols)} FROM {src} p{sizes} CROSS JOIN k5 JOIN {src} q ON q.asset_id=p.asset_id AND q.frame_no=p.frame_no AND q.{other}=p.{other}
      AND q.{axis}=least(greatest(p.{axis}+k,0),{limit}) GROUP BY ALL)"""

    value = "((2*ma*mb+0.0001)*(2*(ab-ma*mb)+0.0009))/((ma*ma+mb*mb+0.0001)*(greatest(aa-ma*ma,0)+greatest(bb-mb*mb,0)+0.0009))"
    return f"{plane}, {one('pl', 'px1', 'x', right)}, {one('px1', 'px2', 'y', bottom)}, sm AS (SELECT asset_id, frame_no, avg({value}) AS ssim FROM px2 GROUP BY ALL)"


_SSIM = ssim_sql("same", "d.dw-1", "d.dh-1", " JOIN (SELECT asset_id, frame_no, w AS dw, h AS dh FROM dims) d ON d.asset_id=p.asset_id AND d.frame_no=p.frame_no")


@query("agg.ssim", f"WITH {PX_SAME}, {_SSIM} SELECT asset_id, frame_no, round(ssim, 9) AS ssim FROM sm")
def ssim(spark, sf):
    return metrics.ssim(*pair(spark, sf)).select(*FRAME, r9("ssim"))


@query("agg.all_metrics", f"""WITH {PX_SAME}, {_SSIM}, e AS (SELECT asset_id, frame_no, sum(se)/(3.0*count(*)) AS mse FROM pl GROUP BY ALL)
  SELECT asset_id, frame_no, round(mse, 12) AS mse, round({_PSNR}, 9) AS psnr, round(ssim, 9) AS ssim FROM e JOIN sm USING (asset_id, frame_no)""")
def all_metrics(spark, sf):
    return metrics.all_metrics(*pair(spark, sf)).select(*FRAME, r9("mse", 12), r9("psnr"), r9("ssim"))


def _stack(fold: str) -> str:
    cols = ", ".join(f"round({clamp01(fold.format(c=c))}, 9) AS {c}" for c in "rgba")
    return f"WITH {BASE}, {MIXED} SELECT asset_id, y, x, {cols} FROM px_emb WHERE asset_id NOT IN (SELECT asset_id FROM mixed) GROUP BY ALL"


for _how, _fold in {"mean": "avg({c})", "max": "max({c})", "min": "min({c})", "median": "list_sort(list({c}))[count(*)//2 + 1]"}.items():
    def _run(spark, sf, how=_how):
        return metrics.stack(t.px_emb(spark, sf), how).select("asset_id", "y", "x", *[r9(c) for c in "rgba"])

    query("agg.stack" if _how == "mean" else f"agg.stack_{_how}", _stack(_fold))(_run)


@query("agg.fuse_median", _stack("median({c})"))
def fuse(spark, sf):
    return metrics.fuse_median(t.px_emb(spark, sf)).select("asset_id", "y", "x", *[r9(c) for c in "rgba"])


STATS = f"""lm AS (SELECT *, {LUMA} AS lum FROM px_emb), e AS (SELECT asset_id, frame_no, abs(lum - lag(lum) OVER (PARTITION BY asset_id, frame_no, y ORDER BY x)) AS e FROM lm),
  st0 AS (SELECT asset_id, frame_no, list_sort(list(lum)) AS ls, count(*) AS n, avg(greatest(r,g,b)-least(r,g,b)) AS chroma_mean, avg((r+g+b)/3.0) AS luminance_mean, avg(r) AS r_mean, avg(g) AS g_mean, avg(b) AS b_mean FROM lm GROUP BY ALL),
  stats AS (SELECT asset_id, frame_no, ls[CAST(floor(0.005*(n-1)) AS BIGINT)+1] AS p01, ls[CAST(floor(0.5*(n-1)) AS BIGINT)+1] AS p50, ls[CAST(floor(0.995*(n-1)) AS BIGINT)+1] AS p99,
    chroma_mean, luminance_mean, r_mean, g_mean, b_mean, (SELECT avg(e) FROM e WHERE e.asset_id=st0.asset_id AND e.frame_no=st0.frame_no) AS edge_mean FROM st0)"""
_NUMS = ["p01", "p50", "p99", "chroma_mean", "luminance_mean", "edge_mean", "r_mean", "g_mean", "b_mean"]


@query("agg.frame_stats", f"WITH {PX_EMB}, {STATS} SELECT asset_id, frame_no, {', '.join(f'round({c}, 9) AS {c}' for c in _NUMS)} FROM stats")
def frame_stats(spark, sf):
    return metrics.frame_stats(t.px_emb(spark, sf)).select(*FRAME, *[r9(c) for c in _NUMS])


CAST = """mv AS (SELECT *, (r_mean+g_mean+b_mean)/3.0 AS m0 FROM stats), mv2 AS (SELECT *, r_mean-m0 AS dr, g_mean-m0 AS dg, b_mean-m0 AS db FROM mv),
  tags AS (SELECT *, sqrt(dr*dr+dg*dg+db*db) AS cast_mag, array_to_string(list_filter([CASE WHEN dr > 0.012 THEN 'warm/red' END, CASE WHEN db > 0.012 THEN 'cool/blue' END, CASE WHEN dg > 0.012 THEN 'green' END,
    CASE WHEN dr < -0.012 THEN 'cyan-ish' END, CASE WHEN db < -0.012 THEN 'yellow-ish' END, CASE WHEN dg < -0.012 THEN 'magenta' END], lambda z: z IS NOT NULL), ', ') AS cd FROM mv2)"""


@query("agg.channel_cast", f"WITH {PX_EMB}, {STATS}, {CAST} SELECT asset_id, frame_no, round(cast_mag, 9) AS cast_mag, CASE WHEN cd = '' THEN 'neutral' ELSE cd END AS cast_dir FROM tags")
def channel_cast(spark, sf):
    return metrics.channel_cast(t.px_emb(spark, sf)).select(*FRAME, r9("cast_mag"), "cast_dir")


# Frames of several sizes: every eighth frame loses its last ten lines.
UNEVEN = f"""{PX_EMB}, uneven AS (SELECT * FROM px_emb WHERE NOT (frame_no % 8 = 3 AND y >= 40)),
  udims AS (SELECT asset_id, frame_no, max(x)+1 AS w, max(y)+1 AS h FROM uneven GROUP BY ALL),
  ufirst AS (SELECT asset_id, arg_min(w, frame_no) AS fw, arg_min(h, frame_no) AS fh, count(*) AS n FROM udims GROUP BY asset_id)"""


def uneven(spark, sf):
    return t.px_emb(spark, sf).where(~((F.col("frame_no") % 8 == 3) & (F.col("y") >= 40)))


def _size_errors(least: int) -> str:
    return f"""WITH {UNEVEN} SELECT asset_id, frame_no, 'LAYOUT' AS code,
      CASE WHEN n < {least} THEN n || ' frames, at least {least} needed' ELSE 'frame is ' || w || 'x' || h || ', its first frame ' || fw || 'x' || fh END AS reason
    FROM udims JOIN ufirst USING (asset_id) WHERE n < {least} OR w <> fw OR h <> fh"""


@query("agg.stack_errors", _size_errors(1))
def stack_errors(spark, sf):
    return metrics.stack_errors(uneven(spark, sf))


@query("fx.register_errors", _size_errors(2))
def register_errors(spark, sf):
    return spectral.register_errors(uneven(spark, sf))


@query("agg.stack_uneven", f"""WITH {UNEVEN} SELECT asset_id, y, x, round(avg(r), 9) AS r, round(avg(g), 9) AS g, round(avg(b), 9) AS b FROM uneven
  WHERE asset_id NOT IN (SELECT asset_id FROM udims JOIN ufirst USING (asset_id) WHERE w <> fw OR h <> fh) GROUP BY ALL""")
def stack_uneven(spark, sf):
    return metrics.stack(uneven(spark, sf)).select("asset_id", "y", "x", *[r9(c) for c in RGB])


@query("join.pair_errors", f"""WITH {UNEVEN} SELECT asset_id, frame_no, 'LAYOUT' AS code, 'frame dims differ: 22x50 vs 22x40' AS reason FROM udims WHERE h = 40""")
def pair_errors(spark, sf):
    return metrics.pair_errors(t.px_emb(spark, sf), uneven(spark, sf))


@query("join.pair_errors_lone", f"""WITH {BASE}, f AS (SELECT asset_id, frame_no FROM dims), g AS (SELECT asset_id, frame_no - 1 AS frame_no FROM f)
  SELECT asset_id, frame_no, 'LAYOUT' AS code, 'only the first side has the frame' AS reason FROM (SELECT * FROM f EXCEPT SELECT * FROM g)
  UNION ALL SELECT asset_id, frame_no, 'LAYOUT', 'only the second side has the frame' FROM (SELECT * FROM g EXCEPT SELECT * FROM f)
  UNION ALL SELECT a.asset_id, a.frame_no, 'LAYOUT', 'frame dims differ: ' || a.w || 'x' || a.h || ' vs ' || b.w || 'x' || b.h
    FROM dims a JOIN dims b ON b.asset_id = a.asset_id AND b.frame_no = a.frame_no + 1 WHERE a.w <> b.w OR a.h <> b.h""")
def pair_errors_lone(spark, sf):
    px = t.px_emb(spark, sf)
    return metrics.pair_errors(px, px.withColumn("frame_no", F.col("frame_no") - 1))


@query("agg.mse_uneven", f"""WITH {UNEVEN}, {DIMS} SELECT asset_id, frame_no, CAST(0.0 AS DOUBLE) AS mse FROM udims JOIN dims USING (asset_id, frame_no, w, h)""")
def mse_uneven(spark, sf):
    return metrics.mse(t.px_emb(spark, sf), uneven(spark, sf)).select(*FRAME, r9("mse", 12))


@query("px.crop_uneven", f"""WITH {UNEVEN} SELECT asset_id, frame_no, y - 20 AS y, x - 2 AS x, r, g, b FROM uneven JOIN udims USING (asset_id, frame_no)
  WHERE w >= 12 AND h >= 50 AND x BETWEEN 2 AND 11 AND y BETWEEN 20 AND 49""")
def crop_uneven(spark, sf):
    return pointwise.crop(uneven(spark, sf), 2, 20, 10, 30).select(*PIXEL, *RGB)
