"""Queries over sample tables and Fourier operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake import tables as t
from framelake.operators import audio, spectral
from framelake.operators.audio import HIGHPASS_48K, SHELF_48K
from framelake.schemas import FRAME, RGB
from framelake.workload.registry import pixels, query, r9
from framelake.workload.sql import DIMS, KEY, LUMA, MIXED, PX_EMB, SND, STEREO, clamp01, rounded
from framelake.workload.stencils import _bilinear, _lanczos, _scaled

MOMENTARY, SHORT_TERM, STEP = 40, 300, 10
BASE = f"{PX_EMB}, {DIMS}"


def _biquad(c, x0, x1, x2, y1, y2):
    b0, b1, b2, a1, a2 = c
    return f"({b0}*{x0} + ({b1})*{x1} + {b2}*{x2} - ({a1})*{y1} - ({a2})*{y2})"


_U0 = _biquad(SHELF_48K, "s.v", "k.x1", "k.x2", "k.u1", "k.u2")
_ZERO = "CAST(0 AS DOUBLE)"

# Direct-form recursion sample by sample; state is two past inputs, shelf outputs and final outputs.
KWEIGHT = f"""snd AS MATERIALIZED ({SND[SND.index('(') + 1 : -1]}),
kf AS (SELECT asset_id, CAST(-1 AS BIGINT) AS n, {_ZERO} AS x1, {_ZERO} AS x2, {_ZERO} AS u1, {_ZERO} AS u2, {_ZERO} AS y1, {_ZERO} AS y2 FROM snd WHERE n = 0
  UNION ALL SELECT asset_id, n, v, x1, u0, u1, {_biquad(HIGHPASS_48K, "u0", "u1", "u2", "y1", "y2")}, y1
  FROM (SELECT k.asset_id, s.n, s.v, k.x1, k.u1, k.u2, k.y1, k.y2, {_U0} AS u0 FROM kf k JOIN snd s ON s.asset_id = k.asset_id AND s.n = k.n + 1)),
kw AS (SELECT asset_id, 0 AS channel, n, y1 AS v FROM kf WHERE n >= 0)"""


@query("au.k_weight", f"WITH RECURSIVE {KWEIGHT} SELECT asset_id, channel, n, round(v, 6) AS v FROM kw")
def k_weight(spark, sf):
    return audio.k_weight(t.snd_ev(spark, sf)).select("asset_id", "channel", "n", r9("v", 6))


def _blocks(src: str, out: str, block: int, channels: int = 1) -> str:
    return f"""{out} AS (SELECT asset_id, j AS block, sum(v*v)/{block}.0 AS energy FROM {src}, LATERAL (SELECT unnest(range(greatest(n//{STEP} - {block // STEP - 1}, 0), n//{STEP} + 1)) AS j) GROUP BY ALL HAVING count(*) = {block * channels})"""


WIDE = f"""{STEREO}, wide AS (SELECT * FROM stereo UNION ALL SELECT asset_id, 2, n, v FROM snd WHERE asset_id IN ('view', 'click'))"""


def snd_wide(spark, sf):
    third = t.snd_ev(spark, sf).where(F.col("asset_id").isin("view", "click")).withColumn("channel", F.lit(2))
    return t.snd_stereo(spark, sf).unionByName(third)


@query("au.layout_errors", f"WITH {WIDE} SELECT asset_id, 'LAYOUT' AS code, count(DISTINCT channel) || ' channels, at most 2 are measured' AS reason FROM wide GROUP BY asset_id HAVING count(DISTINCT channel) > 2")
def layout_errors(spark, sf):
    return audio.layout_errors(snd_wide(spark, sf))


@query("au.block_energy_wide", f"WITH {WIDE}, keep AS (SELECT * FROM wide WHERE asset_id NOT IN ('view', 'click')), {_blocks('keep', 'bl', MOMENTARY, 2)} SELECT asset_id, block, round(energy, 12) AS energy FROM bl")
def block_energy_wide(spark, sf):
    return audio.block_energy(snd_wide(spark, sf), MOMENTARY, STEP).select("asset_id", "block", r9("energy", 12))


@query("au.block_energy", f"WITH {STEREO}, {_blocks('stereo', 'bl', MOMENTARY, 2)} SELECT asset_id, block, round(energy, 12) AS energy FROM bl")
def block_energy(spark, sf):
    return audio.block_energy(t.snd_stereo(spark, sf), MOMENTARY, STEP).select("asset_id", "block", r9("energy", 12))


_LUFS = "CASE WHEN {0} > 0 THEN -0.691 + 10*log10({0}) ELSE -CAST('inf' AS DOUBLE) END"
INTEGRATED = f"""g1 AS (SELECT asset_id, avg(energy) AS m FROM bm WHERE {_LUFS.format('energy')} > -70 GROUP BY asset_id),
  g2 AS (SELECT bm.asset_id, avg(energy) AS m2 FROM bm JOIN g1 USING (asset_id) WHERE {_LUFS.format('energy')} > -70 AND {_LUFS.format('energy')} > {_LUFS.format('m')} - 10 GROUP BY bm.asset_id)"""


@query("agg.integrated_loudness", f"WITH {SND}, {_blocks('snd', 'bm', MOMENTARY)}, {INTEGRATED} SELECT asset_id, round({_LUFS.format('m2')}, 9) AS integrated_lufs FROM g2")
def integrated(spark, sf):
    return audio.integrated(audio.block_energy(t.snd_ev(spark, sf), MOMENTARY, STEP)).select("asset_id", r9("integrated_lufs"))


@query("au.loudness", f"""WITH RECURSIVE {KWEIGHT}, {_blocks('kw', 'bm', MOMENTARY)}, {_blocks('kw', 'bs', SHORT_TERM)}, {INTEGRATED},
  pm AS (SELECT asset_id, max(energy) AS pm FROM bm GROUP BY 1), ps AS (SELECT asset_id, max(energy) AS ps FROM bs GROUP BY 1)
  SELECT asset_id, round({_LUFS.format('m2')}, 9) AS integrated_lufs, round({_LUFS.format('pm')}, 9) AS max_momentary_lufs, round({_LUFS.format('coalesce(ps, 0)')}, 9) AS max_short_term_lufs FROM g2 JOIN pm USING (asset_id) LEFT JOIN ps USING (asset_id)""")
def loudness(spark, sf):
    done = audio.loudness(audio.k_weight(t.snd_ev(spark, sf)), MOMENTARY, SHORT_TERM, STEP)
    return done.select("asset_id", *[r9(c) for c in ("integrated_lufs", "max_momentary_lufs", "max_short_term_lufs")])


@query("au.true_peak", f"""WITH {SND}, raw AS (SELECT i, sin(pi()*(i-15.5)/4)/(pi()*(i-15.5)/4)*(0.5-0.5*cos(2*pi()*i/31.0)) AS v FROM (SELECT unnest(range(32)) AS i)), tp AS (SELECT i % 4 AS phase, i // 4 AS k, v*4/sum(v) OVER () AS w FROM raw),
  f AS (SELECT s.asset_id, s.n, phase, abs(sum(q.v*w)) AS a FROM snd s CROSS JOIN tp JOIN snd q ON q.asset_id = s.asset_id AND q.n = s.n + k - 4 WHERE phase > 0 GROUP BY ALL),
  m AS (SELECT asset_id, max(a) AS a FROM (SELECT asset_id, a FROM f UNION ALL SELECT asset_id, abs(v) FROM snd) GROUP BY 1) SELECT asset_id, round(20*log10(a), 9) AS true_peak_dbfs FROM m""")
def true_peak(spark, sf):
    return audio.true_peak(t.snd_ev(spark, sf)).select("asset_id", r9("true_peak_dbfs"))


@query("au.normalize_lufs", f"""WITH {SND}, {_blocks('snd', 'bm', MOMENTARY)}, {INTEGRATED}, pk AS (SELECT asset_id, max(abs(v)) AS p FROM snd GROUP BY 1), gn AS (SELECT asset_id, least(pow(10.0, (-6.0 - ({_LUFS.format('m2')}))/20.0), (1.0-1e-4)/p) AS gain FROM g2 JOIN pk USING (asset_id))
  SELECT asset_id, channel, n, round(v*gain, 9) AS v FROM snd JOIN gn USING (asset_id)""")
def normalize(spark, sf):
    snd = t.snd_ev(spark, sf)
    measured = audio.integrated(audio.block_energy(snd, MOMENTARY, STEP))
    return audio.normalize_lufs(snd, measured, -6.0).select("asset_id", "channel", "n", r9("v"))


FRAME_SIZE, RATE, NOISE_SECS = 64, 48000, 0.005
STFT = f"""ln AS (SELECT asset_id, max(n)+1 AS len FROM snd GROUP BY 1), fr AS (SELECT asset_id, len, f FROM ln, LATERAL (SELECT unnest(range(CAST(CASE WHEN len <= 64 THEN 1 ELSE ceil((len-64)/32.0)+1 END AS BIGINT))) AS f)),
  wn AS (SELECT fr.asset_id, len, f, n - f*32 AS i, v*(0.5-0.5*cos(2*pi()*(n-f*32)/63.0)) AS v FROM fr JOIN snd ON snd.asset_id = fr.asset_id AND n >= f*32 AND n < f*32+64),
  sp AS (SELECT asset_id, len, f, k, sum(v*cos(2*pi()*((k*i) % 64)/64.0)) AS re, -sum(v*sin(2*pi()*((k*i) % 64)/64.0)) AS im FROM wn CROSS JOIN (SELECT unnest(range(33)) AS k) GROUP BY ALL)"""


@query("au.stft", f"WITH {SND}, {STFT} SELECT asset_id, f AS frame, CAST(k AS INTEGER) AS bin, round(sqrt(re*re+im*im), 9) AS mag, round(re, 9) + 0.0 AS re, round(im, 9) + 0.0 AS im FROM sp")
def stft(spark, sf):
    return audio.stft(t.snd_ev(spark, sf), FRAME_SIZE).select("asset_id", "frame", "bin", r9("mag"), *[(F.round(c, 9) + 0.0).alias(c) for c in ("re", "im")])


@query("au.spectral_subtract", f"""WITH {SND}, {STFT}, nz AS (SELECT asset_id, k, avg(sqrt(re*re+im*im)) AS nm FROM sp WHERE f < 6 GROUP BY ALL),
  cl AS (SELECT asset_id, len, f, k, greatest(sqrt(re*re+im*im) - 1.5*nm, 0.05*nm) AS m, atan2(im, re) AS ph FROM sp JOIN nz USING (asset_id, k)),
  y AS (SELECT asset_id, len, f, i, sum(CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END * m*cos(ph + 2*pi()*((k*i) % 64)/64.0))/64.0 AS y FROM cl CROSS JOIN (SELECT unnest(range(64)) AS i) GROUP BY ALL),
  o AS (SELECT asset_id, f*32+i AS n, sum(y*(0.5-0.5*cos(2*pi()*i/63.0)))/greatest(sum((0.5-0.5*cos(2*pi()*i/63.0))*(0.5-0.5*cos(2*pi()*i/63.0))), 0.5) AS v FROM y WHERE f*32+i < len GROUP BY ALL) SELECT asset_id, n, round(v, 9) + 0.0 AS v FROM o""")
def spectral_subtract(spark, sf):
    done = audio.spectral_subtract(t.snd_ev(spark, sf), RATE, FRAME_SIZE, noise_secs=NOISE_SECS)
    return done.select("asset_id", "n", (F.round("v", 9) + 0.0).alias("v"))


# Recordings with rates of their own

_OTHER = 44100
_SHELF_44, _HIGH_44 = audio.k_weighting(_OTHER)


def _by_rate(parts48, parts44):
    """One coefficient tuple per rate as SQL that picks by recording."""
    return tuple(f"(CASE WHEN k.asset_id < 'p' THEN {a!r} ELSE {b!r} END)" for a, b in zip(parts44, parts48, strict=True))


_KW_RATES = KWEIGHT.replace(_U0, _biquad(_by_rate(SHELF_48K, _SHELF_44), "s.v", "k.x1", "k.x2", "k.u1", "k.u2")).replace(
    _biquad(HIGHPASS_48K, "u0", "u1", "u2", "y1", "y2"), _biquad(tuple(c.replace("k.asset_id", "asset_id") for c in _by_rate(HIGHPASS_48K, _HIGH_44)), "u0", "u1", "u2", "y1", "y2"))


def _rated(spark, sf, low, high):
    """The signals with one rate for names before 'p' and another from there on."""
    return t.snd_ev(spark, sf).withColumn("sample_rate", F.when(F.col("asset_id") < "p", low).otherwise(high))


@query("au.k_weight_rates", f"WITH RECURSIVE {_KW_RATES} SELECT asset_id, channel, n, round(v, 6) AS v FROM kw")
def k_weight_rates(spark, sf):
    return audio.k_weight(_rated(spark, sf, _OTHER, 48000)).select("asset_id", "channel", "n", r9("v", 6))


_SIZES = "CAST(round(0.1 * sr) AS BIGINT) AS st, CAST(round({secs} * sr) AS BIGINT) AS bl"


def _rate_blocks(out: str, secs: float) -> str:
    return f"""{out} AS (SELECT asset_id, j AS block, sum(v*v)/max(bl) AS energy FROM (SELECT asset_id, n, v, {_SIZES.format(secs=secs)} FROM rated), LATERAL (SELECT unnest(range(greatest(CAST(ceil((n - bl + 1) / CAST(st AS DOUBLE)) AS BIGINT), 0), n // st + 1)) AS j) GROUP BY asset_id, j HAVING count(*) = max(bl))"""


@query("au.loudness_rates", f"""WITH {SND}, rated AS (SELECT *, CASE WHEN asset_id < 'p' THEN 48 ELSE 133 END AS sr FROM snd), {_rate_blocks('bm', 0.4)}, {_rate_blocks('bs', 3.0)}, {INTEGRATED},
  pm AS (SELECT asset_id, max(energy) AS pm FROM bm GROUP BY 1), ps AS (SELECT asset_id, max(energy) AS ps FROM bs GROUP BY 1)
  SELECT asset_id, round({_LUFS.format('m2')}, 9) AS integrated_lufs, round({_LUFS.format('pm')}, 9) AS max_momentary_lufs, round({_LUFS.format('coalesce(ps, 0)')}, 9) AS max_short_term_lufs FROM g2 JOIN pm USING (asset_id) LEFT JOIN ps USING (asset_id)""")
def loudness_rates(spark, sf):
    done = audio.loudness_by_rate(_rated(spark, sf, 48, 133))
    return done.select("asset_id", *[r9(c) for c in ("integrated_lufs", "max_momentary_lufs", "max_short_term_lufs")])


def _rates(spark, sf):
    kinds = t.read(spark, sf, "events").groupBy(F.col("event_type").alias("asset_id")).agg(F.min("event_id").alias("m"))
    is_view, is_error = F.col("asset_id") == "view", F.col("asset_id") == "error"
    return kinds.select("asset_id", F.when(is_error, 0).otherwise(48000).alias("sample_rate"), F.when(is_view, 0).otherwise(7).alias("channels"))


_RATES = "SELECT event_type AS asset_id, CASE WHEN event_type = 'error' THEN 0 ELSE 48000 END AS sample_rate, CASE WHEN event_type = 'view' THEN 0 ELSE 7 END AS channels, count(*) AS n FROM events GROUP BY 1"


@query("au.duration", f"SELECT asset_id, n AS frames, CASE WHEN sample_rate > 0 THEN round(n/CAST(sample_rate AS DOUBLE), 9) ELSE 0.0 END AS seconds FROM ({_RATES})")
def duration(spark, sf):
    return audio.duration(t.snd_ev(spark, sf), _rates(spark, sf)).select("asset_id", "frames", r9("seconds"))


@query("au.validate", f"""WITH r AS ({_RATES}) SELECT asset_id, 'LAYOUT' AS code, 'audio buffer has zero channels' AS reason FROM r WHERE channels = 0 UNION ALL SELECT asset_id, 'LAYOUT', 'sample rate is zero' FROM r WHERE sample_rate = 0
  UNION ALL SELECT asset_id, 'LAYOUT', 'sample count does not divide by channels' FROM r WHERE channels > 0 AND n % channels <> 0""")
def validate(spark, sf):
    return audio.validate(t.snd_ev(spark, sf), _rates(spark, sf))


# Fourier operators on frames of 50x21, padded to 64x32


def dft(src: str, out: str, pos: str, n: int, keys: str, sign: int = -1, scale: str = "1.0") -> str:
    """1-D transform of complex rows along ``pos``; zero padding is implied by absent rows."""
    ang = f"2*pi()*((kk*{pos}) % {n})/{n}.0"
    return f"""{out} AS (SELECT {keys}, kk AS {pos}, sum(re*cos({ang}) - ({sign})*im*sin({ang}))*{scale} AS re, sum(im*cos({ang}) + ({sign})*re*sin({ang}))*{scale} AS im
    FROM {src} CROSS JOIN (SELECT unnest(range({n})) AS kk) GROUP BY {keys}, kk)"""


_CHANNELS = "pl AS (SELECT asset_id, frame_no, u.ch AS ch, y, x, u.v AS re, CAST(0.0 AS DOUBLE) AS im FROM px_emb, LATERAL (SELECT unnest(['r','g','b']) AS ch, unnest([r,g,b]) AS v) u)"
_CH = "asset_id, frame_no, ch"


@query("fx.dft_lines", f"WITH {PX_EMB}, {_CHANNELS}, {dft('pl', 'sp', 'x', 32, f'{_CH}, y')} SELECT {_CH}, y, CAST(x AS INTEGER) AS k, round(re, 9) + 0.0 AS re, round(im, 9) + 0.0 AS im FROM sp")
def dft_lines(spark, sf):
    return spectral.dft_lines(t.px_emb(spark, sf)).select(*FRAME, "ch", "y", "k", *[(F.round(c, 9) + 0.0).alias(c) for c in ("re", "im")])


def _psf(name: str, n: int, sigma: float) -> str:
    return f"""{name}_t AS (SELECT i, exp(-pow(CASE WHEN i <= {n // 2} THEN i ELSE i-{n} END, 2)/(2.0*{sigma}*{sigma})) AS v FROM (SELECT unnest(range({n})) AS i)), {name}_n AS (SELECT i, v/sum(v) OVER () AS v FROM {name}_t),
  {name} AS (SELECT k, sum(v*cos(2*pi()*((k*i) % {n})/{n}.0)) AS h FROM {name}_n CROSS JOIN (SELECT unnest(range({n})) AS k) GROUP BY k)"""


@query("fx.wiener", f"""WITH {PX_EMB}, {_CHANNELS}, {dft('pl', 'sx', 'x', 32, f'{_CH}, y')}, {dft('sx', 'sy', 'y', 64, f'{_CH}, x')}, {_psf('hx', 32, 1.0)}, {_psf('hy', 64, 1.0)},
  fl AS (SELECT {_CH}, y, x, re*g AS re, im*g AS im FROM (SELECT sy.*, CASE WHEN x = 0 AND y = 0 THEN 1.0 ELSE hx.h*hy.h/(pow(hx.h*hy.h, 2) + 0.01) END AS g FROM sy JOIN hx ON hx.k = x JOIN hy ON hy.k = y)),
  {dft('fl', 'ix', 'x', 32, f'{_CH}, y', 1, '(1/32.0)')}, {dft('ix', 'iy', 'y', 64, f'{_CH}, x', 1, '(1/64.0)')}
  SELECT asset_id, frame_no, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {", ".join(f"round({clamp01(f'''max(CASE WHEN ch = '{c}' THEN re END)''')}, 9) AS {c}" for c in "rgb")}, 1.0 AS a FROM iy WHERE y < 50 AND x < 22 GROUP BY asset_id, frame_no, y, x""")
def wiener(spark, sf):
    return pixels(spectral.wiener(t.px_emb_whole(spark, sf), 1.0, 0.01))


RL_STEPS = 3


def _rl() -> str:
    """Each step blurs the estimate on the torus, divides, blurs the ratio and multiplies."""
    parts = [_psf("gx", 32, 1.0), _psf("gy", 64, 1.0)]
    parts = [p[: p.rindex(",\n")] for p in parts]  # taps only

    def blur(src, out, pos, other, n):
        taps = "gx_n" if pos == "x" else "gy_n"
        limit = 22 if pos == "x" else 50
        return f"{out} AS (SELECT {_CH}, {other}, tt AS {pos}, sum(re*v) AS re FROM {src} CROSS JOIN (SELECT unnest(range({limit})) AS tt) JOIN {taps} ON i = (tt - {pos} + {n}) % {n} GROUP BY {_CH}, {other}, tt)"

    parts.append(f"e0 AS (SELECT {_CH}, y, x, re FROM pl)")
    key = f"{_CH}, y, x"
    for s in range(RL_STEPS):
        parts += [
            blur(f"e{s}", f"c{s}x", "x", "y", 32), blur(f"c{s}x", f"c{s}", "y", "x", 64),
            f"q{s} AS (SELECT {key}, pl.re/greatest(c.re, 1e-6) AS re FROM pl JOIN c{s} c USING ({key}))",
            blur(f"q{s}", f"d{s}x", "x", "y", 32), blur(f"d{s}x", f"d{s}", "y", "x", 64),
            f"e{s + 1} AS (SELECT {key}, e.re*(1.0 + (d.re - 1.0)*(1.0-0.1)) AS re FROM e{s} e JOIN d{s} d USING ({key}))",
        ]
    return ",\n".join(parts)


@query("fx.richardson_lucy", f"""WITH {PX_EMB}, {_CHANNELS}, {_rl()} SELECT asset_id, frame_no, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x,
  {", ".join(f"round({clamp01(f'''max(CASE WHEN ch = '{c}' THEN re END)''')}, 8) AS {c}" for c in "rgb")} FROM e{RL_STEPS} GROUP BY asset_id, frame_no, y, x""")
def richardson_lucy(spark, sf):
    return pixels(spectral.richardson_lucy(t.px_emb(spark, sf), 1.0, RL_STEPS, 0.1), RGB, digits=8)


_FY = "asset_id, frame_no, y"
_FX = "asset_id, frame_no, x"
# Assets of frames in one size alone take part. Frames are padded to 32x64: only the last frame of the table is shorter than 50
# lines, and alone in its asset it meets only itself. A frame of a single line or column has no window,
# and the first frame of an asset always gets no shift and peak 1.
SHIFTS = f"""{MIXED}, firsts AS (SELECT asset_id, min(frame_no) AS f0 FROM dims GROUP BY 1),
  wn AS (SELECT asset_id, frame_no, y, x, ({LUMA})*(0.5-0.5*cos(2*pi()*x/(w-1.0)))*(0.5-0.5*cos(2*pi()*y/greatest(h-1.0, 1.0))) AS re, CAST(0.0 AS DOUBLE) AS im
    FROM px_emb JOIN dims USING (asset_id, frame_no) WHERE asset_id NOT IN (SELECT asset_id FROM mixed)), {dft('wn', 'fx1', 'x', 32, _FY)}, {dft('fx1', 'fx2', 'y', 64, _FX)},
  cp AS (SELECT b.asset_id, b.frame_no, b.y, b.x, a.re*b.re + a.im*b.im AS cr, a.im*b.re - a.re*b.im AS ci FROM fx2 b JOIN firsts f ON f.asset_id=b.asset_id JOIN fx2 a ON a.asset_id=b.asset_id AND a.frame_no=f.f0 AND a.y=b.y AND a.x=b.x),
  cn AS (SELECT asset_id, frame_no, y, x, cr/(sqrt(cr*cr+ci*ci)+1e-12) AS re, ci/(sqrt(cr*cr+ci*ci)+1e-12) AS im FROM cp), {dft('cn', 'cx1', 'x', 32, _FY, 1, '(1/32.0)')}, {dft('cx1', 'cx2', 'y', 64, _FX, 1, '(1/64.0)')},
  sf AS MATERIALIZED (SELECT asset_id, frame_no, y, x, round(re, 12) AS v FROM cx2), pk AS (SELECT asset_id, frame_no, y AS py, x AS px, v AS pv FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, frame_no ORDER BY v DESC, y, x) AS rn FROM sf) WHERE rn = 1),
  nb AS (SELECT pk.*, a.v AS xm, b.v AS xp, c.v AS ym, d.v AS yp FROM pk JOIN sf a ON a.frame_no=pk.frame_no AND a.y=py AND a.x=(px+31)%32 JOIN sf b ON b.frame_no=pk.frame_no AND b.y=py AND b.x=(px+1)%32 JOIN sf c ON c.frame_no=pk.frame_no AND c.x=px AND c.y=(py+63)%64 JOIN sf d ON d.frame_no=pk.frame_no AND d.x=px AND d.y=(py+1)%64),
  sb AS (SELECT *, px + CASE WHEN abs(xm-2*pv+xp) < 1e-12 THEN 0.0 ELSE 0.5*(xm-xp)/(xm-2*pv+xp) END AS ux, py + CASE WHEN abs(ym-2*pv+yp) < 1e-12 THEN 0.0 ELSE 0.5*(ym-yp)/(ym-2*pv+yp) END AS uy FROM nb),
  shifts AS MATERIALIZED (SELECT asset_id, frame_no, CASE WHEN frame_no = f0 THEN 0.0 ELSE -CASE WHEN ux > 16 THEN ux-32 ELSE ux END END AS dx, CASE WHEN frame_no = f0 THEN 0.0 ELSE -CASE WHEN uy > 32 THEN uy-64 ELSE uy END END AS dy, CASE WHEN frame_no = f0 THEN 1.0 ELSE {clamp01('pv')} END AS peak FROM sb JOIN firsts USING (asset_id))"""


@query("fx.phase_correlate", f"WITH {BASE}, {SHIFTS} SELECT asset_id, frame_no, round(dx, 6) AS dx, round(dy, 6) AS dy, round(peak, 9) AS peak FROM shifts")
def phase_correlate(spark, sf):
    return spectral.phase_correlate(t.px_emb(spark, sf)).select(*FRAME, r9("dx", 6), r9("dy", 6), r9("peak"))


@query("fx.super_resolve", f"""WITH {BASE}, {SHIFTS}, {_scaled(_lanczos, -2, 3, 2.0, True, source='px_emb', out='up')},
  mv AS (SELECT u.asset_id, u.frame_no, u.y, u.x, q.r, q.g, q.b FROM up u JOIN shifts s USING (asset_id, frame_no) JOIN dims d USING (asset_id, frame_no) JOIN up q ON q.asset_id=u.asset_id AND q.frame_no=u.frame_no AND q.x=least(greatest(u.x+round(s.dx*2),0),d.w*2-1) AND q.y=least(greatest(u.y+round(s.dy*2),0),d.h*2-1)
    WHERE u.asset_id IN (SELECT asset_id FROM dims GROUP BY asset_id HAVING count(*) >= 2))
  SELECT asset_id, y, x, {", ".join(f"round({clamp01(f'median({c})')}, 9) AS {c}" for c in "rgb")} FROM mv GROUP BY ALL""")
def super_resolve(spark, sf):
    return spectral.super_resolve(t.px_emb(spark, sf), 2, "median").select("asset_id", "y", "x", *[r9(c) for c in RGB])


@query("fx.stabilize", f"""WITH {BASE}, {SHIFTS}, a AS (SELECT asset_id, frame_no, y, x, w, h, x+dx AS sx, y+dy AS sy FROM px_emb JOIN dims USING (asset_id, frame_no) JOIN shifts USING (asset_id, frame_no)),
  s AS (SELECT *, floor(sx) AS x0, floor(sy) AS y0, sx-floor(sx) AS fx, sy-floor(sy) AS fy FROM a), {_bilinear('', '', 'o', source='s')} SELECT {KEY}, {rounded('rgb', 6)} FROM o""")
def stabilize(spark, sf):
    return pixels(spectral.stabilize(t.px_emb(spark, sf)), RGB, digits=6)
