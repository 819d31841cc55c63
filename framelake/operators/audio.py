"""Sample-table operators: loudness, true peak, short-time spectra and noise reduction.

A channel is cut into fixed chunks of samples; what a chunk needs from its neighbors travels as a
halo or as a few state values, so one very long recording spreads over many tasks.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.errors import INVALID_PARAMETER, LAYOUT, OperatorError
from framelake.session import cut_lineage

CHANNEL = ["asset_id", "channel"]

# K-weighting at 48 kHz (ITU-R BS.1770-4, annex 1), as b0 b1 b2 a1 a2.
SHELF_48K = (1.5351276032805755, -2.6916967024544904, 1.1984293449886033, -1.6906542406570777, 0.7324478962637622)
HIGHPASS_48K = (1.0, -2.0, 1.0, -1.9900477713435634, 0.9900733742522867)
# Design frequency, Q and gain in dB for other rates.
SHELF_DESIGN = (1681.9744509555332, 0.7071752528974341, 3.99984385397353)
HIGHPASS_DESIGN = (38.13547087613142, 0.5003273001200582)
# Loudness offset and gates.
LUFS_OFFSET, ABSOLUTE_GATE, RELATIVE_GATE = -0.691, -70.0, 10.0


def k_weighting(rate: int) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Shelf and high-pass coefficients for a sample rate (cookbook biquads off 48 kHz)."""
    if rate == 48000:
        return SHELF_48K, HIGHPASS_48K
    f0, q, gain = SHELF_DESIGN
    amp, w = 10 ** (gain / 40), 2 * math.pi * f0 / rate
    cos, slope = math.cos(w), 2 * math.sqrt(amp) * math.sin(w) / (2 * q)
    up, down = amp + 1, amp - 1
    a0 = up - down * cos + slope
    shelf = (
        amp * (up + down * cos + slope) / a0, -2 * amp * (down + up * cos) / a0, amp * (up + down * cos - slope) / a0,
        2 * (down - up * cos) / a0, (up - down * cos - slope) / a0,
    )
    f0, q = HIGHPASS_DESIGN
    w = 2 * math.pi * f0 / rate
    cos, alpha = math.cos(w), math.sin(w) / (2 * q)
    a0 = 1 + alpha
    high = ((1 + cos) / 2 / a0, -(1 + cos) / a0, (1 + cos) / 2 / a0, -2 * cos / a0, (1 - alpha) / a0)
    return shelf, high


def _cascade(x: np.ndarray, state: np.ndarray, sections) -> tuple[np.ndarray, np.ndarray]:
    """Both biquads over a batch of chunks at once (transposed form, two state values per section)."""
    y = np.empty_like(x)
    s = state.T.copy()
    for t in range(x.shape[1]):
        v = x[:, t]
        for k, (b0, b1, b2, a1, a2) in enumerate(sections):
            out = b0 * v + s[2 * k]
            s[2 * k] = b1 * v - a1 * out + s[2 * k + 1]
            s[2 * k + 1] = b2 * v - a2 * out
            v = out
        y[:, t] = v
    return y, s.T


CHUNK, CHUNKS_PER_GROUP = 1024, 1024
#: Chunks that one task filters at a time: 256 of 1,024 samples are 2 MB, however many rows Spark hands over at once.
CHUNKS_AT_ONCE = 256


def _few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, CHUNKS_AT_ONCE):
            yield batch.slice(start, CHUNKS_AT_ONCE)


def _with_lists(part: pa.RecordBatch, kept: list[str], **lists: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """The kept columns and new list columns, each given as all values and the rows' lengths."""
    made = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype("int32"), pa.array(v)) for v, n in lists.values()]
    return pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made], names=[*kept, *lists])


def with_rates(samples: DataFrame, rates: DataFrame) -> DataFrame:
    """Samples with the ``sample_rate`` of their recording; recordings without a positive rate are left out (``rate_errors``)."""
    return samples.join(rates.where("sample_rate > 0").select("asset_id", F.col("sample_rate").cast("int").alias("sample_rate")), "asset_id")


def rate_errors(samples: DataFrame, rates: DataFrame) -> DataFrame:
    """Recordings without a positive rate."""
    seen = samples.select("asset_id").distinct().join(rates.select("asset_id", "sample_rate"), "asset_id", "left")
    return seen.where("sample_rate IS NULL OR sample_rate <= 0").select(
        "asset_id", F.lit(LAYOUT).alias("code"), F.lit("the recording has no positive sample rate").alias("reason")
    )


@functools.lru_cache(maxsize=64)
def _ringing(rate: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """What each state value adds to a chunk's samples, and the matrix that carries a state over a chunk."""
    impulse, step = _cascade(np.zeros((4, chunk)), np.eye(4), k_weighting(rate))
    return impulse, step.T


def k_weight(samples: DataFrame, rate: int = 48000, chunk: int = CHUNK, per_group: int = CHUNKS_PER_GROUP) -> DataFrame:
    """K-weighted samples, each recording at its ``sample_rate`` where ``samples`` has that column, else all at ``rate``.

    The filter is linear: a chunk started from silence plus the ringing of the state it inherits. Chunks are filtered
    once and written; what a chunk inherits is a prefix scan over the chunks' four end values (``_inherited``).
    """
    keys = [*CHANNEL, "sample_rate"]
    rated = samples if "sample_rate" in samples.columns else samples.withColumn("sample_rate", F.lit(rate))

    types = {f.name: f.dataType.simpleString() for f in rated.schema}
    lead = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def from_silence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _few_rows(batches):
            x, rates = part.column("x"), part.column("sample_rate").to_numpy()
            lengths, block, ends = np.diff(x.offsets.to_numpy()), np.zeros((len(x), chunk)), np.zeros((len(x), 4))
            filled = np.arange(chunk) < lengths[:, None]
            block[filled] = x.flatten().to_numpy(zero_copy_only=False)
            for r in np.unique(rates):
                mine = rates == r
                block[mine], ends[mine] = _cascade(block[mine], np.zeros((mine.sum(), 4)), k_weighting(int(r)))
            yield _with_lists(part, [*keys, "ck", "n0"], y=(block[filled], lengths), s=(ends.ravel(), np.full(len(x), 4)))

    def add_ringing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _few_rows(batches):
            y, rates = part.column("y"), part.column("sample_rate").to_numpy()
            states = part.column("state").flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            lengths, ring = np.diff(y.offsets.to_numpy()), np.zeros((len(y), chunk))
            for r in np.unique(rates):
                mine = rates == r
                ring[mine] = states[mine] @ _ringing(int(r), chunk)[0]
            done = y.flatten().to_numpy(zero_copy_only=False) + ring[np.arange(chunk) < lengths[:, None]]
            yield _with_lists(part, [*keys, "n0"], y=(done, lengths))

    filtered = (
        rated.withColumn("ck", F.expr(f"n div {chunk}")).groupBy(*keys, "ck")
        .agg(F.array_sort(F.collect_list(F.struct("n", "v"))).alias("c"))
        .select(*keys, "ck", F.get("c.n", 0).cast("bigint").alias("n0"), F.col("c.v").cast("array<double>").alias("x"))
        .mapInArrow(from_silence, f"{lead}, ck BIGINT, n0 BIGINT, y ARRAY<DOUBLE>, s ARRAY<DOUBLE>")
    )
    chunks = cut_lineage(filtered)
    last = chunks.agg(F.max("ck")).first()[0] or 0
    states = _inherited(chunks.select(*keys, "ck", "s"), last, chunk, per_group)
    voiced = chunks.drop("s").join(states, [*keys, "ck"]).select(*keys, "n0", "y", "state").mapInArrow(add_ringing, f"{lead}, n0 BIGINT, y ARRAY<DOUBLE>")
    done = voiced.select(*keys, "n0", F.posexplode("y").alias("i", "v")).select(*keys, (F.col("n0") + F.col("i")).alias("n"), "v")
    return done.select(*samples.columns)


def _inherited(ends: DataFrame, last: int, span: int, per_group: int) -> DataFrame:
    """The state that each block of ``span`` samples inherits, from the blocks' own end states.

    Blocks are folded in groups of ``per_group``; the groups' end states are blocks of the next level, until one group holds
    a channel (``last`` is the largest block number). So a level moves four numbers per block, no fold is longer than a
    group, and levels grow with the logarithm of the length.
    """
    keys = [*CHANNEL, "sample_rate"]

    def power(rate, n: int) -> np.ndarray:
        return np.linalg.matrix_power(_carry(int(rate), span), n)

    @F.pandas_udf("now ARRAY<DOUBLE>, seen ARRAY<ARRAY<DOUBLE>>")
    def fold(numbers: pd.Series, own: pd.Series, rates: pd.Series) -> pd.DataFrame:
        now, seen = [], []
        for cks, rows, rate in zip(numbers, own, rates):
            first = int(cks[0]) // per_group * per_group
            state, at, trail, step = np.zeros(4), first, [], _carry(int(rate), span)
            for ck, row in zip(cks, rows):
                if ck > at:
                    state = power(rate, int(ck) - at) @ state
                trail.append(state)
                state, at = step @ state + np.asarray(row), int(ck) + 1
            now.append(power(rate, first + per_group - at) @ state)
            seen.append(trail)
        return pd.DataFrame({"now": now, "seen": seen})

    @F.pandas_udf("array<double>")
    def advance(own: pd.Series, start: pd.Series, moves: pd.Series, rates: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for o, s, n, r in zip(own, start, moves, rates):
            if (r, n) not in known:
                known[r, n] = power(r, int(n))
            out.append(np.asarray(o) + known[r, n] @ np.asarray(s))
        return pd.Series(out)

    groups = (
        ends.withColumn("gk", F.expr(f"ck div {per_group}")).groupBy(*keys, "gk")
        .agg(F.array_sort(F.collect_list(F.struct("ck", "s"))).alias("c"))
        .withColumn("f", fold(F.col("c.ck"), F.col("c.s"), F.col("sample_rate")))
        .select(*keys, "gk", F.col("c.ck").alias("ck"), F.col("f.seen").alias("seen"), F.col("f.now").alias("now"))
    )
    one = F.explode(F.arrays_zip("ck", "seen")).alias("e")
    if last < per_group:
        return groups.select(*keys, one).select(*keys, "e.ck", F.col("e.seen").alias("state"))
    groups = cut_lineage(groups)
    upper = _inherited(groups.select(*keys, F.col("gk").alias("ck"), F.col("now").alias("s")), last // per_group, span * per_group, per_group)
    starts = upper.select(*keys, F.col("ck").alias("gk"), F.col("state").alias("start"))
    each = groups.drop("now").join(starts, [*keys, "gk"]).select(*keys, "start", one)
    moved = advance(F.col("e.seen"), F.col("start"), F.expr(f"e.ck % {per_group}"), F.col("sample_rate"))
    return each.select(*keys, F.col("e.ck").alias("ck"), moved.alias("state"))


@functools.lru_cache(maxsize=256)
def _carry(rate: int, span: int) -> np.ndarray:
    """The matrix that carries a state over ``span`` samples."""
    return np.linalg.matrix_power(_ringing(rate, 1)[1], span)


MOST_CHANNELS = 2


def layout_errors(samples: DataFrame) -> DataFrame:
    """Assets with more channels than loudness is defined for here: mono or stereo."""
    channels = samples.select(*CHANNEL).distinct().groupBy("asset_id").agg(F.count(F.lit(1)).alias("channels"))
    return channels.where(F.col("channels") > MOST_CHANNELS).select(
        "asset_id", F.lit(LAYOUT).alias("code"), F.format_string("%d channels, at most %d are measured", "channels", F.lit(MOST_CHANNELS)).alias("reason")
    )


def _measurable(steps: DataFrame) -> DataFrame:
    """Assets that stay within ``MOST_CHANNELS`` in every step."""
    return steps.groupBy("asset_id").agg(F.max("ch").alias("_ch")).where(F.col("_ch") <= MOST_CHANNELS).select("asset_id")


def block_energy(samples: DataFrame, block: int, step: int, name: str = "energy") -> DataFrame:
    """Mean square per full block, channels summed; assets in ``layout_errors`` are left out.

    Samples first collapse to one partial sum per step (combined before the shuffle); only those
    partials are handed to the ``block/step`` blocks they belong to.
    """
    return blocks_of(step_energy(samples, step), block, step, name)


def step_energy(samples: DataFrame, step: int) -> DataFrame:
    """Sum of squares, sample count and channel count per step of an asset."""
    per_channel = samples.groupBy(*CHANNEL, F.expr(f"n div {step}").alias("sk")).agg(
        F.sum(F.col("v") * F.col("v")).alias("e"), F.count(F.lit(1)).alias("cnt")
    )
    return per_channel.groupBy("asset_id", "sk").agg(F.sum("e").alias("e"), F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("ch"))


def blocks_of(steps: DataFrame, block: int, step: int, name: str = "energy") -> DataFrame:
    """Full blocks from step sums."""
    if block % step:
        raise OperatorError(INVALID_PARAMETER, "block must be a whole number of steps")
    span = block // step
    return (
        steps.withColumn("block", F.explode(F.sequence(F.greatest(F.col("sk") - span + 1, F.lit(0)), F.col("sk"))))
        .groupBy("asset_id", "block").agg((F.sum("e") / block).alias(name), F.sum("cnt").alias("_cnt"), F.max("ch").alias("_ch"))
        .where((F.col("_cnt") == F.col("_ch") * block) & (F.col("_ch") <= MOST_CHANNELS)).select("asset_id", "block", name)
    )


def lufs(energy: Column) -> Column:
    return F.when(energy > 0, LUFS_OFFSET + 10.0 * F.log10(energy)).otherwise(F.lit(float("-inf")))


def integrated(blocks: DataFrame) -> DataFrame:
    """Two-gate integrated loudness per asset; ``-inf`` when no block survives."""
    loud = blocks.withColumn("_l", lufs(F.col("energy")))
    gate = F.when(F.col("_l") > ABSOLUTE_GATE, F.col("energy"))
    first = loud.groupBy("asset_id").agg(F.avg(gate).alias("_m"))
    kept = loud.join(first, "asset_id").where(
        (F.col("_l") > ABSOLUTE_GATE) & (F.col("_l") > lufs(F.col("_m")) - RELATIVE_GATE)
    )
    second = kept.groupBy("asset_id").agg(F.avg("energy").alias("_m2"))
    return first.join(second, "asset_id", "left").select("asset_id", lufs(F.coalesce("_m2", F.lit(0.0))).alias("integrated_lufs"))


def loudness(weighted: DataFrame, momentary: int, short_term: int, step: int) -> DataFrame:
    """Integrated loudness with the loudest momentary and short-term blocks.

    The samples are read once, into step sums; everything after works on those. Assets in ``layout_errors`` are left out.
    """
    steps = cut_lineage(step_energy(weighted, step))
    blocks = blocks_of(steps, momentary, step)
    peak_m = blocks.groupBy("asset_id").agg(lufs(F.max("energy")).alias("max_momentary_lufs"))
    peak_s = blocks_of(steps, short_term, step).groupBy("asset_id").agg(lufs(F.max("energy")).alias("max_short_term_lufs"))
    silent = F.lit(float("-inf"))
    return (
        _measurable(steps).join(integrated(blocks), "asset_id", "left").join(peak_m, "asset_id", "left").join(peak_s, "asset_id", "left")
        .select("asset_id", *[F.coalesce(c, silent).alias(c) for c in ("integrated_lufs", "max_momentary_lufs", "max_short_term_lufs")])
    )


# Seconds of momentary and short-term blocks, and of the step between them.
MOMENTARY_SECS, SHORT_TERM_SECS, STEP_SECS = 0.4, 3.0, 0.1


def loudness_by_rate(weighted: DataFrame) -> DataFrame:
    """Integrated, momentary and short-term loudness with blocks in seconds of each recording's own ``sample_rate``.

    A block need not be a whole number of steps: each step is summed in the parts that block ends cut it into, so blocks
    are exact at any rate. The samples are read once; recordings in ``layout_errors`` are left out.
    """
    def size(seconds: float) -> Column:
        return F.greatest(F.round(F.lit(seconds) * F.col("sample_rate")).cast("bigint"), F.lit(1).cast("bigint"))

    step, sizes = size(STEP_SECS), (size(MOMENTARY_SECS), size(SHORT_TERM_SECS))
    offset = F.col("n") % step
    part = sum((F.when(offset >= b % step, 1).otherwise(0) for b in sizes[1:]), F.when(offset >= sizes[0] % step, 1).otherwise(0))
    per_channel = weighted.groupBy(*CHANNEL, "sample_rate", F.floor(F.col("n") / step).alias("sk"), part.alias("part")).agg(
        F.sum(F.col("v") * F.col("v")).alias("e"), F.count(F.lit(1)).alias("cnt"), F.min(offset).alias("offset")
    )
    steps = cut_lineage(per_channel.groupBy("asset_id", "sample_rate", "sk", "part").agg(
        F.sum("e").alias("e"), F.sum("cnt").alias("cnt"), F.count(F.lit(1)).alias("ch"), F.min("offset").alias("offset")
    ))

    def blocks(block: Column) -> DataFrame:
        whole = F.floor(block / step)
        first = F.when(F.col("offset") < block % step, F.col("sk") - whole).otherwise(F.col("sk") - whole + 1)
        reach = F.sequence(F.greatest(first, F.lit(0).cast("bigint")), F.col("sk"))
        return (
            steps.withColumn("_size", block).withColumn("block", F.explode(F.when(first <= F.col("sk"), reach)))
            .groupBy("asset_id", "block").agg((F.sum("e") / F.max("_size")).alias("energy"), F.sum("cnt").alias("_cnt"), F.max("ch").alias("_ch"), F.max("_size").alias("_size"))
            .where((F.col("_cnt") == F.col("_ch") * F.col("_size")) & (F.col("_ch") <= MOST_CHANNELS)).select("asset_id", "block", "energy")
        )

    momentary = blocks(sizes[0])
    peak_m = momentary.groupBy("asset_id").agg(lufs(F.max("energy")).alias("max_momentary_lufs"))
    peak_s = blocks(sizes[1]).groupBy("asset_id").agg(lufs(F.max("energy")).alias("max_short_term_lufs"))
    silent = F.lit(float("-inf"))
    return (
        _measurable(steps).join(integrated(momentary), "asset_id", "left").join(peak_m, "asset_id", "left").join(peak_s, "asset_id", "left")
        .select("asset_id", *[F.coalesce(c, silent).alias(c) for c in ("integrated_lufs", "max_momentary_lufs", "max_short_term_lufs")])
    )


PHASES, TAPS = 4, 8  # fixed values: oversampling and taps per phase


def interpolation_taps() -> list[list[float]]:
    """Windowed-sinc taps per phase, scaled so all of them sum to the oversampling factor."""
    size = PHASES * TAPS
    raw = []
    for i in range(size):
        d = (i - (size - 1) / 2) / PHASES
        raw.append((math.sin(math.pi * d) / (math.pi * d) if d else 1.0) * (0.5 - 0.5 * math.cos(2 * math.pi * i / (size - 1))))
    total = sum(raw)
    return [[raw[p + k * PHASES] * PHASES / total for k in range(TAPS)] for p in range(PHASES)]


WINDOW_BITS = 16


def chunk_halo(samples: DataFrame, before: int, after: int, bits: int = WINDOW_BITS) -> DataFrame:
    """Send samples to their chunk of ``2**bits`` and to neighbors that read them."""
    reach = F.sequence(F.shiftright(F.greatest(F.col("n") - after, F.lit(0)), bits), F.shiftright(F.col("n") + before, bits))
    return samples.withColumn("wk", F.explode(reach)).repartition(*CHANNEL, "wk")


def true_peak(samples: DataFrame) -> DataFrame:
    """Peak in dBFS over the samples and three interpolated phases; zero beyond the ends."""
    center = TAPS // 2
    parts = chunk_halo(samples, center, TAPS - 1 - center)
    line = Window.partitionBy(*CHANNEL, "wk").orderBy("n")
    shifts = [k - center for k in range(TAPS)]
    around = {s: F.coalesce(F.lag("v", -s).over(line) if s < 0 else F.lead("v", s).over(line), F.lit(0.0)) if s else F.col("v") for s in shifts}
    near = parts.withColumns({f"t{k}": around[s] for k, s in enumerate(shifts)}).where(F.shiftright("n", WINDOW_BITS) == F.col("wk"))
    levels = [F.abs(F.col("v"))]
    for taps in interpolation_taps()[1:]:
        levels.append(F.abs(sum((F.col(f"t{k}") * w for k, w in enumerate(taps) if k), F.col("t0") * taps[0])))
    peak = near.groupBy("asset_id").agg(F.max(F.greatest(*levels)).alias("peak"))
    return peak.select("asset_id", F.when(F.col("peak") > 0, 20.0 * F.log10("peak")).otherwise(F.lit(float("-inf"))).alias("true_peak_dbfs"))


def normalize_lufs(samples: DataFrame, measured: DataFrame, target: float) -> DataFrame:
    """Gain every asset to ``target``, never past full scale; silent assets stay as they are."""
    if not math.isfinite(target):
        raise OperatorError(INVALID_PARAMETER, "target_lufs must be a finite number")
    peaks = samples.groupBy("asset_id").agg(F.max(F.abs("v")).alias("_peak"))
    wanted = F.pow(F.lit(10.0), (F.lit(target) - F.col("integrated_lufs")) / 20.0)
    room = F.when(F.col("_peak") > 0, (1.0 - 1e-4) / F.col("_peak"))
    gain = F.when(F.col("integrated_lufs") == float("-inf"), F.lit(1.0)).otherwise(F.least(wanted, F.coalesce(room, wanted)))
    gains = measured.join(peaks, "asset_id").select("asset_id", gain.alias("gain"))
    return samples.join(gains, "asset_id").select(*CHANNEL, "n", (F.col("v") * F.col("gain")).alias("v"))


def hann(size: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(size) / max(size - 1, 1))


def _frames(samples: DataFrame, size: int) -> DataFrame:
    """Overlapping frames (half a frame apart), the last one zero-padded, as ordered arrays."""
    hop = size // 2
    ends = samples.groupBy(*CHANNEL).agg((F.max("n") + 1).alias("len"))
    count = F.when(F.col("len") <= size, F.lit(1)).otherwise(F.ceil((F.col("len") - size) / hop) + 1).cast("bigint")
    counted = samples.join(ends.select(*CHANNEL, count.alias("frames"), "len"), CHANNEL)
    last = F.least(F.expr(f"n div {hop}"), F.col("frames") - 1)
    both = F.sequence(F.greatest(F.expr(f"n div {hop}") - 1, F.lit(0)), last)
    placed = counted.withColumn("frame", F.explode(F.when(F.size(both) > 0, both)))
    placed = placed.where((F.col("n") - F.col("frame") * hop >= 0) & (F.col("n") - F.col("frame") * hop < size))
    extra = [F.max(c).alias(c) for c in samples.columns if c == "sample_rate"]
    return placed.groupBy(*CHANNEL, "frame").agg(
        F.array_sort(F.collect_list(F.struct("n", "v"))).alias("c"), F.max("frames").alias("frames"), F.max("len").alias("len"), *extra
    ).withColumn("x", F.col("c.v")).drop("c")


def _check_frame(size: int) -> None:
    if size < 4 or size & (size - 1):
        raise OperatorError(INVALID_PARAMETER, "frame_size must be a power of two, at least 4")


def _spectra(samples: DataFrame, size: int) -> DataFrame:
    _check_frame(size)
    window = hann(size)

    @F.pandas_udf("re ARRAY<DOUBLE>, im ARRAY<DOUBLE>")
    def spectrum(x: pd.Series) -> pd.DataFrame:
        block = np.zeros((len(x), size))
        for i, row in enumerate(x):
            block[i, : len(row)] = row
        z = np.fft.rfft(block * window, axis=1)
        return pd.DataFrame({"re": list(z.real), "im": list(z.imag)})

    return _frames(samples, size).withColumn("z", spectrum("x")).withColumns({"re": F.col("z.re"), "im": F.col("z.im")}).drop("x", "z")


def stft(samples: DataFrame, frame_size: int = 1024) -> DataFrame:
    """Magnitude and phase per frame and frequency bin."""
    bins = _spectra(samples, frame_size).select(*CHANNEL, "frame", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "z"))
    return bins.select(*CHANNEL, "frame", "bin", F.hypot("z.re", "z.im").alias("mag"), F.atan2("z.im", "z.re").alias("phase"), "z.re", "z.im")


def spectral_subtract(
    samples: DataFrame, rate: int | None = None, frame_size: int = 1024, over_subtract: float = 1.5, floor: float = 0.05, noise_secs: float = 0.5
) -> DataFrame:
    """Noise reduction: subtract the mean spectrum of the leading frames, keep the phase, overlap-add.

    How many frames ``noise_secs`` are follows from ``rate``, or from each recording's ``sample_rate`` without one.
    """
    _check_frame(frame_size)
    if not (over_subtract >= 0 and floor >= 0 and noise_secs > 0):
        raise OperatorError(INVALID_PARAMETER, "over_subtract and floor must be >= 0, noise_secs > 0")
    hop, window = frame_size // 2, hann(frame_size)
    rates = F.col("sample_rate") if rate is None else F.lit(rate)
    noise_samples = F.floor(F.lit(noise_secs) * rates + 0.5) - frame_size
    spectra = _spectra(samples if rate is None else samples.withColumn("sample_rate", rates), frame_size)
    lead = spectra.where(F.col("frame") < F.floor(F.greatest(noise_samples, F.lit(0)) / hop) + 1)
    noise = (
        lead.select(*CHANNEL, F.posexplode(F.arrays_zip("re", "im")).alias("bin", "z"))
        .groupBy(*CHANNEL, "bin").agg(F.avg(F.hypot("z.re", "z.im")).alias("m"))
        .groupBy(*CHANNEL).agg(F.array_sort(F.collect_list(F.struct("bin", "m"))).alias("c"))
        .select(*CHANNEL, F.col("c.m").alias("noise"))
    )

    @F.pandas_udf("array<double>")
    def clean(re: pd.Series, im: pd.Series, noise: pd.Series) -> pd.Series:
        z = np.stack(re.to_list()) + 1j * np.stack(im.to_list())
        hum = np.stack(noise.to_list())
        size = np.maximum(np.abs(z) - over_subtract * hum, floor * hum)
        return pd.Series(list(np.fft.irfft(size * np.exp(1j * np.angle(z)), frame_size, axis=1) * window))

    tidy = spectra.join(noise, CHANNEL).withColumn("y", clean("re", "im", "noise"))
    parts = tidy.select(*CHANNEL, "len", (F.col("frame") * hop).alias("start"), F.posexplode("y").alias("i", "y"))
    at = 0.5 - 0.5 * F.cos(2 * math.pi * F.col("i") / (frame_size - 1))
    return (
        parts.select(*CHANNEL, (F.col("start") + F.col("i")).alias("n"), "len", "y", (at * at).alias("w"))
        .where(F.col("n") < F.col("len")).groupBy(*CHANNEL, "n")
        .agg((F.sum("y") / F.greatest(F.sum("w"), F.lit(0.5))).alias("v"))
    )


def duration(samples: DataFrame, assets: DataFrame) -> DataFrame:
    """Frames and seconds per asset."""
    seen = samples.groupBy("asset_id").agg((F.max("n") + 1).alias("frames"))
    return assets.join(seen, "asset_id", "left").select(
        "asset_id", F.coalesce("frames", F.lit(0).cast("bigint")).alias("frames"),
        F.when(F.col("sample_rate") > 0, F.coalesce("frames", F.lit(0)) / F.col("sample_rate")).otherwise(F.lit(0.0)).alias("seconds"),
    )


def validate(samples: DataFrame, assets: DataFrame) -> DataFrame:
    """One row per problem: no channels, no rate, or a sample count that does not divide by channels."""
    seen = samples.groupBy("asset_id").agg(F.count(F.lit(1)).alias("samples"))
    joined = assets.join(seen, "asset_id", "left").withColumn("samples", F.coalesce("samples", F.lit(0).cast("bigint")))
    faults = F.array_compact(F.array(
        F.when(F.col("channels") == 0, F.lit("audio buffer has zero channels")),
        F.when(F.col("sample_rate") == 0, F.lit("sample rate is zero")),
        F.when((F.col("channels") > 0) & (F.col("samples") % F.col("channels") != 0), F.lit("sample count does not divide by channels")),
    ))
    return joined.select("asset_id", F.explode(faults).alias("reason")).select("asset_id", F.lit(LAYOUT).alias("code"), "reason")
