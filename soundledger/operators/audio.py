"""Acoustic features of captures.

A capture is one short recording and the unit of work. Spark spreads captures
over tasks, and inside a task each waveform is framed once; per-frame tracks
are then sliced for the whole file and for every sub-second segment, so both
tables come out of one pass over the audio.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Band edges in Hz, onset refractory time and voicing limits of the feature definition.
BANDS = [
    ("b_0_250", 0, 250), ("b_250_500", 250, 500), ("b_500_1k", 500, 1000),
    ("b_1k_2k", 1000, 2000), ("b_2k_4k", 2000, 4000), ("b_4k_8k", 4000, 8000),
]
PEAK_BANDS = [("peak_hz_300_800", 300.0, 800.0), ("peak_hz_800_1600", 800.0, 1600.0)]
REFRACTORY_MS, CLIP_LEVEL, VOICED_CONF = 150.0, 32_000.0, 0.3
ONE_DECIMAL = [
    "centroid_mean_hz", "centroid_std_hz", "rolloff85_mean_hz", "rolloff95_mean_hz", "peak_hz_300_800", "peak_hz_800_1600",
    "f0_mean_hz", "f0_std_hz", "f0_p50_hz", "f0_p95_hz", "hnr_db",
]
FOUR_DECIMALS = ["flatness_mean", "f0_voiced_frac", "rms_peak", "rms_mean", "rms_p50", "rms_p95", "noise_floor_p10", "active_frac", "zcr"]
DECIMALS = {
    **dict.fromkeys(ONE_DECIMAL, 1), **dict.fromkeys(FOUR_DECIMALS, 4), "start_s": 3, "end_s": 3, "dur_s": 3, "active_floor": 2, "clip_frac": 6,
    "file_dur_s": 3, "file_noise_floor": 2, "file_active_floor": 2,
}
FEATURES = [
    "start_s", "end_s", "dur_s", "rms_peak", "rms_mean", "rms_p50", "rms_p95", "noise_floor_p10", "active_frac", "onsets", "active_floor",
    "zcr", "clip_frac", "centroid_mean_hz", "centroid_std_hz", "rolloff85_mean_hz", "rolloff95_mean_hz", "flatness_mean",
    *[n for n, _, _ in BANDS], *[n for n, _, _ in PEAK_BANDS],
    "f0_voiced_frac", "f0_mean_hz", "f0_std_hz", "f0_p50_hz", "f0_p95_hz", "hnr_db", "file_dur_s", "file_noise_floor", "file_active_floor",
]


@dataclass(frozen=True)
class Grid:
    """Analysis grid. The defaults are those of 16 kHz captures."""

    seg_len_s: float = 0.96
    seg_hop_s: float = 0.48
    env_win_ms: float = 50.0
    env_hop_ms: float = 25.0
    nperseg: int = 1024
    overlap: int = 512
    f0_win_ms: float = 40.0
    f0_hop_ms: float = 20.0
    f0_low: float = 150.0
    f0_high: float = 1200.0
    energy_floor: float = 300.0
    floor_min: float = 150.0
    rounded: bool = True


def framed(x: np.ndarray, win: int, hop: int) -> np.ndarray:
    if len(x) < win:
        return np.empty((0, win), dtype=x.dtype)
    return np.lib.stride_tricks.sliding_window_view(x, win)[::hop]


# What bytes that are no readable 16-bit WAV file raise, or samples too few for a frame.
BAD_CAPTURE = (ValueError, EOFError, wave.Error)


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """16-bit WAV bytes to mono float samples; channels are averaged."""
    with wave.open(io.BytesIO(content), "rb") as w:
        if w.getsampwidth() != 2:
            raise ValueError(f"expected 16-bit samples, found {8 * w.getsampwidth()}-bit")
        rate, channels = w.getframerate(), w.getnchannels()
        raw = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2")
    return raw.reshape(-1, channels).mean(axis=1), rate


def envelope(x: np.ndarray, sr: int, win_ms: float, hop_ms: float) -> np.ndarray:
    win, hop = max(1, int(sr * win_ms / 1000.0)), max(1, int(sr * hop_ms / 1000.0))
    rows = framed(x, win, hop) if len(x) >= win else x[None, :]
    return np.sqrt(np.einsum("ij,ij->i", rows, rows) / rows.shape[1] + 1e-12)


def spectrum(x: np.ndarray, sr: int, nperseg: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin frequencies and magnitudes (frames x bins): periodic Hann, scaled by the window sum, no padding."""
    n = min(nperseg, len(x))
    if n <= overlap:
        raise ValueError(f"{len(x)} samples are shorter than one spectral window")
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    mags = np.abs(np.fft.rfft(framed(x, n, n - overlap) * window, axis=1)) / window.sum()
    return np.fft.rfftfreq(n, 1.0 / sr), mags


def pitch(x: np.ndarray, sr: int, grid: Grid) -> tuple[np.ndarray, np.ndarray]:
    """Per-frame F0 and voicing confidence from the normalised autocorrelation; quiet frames give zero."""
    win, hop = int(sr * grid.f0_win_ms / 1000.0), int(sr * grid.f0_hop_ms / 1000.0)
    rows = framed(x, win, hop).astype(float)
    f0, conf = np.zeros(len(rows)), np.zeros(len(rows))
    lags = np.arange(max(1, int(sr / grid.f0_high)), min(win - 1, int(sr / grid.f0_low)) + 1)
    if not len(rows) or not len(lags):
        return f0, conf
    rows = rows - rows.mean(axis=1, keepdims=True)
    loud = np.flatnonzero(np.sqrt(np.mean(rows * rows, axis=1) + 1e-12) >= grid.energy_floor)
    if len(loud):
        # Long enough that the lags of interest do not wrap around.
        need = win + int(lags[-1]) + 1
        size = min(n for n in (1 << need.bit_length(), 3 << (need.bit_length() - 2)) if n >= need)
        power = np.abs(np.fft.rfft(rows[loud], size, axis=1)) ** 2
        ac = np.fft.irfft(power, size, axis=1)
        ratio = ac[:, lags] / ac[:, :1]
        best = ratio.argmax(axis=1)
        f0[loud] = sr / lags[best]
        conf[loud] = ratio[np.arange(len(loud)), best]
    return f0, conf


def onset_count(above: np.ndarray, hop_ms: float) -> int:
    """Rising edges that come at least the refractory time after the last one counted."""
    gap, last, n = max(1, int(REFRACTORY_MS / hop_ms)), None, 0
    for i in np.flatnonzero(~above[:-1] & above[1:]).tolist():
        if last is None or i - last >= gap:
            last, n = i, n + 1
    return n


def zero_crossing_rate(samples: Column) -> Column:
    """Share of neighbouring samples on different sides of zero."""
    n = F.size(samples)
    pairs = F.zip_with(F.slice(samples, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(samples, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda b, a: (b >= 0) != (a >= 0))
    return F.coalesce(F.try_divide(F.size(F.filter(pairs, lambda c: c)).cast("double"), n - 1), F.lit(0.0))


def clip_ratio(samples: Column) -> Column:
    """Share of samples at the clipping level."""
    return F.coalesce(F.try_divide(F.size(F.filter(samples, lambda v: F.abs(v) >= CLIP_LEVEL)).cast("double"), F.size(samples)), F.lit(0.0))


class Tracks:
    """Per-frame tracks of one capture, computed once and sliced by time."""

    def __init__(self, x: np.ndarray, sr: int, grid: Grid):
        self.x, self.sr, self.grid = np.asarray(x, dtype=float), sr, grid
        self.dur = len(x) / sr if sr else 0.0
        self.env = envelope(self.x, sr, grid.env_win_ms, grid.env_hop_ms)
        self.noise_floor = float(np.percentile(self.env, 10))
        self.active_floor = max(3.0 * self.noise_floor, grid.floor_min)
        self.freqs, mags = spectrum(self.x, sr, grid.nperseg, grid.overlap)
        self.f0, self.conf = pitch(self.x, sr, grid)
        total = mags.sum(axis=1)
        self.centroid = mags @ self.freqs / (total + 1e-12)
        cum = np.cumsum(mags, axis=1)
        self.roll85 = self.freqs[(cum >= 0.85 * (cum[:, -1:] + 1e-12)).argmax(axis=1)]
        self.roll95 = self.freqs[(cum >= 0.95 * (cum[:, -1:] + 1e-12)).argmax(axis=1)]
        self.flat = np.exp(np.log(mags + 1e-12).mean(axis=1)) / (mags.mean(axis=1) + 1e-12)
        energy = mags * mags
        in_band = lambda lo, hi: (self.freqs >= lo) & (self.freqs < hi)
        self.band_energy = np.stack([energy[:, in_band(lo, hi)].sum(axis=1) for _, lo, hi in BANDS], axis=1)
        self.energy = energy.sum(axis=1)
        # Running sums over time give the mean spectrum of any slice from two rows.
        self.peaks = []
        for name, lo, hi in PEAK_BANDS:
            pick = in_band(lo, hi)
            self.peaks.append((name, self.freqs[pick], np.vstack([np.zeros(pick.sum()), np.cumsum(mags[:, pick], axis=0)])))

    def _cut(self, start: float, end: float, per_second: float, n: int) -> slice:
        """Half-even rounded frame positions, kept inside the track."""
        return slice(min(round(start * per_second), n), min(round(end * per_second), n))

    def features(self, start: float, end: float) -> dict[str, float]:
        g = self.grid
        env = self.env[self._cut(start, end, 1000.0 / g.env_hop_ms, len(self.env))]
        x = self.x[self._cut(start, end, self.sr, len(self.x))]
        spec = self._cut(start, end, self.sr / (g.nperseg - g.overlap), len(self.energy))
        voice = self._cut(start, end, 1000.0 / g.f0_hop_ms, len(self.conf))
        out = dict.fromkeys(FEATURES, 0.0)
        out.update(start_s=start, end_s=end, dur_s=end - start, active_floor=self.active_floor)
        out.update(file_dur_s=self.dur, file_noise_floor=self.noise_floor, file_active_floor=self.active_floor)
        if len(env):
            above = env > self.active_floor
            p10, p50, p95 = np.percentile(env, [10, 50, 95])
            out.update(rms_peak=env.max(), rms_mean=env.mean(), rms_p50=p50, rms_p95=p95, noise_floor_p10=p10)
            out.update(active_frac=above.mean(), onsets=float(onset_count(above, g.env_hop_ms)))
        if len(x) > 1:
            out["zcr"] = np.mean((x[1:] >= 0) != (x[:-1] >= 0))
        if len(x):
            out["clip_frac"] = np.mean(np.abs(x) >= CLIP_LEVEL)
        if spec.stop > spec.start:
            c = self.centroid[spec]
            out.update(centroid_mean_hz=c.mean(), centroid_std_hz=c.std(), flatness_mean=self.flat[spec].mean())
            out.update(rolloff85_mean_hz=self.roll85[spec].mean(), rolloff95_mean_hz=self.roll95[spec].mean())
            share = self.band_energy[spec].sum(axis=0) / (self.energy[spec].sum() + 1e-12)
            out.update({name: s for (name, _, _), s in zip(BANDS, share)})
            for name, freqs, run in self.peaks:
                if len(freqs):
                    out[name] = freqs[np.argmax(run[spec.stop] - run[spec.start])]
        conf = self.conf[voice]
        if len(conf):
            voiced = conf > VOICED_CONF
            out["f0_voiced_frac"] = voiced.mean()
            if voiced.any():
                f0 = self.f0[voice][voiced]
                r = np.clip(conf[voiced], 0.001, 0.999)
                p50, p95 = np.percentile(f0, [50, 95])
                out.update(f0_mean_hz=f0.mean(), f0_std_hz=f0.std(), f0_p50_hz=p50, f0_p95_hz=p95)
                out["hnr_db"] = 10.0 * np.log10(np.mean(r / (1 - r)))
        if g.rounded:
            return {k: round(float(v), DECIMALS.get(k, 17)) for k, v in out.items()}
        return {k: float(v) for k, v in out.items()}

    def segments(self) -> Iterator[tuple[int, dict[str, float]]]:
        """Features of every whole segment; the same grid as ``segment_grid``."""
        g = self.grid
        whole = int(np.floor((self.dur + 1e-6 - g.seg_len_s) / g.seg_hop_s)) + 1
        starts = np.arange(max(whole, 0)) * g.seg_hop_s
        return ((i, self.features(t, t + g.seg_len_s)) for i, t in enumerate(starts.tolist()))


def _feature_schema(keys: DataFrame) -> T.StructType:
    fixed = [
        T.StructField("sr", T.IntegerType()), T.StructField("samples", T.IntegerType()), T.StructField("seg_idx", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
    values = [T.StructField(n, T.IntegerType() if n == "onsets" else T.DoubleType()) for n in FEATURES]
    return T.StructType([*keys.schema.fields, *fixed, *values])


#: Rows that a task passes on at a time.
FRAME_ROWS = 1024


def _in_frames(rows: Iterator[tuple], columns: list[str], number: str) -> Iterator[pd.DataFrame]:
    """Rows of many captures as frames of ``FRAME_ROWS``; a frame a capture costs more than a short capture itself. ``number`` may be null."""
    while held := list(islice(rows, FRAME_ROWS)):
        yield pd.DataFrame(held, columns=columns).astype({number: "Int32"})


def capture_features(
    captures: DataFrame, keys: Sequence[str], content: str | None = None, samples: str | None = None, sr: int = 16_000, grid: Grid = Grid()
) -> DataFrame:
    """File rows (``seg_idx`` null) and segment rows of every capture, from WAV bytes or sample arrays.

    A capture that cannot be read gives one row with its ``error`` set. Arrow
    batches are bounded in bytes, so a task holds some fifty captures at a time,
    and rows are passed on ``FRAME_ROWS`` at a time however short captures are.
    """
    keys = list(keys)
    source = captures.select(*keys, F.col(content or samples).alias("_audio"))
    schema = _feature_schema(source.select(*keys))

    def frame(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=schema.names)
        for c in ("sr", "samples", "seg_idx", "onsets"):
            out[c] = out[c].astype("Int32")
        out["error"] = out["error"].astype(object).where(out["error"].notna(), None)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rec in pdf.itertuples(index=False, name=None):
                head, audio = dict(zip(keys, rec[:-1])), rec[-1]
                try:
                    x, rate = decode_wav(bytes(audio)) if content else (np.asarray(audio, dtype=float), sr)
                    tracks = Tracks(x, rate, grid)
                except BAD_CAPTURE as e:  # reported, not fatal
                    rows.append({**head, "error": f"{type(e).__name__}: {e}"})
                    continue
                head.update(sr=rate, samples=len(x))
                rows.append({**head, **tracks.features(0.0, tracks.dur)})
                rows.extend({**head, "seg_idx": i, **f} for i, f in tracks.segments())
                if len(rows) >= FRAME_ROWS:
                    yield frame(rows)
                    rows = []
            if rows:
                yield frame(rows)

    return source.mapInPandas(run, schema)


def file_rows(features: DataFrame) -> DataFrame:
    drop = ["seg_idx", "error", "file_dur_s", "file_noise_floor", "file_active_floor"]
    return features.filter(F.col("error").isNull() & F.col("seg_idx").isNull()).drop(*drop)


def segment_rows(features: DataFrame) -> DataFrame:
    return features.filter(F.col("seg_idx").isNotNull()).drop("error", "sr", "samples")


def failed_captures(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    return features.filter(F.col("error").isNotNull()).select(*keys, "error")


def rounded_feature(name: Column, value: Column) -> Column:
    """A feature's value with the decimals of its name, halves to even; features without a rule stay as they are."""
    out = value
    for digits in sorted(set(DECIMALS.values())):
        out = F.when(name.isin(*[n for n, d in DECIMALS.items() if d == digits]), F.bround(value, digits)).otherwise(out)
    return out


def segment_grid(dur_s: Column, seg_len_s: float = 0.96, seg_hop_s: float = 0.48) -> Column:
    """Zero-based numbers of the full windows in a capture; empty when it is shorter than one."""
    last = F.floor((dur_s + 1e-6 - seg_len_s) / seg_hop_s).cast("int")
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


# --- log-mel tables ---------------------------------------------------------------------------------

MEL_BANDS, MEL_LOW, MEL_HIGH, PATCH_FRAMES, PATCH_HOP = 64, 125.0, 7500.0, 96, 48


@lru_cache(maxsize=16)
def model_filterbank(sr: int, n_fft: int, bands: int = MEL_BANDS, low: float = MEL_LOW, high: float = MEL_HIGH) -> np.ndarray:
    """Triangles with fractional bin edges on the 1127 ln scale (bins x bands)."""
    to_mel = lambda f: 1127.0 * np.log(1.0 + f / 700.0)
    mel = np.linspace(to_mel(low), to_mel(high), bands + 2)
    edges = 700.0 * (np.exp(mel / 1127.0) - 1.0) * n_fft / sr
    k = np.arange(n_fft // 2 + 1)[:, None]
    left, mid, right = edges[:-2], edges[1:-1], edges[2:]
    return np.clip(np.minimum((k - left) / (mid - left), (right - k) / (right - mid)), 0.0, None)


@lru_cache(maxsize=16)
def viewer_filterbank(sr: int, n_fft: int, bands: int = MEL_BANDS, low: float = MEL_LOW, high: float = MEL_HIGH) -> np.ndarray:
    """Triangles with whole-bin edges on the 2595 log10 scale (bins x bands); no edge pair coincides."""
    to_mel = lambda f: 2595.0 * np.log10(1.0 + f / 700.0)
    mel = np.linspace(to_mel(low), to_mel(high), bands + 2)
    edges = np.floor((n_fft + 1) * 700.0 * (10 ** (mel / 2595.0) - 1.0) / sr)
    left, mid, right = edges[:-2], edges[1:-1].copy(), edges[2:].copy()
    mid[mid == left] += 1
    right[right == mid] += 1
    k = np.arange(n_fft // 2 + 1)[:, None]
    rise = np.where((k >= left) & (k < mid), (k - left) / np.maximum(1, mid - left), 0.0)
    fall = np.where((k >= mid) & (k < right), (right - k) / np.maximum(1, right - mid), 0.0)
    return rise + fall


def log_mel_frames(x: np.ndarray, sr: int, win: int = 400, hop: int = 160, n_fft: int = 512) -> np.ndarray:
    """ln(mel + 0.001) of zero-padded magnitude spectra under a symmetric Hann window."""
    window = 0.5 * (1.0 - np.cos(2 * np.pi * np.arange(win) / (win - 1)))
    mags = np.abs(np.fft.rfft(framed(x / 32768.0, win, hop) * window, n_fft, axis=1))
    return np.log(mags @ model_filterbank(sr, n_fft) + 0.001)


def mel_patches(captures: DataFrame, keys: Sequence[str], content: str) -> DataFrame:
    """Model input patches: every 48 frames the last 96 log-mel frames, zeros before the first. A capture that cannot be read is one row with an error."""
    keys = list(keys)
    source = captures.select(*keys, F.col(content).alias("_audio"))
    schema = T.StructType(
        [*source.select(*keys).schema.fields, T.StructField("patch_idx", T.IntegerType()), T.StructField("mel", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())]
    )

    def patches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pdf in batches:
            for rec in pdf.itertuples(index=False, name=None):
                try:
                    x, rate = decode_wav(bytes(rec[-1]))
                except BAD_CAPTURE as e:  # reported, not fatal
                    yield (*rec[:-1], None, None, f"{type(e).__name__}: {e}")
                    continue
                mel = log_mel_frames(x, rate).astype(np.float32)
                padded = np.vstack([np.zeros((PATCH_FRAMES - PATCH_HOP, MEL_BANDS), np.float32), mel])
                for i in range(len(mel) // PATCH_HOP):
                    yield (*rec[:-1], i, padded[i * PATCH_HOP : i * PATCH_HOP + PATCH_FRAMES].ravel(), None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _in_frames(patches(batches), schema.names, "patch_idx")

    return source.mapInPandas(run, schema)


def mel_db_table(captures: DataFrame, keys: Sequence[str], content: str, n_fft: int = 1024, hop: int = 160) -> DataFrame:
    """Log-mel power in dB per frame for viewing, with the 5th and 99th percentile of the capture; one row with an error where it cannot be read."""
    keys = list(keys)
    source = captures.select(*keys, F.col(content).alias("_audio"))
    schema = T.StructType(
        [
            *source.select(*keys).schema.fields, T.StructField("frame", T.IntegerType()), T.StructField("mel_db", T.ArrayType(T.FloatType())),
            T.StructField("db_p5", T.DoubleType()), T.StructField("db_p99", T.DoubleType()),
            T.StructField("error", T.StringType()),
        ]
    )

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pdf in batches:
            for rec in pdf.itertuples(index=False, name=None):
                try:
                    x, rate = decode_wav(bytes(rec[-1]))
                    _, mags = spectrum(x, rate, n_fft, n_fft - hop)
                except BAD_CAPTURE as e:  # reported, not fatal
                    yield (*rec[:-1], None, None, None, None, f"{type(e).__name__}: {e}")
                    continue
                db = 10.0 * np.log10((mags**2) @ viewer_filterbank(rate, 2 * (mags.shape[1] - 1)) + 1e-6)
                p5, p99 = np.percentile(db, [5, 99])
                for i, row in enumerate(db.astype(np.float32)):
                    yield (*rec[:-1], i, row, p5, p99, None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _in_frames(frames(batches), schema.names, "frame")

    return source.mapInPandas(run, schema)


# --- array forms that stay in SQL -------------------------------------------------------------------


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def block_levels(samples: Column, block: int, every: int = 16) -> Column:
    """RMS of every 16th full block of samples, as (block, rms) pairs."""
    n = F.floor(F.size(samples) / block).cast("int")
    kept = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(every))).otherwise(F.array().cast("array<int>"))
    level = lambda i: F.sqrt(_sum(F.transform(F.slice(samples, i * block + 1, block), lambda v: v.cast("double") * v)) / block)
    return F.transform(kept, lambda i: F.struct(i.alias("block"), level(i).alias("rms")))


def patch_health(codes: Column, zero_point: int, flat_share: float = 0.9) -> dict[str, Column]:
    """Range, mean and share of cells at the zero point of a quantised patch, and the flat-patch flag."""
    share = F.size(F.filter(codes, lambda q: q == zero_point)) / F.size(codes)
    return {
        "mel_min": F.array_min(codes), "mel_max": F.array_max(codes), "mel_mean": _sum(F.transform(codes, lambda q: q.cast("double"))) / F.size(codes),
        "zero_share": share, "flat": share > flat_share,
    }


def pool_frames(frames: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Mean then max of each vector position over the frames of a capture, as one array.

    Positions are aggregated before the shuffle, so a capture with many frames costs no more than its dimension.
    """
    keys = list(keys)
    cells = frames.select(*keys, F.posexplode(vector).alias("_dim", "_v"))
    stats = cells.groupBy(*keys, "_dim").agg(F.avg(F.col("_v").cast("double")).alias("_mean"), F.max(F.col("_v").cast("double")).alias("_max"))
    packed = stats.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_dim", "_mean", "_max"))).alias("_d"))
    return packed.select(*keys, F.concat(F.transform("_d", lambda s: s["_mean"]), F.transform("_d", lambda s: s["_max"])).alias("pooled"))


def score_patches(patches: DataFrame, patch: str, cells: int, load_model, out: str = "scores", batch: int = 64) -> DataFrame:
    """Class scores of each patch from a pluggable model.

    ``load_model`` runs once per Python worker and returns a function from a
    (rows x ``cells``) array to a (rows x classes) array.
    """
    from pyspark.ml.functions import predict_batch_udf

    score = predict_batch_udf(load_model, return_type=T.ArrayType(T.FloatType()), batch_size=batch, input_tensor_shapes=[[cells]])
    return patches.withColumn(out, score(F.col(patch)))


# --- WAV bytes from raw payloads --------------------------------------------------------------------


def wav_bytes(payload: Column, sr: int = 16_000) -> Column:
    """A mono 16-bit WAV file around raw little-endian sample bytes, built in SQL; an odd last byte is left out."""
    n = F.expr("2") * F.floor(F.octet_length(payload) / 2)

    def little(value: Column, width: int) -> Column:
        digits = F.lpad(F.hex(value), 2 * width, "0")
        return F.concat(*[F.substring(digits, 2 * (width - i) - 1, 2) for i in range(width)])

    num = lambda v, width: little(F.lit(v), width)
    text = lambda s: F.lit(s.encode().hex())
    header = F.concat(
        text("RIFF"), little(n + 36, 4), text("WAVEfmt "), num(16, 4), num(1, 2), num(1, 2), num(sr, 4), num(2 * sr, 4), num(2, 2), num(16, 2),
        text("data"), little(n, 4),
    )
    return F.concat(F.unhex(header), payload.substr(F.lit(1), n.cast("int")))
