"""Features of signals with known answers, WAV decoding and mel tables."""

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundledger.operators import audio as A

SR = 16_000


def wav(x, channels=1, width=2):
    buf = io.BytesIO()
    with wave.open(buf, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(SR)
        w.writeframes(np.asarray(x, dtype="<i2" if width == 2 else "u1").tobytes())
    return buf.getvalue()


def tone(hz, seconds, amp=8000):
    return amp * np.sin(2 * np.pi * hz * np.arange(int(SR * seconds)) / SR)


@pytest.fixture(scope="module")
def table(spark):
    burst = np.concatenate([np.concatenate([tone(440, 1), np.zeros(SR)]) for _ in range(3)])
    square = np.where(np.arange(2 * SR) % 40 < 20, 32767, -32768)
    stereo = np.stack([tone(440, 2), np.zeros(2 * SR)], axis=1).ravel()
    rows = [
        ("silence", wav(np.zeros(2 * SR))), ("tone", wav(tone(440, 40))), ("burst", wav(burst)), ("square", wav(square)), ("stereo", wav(stereo, 2)),
        ("short", wav(np.zeros(300))), ("brief", wav(tone(440, 0.05))), ("corrupt", b"RIFF junk"), ("eight", wav(np.zeros(4000), width=1)),
        ("noise", wav(np.random.default_rng(0).normal(0, 2000, 2 * SR))),
    ]
    df = spark.createDataFrame(rows, "file STRING, content BINARY")
    return A.capture_features(df, ["file"], content="content").cache()


def file_row(table, name):
    return A.file_rows(table).filter(F.col("file") == name).first()


def test_bad_captures_are_reported(table):
    bad = {r["file"] for r in A.failed_captures(table, ["file"]).collect()}
    assert bad == {"short", "corrupt", "eight"}


def test_tone(table):
    r = file_row(table, "tone")
    assert r["samples"] == 40 * SR and r["dur_s"] == 40.0
    assert abs(r["f0_p50_hz"] - 440) < 10 and r["f0_voiced_frac"] > 0.99 and r["hnr_db"] > 11
    assert r["b_250_500"] > 0.99 and abs(r["peak_hz_300_800"] - 440) < 16
    assert abs(r["rms_peak"] - 8000 / np.sqrt(2)) < 20 and r["clip_frac"] == 0
    assert abs(r["zcr"] - 2 * 440 / SR) < 0.001
    segs = A.segment_rows(table).filter("file = 'tone'").orderBy("seg_idx").collect()
    assert len(segs) == 82 and segs[3]["start_s"] == 1.44 and segs[0]["file_dur_s"] == 40.0


def test_silence_noise_and_clipping(table):
    s = file_row(table, "silence")
    assert s["f0_voiced_frac"] == 0 and s["active_frac"] == 0 and s["onsets"] == 0 and s["hnr_db"] == 0
    assert file_row(table, "square")["clip_frac"] == 1.0
    n = file_row(table, "noise")
    assert n["flatness_mean"] > 0.7 and n["f0_voiced_frac"] < 0.3


def test_bursts_and_channels(table):
    b = file_row(table, "burst")
    assert b["onsets"] == 2 and 0.4 < b["active_frac"] < 0.6  # the first burst begins above the floor
    assert abs(file_row(table, "stereo")["rms_mean"] - 4000 / np.sqrt(2)) < 20
    assert file_row(table, "brief")["samples"] == 800


def direct_features(x, start, end):
    """One window by the definition, without shared tracks."""
    env = np.array([np.sqrt(np.mean(x[i : i + 800] ** 2) + 1e-12) for i in range(0, len(x) - 799, 400)])
    cut = env[round(start * 40) : round(end * 40)]
    return round(float(np.percentile(cut, 95)), 4)


def test_segments_slice_the_file_tracks(spark):
    x = np.round(np.random.default_rng(1).normal(0, 1500, 3 * SR) * np.linspace(0, 1, 3 * SR))
    df = spark.createDataFrame([("a", wav(x))], "file STRING, content BINARY")
    for r in A.segment_rows(A.capture_features(df, ["file"], content="content")).collect():
        assert r["rms_p95"] == pytest.approx(direct_features(x, 0.48 * r["seg_idx"], 0.48 * r["seg_idx"] + 0.96), abs=1e-3)


def test_mel_patches(spark):
    df = spark.createDataFrame([("tone", wav(tone(440, 2))), ("bad", b"x")], "file STRING, content BINARY")
    p = A.mel_patches(df, ["file"], "content").orderBy("patch_idx").collect()
    bad = [r for r in p if r["error"]]
    assert [(r["file"], r["patch_idx"], r["mel"]) for r in bad] == [("bad", None, None)]
    p = [r for r in p if not r["error"]]
    frames = 1 + (2 * SR - 400) // 160
    assert [r["patch_idx"] for r in p] == list(range(frames // 48)) and len(p[0]["mel"]) == 96 * 64
    first = np.array(p[0]["mel"]).reshape(96, 64)
    assert (first[:48] == 0).all() and (first[48:] != 0).all()
    mel = A.log_mel_frames(tone(440, 2).astype("<i2").astype(float), SR)
    assert np.allclose(np.array(p[1]["mel"]).reshape(96, 64), mel[:96], atol=1e-4)
    centre = lambda m: 700 * (np.exp((m / 65 * (1127 * np.log(1 + 7500 / 700) - 1127 * np.log(1 + 125 / 700)) + 1127 * np.log(1 + 125 / 700)) / 1127) - 1)
    assert abs(centre(mel[50].argmax() + 1) - 440) < 40


def test_mel_filterbanks():
    fb = A.model_filterbank(SR, 512)
    assert fb.shape == (257, 64) and fb.min() == 0 and 0 < fb.max() <= 1
    # Low bands are narrower than a bin spacing apart, yet each still has weight in the viewer bank.
    view = A.viewer_filterbank(SR, 1024)
    assert view.shape == (513, 64) and (view.sum(axis=0) > 0).all()


def test_mel_db_limits(spark):
    df = spark.createDataFrame([("tone", wav(tone(1000, 1))), ("bad", b"RIFF")], "file STRING, content BINARY")
    rows = A.mel_db_table(df, ["file"], "content").collect()
    assert [(r["file"], r["frame"]) for r in rows if r["error"]] == [("bad", None)]
    rows = [r for r in rows if not r["error"]]
    flat = np.array([r["mel_db"] for r in rows])
    assert rows[0]["db_p5"] == pytest.approx(np.percentile(flat, 5), abs=1e-3) and flat.shape == (1 + (SR - 1024) // 160, 64)


def test_wav_bytes_round_trip(spark):
    df = spark.range(1).select(A.wav_bytes(F.unhex(F.lit("0100FF7F0080AA"))).alias("content"))
    x, rate = A.decode_wav(bytes(df.first()["content"]))
    assert rate == SR and x.tolist() == [1.0, 32767.0, -32768.0]


def test_segment_grid(spark):
    rows = spark.createDataFrame([(40.0,), (0.96,), (0.95,), (1.44,)], "d DOUBLE").select(F.size(A.segment_grid(F.col("d"))).alias("n")).collect()
    assert [r["n"] for r in rows] == [82, 1, 0, 2]
