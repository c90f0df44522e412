"""Streams with timers, sources with offsets of their own, keyed state read back."""

import time

import pytest
from pyspark.sql import functions as F

from soundledger.sources.manifest_source import mirror_pass, publish_manifest
from soundledger.streaming.silence import silence_stream


def test_silent_devices_by_the_clock(spark, tmp_path):
    """One device falls silent and one never speaks: neither has a row at the time."""
    spark.range(1).select(F.lit("spoke").alias("device"), F.lit("2024-01-01").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "in" / "a"))
    rows = spark.readStream.schema("device STRING, ts TIMESTAMP").parquet(str(tmp_path / "in" / "*"))
    listed = spark.createDataFrame([("spoke",), ("never",)], "device STRING").withColumn("since", F.lit("2024-01-01").cast("timestamp"))
    told = silence_stream(rows, listed, ["device"], "ts", period_ms=100)
    query = told.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).option("path", str(tmp_path / "out")).trigger(processingTime="1 second").start()
    try:
        back = spark.read.schema(told.schema)
        until = time.time() + 90
        while time.time() < until:
            time.sleep(2)
            assert query.isActive, query.exception()
            found = {(r["device"], r["kind"]) for r in back.parquet(str(tmp_path / "out")).collect()} if (tmp_path / "out").exists() else set()
            if len(found) == 6:
                break
    finally:
        query.stop()
    kinds = ("NORESP_FIRST", "OUTAGE_CONFIRMED", "OUTAGE_SUSTAINED")
    assert found == {(d, k) for d in ("spoke", "never") for k in kinds}


@pytest.mark.parametrize("per_batch", [1, 100])
def test_silence_by_event_time_does_not_depend_on_batches(spark, tmp_path, per_batch):
    from soundledger.streaming.jobs import run_to_table

    minutes = {"a": [1, 2, 9, 50, 51], "b": [1, 3], "z": [60]}
    rows = sorted((m, d) for d, ms in minutes.items() for m in ms)
    for i, (m, d) in enumerate(rows):
        one = spark.createDataFrame([(d, m * 60)], "device STRING, s BIGINT").select("device", F.timestamp_seconds("s").alias("ts"))
        one.coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03d}"))
        time.sleep(0.02)
    stream = spark.readStream.schema("device STRING, ts TIMESTAMP").option("maxFilesPerTrigger", per_batch).parquet(str(tmp_path / "in" / "*"))
    listed = spark.createDataFrame([("a",), ("b",), ("never",)], "device STRING").withColumn("since", F.timestamp_seconds(F.lit(0)))
    out = run_to_table(silence_stream(stream, listed, ["device"], "ts", 60_000, "EventTime", "1 minute"), str(tmp_path / "out"))
    got = sorted((r["device"], r["t_us"] // 60_000_000, r["kind"]) for r in out.collect())
    want = []
    for device, ms in {**minutes, "never": []}.items():
        times = ([0] if device != "z" else []) + ms
        for a, b in zip(times, [*times[1:], None], strict=True):
            for n, kind in ((1, "NORESP_FIRST"), (3, "OUTAGE_CONFIRMED"), (30, "OUTAGE_SUSTAINED")):
                if a + n < (b if b is not None else 59.0001):
                    want.append((device, a + n, kind))
            if b is not None and b - a > 3:
                want.append((device, b, "OUTAGE_RECOVERED"))
    assert got == sorted(want)


def test_manifest_stream_restarts_where_it_stopped(spark, tmp_path):
    root, path = str(tmp_path / "manifest"), str(tmp_path / "mirror")
    entry = "path STRING, size BIGINT, mtime BIGINT, sha256 STRING"

    def publish(rows, generation):
        publish_manifest(spark.createDataFrame([(p, 1, m, "x") for p, m in rows], entry), root, generation)

    def run(bad=()):
        mirror_pass(spark, root, path, lambda rows: rows.withColumn("ok", ~F.col("path").isin(list(bad)) if bad else F.lit(True)))

    def done():
        return sorted((r["batch"], r["path"], r["mtime"], r["verify"], r["retry"], r["ok"]) for r in spark.read.parquet(f"{path}/done").collect())

    publish([("a", 10), ("b", 20)], "g1")
    run(bad=("b",))
    assert done() == [(0, "a", 10, False, False, True), (0, "b", 20, False, False, False)]
    run()
    run()
    assert done()[2:] == [(1, "b", 20, False, True, True)], "tried again once, and nothing after that"
    publish([("a", 10), ("b", 20), ("c", 30)], "g1")
    with pytest.raises(Exception, match="broken"):
        mirror_pass(spark, root, path, lambda rows: rows.select(F.raise_error(F.lit("broken")).alias("ok"), "*"))
    run()
    assert done()[3:] == [(2, "c", 30, False, False, True)], "a pass that died is done again"
    publish([("a", 10), ("d", 5)], "g2")
    run()
    assert done()[4:] == [(3, "a", 10, True, False, True), (3, "d", 5, True, False, True)]
    publish([], "g2")
    run()
    assert len(done()) == 6


def slow_peaks(x, held, decay):
    out = []
    for v in x:
        held = v if v > held else decay * held
        out.append(held)
    return out


@pytest.mark.parametrize("short", [0, 256])
def test_decayed_peaks_without_steps(monkeypatch, short):
    import numpy as np

    from soundledger.operators import folds
    from soundledger.operators.folds import decayed, hold_peak, peak_exits

    monkeypatch.setattr(folds, "SHORT", short)

    rng = np.random.default_rng(4)
    for case in range(400):
        n = int(rng.integers(1, 90))
        x = rng.random(n) * (rng.random(n) < 0.6) if case % 2 else rng.choice([0.0, 0.5, 0.475, 0.45125, 1.0], n)
        held = float(rng.choice([0.0, 0.5, 1e-200, rng.random()]))
        want = slow_peaks(x.tolist(), held, 0.95)
        assert np.allclose(hold_peak(x, held, 0.95), want, rtol=1e-12, atol=0), (x, held)
        pairs = peak_exits(x, 0.95)
        log = np.log(held) if held else -np.inf
        score, steps = next((e, s) for b, e, s in pairs if log < b)
        score = held if score < 0 else score
        assert np.isclose(decayed(np.array([score]), np.array([steps]), 0.95)[0], want[-1], rtol=1e-9, atol=0)
    x = np.r_[np.zeros(14_000), 0.5]
    assert np.allclose(hold_peak(x, 1.0, 0.95)[[0, -1]], [0.95, 0.5]) and len(hold_peak(np.full(300_000, 0.3), 0.0, 0.95)) == 300_000


def test_peak_after_many_zeros(spark):
    """A chunk that begins with more zeros than a double can decay through still passes on the score at its end."""
    from soundledger.operators import folds

    rows = [(1, 0, 1.0)] + [(1, 1_000_000 + i, 0.0) for i in range(14_000)] + [(1, 1_014_000, 0.5), (1, 2_000_000, 0.1)]
    df = spark.createDataFrame([(d, t, t, v) for d, t, v in rows], "device BIGINT, t BIGINT, id BIGINT, v DOUBLE")
    got = {r["t"]: r["peak"] for r in folds.decayed_peak(df, ["device"], "t", "id", "v", base_us=1_000_000, target_rows=100_000).filter("t in (0, 1014000, 2000000)").collect()}
    assert got == pytest.approx({0: 1.0, 1_014_000: 0.5, 2_000_000: 0.475})


def slow_floor(rows):
    """Level histogram with halving, row by row: p50 and p95 after each."""
    from soundledger.streaming.folds import HALVE_ABOVE

    hist, total, out = [0] * 32, 0, []
    for b in rows:
        hist[b] += 1
        total += 1
        if total > HALVE_ABOVE:
            hist, total = [h >> 1 for h in hist], total >> 1
        found = []
        for p in (0.5, 0.95):
            upto = 0
            for i in range(32):
                upto += hist[i]
                if upto >= int(total * p):
                    break
            found.append(2 ** (5 + 9.5 * (i + 0.5) / 32))
        out.append((total, *found))
    return out


def test_running_floor_in_any_batches():
    import numpy as np
    import pandas as pd

    from soundledger.streaming.adaptive import running_floor_rule

    rng = np.random.default_rng(8)
    for n, cuts in ((70_000, [20_000, 20_001, 66_000]), (500, [1, 2, 250])):
        b = np.clip(rng.normal(12, 4, n), 0, 31).astype(int)
        frame = pd.DataFrame({"t": np.arange(n), "id": np.arange(n), "level_bin": b, "s": 1.0})
        state, got = ([0] * 32, 0, -1), []
        for part in np.split(np.arange(n), cuts):
            state, out = running_floor_rule("t", "id", ["s"])(frame.iloc[part].reset_index(drop=True), state)
            got.append(out)
        got = pd.concat(got)
        want = np.array(slow_floor(b.tolist()))
        assert (got["n"].to_numpy() == want[:, 0]).all() and np.allclose(got[["p50", "p95"]].to_numpy(), want[:, 1:])


def test_held_out_models_equal_separate_fits(spark, monkeypatch):
    import numpy as np

    from soundledger.operators import models

    monkeypatch.setattr(models, "ROW_BLOCK", 37)
    rng = np.random.default_rng(5)
    n, sessions = 400, 9
    x = rng.normal(size=(n, 4)) * [1, 50, 0.01, 3] + [0, 1000, 3, -2]
    x[:, 3] = np.where(np.arange(n) % sessions == 2, x[:, 3], 7.0)  # constant in all sessions but one
    y = (x[:, 0] + 0.03 * (x[:, 1] - 1000) + rng.normal(size=n) > 0.4).astype(int)
    s = np.arange(n) % sessions
    rows = [(list(map(float, r)), int(v), f"s{i}") for r, v, i in zip(x, y, s, strict=True)] + [(None, 1, "s0")]
    df = spark.createDataFrame(rows, "x ARRAY<DOUBLE>, y INT, session STRING").repartition(3)
    got = {r["session"]: (r["slope"], r["offset"]) for r in models.fit_held_out(df, "session", "x", "y").collect()}
    assert set(got) == {f"s{i}" for i in range(sessions)}
    for i in range(sessions):
        xs, ys = x[s != i], y[s != i]
        mean, std = xs.mean(0), xs.std(0)
        std[std < 1e-12] = 1
        z = np.c_[np.ones(len(xs)), (xs - mean) / std]
        w = np.where(ys == 1, len(ys) / (2 * ys.sum()), len(ys) / (2 * (len(ys) - ys.sum())))
        b, penalty = np.zeros(5), np.diag([0, 1, 1, 1, 1.0])
        for _ in range(40):
            p = 1 / (1 + np.exp(-z @ b))
            b = b - np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (w * (p - ys)) + penalty @ b)
        slope, offset = got[f"s{i}"]
        mine = 1 / (1 + np.exp(-(x @ np.array(slope) + offset)))
        want = 1 / (1 + np.exp(-(np.c_[np.ones(n), (x - mean) / std] @ b)))
        assert np.abs(mine - want)[s != i].max() < 1e-6
    with pytest.raises(ValueError, match="both classes"):
        models.fit_held_out(df.withColumn("y", F.when(F.col("session") == "s1", 1).otherwise(0)), "session", "x", "y")


def test_lines_of_a_large_file_keep_their_numbers(spark, tmp_path):
    """One file is read by many tasks, and every line has the number it has in the file."""
    from soundledger.sources.readers import _numbered_lines, read_ledger

    lines = ["" if i % 1000 == 7 else "x" * (i % 90) + f"\r{i}" for i in range(60_000)]
    (tmp_path / "big.txt").write_text("\n".join(lines) + "\n", newline="")
    (tmp_path / "small.txt").write_text("a\nb", newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        rows = _numbered_lines(spark, str(tmp_path))
        parts = spark.read.option("lineSep", "\n").text(str(tmp_path / "big.txt")).rdd.getNumPartitions()
        got = {}
        for r in rows.collect():
            got.setdefault(r["file_path"].rsplit("/", 1)[1], []).append((r["line"], r["value"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert parts > 10
    assert sorted(got["big.txt"]) == list(enumerate(lines)) and sorted(got["small.txt"]) == [(0, "a"), (1, "b")]
    (tmp_path / "ledger.jsonl").write_text('{"op": "ack", "path": "p"}\n\n{broken\n{"op": "purge", "path": "p"}\n')
    assert sorted((r["line"], r["op"]) for r in read_ledger(spark, str(tmp_path / "ledger.jsonl")).collect()) == [(0, "ack"), (3, "purge")]


def test_ledger_state_goes_by_lines(spark, tmp_path):
    from soundledger.streaming.state import keep_ledger, kept_ledger

    schema = "device BIGINT, path STRING, line BIGINT, op STRING, size BIGINT, mtime BIGINT, sha256 STRING, category STRING, sync_state STRING"
    batches = [
        [(1, "a", 5, "register", 10, 1, "s", "wav", "pending"), (1, "b", 6, "purge", None, None, None, None, None), (2, "a", 7, "ack", None, None, None, None, None)],
        [(1, "b", 3, "register", 1, 1, "s", "wav", "pending"), (1, "a", 4, "ack", None, None, None, None, None), (2, "a", 2, "close", 9, None, None, "log", "pending")],
        [(1, "a", 8, "ack", None, None, None, None, None)],
    ]
    states = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={i}"))
        keep_ledger(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "state"))
        states.append(sorted((r["device"], r["path"], r["size"], r["mtime"], r["sync_state"]) for r in kept_ledger(spark, str(tmp_path / "state")).collect()))
    assert states == [[(1, "a", 10, 1, "pending")], [(1, "a", 10, 1, "pending"), (2, "a", 9, 0, "synced")], [(1, "a", 10, 1, "synced"), (2, "a", 9, 0, "synced")]]
