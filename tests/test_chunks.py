"""Chunked operators against plain per-key folds, with chunks far smaller than a key."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundledger.operators import chunks, extras, folds, joins, windows

SMALL = [{"base_us": 40}, {"base_us": 1000, "target_rows": 5}]


def make_rows(seed, n=160, devices=3, span=900, ties=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        device = 0 if rng.random() < 0.6 else rng.randrange(devices)  # one hot device
        rows.append((device, rng.randrange(span) if ties else i * 7 + rng.randrange(7), i, round(rng.random(), 3)))
    return rows


def by_device(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "device INT, t BIGINT, id BIGINT, v DOUBLE")


@pytest.mark.parametrize("opts", SMALL)
def test_running_and_neighbour(spark, opts):
    rows = make_rows(1)
    df = chunks.with_chunks(frame(spark, rows), ["device"], "t", **opts)
    assert df.select(chunks.CHUNK).distinct().count() > 5
    out = chunks.running(df, ["device"], ["t", "id"], {"s": ("sum", F.col("id")), "hi": ("max", F.col("v")), "n": ("count", F.lit(1))})
    out = chunks.running(out, ["device"], ["t", "id"], {"before": ("max", F.col("v"))}, exclusive=True)
    out = chunks.running(out, ["device"], ["t", "id"], {"rest": ("sum", F.col("id"))}, backward=True)
    out = chunks.neighbour(out, ["device"], ["t", "id"], {"prev": F.col("id")})
    out = chunks.neighbour(out, ["device"], ["t", "id"], {"next": F.col("id")}, following=True)
    got = {r["id"]: r for r in out.collect()}
    for rs in by_device(rows).values():
        for i, r in enumerate(rs):
            g = got[r[2]]
            assert g["s"] == sum(x[2] for x in rs[: i + 1]) and g["n"] == i + 1
            assert g["hi"] == max(x[3] for x in rs[: i + 1])
            assert g["before"] == (max(x[3] for x in rs[:i]) if i else None)
            assert g["rest"] == sum(x[2] for x in rs[i:])
            assert g["prev"] == (rs[i - 1][2] if i else None)
            assert g["next"] == (rs[i + 1][2] if i + 1 < len(rs) else None)


def test_hot_cell_is_split(spark):
    rows = [(0, i, i, 0.0) for i in range(2000)] + [(1, i * 100, 5000 + i, 0.0) for i in range(10)]
    df = chunks.with_chunks(frame(spark, rows), ["device"], "t", base_us=2000, target_rows=100)
    sizes = df.groupBy("device", chunks.CHUNK).count().agg(F.max("count")).first()[0]
    assert sizes <= 100
    assert df.filter("device = 1").select(chunks.CHUNK).distinct().count() == 1
    order = [r[1] for r in sorted(df.filter("device = 0").select("t", chunks.CHUNK).collect())]
    assert order == sorted(order)


@pytest.mark.parametrize("opts", SMALL)
@pytest.mark.parametrize("seed", [2, 3, 4])
def test_detector(spark, opts, seed):
    rows = make_rows(seed, 200)
    got = windows.detector_episodes(frame(spark, rows), ["device"], "t", "id", "v", F.lit(0.55), 2, 12, **opts)
    want = set()
    for device, rs in by_device(rows).items():
        open_at, until, streak = None, 0, 0
        for _, t, _, v in rs:
            streak = streak + 1 if v >= 0.55 else 0
            if open_at is None:
                if streak >= 2:
                    open_at, until = t, t + 12
            elif v >= 0.55:
                until = t + 12
            elif t >= until:
                want.add((device, open_at, t))
                open_at, streak = None, 0
        if open_at is not None:
            want.add((device, open_at, None))
    assert {(r["device"], r["start_us"], r["end_us"]) for r in got.collect()} == want and want


@pytest.mark.parametrize("opts", SMALL)
@pytest.mark.parametrize("gap", [1, 25, 90])
def test_space_out(spark, opts, gap):
    rows = make_rows(5, 220)
    got = {(r["device"], r["t"], r["id"]) for r in folds.space_out(frame(spark, rows), ["device"], "t", "id", gap, **opts).collect()}
    want = set()
    for device, rs in by_device(rows).items():
        free = -1
        for _, t, i, _ in rs:
            if t >= free:
                want.add((device, t, i))
                free = t + gap
    assert got == want


@pytest.mark.parametrize("opts", SMALL)
def test_folds(spark, opts):
    rows = make_rows(6, 240)
    df = frame(spark, rows)
    rate = {r["id"]: r["rate"] for r in folds.smoothed_rate(df, ["device"], "t", "id", **opts).collect()}
    peak = {r["id"]: r["peak"] for r in folds.decayed_peak(df, ["device"], "t", "id", "v", **opts).collect()}
    vec = df.withColumn("s", F.array("v", F.lit(0.5)))
    kept = {r["id"] for r in extras.delta_rows(vec, ["device"], "t", "id", "s", 0.2, **opts).collect()}
    p95 = {r["id"]: r["p95"] for r in windows.trailing_p95(df, ["device"], ["t", "id"], "v", depth=7, **opts).collect()}
    want_kept = set()
    for rs in by_device(rows).values():
        y, held, last, before = 0.0, 0.0, None, None
        for k, (_, t, i, v) in enumerate(rs):
            if before is not None and t > before:
                y = 0.8 * y + 0.2 * 1e6 / (t - before)
            before = t
            held = v if v > held else 0.95 * held
            assert rate[i] == pytest.approx(y, rel=1e-12)
            assert peak[i] == pytest.approx(held, rel=1e-12)
            if last is None or abs(v - last) > 0.2:
                want_kept.add(i)
                last = v
            hist = sorted(x[3] for x in rs[max(0, k - 6) : k + 1])
            assert p95[i] == hist[len(hist) * 95 // 100]
    assert kept == want_kept


def test_trailing_rows_over_blocks(spark):
    rows = make_rows(9, 150, devices=1)
    df = chunks.with_chunks(frame(spark, rows), ["device"], "t", base_us=50)
    out = chunks.trailing_rows(df, ["device"], ["t", "id"], 5, {"s": lambda w: F.sum("id").over(w)}, block_rows=8)
    got = {r["id"]: r["s"] for r in out.collect()}
    for rs in by_device(rows).values():
        for i, r in enumerate(rs):
            assert got[r[2]] == sum(x[2] for x in rs[max(0, i - 4) : i + 1])


@pytest.mark.parametrize("opts", SMALL)
def test_nearest_and_clips(spark, opts):
    rows = make_rows(7, 150)
    rng = random.Random(8)
    trig = [(rng.randrange(3), rng.randrange(900), i, float(i)) for i in range(60)]
    left = frame(spark, rows)
    right = spark.createDataFrame(trig, "device INT, t BIGINT, line BIGINT, rms DOUBLE")
    got = {r["id"]: r["line"] for r in joins.nearest(left, right, ["device"], "t", "line", ["rms"], 30, **opts).collect()}
    for device, t, i, _ in rows:
        near = [(abs(x[1] - t), x[2]) for x in trig if x[0] == device and abs(x[1] - t) <= 30]
        assert got[i] == (min(near)[1] if near else None)
    spaced = folds.space_out(right, ["device"], "t", "line", 61)
    clips = joins.clip_frames(left, spaced, ["device"], "t", 40, 60, **opts)
    have = sorted((r["id"], r["trigger_us"]) for r in clips.collect())
    starts = [(r["device"], r["t"]) for r in spaced.collect()]
    assert have == sorted((i, s) for d, t, i, _ in rows for sd, s in starts if sd == d and s - 40 <= t <= s + 60)


def test_neighbours_of_a_hot_second(spark):
    rows = [(0, 100, i, 0.9) for i in range(50)] + [(0, 399, 60, 0.1), (0, 400, 61, 0.9), (0, 401, 62, 0.9), (0, None, 63, 0.9), (1, 100, 64, 0.9)]
    out = joins.temporal_neighbours(frame(spark, rows), ["device"], "t", F.col("v") >= 0.5, 300, bucket_s=200)
    got = {r["id"]: (r["neighbours"], r["high_neighbours"]) for r in out.collect()}
    for d, t, i, v in rows:
        near = [x for x in rows if x[0] == d and x[2] != i and t is not None and x[1] is not None and abs(x[1] - t) <= 300]
        assert got[i] == (len(near), sum(x[3] >= 0.5 for x in near))


@pytest.mark.parametrize("opts", SMALL)
def test_polls(spark, opts):
    rng = random.Random(11)
    rows = [(rng.randrange(2), i * 3, i, rng.random() < 0.4, rng.randrange(40), rng.randrange(4)) for i in range(200)]
    df = spark.createDataFrame(rows, "device INT, t BIGINT, id BIGINT, ok BOOLEAN, up BIGINT, cnt BIGINT")
    out = {(r["id"], r["kind"]) for r in windows.outages(df, ["device"], ["t", "id"], F.col("ok"), **opts).collect()}
    stuck = {r["id"] for r in windows.stalls(df, ["device"], ["t", "id"], "up", "cnt", **opts).collect()}
    want, want_stuck = set(), set()
    for d in (0, 1):
        silent = run = p_up = p_cnt = 0
        for _, _, i, ok, up, cnt in [r for r in rows if r[0] == d]:
            if not ok:
                silent += 1
                if silent in (1, 3, 30):
                    want.add((i, {1: "NORESP_FIRST", 3: "OUTAGE_CONFIRMED", 30: "OUTAGE_SUSTAINED"}[silent]))
            else:
                if silent >= 3:
                    want.add((i, "OUTAGE_RECOVERED"))
                silent = 0
            if p_up and up < p_up:
                p_cnt, run = 0, 0
            run = run + 1 if p_cnt and cnt <= p_cnt else 0
            if run == 2:
                want_stuck.add(i)
            p_up, p_cnt = up, cnt
    assert out == want and stuck == want_stuck


@pytest.mark.parametrize("opts", SMALL)
def test_sustained_level_and_newest(spark, opts):
    rows = make_rows(13, 200)
    got = {(r["device"], r["since_us"], r["fire_us"]) for r in windows.sustained_level(frame(spark, rows), ["device"], "t", "id", "v", F.lit(0.3), 10, **opts).collect()}
    newest = {r["id"] for r in windows.newest(frame(spark, rows), ["device"], ["t", "id"], 9, **opts).collect()}
    want, want_new = set(), set()
    for d, rs in by_device(rows).items():
        want_new |= {r[2] for r in rs[-9:]}
        since, fired = None, False
        for _, t, _, v in rs:
            if v <= 0.3:
                since, fired = None, False
                continue
            since = t if since is None else since
            if not fired and t - since >= 10:
                want.add((d, since, t))
                fired = True
    assert got == want and newest == want_new


def test_number_names(spark):
    names = [f"cry-2024{m:02d}{d:02d}T{i:06d}" for m in (1, 2) for d in range(1, 20) for i in range(9)] + ["a", "zz"]
    df = spark.createDataFrame([(n,) for n in names], "name STRING")
    got = {r["name"]: r["i"] for r in chunks.number_names(df, "name", "i").collect()}
    assert got == {n: i for i, n in enumerate(sorted(names))}


def test_pointer_doubling():
    t = np.array([0, 1, 5, 6, 7, 20, 21, 40])
    for i in range(len(t)):
        assert folds.last_accepted(t, 6)[i] == t[folds.chain_from(t, i, 6)[-1]]


def test_null_key_is_an_error(spark):
    df = spark.createDataFrame([(None, 1, 1, 0.5), (1, 1, 2, 0.5)], "device INT, t BIGINT, id BIGINT, v DOUBLE")
    with pytest.raises(Exception, match="null in key column device"):
        chunks.with_chunks(df, ["device"], "t").collect()


def test_burst_inside_a_cell_is_cut_to_the_target(spark):
    hour = 3_600_000_000
    df = spark.range(200_000).select(F.lit(1).alias("device"), (F.col("id") * (hour // 200_000)).alias("t"), "id").union(
        spark.range(50).select(F.lit(1), F.col("id") * 24 * hour, F.col("id"))
    )
    sizes = [r["count"] for r in chunks.with_chunks(df, ["device"], "t", target_rows=20_000).groupBy("_chunk").count().collect()]
    assert sum(sizes) == 200_050 and max(sizes) <= 20_200


def test_decayed_peak_above_one(spark):
    scores = [1.2, 0.1, 1.05, 1.5, 0.1, 0.1]
    df = spark.createDataFrame([(1, i, i, v) for i, v in enumerate(scores)], "device INT, t BIGINT, id BIGINT, v DOUBLE")
    got = {r["id"]: r["peak"] for r in folds.decayed_peak(df, ["device"], "t", "id", "v", base_us=2).collect()}
    held, want = 0.0, []
    for v in scores:
        held = v if v > held else 0.95 * held
        want.append(held)
    assert [got[i] for i in range(6)] == pytest.approx(want)
