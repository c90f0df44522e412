"""Files on disk, ledger replay, models, releases and streams."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from soundledger.operators import joins, labels, ledger, models
from soundledger.sources import readers as R
from soundledger.streaming import folds, jobs

LEDGER = "line BIGINT, op STRING, path STRING, size BIGINT, mtime BIGINT, sha256 STRING, sync_state STRING, category STRING"


def test_ledger_file_replay(spark, tmp_path):
    lines = [
        {"ts": 1, "op": "register", "path": "/a.wav", "size": 100, "mtime": 1, "sha256": "aa", "sync_state": "pending", "category": "wav"},
        {"ts": 2, "op": "register", "path": "/b.wav", "size": 200, "mtime": 2, "sha256": "bb", "sync_state": "pending", "category": "wav"},
        {"ts": 3, "op": "ack", "path": "/a.wav", "sync_state": "synced"},
        {"ts": 4, "op": "purge", "path": "/b.wav"},
        {"ts": 5, "op": "compact", "entries": 1},
    ]
    (tmp_path / "ledger.jsonl").write_text("\n".join(json.dumps(x) for x in lines) + "\n{broken\n")
    events = R.read_ledger(spark, str(tmp_path / "ledger.jsonl"))
    assert [tuple(r)[:3] + (r["sync_state"],) for r in ledger.replay(events).collect()] == [("/a.wav", 100, 1, "synced")]
    state = ledger.replay(events)
    again = ledger.compact(state, 9).filter("op = 'register'").withColumn("line", F.lit(0).cast("bigint"))
    assert ledger.replay(again).collect() == state.collect()


def test_ledger_random(spark):
    rng = np.random.default_rng(3)
    ops = ["register", "close", "ack", "purge", "odd"]
    rows = [
        (i, str(rng.choice(ops)), f"p{rng.integers(8)}", int(rng.integers(99)), i, str(i), "synced" if rng.random() < 0.2 else "pending", "wav") for i in range(300)
    ]
    table = {}
    for _, op, path, size, mtime, sha, st, cat in rows:
        if op == "purge":
            table.pop(path, None)
        elif op in ("register", "close"):
            table[path] = [size, sha, st]
        elif op == "ack" and path in table:
            table[path][2] = "synced"
    got = {r["path"]: [r["size"], r["sha256"], r["sync_state"]] for r in ledger.replay(spark.createDataFrame(rows, LEDGER)).collect()}
    assert got == table


def test_manifest_pages(spark):
    rows = [(f"p{i}", 1, i // 3, "s") for i in range(20)]
    df = spark.createDataFrame(rows, "path STRING, size BIGINT, mtime BIGINT, sha256 STRING")
    page = ledger.manifest_page(df, 0, 5).orderBy("mtime", "path").collect()
    assert len(page) == 5 and all(r["truncated"] and r["next_since"] == 2 for r in page)
    assert ledger.manifest_page(df, 5, 5).filter("truncated").count() == 0
    seen, after = [], (-1, "")
    while True:
        part = ledger.keyset_page(df, after, 7).collect()
        if not part:
            break
        seen += [r["path"] for r in part]
        after = max((r["mtime"], r["path"]) for r in part)
    assert sorted(seen) == sorted(r[0] for r in rows)


def test_sync_plan_rules(spark):
    remote = spark.createDataFrame(
        [("/s/a", 1, "x", "wav", False), ("/s/b", 1, "x", "wav", True), ("/s/c", 1, "", "wav", False), ("/s/d", 2, "x", "wav", False), ("/s/e", 1, "x", "odd", False), ("/s/f", 1, "y", "wav", None)],
        "path STRING, size BIGINT, sha256 STRING, category STRING, mutable BOOLEAN",
    )
    mirror = spark.createDataFrame([("wavs/b", 1, "x"), ("wavs/c", 1, "x"), ("wavs/d", 1, "x"), ("misc/e", 1, "x"), ("wavs/f", 1, "x")], "path STRING, size BIGINT, sha256 STRING")
    plan = lambda v: {r["path"]: r["reason"] for r in joins.sync_plan(remote, mirror, v).collect()}
    assert plan(False) == {"/s/a": "missing", "/s/b": "mutable", "/s/c": "no remote sha", "/s/d": "size mismatch", "/s/e": "present", "/s/f": "present"}
    assert plan(True)["/s/f"] == "verify sha mismatch" and plan(True)["/s/e"] == "verified"


def test_session_files(spark, tmp_path):
    for session, files in {"night-1": ["a", "b"], "night-2": ["b", "c"], "night-3": ["d"]}.items():
        d = tmp_path / session
        d.mkdir()
        (d / "manifest.csv").write_text("file,hnr_db\n" + "".join(f"{f},{session[-1]}\n" for f in files))
        if session != "night-3":
            (d / "yamnet_files.csv").write_text("file,max_speech\n" + "".join(f"{f},0.{session[-1]}\n" for f in files if f != "c"))
    got = {r["file"]: (r["session_id"], r["hnr_db"], r["max_speech"]) for r in R.read_sessions(spark, str(tmp_path)).collect()}
    assert got == {"a": ("night-1", "1", "0.1"), "b": ("night-1", "1", "0.1"), "c": ("night-2", "2", None)}


def test_event_log_and_listing(spark, tmp_path):
    tail = ",boot,0.1,0.2,10.0,5.0,1,680,9,1.40,1,2,-60,3"
    v3 = ",0.5" * 20
    (tmp_path / "e.log").write_text(f"2026-04-18T08:15:42.123+11:00,7{tail}{v3}\nup=7s,NOT_SYNCED,7{tail}{v3}\n2026-04-18T08:15:42.123+11:00,7{tail}\nshort,row\n")
    rows = R.read_event_log(spark, str(tmp_path / "e.log")).collect()
    assert [(r["uptime_s"], r["event"], r["not_synced"], len(r["watched"])) for r in rows] == [(7, "boot", False, 20), (7, "boot", True, 20), (7, "boot", False, 0)]
    assert rows[0]["ts"] is not None and rows[1]["ts"] is None and rows[0]["state"] == 3
    (tmp_path / "ls.json").write_text(json.dumps({"entries": [{"name": "x", "type": "file", "size": 3, "mtime": 4}]}))
    assert R.read_listing(spark, str(tmp_path / "ls.json")).first().asDict() == {"name": "x", "type": "file", "size": 3, "mtime": 4}
    (tmp_path / "map.csv").write_text('index,mid,display_name\n0,/m/1,Speech\n1,/m/2,"Child speech, kid speaking"\n')
    assert R.read_class_map(spark, str(tmp_path / "map.csv"), 2).filter("index = 1").first()["display_name"] == "Child speech, kid speaking"
    with pytest.raises(ValueError):
        R.read_class_map(spark, str(tmp_path / "map.csv"))


def newton(x, y, w, steps=50):
    """Unit-penalty logistic regression by Newton steps; the intercept is free."""
    a = np.hstack([x, np.ones((len(x), 1))])
    pen = np.diag([1.0] * x.shape[1] + [0.0])
    b = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-a @ b))
        b -= np.linalg.solve(a.T @ (a * (w * p * (1 - p))[:, None]) + pen, a.T @ (w * (p - y)) + pen @ b)
    return b


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) * [1, 5, 0.1] + [0, 10, 3]
    y = (x[:, 0] + 0.2 * x[:, 1] + rng.normal(size=200) > 2.8).astype(int)
    rows = [(list(map(float, r)), int(v), f"s{i % 4}") for i, (r, v) in enumerate(zip(x, y))] + [(None, 1, "s0")]
    df = spark.createDataFrame(rows, "x ARRAY<DOUBLE>, y INT, session STRING")
    m = models.fit_logistic(df, "x", "y")
    z = (x - x.mean(0)) / x.std(0)
    w = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (200 - y.sum())))
    b = newton(z, y, w)
    assert np.allclose([*m.weights, m.intercept], b, atol=1e-4)
    got = [r["p"] for r in df.select(m.probability(F.col("x")).alias("p")).collect()]
    assert got[-1] is None and np.allclose(got[:-1], 1 / (1 + np.exp(-(z @ b[:3] + b[3]))), atol=1e-4)
    scored = models.hold_one_out(df.filter("x IS NOT NULL"), "session", "x", "y")
    ev = {r["session"]: r for r in models.evaluation(scored, "session", "y").collect()}
    pooled = scored.select("y", "prob").collect()
    pos, neg = [r["prob"] for r in pooled if r["y"]], [r["prob"] for r in pooled if not r["y"]]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert ev[None]["auc"] == pytest.approx(auc) and ev[None]["n"] == 200 and set(ev) == {None, "s0", "s1", "s2", "s3"}


def test_subtypes(spark):
    rng = np.random.default_rng(1)
    centres = {"fuss": 300, "full_cry": 600, "distress": 900, "screech": 1400}
    rows = [(n, [float(hz + rng.normal(0, 10)), float(hz / 2 + rng.normal(0, 10))]) for n, hz in centres.items() for _ in range(30)] + [("none", None)]
    df = spark.createDataFrame(rows, "name STRING, x ARRAY<DOUBLE>")
    fit = models.fit_subtypes(df, "x", pitch_index=0, restarts=8)
    got = df.select("name", fit.label(F.col("x")).alias("label")).collect()
    assert all(r["label"] == (None if r["name"] == "none" else r["name"]) for r in got)
    assert models.fit_subtypes(df.limit(7), "x", 0) is None


def test_release_is_frozen(spark, tmp_path):
    rows = [(f"cry-{i:03d}.wav", f"night-{i % 2}", "high_pos" if i % 3 else "low", 0.81234, 0.1, 0.9) for i in range(6)]
    master = spark.createDataFrame(rows, "capture_file STRING, session_id STRING, confidence_tier STRING, consensus_score DOUBLE, oracle_agreement DOUBLE, s1 DOUBLE")
    caps = labels.release_captures(master, scores=["s1"])
    header = labels.release_header(caps, "v1", git="abc")
    h = header.first()
    assert h["n_captures"] == 6 and h["train_eligible_n"] == 4 and h["n_sessions"] == 2 and h["git"] == "abc"
    assert h["split_distribution"] == {"train": 4, "val": 1, "test": 1}
    labels.write_release(caps, header, str(tmp_path), "v1")
    with pytest.raises(Exception, match="(?i)exist"):
        labels.write_release(caps, header, str(tmp_path), "v1")
    by_session = labels.release_captures(master, by="session").select("session_id", "split").distinct()
    assert by_session.count() == 2
    text = labels.render_inventory(labels.inventory(master.withColumn("day", F.lit("d1")).withColumn("cluster_label", F.lit(""))))
    assert "TOTAL" in text and "## readiness" in text


def test_monitor_over_batches(spark, tmp_path):
    """The same polls in one file or in many give the same anomalies."""
    rng = np.random.default_rng(5)
    polls = [
        dict(device=int(rng.integers(2)), t=i, id=i, answered=bool(rng.random() < 0.6), parse_error=bool(rng.random() < 0.05), uptime=int(rng.integers(60)), state="idle",
             peak=float(rng.random()), alerts=int(rng.integers(3)), overruns=int(rng.integers(400)), counter=int(rng.integers(4)), captures=int(rng.integers(9)) if rng.random() < 0.8 else None)
        for i in range(120)
    ]
    schema = "device INT, t BIGINT, id BIGINT, answered BOOLEAN, parse_error BOOLEAN, uptime BIGINT, state STRING, peak DOUBLE, alerts BIGINT, overruns BIGINT, counter BIGINT, captures BIGINT"
    found = []
    for parts in (1, 4):
        src = tmp_path / f"src{parts}"
        src.mkdir()
        for p in range(parts):
            rows = polls[p * 120 // parts : (p + 1) * 120 // parts]
            (src / f"{p}.json").write_text("\n".join(map(json.dumps, rows)))
            os.utime(src / f"{p}.json", (1000 + p, 1000 + p))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
        out = jobs.run_to_table(folds.monitor_stream(stream, ["device"], "t", "id"), str(tmp_path / f"out{parts}"))
        found.append(sorted(tuple(r) for r in out.select("device", "id", "kind").collect()))
    assert found[0] == found[1] and len({k for _, _, k in found[0]}) >= 9


def test_ledger_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(7)
    src = tmp_path / "src"
    src.mkdir()
    ops = ["register", "close", "ack", "purge"]
    rows = [dict(line=i, op=str(rng.choice(ops)), path=f"p{rng.integers(12)}", size=i, mtime=i, sha256=str(i), sync_state="pending", category="wav") for i in range(90)]
    for p in range(3):
        (src / f"{p}.json").write_text("\n".join(map(json.dumps, rows[p * 30 : p * 30 + 30])))
    jobs.maintain_ledger(spark.readStream.schema(LEDGER).option("maxFilesPerTrigger", 1).json(str(src)), str(tmp_path / "state"))
    batch = ledger.replay(spark.read.schema(LEDGER).json(str(src)))
    key = lambda df: sorted((r["path"], r["size"], r["sync_state"]) for r in df.collect())
    assert key(jobs.ledger_state(spark, str(tmp_path / "state"))) == key(batch)


def test_noise_floor_halves():
    rule, state = folds.floor_rule("t", 4), ([0] * 4, 0, -1)
    for start, n in ((0, 30_000), (30_000, 35_536)):
        state, out = rule(pd.DataFrame({"t": np.arange(start, start + n), "_bin": np.arange(n) % 2}), state)
    assert state[1] == 32_768 and sum(state[0]) == 32_768 and state[2] == 0 and out["n"][0] == 32_768
    whole, _ = rule(pd.DataFrame({"t": np.arange(65_536), "_bin": np.arange(65_536) % 2}), ([0] * 4, 0, -1))
    assert whole == state


def slow_detector(rows, streak, hold):
    """The rule said row by row: hits in a row open, a miss long after the newest hit closes."""
    is_open, run, newest, out = False, 0, None, []
    for t, hit in rows:
        run, newest = (run + 1, t) if hit else (0, newest)
        if not is_open and run >= streak:
            is_open = True
            out.append((t, "crying"))
        elif is_open and not hit and t - newest >= hold:
            is_open = False
            out.append((t, "idle"))
    return out


def slow_trigger(rows, sustain, cooldown, warmup):
    since = fired = None
    start, out = rows[0][0], []
    for t, loud in rows:
        rest = fired is not None and t < fired + cooldown
        if not loud or rest or t < start + warmup:
            since = None
            continue
        since = t if since is None else since
        if t - since >= sustain:
            out.append(t)
            since, fired = None, t
    return out


def in_batches(rule, state, frame, cuts):
    out = []
    for part in np.split(np.arange(len(frame)), cuts):
        if len(part):
            state, made = rule(frame.iloc[part].reset_index(drop=True), state)
            out += list(made.itertuples(index=False, name=None))
    return out


def test_detector_and_trigger_rules_in_any_batches():
    rng = np.random.default_rng(11)
    for case in range(200):
        n = int(rng.integers(1, 120))
        t = np.cumsum(rng.integers(0, 4, n))
        mark = rng.random(n) < rng.choice([0.3, 0.6, 0.9])
        cuts = np.sort(rng.integers(0, n + 1, case % 5))
        rows = list(zip(t.tolist(), mark.tolist(), strict=True))
        streak, hold = int(rng.integers(1, 4)), int(rng.integers(1, 9))
        got = in_batches(folds.detector_rule("t", streak, hold), (False, 0, -(1 << 62)), pd.DataFrame({"t": t, "_hit": mark}), cuts)
        assert got == slow_detector(rows, streak, hold)
        sustain, cooldown, warmup = int(rng.integers(0, 8)), int(rng.integers(0, 20)), int(rng.integers(0, 10))
        frame = pd.DataFrame({"t": t, "_loud": mark, "_level": t * 2.0, "_p50": 0.5})
        fires = in_batches(folds.trigger_rule("t", sustain, cooldown, warmup), (-1, -1, -1), frame, cuts)
        assert [f[0] for f in fires] == slow_trigger(rows, sustain, cooldown, warmup), (rows, cuts, sustain, cooldown, warmup)
        assert all(f[1:] == (2.0 * f[0], 2.0 * f[0]) for f in fires)


def test_unheard_devices_and_late_rows(spark, tmp_path):
    devices = spark.createDataFrame([(i,) for i in range(4)], "device INT")
    polls = spark.createDataFrame([(0, 100, True), (1, 10, True), (2, 100, False)], "device INT, t BIGINT, answered BOOLEAN")
    assert {r["device"] for r in folds.unheard(devices, polls, ["device"], "t", 105, 30).collect()} == {1, 2, 3}
    src = tmp_path / "src"
    src.mkdir()
    for p, times in enumerate(([5, 9], [3, 8, 12])):
        (src / f"{p}.json").write_text("\n".join(json.dumps({"device": 1, "t": t}) for t in times))
        os.utime(src / f"{p}.json", (1000 + p, 1000 + p))
    stream = spark.readStream.schema("device INT, t BIGINT").option("maxFilesPerTrigger", 1).json(str(src))
    out = jobs.run_to_table(folds.late_rows(stream, ["device"], "t"), str(tmp_path / "out"))
    assert sorted((r["rows"], r["late"]) for r in out.collect()) == [(2, 0), (3, 2)]


def test_wav_files_below_sessions(spark, tmp_path):
    import wave

    from soundledger.operators import audio

    for night, name, n in (("night-1", "a", 16_000), ("night-2", "b", 40_000)):
        (tmp_path / night).mkdir()
        with wave.open(str(tmp_path / night / f"{name}.wav"), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(16_000)
            w.writeframes((1000 * np.sin(np.arange(n) / 10)).astype("<i2").tobytes())
    (tmp_path / "night-1" / "bad.wav").write_bytes(b"RIFF")
    (tmp_path / "night-1" / "notes.txt").write_text("no audio")
    captures = R.read_captures(spark, str(tmp_path))
    assert sorted((r["file"], r["session_id"]) for r in captures.select("file", "session_id").collect()) == [("a.wav", "night-1"), ("b.wav", "night-2"), ("bad.wav", "night-1")]
    rows = audio.file_rows(audio.capture_features(captures, ["file"], content="content")).collect()
    assert {r["file"]: r["samples"] for r in rows if r["samples"]} == {"a.wav": 16_000, "b.wav": 40_000}


def test_ledger_changes_are_merged(spark, tmp_path):
    rng = np.random.default_rng(8)
    src = tmp_path / "src"
    src.mkdir()
    ops = ["register", "close", "ack", "purge"]
    rows = [dict(line=i, op=str(rng.choice(ops)), path=f"p{rng.integers(12)}", size=i, mtime=i, sha256=str(i), sync_state="pending", category="wav") for i in range(90)]
    key = lambda df: sorted((r["path"], r["size"], r["sync_state"]) for r in df.collect())
    for p in range(3):
        (src / f"{p}.json").write_text("\n".join(map(json.dumps, rows[p * 30 : p * 30 + 30])))
        jobs.maintain_ledger(spark.readStream.schema(LEDGER).option("maxFilesPerTrigger", 1).json(str(src)), str(tmp_path / "state"))
        if p:
            jobs.compact_ledger(spark, str(tmp_path / "state"))
            assert len(list((tmp_path / "state" / "changes").glob("batch=*"))) == 0 and len(list((tmp_path / "state" / "merged").glob("upto=*"))) == 1
        assert key(jobs.ledger_state(spark, str(tmp_path / "state"))) == key(ledger.replay(spark.read.schema(LEDGER).json(str(src))))


def test_manifest_passes_keep_their_mark(spark, tmp_path):
    files = lambda rows, g: spark.createDataFrame([(p, t, g) for p, t in rows], "path STRING, mtime BIGINT, generation_id STRING")
    bad = {"b"}
    fetch = lambda todo: todo.select("path", "verify", (~F.col("path").isin(*bad)).alias("ok"))
    seen = lambda df: sorted((r["path"], r["verify"]) for r in df.collect())
    run = lambda rows, g: seen(jobs.manifest_run(spark, files(rows, g), str(tmp_path), fetch))
    one = [("a", 1), ("b", 2)]
    assert run(one, "g1") == [("a", False), ("b", False)]
    bad.clear()
    bad.add("none")
    assert run([*one, ("c", 3)], "g1") == [("b", False), ("c", False)]
    assert run([*one, ("c", 3)], "g1") == []
    assert run([("a", 1), ("c", 9)], "g2") == [("a", True), ("c", True)]
    assert run([("a", 1), ("c", 9), ("d", 10)], "g2") == [("d", False)]
