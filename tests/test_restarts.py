"""Listings polled by a stream, files processed once, frames put in order, matches saved once: over restarts and failures."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.config import Ingest
from touchline.operators import tracking
from touchline.plans.matches import pending, save_tables
from touchline.sources import readers
from touchline.streaming import ingest
from touchline.streaming.live import live_stabilizer


def run_once(writer, state):
    writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


# ---- a folder that is polled


def test_polls_of_a_folder_settle_once(spark, tmp_path):
    """A file that grows, one that is there, one that vanishes, one that comes late: the stream tells what the batch form tells."""
    root, polls = tmp_path / "in", f"{tmp_path}/polls"
    (root / "deep").mkdir(parents=True)
    size = {
        "grows.mp4": [1, 5, 9, 9, 9, 9], "there.mp4": [4, 4, 4, 4, 4, 4], "deep/vanishes.mp4": [3, 3, None, None, 3, 3],
        "late.mp4": [None, None, 2, 2, 2, 2], "empty.mp4": [0, 0, 0, 0, 0, 0], "changes.mp4": [7, 7, 8, 8, 7, 7],
    }
    for k in range(6):
        for name, sizes in size.items():
            if sizes[k] is not None:
                (root / name).write_bytes(b"x" * sizes[k])
            elif (root / name).exists():
                (root / name).unlink()
        ingest.poll_stream(spark, str(root), polls).option("checkpointLocation", f"{tmp_path}/ticks").trigger(once=True).start().awaitTermination()
        stream = ingest.stable_stream(ingest.snapshot_stream(spark, polls), Ingest(checks=2))
        run_once(stream.writeStream.format("parquet").option("path", f"{tmp_path}/out"), f"{tmp_path}/state")
    seen = spark.read.schema("path string, size bigint, mtime_ns bigint, poll_no bigint").parquet(polls)
    assert seen.select("poll_no").distinct().count() == 6
    from touchline.operators.ingest import stable_files

    want = {(r["path"].split("/")[-1], r["poll_no"], r["size"]) for r in stable_files(seen.select("path", "poll_no", "size"), Ingest(checks=2)).collect()}
    got = {(r["path"].split("/")[-1], r["poll_no"], r["size"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want == {("grows.mp4", 4, 9), ("there.mp4", 2, 4), ("late.mp4", 4, 2)}
    assert spark.read.parquet(f"{tmp_path}/out").where("mtime_ns IS NULL").isEmpty()


def test_a_poll_that_stands_is_not_listed_again(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.mp4").write_bytes(b"x")
    ingest.poll_once(spark, str(root), f"{tmp_path}/polls", 0)
    (root / "b.mp4").write_bytes(b"x")
    ingest.poll_once(spark, str(root), f"{tmp_path}/polls", 0)
    ingest.poll_once(spark, str(root), f"{tmp_path}/polls", 1)
    got = spark.read.parquet(f"{tmp_path}/polls").groupBy("poll_no").count().collect()
    assert {(r["poll_no"], r["count"]) for r in got} == {(0, 1), (1, 2)}


# ---- files processed once

FILES = "path string, size bigint, mtime_ns bigint"


def process_batches(spark, tmp_path, batches, process):
    for rows in batches:
        if rows:
            spark.createDataFrame(rows, FILES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(FILES).parquet(f"{tmp_path}/in")
        try:
            run_once(stream.writeStream.foreachBatch(ingest.process_once(process, f"{tmp_path}/ledger")), f"{tmp_path}/state")
        except Exception as e:
            if "stopped" not in str(e):
                raise


def results(spark, tmp_path):
    return sorted((r["path"], r["size"]) for r in ingest.read_results(spark, f"{tmp_path}/ledger", "path string, size bigint").collect())


@pytest.mark.parametrize("step", ["process", "_record"])
def test_a_failure_between_the_steps_processes_once(spark, tmp_path, monkeypatch, step):
    calls, fail, record = [], [True], ingest._record

    def stop_once(name):
        if name == step and fail:
            fail.clear()
            raise RuntimeError("stopped")

    def process(files):
        stop_once("process")
        calls.append(sorted(r["path"] for r in files.collect()))
        return files.select("path", "size")

    def stopping(*args):
        stop_once("_record")
        record(*args)

    monkeypatch.setattr(ingest, "_record", stopping)
    process_batches(spark, tmp_path, [[("/a.mp4", 1, 1), ("/b.mov", 1, 1), ("/.c.mp4", 1, 1)], [], [("/a.mp4", 1, 1), ("/d.mp4", 1, 1)]], process)
    assert calls == [["/a.mp4", "/b.mov"], ["/d.mp4"]]
    assert results(spark, tmp_path) == [("/a.mp4", 1), ("/b.mov", 1), ("/d.mp4", 1)]
    assert sorted(r["path"] for r in ingest.read_ledger(spark, f"{tmp_path}/ledger").collect()) == ["/a.mp4", "/b.mov", "/d.mp4"]


def test_the_ledger_holds_the_last_version_of_a_path(spark, tmp_path):
    """A file that is replaced, and then replaced by what it was before, is processed each time."""
    versions = [[("/a.mp4", 1, 1)], [("/a.mp4", 2, 2)], [("/a.mp4", 2, 2)], [("/a.mp4", 1, 1)]]
    process_batches(spark, tmp_path, versions, lambda files: files.select("path", "size"))
    assert results(spark, tmp_path) == [("/a.mp4", 1), ("/a.mp4", 1), ("/a.mp4", 2)]


def test_only_folders_of_the_batch_are_read(spark, tmp_path):
    process_batches(spark, tmp_path, [[(f"/f{i}.mp4", 1, 1) for i in range(40)]], lambda files: files.select("path", "size"))
    ledger = ingest.read_ledger(spark, f"{tmp_path}/ledger")
    plan = ledger.where(F.col("bucket").isin([3]))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:80]
    assert ledger.select("bucket").distinct().count() > 10


# ---- frames put in order

BEST = "match_id bigint, frame bigint, x double, y double"


@pytest.mark.parametrize(("seed", "hold"), [(1, 40), (2, 25)])
def test_shuffled_frames_equal_the_batch_fold(spark, tmp_path, seed, hold):
    rng, rows = random.Random(seed), []
    for match in (1, 2):
        x = 100.0
        for f in range(160):
            x += rng.choice([5, 5, 5, 300])
            if rng.random() < 0.85:
                rows.append((match, f, x % 1900, 400.0 + f % 7))
    late = [r for r in rows if r[1] in (10, 31)]
    rows = [r for r in rows if r not in late]
    shuffled = sorted(rows, key=lambda r: (r[1] + rng.randint(0, hold - 2), r[0]))  # no frame comes after one that is hold or more later
    parts = [shuffled[i : i + 45] for i in range(0, len(shuffled), 45)] + [late + [(m, 1000, None, None) for m in (1, 2)]]
    for part in parts:
        spark.createDataFrame(part, BEST).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = live_stabilizer(spark.readStream.schema(BEST).parquet(f"{tmp_path}/in"), hold=hold, late=True)
        run_once(stream.writeStream.format("parquet").option("path", f"{tmp_path}/out"), f"{tmp_path}/state")
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").where("frame < 150").select("match_id", "frame", "status", "reason", F.round("x", 6)).collect()]
    assert sorted((m, f) for m, f, s, *_ in got if s == "late") == sorted((r[0], r[1]) for r in late)
    boxes = spark.createDataFrame([(m, f, f, x - 5, y - 5, x + 5, y + 5, 0.9) for m, f, x, y in rows], "match_id bigint, frame bigint, det_id bigint, x1 double, y1 double, x2 double, y2 double, confidence double")
    batch = tracking.dense(tracking.stabilize_rows(boxes)).where("frame < 150").select("match_id", "frame", F.coalesce("status", F.lit("lost")), "reason", F.round("x", 6))
    key = lambda r: (r[0], r[1])
    assert sorted((r for r in got if r[2] != "late"), key=key) == sorted(map(tuple, batch.collect()), key=key)


def test_waiting_frames_are_taken_when_a_match_ends(spark, tmp_path):
    schema = f"{BEST}, at timestamp"
    rows = lambda match, frames, second: [(match, f, 100.0 + f, 100.0) for f in frames]
    for part, when in ((rows(1, [3, 1, 2, 0], 0), 60), (rows(2, [0], 9), 10**6), (rows(2, [1], 9), 2 * 10**6)):
        df = spark.createDataFrame(part, BEST).withColumn("at", F.timestamp_seconds(F.lit(when)))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = live_stabilizer(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), time="at", hold=100)
        run_once(stream.writeStream.format("parquet").option("path", f"{tmp_path}/out"), f"{tmp_path}/state")
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").where("match_id = 1").orderBy("frame").select("frame", "status").collect()]
    assert got == [(0, "rejected"), (1, "accepted"), (2, "accepted"), (3, "accepted")]


# ---- matches saved once


def test_a_killed_run_ends_with_each_match_once(spark, tmp_path):
    root, made = str(tmp_path / "runs"), []
    matches = spark.createDataFrame([(m, "normal" if m % 2 else "no_detect") for m in range(5)], "match_id bigint, mode string")

    def build(todo, killed=False):
        made.append(sorted(r["match_id"] for r in todo.collect()))
        tables = {k: todo.select("match_id", F.explode(F.array(F.lit(1), F.lit(2))).alias(k)) for k in ("one", "two")}
        if killed:
            tables["two"] = tables["two"].withColumn("two", F.raise_error(F.lit("stopped")).cast("int"))
        return tables

    save_tables(build, matches.where("match_id < 2"), root)
    with pytest.raises(Exception, match="stopped"):
        save_tables(lambda todo: build(todo, killed=True), matches, root)
    assert sorted(r["match_id"] for r in pending(matches, f"{root}/runs").collect()) == [2, 3, 4]
    save_tables(build, matches, root)
    save_tables(build, matches, root)
    assert made == [[0, 1], [2, 3, 4], [2, 3, 4]]
    for k in ("one", "two"):
        assert spark.read.parquet(f"{root}/{k}").count() == 10
    runs = spark.read.parquet(f"{root}/runs")
    assert sorted(r["match_id"] for r in runs.collect()) == [0, 1, 2, 3, 4] and {r["n_artifacts"] for r in runs.collect()} == {1, 5}


# ---- exported frames and manifests


def test_import_tasks_of_real_folders(spark, tmp_path):
    import json

    from touchline.operators.selection import import_tasks

    manifest = {"match_name": "m1", "hard_frames_exported": 3, "frames": [
        {"frame_index": 7, "reasons": ["low_confidence"], "predicted_bbox": [192.0, 96.0, 384.0, 192.0]}, {"frame_index": 8, "reasons": ["lost_ball_gap"]},
        {"frame_index": 9, "predicted_bbox": [0.0, 0.0, 19.2, 9.6]}, {"frame_index": 9, "predicted_bbox": None}, {"frame_index": 11, "predicted_bbox": [1.0, 1.0, 2.0, 2.0]},
    ]}
    for match in ("m1", "m2"):
        frames = tmp_path / f"match_id={match}" / "frames"
        frames.mkdir(parents=True)
        for name in ("frame_000007.jpg", "frame_000008.jpg", "frame_000009.jpg", "frame_000010.jpg", "mask_000007.jpg", "frame_000012.png"):
            (frames / name).write_bytes(b"x")
    (tmp_path / "match_id=m1" / "hard_frames.json").write_text(json.dumps(manifest, indent=2))
    tasks = import_tasks(readers.list_images(spark, str(tmp_path)), readers.read_manifests(spark, str(tmp_path)))
    got = {(r["match_id"], r["frame"]): json.loads(r["task"]) for r in tasks.collect()}
    assert sorted(got) == [(m, f) for m in ("m1", "m2") for f in (7, 8, 9, 10)]
    assert got["m1", 7] == {
        "data": {"image": "/data/labeling/m1/frames/frame_000007.jpg", "frame_index": 7, "match_name": "m1"},
        "predictions": [{"model_version": "ball_detector", "result": [{"from_name": "label", "to_name": "image", "type": "rectanglelabels", "value": {"x": 10.0, "y": 10.0, "width": 10.0, "height": 10.0, "rectanglelabels": ["ball"]}}]}],
    }
    assert all("predictions" not in t for k, t in got.items() if k != ("m1", 7))
    (tmp_path / "match_id=m2" / "hard_frames.json").write_text('{"frames": [')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.read_manifests(spark, str(tmp_path)).collect()


# ---- regions


@pytest.mark.parametrize(("n", "most"), [(300, 256), (300, 3), (5000, 20)])
def test_regions_match_brute_force(spark, n, most):
    from touchline.operators.highlights import region_events

    rng = np.random.default_rng(n + most)
    corner, side = rng.random((n, 2)), 2.0 ** -rng.uniform(3 if n > 1000 else 1, 14, (n, 2))
    boxes = np.concatenate((corner, corner + side), 1)
    boxes[: n // 3, :2] = boxes[0, :2] + rng.random((n // 3, 2)) / 500  # a crowded cell
    boxes[: n // 3, 2:] = boxes[: n // 3, :2] + rng.random((n // 3, 2)) / 300
    boxes[-3:] = [[0.5, 0.5, 0.5, 0.5], [0.7, 0.7, 0.6, 0.8], [-5.0, 0.1, 9.0, 0.10001]]
    points = np.concatenate((rng.random((400, 2)), boxes[: n // 3, :2], [[0.5, 0.5], [0.65, 0.75], [-0.2, 0.1]]))
    want = [((boxes[:, 0] <= x) & (x <= boxes[:, 2]) & (boxes[:, 1] <= y) & (y <= boxes[:, 3])).any() for x, y in points]
    rows = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(points)] + [(1, 10**6, None, 1.0)], BEST)
    got = region_events(rows.unionByName(rows.limit(5)), spark.createDataFrame(boxes.tolist(), "x1 double, y1 double, x2 double, y2 double"), 1.0, 1.0, most)
    assert sorted(r["frame"] for r in got.collect()) == sorted([i for i, w in enumerate(want) if w] + [i for i in range(5) if want[i]])
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


# ---- tracker


def plain_tracks(frames, cfg):
    """Tracks by the textbook: 8 x 8 matrices, and the cheapest of all assignments. frames: per frame a list of (box, confidence)."""
    import itertools

    eye = np.eye(8)
    move, see, noise, start = eye + np.eye(8, k=4), eye[:4], np.diag([1.0] * 4 + [0.01] * 4), np.diag([10.0] * 4 + [10000.0] * 4)
    z_of = lambda b: np.array([(b[0] + b[2]) / 2, (b[1] + b[3]) / 2, (b[2] - b[0]) * (b[3] - b[1]), (b[2] - b[0]) / (b[3] - b[1] + 1e-6)])

    def box_of(t):
        cx, cy, area, aspect = t["x"][:4]
        w = np.sqrt(max(area * aspect, 1e-6))
        return cx - w / 2, cy - area / (w + 1e-6) / 2, cx + w / 2, cy + area / (w + 1e-6) / 2

    def overlap(a, b):
        both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both + 1e-6)

    def match(tracks, found):
        if not tracks or not found:
            return []
        cost = [[1 - overlap(box_of(t), b) for b, _ in found] for t in tracks]
        few, many = sorted((len(tracks), len(found)))
        at = (lambda p: [(i, j) for i, j in enumerate(p)]) if len(tracks) == few else (lambda p: [(j, i) for i, j in enumerate(p)])
        best = min(itertools.permutations(range(many), few), key=lambda p: sum(cost[i][j] for i, j in at(p)))
        pairs = [(i, j) for i, j in at(best) if 1 - cost[i][j] >= cfg.match]
        for i, j in pairs:
            t, (box, conf) = tracks[i], found[j]
            s = see @ t["p"] @ see.T + np.eye(4)
            gain = t["p"] @ see.T @ np.linalg.inv(s)
            t["x"] = t["x"] + gain @ (z_of(box) - see @ t["x"])
            t["p"] = (eye - gain @ see) @ t["p"]
            t["idle"], t["streak"], t["conf"] = 0, t["streak"] + 1, conf
        return pairs

    live, made, out = [], 0, []
    for frame, found in enumerate(frames):
        for t in live:
            if t["x"][6] + t["x"][2] <= 0:
                t["x"][6] = 0
            t["x"], t["p"] = move @ t["x"], move @ t["p"] @ move.T + noise
            t["streak"], t["idle"] = 0 if t["idle"] else t["streak"], t["idle"] + 1
        high, low = [d for d in found if d[1] >= cfg.high], [d for d in found if cfg.low <= d[1] < cfg.high]
        pairs = match(live, high)
        match([t for i, t in enumerate(live) if i not in {i for i, _ in pairs}], low)
        for j, (box, conf) in enumerate(high):
            if j not in {j for _, j in pairs} and conf >= cfg.new:
                made += 1
                live.append({"x": np.concatenate((z_of(box), np.zeros(4))), "p": start.copy(), "id": made, "idle": 0, "streak": 1, "conf": conf})
        live = [t for t in live if t["idle"] == 0] + [t for t in live if 0 < t["idle"] <= cfg.buffer]
        out += [(frame, t["id"], *box_of(t), 0.7 * t["conf"] + 0.3 * min(t["streak"] / 5, 1)) for t in live if t["idle"] == 0]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_tracker_matches_the_textbook(spark, seed):
    from touchline.config import ByteTrack

    rng, cfg = random.Random(seed), ByteTrack(buffer=4)
    balls = [[rng.uniform(100, 400), rng.uniform(100, 300), rng.uniform(-6, 6), rng.uniform(-6, 6), rng.uniform(20, 40)] for _ in range(4)]
    frames = []
    for f in range(60):
        found = []
        for b in balls:
            b[0], b[1] = b[0] + b[2], b[1] + b[3]
            if rng.random() < 0.75:
                x, y, s = b[0] + rng.uniform(-3, 3), b[1] + rng.uniform(-3, 3), b[4] + rng.uniform(-2, 2)
                found.append(((x - s, y - s, x + s, y + s), rng.choice([0.05, 0.2, 0.3, 0.5, 0.7, 0.9])))
        frames.append([] if 25 <= f < 33 else found)
    rows = [(1, f, 10 * f + i, *map(float, box), conf) for f, found in enumerate(frames) for i, (box, conf) in enumerate(found)]
    dets = spark.createDataFrame(rows, "match_id bigint, frame bigint, det_id bigint, x1 double, y1 double, x2 double, y2 double, confidence double").repartition(3)
    got = sorted((r["frame"], r["track_id"], *r["bbox"], r["score"]) for r in tracking.bytetrack(dets, cfg).collect())
    want = sorted(plain_tracks(frames, cfg))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose(np.array(got), np.array(want), atol=1e-6)
    assert len(want) > 60


# ---- documents of long matches


def test_arrays_are_written_by_several_tasks(spark, tmp_path):
    import json

    from touchline.sources import writers

    rows = [(m, f, f / 2, [1.0, float(f)], "a, b]" if f % 3 else None) for m, n in ((1, 57), (2, 1), (3, 20)) for f in range(5, 5 + n)]
    df = spark.createDataFrame(rows, "match_id bigint, frame bigint, yaw double, bbox array<double>, status string").repartition(5)
    writers.write_arrays(df, f"{tmp_path}/out", per_file=10)
    back = readers.read_arrays(spark, f"{tmp_path}/out", "frame bigint, yaw double, bbox array<double>, status string", "bigint")
    assert sorted(map(tuple, back.collect())) == rows
    files = sorted(tmp_path.glob("out/match_id=1/block=*/*.txt"))
    assert len(files) == 7
    whole = json.loads("".join(f.read_text() for f in files))
    assert [x["frame"] for x in whole] == list(range(5, 62))
    (tmp_path / "out" / "match_id=1" / "block=000000099").mkdir()
    (tmp_path / "out" / "match_id=1" / "block=000000099" / "part-0.txt").write_text("[{broken\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.read_arrays(spark, f"{tmp_path}/out", "frame bigint", "bigint").collect()


# ---- percentiles by bins


@pytest.mark.parametrize("bins", [1, 7, 1024])
def test_percentile_by_bins_is_exact(spark, bins):
    from touchline.operators.highlights import percentile_by_bins

    rng = random.Random(bins)
    groups = {1: [4.5], 2: [1.0, 1.0, 1.0], 3: [rng.random() ** 8 * 1e6 for _ in range(500)], 4: [float(rng.randint(0, 3)) for _ in range(301)], 5: [0.1, 1e9], 6: [5.0] * 40 + [1e-3]}
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [(7, None), (3, None)], "k bigint, x double").repartition(3)
    for share in (0.0, 0.5, 0.95, 1.0):
        got = {r["k"]: r["percentile"] for r in percentile_by_bins(rows, "k", "x", share, bins).collect()}
        want = {r["k"]: r["p"] for r in rows.groupBy("k").agg(F.percentile("x", F.lit(share)).alias("p")).where("p IS NOT NULL").collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_matches_to_do_are_looked_for_once(spark, tmp_path):
    matches = spark.createDataFrame([(i, "normal") for i in range(4)], "match_id long, mode string")
    handed, built = [], []

    def hand_over(df):
        handed.append(spark.createDataFrame(df.collect(), df.schema))
        return handed[-1]

    def build(todo):
        built.append(todo)
        return {"t": todo.select("match_id", F.lit(1).alias("v"))}

    save_tables(build, matches.where("match_id < 2"), str(tmp_path), hand_over)
    save_tables(build, matches, str(tmp_path), hand_over)
    assert built == handed and [sorted(r["match_id"] for r in t.collect()) for t in built] == [[0, 1], [2, 3]]
    assert sorted(r["match_id"] for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [0, 1, 2, 3]
