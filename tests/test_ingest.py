from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from touchline.config import Ingest
from touchline.functions import naming
from touchline.operators import ingest
from touchline.sources import readers, writers
from touchline.streaming.ingest import process_once, stable_stream, without_repeats


def test_names(spark):
    rows = [("/a/b.tar.gz",), ("/a/.x",), ("/a/c",), ("/a/d.MP4",), ("/a/.x.mp4",), ("/a/e.",)]
    got = spark.createDataFrame(rows, "p string").select(naming.stem(naming.base_name(F.col("p"))).alias("s"), naming.all_suffixes(naming.base_name(F.col("p"))).alias("x")).collect()
    assert [tuple(r) for r in got] == [("b", ".tar.gz"), (".x", ""), ("c", ""), ("d", ".MP4"), (".x", ".mp4"), ("e.", "")]


def test_fingerprints(spark):
    rows = [(1, 2, 0, 0, 5), (-1, 2, 3, 4, 5), (1, None, 3, 4, 5), (1, 2, 9, 4, 0)]
    df = spark.createDataFrame(rows, "size bigint, mtime_ns bigint, ctime_ns bigint, ino bigint, dev bigint")
    assert [r["fp_key"] for r in ingest.with_fingerprint(df).collect()] == ["size=1,mtime_ns=2,dev=5", None, None, "size=1,mtime_ns=2,ino=4"]


def test_candidates(spark):
    rows = [("/in/.a.mp4",), ("/in/a.mp4.part",), ("/in/a.MOV",), ("/in/a.txt",), ("/in/b.insv",), ("/in/mp4",)]
    assert [r["path"] for r in ingest.ingest_candidates(spark.createDataFrame(rows, "path string")).collect()] == ["/in/a.MOV", "/in/b.insv"]


def test_replaced_file_is_processed_again(spark):
    files = ingest.with_fingerprint(spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "path string, size bigint, mtime_ns bigint"))
    ledger = spark.createDataFrame([("a", 1, 1), ("b", 1, 2)], "path string, size bigint, mtime_ns bigint")
    assert [r["path"] for r in ingest.unprocessed(files, ledger).collect()] == ["b"]


def test_stable_needs_equal_sizes_in_a_row(spark):
    sizes = {"a": [1, 2, 2, 2], "b": [0, 0, 0, 0], "c": [5, 5, 6, 6], "d": [5, 5, 5]}
    rows = [(p, i + 1, s) for p, all_ in sizes.items() for i, s in enumerate(all_)]
    df = spark.createDataFrame(rows, "path string, poll_no bigint, size bigint")
    assert {(r["path"], r["poll_no"]) for r in ingest.stable_files(df, Ingest(checks=2)).collect()} == {("a", 4), ("d", 3)}


def test_ten_polls_a_check_and_no_second_chance(spark):
    moving = list(range(1, 18))
    sizes = {"at 20": [*moving, 50, 50, 50], "at 21": [*moving, 18, 50, 50, 50], "gone": [1, 2, None, 2, 2, 2]}
    rows = [(p, i + 1, s) for p, all_ in sizes.items() for i, s in enumerate(all_) if s is not None]
    df = spark.createDataFrame(rows, "path string, poll_no bigint, size bigint")
    assert {(r["path"], r["poll_no"]) for r in ingest.stable_files(df, Ingest(checks=2)).collect()} == {("at 20", 20)}


def test_revalidation(spark):
    queue = spark.createDataFrame([("a", "k", 0), ("b", "k", 0), ("c", "k", 1), ("d", "k", 0)], "path string, fp_key string, requeue_count int")
    now = spark.createDataFrame([("a", "k"), ("b", "z"), ("c", "z")], "path string, fp_key string")
    got = {r["path"]: r["action"] for r in ingest.revalidate_queue(queue, now).collect()}
    assert got == {"a": "run", "b": "requeue", "c": "skip_changed", "d": "skip_missing"}


def arrivals(spark, names):
    return spark.createDataFrame([(f"/in/{i}.mp4", n, "j", i) for i, n in enumerate(names)], "src string, match string, job_id string, arrival bigint")


def plan(spark, names, existing=(), **how):
    rows = ingest.archive_plan(arrivals(spark, names), spark.createDataFrame([(n,) for n in existing], "name string"), Ingest(**how)).orderBy("arrival").collect()
    return [(r["dest"], r["status"], r["reason"]) for r in rows]


def test_archive_suffixes(spark):
    got = plan(spark, ["m", "m", "m"], ["m_j.mp4", "m_j_02.mp4"])
    assert [d for d, _, _ in got] == ["m_j_01.mp4", "m_j_03.mp4", "m_j_04.mp4"]


def test_archive_names_cross(spark):
    rows = [("a", "d", 0), ("a", "d", 1), ("a", "d_01", 2), ("y/../a", "d", 3), ("./q//a", "d", 4), ("q/a", "d", 5)]
    df = spark.createDataFrame([(f"/in/{i}.tar.gz", m, j, i) for m, j, i in rows], "src string, match string, job_id string, arrival bigint")
    got = ingest.archive_plan(df, spark.createDataFrame([("a_d_02.tar.gz",)], "name string")).orderBy("arrival").collect()
    assert [r["dest"] for r in got] == ["a_d.tar.gz", "a_d_01.tar.gz", "a_d_01_01.tar.gz", "a_d_03.tar.gz", "q/a_d.tar.gz", "q/a_d_01.tar.gz"]
    wanted = spark.createDataFrame([("job", 0), ("job", 1), ("job_run1", 2)], "name string, arrival bigint")
    dirs = ingest.unique_directories(wanted, spark.createDataFrame([], "name string")).orderBy("arrival").collect()
    assert [r["directory"] for r in dirs] == ["job", "job_run1", "job_run1_run1"]


def test_archive_skip_and_overwrite(spark):
    assert plan(spark, ["m", "n", "n"], ["m_j.mp4"], collision="skip") == [(None, "skip", None), ("n_j.mp4", "ok", None), (None, "skip", None)]
    assert plan(spark, ["m"], ["m_j.mp4"], collision="overwrite") == [("m_j.mp4", "ok", None)]


def test_archive_rejects_names(spark):
    assert [r for _, _, r in plan(spark, ["/m", "../m", "a/../../b", "a/../b"])] == ["absolute", "escapes", "escapes", None]
    assert plan(spark, [" "], template="{match}") == [(None, "reject", "empty")]


def test_run_directories(spark):
    wanted = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "name string, arrival bigint")
    got = ingest.unique_directories(wanted, spark.createDataFrame([("a",), ("a_run1",)], "name string")).collect()
    assert {(r["name"], r["arrival"], r["directory"]) for r in got} == {("a", 1, "a_run2"), ("a", 2, "a_run3"), ("b", 1, "b")}


def test_ledger_lines(spark):
    good = json.dumps({"path": "a", "size": 1, "mtime_ns": 2, "processed_at": "2024-01-01T00:00:00"})
    lines = spark.createDataFrame([(good,), ("{broken",), (json.dumps({"path": "b"}),), (None,)], "value string")
    valid, bad = ingest.parse_ledger(lines)
    assert [r["path"] for r in valid.collect()] == ["a"] and bad.count() == 3


def test_prune_keeps_the_latest(spark):
    rows = [("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 1, 2)), ("c", dt.datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "path string, processed_at timestamp")
    assert sorted(r["path"] for r in ingest.prune_ledger(df, Ingest(ledger_cap=2)).collect()) == ["b", "c"]
    assert ingest.prune_ledger(df, Ingest(ledger_cap=0)).count() == 3


def test_readers_round_trip(spark, tmp_path):
    lines = {"1": [{"frame": 0, "bbox": [1, 2, 3, 4], "confidence": 0.5, "class": 32}, {"frame_index": 1, "bbox_xyxy": [1, 2, 3, 4], "conf": 0.6, "class_id": 32}]}
    for m, rows in lines.items():
        (folder := tmp_path / "in" / f"match_id={m}").mkdir(parents=True)
        (folder / "detections.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
        (folder / "camera_path.json").write_text(json.dumps([{"yaw": 1.0, "pitch": 2.0, "fov": 90.0}] * 2))
        (folder / "tracks.json").write_text(json.dumps([{"frame": 0, "ball": None, "status": "lost"}, {"frame": 1, "ball": {"x": 1.0, "y": 2.0, "bbox": [1, 2, 3, 4], "confidence": 0.5, "track_id": 1}}]))
        (folder / "ffprobe_meta.json").write_text(json.dumps({"streams": [{"codec_type": "video", "codec_name": "hevc", "width": 10, "height": 5, "r_frame_rate": "25"}], "format": {"duration": "2.5"}}))
        (folder / "frame_000001.txt").write_text("0 0.5 0.5 0.1 0.1\nbroken\n")
    root = str(tmp_path / "in")
    got = readers.read_detections(spark, root).orderBy("frame").collect()
    assert [(r["frame"], r["confidence"], r["class_id"], r["x2"]) for r in got] == [(0, 0.5, 32, 3.0), (1, 0.6, 32, 3.0)]
    assert [(r["frame"], r["yaw"]) for r in readers.read_camera_path(spark, root).orderBy("frame").collect()] == [(0, 1.0), (1, 1.0)]
    assert [r["ball"] is None for r in readers.read_tracks(spark, root).orderBy("frame").collect()] == [True, False]
    assert [(r["fps"], r["total_frames"], r["codec"]) for r in readers.read_matches(spark, root).collect()] == [(25.0, 62, "hevc")]
    assert [(r["stem"], r["cx"]) for r in readers.read_yolo_labels(spark, root).collect()] == [("frame_000001", 0.5)]
    assert readers.list_files(spark, root).count() == 5
    writers.write_documents(writers.documents_of(readers.read_camera_path(spark, root)), str(tmp_path / "out"))
    writers.write_runs(writers.run_summary(spark.createDataFrame([("1", "normal")], "match_id string, mode string"), writers.artifact_plan(spark.createDataFrame([("1", "normal")], "match_id string, mode string"))), str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).first()["n_artifacts"] == 5


def test_broken_line_fails(spark, tmp_path):
    import pytest

    (folder := tmp_path / "match_id=1").mkdir()
    (folder / "detections.jsonl").write_text('{"frame": 0}\n{"frame": \n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.read_detections(spark, str(tmp_path)).collect()


def run_stream(df, path, **how):
    q = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def test_stable_stream_equals_batch(spark, tmp_path):
    sizes = {"a": [1, 2, 2, 2], "b": [0, 0, 0, 0], "c": [5, 5, 6, 6], "d": [5, 5, 5]}
    rows = [(p, i + 1, s) for p, all_ in sizes.items() for i, s in enumerate(all_)]
    schema = "path string, poll_no bigint, size bigint"
    for lo, hi in ((0, 2), (2, 9)):  # two runs: the state survives the restart
        spark.createDataFrame([r for r in rows if lo < r[1] <= hi], schema).write.mode("append").parquet(f"{tmp_path}/in")
        run_stream(stable_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), Ingest(checks=2)), tmp_path)
    assert {(r["path"], r["poll_no"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("a", 4), ("d", 3)}


def test_states_of_paths_expire_by_event_time(spark, tmp_path):
    """Path a is settled; two hours later its state is gone, so it is reported again."""
    schema = "path string, poll_no bigint, size bigint, at timestamp"
    day = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    parts = [[("a", i, 5, day(1, i)) for i in (1, 2, 3)], [("b", 1, 0, day(5, 0))], [("b", 2, 0, day(6, 0))], [("a", i, 5, day(7, i)) for i in (1, 2, 3)]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run_stream(stable_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), Ingest(checks=2), time="at"), tmp_path)
    assert [r["path"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["a", "a"]


def test_each_file_is_processed_once_over_restarts(spark, tmp_path):
    schema, done, fail = "path string, size bigint, mtime_ns bigint", [], [True]

    def process(batch):
        if fail:
            fail.clear()
            raise RuntimeError("stopped")
        done.extend(r["path"] for r in batch.collect())

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = stream.writeStream.foreachBatch(process_once(process, f"{tmp_path}/ledger")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    spark.createDataFrame([("/in/a.mp4", 1, 1), ("/in/.b.mp4", 1, 1)], schema).write.parquet(f"{tmp_path}/in")
    try:
        run()
    except Exception as e:
        assert "stopped" in str(e)
    run()
    spark.createDataFrame([("/in/a.mp4", 1, 1), ("/in/c.mp4", 1, 1), ("/in/a.mp4", 2, 2)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert sorted(done) == ["/in/a.mp4", "/in/a.mp4", "/in/c.mp4"]


def test_repeats_in_flight_count_once(spark, tmp_path):
    schema = "path string, fp_key string, seen timestamp"
    rows = [("a", "k", dt.datetime(2024, 1, 1)), ("a", "k", dt.datetime(2024, 1, 1, 0, 5)), ("a", "z", dt.datetime(2024, 1, 1))]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    run_stream(without_repeats(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), tmp_path)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def plain_plan(names, existing, numbered):
    used, out = set(existing), []
    for name in names:
        got, i = name, 1
        while got in used:
            got, i = numbered(name, i), i + 1
        used.add(got)
        out.append(got)
    return out


@pytest.mark.parametrize(("seed", "ranked", "block"), [(1, 5000, 256), (2, 7, 4)])
def test_one_name_meets_its_free_numbers_over_tasks(spark, monkeypatch, seed, ranked, block):
    monkeypatch.setattr(ingest, "RANKED", ranked)
    monkeypatch.setattr(ingest, "BLOCK", block)
    rng = random.Random(seed)
    names = [rng.choice(["m", "m", "m", "q/m", "lonely"]) for _ in range(120)]
    existing = ["m_j.mp4", "m_j_1.mp4", "m_j_001.mp4", "m_j_00.mp4", "m_j_x.mp4", "other_01.mp4", "q/m_j_02.mp4"] + [f"m_j_{i:02d}.mp4" for i in rng.sample(range(1, 160), 60)]
    got = [d for d, _, _ in plan(spark, names, existing)]
    assert got == plain_plan([f"{n}_j.mp4" for n in names], existing, ingest.numbered_file)
    wanted = spark.createDataFrame([("a", i) for i in range(40)], "name string, arrival bigint")
    held = [("a_run3",), ("a_run03",), ("a_run0",), ("a_run4",), ("a_run9",)]
    dirs = ingest.unique_directories(wanted, spark.createDataFrame(held, "name string")).orderBy("arrival").collect()
    assert [r["directory"] for r in dirs] == plain_plan(["a"] * 40, [h for (h,) in held], lambda n, i: f"{n}_run{i}")


def test_numbered_columns_equal_the_plain_form(spark):
    names = ["a.mp4", "q/a.tar.gz", ".hid", "q/.hid.x", "dot.", "a_01.mp4", "no", "q.r/no", "a b.mov", "..x.y"]
    df = spark.createDataFrame([(n, i) for n in names for i in (1, 9, 10, 123)], "name string, i bigint")
    for r in df.select("name", "i", ingest.FILES.with_number(F.col("name"), F.col("i")).alias("got")).collect():
        assert r["got"] == ingest.numbered_file(r["name"], r["i"])
    back = df.select("name", "i", ingest.FILES.with_number(F.col("name"), F.col("i")).alias("made"))
    for r in back.select("name", "i", *(c.alias(k) for k, c in zip(("base", "number"), ingest.FILES.without(F.col("made")), strict=True))).collect():
        assert (r["base"], r["number"]) == (r["name"], r["i"])


def test_arrivals_of_one_family_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(ingest, "RANKED", 2000)
    n = 20_000
    rows = spark.range(n).select(F.concat(F.lit("/in/"), "id", F.lit(".mp4")).alias("src"), F.lit("m").alias("match"), F.lit("j").alias("job_id"), F.col("id").alias("arrival"))
    taken = spark.createDataFrame([("m_j_02.mp4",)], "name string")
    bins = ingest.ranked(rows.withColumn("name", F.lit("m")), "name", ["arrival", "src"])
    assert bins.where("rank <> arrival").isEmpty()
    got = ingest.archive_plan(rows, taken)
    assert got.select("dest").distinct().count() == n and got.agg(F.max("dest")).first()[0] == "m_j_9999.mp4"
    assert got.where("arrival = 2").first()["dest"] == "m_j_03.mp4"


def test_taken_names_go_only_where_their_family_is_dealt_with_in_order(spark, monkeypatch):
    """No task gets the taken names of a large family, be it large by its arrivals or by its taken names."""
    monkeypatch.setattr(ingest, "RANKED", 20)
    seen, in_order = [], ingest._in_order
    monkeypatch.setattr(ingest, "_in_order", lambda asked, taken, *how: seen.append((asked, taken)) or in_order(asked, taken, *how))
    wanted = [(f"a{'b' * (i % 3 == 0)}", i) for i in range(60)] + [("held", 0), ("held", 1), ("few", 0)]
    taken = [f"a_run{i}" for i in range(1, 40, 2)] + ["held"] + [f"held_run{i}" for i in range(1, 31)] + ["few"] + [f"unasked_run{i}" for i in range(1, 50)]
    got = ingest.unique_directories(spark.createDataFrame(wanted, "name string, arrival long"), spark.createDataFrame([(t,) for t in taken], "name string"))
    rows = {(r["name"], r["arrival"]): r["directory"] for r in got.collect()}
    used, want = set(taken), {}
    for name, at in sorted(wanted, key=lambda w: w[1]):
        free = next(n for n in (name, *(f"{name}_run{i}" for i in range(1, 200))) if n not in used)
        used.add(free)
        want[name, at] = free
    assert rows == want and [r["directory"] for r in got.where("name = 'few'").collect()] == ["few_run1"]
    (asked, held), = seen
    assert {r["family"] for r in held.collect()} <= {"few", "ab"} and {r["family"] for r in asked.select("family").distinct().collect()} == {"few", "ab"}
