from __future__ import annotations

import pytest

from touchline.config import HardFrames, Highlights, Labeling, Render
from touchline.operators import hardframes, highlights, render, selection
from tests.test_detections import box, table

XY = "match_id bigint, frame bigint, x double, y double"
BALL = "match_id bigint, frame bigint, ball struct<x:double,y:double>, status string"


def tracks(spark, xs, status=None):
    rows = [(1, f, None if x is None else (float(x), 0.0), None if status is None else status[f]) for f, x in enumerate(xs)]
    return spark.createDataFrame(rows, BALL)


def test_velocity_needs_both_rows(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, None, None), (1, 3, 90.0, 0.0)]
    got = [r["speed"] for r in highlights.ball_velocity(spark.createDataFrame(rows, XY)).orderBy("frame").collect()]
    assert got == pytest.approx([0, 300, 0, 0])


def test_goal_box_edges(spark):
    rows = [(1, f, x, 480.0) for f, x in enumerate((0.0, 153.6, 153.7, 1766.3, 1766.4, 1920.0))]
    df = spark.createDataFrame(rows, XY)
    assert [r["frame"] for r in highlights.goal_box_events(df).orderBy("frame").collect()] == [0, 1, 4, 5]
    regions = spark.createDataFrame([(*b,) for b in Highlights().boxes], "x1 double, y1 double, x2 double, y2 double")
    for most in (100, 0):
        assert sorted(r["frame"] for r in highlights.region_events(df, regions, most=most).collect()) == [0, 1, 4, 5]


def test_clusters_merge_at_the_gap_and_short_clips_go(spark):
    rows = [(1, f, f / 30.0, "speed", 1.0) for f in (300, 450, 601)] + [(2, 0, 0.0, "speed", 1.0)]
    events = spark.createDataFrame(rows, "match_id bigint, frame bigint, time_sec double, type string, value double")
    got = highlights.clips(highlights.cluster_events(events)).orderBy("match_id", "clip_id").collect()
    assert [(r["match_id"], r["event_count"]) for r in got] == [(1, 2), (1, 1), (2, 1)]
    assert highlights.clips(highlights.cluster_events(events), Highlights(before=0.0, after=1.0)).count() == 1


def test_lost_run_fires_once_and_again_after_a_break(spark):
    xs = [None] * 5 + [1] + [None] * 5
    got = hardframes.lost_run_triggers(tracks(spark, xs), Labeling(lost_run=5)).orderBy("frame").collect()
    assert [r["frame"] for r in got] == [4, 10]


def test_lost_run_resets_at_a_hole_in_the_frames(spark):
    df = tracks(spark, [None] * 20).where("frame NOT IN (3)")
    got = hardframes.lost_run_triggers(df, Labeling(lost_run=15)).collect()
    assert [r["frame"] for r in got] == [18]


def test_lost_gap_marks_every_frame_and_the_end(spark):
    got = hardframes.lost_gap_frames(tracks(spark, [1, None, None, None, 1, None]), HardFrames(gap=3)).orderBy("frame").collect()
    assert [(r["frame"], r["gap_length"]) for r in got] == [(1, 3), (2, 3), (3, 3)]


def test_jumps_need_neighbours(spark):
    got = hardframes.position_jumps(tracks(spark, [0, 200, None, 900, 1050]), HardFrames()).collect()
    assert [r["frame"] for r in got] == [1]


def test_reasons_come_in_order(spark):
    dets = table(spark, [box(1, 1, 2, 10, 10, 0.2), box(1, 1, 1, 20, 20, 0.1)])
    got = hardframes.hard_frames(dets, tracks(spark, [0, 200]), HardFrames()).collect()
    assert [(r["frame"], r["reasons"], r["conf"]) for r in got] == [(1, ["low_confidence", "position_jump"], 0.1)]


def test_threshold_frames(spark):
    dets = table(spark, [box(1, 0, 1, 1, 1, 0.9), box(1, 2, 2, 1, 1, 0.2), box(1, 3, 3, 1, 1, 0.9)])
    assert sorted(r["frame"] for r in hardframes.threshold_hard_frames(dets).collect()) == [1, 2]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 14])
def test_even_sampling_formula(spark, n):
    df = spark.createDataFrame([(1, f) for f in range(n)], "match_id bigint, frame bigint")
    for k in (-1, 0, 1, 3, 5, 7, 16):
        want = [] if k <= 0 else list(range(n)) if k >= n else [((2 * i + 1) * n) // (2 * k) for i in range(k)]
        assert sorted(r["frame"] for r in selection.evenly_sample(df, k).collect()) == want


def test_rare_frames_go_first(spark):
    rows = [(1, f, ["low_conf"]) for f in range(0, 100, 5)] + [(1, f, ["lost_run"]) for f in (11, 31)]
    df = spark.createDataFrame(rows, "match_id bigint, frame bigint, triggers array<string>")
    got = sorted(r["frame"] for r in selection.select_for_labeling(df, Labeling(cap=5)).collect())
    assert len(got) == 5 and {11, 31} < set(got) and all(f % 2 == 0 for f in got if f not in (11, 31))
    assert selection.select_for_labeling(df, Labeling(cap=0)).count() == 0
    assert sorted(r["frame"] for r in selection.select_for_labeling(df, Labeling(cap=1)).collect()) == [31]


def test_manifest_counts(spark):
    df = spark.createDataFrame([(1, f, ["low_conf"]) for f in range(4)] + [(2, 0, ["low_conf"])], "match_id bigint, frame bigint, triggers array<string>")
    got = {r["match_id"]: r for r in selection.manifest(df.where("match_id = 1 AND frame < 2"), df).collect()}
    assert (got[1]["identified"], got[1]["exported"], got[2]["exported"]) == (4, 2, 0) and "frame_000001.jpg" in got[1]["document"]


def test_dataset_split_sizes(spark):
    pairs = spark.createDataFrame([("a", str(i)) for i in range(10)], "match_id string, stem string")
    got = [r["split"] for r in selection.build_dataset(pairs).collect()]
    assert (got.count("train"), got.count("val")) == (8, 2)
    assert [r["split"] for r in selection.build_dataset(pairs.limit(1)).collect()] == ["train"]


def test_label_tasks_accept_both_names(spark):
    df = spark.createDataFrame([(1, 0, [192.0, 96.0, 384.0, 192.0], None), (1, 1, None, [0.0, 0.0, 19.2, 9.6]), (1, 2, None, None)], "match_id bigint, frame bigint, bbox array<double>, predicted_bbox array<double>")
    got = selection.label_tasks(df).orderBy("frame").collect()
    assert [(r["x"], r["w"]) for r in got] == [(10.0, 10.0), (0.0, 1.0), (None, None)] and "rectanglelabels" in got[0]["task"]


def test_segments_cover_all_frames_once(spark):
    m = spark.createDataFrame([(1, 30.0, 100), (2, 30.0, 5), (3, 30.0, 0)], "match_id bigint, fps double, total_frames bigint")
    seg = render.render_segments(m, Render()).orderBy("match_id", "segment").collect()
    sizes = {k: [r["stop"] - r["start"] for r in seg if r["match_id"] == k] for k in (1, 2, 3)}
    assert sizes == {1: [9, 9, 9, 9, 8, 8, 8, 8, 8, 8, 8, 8], 2: [1] * 5, 3: []}
    assert [r["warm_start"] for r in seg if r["match_id"] == 1][:3] == [0, 0, 3]


def test_warm_up_frames_look_where_the_segment_starts(spark):
    m = spark.createDataFrame([(1, 10.0, 20)], "match_id bigint, fps double, total_frames bigint")
    path = spark.createDataFrame([(1, f, float(f), 0.0, 90.0) for f in range(20)], "match_id bigint, frame bigint, yaw double, pitch double, fov double")
    plan = render.render_plan(path, render.render_segments(m, Render(parts=2)), Render(parts=2))
    warm = plan.where("warm_up").orderBy("frame").collect()
    assert [(r["frame"], r["yaw"]) for r in warm] == [(f, 10.0) for f in range(5, 10)] and plan.count() == 25
