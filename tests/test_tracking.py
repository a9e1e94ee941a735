from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.config import BallSelection, ByteTrack, Camera, Stabilizer
from touchline.operators import camera, tracking
from tests.test_detections import box, table


def stable(spark, rows, **how):
    return [(r["frame"], r["status"], r["reason"]) for r in tracking.stabilize_ball(table(spark, rows), Stabilizer(**how)).orderBy("frame").collect()]


def test_persistence_then_acceptance(spark):
    assert stable(spark, [box(1, f, f, 100, 500) for f in range(3)]) == [(0, "rejected", "persistence"), (1, "accepted", None), (2, "accepted", None)]


def test_jump_and_speed_are_told_apart(spark):
    jump = [box(1, f, f, 100, 500) for f in range(3)] + [box(1, 3, 3, 600, 500)]
    assert stable(spark, jump)[-1] == (3, "rejected", "jump")
    speed = [box(1, f, f, 100, 500) for f in range(3)] + [box(1, 3, 3, 300, 500)]
    assert stable(spark, speed)[-1] == (3, "rejected", "speed")


def test_smoothing_and_rounding(spark):
    rows = [box(1, 0, 0, 100, 500), box(1, 1, 1, 100, 500), box(1, 2, 2, 110, 500)]
    last = tracking.stabilize_ball(table(spark, rows)).where("frame = 2").first()
    assert last["ball"]["x"] == 103.5


def test_reset_after_a_long_gap(spark):
    rows = [box(1, f, f, 100, 500) for f in range(3)] + [box(1, f, f, 900, 500) for f in (30, 31)]
    got = dict((f, (s, r)) for f, s, r in stable(spark, rows))
    assert got[30] == ("rejected", "persistence") and got[31] == ("accepted", None) and got[10] == ("lost", None) and len(got) == 32


@pytest.mark.parametrize("how", [{"max_gap": 15, "window": 3}, {"max_gap": 3, "window": 3}])
def test_sessions_change_nothing(spark, how):
    rng = random.Random(5)
    rows, frame = [], 0
    for i in range(400):
        frame += rng.choice([1, 1, 1, 2, 3, 4, 5, 18])
        rows.append(box(1, frame, i, 100 + rng.choice([0, 5, 90, 300]), 500))
    cfg = Stabilizer(**how)
    split = tracking.stabilize_rows(table(spark, rows), cfg).select("frame", "status", "x").orderBy("frame").collect()
    import pandas as pd

    pdf = pd.DataFrame([(r[0], r[1], r[2], (r[3] + r[5]) / 2, (r[4] + r[6]) / 2, r[3], r[4], r[5], r[6], r[7]) for r in rows], columns=["match_id", "frame", "det_id", "x", "y", "x1", "y1", "x2", "y2", "confidence"])
    whole = tracking._stabilize(pdf, cfg, 30.0)
    assert [(r["frame"], r["status"]) for r in split] == list(zip(whole["frame"], whole["status"], strict=True))


def test_assignment_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, m = rng.integers(1, 6, 2).tolist()
        cost = rng.random((n, m))
        pairs = tracking.assign(cost)
        assert len(pairs) == min(n, m) == len({r for r, _ in pairs}) == len({c for _, c in pairs})
        small, wide = (cost, range(m)) if n <= m else (cost.T, range(n))
        best = min(sum(small[i, c] for i, c in enumerate(p)) for p in itertools.permutations(wide, min(n, m)))
        assert sum(cost[r, c] for r, c in pairs) == pytest.approx(best)


def test_bytetrack_follows_one_ball_and_scores_it(spark):
    rows = [box(1, f, f, 100 + 2 * f, 500, 0.8) for f in range(10)]
    got = tracking.bytetrack(table(spark, rows)).orderBy("frame").collect()
    assert {r["track_id"] for r in got} == {1} and len(got) == 10
    assert got[0]["score"] == pytest.approx(0.7 * 0.8 + 0.3 * 0.2) and got[9]["score"] == pytest.approx(0.7 * 0.8 + 0.3)


def test_low_confidence_keeps_a_track_but_starts_none(spark):
    rows = [box(1, 0, 0, 100, 500, 0.8), box(1, 1, 1, 100, 500, 0.15), box(1, 1, 2, 900, 500, 0.15)]
    got = tracking.bytetrack(table(spark, rows)).collect()
    assert {(r["frame"], r["track_id"]) for r in got} == {(0, 1), (1, 1)}


def test_bytetrack_ids_stay_unique_over_sessions(spark):
    rows = [box(1, f, f, 100, 500) for f in (0, 1, 100, 101)] + [box(2, 0, 1, 5, 500)]
    got = {(r["match_id"], r["frame"]): r["track_id"] for r in tracking.bytetrack(table(spark, rows), ByteTrack(buffer=4)).collect()}
    assert got[(1, 1)] == 1 and got[(1, 100)] == 2 == got[(1, 101)] and got[(2, 0)] == 1


def candidate(frame, track, x, y, score):
    return (1, frame, track, [x - 5.0, y - 5.0, x + 5.0, y + 5.0], score)


def test_ball_selection_prefers_near_and_locks_out_far(spark):
    rows = [candidate(0, 1, 100.0, 100.0, 0.9), candidate(1, 1, 110.0, 100.0, 0.5), candidate(1, 2, 290.0, 100.0, 0.7), candidate(50, 3, 900.0, 100.0, 0.9)]
    df = spark.createDataFrame(rows, "match_id bigint, frame bigint, track_id bigint, bbox array<double>, score double")
    assert [(r["frame"], r["track_id"]) for r in tracking.select_ball(df).orderBy("frame").collect()] == [(0, 1), (1, 1)]
    assert tracking.select_ball(df, BallSelection(expiry=20)).count() == 3


def test_camera_waits_drifts_and_stays_within_limits(spark):
    rows = [(1, f, 50.0 if f < 60 else None, -10.0 if f < 60 else None) for f in range(400)]
    got = camera.camera_path(spark.createDataFrame(rows, "match_id bigint, frame bigint, yaw double, pitch double")).orderBy("frame").collect()
    assert got[59]["yaw"] == pytest.approx(50, abs=1) and abs(got[399]["yaw"]) < 10 and got[399]["fov"] == 100
    assert max(abs(a["yaw"] - b["yaw"]) for a, b in itertools.pairwise(got)) <= 4 + 1e-9


def test_camera_without_ball_looks_at_the_center(spark):
    rows = [(1, f, None, None) for f in range(3)]
    got = camera.camera_path(spark.createDataFrame(rows, "match_id bigint, frame bigint, yaw double, pitch double"), Camera()).collect()
    assert {(r["yaw"], r["pitch"]) for r in got} == {(0.0, -5.0)}


def test_unwrap_is_continuous(spark):
    rows = [(1, f, ((f * 50 + 180) % 360) - 180.0) for f in range(20)]
    got = camera.unwrap_yaw(spark.createDataFrame(rows, "match_id bigint, frame bigint, yaw double")).orderBy("frame").collect()
    assert [r["unwrapped"] for r in got] == pytest.approx([50.0 * f for f in range(20)])


def test_matches_together_equal_each_alone(spark):
    rows = [box(m, f, f, 100 + 37 * ((f * m) % 5), 500) for m in (1, 2) for f in range(40) if f % (6 + m)]
    both = tracking.stabilize_ball(table(spark, rows)).select("match_id", "frame", "status")
    alone = [tracking.stabilize_ball(table(spark, [r for r in rows if r[0] == m])).select("match_id", "frame", "status") for m in (1, 2)]
    assert sorted(both.collect()) == sorted(alone[0].union(alone[1]).collect())


def test_legacy_tracks_are_dense(spark):
    rows = [box(1, f, f, 20 + 9 * f, 80, 0.15 if f == 15 else 0.85) for f in range(30) if f != 10]
    got = tracking.legacy_tracks(table(spark, rows)).orderBy("frame").collect()
    assert len(got) == 30 and got[10]["ball"] is None and got[9]["ball"] is not None


def test_empty(spark):
    none = table(spark, [])
    assert tracking.stabilize_ball(none).count() == 0 and tracking.bytetrack(none).count() == 0 and tracking.legacy_tracks(none).count() == 0
    assert camera.camera_path(none.select("match_id", "frame", F.lit(None).cast("double").alias("yaw"), F.lit(None).cast("double").alias("pitch"))).count() == 0
