from __future__ import annotations

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.config import Detection, FieldOfInterest
from touchline.functions import geometry as g
from touchline.operators import detections as d

SCHEMA = "match_id bigint, frame bigint, det_id bigint, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int"


def box(match, frame, det, x, y, conf=0.8, half=5.0, cls=32):
    return (match, frame, det, x - half, y - half, x + half, y + half, conf, cls)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(("a", "closed", "half_open"), [(0, 0, 0), (180, 180, -180), (-180, 180, -180), (190, -170, -170), (-190, 170, 170), (540, 180, -180)])
def test_wraps(spark, a, closed, half_open):
    row = spark.range(1).select(g.wrap_deg(float(a)).alias("c"), g.wrap_deg_half_open(float(a)).alias("h")).first()
    assert (row["c"], row["h"]) == (closed, half_open)


def test_angle_diff_takes_the_short_way(spark):
    row = spark.range(1).select(g.angle_diff(-170.0, 170.0).alias("a"), g.angle_diff(170.0, -170.0).alias("b")).first()
    assert (row["a"], row["b"]) == (20.0, -20.0)


def test_vertical_fov_of_wide_picture(spark):
    assert 58 < spark.range(1).select(g.vertical_fov(90.0, 1920, 1080).alias("v")).first()["v"] < 60


def test_box_measurement_round_trip(spark):
    m = g.with_box_measurement(table(spark, [box(1, 0, 1, 100, 50)]))
    back = m.select(*(c.alias(k) for k, c in zip(("a", "b", "c", "d"), g.box_from_measurement(F.col("m_cx"), F.col("m_cy"), F.col("m_area"), F.col("m_aspect")), strict=True))).first()
    assert back == pytest.approx((95, 45, 105, 55), abs=1e-3)


def test_y_band_includes_both_ends(spark):
    rows = [box(1, i, i, 100, y) for i, y in enumerate((191.9, 192.0, 500.0, 940.8, 941.0))]
    assert [r["frame"] for r in d.y_band_filter(table(spark, rows)).orderBy("frame").collect()] == [1, 2, 3]


def test_best_per_frame_takes_the_first_of_equals_in_any_order(spark):
    rows = [box(1, 0, 2, 10, 10, 0.5), box(1, 0, 1, 20, 20, 0.5), box(1, 0, 3, 30, 30, 0.4), box(2, 0, 9, 10, 10, 0.1)]
    for order in (rows, rows[::-1]):
        assert {(r["match_id"], r["det_id"]) for r in d.best_per_frame(table(spark, order)).collect()} == {(1, 1), (2, 9)}


def test_gate_limits_a_frame(spark):
    rows = [box(1, 0, i, 10, 10, 0.3 + i / 100) for i in range(30)] + [box(1, 0, 99, 1, 1, 0.9, cls=0), box(1, 0, 98, 1, 1, 0.2)]
    kept = {r["det_id"] for r in d.detection_gate(table(spark, rows), Detection(max_per_frame=5)).collect()}
    assert kept == {25, 26, 27, 28, 29}


def test_auto_center_follows_each_match_and_falls_back(spark):
    rows = [box(1, i, i, 960 + 480 + i % 3, 480) for i in range(50)] + [box(2, i, i, 5 if i % 2 else 1915, 480) for i in range(50)] + [box(3, 0, 1, 10, 10, 0.1)]
    got = {r["match_id"]: r for r in d.foi_auto_center(table(spark, rows)).collect()}
    assert got[1]["center"] == pytest.approx(90, abs=1)
    assert abs(got[2]["center"]) == pytest.approx(180, abs=2)  # around the seam
    assert got[3]["fallback"] and got[3]["center"] == 0


def test_foi_keeps_its_edges(spark):
    rows = [box(1, i, i, x, 480) for i, x in enumerate((426.0, 426.6666666666667, 960.0, 1493.0, 1494.0))]
    assert [r["frame"] for r in d.foi_filter(table(spark, rows), None, foi=FieldOfInterest()).orderBy("frame").collect()] == [1, 2, 3]


def test_interpolation_bridges_short_gaps_only(spark):
    rows = [box(1, 0, 1, 100, 100, 0.8), box(1, 3, 2, 130, 100, 0.6), box(1, 20, 3, 500, 100)]
    made = d.interpolate_skipped(table(spark, rows), 3).where("interpolated").orderBy("frame").collect()
    assert [(r["frame"], r["x1"], r["class_id"]) for r in made] == [(1, 105.0, 0), (2, 115.0, 0)]
    assert made[0]["confidence"] == pytest.approx(0.48)


def test_iou_and_nms(spark):
    rows = [box(1, 0, 1, 100, 100, 0.9), box(1, 0, 2, 101, 100, 0.8), box(1, 0, 3, 300, 100, 0.1), box(1, 1, 4, 100, 100, 0.5)]
    pairs = {(r["a"], r["b"]): r["iou"] for r in d.pairwise_iou(table(spark, rows)).collect()}
    assert pairs[(1, 2)] == pytest.approx(90 / 110, abs=1e-6) and pairs[(1, 3)] == 0
    assert {r["det_id"] for r in d.nms(table(spark, rows)).collect()} == {1, 3, 4}


def test_untile_places_tiles(spark):
    rows = table(spark, [box(1, 0, i, 10, 10) for i in range(4)]).withColumns({"tile_r": F.floor(F.col("det_id") / 2), "tile_c": F.pmod("det_id", F.lit(2))})
    got = [(r["x1"], r["y1"]) for r in d.untile_detections(rows).orderBy("det_id").collect()]
    assert got == [(5, 5), (869, 5), (5, 437), (869, 437)]


def test_empty_tables(spark):
    none = table(spark, [])
    for out in (d.best_per_frame(none), d.foi_auto_center(none), d.interpolate_skipped(none, 5), d.pairwise_iou(none), d.nms(none), d.group_by_frame(none)):
        assert out.count() == 0


def test_yaw_pitch(spark):
    row = g.with_yaw_pitch(g.with_bbox_geometry(table(spark, [box(1, 0, 1, 960, 480)])), 1920, 960).first()
    assert (row["yaw"], row["pitch"]) == (0, 0) and math.isclose(row["area"], 100)


def test_kept_boxes_of_many_frames_at_once():
    """200,000 boxes of 50,000 frames, as one frame after another gives them, without a step in Python by frame."""
    rng = np.random.default_rng(4)
    n = 200_000
    x, y = rng.integers(0, 40, n).astype(float), rng.integers(0, 40, n).astype(float)
    rows = pd.DataFrame({"frame": rng.integers(0, 50_000, n), "det_id": rng.permutation(n), "x1": x, "y1": y, "x2": x + 30, "y2": y + 30, "confidence": rng.integers(0, 5, n) / 5})
    started = time.process_time()
    kept = d.kept_boxes(rows, 0.25)
    assert time.process_time() - started < 10  # frame by frame: more than a minute
    for frame in range(0, 50_000, 997):
        stay: list = []
        for b in rows[rows["frame"] == frame].sort_values(["confidence", "det_id"], ascending=[False, True]).itertuples():
            over = lambda k: max(0, min(k.x2, b.x2) - max(k.x1, b.x1)) * max(0, min(k.y2, b.y2) - max(k.y1, b.y1))  # noqa: B023, E731
            if not any(over(k) / (1800 - over(k) + 1e-6) > 0.25 for k in stay):
                stay.append(b)
        assert kept[kept["frame"] == frame]["det_id"].tolist() == [b.det_id for b in stay]
