"""Registered queries of the match-tracking operators, over detections derived from the driver's tables, and their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.config import BallSelection, Detection, HardFrames, Ingest, Labeling, Render
from touchline.functions import geometry as g
from touchline.functions import naming
from touchline.operators import camera, hardframes, highlights, ingest, render, selection, tracking
from touchline.operators import detections as d
from touchline.plans import inputs
from touchline.plans.matches import overview, run_matches, save_tables
from touchline.sources import readers, writers
from touchline.streaming import ingest as ingest_streams
from touchline.streaming.live import live_clips, live_stabilizer

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# ---- shared parts of the SQL

_DET = f"det AS ({inputs.DETECTIONS_SQL.format(events='events')})"
_BAND = "band AS (SELECT * FROM det WHERE (y1 + y2) / 2 / 960.0e0 BETWEEN 0.20e0 AND 0.98e0)"
_BEST = """best AS (SELECT match_id, frame, det_id, x1, y1, x2, y2, confidence, class_id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM
  (SELECT *, row_number() OVER (PARTITION BY match_id, frame ORDER BY confidence DESC, det_id) AS r FROM band) WHERE r = 1)"""
_MAT = "mat AS (SELECT match_id, 30.0e0 AS fps, max(frame) + 11 AS total_frames FROM det GROUP BY match_id)"
_SPINE = "spine AS (SELECT match_id, CAST(unnest(generate_series(0, last)) AS BIGINT) AS frame FROM (SELECT match_id, max(frame) AS last FROM best GROUP BY match_id))"
_DENSE = "fr AS (SELECT s.match_id, s.frame, b.x, b.y, b.confidence FROM spine s LEFT JOIN best b USING (match_id, frame))"
_VEL = """vel AS (SELECT match_id, frame, x, y, vx, vy, sqrt(vx * vx + vy * vy) AS speed FROM (SELECT match_id, frame, x, y,
  CASE WHEN px IS NOT NULL THEN (x - px) / ((frame - pf) / 30.0e0) ELSE 0.0e0 END AS vx, CASE WHEN px IS NOT NULL THEN (y - py) / ((frame - pf) / 30.0e0) ELSE 0.0e0 END AS vy
  FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(frame) OVER w AS pf FROM best WINDOW w AS (PARTITION BY match_id ORDER BY frame))))"""
_EV = """ev AS (
  SELECT v.match_id, frame, 'speed' AS type, speed AS value FROM vel v JOIN (SELECT match_id, quantile_cont(speed, 0.95) AS t FROM vel WHERE speed > 0 GROUP BY match_id) q ON q.match_id = v.match_id WHERE speed > 0 AND speed >= t
  UNION ALL SELECT match_id, frame, 'goal_box', 1.0e0 FROM best WHERE (x / 1920.0e0 BETWEEN 0.0e0 AND 0.08e0 OR x / 1920.0e0 BETWEEN 0.92e0 AND 1.0e0) AND y / 960.0e0 BETWEEN 0.3e0 AND 0.7e0
  UNION ALL SELECT match_id, frame, 'direction', angle FROM (SELECT match_id, frame, degrees(acos(greatest(-1.0e0, least(1.0e0, (vx * pvx + vy * pvy) / (speed * ps))))) AS angle
    FROM (SELECT *, lag(vx) OVER w AS pvx, lag(vy) OVER w AS pvy, lag(speed) OVER w AS ps FROM vel WINDOW w AS (PARTITION BY match_id ORDER BY frame)) WHERE speed >= 10 AND ps >= 10) WHERE angle >= 90)"""
_CLU = """clu AS (SELECT *, sum(n) OVER (PARTITION BY match_id ORDER BY frame, type ROWS UNBOUNDED PRECEDING) AS cluster FROM
  (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY match_id ORDER BY frame, type) > 150 THEN 1 ELSE 0 END AS n FROM ev))"""
_STAB = """st AS (
 SELECT match_id, CAST(-1 AS BIGINT) AS frame, CAST(NULL AS BIGINT) AS pf, CAST(NULL AS DOUBLE) AS ex, CAST(NULL AS DOUBLE) AS ey, CAST(0 AS BIGINT) AS b1, CAST(0 AS BIGINT) AS b2, 'init' AS status, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS DOUBLE) AS d, CAST(NULL AS DOUBLE) AS sp FROM (SELECT DISTINCT match_id FROM fr)
 UNION ALL
 SELECT match_id, frame, CASE WHEN acc THEN frame ELSE pf0 END, CASE WHEN acc THEN CASE WHEN ex0 IS NULL THEN x ELSE 0.35e0 * x + (1 - 0.35e0) * ex0 END ELSE ex0 END,
   CASE WHEN acc THEN CASE WHEN ey0 IS NULL THEN y ELSE 0.35e0 * y + (1 - 0.35e0) * ey0 END ELSE ey0 END, h, b1, CASE WHEN acc THEN 'accepted' WHEN h = 1 THEN 'rejected' ELSE 'lost' END,
   CASE WHEN h = 0 OR acc THEN NULL WHEN NOT pers THEN 'persistence' WHEN d0 > 250 THEN 'jump' ELSE 'speed' END, d0, d0 / ((frame - pf0) / 30.0e0)
 FROM (SELECT *, (h = 1 AND pers AND (ex0 IS NULL OR (d0 <= 250 AND d0 / ((frame - pf0) / 30.0e0) <= 2500))) AS acc FROM (
   SELECT *, h + b1 + b2 >= 2 AS pers, sqrt((x - ex0) * (x - ex0) + (y - ey0) * (y - ey0)) AS d0 FROM (
    SELECT f.match_id, f.frame, f.x, f.y, CASE WHEN f.x IS NULL THEN 0 ELSE 1 END AS h, CASE WHEN rs THEN NULL ELSE s.pf END AS pf0, CASE WHEN rs THEN NULL ELSE s.ex END AS ex0, CASE WHEN rs THEN NULL ELSE s.ey END AS ey0,
     CASE WHEN rs THEN 0 ELSE s.b1 END AS b1, CASE WHEN rs THEN 0 ELSE s.b2 END AS b2
    FROM (SELECT *, coalesce(frame + 1 - pf > 15, false) AS rs FROM st) s JOIN fr f ON f.match_id = s.match_id AND f.frame = s.frame + 1))))"""


def _sql(body: str, *parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join((_DET, *parts)) + "\n" + body


_TO_BEST = (_BAND, _BEST)
_TO_DENSE = (_BAND, _BEST, _SPINE, _DENSE)
_TO_STAB = (*_TO_DENSE, _STAB)
_TO_EV = (_BAND, _BEST, _VEL, _EV)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _best(spark: SparkSession, sf: str) -> DataFrame:
    return d.best_per_frame(d.y_band_filter(inputs.detections(spark, sf)))


def _ball(spark: SparkSession, sf: str) -> DataFrame:
    return d.centers_of(_best(spark, sf))


def _plain_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks whose ball is the best detection of the frame."""
    rows = tracking.dense(_ball(spark, sf))
    return rows.select("match_id", "frame", F.when(F.col("x").isNotNull(), F.struct("x", "y")).alias("ball"))


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


# ---- detections


@query(_sql("SELECT match_id, frame, det_id, confidence FROM band", _BAND))
def y_band_filter(spark, sf):
    return d.y_band_filter(inputs.detections(spark, sf)).select("match_id", "frame", "det_id", "confidence")


@query(_sql("SELECT match_id, frame, det_id, x1, y1, x2, y2, confidence FROM best", *_TO_BEST))
def best_per_frame(spark, sf):
    return _best(spark, sf).select("match_id", "frame", "det_id", "x1", "y1", "x2", "y2", "confidence")


@query(_sql("SELECT match_id, frame, det_id FROM (SELECT *, row_number() OVER (PARTITION BY match_id, frame ORDER BY confidence DESC, det_id) AS r FROM det WHERE class_id = 32 AND confidence >= 0.25e0) WHERE r <= 20"))
def detection_gate(spark, sf):
    return d.detection_gate(inputs.detections(spark, sf)).select("match_id", "frame", "det_id")


@query(_sql("SELECT match_id, frame, det_id FROM (SELECT *, row_number() OVER (PARTITION BY match_id, frame ORDER BY confidence DESC, det_id) AS r FROM det WHERE class_id = 32 AND confidence >= 0.25e0) WHERE r <= 2"))
def detection_gate_of_few(spark, sf):
    """Frames hold more boxes than the gate lets through."""
    return d.detection_gate(inputs.detections(spark, sf), Detection(max_per_frame=2)).select("match_id", "frame", "det_id")


@query(_sql("SELECT match_id, frame, det_id FROM det WHERE frame % 3 = 0"))
def sample_frames(spark, sf):
    return d.sample_frames(inputs.detections(spark, sf), 3).select("match_id", "frame", "det_id")


@query(_sql("SELECT match_id, frame, count(*) AS n, string_agg(CAST(det_id AS VARCHAR), ',' ORDER BY det_id) AS det_ids FROM det GROUP BY match_id, frame"))
def group_by_frame(spark, sf):
    rows = d.group_by_frame(inputs.detections(spark, sf))
    return rows.select("match_id", "frame", F.size("detections").cast("long").alias("n"), F.array_join(F.transform("detections", lambda x: x["det_id"].cast("string")), ",").alias("det_ids"))


@query(_sql("""SELECT match_id, frame, det_id, cx, cy, area, round(yaw, 6) AS yaw, round(pitch, 6) AS pitch, round(CASE WHEN w > 180 THEN w - 360 ELSE w END, 6) AS wrapped, round(((yaw * 3 + 180) % 360 + 360) % 360 - 180, 6) AS wrapped_half, round((x2 - x1) / (y2 - y1 + 1e-6), 6) AS aspect,
  round(CASE WHEN df > 180 THEN df - 360 ELSE df END, 6) AS turn FROM (SELECT *, ((yaw * 3) % 360 + 360) % 360 AS w, ((yaw - 170.0e0) % 360 + 360) % 360 AS df FROM (
  SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, (x2 - x1) * (y2 - y1) AS area, (x1 + x2) / 2 / 1920.0e0 * 360.0e0 - 180.0e0 AS yaw, 90.0e0 - (y1 + y2) / 2 / 960.0e0 * 180.0e0 AS pitch FROM det))"""))
def scalar_geometry(spark, sf):
    rows = g.with_box_measurement(g.with_yaw_pitch(g.with_bbox_geometry(inputs.detections(spark, sf)), 1920.0, 960.0))
    yaw = F.col("yaw")
    return rows.select("match_id", "frame", "det_id", "cx", "cy", "area", _r("yaw"), _r("pitch"), F.round(g.wrap_deg(yaw * 3), 6).alias("wrapped"), F.round(g.wrap_deg_half_open(yaw * 3), 6).alias("wrapped_half"), F.round("m_aspect", 6).alias("aspect"), F.round(g.angle_diff(yaw, 170.0), 6).alias("turn"))


@query(_sql("""SELECT match_id, frame, det_id, x1 + CASE WHEN det_id % 2 = 1 THEN 864.0e0 ELSE 0.0e0 END AS x1, y1 + CASE WHEN det_id % 4 >= 2 THEN 432.0e0 ELSE 0.0e0 END AS y1,
  x2 + CASE WHEN det_id % 2 = 1 THEN 864.0e0 ELSE 0.0e0 END AS x2, y2 + CASE WHEN det_id % 4 >= 2 THEN 432.0e0 ELSE 0.0e0 END AS y2 FROM det"""))
def untile_detections(spark, sf):
    tiles = inputs.detections(spark, sf).withColumns({"tile_c": F.pmod("det_id", F.lit(2)), "tile_r": F.floor(F.pmod("det_id", F.lit(4)) / 2)})
    return d.untile_detections(tiles).select("match_id", "frame", "det_id", "x1", "y1", "x2", "y2")


_FOI = """ang AS (SELECT *, (x1 + x2) / 2 / 1920.0e0 * 360.0e0 - 180.0e0 AS yaw, 90.0e0 - (y1 + y2) / 2 / 960.0e0 * 180.0e0 AS pitch FROM det),
smp AS (SELECT match_id, yaw, least(CAST(floor((yaw + 180.0e0) / 5.0e0) AS BIGINT), 71) AS bin FROM ang WHERE frame < 900 AND confidence >= 0.25e0 AND pitch BETWEEN -45 AND 20),
bin AS (SELECT match_id, bin, count(*) AS n, sum(sin(radians(yaw))) AS s, sum(cos(radians(yaw))) AS c FROM smp GROUP BY match_id, bin),
pk AS (SELECT match_id, bin AS peak FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY n DESC, bin) AS r FROM bin) WHERE r = 1),
cen AS (SELECT m.match_id, coalesce(center, 0.0e0) AS center, coalesce(sample_count, 0) AS sample_count, center IS NULL AS fallback FROM (SELECT DISTINCT match_id FROM det) m
  LEFT JOIN (SELECT b.match_id, degrees(atan2(sum(s), sum(c))) AS center FROM bin b JOIN pk USING (match_id) WHERE ((bin - peak + 1) % 72 + 72) % 72 <= 2 GROUP BY b.match_id) USING (match_id)
  LEFT JOIN (SELECT match_id, count(*) AS sample_count FROM smp GROUP BY match_id) USING (match_id)),
foi AS (SELECT * FROM (SELECT a.*, abs(CASE WHEN w > 180 THEN w - 360 ELSE w END) AS off FROM (SELECT a.*, ((yaw - center) % 360 + 360) % 360 AS w FROM ang a JOIN cen USING (match_id)) a) WHERE off <= 100 AND pitch BETWEEN -45 AND 20)"""


@query(_sql("SELECT match_id, round(center, 6) AS center, sample_count, fallback FROM cen", _FOI))
def foi_auto_center(spark, sf):
    return d.foi_auto_center(inputs.detections(spark, sf)).withColumn("center", F.round("center", 6))


@query(_sql("SELECT match_id, frame, det_id FROM foi", _FOI))
def foi_filter(spark, sf):
    rows = inputs.detections(spark, sf)
    return d.foi_filter(rows, d.foi_auto_center(rows)).select("match_id", "frame", "det_id")


@query(_sql("SELECT match_id, round(center, 6) AS center, sample_count, fallback, total, coalesce(kept, 0) AS kept, round(100.0e0 * (total - coalesce(kept, 0)) / total, 6) AS filtered_pct FROM cen JOIN (SELECT match_id, count(*) AS total FROM det GROUP BY 1) USING (match_id) LEFT JOIN (SELECT match_id, count(*) AS kept FROM foi GROUP BY 1) USING (match_id)", _FOI))
def foi_meta(spark, sf):
    rows = inputs.detections(spark, sf)
    return d.foi_meta(rows, d.foi_auto_center(rows)).select("match_id", _r("center"), "sample_count", "fallback", "total", "kept", _r("filtered_pct"))


@query(_sql("""SELECT match_id, frame, det_id, x1, x2, confidence, class_id, false AS interpolated FROM det UNION ALL
  SELECT match_id, pos, NULL, round(x1 + (nx1 - x1) * t, 6), round(x2 + (nx2 - x2) * t, 6), round(0.8e0 * least(confidence, nc), 6), 0, true FROM (SELECT *, (pos - frame) / CAST(nf - frame AS DOUBLE) AS t FROM (
  SELECT *, unnest(generate_series(frame + 1, nf - 1)) AS pos FROM (SELECT *, lead(frame) OVER w AS nf, lead(x1) OVER w AS nx1, lead(x2) OVER w AS nx2, lead(confidence) OVER w AS nc
    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id, frame ORDER BY confidence DESC, det_id) AS r FROM det) WHERE r = 1) WINDOW w AS (PARTITION BY match_id ORDER BY frame)) WHERE nf - frame > 1 AND nf - frame <= 25))"""))
def interpolate_skipped(spark, sf):
    return d.interpolate_skipped(inputs.detections(spark, sf), 25).select("match_id", "frame", "det_id", _r("x1"), _r("x2"), _r("confidence"), "class_id", "interpolated")


_IOU = """iou AS (SELECT match_id, frame, a, b, ca, cb, w * h / (sa + sb - w * h + 1e-6) AS iou FROM (SELECT p.match_id, p.frame, p.det_id AS a, q.det_id AS b, p.confidence AS ca, q.confidence AS cb, (p.x2 - p.x1) * (p.y2 - p.y1) AS sa, (q.x2 - q.x1) * (q.y2 - q.y1) AS sb,
  greatest(least(p.x2, q.x2) - greatest(p.x1, q.x1), 0.0e0) AS w, greatest(least(p.y2, q.y2) - greatest(p.y1, q.y1), 0.0e0) AS h FROM det p JOIN det q ON p.match_id = q.match_id AND p.frame = q.frame AND p.det_id < q.det_id))"""


@query(_sql("SELECT match_id, frame, a, b, round(iou, 6) AS iou FROM iou", _IOU))
def pairwise_iou(spark, sf):
    return d.pairwise_iou(inputs.detections(spark, sf)).withColumn("iou", F.round("iou", 6))


_NMS = """rk AS (SELECT *, row_number() OVER (PARTITION BY match_id, frame ORDER BY confidence DESC, det_id) AS r FROM det),
nm AS (SELECT match_id, frame, r, det_id, true AS stays, [{'a': x1, 'b': y1, 'c': x2, 'd': y2}] AS held FROM rk WHERE r = 1
 UNION ALL SELECT match_id, frame, r, det_id, stays, CASE WHEN stays THEN list_append(held, {'a': x1, 'b': y1, 'c': x2, 'd': y2}) ELSE held END FROM (SELECT rk.*, nm.held, len(list_filter(nm.held, lambda k:
   greatest(least(k.c, x2) - greatest(k.a, x1), 0.0e0) * greatest(least(k.d, y2) - greatest(k.b, y1), 0.0e0) / ((k.c - k.a) * (k.d - k.b) + (x2 - x1) * (y2 - y1)
     - greatest(least(k.c, x2) - greatest(k.a, x1), 0.0e0) * greatest(least(k.d, y2) - greatest(k.b, y1), 0.0e0) + 1e-6) > 0.25e0)) = 0 AS stays
   FROM nm JOIN rk ON rk.match_id = nm.match_id AND rk.frame = nm.frame AND rk.r = nm.r + 1))"""


@query(_sql("SELECT match_id, frame, det_id FROM nm WHERE stays", _NMS, recursive=True))
def nms(spark, sf):
    """Frames of many boxes have chains: a box that is suppressed suppresses none."""
    return d.nms(inputs.detections(spark, sf), 0.25).select("match_id", "frame", "det_id")


# ---- tracks


@query(_sql("SELECT match_id, frame FROM spine", *_TO_BEST, _SPINE))
def frame_spine(spark, sf):
    return tracking.frame_spine(_best(spark, sf))


@query(_sql("SELECT match_id, CAST(unnest(generate_series(0, last)) AS BIGINT) AS frame FROM (SELECT match_id, max(frame) AS last FROM det GROUP BY 1) EXCEPT SELECT match_id, frame FROM det"))
def frames_without(spark, sf):
    return hardframes.frames_without(inputs.detections(spark, sf))


@query(_sql("SELECT match_id, frame, status, reason, round(CASE WHEN status = 'accepted' THEN ex END, 6) AS x, round(CASE WHEN status = 'accepted' THEN ey END, 6) AS y FROM st WHERE frame >= 0", *_TO_STAB, recursive=True))
def stabilize_ball(spark, sf):
    rows = tracking.dense(tracking.stabilize_rows(_best(spark, sf)))
    return rows.select("match_id", "frame", F.coalesce("status", F.lit("lost")).alias("status"), "reason", _r("x"), _r("y"))


@query(_sql("SELECT match_id, frame, reason AS trigger, round(round_even(d, 1), 6) AS distance_px, round(CASE WHEN reason = 'speed' THEN round_even(sp, 1) END, 6) AS speed_px_s FROM st WHERE reason IN ('jump', 'speed')", *_TO_STAB, recursive=True))
def stabilizer_events(spark, sf):
    return tracking.stabilizer_events(tracking.stabilize_rows(_best(spark, sf))).select("match_id", "frame", "trigger", _r("distance_px"), _r("speed_px_s"))


@query(_sql("SELECT match_id, count(*) AS frames, count(*) FILTER (WHERE status = 'accepted') AS accepted, count(*) FILTER (WHERE status = 'rejected') AS rejected, count(*) FILTER (WHERE status = 'lost') AS lost FROM st WHERE frame >= 0 GROUP BY match_id", *_TO_STAB, recursive=True))
def track_summary(spark, sf):
    return tracking.track_summary(tracking.stabilize_ball(_best(spark, sf)))


@query(_sql("SELECT match_id, frame, hits, hits >= 2 AS persistent FROM (SELECT match_id, frame, count(*) OVER (PARTITION BY match_id ORDER BY frame RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS hits FROM best)", *_TO_BEST))
def persistence_gate(spark, sf):
    return tracking.persistence_gate(_best(spark, sf)).select("match_id", "frame", "hits", "persistent")


@query()
def bytetrack(spark, sf):
    return tracking.bytetrack(inputs.detections(spark, sf)).select("match_id", "frame", "track_id", _r("score"))


@query(_sql("""SELECT match_id, frame, x, y, track_id FROM sel WHERE picked""", """cand AS (SELECT match_id, frame, det_id, confidence AS score, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, (x2 - x1) * (y2 - y1) AS area, dense_rank() OVER (PARTITION BY match_id ORDER BY frame) AS k FROM det),
sel AS (SELECT match_id, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS frame, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y, CAST(NULL AS BIGINT) AS track_id, false AS picked FROM (SELECT DISTINCT match_id FROM det)
 UNION ALL
 SELECT match_id, k, frame, CASE WHEN ok THEN cx ELSE px END, CASE WHEN ok THEN cy ELSE py END, CASE WHEN ok THEN det_id END, ok FROM (
  SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY ok DESC, total DESC, det_id) AS r FROM (
   SELECT *, area BETWEEN 10 AND 10000 AND (px IS NULL OR dist <= 300) AS ok, 0.6e0 * score + 0.4e0 * CASE WHEN px IS NULL THEN 1.0e0 ELSE greatest(0.0e0, 1.0e0 - dist / 200.0e0) END AS total FROM (
    SELECT c.match_id, c.k, c.frame, c.det_id, c.score, c.cx, c.cy, c.area, s.x AS px, s.y AS py, sqrt((c.cx - s.x) * (c.cx - s.x) + (c.cy - s.y) * (c.cy - s.y)) AS dist FROM sel s JOIN cand c ON c.match_id = s.match_id AND c.k = s.k + 1))) WHERE r = 1)""", recursive=True))
def select_ball(spark, sf):
    """Every detection as a candidate of its own."""
    rows = inputs.detections(spark, sf).select("match_id", "frame", F.col("det_id").alias("track_id"), F.array("x1", "y1", "x2", "y2").alias("bbox"), F.col("confidence").alias("score"))
    return tracking.select_ball(rows, BallSelection()).select("match_id", "frame", "x", "y", "track_id")


@query()
def legacy_tracks(spark, sf):
    return tracking.legacy_tracks(inputs.detections(spark, sf)).select("match_id", "frame", F.round("ball.x", 4).alias("x"), F.round("ball.y", 4).alias("y"), "ball.track_id")


# ---- camera


def _wd(a: str) -> str:
    return f"(CASE WHEN (({a}) % 360 + 360) % 360 > 180 THEN (({a}) % 360 + 360) % 360 - 360 ELSE (({a}) % 360 + 360) % 360 END)"


def _wh(a: str) -> str:
    return f"((((({a}) + 180) % 360) + 360) % 360 - 180)"


_ANG = "an AS (SELECT match_id, frame, x / 1920.0e0 * 360.0e0 - 180.0e0 AS yaw, 90.0e0 - y / 960.0e0 * 180.0e0 AS pitch FROM fr)"
_CAM = f"""cs AS (
 SELECT match_id, CAST(-1 AS BIGINT) AS frame, y AS ky, p AS kp, 0.0e0 AS dy, 0.0e0 AS dp, 100.0e0 AS p00, 0.0e0 AS p01, 100.0e0 AS p11, CAST(0 AS BIGINT) AS lc, false AS lost, CAST(NULL AS DOUBLE) AS ey, CAST(NULL AS DOUBLE) AS ep, CAST(NULL AS DOUBLE) AS oy, CAST(NULL AS DOUBLE) AS op
 FROM (SELECT match_id, arg_min(yaw, frame) AS y, arg_min(pitch, frame) AS p FROM an WHERE yaw IS NOT NULL GROUP BY match_id)
 UNION ALL
 SELECT match_id, frame, ky, kp, dy, dp, p00, p01, p11, lc, lost, ey, ep,
  CASE WHEN oy0 IS NULL THEN ey ELSE oy0 + greatest(-md, least(md, sl * (CASE WHEN abs({_wd('ey - oy0')}) < 0.5 THEN 0 ELSE {_wd('ey - oy0')} END))) END,
  CASE WHEN oy0 IS NULL THEN ep ELSE op0 + greatest(-md, least(md, sl * (CASE WHEN abs(ep - op0) < 0.5 THEN 0 ELSE ep - op0 END))) END
 FROM (SELECT *, CASE WHEN sqrt(dy * dy + dp * dp) > 2 * 60 / 30.0e0 THEN 120 / 30.0e0 ELSE 60 / 30.0e0 END AS md, CASE WHEN sqrt(dy * dy + dp * dp) < 2.0e0 / 30 AND NOT lost THEN 0.3e0 ELSE 1.0e0 END AS sl,
    CASE WHEN ey0 IS NULL THEN ky ELSE ey0 + 0.15e0 * {_wd('ky - ey0')} END AS ey, CASE WHEN ey0 IS NULL THEN kp ELSE ep0 + 0.15e0 * (kp - ep0) END AS ep
  FROM (SELECT match_id, frame, lc, lost, p00, p01, p11, ey0, ep0, oy0, op0, dy2 AS dy, dp2 AS dp, CASE WHEN lc > 90 THEN ky2 + {_wd('0.0e0 - ' + _wh('ky2'))} * 0.02e0 ELSE ky2 END AS ky, CASE WHEN lc > 90 THEN kp2 + (-5.0e0 - kp2) * 0.02e0 ELSE kp2 END AS kp
   FROM (SELECT match_id, frame, yaw IS NULL AS lost, CASE WHEN yaw IS NULL THEN lc0 + 1 ELSE 0 END AS lc, ey0, ep0, oy0, op0,
      CASE WHEN yaw IS NULL THEN yp ELSE yp + k0 * {_wd('yaw - ' + _wh('yp'))} END AS ky2, CASE WHEN yaw IS NULL THEN pp ELSE pp + k0 * (pitch - pp) END AS kp2,
      CASE WHEN yaw IS NULL THEN dy0 * (CASE WHEN lc0 + 1 > 30 THEN 0.95e0 ELSE 1 END) ELSE dy0 + k1 * {_wd('yaw - ' + _wh('yp'))} END AS dy2,
      CASE WHEN yaw IS NULL THEN dp0 * (CASE WHEN lc0 + 1 > 30 THEN 0.95e0 ELSE 1 END) ELSE dp0 + k1 * (pitch - pp) END AS dp2,
      CASE WHEN yaw IS NULL THEN a00 ELSE (1 - k0) * (1 - k0) * a00 + k0 * k0 END AS p00, CASE WHEN yaw IS NULL THEN a01 ELSE (1 - k0) * (a01 - k1 * a00) + k0 * k1 END AS p01, CASE WHEN yaw IS NULL THEN a11 ELSE a11 - 2 * k1 * a01 + k1 * k1 * a00 + k1 * k1 END AS p11
    FROM (SELECT *, a00 / (a00 + 1) AS k0, a01 / (a00 + 1) AS k1 FROM (
      SELECT f.match_id, f.frame, f.yaw, f.pitch, s.lc AS lc0, s.ky + s.dy / 30.0e0 AS yp, s.kp + s.dp / 30.0e0 AS pp, s.dy AS dy0, s.dp AS dp0, s.ey AS ey0, s.ep AS ep0, s.oy AS oy0, s.op AS op0,
       s.p00 + 2 * s.p01 / 30.0e0 + s.p11 / 900.0e0 + 0.1e0 / 900 AS a00, s.p01 + s.p11 / 30.0e0 + 0.1e0 / 30 AS a01, s.p11 + 0.1e0 AS a11
      FROM cs s JOIN an f ON f.match_id = s.match_id AND f.frame = s.frame + 1)))))
)"""


@query(_sql(f"SELECT match_id, frame, round({_wh('oy')}, 5) AS yaw, round(greatest(-89, least(89, op)), 5) AS pitch, round(round_even(CASE WHEN lost THEN 100.0e0 ELSE 80 + 20 * least(sqrt(dy * dy + dp * dp) / 5, 1) END, 1), 5) AS fov, lc AS lost_count FROM cs WHERE frame >= 0", *_TO_DENSE, _ANG, _CAM, recursive=True))
def camera_path(spark, sf):
    path = camera.camera_path(camera.ball_angles(_plain_tracks(spark, sf)))
    return path.select("match_id", "frame", _r("yaw", 5), _r("pitch", 5), _r("fov", 5), "lost_count")


@query(_sql("SELECT match_id, CAST(unnest(generate_series(0, total_frames - 1)) AS BIGINT) AS frame, 0.0e0 AS yaw, -5.0e0 AS pitch, 90.0e0 AS fov FROM mat", _MAT))
def static_camera_path(spark, sf):
    return camera.static_camera_path(inputs.matches(inputs.detections(spark, sf)))


@query(_sql(f"SELECT match_id, frame, round(sum(step) OVER (PARTITION BY match_id ORDER BY frame ROWS UNBOUNDED PRECEDING), 6) AS unwrapped FROM (SELECT match_id, frame, CASE WHEN p IS NULL THEN yaw ELSE {_wd('yaw - p')} END AS step FROM (SELECT *, lag(yaw) OVER (PARTITION BY match_id ORDER BY frame) AS p FROM an WHERE yaw IS NOT NULL))", *_TO_DENSE, _ANG))
def unwrap_yaw(spark, sf):
    return camera.unwrap_yaw(camera.ball_angles(_plain_tracks(spark, sf)).where("yaw IS NOT NULL")).select("match_id", "frame", _r("unwrapped"))


@query(_sql("SELECT match_id, frame, frame - coalesce(max(CASE WHEN x IS NOT NULL THEN frame END) OVER (PARTITION BY match_id ORDER BY frame ROWS UNBOUNDED PRECEDING), -1) AS lost_count FROM fr", *_TO_DENSE))
def lost_counts(spark, sf):
    rows = _plain_tracks(spark, sf).select("match_id", "frame", F.col("ball").isNotNull().alias("seen"))
    return camera.lost_counts(rows).select("match_id", "frame", "lost_count")


# ---- highlights


@query(_sql("SELECT match_id, frame, round(vx, 6) AS vx, round(vy, 6) AS vy, round(speed, 6) AS speed FROM vel", *_TO_BEST, _VEL))
def ball_velocity(spark, sf):
    return highlights.ball_velocity(_ball(spark, sf), adjacent=False).select("match_id", "frame", _r("vx"), _r("vy"), _r("speed"))


@query(_sql("SELECT match_id, frame, round(value, 6) AS value FROM ev WHERE type = 'speed'", *_TO_EV))
def speed_events(spark, sf):
    return highlights.speed_events(highlights.ball_velocity(_ball(spark, sf), adjacent=False)).select("match_id", "frame", _r("value"))


@query(_sql("SELECT match_id, frame FROM ev WHERE type = 'goal_box'", *_TO_EV))
def goal_box_events(spark, sf):
    return highlights.goal_box_events(_ball(spark, sf)).select("match_id", "frame")


@query(_sql("SELECT match_id, round(quantile_cont(speed, 0.95), 6) AS threshold FROM vel WHERE speed > 0 GROUP BY match_id", *_TO_EV))
def speed_thresholds_by_bins(spark, sf):
    velocity = _written(highlights.ball_velocity(_ball(spark, sf), adjacent=False).select("match_id", "speed"))
    return highlights.speed_thresholds(velocity, bins=256).withColumn("threshold", F.round("threshold", 6))


@query(_sql("SELECT match_id, frame FROM ev WHERE type = 'goal_box'", *_TO_EV))
def region_events(spark, sf):
    """The same rectangles as a table."""
    regions = spark.createDataFrame([(0.0, 0.3, 0.08, 0.7), (0.92, 0.3, 1.0, 0.7)], "x1 double, y1 double, x2 double, y2 double")
    return highlights.region_events(_ball(spark, sf), regions).select("match_id", "frame")


@query(_sql("SELECT match_id, frame, round(value, 6) AS value FROM ev WHERE type = 'direction'", *_TO_EV))
def direction_events(spark, sf):
    return highlights.direction_events(highlights.ball_velocity(_ball(spark, sf), adjacent=False)).select("match_id", "frame", _r("value"))


@query(_sql("SELECT match_id, frame, type, round(value, 6) AS value FROM ev", *_TO_EV))
def highlight_events(spark, sf):
    return highlights.highlight_events(_ball(spark, sf), adjacent=False).select("match_id", "frame", "type", _r("value"))


@query(_sql("SELECT match_id, frame, type, CAST(cluster AS BIGINT) AS cluster FROM clu", *_TO_EV, _CLU))
def cluster_events(spark, sf):
    return highlights.cluster_events(highlights.highlight_events(_ball(spark, sf), adjacent=False)).select("match_id", "frame", "type", "cluster")


@query(_sql("""SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY cluster) - 1 AS clip_id, round(a, 6) AS start_sec, round(b, 6) AS end_sec, round(b - a, 6) AS duration, event_count, event_types FROM
 (SELECT match_id, cluster, greatest(0.0e0, min(frame / 30.0e0) - 5) AS a, max(frame / 30.0e0) + 3 AS b, count(*) AS event_count, string_agg(DISTINCT type, ',' ORDER BY type) AS event_types FROM clu GROUP BY match_id, cluster) WHERE b - a >= 3""", *_TO_EV, _CLU))
def highlight_clips(spark, sf):
    found = highlights.highlight_clips(_ball(spark, sf), adjacent=False)
    return found.select("match_id", "clip_id", _r("start_sec"), _r("end_sec"), _r("duration"), "event_count", F.array_join("event_types", ",").alias("event_types"))


_NEXT = """vel AS (SELECT match_id, frame, x, y, vx, vy, sqrt(vx * vx + vy * vy) AS speed FROM (SELECT match_id, frame, x, y, coalesce((x - lag(x) OVER w) * 30.0e0, 0.0e0) AS vx, coalesce((y - lag(y) OVER w) * 30.0e0, 0.0e0) AS vy
  FROM fr WINDOW w AS (PARTITION BY match_id ORDER BY frame)))"""
_TO_NEXT = (*_TO_DENSE, _NEXT, _EV)


def _next(spark: SparkSession, sf: str) -> DataFrame:
    """The ball on every frame of the match, null where there is none: velocities are between frames that follow each other."""
    return tracking.dense(_ball(spark, sf).select("match_id", "frame", "x", "y"))


@query(_sql("SELECT match_id, frame, round(vx, 6) AS vx, round(vy, 6) AS vy, round(speed, 6) AS speed FROM vel", *_TO_NEXT))
def ball_velocity_adjacent(spark, sf):
    return highlights.ball_velocity(_next(spark, sf)).select("match_id", "frame", _r("vx"), _r("vy"), _r("speed"))


@query(_sql("SELECT match_id, frame, type, round(value, 6) AS value FROM ev", *_TO_NEXT))
def highlight_events_adjacent(spark, sf):
    return highlights.highlight_events(_next(spark, sf)).select("match_id", "frame", "type", _r("value"))


@query(ORACLE_SQL["highlight_clips"].replace(_VEL, f"{_SPINE}, {_DENSE}, {_NEXT}"))
def highlight_clips_adjacent(spark, sf):
    found = highlights.highlight_clips(_next(spark, sf))
    return found.select("match_id", "clip_id", _r("start_sec"), _r("end_sec"), _r("duration"), "event_count", F.array_join("event_types", ",").alias("event_types"))


# ---- hard frames and labeling

_RUNS = "runs AS (SELECT match_id, frame, frame - row_number() OVER (PARTITION BY match_id ORDER BY frame) AS island FROM fr WHERE x IS NULL)"
_LOW = "low AS (SELECT match_id, frame, confidence AS conf FROM (SELECT *, row_number() OVER (PARTITION BY match_id, frame ORDER BY det_id) AS r FROM band WHERE confidence < 0.3e0) WHERE r = 1)"
_GAP = "gap AS (SELECT match_id, frame, gap_length FROM (SELECT *, count(*) OVER (PARTITION BY match_id, island) AS gap_length FROM runs) WHERE gap_length >= 15)"
_JUMP = "jmp AS (SELECT match_id, frame, round_even(distance_px, 1) AS distance_px FROM (SELECT match_id, frame, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS distance_px FROM fr WINDOW w AS (PARTITION BY match_id ORDER BY frame)) WHERE distance_px > 150)"
_HARD = """hard AS (SELECT match_id, frame, string_agg(t, ',' ORDER BY i) AS reasons, max(conf) AS conf, max(gap_length) AS gap_length, max(distance_px) AS distance_px FROM (
 SELECT match_id, frame, 0 AS i, 'low_confidence' AS t, conf, NULL AS gap_length, NULL AS distance_px FROM low UNION ALL SELECT match_id, frame, 1, 'lost_ball_gap', NULL, gap_length, NULL FROM gap UNION ALL SELECT match_id, frame, 2, 'position_jump', NULL, NULL, distance_px FROM jmp) GROUP BY match_id, frame)"""
_TO_HARD = (*_TO_DENSE, _RUNS, _LOW, _GAP, _JUMP, _HARD)


@query(_sql("SELECT match_id, frame, conf FROM low", *_TO_HARD))
def low_confidence_frames(spark, sf):
    return hardframes.low_confidence_frames(d.y_band_filter(inputs.detections(spark, sf))).select("match_id", "frame", "conf")


@query(_sql("SELECT match_id, frame, 15 AS run_length FROM (SELECT *, row_number() OVER (PARTITION BY match_id, island ORDER BY frame) AS k FROM runs) WHERE k = 15", *_TO_DENSE, _RUNS))
def lost_run_triggers(spark, sf):
    return hardframes.lost_run_triggers(_plain_tracks(spark, sf))


@query(_sql("SELECT match_id, frame, gap_length FROM gap", *_TO_HARD))
def lost_gap_frames(spark, sf):
    return hardframes.lost_gap_frames(_plain_tracks(spark, sf))


@query(_sql("SELECT match_id, frame, round(distance_px, 6) AS distance_px FROM jmp", *_TO_HARD))
def position_jumps(spark, sf):
    return hardframes.position_jumps(_plain_tracks(spark, sf)).select("match_id", "frame", _r("distance_px"))


def _hard(spark: SparkSession, sf: str) -> DataFrame:
    return hardframes.hard_frames(d.y_band_filter(inputs.detections(spark, sf)), _plain_tracks(spark, sf))


@query(_sql("SELECT match_id, frame, round_even(frame / 30.0e0, 3) AS time_sec, reasons, conf, gap_length, round(distance_px, 6) AS distance_px FROM hard", *_TO_HARD))
def hard_frames(spark, sf):
    return _hard(spark, sf).select("match_id", "frame", "time_sec", F.array_join("reasons", ",").alias("reasons"), "conf", "gap_length", _r("distance_px"))


@query(_sql("SELECT match_id, frame FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY md5(match_id || '|' || frame || '|42'), frame) AS r FROM hard) WHERE r <= 100", *_TO_HARD))
def sample_hard_frames(spark, sf):
    return selection.sample_hard_frames(_hard(spark, sf), HardFrames(cap=100)).select("match_id", "frame")


@query(_sql("SELECT match_id, frame FROM det WHERE confidence < 0.3e0 UNION SELECT match_id, frame FROM (SELECT match_id, CAST(unnest(generate_series(0, last)) AS BIGINT) AS frame FROM (SELECT match_id, max(frame) AS last FROM det GROUP BY 1) EXCEPT SELECT match_id, frame FROM det)"))
def threshold_hard_frames(spark, sf):
    return hardframes.threshold_hard_frames(inputs.detections(spark, sf))


_CAND = """srun AS (SELECT match_id, frame, frame - row_number() OVER (PARTITION BY match_id ORDER BY frame) AS island FROM st WHERE frame >= 0 AND status <> 'accepted'),
cnd AS (SELECT match_id, frame, string_agg(t, ',' ORDER BY i) AS triggers, max(conf) AS conf, max(run_length) AS run_length, max(distance_px) AS distance_px, max(i) > 0 AS rare FROM (
 SELECT match_id, frame, 0 AS i, 'low_conf' AS t, confidence AS conf, NULL AS run_length, NULL AS distance_px FROM best WHERE confidence BETWEEN 0.20e0 AND 0.50e0
 UNION ALL SELECT match_id, frame, 1, 'lost_run', NULL, 15, NULL FROM (SELECT *, row_number() OVER (PARTITION BY match_id, island ORDER BY frame) AS k FROM srun) WHERE k = 15
 UNION ALL SELECT match_id, frame, 2, 'jump_reject', NULL, NULL, round_even(d, 1) FROM st WHERE reason IN ('jump', 'speed') AND round_even(d, 1) >= 200) GROUP BY match_id, frame)"""


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    best = _best(spark, sf)
    stable = _written(tracking.stabilize_rows(best))
    return hardframes.labeling_candidates(best, tracking.stabilize_ball(best, stable=stable), tracking.stabilizer_events(stable))


@query(_sql("SELECT match_id, frame, round_even(frame / 30.0e0, 3) AS time_sec, triggers, conf, run_length, round(distance_px, 6) AS distance_px FROM cnd", *_TO_STAB, _CAND, recursive=True))
def labeling_candidates(spark, sf):
    return _candidates(spark, sf).select("match_id", "frame", "time_sec", F.array_join("triggers", ",").alias("triggers"), "conf", "run_length", _r("distance_px"))


_PICK = """rare AS (SELECT *, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY match_id) AS n FROM cnd WHERE rare WINDOW w AS (PARTITION BY match_id ORDER BY frame)),
dns AS (SELECT *, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY match_id) AS n FROM cnd WHERE NOT rare AND frame % 2 = 0 WINDOW w AS (PARTITION BY match_id ORDER BY frame)),
nr AS (SELECT match_id, count(*) FILTER (WHERE rare) AS n_rare FROM cnd GROUP BY match_id),
pick AS (SELECT match_id, frame FROM rare WHERE n <= 120 OR r IN (SELECT ((2 * i + 1) * n) // 240 FROM generate_series(0, 119) s(i))
 UNION ALL SELECT match_id, frame FROM (SELECT dns.*, greatest(120 - n_rare, 0) AS k FROM dns JOIN nr USING (match_id)) WHERE k > 0 AND (n <= k OR r IN (SELECT ((2 * i + 1) * n) // (2 * k) FROM generate_series(0, 119) s(i) WHERE i < k)))"""


@query(_sql("SELECT match_id, frame FROM pick", *_TO_STAB, _CAND, _PICK, recursive=True))
def select_for_labeling(spark, sf):
    return selection.select_for_labeling(_candidates(spark, sf), Labeling(cap=120)).select("match_id", "frame")


@query(_sql("SELECT match_id, identified, coalesce(exported, 0) AS exported FROM (SELECT match_id, count(*) AS identified FROM cnd GROUP BY 1) LEFT JOIN (SELECT match_id, count(*) AS exported FROM pick GROUP BY 1) USING (match_id)", *_TO_STAB, _CAND, _PICK, recursive=True))
def labeling_manifest(spark, sf):
    found = _candidates(spark, sf)
    return selection.manifest(selection.select_for_labeling(found, Labeling(cap=120)), found).select("match_id", "identified", "exported")


@query(_sql("""SELECT match_id, '{"match_id":' || match_id || ',"identified":' || identified || ',"exported":' || coalesce(exported, 0) || coalesce(',"frames":[' || frames || ']', '') || '}' AS document
 FROM (SELECT match_id, count(*) AS identified FROM cnd GROUP BY 1) LEFT JOIN (SELECT match_id, count(*) AS exported,
  string_agg('{"frame":' || frame || ',"image":"frame_' || lpad(CAST(frame AS VARCHAR), 6, '0') || '.jpg","triggers":["' || replace(triggers, ',', '","') || '"]}', ',' ORDER BY frame) AS frames
  FROM pick JOIN cnd USING (match_id, frame) GROUP BY 1) USING (match_id)""", *_TO_STAB, _CAND, _PICK, recursive=True))
def manifest_documents(spark, sf):
    found = _written(_candidates(spark, sf).select("match_id", "frame", "triggers"))
    return selection.manifest(selection.select_for_labeling(found, Labeling(cap=120)), found).select("match_id", "document")


@query(_sql("SELECT match_id, frame FROM (SELECT match_id, frame, row_number() OVER (PARTITION BY match_id ORDER BY frame) - 1 AS r, count(*) OVER (PARTITION BY match_id) AS n FROM best) WHERE r IN (SELECT ((2 * i + 1) * n) // 74 FROM generate_series(0, 36) s(i))", *_TO_BEST))
def evenly_sample(spark, sf):
    return selection.evenly_sample(_best(spark, sf).select("match_id", "frame"), 37)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents stand for frames of their source, labels for label files."""
    frames = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("match_id"), F.col("doc_id").cast("string").alias("stem"))
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").cast("string").alias("stem"))
    return selection.labeled_pairs(frames, frames.join(labels.hint("merge"), "stem", "left_semi"))


@query("SELECT source AS match_id, count(*) AS pairs FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY source")
def labeled_pairs(spark, sf):
    return selection.pair_counts(_pairs(spark, sf))


@query("""SELECT source AS match_id, CAST(doc_id AS VARCHAR) AS stem, CASE WHEN r <= greatest(1, floor(n * (1 - 0.2e0))) THEN 'train' ELSE 'val' END AS split, source || '_' || doc_id AS file FROM
 (SELECT *, row_number() OVER (ORDER BY md5(source || '|' || doc_id || '|42'), source, CAST(doc_id AS VARCHAR)) AS r, count(*) OVER () AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))""")
def build_dataset(spark, sf):
    return selection.build_dataset(_pairs(spark, sf))


@query(_sql("""SELECT match_id, frame, 'frame_' || lpad(CAST(frame AS VARCHAR), 6, '0') || '.jpg' AS image, round(x1 / 1920.0e0 * 100.0e0, 2) AS x, round(y1 / 960.0e0 * 100.0e0, 2) AS y, round((x2 - x1) / 1920.0e0 * 100.0e0, 2) AS w, round((y2 - y1) / 960.0e0 * 100.0e0, 2) AS h FROM best""", *_TO_BEST))
def label_tasks(spark, sf):
    rows = _best(spark, sf).select("match_id", "frame", F.array("x1", "y1", "x2", "y2").alias("bbox"))
    return selection.label_tasks(rows).drop("task")


@query(_sql("""SELECT match_id, frame, 'frame_' || lpad(CAST(frame AS VARCHAR), 6, '0') || '.jpg' AS image, '{"data":{"image":"/data/labeling/' || match_id || '/frames/frame_' || lpad(CAST(frame AS VARCHAR), 6, '0') || '.jpg","frame_index":' || frame || ',"match_name":"' || match_id || '"}'
  || CASE WHEN confidence < 0.5e0 AND frame % 3 <> 0 THEN ',"predictions":[{"model_version":"ball_detector","result":[{"from_name":"label","to_name":"image","type":"rectanglelabels","value":{"x":' || round(x1 / 1920.0e0 * 100.0e0, 2) || ',"y":' || round(y1 / 960.0e0 * 100.0e0, 2)
  || ',"width":' || round((x2 - x1) / 1920.0e0 * 100.0e0, 2) || ',"height":' || round((y2 - y1) / 960.0e0 * 100.0e0, 2) || ',"rectanglelabels":["ball"]}}]}]' ELSE '' END || '}' AS task FROM best WHERE frame % 5 <> 0""", *_TO_BEST))
def import_tasks(spark, sf):
    """Manifests of the unsure frames, written and read as nested documents, some entries without a box; the listing of exported
    frames has others too and lacks those whose export failed."""
    best, path = _best(spark, sf), _folder(spark)
    box = F.when(F.col("frame") % 3 != 0, F.array("x1", "y1", "x2", "y2"))
    entries = best.where("confidence < 0.5").groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct(F.col("frame").alias("frame_index"), box.alias("predicted_bbox")))).alias("frames"))
    writers.write_manifests(entries.withColumn("match_name", F.col("match_id").cast("string")), path)
    images = best.where("frame % 5 <> 0").select("match_id", naming.frame_file(F.col("frame")).alias("image"))
    others = best.where("frame % 5 = 0").select("match_id", F.concat(F.lit("mask_"), F.col("frame").cast("string"), F.lit(".jpg")).alias("image"))
    return selection.import_tasks(images.unionByName(others), readers.read_manifests(spark, path, "bigint", "part-*.json"))


# ---- render plans

_SEG = """seg AS (SELECT match_id, segment, start, stop, CASE WHEN segment > 0 THEN greatest(0, start - 15) ELSE start END AS warm_start FROM (
 SELECT match_id, k AS segment, k * (total_frames // 12) + least(k, total_frames % 12) AS start, (k + 1) * (total_frames // 12) + least(k + 1, total_frames % 12) AS stop FROM mat, generate_series(0, 11) s(k)))"""


@query(_sql("SELECT match_id, segment, start, stop, warm_start FROM seg", _MAT, _SEG))
def render_segments(spark, sf):
    return render.render_segments(inputs.matches(inputs.detections(spark, sf)))


@query(_sql("SELECT match_id, segment, frame, frame < start AS warm_up, 0.0e0 AS yaw, -5.0e0 AS pitch, 90.0e0 AS fov, round(degrees(2 * atan(tan(radians(90.0e0) / 2) * (1080 / 1920.0e0))), 6) AS vfov FROM (SELECT *, CAST(unnest(generate_series(warm_start, stop - 1)) AS BIGINT) AS frame FROM seg)", _MAT, _SEG))
def render_plan(spark, sf):
    m = inputs.matches(inputs.detections(spark, sf))
    return render.render_plan(camera.static_camera_path(m), render.render_segments(m)).withColumn("vfov", F.round("vfov", 6))


@query(_sql("""SELECT match_id, segment, frame, frame < start AS warm_up, CAST((greatest(frame, start) * 7 + match_id) % 360 - 180 AS DOUBLE) AS yaw, CAST(-(greatest(frame, start) % 31) AS DOUBLE) AS pitch, CAST(60 + greatest(frame, start) % 41 AS DOUBLE) AS fov,
  round(degrees(2 * atan(tan(radians(CAST(60 + greatest(frame, start) % 41 AS DOUBLE)) / 2) * (1080 / 1920.0e0))), 6) AS vfov FROM (SELECT *, CAST(unnest(generate_series(warm_start, stop - 1)) AS BIGINT) AS frame FROM seg)""", _MAT, _SEG))
def render_plan_moving(spark, sf):
    """A camera that moves at every frame: warm-up frames look where their segment starts."""
    m = inputs.matches(inputs.detections(spark, sf))
    f = F.col("frame")
    path = camera.static_camera_path(m).select("match_id", "frame", ((f * 7 + F.col("match_id")) % 360 - 180).cast("double").alias("yaw"), (-(f % 31)).cast("double").alias("pitch"), (60 + f % 41).cast("double").alias("fov"))
    return render.render_plan(path, render.render_segments(m)).withColumn("vfov", F.round("vfov", 6))


@query(_sql("SELECT match_id, segment, count(*) AS frames, max(fov) AS fov, round(max(degrees(2 * atan(tan(radians(fov) / 2) * (1080 / 1920.0e0)))), 6) AS vfov FROM (SELECT match_id, segment, 120.0e0 AS fov, unnest(generate_series(warm_start, stop - 1)) AS frame FROM seg) GROUP BY match_id, segment", _MAT, _SEG))
def tactical_plan(spark, sf):
    plan = render.tactical_plan(inputs.matches(inputs.detections(spark, sf)))
    return plan.groupBy("match_id", "segment").agg(F.count("*").alias("frames"), F.max("fov").alias("fov"), F.round(F.max("vfov"), 6).alias("vfov"))


@query(_sql("SELECT match_id, segment, min(frame) AS start, max(frame) + 1 AS stop FROM (SELECT match_id, frame, ntile(12) OVER (PARTITION BY match_id ORDER BY frame) - 1 AS segment FROM spine) GROUP BY match_id, segment", *_TO_BEST, _SPINE))
def ntile_segments(spark, sf):
    return render.ntile_segments(tracking.frame_spine(_best(spark, sf)), Render())


# ---- ingest

_SNAP = f"snap AS ({inputs.SNAPSHOTS_SQL.format(events='events')})"
_FILES = """files AS (SELECT event_id, user_id, ts, '/in/' || CASE WHEN event_id % 7 = 0 THEN '.' ELSE '' END || 'm' || user_id || CASE WHEN event_id % 5 = 0 THEN '.MP4' WHEN event_id % 5 = 1 THEN '.insv' WHEN event_id % 5 = 2 THEN '.mp4.part' WHEN event_id % 5 = 3 THEN '.tar.gz' ELSE '.mov' END AS path,
  CAST(floor(value) AS BIGINT) AS size, event_id % 3 AS mtime_ns FROM events)"""


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """Files named by user, kind by event: dotfiles, videos, staged copies and archives."""
    e = F.col("event_id")
    ext = F.when(e % 5 == 0, ".MP4").when(e % 5 == 1, ".insv").when(e % 5 == 2, ".mp4.part").when(e % 5 == 3, ".tar.gz").otherwise(".mov")
    path = F.concat(F.lit("/in/"), F.when(e % 7 == 0, ".").otherwise(""), F.lit("m"), F.col("user_id").cast("string"), ext)
    return inputs.events(spark, sf).select("event_id", "user_id", "ts", path.alias("path"), F.floor("value").cast("long").alias("size"), (e % 3).alias("mtime_ns"))


@query(f"WITH {_FILES} SELECT event_id, path FROM files WHERE event_id % 7 <> 0 AND event_id % 5 IN (0, 1, 4)")
def ingest_candidates(spark, sf):
    return ingest.ingest_candidates(_files(spark, sf)).select("event_id", "path")


@query(f"""WITH {_FILES} SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '.' ELSE '' END || 'm' || user_id AS stem, CASE event_id % 5 WHEN 0 THEN '.MP4' WHEN 1 THEN '.insv' WHEN 2 THEN '.mp4.part' WHEN 3 THEN '.tar.gz' ELSE '.mov' END AS suffixes,
  strftime(ts, '%Y%m%d_%H%M%S') || '_' || CASE WHEN event_id % 7 = 0 THEN '.' ELSE '' END || 'm' || user_id AS job_id, 'size=' || size || ',mtime=' || mtime_ns AS fp_key FROM files""")
def file_names(spark, sf):
    rows = ingest.with_fingerprint(_files(spark, sf))
    name = naming.base_name(F.col("path"))
    key = F.replace("fp_key", F.lit("mtime_ns="), F.lit("mtime="))
    return rows.select("event_id", naming.stem(name).alias("stem"), naming.all_suffixes(name).alias("suffixes"), naming.job_id(F.col("ts"), name).alias("job_id"), key.alias("fp_key"))


@query(f"""WITH {_SNAP}, r AS (SELECT *, coalesce(size = lag(size) OVER w AND size > 0, false) AS same FROM snap WHERE poll_no <= 20 WINDOW w AS (PARTITION BY path ORDER BY poll_no)),
 i AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY poll_no ROWS UNBOUNDED PRECEDING) AS island FROM r),
 k AS (SELECT *, sum(CASE WHEN same THEN 1 ELSE 0 END) OVER (PARTITION BY path, island ORDER BY poll_no ROWS UNBOUNDED PRECEDING) AS run FROM i)
 SELECT path, min(poll_no) AS poll_no, arg_min(size, poll_no) AS size FROM k WHERE run = 2 GROUP BY path""")
def stable_files(spark, sf):
    return ingest.stable_files(inputs.snapshots(spark, sf), Ingest(checks=2))


@query("""SELECT event_id, CASE WHEN mtime_ns >= 0 THEN 'size=' || size || ',mtime_ns=' || mtime_ns || CASE WHEN ino > 0 THEN ',ino=' || ino ELSE '' END || CASE WHEN dev > 0 THEN ',dev=' || dev ELSE '' END END AS fp_key,
  CASE WHEN mtime_ns >= 0 AND ctime_ns > 0 THEN ctime_ns END AS ctime_ns, CASE WHEN mtime_ns >= 0 AND ino > 0 THEN ino END AS ino, CASE WHEN mtime_ns >= 0 AND dev > 0 THEN dev END AS dev
 FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS size, event_id % 4 - 1 AS mtime_ns, event_id % 3 AS ctime_ns, event_id % 5 - 1 AS ino, event_id % 2 AS dev FROM events)""")
def file_fingerprints(spark, sf):
    """Fingerprints with change times, inodes and devices, some of them missing, some times invalid."""
    e = F.col("event_id")
    rows = inputs.events(spark, sf).select(e, F.floor("value").cast("long").alias("size"), (e % 4 - 1).alias("mtime_ns"), (e % 3).alias("ctime_ns"), (e % 5 - 1).alias("ino"), (e % 2).alias("dev"))
    return ingest.with_fingerprint(rows).select("event_id", "fp_key", "fp.ctime_ns", "fp.ino", "fp.dev")


@query(f"WITH {_FILES} SELECT event_id, path FROM files f WHERE NOT EXISTS (SELECT 1 FROM files g WHERE g.event_id % 4 = 0 AND g.path = f.path AND g.size = f.size AND g.mtime_ns = f.mtime_ns)")
def unprocessed(spark, sf):
    """Each fourth event has been processed."""
    files = ingest.with_fingerprint(_files(spark, sf))
    return ingest.unprocessed(files, _files(spark, sf).where("event_id % 4 = 0")).select("event_id", "path")


@query(f"WITH {_FILES} SELECT path, event_id FROM (SELECT path, event_id, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS r FROM files) WHERE r = 1")
def latest_ledger(spark, sf):
    rows = _files(spark, sf).select("path", "event_id", F.struct("ts", "event_id").alias("processed_at"))
    return ingest.latest_ledger(rows).select("path", "event_id")


@query(f"WITH {_FILES} SELECT path, event_id FROM files ORDER BY ts DESC, path DESC LIMIT 200")
def prune_ledger(spark, sf):
    rows = _files(spark, sf).select("path", "event_id", F.col("ts").alias("processed_at"))
    return ingest.prune_ledger(rows, Ingest(ledger_cap=200)).select("path", "event_id")


@query("""WITH q AS (SELECT user_id, arg_min(floor(value), event_id) AS a, count(*) % 2 AS n FROM events GROUP BY user_id), c AS (SELECT user_id, arg_max(floor(value / 8), event_id) AS b FROM events WHERE user_id % 5 <> 0 GROUP BY user_id)
 SELECT CAST(q.user_id AS VARCHAR) AS path, CASE WHEN c.user_id IS NULL THEN 'skip_missing' WHEN b = floor(a / 8) THEN 'run' WHEN n < 1 THEN 'requeue' ELSE 'skip_changed' END AS action FROM q LEFT JOIN c USING (user_id)""")
def revalidate_queue(spark, sf):
    """First and last sizes of each user's events, in coarse steps, stand for queued and current fingerprints."""
    e = inputs.events(spark, sf)
    path = F.col("user_id").cast("string").alias("path")
    step = lambda v: F.floor(v / 8).cast("string")
    queue = e.groupBy("user_id").agg(F.min_by(F.floor("value"), "event_id").alias("a"), (F.count("*") % 2).alias("requeue_count")).select(path, step(F.col("a")).alias("fp_key"), "requeue_count")
    now = e.where("user_id % 5 <> 0").groupBy("user_id").agg(F.max_by("value", "event_id").alias("b")).select(path, step(F.col("b")).alias("fp_key"))
    return ingest.revalidate_queue(queue, now).select("path", "action")


_NUMBERED = "lpad(CAST(i AS VARCHAR), CAST(greatest(2, len(CAST(i AS VARCHAR))) AS INTEGER), '0')"


@query(f"""WITH RECURSIVE e AS (SELECT event_id, 'm' || CAST(floor(user_id / 15) AS BIGINT) || '_d' || (event_id % 9) AS fam, event_id % 7 = 0 AS odd, event_id % 13 = 0 AS bad, event_id % 50 = 0 AS held, event_id % 75 = 0 AS held2 FROM events),
 x AS (SELECT fam, list(DISTINCT name) AS t FROM (SELECT fam, fam || '.mp4' AS name FROM e WHERE held UNION SELECT fam, fam || '_02.mp4' FROM e WHERE held2) GROUP BY fam),
 a AS (SELECT fam, event_id, CASE WHEN odd THEN fam || '_01' ELSE fam END AS stem, row_number() OVER (PARTITION BY fam ORDER BY event_id) AS k FROM e WHERE NOT bad),
 s AS (SELECT f.fam, CAST(0 AS BIGINT) AS k, coalesce(t, CAST([] AS VARCHAR[])) AS taken, CAST(NULL AS VARCHAR) AS dest, CAST(NULL AS BIGINT) AS event_id FROM (SELECT DISTINCT fam FROM e) f LEFT JOIN x USING (fam)
  UNION ALL SELECT fam, k, list_append(taken, dest), dest, event_id FROM (SELECT s.fam, a.k, s.taken, a.event_id,
    CASE WHEN NOT list_contains(s.taken, a.stem || '.mp4') THEN a.stem || '.mp4' ELSE list_filter(list_transform(range(1, len(s.taken) + 2), lambda i: a.stem || '_' || {_NUMBERED} || '.mp4'), lambda d: NOT list_contains(s.taken, d))[1] END AS dest
   FROM s JOIN a ON a.fam = s.fam AND a.k = s.k + 1))
 SELECT event_id, dest, 'ok' AS status, CAST(NULL AS VARCHAR) AS reason FROM s WHERE k > 0 UNION ALL SELECT event_id, NULL, 'reject', 'escapes' FROM e WHERE bad""")
def archive_plan(spark, sf):
    """Every event is a file that arrives; the archive holds some, names cross with suffixed ones, some try to leave it."""
    e = F.col("event_id")
    match = F.concat(F.lit("m"), F.floor(F.col("user_id") / 15).cast("string"))
    job = F.concat(F.lit("d"), (e % 9).cast("string"))
    events = inputs.events(spark, sf)
    path = F.when(e % 13 == 0, F.concat(match, F.lit("/../../x"))).when(e % 11 == 0, F.concat(F.lit("y/../"), match)).otherwise(match)
    rows = events.select("event_id", F.concat(F.lit("/in/f"), e.cast("string"), F.lit(".mp4")).alias("src"), path.alias("match"), F.concat(job, F.when(e % 7 == 0, "_01").otherwise("")).alias("job_id"), e.alias("arrival"))
    held = lambda every, end: events.where(e % every == 0).select(F.concat(match, F.lit("_"), job, F.lit(end)).alias("name"))
    return ingest.archive_plan(rows, held(50, ".mp4").unionByName(held(75, "_02.mp4")), hand_over=_written).select("event_id", "dest", "status", "reason")


@query(f"""WITH a AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k FROM events), t AS (SELECT event_id % 4001 AS i FROM events WHERE event_id % 9 = 0 UNION SELECT event_id FROM events WHERE event_id % 2 = 0),
 f AS (SELECT i, row_number() OVER (ORDER BY i) AS k FROM (SELECT unnest(generate_series(0, (SELECT count(*) * 2 + 1 FROM events))) AS i EXCEPT SELECT i FROM t))
 SELECT event_id, CASE WHEN i = 0 THEN 'final_cam.tar.gz' ELSE 'final_cam_' || {_NUMBERED} || '.tar.gz' END AS dest FROM a JOIN f USING (k)""")
def archive_one_family(spark, sf):
    """Every event is a file that asks for one and the same name, many of whose numbers are taken."""
    events, name = inputs.events(spark, sf), lambda i: F.when(i == 0, "final_cam.tar.gz").otherwise(F.format_string("final_cam_%02d.tar.gz", i))
    rows = events.select("event_id", F.concat(F.lit("/in/f"), F.col("event_id").cast("string"), F.lit(".tar.gz")).alias("src"), F.lit("final").alias("match"), F.lit("cam").alias("job_id"), F.col("event_id").alias("arrival"))
    e = F.col("event_id")
    held = events.where(e % 9 == 0).select(name(e % 4001).alias("name")).unionByName(events.where(e % 2 == 0).select(name(e).alias("name")))
    return ingest.archive_plan(rows, held, hand_over=_written).select("event_id", "dest")


@query("""WITH RECURSIVE a AS (SELECT event_id, 'job' || user_id AS fam, 'job' || user_id || CASE WHEN event_id % 5 = 0 THEN '_run1' ELSE '' END AS name, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
 s AS (SELECT fam, CAST(0 AS BIGINT) AS k, [fam || '_run2'] AS taken, CAST(NULL AS VARCHAR) AS directory, CAST(NULL AS BIGINT) AS event_id FROM (SELECT DISTINCT fam FROM a)
  UNION ALL SELECT fam, k, list_append(taken, directory), directory, event_id FROM (SELECT s.fam, a.k, s.taken, a.event_id,
    CASE WHEN NOT list_contains(s.taken, a.name) THEN a.name ELSE list_filter(list_transform(range(1, len(s.taken) + 2), lambda i: a.name || '_run' || i), lambda d: NOT list_contains(s.taken, d))[1] END AS directory
   FROM s JOIN a ON a.fam = s.fam AND a.k = s.k + 1))
 SELECT event_id, directory FROM s WHERE k > 0""")
def unique_directories(spark, sf):
    """Every event wants a directory of its user; every fifth asks for a numbered one, and one of each user exists."""
    events, job = inputs.events(spark, sf), F.concat(F.lit("job"), F.col("user_id").cast("string"))
    rows = events.select("event_id", F.concat(job, F.when(F.col("event_id") % 5 == 0, "_run1").otherwise("")).alias("name"), F.col("event_id").alias("arrival"))
    return ingest.unique_directories(rows, events.select(F.concat(job, F.lit("_run2")).alias("name")).distinct(), _written).select("event_id", "directory")


@query("SELECT count(*) FILTER (WHERE event_id % 10 <> 0 AND event_id % 7 <> 0) AS valid, count(*) FILTER (WHERE event_id % 10 = 0 OR event_id % 7 = 0) AS quarantined FROM events")
def parse_ledger(spark, sf):
    """Ledger lines of the events: every tenth is cut short, every seventh has a negative size."""
    e = F.col("event_id")
    record = F.to_json(F.struct(F.concat(F.lit("/in/"), e.cast("string")).alias("path"), F.when(e % 7 == 0, -1).otherwise(e).alias("size"), e.alias("mtime_ns"), F.col("ts").alias("processed_at")))
    lines = inputs.events(spark, sf).select(F.when(e % 10 == 0, F.substring(record, 1, 12)).otherwise(record).alias("value"))
    good, bad = ingest.parse_ledger(lines)
    counted = good.select(F.lit(1).alias("v"), F.lit(0).alias("q")).unionByName(bad.select(F.lit(0).alias("v"), F.lit(1).alias("q")))
    return counted.agg(F.sum("v").alias("valid"), F.sum("q").alias("quarantined"))


# ---- sources, sinks, runs


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one; where none is named, a local session (tests) gets a temporary one, a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def _written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so that a fold under several tables runs once."""
    path = _folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query(_sql("SELECT match_id, count(*) AS n, round(sum(x1 + y2), 3) AS s, round(sum(confidence), 6) AS c, max(frame) AS last FROM det GROUP BY match_id"))
def read_detections(spark, sf):
    """Detections written as lines of one file tree and read again."""
    path = _folder(spark)
    rows = inputs.detections(spark, sf).select("match_id", "frame", F.array("x1", "y1", "x2", "y2").alias("bbox"), "confidence", F.col("class_id").alias("class"))
    writers.write_detections(rows, path)
    back = readers.to_v1_schema(spark.read.schema(readers.DETECTION_LINE + ", match_id bigint").option("mode", "FAILFAST").json(path))
    return back.groupBy("match_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x1") + F.col("y2")), 3).alias("s"), F.round(F.sum("confidence"), 6).alias("c"), F.max("frame").alias("last"))


@query(_sql("SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY frame) - 1 AS frame, x1 AS yaw, y1 AS pitch, 90.0e0 AS fov FROM best", *_TO_BEST))
def read_camera_path(spark, sf):
    rows = _best(spark, sf).select("match_id", "frame", F.col("x1").alias("yaw"), F.col("y1").alias("pitch"), F.lit(90.0).alias("fov"))
    documents = writers.documents_of(rows).withColumnRenamed("document", "value")
    return readers.camera_frames(documents)


@query(_sql("SELECT match_id, frame, x1, y1, confidence FROM best", *_TO_BEST))
def array_documents(spark, sf):
    """A JSON array for each match, written by several tasks and read again by line."""
    path = _folder(spark)
    writers.write_arrays(_best(spark, sf).select("match_id", "frame", "x1", "y1", "confidence"), path, per_file=400)
    return readers.read_arrays(spark, path, "frame bigint, x1 double, y1 double, confidence double", "bigint")


@query("SELECT user_id AS match_id, 1920 AS width, 960 AS height, 30000 / 1001.0e0 AS fps, CAST(count(*) AS DOUBLE) AS duration, CAST(round_even(30000 / 1001.0e0 * count(*), 0) AS BIGINT) AS total_frames, 'h264' AS codec FROM events GROUP BY user_id")
def read_matches(spark, sf):
    """A probe document per user whose duration is the number of events."""
    made = F.format_string('{"streams":[{"codec_type":"audio"},{"codec_type":"video","codec_name":"h264","width":1920,"height":960,"r_frame_rate":"30000/1001"}],"format":{"duration":"%d"}}', F.col("n"))
    probes = inputs.events(spark, sf).groupBy(F.col("user_id").alias("match_id")).agg(F.count("*").alias("n")).select("match_id", made.alias("value"))
    return readers.matches_of_probes(probes)


@query(_sql("SELECT match_id, 'frame_' || lpad(CAST(frame AS VARCHAR), 6, '0') AS stem, class_id, x / 1920.0e0 AS cx, y / 960.0e0 AS cy FROM best", *_TO_BEST))
def read_yolo_labels(spark, sf):
    rows = d.centers_of(_best(spark, sf)).join(_best(spark, sf).select("match_id", "frame", "class_id").hint("merge"), ["match_id", "frame"])
    line = F.concat_ws(" ", F.col("class_id").cast("string"), (F.col("x") / 1920.0).cast("string"), (F.col("y") / 960.0).cast("string"), F.lit("0.1"), F.lit("0.1"))
    lines = rows.select("match_id", line.alias("value"), F.format_string("/labels/frame_%06d.txt", "frame").alias("path"))
    return readers.yolo_rows(lines).select("match_id", "stem", "class_id", "cx", "cy")


@query(_sql("SELECT match_id, mode, n_artifacts FROM (SELECT match_id, CASE WHEN match_id % 3 = 2 THEN 'no_detect' ELSE 'normal' END AS mode, CASE WHEN match_id % 3 = 2 THEN 1 ELSE 5 END AS n_artifacts FROM mat)", _MAT))
def run_summary(spark, sf):
    m = inputs.matches(inputs.detections(spark, sf))
    return writers.run_summary(m, writers.artifact_plan(m)).select("match_id", "mode", "n_artifacts")


@query(_sql("""SELECT match_id, mode, n_artifacts, artifacts, '{"fps":30.0,"version":1}' AS config_json FROM (SELECT match_id, CASE WHEN match_id % 3 = 2 THEN 'no_detect' ELSE 'normal' END AS mode, CASE WHEN match_id % 3 = 2 THEN 1 ELSE 5 END AS n_artifacts,
  CASE WHEN match_id % 3 = 2 THEN 'camera_path.json' ELSE 'ffprobe_meta.json,detections.jsonl,tracks.json,camera_path.json,foi_meta.json' END AS artifacts FROM mat)""", _MAT))
def run_documents(spark, sf):
    """The runs table with its lists of artifacts and the configuration, written by match and read again."""
    m, path = inputs.matches(inputs.detections(spark, sf)), _folder(spark)
    writers.write_runs(writers.run_summary(m, writers.artifact_plan(m), '{"fps":30.0,"version":1}'), path)
    back = spark.read.schema("mode string, n_artifacts bigint, artifacts array<string>, config_json string, match_id bigint").parquet(path)
    return back.select("match_id", "mode", "n_artifacts", F.array_join("artifacts", ",").alias("artifacts"), "config_json")


@query()
def run_all_matches(spark, sf):
    """All matches end to end: rows of each table by match."""
    rows = inputs.detections(spark, sf)
    m = inputs.matches(rows)
    return overview(run_matches(rows, m, hand_over=_written), m)


@query(_sql("SELECT match_id, mode, n_artifacts, n FROM (SELECT match_id, CASE WHEN match_id % 3 = 2 THEN 'no_detect' ELSE 'normal' END AS mode, CASE WHEN match_id % 3 = 2 THEN 1 ELSE 5 END AS n_artifacts FROM mat) JOIN (SELECT match_id, count(*) AS n FROM best GROUP BY match_id) USING (match_id)", _MAT, *_TO_BEST))
def restarted_runs(spark, sf):
    """Matches saved in three runs: the first does a third of them, the second leaves its tables half-way, the last does what is
    left. Each match is complete once, with the rows of one run."""
    rows, root = _written(_best(spark, sf)), _folder(spark)
    m = _written(inputs.matches(inputs.detections(spark, sf)))
    build = lambda todo: {"best": rows.join(todo.select("match_id").hint("merge"), "match_id", "left_semi")}
    save_tables(build, m.where("match_id % 3 = 0"), root, _written)
    writers.overwrite_matches(build(m.where("match_id % 3 = 1"))["best"].where("frame % 2 = 0"), f"{root}/best")
    save_tables(build, m, root, _written)
    saved = spark.read.schema("match_id bigint").parquet(f"{root}/best").groupBy("match_id").agg(F.count("*").alias("n"))
    runs = spark.read.schema("mode string, n_artifacts bigint, match_id bigint").parquet(f"{root}/runs")
    return runs.join(saved.hint("merge"), "match_id").select("match_id", "mode", "n_artifacts", "n")


# ---- streaming


def _stream(spark: SparkSession, rows: DataFrame, schema: str, run, keys: list[str]) -> DataFrame:
    """rows through a file stream into a table, until all is read; the result is that table."""
    path = _folder(spark)
    rows.repartition(*keys).sortWithinPartitions(*keys).write.parquet(f"{path}/in")
    out = run(spark.readStream.schema(schema).parquet(f"{path}/in"))
    stream = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@query(_sql("SELECT match_id, frame, status, reason, round(CASE WHEN status = 'accepted' THEN ex END, 6) AS x FROM st WHERE frame >= 0", *_TO_STAB, recursive=True))
def live_stabilization(spark, sf):
    rows = d.centers_of(_best(spark, sf)).select("match_id", "frame", "x", "y")
    out = _stream(spark, rows, "match_id bigint, frame bigint, x double, y double", live_stabilizer, ["match_id"])
    return out.select("match_id", "frame", "status", "reason", _r("x"))


def _triggers(spark: SparkSession, parts: list[DataFrame], schema: str, start) -> str:
    """The parts as a file stream, one trigger each: start(stream, path) is a writer. A folder for the stream's output."""
    path = _folder(spark)
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        start(spark.readStream.schema(schema).parquet(f"{path}/in"), path).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return path


def _to_table(run):
    def start(stream: DataFrame, path: str):
        out = run(stream)
        start.schema = out.schema
        return out.writeStream.format("parquet").option("path", f"{path}/out")

    return start


_REORDERED = _DENSE.replace("LEFT JOIN best b", "LEFT JOIN (SELECT * FROM best JOIN (SELECT match_id, max(frame) AS newest FROM best GROUP BY match_id) USING (match_id) WHERE NOT (frame % 101 = 5 AND frame < newest - 1600)) b")


@query(_sql("""SELECT match_id, frame, status, reason, round(CASE WHEN status = 'accepted' THEN ex END, 6) AS x FROM st WHERE frame >= 0
 UNION ALL SELECT match_id, frame, 'late', NULL, NULL FROM best JOIN (SELECT match_id, max(frame) AS newest FROM best GROUP BY match_id) USING (match_id) WHERE frame % 101 = 5 AND frame < newest - 1600""", _BAND, _BEST, _SPINE, _REORDERED, _STAB, recursive=True))
def live_reordered(spark, sf):
    """Frames that come up to two triggers late are put in order; the few that come after all others are reported as late."""
    rows = d.centers_of(_best(spark, sf)).select("match_id", "frame", "x", "y")
    newest = rows.groupBy("match_id").agg(F.max("frame").alias("newest"))
    last = (F.col("frame") % 101 == 5) & (F.col("frame") < F.col("newest") - 1600)
    turn = F.when(last, 5).otherwise(F.floor(F.col("frame") * 4 / (F.col("newest") + 1)).cast("int") + F.when(F.col("frame") % 7 == 3, 1).otherwise(0))
    placed = _written(rows.join(newest.hint("merge"), "match_id").select("match_id", "frame", "x", "y", F.timestamp_seconds(F.col("frame") / 30.0 + 86400).alias("time"), turn.alias("turn"), "newest"))
    hold = 1 + placed.agg(F.max(F.ceil((F.col("newest") + 1) / 2))).first()[0]
    end = spark.range(1).select(F.lit(-1).cast("long").alias("match_id"), F.lit(0).cast("long").alias("frame"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.timestamp_seconds(F.lit(10**9)).alias("time"))
    parts = [placed.where(F.col("turn") == k).drop("turn", "newest").repartition("match_id") for k in range(6)] + [end]
    run = _to_table(lambda stream: live_stabilizer(stream, time="time", delay="1 day", hold=hold, late=True))
    path = _triggers(spark, parts, "match_id bigint, frame bigint, x double, y double, time timestamp", run)
    out = spark.read.schema(run.schema).parquet(f"{path}/out").where("match_id >= 0")
    return out.select("match_id", "frame", "status", "reason", _r("x"))


@query(ORACLE_SQL["stable_files"])
def stable_file_stream(spark, sf):
    """The polls of stable_files in three triggers; the state of a path is carried from one to the next."""
    rows = inputs.snapshots(spark, sf)
    parts = [rows.where(F.col("poll_no").between(a, b)).repartition("path") for a, b in ((1, 7), (8, 15), (16, 1 << 40))]
    run = _to_table(lambda stream: ingest_streams.stable_stream(stream, Ingest(checks=2)))
    path = _triggers(spark, parts, "path string, poll_no bigint, size bigint", run)
    return spark.read.schema(run.schema).parquet(f"{path}/out")


@query("""WITH f AS (SELECT user_id, event_id % 3 AS batch, CAST(floor(arg_max(value, event_id) / 100) AS BIGINT) AS size FROM events WHERE event_id % 7 <> 0 GROUP BY ALL)
 SELECT '/in/m' || user_id || '.mp4' AS path, size, batch FROM (SELECT *, lag(size) OVER (PARTITION BY user_id ORDER BY batch) AS held FROM f) WHERE held IS NULL OR held <> size""")
def processed_files(spark, sf):
    """Files as three batches see them, dotfiles among them: those that are new or have changed since the ledger's last
    version of their path are processed, once."""
    e = F.col("event_id")
    seen = inputs.events(spark, sf).groupBy("user_id", (e % 3).alias("batch"), (e % 7 == 0).alias("dot")).agg(F.floor(F.max_by("value", e) / 100).cast("long").alias("size"))
    path = F.concat(F.lit("/in/"), F.when(F.col("dot"), ".").otherwise(""), F.lit("m"), F.col("user_id").cast("string"), F.lit(".mp4"))
    rows = seen.select("batch", path.alias("path"), "size", F.lit(1).cast("long").alias("mtime_ns"))
    process = ingest_streams.process_once(lambda files: files.select("path", "size"), ledger := _folder(spark))
    parts = [rows.where(F.col("batch") == k).drop("batch") for k in range(3)]
    _triggers(spark, parts, "path string, size bigint, mtime_ns bigint", lambda stream, _: stream.writeStream.foreachBatch(process))
    return ingest_streams.read_results(spark, ledger, "path string, size bigint")


@query(_sql("""SELECT match_id, round(greatest(0.0e0, a - 5), 3) AS start_sec, round(b + 3, 3) AS end_sec, event_count FROM (SELECT match_id, cluster, min(frame) / 30.0e0 AS a, max(frame) / 30.0e0 AS b, count(*) AS event_count FROM clu WHERE frame < 1000000000 GROUP BY match_id, cluster)""", *_TO_EV, _CLU))
def live_highlight_clips(spark, sf):
    """Events as a stream; a last event far ahead lets the watermark pass all sessions."""
    found = highlights.highlight_events(_ball(spark, sf), adjacent=False)
    rows = found.select("match_id", F.timestamp_micros(F.round(F.col("frame") * 1000000.0 / 30.0).cast("long")).alias("event_time"), "type")
    ahead = found.groupBy().agg(F.max("frame").alias("f")).select(F.lit(-1).cast("long").alias("match_id"), F.timestamp_micros((F.col("f") * 1000000 + 10**12).cast("long")).alias("event_time"), F.lit("end").alias("type"))
    path = _folder(spark)
    rows.coalesce(4).write.parquet(f"{path}/in")
    schema = "match_id bigint, event_time timestamp, type string"

    def go() -> None:
        out = live_clips(spark.readStream.schema(schema).parquet(f"{path}/in"))
        go.schema = out.schema
        out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()

    go()
    ahead.write.mode("append").parquet(f"{path}/in")
    go()
    out = spark.read.schema(go.schema).parquet(f"{path}/out").where("match_id >= 0")
    return out.select("match_id", _r("start_sec", 3), _r("end_sec", 3), "event_count")
