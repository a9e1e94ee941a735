"""Virtual camera path: filtered angles, smoothing, pan limits, field of view."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.config import Camera
from touchline.functions.geometry import angle_diff, pitch_of, wrap_deg_half_open, yaw_of
from touchline.operators.detections import FRAME, dealt

PATH = "match_id bigint, frame bigint, yaw double, pitch double, speed double, lost_count bigint"


def _wrap(a: float) -> float:
    turned = a % 360.0
    return turned - 360.0 if turned > 180.0 else turned


def _half_open(a: float) -> float:
    return (a + 180.0) % 360.0 - 180.0


def _limited(gap: float, most: float, factor: float, deadband: float) -> float:
    return max(-most, min(most, factor * (0.0 if abs(gap) < deadband else gap)))


def _follow(rows: pd.DataFrame, cfg: Camera, fps: float) -> Iterator[tuple]:
    """One fold over all frames: two constant-velocity filters that share their gains, then EMA, then pan limits."""
    frames, yaws, pitches = (rows[c].tolist() for c in ("frame", "yaw", "pitch"))
    seen = next((i for i, v in enumerate(yaws) if not np.isnan(v)), None)
    if seen is None:
        return
    q, r, dt = cfg.process_noise, cfg.measurement_noise, 1.0 / fps
    yaw, pitch, dyaw, dpitch = yaws[seen], pitches[seen], 0.0, 0.0
    p00, p01, p11 = 100.0, 0.0, 100.0
    lost_count, smooth, out = 0, None, None
    for frame, my, mp in zip(frames, yaws, pitches, strict=True):
        lost = np.isnan(my)
        a00, a01, a11 = p00 + 2 * dt * p01 + dt * dt * p11 + q * dt * dt, p01 + dt * p11 + q * dt, p11 + q
        yaw, pitch = yaw + dyaw * dt, pitch + dpitch * dt
        if lost:
            lost_count += 1
            p00, p01, p11 = a00, a01, a11
            if lost_count > cfg.coast:
                dyaw, dpitch = dyaw * 0.95, dpitch * 0.95
            if lost_count > cfg.drift:
                yaw += _wrap(cfg.center_yaw - _half_open(yaw)) * 0.02
                pitch += (cfg.center_pitch - pitch) * 0.02
        else:
            lost_count = 0
            k0, k1 = a00 / (a00 + r), a01 / (a00 + r)
            gy, gp = _wrap(my - _half_open(yaw)), mp - pitch
            yaw, pitch, dyaw, dpitch = yaw + k0 * gy, pitch + k0 * gp, dyaw + k1 * gy, dpitch + k1 * gp
            p00 = (1 - k0) * (1 - k0) * a00 + k0 * k0 * r
            p01 = (1 - k0) * (a01 - k1 * a00) + k0 * k1 * r
            p11 = a11 - 2 * k1 * a01 + k1 * k1 * a00 + k1 * k1 * r
        speed = float(np.sqrt(dyaw * dyaw + dpitch * dpitch))
        smooth = (yaw, pitch) if smooth is None else (smooth[0] + cfg.alpha * _wrap(yaw - smooth[0]), smooth[1] + cfg.alpha * (pitch - smooth[1]))
        if out is None:
            out = smooth
        else:
            # speed is in degrees a second, but is held against limits a frame
            most = (cfg.pan_fast if speed > 2 * cfg.pan_normal / fps else cfg.pan_normal) / fps
            factor = 0.3 if speed < cfg.velocity / fps and not lost else 1.0
            out = (out[0] + _limited(_wrap(smooth[0] - out[0]), most, factor, cfg.deadband), out[1] + _limited(smooth[1] - out[1], most, factor, cfg.deadband))
        yield frame, out[0], out[1], speed, lost_count


def camera_path(angles: DataFrame, cfg: Camera = Camera(), fps: float = 30.0) -> DataFrame:
    """match_id, frame, yaw, pitch, fov (to 1 place), lost_count from dense angles (null where there is no ball).

    A match is one fold, since every frame depends on all before. A match without any ball looks at the centre.
    """

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("frame")
        rows = list(_follow(g, cfg, fps)) or [(f, cfg.center_yaw, cfg.center_pitch, 0.0, i + 1) for i, f in enumerate(g["frame"])]
        return pd.DataFrame(rows, columns=["frame", "yaw", "pitch", "speed", "lost_count"]).assign(match_id=key[0])[["match_id", "frame", "yaw", "pitch", "speed", "lost_count"]]

    path = dealt(angles.select(*FRAME, "yaw", "pitch"), "match_id").groupBy("match_id").applyInPandas(run, PATH)
    moving = cfg.fov_min + (cfg.fov_max - cfg.fov_min) * F.least(F.col("speed") / 5.0, F.lit(1.0))
    lost = F.lit(cfg.fov_max) if cfg.widen else F.when(F.col("lost_count") > cfg.coast, F.lit(cfg.fov)).otherwise(moving)
    return path.select(
        *FRAME, wrap_deg_half_open("yaw").alias("yaw"), F.greatest(F.lit(-89.0), F.least(F.lit(89.0), F.col("pitch"))).alias("pitch"),
        F.bround(F.when(F.col("lost_count") > 0, lost).otherwise(moving), 1).alias("fov"), "lost_count",
    )


def ball_angles(tracks: DataFrame, width: float = 1920.0, height: float = 960.0) -> DataFrame:
    """Dense angles of tracks (match_id, frame, ball)."""
    return tracks.select(*FRAME, yaw_of(F.col("ball.x"), width).alias("yaw"), pitch_of(F.col("ball.y"), height).alias("pitch"))


def static_camera_path(matches: DataFrame, cfg: Camera = Camera()) -> DataFrame:
    """One constant row per frame of each match (match_id, total_frames)."""
    frames = matches.where("total_frames > 0").select("match_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total_frames") - 1)).alias("frame"))
    return frames.select(*FRAME, F.lit(cfg.center_yaw).alias("yaw"), F.lit(cfg.center_pitch).alias("pitch"), F.lit(cfg.fov).alias("fov"))


def unwrap_yaw(rows: DataFrame, yaw: str = "yaw") -> DataFrame:
    """rows with unwrapped: the running sum of shortest turns, starting at the first yaw of a match."""
    order = Window.partitionBy("match_id").orderBy("frame")
    before = F.lag(yaw).over(order)
    step = F.when(before.isNull(), F.col(yaw)).otherwise(angle_diff(F.col(yaw), before))
    return rows.withColumn("unwrapped", F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def lost_counts(rows: DataFrame, seen: str = "seen") -> DataFrame:
    """rows with lost_count: frames since the ball was last seen (since before the first frame if it never was)."""
    order = Window.partitionBy("match_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(seen), F.col("frame")), ignorenulls=True).over(order)
    return rows.withColumn("lost_count", F.col("frame") - F.coalesce(last, F.lit(-1)))
