"""Render plans: which camera looks at which frame, in which segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.config import Camera, Render
from touchline.functions.geometry import with_vertical_fov
from touchline.operators.camera import static_camera_path
from touchline.operators.detections import FRAME


def render_segments(matches: DataFrame, cfg: Render = Render()) -> DataFrame:
    """match_id, segment, start, stop (exclusive), warm_start: total_frames in at most parts pieces, the first ones larger by one.

    Every piece but the first begins int(overlap_sec * fps) frames early. Matches without frames have none.
    """
    m = matches.where("total_frames > 0").withColumn("k", F.least(F.lit(cfg.parts).cast("long"), "total_frames"))
    rows = m.select("match_id", "total_frames", "fps", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("segment"))
    base, larger = F.floor(F.col("total_frames") / F.col("k")), F.pmod("total_frames", "k")
    start = F.col("segment") * base + F.least("segment", larger)
    size = base + (F.col("segment") < larger).cast("long")
    early = F.when(F.col("segment") > 0, F.floor(F.col("fps") * cfg.overlap_sec)).otherwise(0)
    return rows.select("match_id", "segment", start.alias("start"), (start + size).alias("stop"), F.greatest(F.lit(0).cast("long"), start - early).alias("warm_start"))


def render_plan(path: DataFrame, segments: DataFrame, cfg: Render = Render()) -> DataFrame:
    """match_id, segment, frame, warm_up, yaw, pitch, fov, vfov: warm-up frames look where the segment's first frame looks.

    Segments are few a match; frames join them by equality on exploded frames.
    """
    frames = segments.select("match_id", "segment", "start", F.explode(F.sequence(F.col("warm_start"), F.col("stop") - 1)).alias("frame"))
    frames = frames.withColumn("warm_up", F.col("frame") < F.col("start")).withColumn("look", F.greatest("frame", "start"))
    camera = path.select("match_id", F.col("frame").alias("look"), "yaw", "pitch", "fov")
    joined = frames.join(camera.hint("merge"), ["match_id", "look"])
    return with_vertical_fov(joined, cfg.width, cfg.height).select("match_id", "segment", "frame", "warm_up", "yaw", "pitch", "fov", "vfov")


def tactical_plan(matches: DataFrame, cfg: Render = Render()) -> DataFrame:
    camera = Camera(center_yaw=cfg.tactical_yaw, center_pitch=cfg.tactical_pitch, fov=cfg.tactical_fov)
    return render_plan(static_camera_path(matches, camera), render_segments(matches, cfg), cfg)


def ntile_segments(frames: DataFrame, cfg: Render = Render()) -> DataFrame:
    """match_id, segment, start, stop of the frames that a table has, by ntile: the same sizes as render_segments."""
    n = F.ntile(cfg.parts).over(Window.partitionBy("match_id").orderBy("frame"))
    return frames.select(*FRAME, (n - 1).cast("long").alias("segment")).groupBy("match_id", "segment").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("stop"))
