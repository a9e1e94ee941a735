"""Frames that are worth labeling: low confidence, lost balls, jumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.config import HardFrames, Labeling
from touchline.operators.detections import FRAME
from touchline.operators.tracking import frame_spine

#: Order of the triggers of a frame.
REASONS = ("low_confidence", "lost_ball_gap", "position_jump")
TRIGGERS = ("low_conf", "lost_run", "jump_reject")


def _box(prefix: str = "") -> Column:
    return F.array(*(F.col(prefix + k) for k in ("x1", "y1", "x2", "y2")))


def first_per_frame(dets: DataFrame, where: Column) -> DataFrame:
    """The first detection (by det_id) of a frame that meets the condition."""
    rest = ["det_id", "confidence", "x1", "y1", "x2", "y2"]
    return dets.where(where).groupBy(*FRAME).agg(F.min(F.struct(*rest)).alias("d")).select(*FRAME, "d.*")


def low_confidence_frames(dets: DataFrame, cfg: HardFrames = HardFrames()) -> DataFrame:
    """Below cfg.confidence."""
    return first_per_frame(dets, F.col("confidence") < cfg.confidence).select(*FRAME, F.col("confidence").alias("conf"), _box().alias("bbox"))


def confidence_band_frames(dets: DataFrame, cfg: Labeling = Labeling()) -> DataFrame:
    """Within [cfg.low, cfg.high]."""
    return first_per_frame(dets, F.col("confidence").between(cfg.low, cfg.high)).select(*FRAME, F.col("confidence").alias("conf"), _box().alias("bbox"))


def threshold_hard_frames(dets: DataFrame, threshold: float = 0.3) -> DataFrame:
    """match_id, frame with a detection below the threshold, or with none at all up to the last frame."""
    low = dets.where(F.col("confidence") < threshold).select(*FRAME)
    return low.unionByName(frames_without(dets)).distinct()


def frames_without(dets: DataFrame) -> DataFrame:
    return frame_spine(dets).join(dets.select(*FRAME).distinct().hint("merge"), FRAME, "left_anti")


def _runs(tracks: DataFrame, consecutive: bool) -> DataFrame:
    """Rows of null-ball runs with island; consecutive: a gap in frame numbers ends a run, else only a ball does."""
    order = Window.partitionBy("match_id").orderBy("frame")
    if consecutive:
        lost = tracks.where("ball IS NULL").select(*FRAME)
        return lost.withColumn("island", F.col("frame") - F.row_number().over(order))
    seen = F.count(F.when(F.col("ball").isNotNull(), 1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return tracks.select(*FRAME, "ball", seen.alias("island")).where("ball IS NULL").drop("ball")


def lost_run_triggers(tracks: DataFrame, cfg: Labeling = Labeling()) -> DataFrame:
    """match_id, frame, run_length: the frame where a run of frames without a ball reaches cfg.lost_run."""
    runs = _runs(tracks, consecutive=True)
    place = F.row_number().over(Window.partitionBy("match_id", "island").orderBy("frame"))
    return runs.withColumn("run_length", place.cast("long")).where(F.col("run_length") == cfg.lost_run).select(*FRAME, "run_length")


def lost_gap_frames(tracks: DataFrame, cfg: HardFrames = HardFrames()) -> DataFrame:
    """match_id, frame, gap_length: every frame of a run without a ball of at least cfg.gap frames."""
    runs = _runs(tracks, consecutive=False)
    length = runs.groupBy("match_id", "island").agg(F.count("*").alias("gap_length")).where(F.col("gap_length") >= cfg.gap)
    return runs.join(length.hint("merge"), ["match_id", "island"]).select(*FRAME, "gap_length")


def position_jumps(tracks: DataFrame, cfg: HardFrames = HardFrames()) -> DataFrame:
    """match_id, frame, distance_px (to 1 place): more than cfg.jump between neighbouring rows that both have a ball."""
    order = Window.partitionBy("match_id").orderBy("frame")
    dx, dy = (F.col(f"ball.{k}") - F.lag(f"ball.{k}").over(order) for k in ("x", "y"))
    moved = tracks.select(*FRAME, F.sqrt(dx * dx + dy * dy).alias("distance_px"))
    return moved.where(F.col("distance_px") > cfg.jump).withColumn("distance_px", F.bround("distance_px", 1))


def merge_triggers(kinds: dict[str, DataFrame], columns: dict[str, str]) -> DataFrame:
    """match_id, frame, triggers (in the order of kinds) and the columns (name: type) that any of them gave."""
    parts = []
    for i, (name, df) in enumerate(kinds.items()):
        given = [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()]
        parts.append(df.select(*FRAME, F.struct(F.lit(i).alias("i"), F.lit(name).alias("name")).alias("t"), *given))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("t.i"))).alias(c)
    merged = union.groupBy(*FRAME).agg(F.array_sort(F.collect_set("t")).alias("t"), *map(first, columns))
    return merged.select(*FRAME, F.transform("t", lambda t: t["name"]).alias("triggers"), *columns)


def hard_frames(dets: DataFrame, tracks: DataFrame, cfg: HardFrames = HardFrames(), fps: float = 30.0) -> DataFrame:
    """match_id, frame, time_sec, reasons, conf, bbox, gap_length, distance_px: low confidence, lost gaps and jumps by frame."""
    kinds = dict(zip(REASONS, (low_confidence_frames(dets, cfg), lost_gap_frames(tracks, cfg), position_jumps(tracks, cfg)), strict=True))
    merged = merge_triggers(kinds, {"conf": "double", "bbox": "array<double>", "gap_length": "bigint", "distance_px": "double"})
    return merged.withColumn("time_sec", F.bround(F.col("frame") / fps, 3)).withColumnRenamed("triggers", "reasons")


def labeling_candidates(dets: DataFrame, tracks: DataFrame, events: DataFrame, cfg: Labeling = Labeling(), fps: float = 30.0) -> DataFrame:
    """match_id, frame, time_sec, triggers, conf, bbox, run_length, distance_px: confidence band, lost runs, rejected jumps."""
    jumps = events.where(F.col("distance_px") >= cfg.jump).groupBy(*FRAME).agg(F.max("distance_px").alias("distance_px"))
    kinds = dict(zip(TRIGGERS, (confidence_band_frames(dets, cfg), lost_run_triggers(tracks, cfg), jumps), strict=True))
    merged = merge_triggers(kinds, {"conf": "double", "bbox": "array<double>", "run_length": "bigint", "distance_px": "double"})
    return merged.withColumn("time_sec", F.bround(F.col("frame") / fps, 3))
