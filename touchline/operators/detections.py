"""Detection tables: gates, field of interest, best per frame, interpolation, overlaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.config import Detection, FieldOfInterest
from touchline.functions.geometry import iou, pitch_of, with_bbox_geometry, wrap_deg, yaw_of

FRAME = ["match_id", "frame"]
#: Tasks of a fold by core, at least: groups are unlike in length.
TASKS_PER_CORE = 3


def dealt(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """rows with each group of keys in one task, for a fold by group in Python.

    A group's rows are few bytes but long work. The number of tasks is given, so adaptive execution doesn't merge them by bytes
    as it merges other shuffles: at least TASKS_PER_CORE by core, and spark.sql.shuffle.partitions where that is more.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, *keys)


def detection_gate(dets: DataFrame, cfg: Detection = Detection()) -> DataFrame:
    """Rows of the class with confidence enough, at most max_per_frame of a frame (best first, then det_id)."""
    kept = dets.where((F.col("class_id") == cfg.class_id) & (F.col("confidence") >= cfg.min_confidence))
    order = Window.partitionBy(*FRAME).orderBy(F.desc("confidence"), "det_id")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.max_per_frame).drop("rank")


def y_band_filter(dets: DataFrame, cfg: Detection = Detection()) -> DataFrame:
    """Boxes whose centre lies in the band of height, both ends included; a height of 0 or less counts as fraction 0."""
    share = (F.col("y1") + F.col("y2")) / 2 / cfg.height if cfg.height > 0 else F.lit(0.0)
    return dets.where(share.between(cfg.min_y, cfg.max_y))


def sample_frames(dets: DataFrame, every_n: int) -> DataFrame:
    return dets.where(F.pmod("frame", F.lit(every_n)) == 0) if every_n > 1 else dets


def best_per_frame(dets: DataFrame) -> DataFrame:
    """The surest detection of a frame, the least det_id among equals; an aggregate that combines before the shuffle."""
    rest = [c for c in dets.columns if c not in FRAME]
    best = F.max_by(F.struct(*rest), F.struct(F.col("confidence"), -F.col("det_id")))
    return dets.groupBy(*FRAME).agg(best.alias("b")).select(*FRAME, "b.*")


def group_by_frame(dets: DataFrame) -> DataFrame:
    """match_id, frame, detections in order of det_id."""
    fields = ["det_id", "x1", "y1", "x2", "y2", "confidence", "class_id"]
    return dets.groupBy(*FRAME).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("detections"))


def untile_detections(tiles: DataFrame, cfg: Detection = Detection()) -> DataFrame:
    """Boxes of a 2 x 2 tiling (tile_r, tile_c) in the whole picture's pixels; tiles overlap inwards."""
    w, h = int(cfg.width) // 2, int(cfg.height) // 2
    dx = F.when(F.col("tile_c") > 0, float(w - int(w * cfg.tile_overlap))).otherwise(0.0)
    dy = F.when(F.col("tile_r") > 0, float(h - int(h * cfg.tile_overlap))).otherwise(0.0)
    return tiles.withColumns({"x1": F.col("x1") + dx, "x2": F.col("x2") + dx, "y1": F.col("y1") + dy, "y2": F.col("y2") + dy}).drop("tile_r", "tile_c")


def _angles(dets: DataFrame, cfg: Detection) -> DataFrame:
    c = F.col
    return dets.withColumns({"yaw": yaw_of((c("x1") + c("x2")) / 2, cfg.width), "pitch": pitch_of((c("y1") + c("y2")) / 2, cfg.height)})


def foi_auto_center(dets: DataFrame, cfg: Detection = Detection(), foi: FieldOfInterest = FieldOfInterest()) -> DataFrame:
    """match_id, center, sample_count, fallback: circular mean of the yaws around the fullest of 72 bins of 5 degrees.

    Samples are sure detections of the first frames in the pitch range. The least bin wins a tie; a match without
    samples falls back to the configured centre. Only bins are shuffled: they carry their counts and sums.
    """
    early = _angles(dets, cfg).where((F.col("frame") < int(cfg.fps * foi.sample_sec)) & (F.col("confidence") >= foi.min_confidence) & F.col("pitch").between(foi.pitch_min, foi.pitch_max))
    bins = (
        early.withColumn("bin", F.least(F.floor((F.col("yaw") + 180.0) / 5.0), F.lit(71)))
        .groupBy("match_id", "bin")
        .agg(F.count("*").alias("n"), F.sum(F.sin(F.radians("yaw"))).alias("s"), F.sum(F.cos(F.radians("yaw"))).alias("c"))
    )
    peaks = bins.groupBy("match_id").agg(F.max(F.struct("n", (-F.col("bin")).alias("b"))).alias("p"), F.sum("n").alias("sample_count"))
    near = bins.join(peaks.select("match_id", (-F.col("p.b")).alias("peak")).hint("merge"), "match_id").where(F.pmod(F.col("bin") - F.col("peak") + 1, F.lit(72)) <= 2)
    center = near.groupBy("match_id").agg(F.degrees(F.atan2(F.sum("s"), F.sum("c"))).alias("center"))
    found = center.join(peaks.select("match_id", "sample_count").hint("merge"), "match_id")
    return (
        dets.select("match_id").distinct().join(found.hint("merge"), "match_id", "left")
        .select("match_id", F.coalesce("center", F.lit(foi.center)).alias("center"), F.coalesce("sample_count", F.lit(0)).alias("sample_count"), F.col("center").isNull().alias("fallback"))
    )


def foi_filter(dets: DataFrame, centers: DataFrame | None = None, cfg: Detection = Detection(), foi: FieldOfInterest = FieldOfInterest()) -> DataFrame:
    """Detections within the window around the centre (of their match, or the configured one) and the pitch range, ends included."""
    rows = _angles(dets, cfg)
    rows = rows.withColumn("center", F.lit(foi.center)) if centers is None else rows.join(centers.select("match_id", "center").hint("merge"), "match_id")
    inside = (F.abs(wrap_deg(F.col("yaw") - F.col("center"))) <= foi.window / 2) & F.col("pitch").between(foi.pitch_min, foi.pitch_max)
    return rows.where(inside).drop("center")


def foi_meta(dets: DataFrame, centers: DataFrame, cfg: Detection = Detection(), foi: FieldOfInterest = FieldOfInterest()) -> DataFrame:
    """match_id, center, fallback, sample_count, total, kept, filtered_pct."""
    kept = foi_filter(dets, centers, cfg, foi).groupBy("match_id").agg(F.count("*").alias("kept"))
    total = dets.groupBy("match_id").agg(F.count("*").alias("total"))
    out = centers.join(total.hint("merge"), "match_id").join(kept.hint("merge"), "match_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return out.withColumn("filtered_pct", F.lit(100.0) * (F.col("total") - F.col("kept")) / F.col("total"))


def interpolate_skipped(dets: DataFrame, every_n: int) -> DataFrame:
    """Rows and, between neighbouring frames at a gap of 2 to every_n, linearly placed boxes of class 0 at 0.8 of the confidence."""
    best = best_per_frame(dets)
    order = Window.partitionBy("match_id").orderBy("frame")
    cols = ["x1", "y1", "x2", "y2", "confidence"]
    ahead = best.withColumns({"next": F.lead("frame").over(order)} | {f"n_{c}": F.lead(c).over(order) for c in cols})
    gap = F.col("next") - F.col("frame")
    filled = ahead.where((gap > 1) & (gap <= every_n)).withColumn("at", F.explode(F.sequence(F.col("frame") + 1, F.col("next") - 1)))
    t = (F.col("at") - F.col("frame")) / gap
    between = lambda c: F.col(c) + (F.col(f"n_{c}") - F.col(c)) * t
    made = filled.select(
        "match_id", F.col("at").alias("frame"), F.lit(None).cast("long").alias("det_id"), *(between(c).alias(c) for c in cols[:4]),
        (F.least("confidence", "n_confidence") * 0.8).alias("confidence"), F.lit(0).alias("class_id"), F.lit(True).alias("interpolated"),
    )
    own = dets.select("match_id", "frame", "det_id", *cols, "class_id", F.lit(False).alias("interpolated"))
    return own.unionByName(made)


def pairwise_iou(dets: DataFrame) -> DataFrame:
    """match_id, frame, a, b (det_id, a < b), iou for boxes of one frame."""
    own = dets.select(*FRAME, *(F.col(c).alias(f"{c}_a") for c in ("det_id", "x1", "y1", "x2", "y2")))
    other = dets.select(*FRAME, *(F.col(c).alias(f"{c}_b") for c in ("det_id", "x1", "y1", "x2", "y2")))
    pairs = own.join(other.hint("merge"), FRAME).where("det_id_a < det_id_b")
    box = lambda s: {k: F.col(f"{k}_{s}") for k in ("x1", "y1", "x2", "y2")}
    return pairs.select(*FRAME, F.col("det_id_a").alias("a"), F.col("det_id_b").alias("b"), iou(box("a"), box("b")).alias("iou"))


def kept_boxes(rows: pd.DataFrame, max_iou: float) -> pd.DataFrame:
    """nms() of the rows of some frames of a match, in all frames at once."""
    rows = rows[rows["frame"].notna()].sort_values(["frame", "confidence", "det_id"], ascending=[True, False, True])
    frame, box = rows["frame"].to_numpy(), rows[["x1", "y1", "x2", "y2"]].to_numpy()
    size = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
    stays, left = np.zeros(len(rows), bool), np.arange(len(rows))
    while len(left):
        # the first box left of each frame stays, and the boxes it suppresses leave, in all frames at once
        first = np.concatenate(([True], frame[left][1:] != frame[left][:-1]))
        head = left[first][first.cumsum() - 1]
        stays[left[first]] = True
        w = (np.minimum(box[head, 2], box[left, 2]) - np.maximum(box[head, 0], box[left, 0])).clip(min=0)
        h = (np.minimum(box[head, 3], box[left, 3]) - np.maximum(box[head, 1], box[left, 1])).clip(min=0)
        left = left[~first & ~(w * h / (size[head] + size[left] - w * h + 1e-6) > max_iou)]
    return rows[stays]


def nms(dets: DataFrame, max_iou: float = Detection.nms_iou) -> DataFrame:
    """Greedy suppression in each frame: by falling confidence (then det_id) a box stays unless it overlaps a kept one by more."""
    # frames are independent, so a long match is dealt out by blocks of frames
    blocks = dets.withColumn("__block", F.floor(F.col("frame") / 1024))
    return dealt(blocks, "match_id", "__block").groupBy("match_id", "__block").applyInPandas(lambda block: kept_boxes(block, max_iou), blocks.schema).drop("__block")


def centers_of(dets: DataFrame) -> DataFrame:
    """match_id, frame, x, y, confidence, det_id: centre of each box."""
    return with_bbox_geometry(dets).select(*FRAME, F.col("cx").alias("x"), F.col("cy").alias("y"), "confidence", "det_id")
