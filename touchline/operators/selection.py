"""Selection for labeling, manifests, training sets and labeling tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.config import HardFrames, Labeling
from touchline.functions.naming import frame_file
from touchline.operators.detections import FRAME


def is_picked(rank: Column, n: Column, k: Column) -> Column:
    """Whether row `rank` (from 0) of n is one of k evenly spaced ones, at ((2 i + 1) n) div 2 k; k <= 0: none, k >= n: all.

    Row r is hit by i = ceil((2 k r - n) / 2 n) where that index leads back to r.
    """
    i = F.greatest(F.ceil((2 * k * rank - n) / (2 * n)), F.lit(0).cast("long"))
    place = F.floor(((2 * i + 1) * n) / (2 * k))
    return F.when(k <= 0, False).when(k >= n, True).otherwise((place == rank) & (i < k))


def evenly_sample(rows: DataFrame, k: int | str, by: str = "match_id", order: str = "frame") -> DataFrame:
    """At most k rows of each group, evenly spaced in order; k may name a column."""
    w = Window.partitionBy(by).orderBy(order)
    n = rows.groupBy(by).agg(F.count("*").alias("__n"))
    ranked = rows.withColumn("__r", F.row_number().over(w).cast("long") - 1).join(n.hint("merge"), by)
    return ranked.where(is_picked(F.col("__r"), F.col("__n"), F.col(k) if isinstance(k, str) else F.lit(k))).drop("__r", "__n")


def select_for_labeling(candidates: DataFrame, cfg: Labeling = Labeling()) -> DataFrame:
    """Rare candidates (any trigger but low_conf) first, up to the cap; the rest is filled from low_conf frames divisible by every_n."""
    cap = max(cfg.cap, 0)
    rare = F.exists("triggers", lambda t: t != "low_conf")
    rows = candidates.withColumn("__rare", rare)
    if cfg.every_n > 1:
        rows = rows.where(F.col("__rare") | (F.pmod("frame", F.lit(cfg.every_n)) == 0))
    n_rare = rows.groupBy("match_id").agg(F.count_if("__rare").alias("__n_rare"))
    rows = rows.join(n_rare.hint("merge"), "match_id")
    few = evenly_sample(rows.where("__rare"), cap)
    room = rows.where("NOT __rare").withColumn("__k", F.greatest(F.lit(cap) - F.col("__n_rare"), F.lit(0)))
    return few.unionByName(evenly_sample(room, "__k").drop("__k")).drop("__rare", "__n_rare")


def sample_hard_frames(frames: DataFrame, cfg: HardFrames = HardFrames(), seed: int = 42) -> DataFrame:
    """At most cfg.cap frames of each match, by the digest of match, frame and seed."""
    key = F.md5(F.concat_ws("|", F.col("match_id").cast("string"), F.col("frame").cast("string"), F.lit(str(seed))))
    w = Window.partitionBy("match_id").orderBy(key, "frame")
    return frames.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cfg.cap).drop("__r")


def manifest(selected: DataFrame, candidates: DataFrame) -> DataFrame:
    """match_id, identified, exported, document: the selected frames of a match as one JSON document, with image names."""
    fields = [c for c in selected.columns if c not in FRAME]
    rows = selected.groupBy("match_id").agg(F.count("*").alias("exported"), F.sort_array(F.collect_list(F.struct("frame", frame_file(F.col("frame")).alias("image"), *fields))).alias("frames"))
    seen = candidates.groupBy("match_id").agg(F.count("*").alias("identified"))
    both = seen.join(rows.hint("merge"), "match_id", "left").withColumn("exported", F.coalesce("exported", F.lit(0)))
    return both.select("match_id", "identified", "exported", F.to_json(F.struct("match_id", "identified", "exported", "frames")).alias("document"))


def manifest_frames(manifests: DataFrame) -> DataFrame:
    """match_id, frame, predicted_bbox: the frames of nested manifests (match_id, frames), the last entry of a frame that repeats.

    A null or empty list of frames has none; an entry without frame_index is left out.
    """
    rows = manifests.select("match_id", F.posexplode("frames").alias("at", "f")).where("f.frame_index IS NOT NULL")
    last = rows.groupBy("match_id", F.col("f.frame_index").alias("frame")).agg(F.max_by(F.struct("f.predicted_bbox"), "at").alias("m"))
    return last.select("match_id", "frame", "m.predicted_bbox")


def exported_frames(images: DataFrame) -> DataFrame:
    """images (match_id, image: a file name) with frame, the number in a name like frame_000012.jpg; other files are left out."""
    number = F.regexp_extract("image", r"^frame_(\d+)(?:_.*)?\.jpg$", 1)
    return images.withColumn("frame", F.when(number != "", number).cast("long")).where("frame IS NOT NULL")


def import_tasks(images: DataFrame, manifests: DataFrame, root: str = "/data/labeling", width: float = 1920.0, height: float = 960.0) -> DataFrame:
    """match_id, frame, image, task: one JSON task for each exported frame of a listing (match_id, image).

    Every frame has a task, whether or not the match's manifest (match_id, frames) knows it; where that has a predicted box,
    the box is the task's prediction, in percent of the picture. Frames of a manifest that weren't exported have no task.
    """
    rows = exported_frames(images).join(manifest_frames(manifests).hint("merge"), ["match_id", "frame"], "left")
    box, pct = F.col("predicted_bbox"), lambda v, whole: F.round(v / whole * 100.0, 2)
    value = F.struct(
        pct(box[0], width).alias("x"), pct(box[1], height).alias("y"), pct(box[2] - box[0], width).alias("width"), pct(box[3] - box[1], height).alias("height"),
        F.array(F.lit("ball")).alias("rectanglelabels"),
    )
    result = F.struct(F.lit("label").alias("from_name"), F.lit("image").alias("to_name"), F.lit("rectanglelabels").alias("type"), value.alias("value"))
    predictions = F.when(box.isNotNull(), F.array(F.struct(F.lit("ball_detector").alias("model_version"), F.array(result).alias("result"))))
    name = F.col("match_id").cast("string")
    data = F.struct(F.concat_ws("/", F.lit(root), name, F.lit("frames"), "image").alias("image"), F.col("frame").alias("frame_index"), name.alias("match_name"))
    return rows.select("match_id", "frame", "image", F.to_json(F.struct(data.alias("data"), predictions.alias("predictions"))).alias("task"))


def labeled_pairs(frames: DataFrame, labels: DataFrame) -> DataFrame:
    """Frames (match_id, stem, ...) that have a label file, each once."""
    return frames.join(labels.select("match_id", "stem").distinct().hint("merge"), ["match_id", "stem"])


def pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("match_id").agg(F.count("*").alias("pairs"))


def build_dataset(pairs: DataFrame, val_ratio: float = 0.2, seed: int = 42, buckets: int = 1024) -> DataFrame:
    """match_id, stem, split, file: the max(1, int(n (1 - val_ratio))) pairs with the least digest are for training.

    Ranks are counted by bucket of the digest and within it, so no task orders all pairs.
    """
    digest = F.md5(F.concat_ws("|", F.col("match_id").cast("string"), "stem", F.lit(str(seed))))
    rows = pairs.select("match_id", "stem", digest.alias("d")).withColumn("b", F.pmod(F.conv(F.substring("d", 1, 4), 16, 10).cast("int"), F.lit(1 << 16)) * buckets / 65536).withColumn("b", F.floor("b"))
    sizes = rows.groupBy("b").agg(F.count("*").alias("n"))
    # at most `buckets` rows
    before = sizes.select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rank = F.row_number().over(Window.partitionBy("b").orderBy("d", "match_id", "stem")) + F.col("before")
    train = F.greatest(F.lit(1), F.floor(F.col("total") * (1 - val_ratio)))
    ranked = rows.join(before.hint("merge"), "b").select("match_id", "stem", F.when(rank <= train, "train").otherwise("val").alias("split"))
    return ranked.withColumn("file", F.concat(F.col("match_id").cast("string"), F.lit("_"), "stem"))


def label_tasks(frames: DataFrame, width: float = 1920.0, height: float = 960.0) -> DataFrame:
    """match_id, frame, image, x, y, w, h (percent of the picture, 2 places; null without a box), task (JSON).

    frames has bbox or predicted_bbox.
    """
    boxes = [c for c in ("predicted_bbox", "bbox") if c in frames.columns]
    box = F.coalesce(*map(F.col, boxes))
    pct = lambda v, whole: F.round(v / whole * 100.0, 2)
    rows = frames.select(
        *FRAME, frame_file(F.col("frame")).alias("image"), pct(box[0], width).alias("x"), pct(box[1], height).alias("y"),
        pct(box[2] - box[0], width).alias("w"), pct(box[3] - box[1], height).alias("h"),
    )
    value = F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height"), F.array(F.lit("ball")).alias("rectanglelabels"))
    results = F.when(F.col("x").isNotNull(), F.array(F.struct(F.lit("rectanglelabels").alias("type"), value.alias("value"))))
    return rows.withColumn("task", F.to_json(F.struct(F.struct("image", "match_id", "frame").alias("data"), results.alias("predictions"))))
