"""Readers: one directory per match (match_id=...), every file of all matches in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.sources.schemas import CAMERA_ITEM, DETECTION_LINE, MANIFEST, PROBE, TRACK_LINE, struct


def to_v1_schema(lines: DataFrame, fps: float = 30.0) -> DataFrame:
    """Canonical detection rows from lines in either spelling; det_id is kept, else made from the order of input."""
    c, box = F.col, F.coalesce("bbox_xyxy", "bbox")
    order = c("det_id") if "det_id" in lines.columns else F.monotonically_increasing_id()
    frame = F.coalesce("frame_index", "frame")
    return lines.select(
        *(["match_id"] if "match_id" in lines.columns else []), frame.alias("frame"), order.alias("det_id"),
        *(box[i].alias(k) for i, k in enumerate(("x1", "y1", "x2", "y2"))),
        F.coalesce("conf", "confidence").alias("confidence"), F.coalesce("class_id", "class").alias("class_id"),
        F.coalesce("interpolated", F.lit(False)).alias("interpolated"), (F.bround(frame / fps, 4) if fps > 0 else F.lit(0.0)).alias("time_sec"),
    )


def read_detections(spark: SparkSession, root: str, fps: float = 30.0) -> DataFrame:
    """root/match_id=*/detections.jsonl; blank lines are skipped, a broken line fails the job."""
    schema = struct(DETECTION_LINE + ", match_id string")
    return to_v1_schema(spark.read.schema(schema).option("mode", "FAILFAST").option("basePath", root).option("pathGlobFilter", "*.jsonl").json(root), fps)


def read_tracks(spark: SparkSession, root: str) -> DataFrame:
    """root/match_id=*/tracks.json, each an array of rows."""
    schema = struct(TRACK_LINE + ", match_id string")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("basePath", root).option("pathGlobFilter", "tracks.json").json(root)


def read_camera_path(spark: SparkSession, root: str) -> DataFrame:
    """root/match_id=*/camera_path.json: the frame is the place in the array."""
    whole = spark.read.option("wholetext", True).option("basePath", root).option("pathGlobFilter", "camera_path.json").text(root)
    return whole.select("match_id", F.posexplode(F.from_json("value", CAMERA_ITEM)).alias("frame", "p")).select("match_id", F.col("frame").cast("long").alias("frame"), "p.yaw", "p.pitch", "p.fov")


def camera_frames(documents: DataFrame, value: str = "value") -> DataFrame:
    """match_id, frame, yaw, pitch, fov of one JSON array per row."""
    return documents.select("match_id", F.posexplode(F.from_json(value, CAMERA_ITEM)).alias("frame", "p")).select("match_id", F.col("frame").cast("long").alias("frame"), "p.yaw", "p.pitch", "p.fov")


def matches_of_probes(probes: DataFrame, value: str = "value") -> DataFrame:
    """Match rows from probe documents: the frame rate is a fraction, total_frames is rounded half to even."""
    p = F.from_json(F.col(value), PROBE)
    video = F.element_at(F.filter(p["streams"], lambda s: s["codec_type"] == "video"), 1)
    rate = F.split(video["r_frame_rate"], "/")
    fps = rate[0].cast("double") / F.coalesce(F.try_element_at(rate, F.lit(2)).cast("double"), F.lit(1.0))
    out = probes.select("match_id", video.alias("v"), fps.alias("fps"), F.coalesce(p["format"]["duration"].cast("double"), video["duration"].cast("double"), F.lit(0.0)).alias("duration"))
    return out.select("match_id", "v.width", "v.height", "fps", "duration", F.bround(F.col("fps") * F.col("duration"), 0).cast("long").alias("total_frames"), F.col("v.codec_name").alias("codec"))


def read_matches(spark: SparkSession, root: str) -> DataFrame:
    """root/match_id=*/ffprobe_meta.json."""
    return matches_of_probes(spark.read.option("wholetext", True).option("basePath", root).option("pathGlobFilter", "ffprobe_meta.json").text(root))


def yolo_rows(lines: DataFrame, value: str = "value", path: str = "path") -> DataFrame:
    """class_id, cx, cy, w, h (unit square) and stem of each line of a label file; other lines are left out."""
    p = F.split(F.trim(F.col(value)), r"\s+")
    name = F.regexp_extract(F.col(path), r"([^/]+?)(\.[^./]*)?$", 1)
    kept = [c for c in lines.columns if c not in (value, path)]
    return lines.where(F.size(p) == 5).select(*kept, name.alias("stem"), p[0].cast("int").alias("class_id"), *(p[i + 1].cast("double").alias(k) for i, k in enumerate(("cx", "cy", "w", "h"))))


def read_yolo_labels(spark: SparkSession, root: str) -> DataFrame:
    """root/match_id=*/*.txt."""
    lines = spark.read.option("basePath", root).option("pathGlobFilter", "*.txt").text(root)
    return yolo_rows(lines.withColumn("path", F.col("_metadata.file_path")))


def read_arrays(spark: SparkSession, root: str, item: str, key_type: str = "string") -> DataFrame:
    """match_id and the fields of item (DDL) of the arrays that writers.write_arrays() wrote, a row an element; a broken line fails the job."""
    lines = spark.read.schema(f"value string, match_id {key_type}, block string").option("basePath", root).text(root)
    element = F.regexp_replace(F.regexp_replace("value", r"^\[", ""), r"[,\]]$", "")
    return lines.select("match_id", F.from_json(element, item, {"mode": "FAILFAST"}).alias("e")).select("match_id", "e.*")


def read_manifests(spark: SparkSession, root: str, match_type: str = "string", files: str = "hard_frames.json") -> DataFrame:
    """match_id, match_name, frames of root/match_id=*/hard_frames.json, each one nested document; a broken one fails the job."""
    schema = struct(f"{MANIFEST}, match_id {match_type}")
    files = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("basePath", root).option("pathGlobFilter", files)
    return files.json(root).select("match_id", "match_name", "frames")


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """match_id (as text), image (file name) of root/match_id=*/frames/*.jpg; the pictures are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jpg").load(root)
    place = r"/match_id=([^/]+)/frames/([^/]+)$"
    parts = F.regexp_extract("path", place, 1), F.regexp_extract("path", place, 2)
    return files.select(parts[0].alias("match_id"), parts[1].alias("image")).where("match_id <> ''")


def list_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, size, mtime of files; their contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
