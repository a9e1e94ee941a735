"""Detections, file snapshots and frames derived from the driver's tables, so that queries read what grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs unchanged in Spark and DuckDB: one match per 15 users, two candidates a frame, gaps, jumps and strays. Every eleventh
#: detection is moved to the begin of its 30 frames, so some frames lack one and others hold five boxes or more.
DETECTIONS_SQL = """
SELECT match_id, frame, det_id,
       CAST(cx - half AS DOUBLE) AS x1, CAST(cy - half AS DOUBLE) AS y1,
       CAST(cx + half AS DOUBLE) AS x2, CAST(cy + half AS DOUBLE) AS y2,
       confidence, CASE WHEN det_id % 17 = 0 THEN 0 ELSE 32 END AS class_id
FROM (SELECT match_id, det_id, frame, 3 + det_id % 6 AS half,
         (abs((frame * 13 + match_id * 37) % 3600 - 1800) + 40 + 240 * cand
           + CASE WHEN det_id % 53 = 0 THEN 400 WHEN det_id % 29 = 0 THEN 110 ELSE det_id % 5 END) % 1900 + 10 AS cx,
         340 + abs((frame * 5) % 500 - 250) + det_id % 3
           - CASE WHEN det_id % 31 = 0 THEN 330 ELSE 0 END AS cy,
         greatest(5, 15 + (det_id * 37) % 80 - 50 * cand) / 100.0e0 AS confidence
  FROM (SELECT match_id, det_id, cand, CASE WHEN det_id % 11 = 0 THEN place - place % 30 ELSE place END AS frame
   FROM (SELECT match_id, event_id AS det_id, rn % 2 AS cand,
           CAST(floor(rn / 2) + 20 * floor(rn / 60) + 180 * floor(rn / 300) AS BIGINT) AS place
    FROM (SELECT event_id, CAST(floor(user_id / 15) AS BIGINT) AS match_id,
             row_number() OVER (PARTITION BY CAST(floor(user_id / 15) AS BIGINT) ORDER BY ts, event_id) - 1 AS rn
      FROM {events}) e) m) s) p
"""
SNAPSHOTS_SQL = """
SELECT CAST(user_id AS VARCHAR(20)) AS path, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS poll_no,
       CAST(floor(value / 50) AS BIGINT) AS size FROM {events}
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(DETECTIONS_SQL, events=events(spark, sf_dir).select("event_id", "user_id", "ts"))
    return rows.withColumn("class_id", F.col("class_id").cast("int"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SNAPSHOTS_SQL, events=events(spark, sf_dir).select("event_id", "user_id", "ts", "value"))


def matches(dets: DataFrame, fps: float = 30.0) -> DataFrame:
    """match_id, fps, total_frames (last frame + 11), mode (each third match has no detector)."""
    total = dets.groupBy("match_id").agg((F.max("frame") + 11).alias("total_frames"))
    mode = F.when(F.pmod("match_id", F.lit(3)) == 2, "no_detect").otherwise("normal")
    return total.select("match_id", F.lit(fps).alias("fps"), "total_frames", mode.alias("mode"))
