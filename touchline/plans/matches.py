"""All matches end to end in one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.config import Camera, Detection, Highlights, Labeling, Stabilizer
from touchline.operators.camera import ball_angles, camera_path, static_camera_path
from touchline.operators.detections import best_per_frame, y_band_filter
from touchline.operators.hardframes import labeling_candidates
from touchline.operators.highlights import highlight_clips
from touchline.operators.selection import select_for_labeling
from touchline.operators.tracking import stabilize_ball, stabilize_rows, stabilizer_events
from touchline.sources.writers import artifact_plan, overwrite_matches, run_summary, write_runs


def run_matches(
    dets: DataFrame, matches: DataFrame, detection: Detection = Detection(), stabilizer: Stabilizer = Stabilizer(),
    camera: Camera = Camera(), highlights: Highlights = Highlights(), labeling: Labeling = Labeling(),
    hand_over: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> dict[str, DataFrame]:
    """Tables by name: tracks, events, camera_path, clips, labeling. matches: match_id, fps, total_frames, mode.

    Matches of mode no_detect get a constant camera path and no tracks, clips or frames. A match without detections in
    normal mode has lost tracks only. hand_over writes a table and reads it back, so that its fold runs once for all
    tables; without it each table runs its own.
    """
    normal, still = matches.where("mode = 'normal'"), matches.where("mode = 'no_detect'")
    rows = dets.join(normal.select("match_id").hint("merge"), "match_id", "left_semi")
    best = best_per_frame(y_band_filter(rows, detection))
    totals = normal.select("match_id", "total_frames")
    stable = hand_over(stabilize_rows(best, stabilizer, detection.fps))
    tracks = hand_over(stabilize_ball(best, stabilizer, detection.fps, totals=totals, stable=stable))
    events = stabilizer_events(stable)
    path = camera_path(ball_angles(tracks, detection.width, detection.height), camera, detection.fps)
    ball = tracks.select("match_id", "frame", "ball.x", "ball.y")
    return {
        "tracks": tracks,
        "events": events,
        "camera_path": path.drop("lost_count").unionByName(static_camera_path(still, camera)),
        "clips": highlight_clips(ball, highlights, detection.width, detection.height, detection.fps),
        "labeling": select_for_labeling(labeling_candidates(best, tracks, events, labeling, detection.fps), labeling),
    }


def pending(matches: DataFrame, runs: str) -> DataFrame:
    """The matches that the runs table (a folder by match) doesn't hold."""
    spark = matches.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(runs)
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return matches
    done = spark.read.schema(f"match_id {matches.schema['match_id'].dataType.simpleString()}").parquet(runs)
    return matches.join(done.distinct().hint("merge"), "match_id", "left_anti")


def save_tables(build: Callable[[DataFrame], dict[str, DataFrame]], matches: DataFrame, root: str, hand_over: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """root/<table>/match_id=... of the matches that are not complete yet, then root/runs, which makes them complete.

    build(matches) gives the tables of some matches. A run that is killed leaves tables without a row in runs; the next run
    makes these matches anew and replaces what lies there, and leaves the complete ones alone, so each ends up once. hand_over
    writes a table and reads it back: the matches to do are then looked for once, not for every table.
    """
    todo = hand_over(pending(matches, f"{root}/runs"))
    if todo.isEmpty():
        return
    for name, df in build(todo).items():
        overwrite_matches(df, f"{root}/{name}")
    write_runs(run_summary(todo, artifact_plan(todo)), f"{root}/runs")


def save_matches(dets: DataFrame, matches: DataFrame, root: str, **how) -> None:
    """run_matches() into folders, restartable; how: its configurations and hand_over."""
    save_tables(lambda todo: run_matches(dets.join(todo.select("match_id").hint("merge"), "match_id", "left_semi"), todo, **how), matches, root)


def overview(tables: dict[str, DataFrame], matches: DataFrame) -> DataFrame:
    """match_id, mode and the number of rows of each table."""
    out = matches.select("match_id", "mode")
    for name, df in tables.items():
        counted = df.groupBy("match_id").agg(F.count("*").alias(f"n_{name}"))
        out = out.join(counted.hint("merge"), "match_id", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out
