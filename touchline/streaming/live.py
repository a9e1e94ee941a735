"""Live tracks, triggers and clips over streams of detections and events."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from touchline.config import Highlights, Labeling, Stabilizer

LIVE = "match_id bigint, frame bigint, status string, reason string, x double, y double, lost_run boolean"


def live_stabilizer(
    best: DataFrame, cfg: Stabilizer = Stabilizer(), labeling: Labeling = Labeling(), fps: float = 30.0, time: str | None = None, delay: str = "10 seconds",
    forget_ms: int = 3_600_000, hold: int = 0, late: bool = False,
) -> DataFrame:
    """LIVE rows of a stream of best detections (match_id, frame, x, y; x null: a frame without one), in append mode.

    The state of a match is small: last frame, anchor, frames in the window, length of the run without a ball, and frames
    that wait. Frames wait until one that is hold or more later has come, and are then taken in order, so rows that come in
    any order within hold frames over several triggers give what ordered ones give; of rows that repeat a waiting frame the
    last to come counts. Frames at or before the last one taken are late: dropped, or, with late, reported in a row of status
    'late' each. Frames that the stream leaves out count as lost; lost_run marks the frame where a run without a ball reaches
    labeling.lost_run.

    With time (a timestamp column of best) the watermark, delay behind, drives expiry: a match without rows for forget_ms
    of event time has ended, its waiting frames are taken and its state is removed; rows behind the watermark are dropped by
    Spark and counted in the query's progress. Without it, states stay, and the last hold frames wait for later ones.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else {"at": -1, "last": None, "x": 0.0, "y": 0.0, "recent": [], "run": 0, "newest": -1}
        wait = {int(f): xy for f, xy in s.pop("wait", {}).items()}
        ended, out, seen = state.hasTimedOut, [], 0

        def emit(frame: int, status: str, reason: str | None = None) -> None:
            s["run"] = 0 if status == "accepted" else s["run"] + 1
            ok = status == "accepted"
            out.append((key[0], frame, status, reason, s["x"] if ok else None, s["y"] if ok else None, s["run"] == labeling.lost_run))

        if not ended:
            rows = pd.concat(list(parts))
            for frame, dx, dy in zip(rows["frame"].tolist(), rows["x"].tolist(), rows["y"].tolist(), strict=True):
                if frame > s["at"]:
                    wait[frame] = None if dx is None or np.isnan(dx) else (dx, dy)
                elif late:
                    out.append((key[0], frame, "late", None, None, None, False))
            s["newest"] = max(s["newest"], int(rows["frame"].max()))
            seen = int(rows[time].max().timestamp() * 1000) if time is not None else 0
        for frame in sorted(f for f in wait if ended or f <= s["newest"] - hold):
            place = wait.pop(frame)
            for skipped in range(s["at"] + 1, frame):
                emit(skipped, "lost")
            s["at"] = frame
            if s["last"] is not None and frame - s["last"] > cfg.max_gap:
                s["last"], s["recent"] = None, []
            if place is None:
                emit(frame, "lost")
                continue
            dx, dy = place
            s["recent"] = [f for f in s["recent"] if f > frame - cfg.window] + [frame]
            reason = "persistence" if len(s["recent"]) < cfg.required else None
            if reason is None and s["last"] is not None:
                gap = float(np.hypot(dx - s["x"], dy - s["y"]))
                reason = "jump" if gap > cfg.max_jump else "speed" if gap / ((frame - s["last"]) / fps) > cfg.max_speed else None
            if reason:
                emit(frame, "rejected", reason)
                continue
            blend = cfg.alpha if s["last"] is not None else 1.0
            s["x"], s["y"], s["last"] = blend * dx + (1 - blend) * s["x"], blend * dy + (1 - blend) * s["y"], frame
            emit(frame, "accepted")
        if ended:
            state.remove()
        else:
            state.update((json.dumps(s | {"wait": wait}),))
            if time is not None:
                state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + forget_ms)
        yield pd.DataFrame(out, columns=["match_id", "frame", "status", "reason", "x", "y", "lost_run"])

    own = ["match_id", "frame", "x", "y", *([time] if time else [])]
    rows = best.select(*own) if time is None else best.select(*own).withWatermark(time, delay)
    expiry = GroupStateTimeout.NoTimeout if time is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("match_id").applyInPandasWithState(step, LIVE, "state string", "append", expiry)


def live_clips(events: DataFrame, cfg: Highlights = Highlights(), time: str = "event_time", delay: str = "10 seconds") -> DataFrame:
    """Clips of a stream of events (match_id, event_time, type): sessions of events at most cfg.gap seconds apart.

    Streams need a threshold for speed events beforehand. The last session of a match comes when the watermark passes it.
    """
    sessions = F.session_window(time, f"{int(cfg.gap * 1000)} milliseconds")
    rolled = events.withWatermark(time, delay).groupBy("match_id", sessions.alias("s")).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("event_count"), F.array_sort(F.collect_set("type")).alias("event_types"))
    start = F.greatest(F.lit(0.0), F.col("first").cast("double") - cfg.before)
    out = rolled.select("match_id", start.alias("start_sec"), (F.col("last").cast("double") + cfg.after).alias("end_sec"), "event_count", "event_types")
    return out.withColumn("duration", F.col("end_sec") - F.col("start_sec")).where(F.col("duration") >= cfg.min_clip)
