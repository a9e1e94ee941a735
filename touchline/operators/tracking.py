"""Tracks: frame spine, multi-object tracking, ball selection, stabilizer.

State at a frame depends on the accepted state before it, so these are folds over the frames of a key, in order, inside
applyInPandas. Keys are sessions where a gap is long enough that no state crosses it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.config import BallSelection, ByteTrack, Stabilizer
from touchline.operators.detections import FRAME, dealt


def frame_spine(rows: DataFrame, extra: int = 0, totals: DataFrame | None = None) -> DataFrame:
    """match_id, frame for 0 .. max(frame) + extra, or up to total_frames of the match where that is more."""
    last = rows.groupBy("match_id").agg((F.max("frame") + 1 + extra).alias("n"))
    if totals is not None:
        last = last.join(totals.select("match_id", "total_frames").hint("merge"), "match_id", "full").select("match_id", F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("total_frames", F.lit(0))).alias("n"))
    return last.where("n > 0").select("match_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("frame"))


def dense(rows: DataFrame, extra: int = 0, totals: DataFrame | None = None) -> DataFrame:
    """rows (one per match and frame) on the spine: frames without a row have nulls."""
    return frame_spine(rows, extra, totals).join(rows.hint("merge"), FRAME, "left")


def sessions(rows: DataFrame, gap: int, when: Column | None = None) -> DataFrame:
    """rows with a session number per match: a new one begins where more than gap frames lie between rows (that meet when)."""
    order = Window.partitionBy("match_id").orderBy("frame")
    mark = F.col("frame") if when is None else F.when(when, F.col("frame"))
    before = F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.col("frame") - before > gap) & mark.isNotNull()
    return rows.withColumn("session", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


#: Sessions that one call of a fold takes.
SESSIONS = 16
STABLE = "match_id bigint, frame bigint, status string, reason string, x double, y double, confidence double, bbox array<double>, distance_px double, speed_px_s double"


def _stabilize(rows: pd.DataFrame, cfg: Stabilizer, fps: float) -> pd.DataFrame:
    rows = rows.sort_values(["frame", "det_id"]).drop_duplicates("frame", keep="last")
    out: list[tuple] = []
    recent: list[int] = []
    last, x, y = None, 0.0, 0.0
    for frame, dx, dy in zip(rows["frame"].tolist(), rows["x"].tolist(), rows["y"].tolist(), strict=True):
        if last is not None and frame - last > cfg.max_gap:
            last, recent = None, []
        recent = [f for f in recent if f > frame - cfg.window] + [frame]
        reason, distance, speed = None, None, None
        if len(recent) < cfg.required:
            reason = "persistence"
        elif last is not None:
            gap = float(math.sqrt((dx - x) * (dx - x) + (dy - y) * (dy - y)))
            rate = gap / ((frame - last) / fps)
            if gap > cfg.max_jump:
                reason, distance = "jump", gap
            elif rate > cfg.max_speed:
                reason, distance, speed = "speed", gap, rate
        if reason is None:
            if last is None:
                x, y = dx, dy
            else:
                x, y = cfg.alpha * dx + (1 - cfg.alpha) * x, cfg.alpha * dy + (1 - cfg.alpha) * y
            last = frame
        out.append(("accepted" if reason is None else "rejected", reason, x if reason is None else None, y if reason is None else None, distance, speed))
    made = pd.DataFrame(out, columns=["status", "reason", "sx", "sy", "distance_px", "speed_px_s"], index=rows.index)
    boxes = rows[["x1", "y1", "x2", "y2"]].to_numpy().tolist()
    return pd.DataFrame({
        "match_id": rows["match_id"], "frame": rows["frame"], "status": made["status"], "reason": made["reason"], "x": made["sx"].astype(float), "y": made["sy"].astype(float),
        "confidence": rows["confidence"], "bbox": boxes, "distance_px": made["distance_px"].astype(float), "speed_px_s": made["speed_px_s"].astype(float),
    })


def stabilize_rows(best: DataFrame, cfg: Stabilizer = Stabilizer(), fps: float = 30.0) -> DataFrame:
    """STABLE rows for frames with a detection: accepted with the smoothed position, or rejected with the reason.

    best has one row per match and frame (of more, the last det_id counts). Detections more than max_gap apart share no
    state as long as window - 1 <= max_gap, so the fold runs by session; else by match.
    """
    rows = best.withColumns({"x": (F.col("x1") + F.col("x2")) / 2, "y": (F.col("y1") + F.col("y2")) / 2}).select("match_id", "frame", "det_id", "x", "y", "x1", "y1", "x2", "y2", "confidence")
    rows = sessions(rows, cfg.max_gap) if cfg.window - 1 <= cfg.max_gap else rows.withColumn("session", F.lit(0))
    # a block of whole sessions at a time: the fold starts anew at each gap by itself
    rows = rows.withColumn("block", F.floor(F.col("session") / SESSIONS)).drop("session")
    return dealt(rows, "match_id", "block").groupBy("match_id", "block").applyInPandas(lambda g: _stabilize(g, cfg, fps), STABLE)


def stabilize_ball(best: DataFrame, cfg: Stabilizer = Stabilizer(), fps: float = 30.0, extra: int = 0, totals: DataFrame | None = None, stable: DataFrame | None = None) -> DataFrame:
    """Dense tracks: match_id, frame, ball (x and y to 2 places, null unless accepted), status, reason, raw_det.

    stable: stabilize_rows() of best, where it is at hand.
    """
    rows = dense(stabilize_rows(best, cfg, fps) if stable is None else stable, extra, totals)
    ball = F.struct(F.bround("x", 2).alias("x"), F.bround("y", 2).alias("y"), "bbox", "confidence", F.lit(1).cast("long").alias("track_id"))
    return rows.select(
        *FRAME, F.when(F.col("status") == "accepted", ball).alias("ball"), F.coalesce("status", F.lit("lost")).alias("status"), "reason",
        F.when(F.col("status").isNotNull(), F.struct("bbox", F.col("confidence").alias("conf"))).alias("raw_det"),
    )


def stabilizer_events(stable: DataFrame) -> DataFrame:
    """match_id, frame, trigger, distance_px, speed_px_s (to 1 place) of jumps and of speeds; stable: of stabilize_rows."""
    tenths = [F.bround(c, 1).alias(c) for c in ("distance_px", "speed_px_s")]
    return stable.where(F.col("reason").isin("jump", "speed")).select(*FRAME, F.col("reason").alias("trigger"), *tenths)


def track_summary(tracks: DataFrame) -> DataFrame:
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return tracks.groupBy("match_id").agg(F.count("*").alias("frames"), of("accepted"), of("rejected"), of("lost"))


def persistence_gate(best: DataFrame, cfg: Stabilizer = Stabilizer()) -> DataFrame:
    """best with hits (detections in the last window frames, own included) and persistent; no resets, for analysis."""
    order = Window.partitionBy("match_id").orderBy("frame").rangeBetween(-(cfg.window - 1), 0)
    return best.withColumn("hits", F.count("*").over(order)).withColumn("persistent", F.col("hits") >= cfg.required)


def assign(cost: Sequence[Sequence[float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, as many as the shorter side has: shortest augmenting paths."""
    n, m = len(cost), len(cost[0])
    if n > m:
        return sorted((r, c) for c, r in assign(list(zip(*cost, strict=True))))
    if n == 1:
        return [(0, min(range(m), key=cost[0].__getitem__))]
    u, v, match, columns = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), range(1, m + 1)
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, way, used = [math.inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while match[at]:
            used[at] = True
            row, to = match[at], 0
            costs, base = cost[row - 1], u[row]
            for j in columns:
                if not used[j]:
                    slack = costs[j - 1] - base - v[j]
                    if slack < least[j]:
                        least[j], way[j] = slack, at
                    if not to or least[j] < least[to]:
                        to = j
            step = least[to]
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = to
        while at:
            match[at], at = match[way[at]], way[at]
    return sorted((match[j] - 1, j - 1) for j in columns if match[j])


Box = tuple[float, float, float, float]


def measured(box: Box) -> Box:
    """Centre, area and aspect."""
    x1, y1, x2, y2 = box
    w, h = x2 - x1, y2 - y1
    return x1 + w / 2, y1 + h / 2, w * h, w / (h + 1e-6)


def box_iou(a: Box, b: Box) -> float:
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = wide * high if wide > 0 and high > 0 else 0.0
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both + 1e-6)


class _Track:
    """A live track: value and rate of centre x, centre y, area and aspect, with the covariances that the four parts share
    (of value, of both, of rate). Frames have a few tracks, so plain numbers beat arrays by far."""

    __slots__ = ("conf", "cov", "id", "idle", "rate", "streak", "value")

    def __init__(self, box: Box, conf: float, number: int) -> None:
        self.value, self.rate, self.cov = measured(box), (0.0, 0.0, 0.0, 0.0), (10.0, 0.0, 10000.0)
        self.id, self.idle, self.streak, self.conf = number, 0, 1, conf

    def predict(self) -> None:
        (x, y, area, aspect), (dx, dy, da, dr), (a, b, c) = self.value, self.rate, self.cov
        if da + area <= 0:
            da = 0.0
        self.rate, self.value = (dx, dy, da, dr), (x + dx, y + dy, area + da, aspect + dr)
        self.cov = (a + 2 * b + c + 1.0, b + c, c + 0.01)
        if self.idle > 0:
            self.streak = 0
        self.idle += 1

    def update(self, box: Box, conf: float) -> None:
        a, b, c = self.cov
        k, g = a / (a + 1.0), b / (a + 1.0)
        gap = [m - v for m, v in zip(measured(box), self.value, strict=True)]
        self.value = tuple([v + k * e for v, e in zip(self.value, gap, strict=True)])
        self.rate = tuple([d + g * e for d, e in zip(self.rate, gap, strict=True)])
        self.cov = ((1 - k) * a, (1 - k) * b, c - g * b)
        self.idle, self.conf = 0, conf
        self.streak += 1

    def box(self) -> Box:
        x, y, area, aspect = self.value
        w = math.sqrt(max(area * aspect, 1e-6))
        h = area / (w + 1e-6)
        return x - w / 2, y - h / 2, x + w / 2, y + h / 2


def _matched(live: list[_Track], found: list[tuple[Box, float]], cfg: ByteTrack) -> tuple[set[int], set[int]]:
    """Update tracks by the boxes they overlap; the places of the tracks and boxes that found each other."""
    if not live or not found:
        return set(), set()
    places = [t.box() for t in live]
    overlap = [[box_iou(p, b) for b, _ in found] for p in places]
    pairs = [(r, c) for r, c in assign([[1.0 - x for x in row] for row in overlap]) if overlap[r][c] >= cfg.match]
    for r, c in pairs:
        live[r].update(*found[c])
    return {r for r, _ in pairs}, {c for _, c in pairs}


CANDIDATES = "match_id bigint, session int, frame bigint, track_id bigint, bbox array<double>, score double"


def _bytetrack(rows: pd.DataFrame, cfg: ByteTrack) -> Iterator[tuple]:
    rows = rows.sort_values(["frame", "det_id"])
    frames: dict[int, list[tuple[Box, float]]] = {}
    for frame, *box, conf in zip(*(rows[c].tolist() for c in ("frame", "x1", "y1", "x2", "y2", "confidence")), strict=True):
        frames.setdefault(frame, []).append((tuple(map(float, box)), conf))
    live: list[_Track] = []
    made = 0
    for frame in range(min(frames), max(frames) + 1):
        if not live and frame not in frames:
            continue  # without live tracks an empty frame changes nothing
        for t in live:
            t.predict()
        found = frames.get(frame, ())
        high, low = [d for d in found if d[1] >= cfg.high], [d for d in found if cfg.low <= d[1] < cfg.high]
        hit, used = _matched(live, high, cfg)
        _matched([t for i, t in enumerate(live) if i not in hit], low, cfg)
        for i, (box, conf) in enumerate(high):
            if i not in used and conf >= cfg.new:
                made += 1
                live.append(_Track(box, conf, made))
        # tracks seen in this frame come first, then the lost ones
        seen = [t for t in live if t.idle == 0]
        live = seen + [t for t in live if 0 < t.idle <= cfg.buffer]
        for t in seen:
            yield frame, t.id, list(t.box()), 0.7 * t.conf + 0.3 * min(t.streak / 5.0, 1.0)


def bytetrack(dets: DataFrame, cfg: ByteTrack = ByteTrack()) -> DataFrame:
    """match_id, frame, track_id, bbox, score: tracks that were updated in a frame. Ids count from 1 in each match.

    All tracks are gone after more than buffer + 1 frames without a detection of the lower threshold, so the fold runs by
    session; ids are made unique by the number of tracks of earlier sessions.
    """
    rows = dets.select("match_id", "frame", "det_id", "x1", "y1", "x2", "y2", "confidence").where(F.col("confidence") >= cfg.low)
    split = sessions_by_frame(rows, cfg.buffer + 1)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        out = [(int(key[0]), int(session), *row) for session, part in g.groupby("session") for row in _bytetrack(part, cfg)]
        return pd.DataFrame(out, columns=["match_id", "session", "frame", "track_id", "bbox", "score"])

    split = split.withColumn("block", F.floor(F.col("session") / SESSIONS))
    found = dealt(split, "match_id", "block").groupBy("match_id", "block").applyInPandas(run, CANDIDATES)
    last = Window.partitionBy("match_id").orderBy("session").rowsBetween(Window.unboundedPreceding, -1)
    made = found.groupBy("match_id", "session").agg(F.max("track_id").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(last), F.lit(0))).drop("n")
    return found.join(made.hint("merge"), ["match_id", "session"]).select("match_id", "frame", (F.col("track_id") + F.col("before")).alias("track_id"), "bbox", "score")


def sessions_by_frame(rows: DataFrame, gap: int) -> DataFrame:
    """rows (any number a frame) with a session number per match: a new one begins after more than gap frames without a row."""
    order = Window.partitionBy("match_id").orderBy("frame")
    before = F.last("frame").over(order.rangeBetween(Window.unboundedPreceding, -1))
    first = F.row_number().over(Window.partitionBy("match_id", "frame").orderBy("det_id")) == 1
    marked = rows.withColumn("__new", (first & (F.col("frame") - before > gap)).cast("int"))
    return marked.withColumn("session", F.coalesce(F.sum("__new").over(order.rangeBetween(Window.unboundedPreceding, 0)), F.lit(0)).cast("int")).drop("__new")


SELECTED = "match_id bigint, frame bigint, x double, y double, bbox array<double>, confidence double, track_id bigint"


def _select(rows: pd.DataFrame, cfg: BallSelection) -> Iterator[tuple]:
    x = y = at = None
    for frame, g in rows.sort_values(["frame", "pos"]).groupby("frame"):
        best = None
        for box, score, track in zip(g["bbox"], g["score"], g["track_id"], strict=True):
            area = (box[2] - box[0]) * (box[3] - box[1])
            if not cfg.min_area <= area <= cfg.max_area:
                continue
            cx, cy, near = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2, 1.0
            if x is not None and (cfg.expiry is None or frame - at <= cfg.expiry):
                moved = float(math.sqrt((cx - x) ** 2 + (cy - y) ** 2))
                if moved > cfg.max_displacement:
                    continue
                near = max(0.0, 1.0 - moved / cfg.max_speed)
            total = 0.6 * score + 0.4 * near
            if best is None or total > best[0]:
                best = (total, cx, cy, box, score, track)
        if best is not None:
            _, x, y, box, score, track = best
            at = frame
            yield frame, x, y, list(box), score, track


def select_ball(candidates: DataFrame, cfg: BallSelection = BallSelection()) -> DataFrame:
    """match_id, frame, x, y, bbox, confidence, track_id of the chosen candidate; frames without one have no row.

    The last ball never expires unless cfg.expiry is set, so a match is one fold. Ties go to the first candidate: the
    order is `pos` where the table has it, else track_id.
    """
    rows = candidates if "pos" in candidates.columns else candidates.withColumn("pos", F.col("track_id"))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_select(g, cfg)), columns=["frame", "x", "y", "bbox", "confidence", "track_id"]).assign(match_id=key[0])[["match_id", "frame", "x", "y", "bbox", "confidence", "track_id"]]

    return dealt(rows, "match_id").groupBy("match_id").applyInPandas(run, SELECTED)


def legacy_tracks(dets: DataFrame, track: ByteTrack = ByteTrack(), ball: BallSelection = BallSelection()) -> DataFrame:
    """Dense tracks (match_id, frame, ball) of tracking and ball selection, up to the last detection's frame."""
    chosen = select_ball(bytetrack(dets, track), ball)
    spine = frame_spine(dets).join(chosen.hint("merge"), FRAME, "left")
    return spine.select(*FRAME, F.when(F.col("x").isNotNull(), F.struct("x", "y", "bbox", "confidence", "track_id")).alias("ball"))
