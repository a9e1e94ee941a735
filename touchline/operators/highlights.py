"""Highlight events and clips from tracks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.config import Highlights
from touchline.operators.detections import FRAME

EVENT = [*FRAME, "time_sec", "type", "value"]


def ball_velocity(rows: DataFrame, fps: float = 30.0, adjacent: bool = True) -> DataFrame:
    """rows (match_id, frame, x, y) with vx, vy, speed in px/s: 0 unless this row and the one before have a ball.

    rows is dense (nulls where there is no ball); adjacent=False takes whatever row comes before, and the frames between.
    """
    order = Window.partitionBy("match_id").orderBy("frame")
    before = {k: F.lag(k).over(order) for k in ("x", "y", "frame")}
    per_second = lambda gone: gone * fps if adjacent else gone / ((F.col("frame") - F.col("p_frame")) / fps)
    both = F.col("x").isNotNull() & F.col("p_x").isNotNull()
    moved = rows.withColumns({f"p_{k}": v for k, v in before.items()})
    rate = lambda k: F.when(both, per_second(F.col(k) - F.col(f"p_{k}"))).otherwise(0.0)
    return moved.withColumns({"vx": rate("x"), "vy": rate("y")}).withColumn("speed", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))).drop("p_x", "p_y", "p_frame")


def percentile_by_bins(rows: DataFrame, key: str, value: str, share: float, bins: int = 1024) -> DataFrame:
    """key, percentile: the exact percentile of the values of each key, between neighbours in proportion, as percentile() gives it.

    No task holds the values of a key: they are counted in bins of equal width, a count a task and bin, and then only the
    distinct values of the one or two bins that hold the wanted ranks are counted and ranked. Nulls don't count.
    """
    v = rows.select(key, F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    span = v.groupBy(key).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    binned = v.join(span.hint("merge"), key).withColumn("bin", place).withColumn("at", (F.col("n") - 1) * F.lit(float(share)))
    counts = binned.groupBy(key, "bin").agg(F.count("*").alias("m"), F.first("at").alias("at"))
    before = counts.withColumn("before", F.sum("m").over(Window.partitionBy(key).orderBy("bin")) - F.col("m"))
    wanted = before.where((F.col("before") <= F.ceil("at")) & (F.floor("at") < F.col("before") + F.col("m"))).select(key, "bin", "before")
    kept = binned.join(wanted.hint("merge"), [key, "bin"]).groupBy(key, "bin", "before", "at", "v").agg(F.count("*").alias("m"))
    upto = F.col("before") + F.sum("m").over(Window.partitionBy(key, "bin").orderBy("v"))
    ranked = kept.withColumn("upto", upto).withColumn("since", F.col("upto") - F.col("m"))
    holds = lambda rank: F.max(F.when((F.col("since") <= rank) & (rank < F.col("upto")), F.col("v")))
    ends = ranked.groupBy(key).agg(F.first("at").alias("at"), holds(F.floor("at")).alias("low"), holds(F.ceil("at")).alias("high"))
    between = (F.ceil("at") - F.col("at")) * F.col("low") + (F.col("at") - F.floor("at")) * F.col("high")
    return ends.select(key, F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between).alias("percentile"))


def speed_thresholds(velocity: DataFrame, cfg: Highlights = Highlights(), bins: int | None = None) -> DataFrame:
    """match_id, threshold: exact percentile of the speeds above 0; with bins, without all distinct speeds of a match in one task."""
    moving = velocity.where("speed > 0")
    if bins:
        return percentile_by_bins(moving, "match_id", "speed", cfg.percentile, bins).withColumnRenamed("percentile", "threshold")
    return moving.groupBy("match_id").agg(F.percentile("speed", F.lit(cfg.percentile)).alias("threshold"))


def _event(rows: DataFrame, kind: str, value: Column, fps: float) -> DataFrame:
    return rows.select(*FRAME, (F.col("frame") / fps).alias("time_sec"), F.lit(kind).alias("type"), value.alias("value"))


def speed_events(velocity: DataFrame, cfg: Highlights = Highlights(), fps: float = 30.0, thresholds: DataFrame | None = None) -> DataFrame:
    limits = speed_thresholds(velocity, cfg) if thresholds is None else thresholds
    return _event(velocity.join(limits.hint("merge"), "match_id").where("speed > 0 AND speed >= threshold"), "speed", F.col("speed"), fps)


def goal_box_events(rows: DataFrame, cfg: Highlights = Highlights(), width: float = 1920.0, height: float = 960.0, fps: float = 30.0) -> DataFrame:
    """Frames whose ball lies in any of the rectangles (unit square, ends included), once each."""
    x, y = F.col("x") / width, F.col("y") / height
    inside = reduce(lambda a, b: a | b, (x.between(x1, x2) & y.between(y1, y2) for x1, y1, x2, y2 in cfg.boxes), F.lit(False))
    return _event(rows.where(inside), "goal_box", F.lit(1.0), fps)


#: Rectangles of a cell beyond which it is split among several tasks.
CELL_RECTANGLES = 256


def region_events(rows: DataFrame, regions: DataFrame, width: float = 1920.0, height: float = 960.0, most: int = CELL_RECTANGLES) -> DataFrame:
    """rows whose ball lies in any rectangle of a table (x1, y1, x2, y2 of the unit square, ends included), once each.

    Grids of 2**level cells an axis: a rectangle lies in the grid whose cells are just larger than it, so in four cells at
    most. Distinct places look into their cell of each grid that is in use; all joins are by cell. The rectangles of a
    cell that holds more than `most` are dealt out, and its places with them. Rectangles with a null or turned side hold nothing.
    """
    sides = {c: F.col(c).cast("double").alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2")}
    boxes = regions.select(*sides.values()).where("r_x1 <= r_x2 AND r_y1 <= r_y2").distinct()
    longest = F.greatest(F.col("r_x2") - F.col("r_x1"), F.col("r_y2") - F.col("r_y1"), F.lit(2.0**-24))
    boxes = boxes.withColumn("level", F.floor(-F.log2(longest)).cast("int"))
    cell = lambda v: F.floor(v * F.pow(F.lit(2.0), F.col("level")))
    span = lambda a, b: F.explode(F.sequence(cell(F.col(f"r_{a}")), cell(F.col(f"r_{b}"))))
    boxes = boxes.withColumn("cx", span("x1", "x2")).withColumn("cy", span("y1", "y2"))
    cells = boxes.groupBy("level", "cx", "cy").agg(F.floor(F.count("*") / (most + 1)).cast("int").alias("shares"))
    full = cells.where("shares > 0")
    of_cell = ["level", "cx", "cy"]
    boxes = boxes.join(full.hint("merge"), of_cell, "left").withColumn("share", F.pmod(F.hash("r_x1", "r_y1", "r_x2", "r_y2"), F.coalesce("shares", F.lit(0)) + 1)).drop("shares")
    levels = [r["level"] for r in cells.select("level").distinct().collect()]  # some 30 at most, between the largest and least side
    places = rows.select((F.col("x") / width).alias("px"), (F.col("y") / height).alias("py")).where("px IS NOT NULL AND py IS NOT NULL").distinct()
    looks = places.withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    looks = looks.withColumns({"cx": cell(F.col("px")), "cy": cell(F.col("py"))}).join(full.hint("merge"), of_cell, "left")
    looks = looks.withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(0))))).drop("shares")
    held = F.col("px").between(F.col("r_x1"), F.col("r_x2")) & F.col("py").between(F.col("r_y1"), F.col("r_y2"))
    names = {c: f"b_{c}" for c in (*of_cell, "share")}
    there = boxes.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, (F.col(c) == F.col(n) for c, n in names.items()))
    hits = looks.join(there.hint("merge"), same & held, "left_semi").select("px", "py").distinct()
    return rows.join(hits.hint("merge"), (F.col("x") / width == F.col("px")) & (F.col("y") / height == F.col("py")), "left_semi")


def direction_events(velocity: DataFrame, cfg: Highlights = Highlights(), fps: float = 30.0) -> DataFrame:
    """Turns of at least cfg.direction degrees between consecutive velocities of at least cfg.min_speed."""
    order = Window.partitionBy("match_id").orderBy("frame")
    both = velocity.withColumns({f"p_{c}": F.lag(c).over(order) for c in ("vx", "vy", "speed")})
    cos = (F.col("vx") * F.col("p_vx") + F.col("vy") * F.col("p_vy")) / (F.col("speed") * F.col("p_speed"))
    fast = both.where((F.col("speed") >= cfg.min_speed) & (F.col("p_speed") >= cfg.min_speed))
    turned = fast.withColumn("angle", F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))
    return _event(turned.where(F.col("angle") >= cfg.direction), "direction", F.col("angle"), fps)


def highlight_events(rows: DataFrame, cfg: Highlights = Highlights(), width: float = 1920.0, height: float = 960.0, fps: float = 30.0, adjacent: bool = True) -> DataFrame:
    """All events of tracks (match_id, frame, x, y), a bag union."""
    velocity = ball_velocity(rows, fps, adjacent)
    return speed_events(velocity, cfg, fps).unionByName(goal_box_events(rows, cfg, width, height, fps)).unionByName(direction_events(velocity, cfg, fps))


def cluster_events(events: DataFrame, cfg: Highlights = Highlights(), fps: float = 30.0) -> DataFrame:
    """events with cluster: a new one begins where more than cfg.gap seconds (counted in frames) lie between events."""
    order = Window.partitionBy("match_id").orderBy("frame", "type")
    new = F.col("frame") - F.lag("frame").over(order) > cfg.gap * fps
    marked = events.withColumn("__new", F.coalesce(new, F.lit(False)).cast("int"))
    return marked.withColumn("cluster", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def clips(clustered: DataFrame, cfg: Highlights = Highlights()) -> DataFrame:
    """match_id, clip_id (in order), start_sec, end_sec, duration, event_count, event_types (sorted); short clips are left out."""
    rolled = clustered.groupBy("match_id", "cluster").agg(
        F.greatest(F.lit(0.0), F.min("time_sec") - cfg.before).alias("start_sec"), (F.max("time_sec") + cfg.after).alias("end_sec"),
        F.count("*").alias("event_count"), F.array_sort(F.collect_set("type")).alias("event_types"),
    )
    kept = rolled.withColumn("duration", F.col("end_sec") - F.col("start_sec")).where(F.col("duration") >= cfg.min_clip)
    number = F.row_number().over(Window.partitionBy("match_id").orderBy("cluster")).cast("long") - 1
    return kept.select("match_id", number.alias("clip_id"), "start_sec", "end_sec", "duration", "event_count", "event_types")


def highlight_clips(rows: DataFrame, cfg: Highlights = Highlights(), width: float = 1920.0, height: float = 960.0, fps: float = 30.0, adjacent: bool = True) -> DataFrame:
    return clips(cluster_events(highlight_events(rows, cfg, width, height, fps, adjacent), cfg, fps), cfg)
