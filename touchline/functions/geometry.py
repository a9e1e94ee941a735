"""Scalar geometry as Column -> Column functions; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-6


def _c(x: Column | float | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def wrap_deg(a: Column | float | str) -> Column:
    """Into (-180, 180]; -180 becomes 180."""
    turned = F.pmod(_c(a), F.lit(360.0))
    return F.when(turned > 180, turned - 360).otherwise(turned)


def wrap_deg_half_open(a: Column | float | str) -> Column:
    """Into [-180, 180); 180 becomes -180."""
    return F.pmod(_c(a) + 180.0, F.lit(360.0)) - 180.0


def angle_diff(a: Column | float | str, b: Column | float | str) -> Column:
    """Shortest signed turn from b to a, in (-180, 180]."""
    return wrap_deg(_c(a) - _c(b))


def yaw_of(x: Column | str, width: Column | float) -> Column:
    return _c(x) / _c(width) * 360.0 - 180.0


def pitch_of(y: Column | str, height: Column | float) -> Column:
    return F.lit(90.0) - _c(y) / _c(height) * 180.0


def with_yaw_pitch(df: DataFrame, width: float, height: float, x: str = "cx", y: str = "cy") -> DataFrame:
    """yaw and pitch in degrees of a point of the equirectangular picture."""
    return df.withColumns({"yaw": yaw_of(x, width), "pitch": pitch_of(y, height)})


def with_bbox_geometry(df: DataFrame) -> DataFrame:
    """cx, cy, w, h, area of x1, y1, x2, y2."""
    c = F.col
    w, h = c("x2") - c("x1"), c("y2") - c("y1")
    return df.withColumns({"cx": (c("x1") + c("x2")) / 2, "cy": (c("y1") + c("y2")) / 2, "w": w, "h": h, "area": w * h})


def with_box_measurement(df: DataFrame) -> DataFrame:
    """m_cx, m_cy, m_area, m_aspect: the box as a tracker measures it."""
    c = F.col
    w, h = c("x2") - c("x1"), c("y2") - c("y1")
    return df.withColumns({"m_cx": c("x1") + w / 2, "m_cy": c("y1") + h / 2, "m_area": w * h, "m_aspect": w / (h + EPS)})


def box_from_measurement(cx: Column, cy: Column, area: Column, aspect: Column) -> list[Column]:
    """x1, y1, x2, y2 of a measured box; area times aspect counts as EPS at least."""
    w = F.sqrt(F.greatest(area * aspect, F.lit(EPS)))
    h = area / (w + EPS)
    return [cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2]


def vertical_fov(hfov: Column | float, out_w: float, out_h: float) -> Column:
    return F.degrees(2 * F.atan(F.tan(F.radians(_c(hfov)) / 2) * (out_h / out_w)))


def with_vertical_fov(df: DataFrame, out_w: float, out_h: float, fov: str = "fov") -> DataFrame:
    return df.withColumn("vfov", vertical_fov(F.col(fov), out_w, out_h))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    area = lambda q: (q["x2"] - q["x1"]) * (q["y2"] - q["y1"])
    return w * h / (area(a) + area(b) - w * h + EPS)
