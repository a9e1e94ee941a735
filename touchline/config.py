"""Parameters of the operators; the defaults are fixed values that the results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Detection:
    width: float = 1920.0
    height: float = 960.0
    fps: float = 30.0
    min_confidence: float = 0.25
    max_per_frame: int = 20
    class_id: int = 32
    min_y: float = 0.20
    max_y: float = 0.98
    every_n: int = 1
    tile_overlap: float = 0.1
    nms_iou: float = 0.45


@dataclass(frozen=True)
class FieldOfInterest:
    center: float = 0.0
    window: float = 200.0
    pitch_min: float = -45.0
    pitch_max: float = 20.0
    sample_sec: float = 30.0
    min_confidence: float = 0.25


@dataclass(frozen=True)
class ByteTrack:
    high: float = 0.25
    low: float = 0.1
    new: float = 0.25
    buffer: int = 30
    match: float = 0.4


@dataclass(frozen=True)
class BallSelection:
    max_speed: float = 200.0
    max_displacement: float = 300.0
    min_area: float = 10.0
    max_area: float = 10000.0
    #: Frames after which the last ball is forgotten; None: never.
    expiry: int | None = None


@dataclass(frozen=True)
class Stabilizer:
    alpha: float = 0.35
    required: int = 2
    window: int = 3
    max_jump: float = 250.0
    max_speed: float = 2500.0
    max_gap: int = 15


@dataclass(frozen=True)
class Camera:
    pan_normal: float = 60.0
    pan_fast: float = 120.0
    alpha: float = 0.15
    fov: float = 90.0
    fov_min: float = 80.0
    fov_max: float = 100.0
    coast: int = 30
    drift: int = 90
    center_yaw: float = 0.0
    center_pitch: float = -5.0
    deadband: float = 0.5
    velocity: float = 2.0
    widen: bool = True
    process_noise: float = 0.1
    measurement_noise: float = 1.0


@dataclass(frozen=True)
class Highlights:
    percentile: float = 0.95
    direction: float = 90.0
    min_speed: float = 10.0
    boxes: tuple[tuple[float, float, float, float], ...] = ((0.0, 0.3, 0.08, 0.7), (0.92, 0.3, 1.0, 0.7))
    before: float = 5.0
    after: float = 3.0
    gap: float = 5.0
    min_clip: float = 3.0


@dataclass(frozen=True)
class HardFrames:
    confidence: float = 0.3
    gap: int = 15
    jump: float = 150.0
    cap: int = 500


@dataclass(frozen=True)
class Labeling:
    cap: int = 600
    every_n: int = 2
    low: float = 0.20
    high: float = 0.50
    lost_run: int = 15
    jump: float = 200.0


@dataclass(frozen=True)
class Render:
    width: int = 1920
    height: int = 1080
    parts: int = 12
    overlap_sec: float = 0.5
    tactical_fov: float = 120.0
    tactical_yaw: float = 0.0
    tactical_pitch: float = -5.0


@dataclass(frozen=True)
class Ingest:
    checks: int = 5
    staging: tuple[str, ...] = (".uploading", ".tmp", ".part")
    suffixes: tuple[str, ...] = (".mp4", ".insv", ".mov")
    ledger_cap: int = 50_000
    template: str = "{match}_{job_id}{ext}"
    collision: str = "suffix"
