"""Declared schemas of the tables."""

from pyspark.sql.types import StructType

MATCHES = "match_id string, width int, height int, fps double, duration double, total_frames bigint, codec string"
DETECTIONS = "match_id bigint, frame bigint, det_id bigint, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int"
#: Both spellings of a detection line.
DETECTION_LINE = (
    "frame bigint, frame_index bigint, bbox array<double>, bbox_xyxy array<double>, confidence double, conf double, "
    "class int, class_id int, interpolated boolean, time_sec double"
)
BALL = "struct<x:double,y:double,bbox:array<double>,confidence:double,track_id:bigint>"
TRACK_LINE = f"frame bigint, ball {BALL}, status string, reason string, raw_det struct<bbox:array<double>,conf:double>"
CAMERA_ITEM = "array<struct<yaw:double,pitch:double,fov:double>>"
LEDGER = "path string, size bigint, mtime_ns bigint, ctime_ns bigint, ino bigint, dev bigint, processed_at timestamp, job_path string"
MANIFEST = "match_name string, frames array<struct<frame_index:bigint,time_sec:double,predicted_bbox:array<double>>>"
PROBE = "streams array<struct<codec_type:string,codec_name:string,width:int,height:int,r_frame_rate:string,duration:string>>, format struct<duration:string>"


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
