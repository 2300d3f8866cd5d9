"""Declared schemas of every layer.  Nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _L, _B = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name.rstrip("_"), kind) for name, kind in fields.items()])


def array(kind) -> T.ArrayType:
    return T.ArrayType(kind)


DETECTION = struct(label=_S, class_=_S, confidence=_D, bbox=array(_D), class_id=T.IntegerType())
DETECTIONS = struct(
    video_id=_S, video_name=_S, video_path=_S,
    frames=array(struct(video_name=_S, frame_path=_S, timestamp=_D, detections=array(DETECTION))),
)
POINT = struct(timestamp=_D, frame_path=_S, bbox=array(_D), center_x=_D, center_y=_D, confidence=_D)
TRACK = struct(
    track_id=_S, label=_S, start_ts=_D, end_ts=_D, duration_sec=_D, frame_count=T.IntegerType(), avg_confidence=_D,
    max_confidence=_D, direction=_S, representative_frame=_S, points=array(POINT),
)
TRAJECTORIES = struct(video_id=_S, video_name=_S, video_path=_S, tracks=array(TRACK))
EVENT = struct(
    event_id=_S, event_type=_S, plugin_name=_S, video_id=_S, video_name=_S, video_path=_S, start_ts=_D, end_ts=_D,
    track_ids=array(_S), confidence=_D, representative_frame=_S, evidence_frames=array(_S), key_snapshots=array(_S),
    attributes=T.MapType(_S, _S), description=_S,
)
EVENTS = struct(video_id=_S, video_name=_S, video_path=_S, segment_built=_B, events=array(EVENT))
OCR = struct(
    video_name=_S,
    frames=array(struct(frame_path=_S, timestamp_sec=_D, display_time=_S,
                        ocr_results=array(struct(text=_S, score=_D, bbox=array(array(T.IntegerType())))))),
)
SEGMENT = struct(
    segment_id=_S, video_id=_S, video_name=_S, video_path=_S, time_range=struct(start=_D, end=_D), frame_paths=array(_S),
    events=array(_S), event_ids=array(_S), tracks=array(_S), text=_S, text_source=_S,
)
SEGMENTS = struct(
    video_id=_S, segments=array(SEGMENT),
    embeddings=array(struct(segment_id=_S, model=_S, dimension=T.IntegerType(), path=_S, text_source=_S, created_at=_S)),
)
VECTORS = struct(
    ext_id=_L, video_id=_S, kind=_S, vec=array(T.FloatType()), video_name=_S, video_path=_S, frame_path=_S,
    timestamp_seconds=_D, frame_id=_S, segment_id=_S, start_ts=_D, end_ts=_D,
)
#: What every retrieval channel returns, so that fusion is one union and one shuffle.
HIT = struct(
    channel=_S, score=_D, video_id=_S, video_name=_S, video_path=_S, frame_id=_S, frame_path=_S, segment_id=_S, start_ts=_D,
    end_ts=_D, ts=_D, label=_S, direction=_S, event_type=_S, track_id=_S, event_id=_S, text=_S, snapshots=array(_S),
)
