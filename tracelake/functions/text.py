"""Column functions for names, labels, identifiers and display strings.  All null-safe unless noted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label display names.
LABEL_ZH = {
    "car": "汽车",
    "truck": "货车",
    "bus": "公交车",
    "motorcycle": "摩托车",
    "bicycle": "自行车",
    "person": "行人",
    "van": "面包车",
    "traffic light": "交通信号灯",
}
DIRECTIONS = ("left_to_right", "right_to_left", "top_to_bottom", "bottom_to_top", "stationary", "unknown")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def normal_label(c) -> Column:
    """Trimmed, lower case, one space between words; null becomes empty."""
    return F.regexp_replace(F.lower(F.regexp_replace(text_or_empty(c), r"^\s+|\s+$", "")), r"\s+", " ")


def normal_entity(c) -> Column:
    return normal_label(F.translate(text_or_empty(c), "_", " "))


def normal_event_type(c) -> Column:
    return F.translate(normal_label(c), " ", "_")


def normal_text(c) -> Column:
    """Lower case without any whitespace (recognised text)."""
    return F.regexp_replace(F.lower(text_or_empty(c)), r"\s+", "")


def normal_direction(c) -> Column:
    token = F.translate(normal_label(c), "- ", "__")
    return F.when(token.isin(*DIRECTIONS), token).otherwise("")


def normal_path(c) -> Column:
    """Forward slashes, lower case.  Resolving against a root is the caller's business."""
    return F.lower(F.replace(text_or_empty(c), F.lit("\\"), F.lit("/")))


def base_name(c) -> Column:
    return F.regexp_extract(F.replace(text_or_empty(c), F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)


def stem(c) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base_name(c), r"(?<=.)\.[^.]*$", "")


def folded_stem(c) -> Column:
    return F.lower(stem(c))


def asset_id(path) -> Column:
    """Readable stem plus ten hex digits of the path's SHA-1."""
    safe = F.regexp_replace(stem(path), r"[^A-Za-z0-9_-]+", "_")
    safe = F.regexp_replace(safe, r"^_+|_+$", "")
    safe = F.when(safe == "", F.lit("video")).otherwise(safe)
    return F.concat_ws("_", safe, F.substring(F.sha1(normal_path(path).cast("binary")), 1, 10))


def frame_id(path, seconds) -> Column:
    ms = F.bround(_col(seconds).cast("double") * 1000).cast("long")
    return F.sha1(F.concat(normal_path(path), F.lit("_"), ms.cast("string")).cast("binary"))


def event_id(video, rule, track) -> Column:
    number = F.substring_index(_col(track).cast("string"), ":", -1)
    rule = F.lit(rule) if isinstance(rule, str) else rule
    return F.concat(_col(video).cast("string"), F.lit(":"), rule, F.lit(":"), number)


def segment_id(video, number) -> Column:
    return F.concat(_col(video).cast("string"), F.lit("_seg"), F.format_string("%03d", _col(number).cast("int")))


def short_event_id(c) -> Column:
    """v:type:v:n becomes v:type:n; every other id stays as it is."""
    parts = F.split(_col(c), ":")
    old = (F.size(parts) == 4) & (F.try_element_at(parts, F.lit(1)) == F.try_element_at(parts, F.lit(3)))
    new = F.concat_ws(":", F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(4)))
    return F.when(old, new).otherwise(_col(c))


def frame_name_parts(path) -> Column:
    """struct(name, seconds) of `{name}_{seconds}.ext`; seconds 0 where they do not parse."""
    s = stem(path)
    has = s.contains("_")
    tail = F.substring_index(s, "_", -1)
    head = F.when(has, F.regexp_extract(s, r"(?s)^(.*)_[^_]*$", 1)).otherwise(s)
    seconds = F.when(has, F.coalesce(tail.try_cast("double"), F.lit(0.0))).otherwise(0.0)
    return F.struct(head.alias("name"), seconds.alias("seconds"))


def frame_file_name(name, seconds) -> Column:
    safe = F.regexp_replace(text_or_empty(name), r"[^\p{L}\p{N}_-]", "_")
    return F.concat(safe, F.lit("_"), F.format_string("%.2f", _col(seconds).cast("double")), F.lit(".jpg"))


def display_time(seconds) -> Column:
    whole = F.floor(_col(seconds).cast("double")).cast("long")
    h, m, s = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    short = F.format_string("%02d:%02d", m.cast("long"), s)
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h.cast("long"), m.cast("long"), s)).otherwise(short)


def label_zh(c) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LABEL_ZH.items() for x in pair])
    return F.coalesce(F.try_element_at(names, _col(c)), _col(c))


def segment_text(video, start, description, classes=None, read=None) -> Column:
    """Description, else what was detected and read, else a numbered placeholder; never empty."""
    classes, read = F.trim(text_or_empty(classes if classes is not None else F.lit(""))), F.trim(text_or_empty(read if read is not None else F.lit("")))
    description = F.trim(text_or_empty(description))
    found = F.concat_ws(
        "，",
        F.when(classes != "", F.concat(F.lit("检测到 "), classes)),
        F.when(read != "", F.concat(F.lit("识别到文本 "), read)),
    )
    blank = F.concat(F.lit("视频片段_"), _col(video).cast("string"), F.lit("_"), _col(start).cast("string"))
    return F.when(description != "", description).when(found != "", found).otherwise(blank)


def percent_encoded(c) -> Column:
    return F.replace(F.url_encode(text_or_empty(c)), F.lit("+"), F.lit("%20"))


def clip_url(path, start, end, event_type) -> Column:
    """Download link of a clip of at least one second."""
    start, stop = _col(start).cast("double"), F.greatest(_col(end).cast("double"), _col(start).cast("double") + 1.0)
    kind = F.when(text_or_empty(event_type) == "", F.lit("clip")).otherwise(text_or_empty(event_type))
    name = F.concat(kind, F.lit("_"), start.cast("string"), F.lit("s"))
    return F.concat(
        F.lit("/api/search/download_clip?video_path="), percent_encoded(path), F.lit("&start_ts="), start.cast("string"),
        F.lit("&end_ts="), stop.cast("string"), F.lit("&output_name="), percent_encoded(name),
    )


def is_ascii_query(c) -> Column:
    """Not blank, and ASCII once spaces, underscores and hyphens are gone."""
    return F.regexp_replace(text_or_empty(c), r"[\s_\-]+", "").rlike(r"^[\x00-\x7F]+$")


def safe_stem(c) -> Column:
    """A name fit for a file: other characters become underscores, none at the ends; at most 80 characters, never empty."""
    clean = F.regexp_replace(F.regexp_replace(text_or_empty(c), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.substring(F.when(clean == "", F.lit("clip")).otherwise(clean), 1, 80)


def without_paths(c, *paths) -> Column:
    """A message without these paths."""
    out = text_or_empty(c)
    for path in paths:
        out = F.when(text_or_empty(path) == "", out).otherwise(F.replace(out, text_or_empty(path), F.lit("<path>")))
    return out


def anchor_seconds(ts, start, end) -> Column:
    ts, start, end = (_col(c).cast("double") for c in (ts, start, end))
    return F.coalesce(ts, (start + end) / 2, start, F.lit(0.0))


def valid_clip(start, end, longest: float = 60.0) -> Column:
    """A clip that ends after it starts and is not too long."""
    start, end = _col(start).cast("double"), _col(end).cast("double")
    return F.coalesce((start >= 0) & (end > start) & (end - start <= longest), F.lit(False))


def under_roots(path, roots: list[str]) -> Column:
    """Whether a path lies below one of the roots (no step upwards in it)."""
    clean = normal_path(path)
    below = F.lit(False)
    for root in roots:
        below = below | clean.startswith(root.replace("\\", "/").lower().rstrip("/") + "/")
    return below & ~clean.contains("/../")


def timestamp_text(explicit, path) -> Column:
    """The explicit time, else the one in the frame's name, else 0.0, as text."""
    found = F.coalesce(_col(explicit).try_cast("double"), frame_name_parts(path)["seconds"])
    return F.coalesce(found, F.lit(0.0)).cast("string")
