"""Column builders: scalar functions as expressions that stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: Texts of booleans, identity prefix, session hours, weekdays, OCR and file-name patterns.
TRUE_TEXTS = ("true", "1", "yes", "y", "on")
FALSE_TEXTS = ("false", "0", "no", "n", "off")
ID_PREFIX = "COW"
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
OVERLAY_TIME = r"(\d{1,2})-(\d{1,2})-(\d{4}).*?(\d{1,2}):(\d{2}):(\d{2})"
OVERLAY_WEEKDAY = r"(?i)\b(Mon|Tue|Wed|Thu|Fri|Sat|Sun)\b"
OVERLAY_FROM, OVERLAY_TO = "—–_OoIl|", "---00111"
FILE_TIME = r"(?i)(20\d{2})[-_](\d{1,2})[-_](\d{1,2}).*?(?:\bat\b|\bsaat\b)[\s_-]*(\d{1,2})[.\-_:](\d{2})[.\-_:](\d{2})"
PIECES = 6


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a timestamp of either kind."""
    return F.unix_micros(time.cast("timestamp"))


def seconds(time: Column) -> Column:
    return micros(time) / 1e6


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def bool_text(value: Column, default: bool = False) -> Column:
    """A boolean that arrives as text; what isn't one, and null, is default."""
    text = F.lower(stripped(value.cast("string")))
    return F.coalesce(F.when(text.isin(*TRUE_TEXTS), True).when(text.isin(*FALSE_TEXTS), False), F.lit(default))


def bool_number(value: Column, default: bool = False) -> Column:
    """A boolean that arrives as a number: anything but zero."""
    return F.coalesce(value != 0, F.lit(default))


def normal_id(value: Column, prefix: str = ID_PREFIX) -> Column:
    """'cow 7', 'COW-07' and the like become COW_0007; other texts are trimmed, null is empty."""
    text = F.coalesce(stripped(value.cast("string")), F.lit(""))
    digits = F.regexp_extract(text, rf"(?i)^{prefix}[\s_-]*0*([0-9]+)$", 1)
    return F.when(digits != "", F.format_string(f"{prefix}_%04d", digits.try_cast("bigint"))).otherwise(text)


def id_number(value: Column, prefix: str = ID_PREFIX) -> Column:
    """The number of a normal id, null for other ids."""
    return F.regexp_extract(value, rf"(?i)^{prefix}_([0-9]+)$", 1).try_cast("bigint")


def blank_to_null(text: Column) -> Column:
    return F.when(stripped(text) != "", text)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def number(value: Column) -> Column:
    """Numeric coercion: text that isn't a number, and NaN, is null."""
    return nan_to_null(value.try_cast("double"))


def session_type(hour: Column) -> Column:
    return (
        F.when(hour.isNull(), "unknown")
        .when((hour >= 5) & (hour < 10), "morning")
        .when((hour >= 12) & (hour < 18), "afternoon")
        .when((hour >= 20) | (hour < 3), "night")
        .otherwise("other")
    )


def session_id(camera: Column, start: Column, fallback: Column) -> Column:
    named = F.concat_ws("_", camera, F.date_format(start, "yyyyMMdd"), session_type(F.hour(start)))
    return F.when(start.isNull(), fallback).otherwise(named)


def _timestamp(text: Column, pattern: str, order: Sequence[int]) -> Column:
    found = [F.regexp_extract(text, pattern, i + 1).try_cast("int") for i in range(PIECES)]
    year, month, day, hour, minute, second = (found[i] for i in order)
    valid = (hour < 24) & (minute < 60) & (second < 60)
    return F.when(valid, F.try_make_timestamp(year, month, day, hour, minute, second.cast("decimal(8,6)")))


def overlay_time(text: Column) -> Column:
    """Date and time of a camera overlay read by OCR; null where it can't be, or where the weekday disagrees."""
    when = _timestamp(F.translate(text, OVERLAY_FROM, OVERLAY_TO), OVERLAY_TIME, (2, 0, 1, 3, 4, 5))
    day = F.lower(F.regexp_extract(text, OVERLAY_WEEKDAY, 1))
    expected = F.when(day != "", F.array_position(F.array(*map(F.lit, WEEKDAYS)), day) - 1)
    return F.when(F.year(when).between(2000, 2100) & (expected.isNull() | (F.weekday(when) == expected)), when)


def file_time(name: Column) -> Column:
    """Date and time in the stem of an exported file's name."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return _timestamp(stem, FILE_TIME, (0, 1, 2, 3, 4, 5))


def sample_offsets(duration: Column, count: int = 3) -> Column:
    """Seconds at which a recording is sampled."""
    margin, middle = F.least(F.lit(1.0), duration / 10), duration / 2
    few = F.lit(count <= 1) | (duration <= 2 * margin)
    return F.when(duration <= 0, F.array(F.lit(0.0))).when(few, F.array(middle)).otherwise(F.array(margin, middle, F.greatest(margin, duration - margin)))


def overlap_seconds(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    """Length of what two intervals share; 0 where an end is missing."""
    shared = micros(F.least(end1, end2)) - micros(F.greatest(start1, start2))
    known = start1.isNotNull() & end1.isNotNull() & start2.isNotNull() & end2.isNotNull()
    return F.when(known, F.greatest(F.lit(0.0), shared / 1e6)).otherwise(0.0)


def plus_seconds(text: Column, seconds: Column) -> Column:
    """Text of a time seconds later, to whole seconds; empty where either is missing or unreadable."""
    moved = F.try_to_timestamp(text) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return F.coalesce(F.date_format(moved, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def evidence_window(start: Column, end: Column, duration: Column | None = None, padding: float = 2.0) -> tuple[Column, Column]:
    low = F.greatest(F.lit(0.0), start - padding)
    high = end + padding if duration is None else F.least(end + padding, F.coalesce(duration, end + padding))
    return low, F.greatest(low, high)


def pair_key(left: Column, right: Column) -> Column:
    return F.concat_ws("||", F.least(left, right), F.greatest(left, right))


def short_sha1(text: Column, prefix: str = "", length: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(text.cast("binary")), 1, length))


def content_id(sha256: Column, prefix: str = "vid_") -> Column:
    return F.concat(F.lit(prefix), F.substring(sha256, 1, 12))


def annotation(entity: Column, status: Column, similarity: Column, first: Column, second: Column) -> Column:
    """Label of an overlay."""
    name = F.coalesce(blank_to_null(entity), F.lit("UNKNOWN"))
    predicted = F.concat(name, F.lit(" · PREDICTED · similarity="), F.format_string("%.3f", similarity))
    return F.when((status == "PREDICTED") & similarity.isNotNull(), predicted).when((status == "AMBIGUOUS") & first.isNotNull(), F.concat(F.lit("AMBIGUOUS · "), first, F.lit(" / "), second)).otherwise(name)


#: The URL namespace of name-based UUIDs, and what its variant bits make of a hexadecimal digit.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
VARIANT_FROM, VARIANT_TO = "0123456789abcdef", "89ab89ab89ab89ab"


def uuid5_url(text: Column) -> Column:
    """Name-based UUIDs (version 5) in the URL namespace: the SHA-1 of namespace and name with the version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), text.cast("binary")))
    part = lambda a, n: F.substring(h, a + 1, n)
    return F.concat_ws("-", part(0, 8), part(8, 4), F.concat(F.lit("5"), part(13, 3)), F.concat(F.translate(part(16, 1), VARIANT_FROM, VARIANT_TO), part(17, 3)), part(20, 12))


def cache_key(*values: Column, length: int = 12) -> Column:
    """A short name of what a made file depends on: the SHA-1 of the values as JSON."""
    return short_sha1(F.to_json(F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values)))), length=length)


def rescaled(value: Column, low: Column, high: Column, size: float) -> Column:
    """A coordinate of a picture scaled to size, back in the frame from which low to high was cut."""
    return value * ((high - low) / size) + low


def in_body(value: Column, low: Column, length: Column) -> Column:
    """A coordinate from a box's edge in body lengths, at least one pixel long."""
    return (value - low) / F.greatest(F.lit(1.0), length)


# vectors ------------------------------------------------------------------


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    return F.transform(F.array(F.greatest(F.sqrt(dot(vector, vector)), F.lit(1e-12))), lambda n: F.transform(doubles(vector), lambda x: x / n))[0]


# boxes (x1, y1, x2, y2) -----------------------------------------------------


def box_iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return wide * high / F.greatest(F.lit(1e-12), area(a) + area(b) - wide * high)


def clipped_box(box: Sequence[Column], width: Column, height: Column) -> list[Column]:
    """Whole pixels inside the image, at least one wide and high; halves round to even."""
    low = lambda v, most: F.greatest(F.lit(0), F.least(most - 1, F.bround(v, 0).cast("int")))
    x, y = low(box[0], width), low(box[1], height)
    return [x, y, F.greatest(x + 1, F.least(width, F.bround(box[2], 0).cast("int"))), F.greatest(y + 1, F.least(height, F.bround(box[3], 0).cast("int")))]


def grown_box(box: Sequence[Column], width: Column, height: Column, x: float = 0.06, y: float = 0.08) -> list[Column]:
    w, h = box[2] - box[0], box[3] - box[1]
    return clipped_box([box[0] - w * x, box[1] - h * y, box[2] + w * x, box[3] + h * y], width, height)


def torso_box(box: Sequence[Column], width: Column, height: Column, orientation: str = "left_to_right") -> list[Column]:
    """The part of a side view between the shoulders and the rump."""
    w, h = box[2] - box[0], box[3] - box[1]
    left, right = (0.22, 0.08) if orientation == "right_to_left" else (0.08, 0.22)
    return clipped_box([box[0] + left * w, box[1] + 0.04 * h, box[2] - right * w, box[1] + 0.76 * h], width, height)


def parsed_box(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: x.try_cast("double"))


def clip01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def scaled_round(value: Column, places: int) -> Column:
    """A double rounded by scaling it first; F.round goes by its shortest decimal text, which differs at halves."""
    return F.round(value * 10.0**places) / 10.0**places


def frame_quality(box: Sequence[Column], width: Column, height: Column, confidence: Column, sharpness: Column, overlap: Column, gate: tuple[float, float] = (0.18, 0.82)) -> Column:
    """How well a frame shows its subject, 0 to 1: confidence, centring, size, sharpness and margins, less overlap.

    The gate's middle and radius are those of its decimals (0.32 for 0.18 to
    0.82, not the double below it), and the area is a share of the picture
    before it is weighed: frames whose qualities are equal on paper then differ
    in the last bit, and so in rank, wherever they do by that formula.
    """
    middle, radius = round((gate[0] + gate[1]) / 2, 12), max(0.05, round((gate[1] - gate[0]) / 2, 12))
    centre = clip01(1 - F.abs((box[0] + box[2]) / 2 / width - middle) / radius)
    area = clip01((box[2] - box[0]) * (box[3] - box[1]) / (width * height) / 0.12)
    edge = clip01(F.least(box[0] / width, (width - box[2]) / width, box[1] / height, (height - box[3]) / height) / 0.03)
    return clip01(0.30 * clip01(confidence) + 0.22 * centre + 0.18 * area + 0.17 * sharpness + 0.13 * edge - 0.35 * clip01(overlap))
