"""Measured signals over an entity's life: summaries, baselines and alerts."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from trackloom.functions import exprs, windows

#: Names a score may have, the landmarks of a back in order, and the factor from a median deviation to a standard one.
SCORE_NAMES = ("arch_score", "posture_score", "hunch_score", "score")
BACK = ("withers", "thoracic_spine", "dorsal_apex", "lumbar_spine", "sacrum")
TO_SIGMA = 1.4826


def score_column(df: DataFrame) -> str:
    for name in SCORE_NAMES:
        if name in df.columns:
            return name
    raise ValueError(f"scores need one of {SCORE_NAMES}")


def posture_summary(scores: DataFrame, key: str = "tracklet_id", score: str | None = None) -> DataFrame:
    """A row for each key with a numeric score: mean, median, p90, max, sample std (0 for one), count, valid_frame_ratio, mad, uncertainty.

    The ratio counts all rows of the key.  The deviation takes a second
    aggregation, so that no key's rows are gathered.
    """
    value = exprs.number(F.col(score or score_column(scores)).cast("string"))
    own = scores.select(key, value.alias("__v"))
    first = own.groupBy(key).agg(
        F.avg("__v").alias("mean"), F.percentile("__v", F.lit(0.5)).alias("median"), F.percentile("__v", F.lit(0.9)).alias("p90"), F.max("__v").alias("max"),
        F.coalesce(F.stddev_samp("__v"), F.lit(0.0)).alias("std"), F.count("__v").alias("n_scored"), (F.count("__v") / F.count("*")).alias("valid_frame_ratio"),
    ).where("n_scored > 0")
    mads = windows.grouped_median_mad(own.where("__v IS NOT NULL"), [key], "__v").select(key, "mad")
    return first.join(mads, key).withColumn("uncertainty", TO_SIGMA * F.col("mad") / F.sqrt(F.greatest("n_scored", F.lit(1))))


def feature_summary(values: DataFrame, key: str, value: str, total: str | None = None) -> DataFrame:
    """median, p90, population standard_deviation, valid_frame_count, valid_frame_ratio and uncertainty of finite values; the total is the stated one if larger."""
    v = F.col(value).cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    own = values.select(key, finite.alias("__v"), (F.col(total) if total else F.lit(None).cast("bigint")).alias("__t"))
    first = own.groupBy(key).agg(F.percentile("__v", F.lit(0.5)).alias("median"), F.percentile("__v", F.lit(0.9)).alias("p90"), F.stddev_pop("__v").alias("standard_deviation"), F.count("__v").alias("valid_frame_count"), F.max("__t").alias("__t")).where("valid_frame_count > 0")
    mads = windows.grouped_median_mad(own.where("__v IS NOT NULL"), [key], "__v").select(key, "mad")
    ratio = F.col("valid_frame_count") / F.greatest(F.coalesce("__t", "valid_frame_count"), F.col("valid_frame_count"))
    return first.join(mads, key).withColumns({"valid_frame_ratio": ratio, "uncertainty": TO_SIGMA * F.col("mad") / F.sqrt("valid_frame_count")}).drop("__t", "mad")


def arch_score(points: Column) -> Column:
    """Greatest distance of ordered points (x, y) from the chord between the ends, by the chord's length; null for fewer than three or a chord of none."""
    def score(p: Column) -> Column:
        a, b = F.element_at(p, 1), F.element_at(p, -1)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        square = dx * dx + dy * dy
        most = F.array_max(F.transform(p, lambda q: F.abs(dx * (q["y"] - a["y"]) - dy * (q["x"] - a["x"]))))
        return F.when(F.sqrt(square) > 1e-9, most / square)

    return F.when(F.size(points) >= 3, F.transform(F.array(points), score)[0])


def frame_scores(keypoints: DataFrame, landmarks: Sequence[str] = BACK, min_visibility: float = 0.25) -> DataFrame:
    """tracklet_id, frame_idx, arch_score and model of frames with all landmarks, none less visible than the bar; unknown visibility passes."""
    own = keypoints.where(F.col("keypoint_name").isin(*landmarks))
    order = F.array_position(F.array(*map(F.lit, landmarks)), F.col("keypoint_name"))
    frames = own.groupBy("tracklet_id", "frame_idx").agg(
        F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("x_px").alias("x"), F.col("y_px").alias("y")))).alias("p"), F.count_distinct("keypoint_name").alias("n"),
        F.count_if(F.col("visibility") < min_visibility).alias("hidden"), F.min("timestamp_s").alias("timestamp_s"), F.min("model_name").alias("model_name"), F.min("model_version").alias("model_version"),
    )
    good = frames.where((F.col("n") == len(landmarks)) & (F.col("hidden") == 0))
    return good.withColumn("arch_score", arch_score(F.col("p"))).where("arch_score IS NOT NULL").select("tracklet_id", "frame_idx", "timestamp_s", "arch_score", "model_name", "model_version")


def frame_reasons(points: Column, required: Sequence[str], occlusion: Column, jump: Column, scale: Column, min_visibility: float = 0.5) -> Column:
    """Why a frame's points (a map of name to struct x, y, visibility) can't be used; an empty array if they can."""
    at = lambda n: F.try_element_at(points, F.lit(n))
    hidden, missing = F.lit(False), F.lit(False)
    for n in required:
        hidden = hidden | at(n).isNull() | (at(n)["visibility"] < min_visibility)
        missing = missing | at(n).isNull()
    rising = falling = F.lit(True)
    for a, b in zip(required, required[1:]):
        rising, falling = rising & (at(a)["x"] <= at(b)["x"]), falling & (at(a)["x"] >= at(b)["x"])
    #: fixed values: the reasons and their bars
    checks = {"low_visibility": hidden, "occlusion": occlusion > 0.35, "tracker_jump": jump, "implausible_scale_change": ~scale.between(0.65, 1.55), "anatomical_order": ~missing & ~(rising | falling)}
    return F.array_compact(F.array(*(F.when(c, n) for n, c in checks.items())))


def reason_counts(reasons: DataFrame, column: str = "reasons") -> DataFrame:
    """reason and n: how many frames each reason keeps out."""
    return reasons.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


#: A baseline's time line is cut into spans of this many windows.
SPAN = 4


def baseline(observations: DataFrame, keys: Sequence[str], time: str = "observed_at", value: str = "value", window_days: int = 30, min_days: int = 3, epsilon: float = 1e-6) -> DataFrame:
    """Rows with a time and a value, with baseline, mad, baseline_day_count, delta and robust_z.

    The baseline is the median of the key's values in the window before the row,
    its time and later ones left out; null unless they fall on min_days dates.
    A key's time line is cut into spans of SPAN windows, each with a copy of the
    window before it, so a key of many rows is several tasks.
    """
    own = observations.where(F.col(time).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    window = window_days * 86_400_000_000
    span = lambda us: F.floor(us / F.lit(SPAN * window))
    timed = own.withColumn("__us", exprs.micros(F.col(time)))
    here, later = span(F.col("__us")), span(F.col("__us") + window)
    spread = timed.withColumn("__span", F.explode(F.when(later > here, F.array(here, later)).otherwise(F.array(here))))
    frame = Window.partitionBy(*keys, "__span").orderBy("__us").rangeBetween(-window, -1)
    days = F.size(F.collect_set(F.to_date(time)).over(frame))
    held = spread.withColumns({"baseline_day_count": days, "__values": F.collect_list(F.col(value).cast("double")).over(frame)}).where(F.col("__span") == here).drop("__span")
    enough = F.col("baseline_day_count") >= min_days
    median = held.withColumn("baseline", F.when(enough, windows.array_median(F.col("__values"))))
    mad = median.withColumn("mad", F.when(enough, windows.array_mad(F.col("__values"), F.col("baseline"))))
    delta = mad.withColumn("delta", F.col(value) - F.col("baseline"))
    return delta.withColumn("robust_z", F.col("delta") / (TO_SIGMA * F.col("mad") + epsilon)).drop("__us", "__values")


def alerts(rows: DataFrame, keys: Sequence[str], *order: Column, z: str = "robust_z", ratio: str | None = "valid_frame_ratio", uncertainty: str | None = "uncertainty", z_threshold: float = 3.0, min_ratio: float = 0.6, max_uncertainty: float = 0.05) -> DataFrame:
    """rows with status: REVIEW_NEEDED where two of a key's last three rows are usable and deviate, else OK."""
    usable = F.coalesce(F.abs(z) >= z_threshold, F.lit(False))
    if ratio:
        usable = usable & (F.coalesce(ratio, F.lit(0.0)) >= min_ratio)
    if uncertainty:
        usable = usable & (F.coalesce(uncertainty, F.lit(float("inf"))) <= max_uncertainty)
    last = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-2, 0)
    flagged = rows.withColumn("__flag", usable.cast("int"))
    return flagged.withColumn("status", F.when((F.count("*").over(last) == 3) & (F.sum("__flag").over(last) >= 2), "REVIEW_NEEDED").otherwise("OK")).drop("__flag")


def history(rows: DataFrame, keys: Sequence[str], value: str, *order: Column, min_values: int = 3) -> DataFrame:
    """rows with observation_order, personal_baseline (median of all earlier values, from min_values) and delta_from_baseline.

    Nulls are no values; NaN counts as infinity.  A pass over the sorted rows
    keeps the lower and the upper half of a key's values in two heaps, so a key
    of n rows takes n log n steps.
    """
    own = Window.partitionBy(*keys).orderBy(*order)
    numbered = rows.withColumns({"observation_order": F.row_number().over(own), "__v": F.col(value).cast("double")})
    schema = T.StructType([*numbered.schema.fields, T.StructField("personal_baseline", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: list[float] = []  # negated
        high: list[float] = []
        last = 0
        for batch in batches:
            out = []
            for n, v in zip(batch.column("observation_order").to_pylist(), batch.column("__v").to_pylist(), strict=True):
                if n == 1:
                    low, high = [], []
                elif n != last + 1:
                    raise RuntimeError("a key's rows don't come in order")
                last = n
                size = len(low) + len(high)
                out.append(None if size < min_values or not size else -low[0] if size % 2 else (high[0] - low[0]) / 2)
                if v is None:
                    continue
                heapq.heappush(high, -heapq.heappushpop(low, -(math.inf if math.isnan(v) else v)))
                if len(high) > len(low):
                    heapq.heappush(low, -heapq.heappop(high))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "personal_baseline"])

    out = numbered.mapInArrow(run, schema).drop("__v")
    return out.withColumn("delta_from_baseline", F.col(value) - F.col("personal_baseline"))


def import_scores(scores: DataFrame, tracks: DataFrame, labels: DataFrame, manifest: DataFrame | None, existing: DataFrame | None = None, source: str = "", sequence: str | None = None) -> DataFrame:
    """Observations of the tracks' scores, appended to existing ones; an observation of the same track and model stays as it was.

    The model is the first one named, in the order of sequence; without one, the
    least name.
    """
    score = score_column(scores)
    numeric = scores.where(exprs.number(F.col(score).cast("string")).isNotNull())
    default = lambda c, d: numeric.where(F.col(c).isNotNull()).agg(F.coalesce(F.min_by(c, F.struct(sequence, c)) if sequence else F.min(c), F.lit(d)).alias(c)) if c in scores.columns else numeric.sparkSession.range(1).select(F.lit(d).alias(c))
    model = default("model_name", "keypoint_model").join(default("model_version", "unknown"))  # a row each
    place = tracks.select("tracklet_id", "video_id", "session_id", "start_s").dropDuplicates(["tracklet_id"])
    joined = posture_summary(scores, "tracklet_id", score).join(place, "tracklet_id", "left").join(labels.select("tracklet_id", exprs.normal_id(F.col("entity_id")).alias("entity_id")).dropDuplicates(["tracklet_id"]), "tracklet_id", "left")
    time = F.lit("")
    if manifest is not None:
        start = F.coalesce(*(F.col(c).cast("string") for c in ("recording_start", "recording_timestamp", "camera_timestamp") if c in manifest.columns), F.lit(None).cast("string"))
        joined = joined.join(manifest.select("video_id", start.alias("__start")).dropDuplicates(["video_id"]), "video_id", "left")
        time = exprs.plus_seconds(F.col("__start"), F.col("start_s"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    new = joined.join(F.broadcast(model)).select(  # one row
        "tracklet_id", text("entity_id"), text("video_id"), text("session_id"), time.alias("observed_at"), F.col("mean").alias("score_mean"), F.col("median").alias("score_median"), F.col("p90").alias("score_p90"),
        F.col("max").alias("score_max"), F.col("std").alias("score_std"), F.col("n_scored").alias("n_scored_frames"), "valid_frame_ratio", F.col("uncertainty").alias("measurement_uncertainty"), "model_name", "model_version", F.lit(source).alias("source_scores"),
    )
    if existing is None:
        return new
    return existing.unionByName(new.join(existing.select("tracklet_id", "model_name", "model_version").distinct(), ["tracklet_id", "model_name", "model_version"], "left_anti"), allowMissingColumns=True)


def with_current_identity(observations: DataFrame, labels: DataFrame) -> DataFrame:
    """Observations under the identity their track is confirmed for now."""
    now = labels.where(F.coalesce("confirmed", F.lit(False))).select("tracklet_id", exprs.normal_id(F.col("entity_id")).alias("__e")).dropDuplicates(["tracklet_id"])
    return observations.join(now, "tracklet_id", "left").withColumn("entity_id", F.coalesce("__e", F.lit(""))).drop("__e")


def health_summaries(observations: DataFrame, keys: Sequence[str] = ("entity_id", "model_name", "model_version"), time: str = "observed_at", value: str = "score_median", window_days: int = 30, min_days: int = 3, **bars) -> DataFrame:
    """Baseline and alert status of every observation of a known entity, by entity and model."""
    known = observations.where(F.col(keys[0]).isNotNull() & (F.col(keys[0]).cast("string") != ""))
    return alerts(baseline(known, keys, time, value, window_days, min_days), keys, F.col(time), **bars)
