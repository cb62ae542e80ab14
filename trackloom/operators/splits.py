"""Leakage-safe splits by recording date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed value: a recording's split -> its tracks' split.
TRACK_SPLITS = {"train": "train", "validation": "val", "test": "test"}


def _checked(bad: DataFrame, message: str) -> None:
    """Raises if bad has a row; one row at most reaches the driver."""
    if bad.head(1):
        raise ValueError(message)


def _dated(manifest: DataFrame, start_col: str) -> DataFrame:
    return manifest.withColumn("recording_date", F.to_date(start_col).cast("string"))


def _unverified(manifest: DataFrame) -> Column:
    return F.coalesce("overlap_unverified", F.lit(False)) if "overlap_unverified" in manifest.columns else F.lit(False)


def date_split(manifest: DataFrame, test_dates: Sequence[str], validation_dates: Sequence[str] = (), start_col: str = "recording_start", group_col: str = "overlap_group_id") -> DataFrame:
    """manifest with recording_date and split: test, validation or train.

    Rows without a verified date train.  A date in both lists, a listed date
    without rows, or a group in two splits is an error.
    """
    tests, validations = set(map(str, test_dates)), set(map(str, validation_dates))
    if tests & validations:
        raise ValueError("a date is in both lists")
    dated = _dated(manifest, start_col)
    listed = lambda dates: F.col("recording_date").isin(*sorted(dates)) if dates else F.lit(False)
    held = F.when(_unverified(manifest) | F.col("recording_date").isNull(), "train").when(listed(tests), "test").when(listed(validations), "validation").otherwise("train")
    out = dated.withColumn("split", held)
    if tests | validations:
        spark = manifest.sparkSession
        asked = spark.createDataFrame([(d,) for d in sorted(tests | validations)], "recording_date string")
        _checked(asked.join(dated.select("recording_date"), "recording_date", "left_anti"), "a listed date has no recording")
    if group_col in manifest.columns:
        crossing = out.where(F.coalesce(F.col(group_col).cast("string"), F.lit("")) != "").groupBy(group_col).agg(F.count_distinct("split").alias("n")).where("n > 1")
        _checked(crossing, "an overlap group crosses dataset splits")
    return out


def last_day_split(manifest: DataFrame, start_col: str = "recording_start", group_col: str = "overlap_group_id") -> DataFrame:
    """date_split with the last verified date as validation; one date reaches the driver."""
    last = _dated(manifest, start_col).where(~_unverified(manifest)).agg(F.max("recording_date")).first()[0]
    if last is None:
        raise ValueError("no recording has a verified date")
    return date_split(manifest, [], [last], start_col, group_col)


def track_split(labels: DataFrame, tracks: DataFrame, videos: DataFrame, flagged: DataFrame | None = None, open_set: Sequence[str] = ()) -> DataFrame:
    """tracklet_id, entity_id, session_id, video_id, split of labelled tracks, by their recording's split.

    Identities of open_set are apart; of the others those with tracks in both
    train and val stay.  If none does although there were any, it fails.
    """
    own = labels.withColumn("entity_id", F.trim("entity_id")).where("entity_id <> ''")
    for flag in ("confirmed", "training_eligible"):
        if flag in own.columns:
            own = own.where(F.coalesce(flag, F.lit(False)))
    own = own.select("tracklet_id", "entity_id").dropDuplicates(["tracklet_id"])
    if flagged is not None:
        own = own.join(flagged.select("tracklet_id"), "tracklet_id", "left_anti")
    placed = own.join(tracks.select("tracklet_id", "session_id", "video_id").dropDuplicates(["tracklet_id"]), "tracklet_id").join(videos.select("video_id", F.col("split").alias("__v")).dropDuplicates(["video_id"]), "video_id").where("__v IS NOT NULL")
    names = F.create_map(*(F.lit(x) for p in TRACK_SPLITS.items() for x in p))
    apart = F.col("entity_id").isin(*open_set) if open_set else F.lit(False)
    split = placed.withColumn("split", F.when(apart, "open_set_test").otherwise(F.coalesce(F.try_element_at(names, F.col("__v")), F.lit("train")))).drop("__v")
    both = split.where("split IN ('train', 'val')").groupBy("entity_id").agg(F.count_distinct("split").alias("n")).where("n = 2").select("entity_id")
    kept = split.join(both, "entity_id", "left_semi").unionByName(split.where("split = 'open_set_test'"))
    state = split.agg(F.count("*").alias("n"), F.count_if(F.expr("split <> 'open_set_test'")).alias("c")).join(both.agg(F.count("*").alias("b")))
    _checked(state.where("n = 0 OR (c > 0 AND b = 0)"), "no identity has tracks on a train day and on a validation day")
    return kept.select("tracklet_id", "entity_id", "session_id", "video_id", "split")
