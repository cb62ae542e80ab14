"""Operators that string others together: extraction, the worker over recordings, import of a run, report tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from trackloom.functions import exprs
from trackloom.operators import manifest, registry, tracks
from trackloom.operators.labels import confirmed_labels
from trackloom.sources import tables


def extract(
    detections: DataFrame,
    fps: Column,
    width: Column,
    height: Column,
    sample_fps: float = 5.0,
    max_seconds: float | None = None,
    min_area: float = 0.010,
    gate: tuple[float, float] = (0.18, 0.82),
    best: int = 12,
    min_samples: int = 8,
    min_span: float = 0.16,
    min_best: int = 3,
    orientation: str = "left_to_right",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tracks, their best frames and counts by recording from detections that carry a track_id.

    detections: video_id, frame_idx, track_id, det_id, x1, y1, x2, y2,
    confidence and sharpness; null sharpness is none.  Sampled frames of boxes
    that are large enough make the tracks; those whose centre lies in the gate
    compete for the best frames.  A recording all of whose boxes are too small
    still counts its sampled frames.
    """
    sampled = manifest.sampled_frames(detections, fps, sample_fps, max_seconds)
    box = ["x1", "y1", "x2", "y2"]
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / (width * height)
    crowded = tracks.frame_overlap(sampled.where(area >= min_area), ["video_id", "frame_idx"], "det_id", box)
    quality = exprs.frame_quality([F.col(c) for c in box], width, height, F.col("confidence"), F.coalesce("sharpness", F.lit(0.0)), F.col("overlap"), gate)
    seen = crowded.withColumns({"center_x": (F.col("x1") + F.col("x2")) / 2 / width, "timestamp_s": F.col("frame_idx") / fps, "quality": quality})
    keys = ["video_id", "track_id"]
    frames = tracks.best_frames(seen, keys, "quality", "frame_idx", best, ("center_x", *gate))
    chosen = frames.groupBy(*keys).agg(F.count("*").alias("n_best_frames"), F.avg("quality").alias("mean_quality"))
    summary = tracks.track_summary(seen, keys).join(chosen, keys, "left")
    summary = summary.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best_frames", "mean_quality")})
    judged = tracks.judged_tracks(summary, F.col("n_best_frames"), min_samples, min_span, min_best, orientation)
    return judged, frames, extraction_counts(sampled, judged)


def extraction_counts(sampled: DataFrame, judged: DataFrame) -> DataFrame:
    """video_id, sampled_frames, raw_tracks and valid_tracks of every recording with a sampled frame."""
    frames = sampled.groupBy("video_id").agg(F.count_distinct("frame_idx").alias("sampled_frames"))
    found = judged.groupBy("video_id").agg(F.count("*").alias("raw_tracks"), F.count_if("valid").alias("valid_tracks"))
    return frames.join(found, "video_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("raw_tracks", "valid_tracks")})


def advance(videos: DataFrame, tracked: DataFrame, embedded: DataFrame, predictions: DataFrame | None = None, failures: DataFrame | None = None) -> DataFrame:
    """Where each pending recording stands after what is there of its stages: video_id, status, attempts and last_error.

    videos: video_id, status, canonical_video_id.  tracked and embedded name
    recordings whose stage is done, predictions has video_id, is_unknown and
    is_ambiguous, failures video_id and error.  A copy of another recording is
    linked and never worked on.  A stage that is there isn't run again; one that
    failed leaves the state before it and counts an attempt.  A recording is
    assigned only if a prediction is neither unknown nor ambiguous; without a
    gallery (predictions None) it stays pending.
    """
    state = F.col("status")
    done = lambda df, name: df.select("video_id", F.lit(True).alias(name)).distinct()
    rows = videos.where(state.isin(*registry.WORK_STATES)).select("video_id", "status", "canonical_video_id")
    rows = rows.join(done(tracked, "__t"), "video_id", "left").join(done(embedded, "__e"), "video_id", "left")
    if predictions is not None:
        sure = predictions.groupBy("video_id").agg(F.count_if(~F.col("is_unknown") & ~F.col("is_ambiguous")).alias("__sure"))
        rows = rows.join(sure, "video_id", "left")
        end = F.when(F.coalesce("__sure", F.lit(0)) > 0, "ID_ASSIGNED").otherwise("ID_UNRESOLVED")
    else:
        end = F.lit("ID_PENDING")
    if failures is not None:
        rows = rows.join(failures.groupBy("video_id").agg(F.min("error").alias("__error")), "video_id", "left")
    else:
        rows = rows.withColumn("__error", F.lit(None).cast("string"))
    linked = F.col("canonical_video_id").isNotNull() & (F.col("canonical_video_id") != F.col("video_id"))
    after_tracking = F.when((state == "INGESTED") & F.col("__t"), "TRACKED").otherwise(state)
    after_embedding = F.when((after_tracking == "TRACKED") & F.col("__e"), "EMBEDDED").otherwise(after_tracking)
    failed = F.col("__error").isNotNull() & ~linked
    reached = F.when(linked, "DUPLICATE_LINKED").when((after_embedding == "EMBEDDED") & ~failed, end).otherwise(after_embedding)
    return rows.select("video_id", reached.alias("status"), F.when(failed, 1).otherwise(0).alias("attempts"), F.when(failed, F.left("__error", F.lit(4000))).alias("last_error"))


Stage = Callable[[DataFrame], DataFrame]


def process_new(videos: DataFrame, tracked: DataFrame, embedded: DataFrame, extract_stage: Stage, embed_stage: Stage, identify_stage: Stage | None = None) -> DataFrame:
    """advance after running each stage for the recordings that lack it.

    A stage takes the recordings it is for, all at once, and gives video_id and
    error (null where it went well); identify_stage gives predictions.  Each
    stage's result is written once and read from there, so that it runs once.
    """
    own = videos.where(F.coalesce("canonical_video_id", "video_id") == F.col("video_id"))
    todo = own.where("status = 'INGESTED'").join(tracked.select("video_id"), "video_id", "left_anti")
    first = tables.held(extract_stage(todo))
    now_tracked = tracked.select("video_id").unionByName(first.where("error IS NULL").select("video_id")).distinct()
    ready = own.where("status = 'TRACKED'").select("video_id").unionByName(own.where("status = 'INGESTED'").select("video_id").join(now_tracked, "video_id", "left_semi"))
    second = tables.held(embed_stage(own.join(ready, "video_id", "left_semi").join(embedded.select("video_id"), "video_id", "left_anti")))
    now_embedded = embedded.select("video_id").unionByName(second.where("error IS NULL").select("video_id")).distinct()
    failures = first.where("error IS NOT NULL").select("video_id", "error").unionByName(second.where("error IS NOT NULL").select("video_id", "error"))
    predictions = None
    if identify_stage is not None:
        at_end = own.where("status = 'EMBEDDED'").select("video_id").unionByName(ready.join(now_embedded, "video_id", "left_semi")).distinct()
        predictions = tables.held(identify_stage(own.join(at_end, "video_id", "left_semi")))
    return advance(videos, now_tracked, now_embedded, predictions, failures)


def queue(videos: DataFrame) -> DataFrame:
    """Pending recordings in the order of work: by state, then by when they came."""
    order = F.array_position(F.array(*map(F.lit, registry.WORK_STATES)), F.col("status"))
    return videos.where(F.col("status").isin(*registry.WORK_STATES)).orderBy(order, "created_at", "video_id")


def assigned_tracklets(tracklets: DataFrame, labels: DataFrame, entities: DataFrame) -> DataFrame:
    """Registered tracklets with the entity_uuid of the identity their label is confirmed for; others keep theirs."""
    named = confirmed_labels(labels).select("tracklet_id", "entity_id").dropDuplicates(["tracklet_id"])
    own = named.join(entities.select(F.col("display_id").alias("entity_id"), F.col("entity_uuid").alias("__new")), "entity_id").select("tracklet_id", "__new")
    old = F.col("entity_uuid") if "entity_uuid" in tracklets.columns else F.lit(None).cast("string")
    return tracklets.join(own, "tracklet_id", "left").withColumn("entity_uuid", F.coalesce("__new", old)).drop("__new")


def import_run(known: dict[str, DataFrame], run: dict[str, DataFrame], version: str) -> dict[str, DataFrame]:
    """Rows that an import of a run adds to tracklets, embeddings, entities and edges, the tracklets with their entities, and counts.

    known: the registry's tables of those names and videos; run: tracklets,
    embeddings, labels, pair_reviews and label_audit.  An import that is run
    again adds nothing.
    """
    new = {
        "tracklets": registry.new_tracklets(known["tracklets"], run["tracklets"]),
        "embeddings": registry.new_embeddings(known["embeddings"], run["embeddings"], version),
        "edges": registry.new_edges(known["edges"], run["pair_reviews"]),
    }
    conflicts = run["label_audit"].where("status = 'conflict'").select("entity_id")
    labels = confirmed_labels(run["labels"])
    new["entities"] = registry.new_identities(known["entities"], registry.identity_states(labels, known["videos"], conflicts))
    all_tracks = known["tracklets"].unionByName(new["tracklets"], allowMissingColumns=True)
    new["assigned"] = assigned_tracklets(all_tracks, labels, known["entities"].unionByName(new["entities"], allowMissingColumns=True))
    count = lambda n: new[n].agg(F.count("*").alias(n))
    new["counts"] = count("tracklets").join(count("embeddings")).join(count("entities")).join(count("edges"))  # a row each
    return new


def event_payloads(events: DataFrame) -> DataFrame:
    """event_id, operation, payload and inverse (JSON): what an event did and what takes it back."""
    merge, split = F.col("operation") == "merge", F.col("operation") == "split"
    payload = F.when(merge, F.to_json(F.struct("sources", "target"))).when(split, F.to_json(F.struct(F.element_at("sources", 1).alias("source"), "target", "tracklets")))
    inverse = F.when(merge, F.to_json(F.struct(F.col("target").alias("from"), F.array_remove("sources", F.col("target")).alias("restore")))).when(split, F.to_json(F.struct(F.col("target").alias("from"), F.element_at("sources", 1).alias("to"), "tracklets")))
    return events.where(merge | split).select("event_id", "operation", payload.alias("payload"), inverse.alias("inverse"))


def report_members(tracklets: DataFrame, assignments: DataFrame | None) -> DataFrame:
    """Valid tracks with the cluster, similarity and review mark of their track and session; all UNCLUSTERED where nothing is clustered."""
    valid = tracklets.where(F.coalesce("valid", F.lit(False)))
    if assignments is None:
        return valid.withColumns({"pseudo_id": F.lit("UNCLUSTERED"), "similarity_to_cluster": F.lit(0.0), "needs_review": F.lit(True)})
    return valid.join(assignments.select("tracklet_id", "session_id", "pseudo_id", "similarity_to_cluster", "needs_review"), ["tracklet_id", "session_id"], "left")


def report_counts(members: DataFrame) -> DataFrame:
    """pseudo_id, tracklets, sessions and mean_quality of every cluster, tracks without one as the null cluster."""
    return members.groupBy("pseudo_id").agg(F.count("*").alias("tracklets"), F.count_distinct("session_id").alias("sessions"), F.avg("mean_quality").alias("mean_quality"))


def best_tracks(tracklets: DataFrame, n: int) -> DataFrame:
    """The n valid tracks of the highest mean quality."""
    return tracklets.where(F.coalesce("valid", F.lit(False))).orderBy(F.col("mean_quality").desc_nulls_last(), "tracklet_id").limit(n)


def least_consistent(tracklets: DataFrame, n: int) -> DataFrame:
    """The n tracks whose frames look least alike, those that aren't known left out."""
    return tracklets.where("appearance_consistency IS NOT NULL").orderBy("appearance_consistency", "tracklet_id").limit(n)


def split_frames(split: DataFrame, frames: DataFrame, files: DataFrame | None = None, path_col: str = "torso_path") -> DataFrame:
    """The frames of split tracks, those whose file is in a listing (path) where one is given."""
    joined = split.join(frames.select("tracklet_id", "rank", *([path_col] if path_col in frames.columns else [])), "tracklet_id")
    if files is None:
        return joined
    return joined.join(files.select(F.col("path").alias(path_col)).distinct(), path_col, "left_semi")


#: The encoder that needs a checkpoint of its own kind, and that kind.
OWN_ENCODER, OWN_KIND = "metric", "metric_resnet50"


def check_backend(backend: str, kind: str) -> None:
    """Raises where the one encoder with checkpoints of its own kind gets another's, or another one gets its."""
    if (backend == OWN_ENCODER) != (kind == OWN_KIND):
        raise ValueError(f"the encoder {backend} can't take a checkpoint of kind {kind}")
