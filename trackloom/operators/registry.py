"""Event-sourced registry of recordings and identities.

Nothing is updated in place: changes are appended events with a sequence
number, and the current state is a view that replays them.  Replay is a window
over each recording or track, so it is as parallel as the keys are many.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from trackloom.functions import exprs, windows
from trackloom.sources.tables import anti_append

#: States of identities and recordings, and of a recording's work in order.
IDENTITY_STATES = ("provisional", "visual_confirmed", "stable_visual", "external_linked", "ambiguous", "retired")
WORK_STATES = ("INGESTED", "TRACKED", "EMBEDDED")
END_STATES = ("ID_PENDING", "ID_ASSIGNED", "ID_UNRESOLVED", "DUPLICATE_LINKED")

VIDEO_EVENTS = "seq long, video_id string, kind string, expected string, target string, error string"
IDENTITY_EVENTS = "seq long, event_id string, operation string, target string, sources array<string>, tracklets array<string>, reviewer string, undoes string"


def ingest(videos: DataFrame, found: DataFrame, camera: str) -> DataFrame:
    """New recordings of a scan: those whose hash isn't registered, one of each hash, as INGESTED."""
    new = anti_append(videos, windows.keep_one(found, ["sha256"], F.col("path")), ["sha256"])
    return new.withColumns({"camera_id": F.lit(camera), "status": F.lit("INGESTED")})


def video_states(videos: DataFrame, events: DataFrame) -> DataFrame:
    """video_id, status, attempts and last_error after all events.

    A transition holds only where its expected state is the current one, as a
    compare-and-set: the fold walks a recording's few events in order.
    """
    logs = events.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "expected", "target", "error"))).alias("log"))
    start = F.struct(F.col("status").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error"))

    def step(s, e):
        holds = (e["kind"] == "transition") & (e["expected"] == s["status"])
        failed = e["kind"] == "error"
        return F.struct(
            F.when(holds, e["target"]).otherwise(s["status"]).alias("status"),
            (s["attempts"] + F.when(holds | failed, 1).otherwise(0)).alias("attempts"),
            F.when(failed, F.left(e["error"], F.lit(4000))).when(holds, e["error"]).otherwise(s["last_error"]).alias("last_error"),
        )

    replayed = videos.select("video_id", "status").join(logs, "video_id", "left").select("video_id", F.aggregate(F.coalesce("log", F.array().cast("array<struct<seq:bigint,kind:string,expected:string,target:string,error:string>>")), start, step).alias("s"))
    return replayed.select("video_id", "s.*")


def pending(videos: DataFrame, events: DataFrame, status: str = "INGESTED") -> DataFrame:
    return video_states(videos, events).where(F.col("status") == status).join(videos.drop("status"), "video_id").orderBy("created_at", "video_id")


def model_version(name: str, sha256: str) -> str:
    return f"{name}:{sha256[:16]}"


def register_models(models: DataFrame | None, found: DataFrame) -> DataFrame:
    """The versions that found (model_name, checkpoint_sha256, code_commit, config_hash) adds to models, one row each; of rows of one version that of the least commit and config."""
    version = F.concat_ws(":", "model_name", F.left("checkpoint_sha256", F.lit(16)))
    rows = windows.keep_one(found.withColumn("model_version", version), ["model_version"], F.struct("code_commit", "config_hash"))
    rows = rows.select("model_version", "model_name", "checkpoint_sha256", "code_commit", "config_hash")
    return rows if models is None else anti_append(models, rows, ["model_version"])


def register_model(models: DataFrame, name: str, sha256: str, code: str = "unknown", config: str = "unknown") -> DataFrame:
    row = models.sparkSession.createDataFrame([(model_version(name, sha256), name, sha256, code, config)], "model_version string, model_name string, checkpoint_sha256 string, code_commit string, config_hash string")
    return anti_append(models, row, ["model_version"])


def new_tracklets(registered: DataFrame, tracks: DataFrame) -> DataFrame:
    """Rows to add to the registry: known columns, the others as JSON, pending or rejected by valid."""
    own = ("tracklet_id", "video_id", "start_s", "end_s", "direction", "flank", "mean_quality")
    rest = [c for c in tracks.columns if c not in own]
    text = lambda c: exprs.blank_to_null(F.col(c).cast("string")) if c in tracks.columns else F.lit(None).cast("string")
    zero = lambda c: F.coalesce(exprs.number(F.col(c).cast("string")), F.lit(0.0)) if c in tracks.columns else F.lit(0.0)
    valid = F.coalesce("valid", F.lit(True)) if "valid" in tracks.columns else F.lit(True)
    rows = tracks.select(
        "tracklet_id", "video_id", zero("start_s").alias("start_s"), zero("end_s").alias("end_s"), text("direction").alias("direction"), text("flank").alias("flank"), zero("mean_quality").alias("quality_score"),
        F.when(valid, "pending").otherwise("rejected").alias("review_state"), (F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias("metadata_json"),
    )
    return anti_append(registered, rows, ["tracklet_id"])


def new_embeddings(registered: DataFrame, embeddings: DataFrame, version: str) -> DataFrame:
    rows = embeddings.select("tracklet_id", F.lit(version).alias("model_version"), F.col("embedding").cast("array<float>").alias("embedding"), F.size("embedding").alias("dimensions"))
    named = rows.withColumn("embedding_id", exprs.uuid5_url(F.concat_ws(":", "tracklet_id", "model_version")))
    return anti_append(registered, named, ["tracklet_id", "model_version"])


def identity_states(labels: DataFrame, videos: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """entity_id, dates and identity_state by the days an identity is seen on: three make it stable, two confirmed; conflicts are ambiguous."""
    dates = videos.select("video_id", F.to_date("recording_start").alias("d"))
    seen = labels.join(dates, "video_id", "left").groupBy("entity_id").agg(F.count_distinct("d").alias("dates"))
    state = F.when(F.col("dates") >= 3, "stable_visual").when(F.col("dates") >= 2, "visual_confirmed").otherwise("provisional")
    if conflicts is None:
        return seen.withColumn("identity_state", state)
    marked = seen.join(conflicts.select("entity_id", F.lit(True).alias("__c")).distinct(), "entity_id", "left")
    return marked.withColumn("identity_state", F.when(F.col("__c"), "ambiguous").otherwise(state)).drop("__c")


def new_identities(entities: DataFrame, states: DataFrame) -> DataFrame:
    rows = states.select(exprs.uuid5_url(F.concat(F.lit("entity:"), "entity_id")).alias("entity_uuid"), F.col("entity_id").alias("display_id"), "identity_state")
    return anti_append(entities, rows, ["display_id"])


def new_edges(edges: DataFrame, reviews: DataFrame) -> DataFrame:
    """Review decisions as edges with sorted ends and a name made of them."""
    left, right = F.least("left_id", "right_id"), F.greatest("left_id", "right_id")
    rows = reviews.select(exprs.uuid5_url(F.concat_ws(":", F.lit("edge"), left, right, "decision")).alias("edge_id"), left.alias("left_id"), right.alias("right_id"), "decision", "similarity")
    return anti_append(edges, rows, ["edge_id"])


def override_times(videos: DataFrame, overrides: DataFrame) -> DataFrame:
    """videos with manual times for every row of overrides, and overlap groups found anew."""
    from trackloom.operators.manifest import overlap_groups

    new = overrides.select("video_id", F.col("recording_start").alias("__s"), F.col("recording_end").alias("__e"), F.lit(True).alias("__m")).dropDuplicates(["video_id"])
    manual = F.col("__m").isNotNull()
    joined = videos.join(new, "video_id", "left").withColumns({
        "recording_start": F.when(manual, F.col("__s")).otherwise(F.col("recording_start")), "recording_end": F.when(manual, F.col("__e")).otherwise(F.col("recording_end")),
        "timestamp_source": F.when(manual, "manual").otherwise(F.col("timestamp_source")), "timestamp_confidence": F.when(manual, 1.0).otherwise(F.col("timestamp_confidence")),
    }).drop("__s", "__e", "__m", "overlap_group_id", "canonical_video_id", "overlap_unverified")
    return overlap_groups(joined)


def effective_events(events: DataFrame) -> DataFrame:
    """Merges and splits that no later event undoes."""
    undone = events.where("operation = 'undo'").select(F.col("undoes").alias("event_id")).distinct()
    return events.where("operation IN ('merge', 'split')").join(undone, "event_id", "left_anti")


def replay(assignments: DataFrame, events: DataFrame) -> DataFrame:
    """tracklet_id, entity_id after all effective events, in the order of seq.

    A merge moves all tracks of its sources to its target, a split moves the
    tracks it names from its source to its target.  Where the merges lead is
    found once for each identity; only tracks that a split names walk through
    the log themselves.
    """
    effective = effective_events(events)
    merges = effective.where("operation = 'merge'").select("seq", F.explode("sources").alias("source"), "target").where("source <> target")
    chain = merges.agg(F.array_sort(F.collect_list(F.struct("seq", "source", "target"))).alias("chain"))
    splits = effective.where("operation = 'split'").select("seq", F.explode("tracklets").alias("tracklet_id"), F.element_at("sources", 1).alias("source"), "target")
    own = splits.groupBy("tracklet_id").agg(F.array_sort(F.collect_list(F.struct("seq", "source", "target"))).alias("own"))
    none = F.array().cast("array<struct<seq:bigint,source:string,target:string>>")

    def walked(rows: DataFrame, log) -> DataFrame:
        step = lambda at, e: F.when(at == e["source"], e["target"]).otherwise(at)
        return rows.join(F.broadcast(chain)).withColumn("final", F.aggregate(log, F.col("entity_id"), step))  # one row: the log of human merges

    moved = walked(assignments.select("entity_id").distinct(), F.coalesce("chain", none)).select("entity_id", "final")
    named = walked(assignments.join(own, "tracklet_id"), F.array_sort(F.concat("own", F.coalesce("chain", none))))
    rest = assignments.join(own.select("tracklet_id"), "tracklet_id", "left_anti").join(moved, "entity_id", "left")
    return rest.select("tracklet_id", F.coalesce("final", "entity_id").alias("entity_id")).unionByName(named.select("tracklet_id", F.col("final").alias("entity_id")))


def identity_view(entities: DataFrame, events: DataFrame) -> DataFrame:
    """display_id, identity_state and alias_of: sources of effective merges, and identities that an undone split made, are retired."""
    effective = effective_events(events)
    merged = effective.where("operation = 'merge'").select(F.explode("sources").alias("display_id"), F.col("target").alias("t"), "seq").where("display_id <> t").groupBy("display_id").agg(F.max_by("t", "seq").alias("alias_of"))
    undone = events.where("operation = 'undo'").select(F.col("undoes").alias("event_id")).distinct()
    unmade = events.where("operation = 'split'").join(undone, "event_id", "left_semi").select(F.col("target").alias("display_id"), F.lit(True).alias("unmade")).distinct()
    joined = entities.join(merged, "display_id", "left").join(unmade, "display_id", "left")
    return joined.select("display_id", F.when(F.col("alias_of").isNotNull() | F.col("unmade"), "retired").otherwise(F.col("identity_state")).alias("identity_state"), "alias_of")


def merge_conflicts(assignments: DataFrame, edges: DataFrame, entities: Sequence[str]) -> DataFrame:
    """Active "different" edges with both ends among the tracks of the entities."""
    members = assignments.where(F.col("entity_id").isin(*entities)).select("tracklet_id")
    side = lambda c: members.select(F.col("tracklet_id").alias(c)).distinct()
    return edges.where("decision = 'different' AND superseded_by IS NULL").join(side("left_id"), "left_id", "left_semi").join(side("right_id"), "right_id", "left_semi")


def _event(events: DataFrame, event_id: str, operation: str, target=None, sources=(), tracklets=(), reviewer="manual", undoes=None) -> DataFrame:
    seq = (events.agg(F.max("seq")).first()[0] or 0) + 1
    return events.unionByName(events.sparkSession.createDataFrame([(seq, event_id, operation, target, list(sources), list(tracklets), reviewer, undoes)], IDENTITY_EVENTS))


def merge(entities: DataFrame, assignments: DataFrame, edges: DataFrame, events: DataFrame, sources: Sequence[str], target: str, event_id: str, resolve: bool = False, reviewer: str = "manual") -> tuple[DataFrame, DataFrame]:
    """Events and edges after a merge; with resolve it supersedes the edges in its way, else they forbid it."""
    names = sorted({*sources, target})
    if entities.where(F.col("display_id").isin(*names)).count() != len(names):
        raise ValueError("an identity doesn't exist")
    conflicts = merge_conflicts(replay(assignments, events), edges, names)
    ids = [r["edge_id"] for r in conflicts.select("edge_id").collect()]
    if ids and not resolve:
        raise ValueError(f"recorded as different: {ids}")
    superseded = edges.withColumn("superseded_by", F.when(F.col("edge_id").isin(*ids), event_id).otherwise(F.col("superseded_by"))) if ids else edges
    return _event(events, event_id, "merge", target, names, reviewer=reviewer), superseded


def split(entities: DataFrame, assignments: DataFrame, events: DataFrame, source: str, tracklets: Sequence[str], new: str, event_id: str, reviewer: str = "manual") -> tuple[DataFrame, DataFrame]:
    """Entities and events after tracks of source become an identity of their own."""
    chosen = sorted(set(tracklets))
    if not chosen:
        raise ValueError("a split needs a track")
    own = replay(assignments, events).where((F.col("entity_id") == source) & F.col("tracklet_id").isin(*chosen)).count()
    if own != len(chosen):
        raise ValueError("a track isn't the source's")
    return create(entities, new), _event(events, event_id, "split", new, [source], chosen, reviewer)


def create(entities: DataFrame, name: str, state: str = "provisional") -> DataFrame:
    if state not in IDENTITY_STATES:
        raise ValueError(f"state must be one of {IDENTITY_STATES}")
    if entities.where(F.col("display_id") == name).count():
        raise ValueError(f"{name} exists already")
    return entities.unionByName(entities.sparkSession.createDataFrame([(name, state)], "display_id string, identity_state string"), allowMissingColumns=True)


def undo(events: DataFrame, edges: DataFrame, event_id: str, undo_id: str) -> tuple[DataFrame, DataFrame]:
    """Events and edges after the last effective operation is undone; the operation stays in the log.

    Only the latest effective operation may be undone, so that an undo never
    moves tracks that a later operation placed.
    """
    if not events.where((F.col("event_id") == event_id) & F.col("operation").isin("merge", "split")).count():
        raise ValueError(f"unknown operation {event_id}")
    last = effective_events(events).orderBy(F.col("seq").desc()).select("event_id").head(1)
    if not last or last[0][0] != event_id:
        undone = events.where((F.col("operation") == "undo") & (F.col("undoes") == event_id)).count()
        raise ValueError("it is undone already" if undone else "undo later operations first")
    free = edges.withColumn("superseded_by", F.when(F.col("superseded_by") == event_id, F.lit(None)).otherwise(F.col("superseded_by")))
    return _event(events, undo_id, "undo", undoes=event_id), free


def next_step(video: dict, has_gallery: bool, known: int = 0, ambiguous: int = 0) -> list[tuple[str, str]]:
    """Transitions (expected, target) that a recording goes through from its state."""
    state, canonical = video["status"], video.get("canonical_video_id")
    if canonical and canonical != video["video_id"]:
        return [(state, "DUPLICATE_LINKED")]
    end = ("ID_ASSIGNED" if known - ambiguous > 0 else "ID_UNRESOLVED") if has_gallery else "ID_PENDING"
    path = [*WORK_STATES, end]
    return list(zip(path[path.index(state) :], path[path.index(state) + 1 :])) if state in WORK_STATES else []


def latest_state(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    return windows.latest_wins(rows, [key], sequence)


def running_state(rows: DataFrame, key: str, sequence: str, value: str) -> DataFrame:
    """rows with the value of the same key just before."""
    return rows.withColumn("previous", F.lag(value).over(Window.partitionBy(key).orderBy(sequence)))
