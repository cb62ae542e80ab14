"""Queries of the composed operators: over events a recording is a user, a track a user's events of one type; over embeddings a track is vec_id // 7."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import exprs
from trackloom.operators import bundle, cluster, labels as ids, merging, manifest, posture, registry, similarity as sim, workflow as wf
from trackloom.plans import similarity_queries
from trackloom.plans.session import table
from trackloom.sources import tables


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")


def _text(name):
    return F.col(name).cast("string")


# extraction ----------------------------------------------------------------


def _extracted(spark, sf):
    e = _events(spark, sf)
    boxes = e.select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_idx"), F.col("event_type").alias("track_id"), F.col("event_id").alias("det_id"),
        (F.col("value") * 6).alias("x1"), F.lit(40.0).alias("y1"), (F.col("value") * 6 + 30 + F.col("event_id") % 60).alias("x2"), F.lit(140.0).alias("y2"),
        ((F.col("event_id") % 10) / 10).alias("confidence"), F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 7) / 7).alias("sharpness"),
    )
    return wf.extract(boxes, F.lit(15.0), F.lit(800.0), F.lit(240.0), min_area=0.02)


EXTRACT = """WITH d AS (SELECT user_id AS video_id, event_id AS f, event_type AS track_id, value * 6 AS x1, value * 6 + 30 + event_id % 60 AS x2, event_id % 10 / 10 AS conf, CASE WHEN event_id % 3 > 0 THEN event_id % 7 / 7 ELSE 0 END AS sharp FROM events WHERE event_id % 3 = 0),
b AS (SELECT *, (x1 + x2) / 2 / 800 AS cx, (x2 - x1) * 100.0 / (800 * 240) AS area FROM d WHERE (x2 - x1) * 100.0 / (800 * 240) >= 0.02),
q AS (SELECT *, greatest(0, least(1, 0.30 * greatest(0, least(1, conf)) + 0.22 * greatest(0, least(1, 1 - abs(cx - 0.5) / 0.32)) + 0.18 * greatest(0, least(1, area / 0.12)) + 0.17 * sharp
      + 0.13 * greatest(0, least(1, least(x1 / 800, (800 - x2) / 800, 40 / 240, 100 / 240) / 0.03)))) AS q FROM b),
k AS (SELECT * FROM q WHERE cx BETWEEN 0.18 AND 0.82 QUALIFY row_number() OVER (PARTITION BY video_id, track_id ORDER BY q DESC, f) <= 12),
n AS (SELECT video_id, track_id, count(*) AS n_best_frames, avg(q) AS mean_quality FROM k GROUP BY ALL),
t AS (SELECT video_id, track_id, count(*) AS n_frames, (max(cx::FLOAT) - min(cx::FLOAT))::DOUBLE AS span, (arg_max(cx::FLOAT, f) - arg_min(cx::FLOAT, f))::DOUBLE AS dx FROM q GROUP BY ALL),
j AS (SELECT t.*, coalesce(n_best_frames, 0) AS n_best_frames, coalesce(mean_quality, 0) AS mean_quality FROM t LEFT JOIN n USING (video_id, track_id)),
v AS (SELECT *, n_frames >= 8 AND span >= 0.16 AND dx >= 0.35 * 0.16 AND n_best_frames >= 3 AS valid FROM j)"""


def extract_tracks(spark, sf):
    rows = _extracted(spark, sf)[0]
    return rows.select("video_id", "track_id", "n_frames", "n_best_frames", F.round("span", 6).alias("span"), exprs.scaled_round(F.col("mean_quality"), 9).alias("mean_quality"), "valid")


def extract_frames(spark, sf):
    return _extracted(spark, sf)[1].select("video_id", "track_id", "rank", "frame_idx", exprs.scaled_round(F.col("quality"), 9).alias("quality"))


def extract_counts(spark, sf):
    return _extracted(spark, sf)[2]


def frame_reason_counts(spark, sf):
    l = table(spark, sf, "lineitem")
    reasons = F.array_compact(F.array(F.when(F.col("l_tax") > 0.06, "occlusion"), F.when(F.col("l_discount") < 0.03, "low_visibility"), F.when(F.col("l_linenumber") == 7, "tracker_jump")))
    return posture.reason_counts(l.select(reasons.alias("reasons")))


# embeddings ----------------------------------------------------------------


def _tracks(spark, sf):
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 7).cast("long").alias("t")).distinct()
    return e.select(F.concat(F.lit("t"), "t").alias("tracklet_id"), F.concat(F.lit("s"), F.col("t") % 5).alias("session_id"), F.concat(F.lit("v"), F.col("t") % 11).alias("video_id"), (F.col("t") % 4 > 0).alias("valid"), F.lit("c1").alias("crop_version"), "t")


def track_embeddings(spark, sf):
    e = table(spark, sf, "embeddings")
    frames = e.select(F.concat(F.lit("t"), F.floor(F.col("vec_id") / 7).cast("long")).alias("tracklet_id"), "embedding", F.slice("embedding", 49, 16).alias("geometry_embedding"), ((F.col("vec_id") % 10) / 10).alias("quality"))
    tracks = _tracks(spark, sf)
    rows = sim.track_embeddings(frames, tracks, tracks.where("t % 11 = 5"), "b", "c", "0a", "p")
    return rows.select("tracklet_id", "session_id", "video_id", "backend", "crop_version", "embedding_schema_version", "frames_used", F.round("mean_frame_quality", 6).alias("mean_frame_quality"), F.round(F.element_at("embedding", 7).cast("double"), 5).alias("e7"), F.round(F.element_at("geometry_embedding", 3).cast("double"), 5).alias("g3"))


TRACK_EMBEDDINGS = """WITH f AS (SELECT vec_id // 7 AS t, embedding::DOUBLE[] AS v, greatest(vec_id % 10 / 10, 0.05) AS w, vec_id % 10 / 10 AS q FROM embeddings WHERE (vec_id // 7) % 4 > 0 AND (vec_id // 7) % 11 <> 5),
u AS (SELECT t, w, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM f),
m AS (SELECT t, dim, sum(w * x) / sum(w) AS x FROM u GROUP BY ALL),
n AS (SELECT t, max(x) FILTER (dim = 7) / sqrt(sum(x * x)) AS e7, max(x) FILTER (dim = 51) / sqrt(sum(x * x) FILTER (dim >= 49)) AS g3, count(*) AS size FROM m GROUP BY t),
c AS (SELECT t, count(*) AS frames_used, avg(q) AS q FROM f GROUP BY t)
SELECT 't' || t AS tracklet_id, 's' || (t % 5) AS session_id, 'v' || (t % 11) AS video_id, 'b' AS backend, 'c1' AS crop_version, size || 'd_1' AS embedding_schema_version, frames_used, round(q, 6) AS mean_frame_quality, round(e7::FLOAT::DOUBLE, 5) AS e7, round(g3::FLOAT::DOUBLE, 5) AS g3 FROM n JOIN c USING (t)"""


def gallery(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("n"), _text("vec_id").alias("tracklet_id"), "embedding", F.lit("b").alias("backend"), "label")
    own = e.select("tracklet_id", F.when(F.col("n") % 5 > 0, F.concat(F.lit("E"), "label")).otherwise(" ").alias("entity_id"), (F.col("n") % 3 > 0).alias("confirmed"), (F.col("n") % 7 > 0).alias("training_eligible"))
    tracks = e.where("n % 2 = 0").select("tracklet_id", F.lit("left").alias("flank"), F.when(F.col("n") % 4 == 0, "cam").alias("view"))
    rows = sim.build_gallery(own, e.drop("label", "n"), tracks, e.where("n % 11 = 0").select("tracklet_id"))
    return rows.select("entity_id", "tracklet_id", "flank", "view", "domain", "backend", F.round(F.element_at("prototype", 1), 6).alias("p1"))


def prototype_summary(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    ranks = sim.prototype_retrieval(e.where("id % 4 <> 0"), e.where("id % 4 = 0"))
    return sim.rank_summary(ranks).select("queries", F.round("top1", 6).alias("top1"), F.round("mean_ap", 6).alias("mean_ap"))


def cluster_sizes(spark, sf):
    return cluster.cluster_sizes(table(spark, sf, "embeddings").select(F.concat_ws("-", "label", F.floor(F.col("vec_id") / 30)).alias("pseudo_id")))


# report, worker and registry -------------------------------------------------


def _members(spark, sf):
    e = _events(spark, sf)
    tracks = e.select(_text("event_id").alias("tracklet_id"), _text("user_id").alias("session_id"), (F.col("event_id") % 4 > 0).alias("valid"), F.col("value").alias("mean_quality"))
    found = e.where("event_id % 5 > 0").select(_text("event_id").alias("tracklet_id"), F.when(F.col("event_id") % 6 > 0, _text("user_id")).otherwise("other").alias("session_id"), F.col("event_type").alias("pseudo_id"), (F.col("value") / 100).alias("similarity_to_cluster"), (F.col("event_id") % 2 == 0).alias("needs_review"))
    return wf.report_members(tracks, found)


def report_members(spark, sf):
    return _members(spark, sf).select("tracklet_id", "session_id", "pseudo_id", "needs_review")


def report_counts(spark, sf):
    return wf.report_counts(_members(spark, sf)).withColumn("mean_quality", F.round("mean_quality", 6))


MEMBERS = "m AS (SELECT event_id, user_id, value, CASE WHEN event_id % 5 > 0 AND event_id % 6 > 0 THEN event_type END AS pseudo_id, CASE WHEN event_id % 5 > 0 AND event_id % 6 > 0 THEN event_id % 2 = 0 END AS needs_review FROM events WHERE event_id % 4 > 0)"


def _queue(spark, sf):
    state = F.element_at(F.array(*map(F.lit, ("INGESTED", "TRACKED", "EMBEDDED", "ID_ASSIGNED"))), (F.col("event_id") % 4 + 1).cast("int"))
    return _events(spark, sf).select(_text("event_id").alias("video_id"), state.alias("status"), F.when(F.col("event_id") % 9 == 0, _text("user_id")).when(F.col("event_id") % 9 == 1, _text("event_id")).alias("canonical_video_id"), F.col("ts").alias("created_at"), "event_id")


def worker_states(spark, sf):
    v = _queue(spark, sf)
    guesses = v.where("event_id % 7 > 1").select("video_id", (F.col("event_id") % 5 < 2).alias("is_unknown"), (F.col("event_id") % 5 == 2).alias("is_ambiguous"))
    failures = v.where("event_id % 13 = 0").select("video_id", F.lit("no frames").alias("error"))
    return wf.advance(v, v.where("event_id % 3 > 0"), v.where("event_id % 5 > 0"), guesses, failures)


WORKER = """WITH v AS (SELECT event_id AS i, CASE event_id % 4 WHEN 0 THEN 'INGESTED' WHEN 1 THEN 'TRACKED' ELSE 'EMBEDDED' END AS s, CASE WHEN event_id % 9 = 0 THEN user_id WHEN event_id % 9 = 1 THEN event_id END AS c FROM events WHERE event_id % 4 < 3),
t AS (SELECT *, c IS NOT NULL AND c <> i AS linked, CASE WHEN s = 'INGESTED' AND i % 3 > 0 THEN 'TRACKED' ELSE s END AS s1 FROM v),
e AS (SELECT *, CASE WHEN s1 = 'TRACKED' AND i % 5 > 0 THEN 'EMBEDDED' ELSE s1 END AS s2, i % 13 = 0 AND NOT linked AS failed FROM t)
SELECT i::VARCHAR AS video_id, CASE WHEN linked THEN 'DUPLICATE_LINKED' WHEN s2 = 'EMBEDDED' AND NOT failed THEN CASE WHEN i % 7 > 1 AND i % 5 > 2 THEN 'ID_ASSIGNED' ELSE 'ID_UNRESOLVED' END ELSE s2 END AS status, failed::INT AS attempts, CASE WHEN failed THEN 'no frames' END AS last_error FROM e"""


def worker_process(spark, sf):
    """The loop over all stages: extraction fails for each thirteenth, embedding for each seventeenth; no gallery."""
    v = _queue(spark, sf)
    stage = lambda n: lambda df: df.select("video_id", F.when(F.col("event_id") % n == 0, f"stage {n}").alias("error"))
    return wf.process_new(v, v.where("event_id % 3 = 1"), v.where("event_id % 5 = 1"), stage(13), stage(17))


PROCESS = """WITH v AS (SELECT event_id AS i, CASE event_id % 4 WHEN 0 THEN 'INGESTED' WHEN 1 THEN 'TRACKED' ELSE 'EMBEDDED' END AS s, CASE WHEN event_id % 9 = 0 THEN user_id WHEN event_id % 9 = 1 THEN event_id END AS c FROM events WHERE event_id % 4 < 3),
a AS (SELECT *, c IS NOT NULL AND c <> i AS linked, s = 'INGESTED' AND i % 3 <> 1 AND i % 13 = 0 AS f1 FROM v),
b AS (SELECT *, CASE WHEN s = 'INGESTED' AND NOT f1 THEN 'TRACKED' ELSE s END AS s1 FROM a),
d AS (SELECT *, s1 = 'TRACKED' AND i % 5 <> 1 AND i % 17 = 0 AS f2 FROM b)
SELECT i::VARCHAR AS video_id, CASE WHEN linked THEN 'DUPLICATE_LINKED' WHEN f1 OR f2 THEN s1 ELSE 'ID_PENDING' END AS status, (NOT linked AND (f1 OR f2))::INT AS attempts, CASE WHEN linked THEN NULL WHEN f1 THEN 'stage 13' WHEN f2 THEN 'stage 17' END AS last_error FROM d"""


def work_queue(spark, sf):
    return wf.queue(_queue(spark, sf)).select("video_id", "status")


def pending_recordings(spark, sf):
    e = _events(spark, sf)
    videos = e.groupBy(_text("user_id").alias("video_id")).agg(F.min("ts").alias("created_at")).withColumn("status", F.lit("INGESTED"))
    steps = e.select(F.col("event_id").alias("seq"), _text("user_id").alias("video_id"), F.lit("transition").alias("kind"), F.when(F.col("event_id") % 2 == 0, "INGESTED").otherwise("TRACKED").alias("expected"), F.when(F.col("event_id") % 2 == 0, "TRACKED").otherwise("INGESTED").alias("target"), F.lit(None).cast("string").alias("error"))
    return registry.pending(videos, steps, "TRACKED").select("video_id", "status", "created_at")


U5 = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({}))"


def _uuid(name: str) -> str:
    h = U5.format(name)
    return f"{h}[1:8] || '-' || {h}[9:12] || '-5' || {h}[14:16] || '-' || translate({h}[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || {h}[18:20] || '-' || {h}[21:32]"


def name_uuids(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", exprs.uuid5_url(F.concat(F.lit("é:"), "c_name")).alias("id"))


def _registered(spark, sf):
    """A run over events: a track an event, an identity user and event_id % 3; half of the tracks and some identities are known already."""
    e = _events(spark, sf)
    name = F.concat_ws("_", F.lit("E"), "user_id", F.col("event_id") % 3)
    run = {
        "tracklets": e.select(_text("event_id").alias("tracklet_id"), _text("user_id").alias("video_id"), F.col("value").alias("start_s"), (F.col("event_id") % 4 > 0).alias("valid"), (F.col("event_id") % 9).alias("n_frames")),
        "embeddings": e.select(_text("event_id").alias("tracklet_id"), F.array(F.col("value"), F.lit(1.0)).alias("embedding")),
        "labels": e.select(_text("event_id").alias("tracklet_id"), F.when(F.col("event_id") % 7 > 0, name).otherwise("").alias("entity_id"), (F.col("event_id") % 5 > 0).alias("confirmed"), _text("user_id").alias("video_id")),
        "pair_reviews": e.select(_text("event_id").alias("left_id"), (F.col("event_id") + 1 - F.col("event_id") % 3).cast("string").alias("right_id"), F.when(F.col("event_id") % 2 == 0, "same").otherwise("different").alias("decision"), F.col("value").alias("similarity")),
        "label_audit": e.where("user_id % 10 = 0").select(name.alias("entity_id"), F.lit("conflict").alias("status")).distinct(),
    }
    known = {
        "videos": e.groupBy(_text("user_id").alias("video_id")).agg(F.min("ts").alias("recording_start")),
        "tracklets": e.where("event_id % 2 = 0").select(_text("event_id").alias("tracklet_id")),
        "embeddings": e.where("event_id % 3 = 0").select(_text("event_id").alias("tracklet_id"), F.lit("m:1").alias("model_version")),
        "entities": e.where("user_id % 4 = 0 AND event_id % 3 = 1 AND event_id % 5 > 0 AND event_id % 7 > 0").select(name.alias("display_id"), F.concat(F.lit("old-"), name).alias("entity_uuid")).distinct(),
        "edges": spark.createDataFrame([], "edge_id string"),
    }
    return wf.import_run(known, run, "m:1")


def import_tracklets(spark, sf):
    return _registered(spark, sf)["tracklets"].select("tracklet_id", "video_id", F.round("start_s", 6).alias("start_s"), "quality_score", "review_state", "metadata_json")


def import_embeddings(spark, sf):
    return _registered(spark, sf)["embeddings"].select("tracklet_id", "model_version", "dimensions", "embedding_id")


def import_entities(spark, sf):
    return _registered(spark, sf)["entities"]


def import_assigned(spark, sf):
    return _registered(spark, sf)["assigned"].select("tracklet_id", "entity_uuid")


def import_edges(spark, sf):
    return _registered(spark, sf)["edges"].select("edge_id", "left_id", "right_id", "decision")


def import_counts(spark, sf):
    return _registered(spark, sf)["counts"]


REG = """e AS (SELECT *, 'E_' || user_id || '_' || (event_id % 3) AS name, event_id % 7 > 0 AND event_id % 5 > 0 AS named FROM events),
old AS (SELECT DISTINCT name FROM e WHERE user_id % 4 = 0 AND event_id % 3 = 1 AND named),
ent AS (SELECT name, any_value(user_id) AS u FROM e WHERE named AND name NOT IN (SELECT name FROM old) GROUP BY 1)"""
EDGES = "r AS (SELECT DISTINCT least(event_id::VARCHAR, (event_id + 1 - event_id % 3)::VARCHAR) AS left_id, greatest(event_id::VARCHAR, (event_id + 1 - event_id % 3)::VARCHAR) AS right_id, CASE WHEN event_id % 2 = 0 THEN 'same' ELSE 'different' END AS decision FROM events)"


def register_models(spark, sf):
    """A model for each event type, the checkpoint hash that of its name; of those of odd length one is there before, and a second registration adds nothing."""
    types = table(spark, sf, "events").select("event_type").distinct()
    sha = F.sha2("event_type", 256)
    found = types.select(F.col("event_type").alias("model_name"), sha.alias("checkpoint_sha256"), F.lit("c1").alias("code_commit"), F.lit("f1").alias("config_hash"))
    before = registry.register_models(None, found.where("length(model_name) % 2 = 1").withColumn("code_commit", F.lit("c0")))
    once = before.unionByName(registry.register_models(before, found.unionByName(found)))
    return once.unionByName(registry.register_models(once, found))


def event_payloads(spark, sf):
    e = _events(spark, sf)
    kind = F.element_at(F.array(*map(F.lit, ("merge", "split", "undo"))), (F.col("event_id") % 3 + 1).cast("int"))
    events = e.select(_text("event_id").alias("event_id"), kind.alias("operation"), F.concat(F.lit("n"), "event_id").alias("target"), F.array(_text("user_id"), F.concat(F.lit("n"), "event_id")).alias("sources"), F.array(_text("event_id")).alias("tracklets"))
    return wf.event_payloads(events)


def registry_conflicts(spark, sf):
    e = _events(spark, sf)
    own = e.select(_text("event_id").alias("tracklet_id"), F.concat(F.lit("u"), "user_id").alias("entity_id"))
    edges = e.select(F.concat(F.lit("e"), "event_id").alias("edge_id"), _text("event_id").alias("left_id"), (F.col("event_id") + 3).cast("string").alias("right_id"), F.when(F.col("event_id") % 2 == 0, "different").otherwise("same").alias("decision"), F.when(F.col("event_id") % 5 == 0, "m1").alias("superseded_by"))
    return registry.merge_conflicts(own, edges, [f"u{n}" for n in range(0, 60)]).select("edge_id", "left_id", "right_id")


# recordings ------------------------------------------------------------------


def _recordings(spark, sf):
    e = _events(spark, sf)
    return e.select(_text("event_id").alias("video_id"), (F.col("user_id") % 8).alias("camera_id"), F.col("ts").alias("recording_start"), (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("recording_end"), F.lit("camera_ocr").alias("timestamp_source"), F.lit(0.5).alias("timestamp_confidence"), "event_id")


def time_overrides(spark, sf):
    """Each fifth recording gets a start at midnight of its day; groups are found anew."""
    v = _recordings(spark, sf)
    day = F.date_trunc("day", "recording_start")
    new = v.where("event_id % 5 = 0").select("video_id", day.alias("recording_start"), (day + F.expr("INTERVAL 10 SECONDS")).alias("recording_end"))
    return registry.override_times(v, new).select("video_id", "recording_start", "timestamp_source", "timestamp_confidence", "overlap_group_id", "canonical_video_id")


def canonical_manifest(spark, sf):
    """Corrections of every fifth recording, then groups; every seventh is a copy of the one before."""
    v = _recordings(spark, sf).withColumn("duplicate_of", F.when(F.col("event_id") % 7 == 1, (F.col("event_id") - 1).cast("string")))
    fix = v.where("event_id % 5 = 0").select("video_id", F.date_trunc("day", "recording_start").alias("recording_start"), (F.date_trunc("day", "recording_start") + F.expr("INTERVAL 10 SECONDS")).alias("recording_end"), F.lit("manual").alias("timestamp_source"))
    return manifest.canonical_manifest([v.where("event_id % 2 = 0"), v.where("event_id % 2 = 1").drop("timestamp_confidence")], [fix]).select("video_id", "timestamp_source", "timestamp_confidence", "overlap_group_id", "canonical_video_id", "overlap_unverified")


GROUPS = """v AS (SELECT event_id AS id, user_id % 8 AS cam, CASE WHEN event_id % 5 = 0 THEN date_trunc('day', ts) ELSE ts END AS s, CASE WHEN event_id % 5 = 0 THEN date_trunc('day', ts) + INTERVAL 10 SECONDS ELSE ts + INTERVAL 10 MINUTES END AS e FROM events),
t AS (SELECT *, max(e) OVER (PARTITION BY cam ORDER BY s, id::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM v),
i AS (SELECT *, sum((reached IS NULL OR s >= reached)::INT) OVER (PARTITION BY cam ORDER BY s, id::VARCHAR ROWS UNBOUNDED PRECEDING) AS island FROM t),
g AS (SELECT cam, island, 'ovl_' || sha1(string_agg(id::VARCHAR, '|' ORDER BY id::VARCHAR))[1:12] AS overlap_group_id, arg_min(id::VARCHAR, (s, id::VARCHAR)) AS canonical_video_id FROM i GROUP BY 1, 2),
o AS (SELECT i.id, i.s, g.overlap_group_id, g.canonical_video_id FROM i JOIN g USING (cam, island))"""


def usable_recordings(spark, sf):
    v = _recordings(spark, sf).withColumns({"enabled": F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 4 > 1), "is_duplicate": F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3 == 2)})
    return manifest.usable(v).select("video_id")


def duplicate_files(spark, sf):
    """Hashes of some files are missing, paths repeat."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("video_id"), F.when(F.col("doc_id") % 10 > 0, F.sha2("text", 256)).alias("sha256"), F.concat(F.lit("p"), F.col("doc_id") % 50).alias("path"))
    return manifest.mark_duplicates(d).select("video_id", "is_duplicate", "duplicate_of")


def orphan_tracks(spark, sf):
    e = _events(spark, sf)
    return tables.orphans(e.select("event_id", F.when(F.col("event_id") % 6 > 0, F.col("user_id")).alias("video_id")), e.where("event_id % 211 = 0").select(F.col("user_id").alias("video_id")), "video_id")


def split_frames(spark, sf):
    e = _events(spark, sf)
    split = e.where("event_id % 10 < 4").select((F.col("event_id") % 900).alias("tracklet_id"), F.when(F.col("event_id") % 3 > 0, "train").otherwise("val").alias("split")).distinct()
    frames = e.select((F.col("event_id") % 900).alias("tracklet_id"), F.col("event_id").alias("rank"), F.concat(F.lit("f"), "event_id").alias("torso_path"))
    return wf.split_frames(split, frames, e.where("event_id % 5 > 0").select(F.concat(F.lit("f"), "event_id").alias("path"))).select("tracklet_id", "split", "rank")


def best_tracks(spark, sf):
    e = _events(spark, sf).select(F.col("event_id").alias("tracklet_id"), (F.col("event_id") % 4 > 0).alias("valid"), F.when(F.col("event_id") % 9 > 0, F.col("value")).alias("mean_quality"))
    return wf.best_tracks(e, 25).select("tracklet_id", F.round("mean_quality", 6).alias("mean_quality"))


def least_consistent(spark, sf):
    e = _events(spark, sf).select(F.col("event_id").alias("tracklet_id"), F.when(F.col("event_id") % 9 > 0, F.col("value")).alias("appearance_consistency"))
    return wf.least_consistent(e, 25).select("tracklet_id", F.round("appearance_consistency", 6).alias("appearance_consistency"))


def rescaled_points(spark, sf):
    l = table(spark, sf, "lineitem")
    x = exprs.rescaled(F.col("l_quantity") * 8, F.col("l_discount") * 1000, F.col("l_discount") * 1000 + 200, 448.0)
    return l.select("l_orderkey", "l_linenumber", F.round(x, 6).alias("x_px"), F.round(exprs.in_body(x, F.col("l_discount") * 1000, F.col("l_tax") * 50), 6).alias("x_normalized"))


def keypoint_names(spark, sf):
    e = _events(spark, sf).select("event_id", F.col("event_type").alias("keypoint_name"))
    return tables.renamed_keypoints(e, {"click": "withers", "view": "sacrum"})


def cache_keys(spark, sf):
    return _events(spark, sf).select("event_id", exprs.cache_key(F.col("user_id"), F.col("event_type")).alias("key"))


# labels ----------------------------------------------------------------------

NOW = "2026-09-01T00:00:00"


def _label_rows(spark, sf):
    """Labels of tracks: identities of 20 tracks, unconfirmed ones, and blank ids."""
    e = table(spark, sf, "embeddings")
    entity = F.when(F.col("vec_id") % 5 > 0, F.format_string("COW_%04d", F.floor(F.col("vec_id") / 20).cast("int"))).otherwise("")
    return e.select(_text("vec_id").alias("tracklet_id"), F.lit("").alias("pseudo_id"), F.concat(F.lit("s"), F.col("vec_id") % 4).alias("session_id"), F.lit("v").alias("video_id"), entity.alias("entity_id"), ((F.col("vec_id") % 3 > 0) & (F.col("vec_id") % 5 > 0)).alias("confirmed"), F.lit("old").alias("assignment_source"), F.lit("").alias("notes"), F.lit("").alias("updated_at"))


def _no_reviews(spark):
    return spark.createDataFrame([], tables.schema_of("pair_reviews"))


LABELS = "l AS (SELECT vec_id AS i, CASE WHEN vec_id % 5 > 0 THEN printf('COW_%04d', (vec_id // 20)::INT) ELSE '' END AS e, vec_id % 3 > 0 AND vec_id % 5 > 0 AS c FROM embeddings)"


def _brief(df):
    return df.select("tracklet_id", "entity_id", "confirmed", "assignment_source")


def load_labels(spark, sf):
    e = table(spark, sf, "embeddings")
    tracks = e.select(_text("vec_id").alias("tracklet_id"), F.concat(F.lit("s"), F.col("vec_id") % 4).alias("session_id"), F.lit("v").alias("video_id"), (F.col("vec_id") % 6 > 0).alias("valid"))
    found = e.where("vec_id % 2 = 0").select(_text("vec_id").alias("tracklet_id"), F.concat(F.lit("P"), "label").alias("pseudo_id"))
    old = e.where("vec_id % 7 > 0").select(_text("vec_id").alias("tracklet_id"), F.concat(F.lit("cow "), F.floor(F.col("vec_id") / 20)).alias("entity_id"), (F.col("vec_id") % 4 > 0).alias("confirmed"), F.lit(1).alias("n"))
    newer = e.where("vec_id % 14 = 1").select(_text("vec_id").alias("tracklet_id"), F.lit("x").alias("entity_id"), F.lit(None).cast("boolean").alias("confirmed"), F.lit(2).alias("n"))
    return ids.load_labels(tracks, found, old.unionByName(newer), "n").select("tracklet_id", "pseudo_id", "session_id", "entity_id", "confirmed")


def merge_labels(spark, sf):
    return _brief(ids.merge(_label_rows(spark, sf), ["COW_0003", "cow 2", "COW_0005"], NOW)[0])


def rename_labels(spark, sf):
    return _brief(ids.rename(_label_rows(spark, sf), "COW_0003", "Bella", NOW))


def unassign_labels(spark, sf):
    return _brief(ids.unassign(_label_rows(spark, sf), ["41", "42", "43"]))


def accept_pair(spark, sf):
    """Tracks 41 and 101 become one, and so do their identities 2 and 5."""
    return _brief(ids.accept_same(_label_rows(spark, sf), _no_reviews(spark), "41", "101", NOW)[0])


def assign_checked(spark, sf):
    own, _, _ = ids.assign_checked(_label_rows(spark, sf), _no_reviews(spark), spark.createDataFrame([], tables.schema_of("identity_exclusions")), ["40", "45", "50"], "cow 9", NOW)
    return _brief(own)


def _bulk(spark, sf):
    """Neighbours as candidates, with decisions and exclusions that forbid some of them."""
    e = table(spark, sf, "embeddings")
    side = lambda of, step: (_text(of).alias("left_id"), (F.col(of) + step).cast("string").alias("right_id"))
    pairs = e.where("vec_id % 3 < 2").select(*side("vec_id", 19)).unionByName(e.where("vec_id % 10 = 0").select(*side("vec_id", 5)))
    rest = (F.lit("").alias("entity_id"), F.lit(None).cast("double").alias("similarity"), F.lit("").alias("notes"), F.lit("").alias("updated_at"))
    reviews = e.where("vec_id % 12 = 1").select(*side("vec_id", 43), F.lit("different").alias("decision"), *rest)
    barred = e.where("vec_id % 9 = 2").select(F.format_string("cow %d", F.floor(F.col("vec_id") / 20).cast("int") + 1).alias("entity_id"), _text("vec_id").alias("tracklet_id"), F.lit("").alias("reason"), F.lit("").alias("updated_at"))
    return reviews, barred, pairs


def unite_pairs(spark, sf):
    """Labels after all candidates are taken in order, refusals included."""
    return merging.unite(_label_rows(spark, sf), *_bulk(spark, sf), NOW)[0].select("tracklet_id", "entity_id", "confirmed")


def accepted_pairs(spark, sf):
    return merging.accept_pairs(_label_rows(spark, sf), *_bulk(spark, sf)).select("left_id", "right_id", "entity_id")


#: One pair after the other over a list of names, as numbers: what unite_pairs gives by forests and folds.
FOLD = r"""
n AS (SELECT count(*) AS n, greatest(max(vec_id // 20) FILTER (vec_id % 5 > 0), max(vec_id // 20 + 1) FILTER (vec_id % 9 = 2)) AS g FROM embeddings),
start AS (SELECT list(CASE WHEN c THEN i // 20 END ORDER BY i) AS own FROM l),
q AS (SELECT row_number() OVER (ORDER BY x, y) AS k, x, y, x::INT AS a, y::INT AS b FROM (
        SELECT least(v::VARCHAR, w::VARCHAR) AS x, greatest(v::VARCHAR, w::VARCHAR) AS y FROM (
          SELECT vec_id AS v, vec_id + 19 AS w FROM embeddings WHERE vec_id % 3 < 2 UNION SELECT vec_id, vec_id + 5 FROM embeddings WHERE vec_id % 10 = 0)
        WHERE w < (SELECT n FROM n))),
d AS (SELECT list([vec_id, vec_id + 43]) AS d FROM embeddings WHERE vec_id % 12 = 1 AND vec_id + 43 < (SELECT n FROM n)),
f AS (
  SELECT 0::BIGINT AS k, own, (SELECT g FROM n)::BIGINT AS last, false AS ok, NULL::BIGINT AS new FROM start
  UNION ALL
  SELECT k, CASE WHEN ok THEN list_transform(own, lambda c, i: CASE WHEN i - 1 IN (a, b) OR c = ca OR c = cb THEN new ELSE c END) ELSE own END,
         CASE WHEN ok AND ca IS NULL AND cb IS NULL THEN last + 1 ELSE last END, ok, CASE WHEN ok THEN new END
  FROM (SELECT *, ca IS DISTINCT FROM cb OR ca IS NULL AS apart, coalesce(least(ca, cb), last + 1) AS new,
               (ca IS DISTINCT FROM cb OR ca IS NULL)
               AND NOT coalesce(cb = a // 20 + 1 AND a % 9 = 2, false) AND NOT coalesce(ca = b // 20 + 1 AND b % 9 = 2, false)
               AND len(list_filter(d, lambda p: (p[1] IN (a, b) OR coalesce(own[p[1] + 1] IN (ca, cb), false)) AND (p[2] IN (a, b) OR coalesce(own[p[2] + 1] IN (ca, cb), false)))) = 0 AS ok
        FROM (SELECT q.k, q.a, q.b, f.own, f.last, d.d, f.own[q.a + 1] AS ca, f.own[q.b + 1] AS cb FROM f JOIN q ON q.k = f.k + 1 CROSS JOIN d))),
o AS (SELECT i, own[i + 1] AS c FROM (SELECT own FROM f ORDER BY k DESC LIMIT 1), l),
m AS (SELECT c, CASE WHEN c > (SELECT g FROM n) THEN (SELECT g FROM n) + dense_rank() OVER (PARTITION BY c > (SELECT g FROM n) ORDER BY c) ELSE c END AS name FROM (SELECT DISTINCT c FROM o WHERE c IS NOT NULL))
"""


def review_states(spark, sf):
    e = table(spark, sf, "embeddings")
    states = e.select(_text("vec_id").alias("tracklet_id"), F.lit("valid").alias("state"), F.lit(None).cast("double").alias("split_at_s"), F.lit("").alias("notes"), F.lit("").alias("updated_at"))
    return ids.set_state(ids.set_state(states, "17", "unsure", NOW), "17", "tracklet_error", NOW).select("tracklet_id", "state")


def matching_labels(spark, sf):
    return ids.matching(_label_rows(spark, sf), " cow_001").select("tracklet_id", "entity_id")


def bundle_labels(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("t", _text("vec_id"))
    tracks = e.select(F.col("t").alias("tracklet_id"), F.lit("s").alias("session_id"), F.lit("v").alias("video_id"))
    guesses = e.where("vec_id % 2 = 0").select(F.col("t").alias("tracklet_id"), F.when(F.col("vec_id") % 4 == 0, F.concat(F.lit("E"), "label")).alias("top_1_id"), (F.col("label") / 64).alias("top_1_score"), F.lit("UNKNOWN").alias("predicted"))
    rows = bundle.new_labels(e.where("vec_id % 3 > 0").select(F.col("t").alias("tracklet_id"), F.concat(F.lit("P"), "label").alias("pseudo_id")), tracks, guesses, NOW)
    return rows.select("tracklet_id", "pseudo_id", "entity_id", "confirmed", "notes")


# signals -----------------------------------------------------------------------


def _observed(spark, sf):
    e = _events(spark, sf)
    track = F.concat_ws("-", "user_id", "event_type")
    scores = e.select(track.alias("tracklet_id"), F.when(F.col("event_id") % 5 > 0, (F.round(F.col("value"), 3)).cast("string")).otherwise("n/a").alias("posture_score"), F.lit("m").alias("model_name"))
    one = e.groupBy(track.alias("tracklet_id"), "user_id").agg(F.min("event_id").alias("i"))
    tracks = one.select("tracklet_id", _text("user_id").alias("video_id"), F.lit("s").alias("session_id"), (F.col("i") % 60).cast("double").alias("start_s"))
    own = one.where("user_id % 3 > 0").select("tracklet_id", F.concat(F.lit("cow "), "user_id").alias("entity_id"), (F.col("user_id") % 2 == 0).alias("confirmed"))
    videos = one.select(_text("user_id").alias("video_id"), F.date_format(F.expr("make_timestamp(2026, 9, 1, 8, 0, 0) + make_interval(0, 0, 0, CAST(user_id % 20 AS INT))"), "yyyy-MM-dd HH:mm:ss").alias("recording_start")).distinct()
    old = one.where("user_id % 7 = 0").select("tracklet_id", F.lit("m").alias("model_name"), F.lit("unknown").alias("model_version"), F.lit("kept").alias("source_scores"), F.lit("gone").alias("entity_id"))
    return posture.import_scores(scores, tracks, own, videos, old, "scores.csv"), own


def import_scores(spark, sf):
    rows = _observed(spark, sf)[0]
    return rows.select("tracklet_id", "entity_id", "observed_at", F.round("score_median", 6).alias("score_median"), "n_scored_frames", "model_name", "source_scores")


def late_identity(spark, sf):
    rows, own = _observed(spark, sf)
    return posture.with_current_identity(rows, own).select("tracklet_id", "entity_id")


OBSERVED = """s AS (SELECT user_id || '-' || event_type AS t, any_value(user_id) AS u, min(event_id) AS i, median(round(value, 3)) FILTER (event_id % 5 > 0) AS m, count(*) FILTER (event_id % 5 > 0) AS n FROM events GROUP BY 1),
o AS (SELECT t, u, 'gone' AS e, NULL::VARCHAR AS seen, NULL::DOUBLE AS m, NULL::BIGINT AS n, 'kept' AS src FROM s WHERE u % 7 = 0
      UNION ALL SELECT t, u, CASE WHEN u % 3 > 0 THEN printf('COW_%04d', u::INT) ELSE '' END, strftime(TIMESTAMP '2026-09-01 08:00:00' + to_days((u % 20)::INT) + to_seconds(i % 60), '%Y-%m-%d %H:%M:%S'), m, n, 'scores.csv' FROM s WHERE u % 7 > 0 AND n > 0)"""


QUERIES = {
    "extract_tracks": (extract_tracks, EXTRACT + " SELECT video_id, track_id, n_frames, n_best_frames, round(span, 6) AS span, round(mean_quality, 9) AS mean_quality, valid FROM v"),
    "extract_frames": (extract_frames, EXTRACT + " SELECT video_id, track_id, row_number() OVER (PARTITION BY video_id, track_id ORDER BY q DESC, f) AS rank, f AS frame_idx, round(q, 9) AS quality FROM k"),
    "extract_counts": (extract_counts, EXTRACT + " SELECT d.video_id, count(DISTINCT f) AS sampled_frames, coalesce(any_value(n), 0) AS raw_tracks, coalesce(any_value(g), 0) AS valid_tracks FROM d LEFT JOIN (SELECT video_id, count(*) AS n, count(*) FILTER (valid) AS g FROM v GROUP BY 1) c ON c.video_id = d.video_id GROUP BY 1"),
    "frame_reason_counts": (frame_reason_counts, "SELECT r AS reason, count(*) AS n FROM (SELECT unnest([CASE WHEN l_tax > 0.06 THEN 'occlusion' END, CASE WHEN l_discount < 0.03 THEN 'low_visibility' END, CASE WHEN l_linenumber = 7 THEN 'tracker_jump' END]) AS r FROM lineitem) WHERE r IS NOT NULL GROUP BY 1"),
    "track_embeddings": (track_embeddings, TRACK_EMBEDDINGS),
    "gallery": (gallery, "SELECT 'E' || label AS entity_id, vec_id::VARCHAR AS tracklet_id, CASE WHEN vec_id % 2 = 0 THEN 'left' ELSE 'unknown' END AS flank, CASE WHEN vec_id % 4 = 0 THEN 'cam' ELSE 'unknown' END AS view, 'unknown' AS domain, 'b' AS backend, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS p1 FROM embeddings WHERE vec_id % 5 > 0 AND vec_id % 3 > 0 AND vec_id % 7 > 0 AND vec_id % 11 > 0"),
    "prototype_summary": (prototype_summary, f"SELECT count(*) AS queries, round(avg((rank = 1)::INT), 6) AS top1, round(avg(1 / rank), 6) AS mean_ap FROM ({similarity_queries.QUERIES['prototype_retrieval'][1]})"),
    "cluster_sizes": (cluster_sizes, "WITH c AS (SELECT label || '-' || (vec_id // 30) AS p, count(*) AS n FROM embeddings GROUP BY 1) SELECT sum(n)::BIGINT AS tracks, count(*) AS clusters, count(*) FILTER (n > 1) AS shared_clusters FROM c"),
    "report_members": (report_members, f"WITH {MEMBERS} SELECT event_id::VARCHAR AS tracklet_id, user_id::VARCHAR AS session_id, pseudo_id, needs_review FROM m"),
    "report_counts": (report_counts, f"WITH {MEMBERS} SELECT pseudo_id, count(*) AS tracklets, count(DISTINCT user_id) AS sessions, round(avg(value), 6) AS mean_quality FROM m GROUP BY 1"),
    "worker_states": (worker_states, WORKER),
    "worker_process": (worker_process, PROCESS),
    "work_queue": (work_queue, "SELECT event_id::VARCHAR AS video_id, CASE event_id % 4 WHEN 0 THEN 'INGESTED' WHEN 1 THEN 'TRACKED' ELSE 'EMBEDDED' END AS status FROM events WHERE event_id % 4 < 3"),
    "pending_recordings": (pending_recordings, "WITH RECURSIVE x AS (SELECT user_id, event_id % 2 = 0 AS even, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), r AS (SELECT DISTINCT user_id, true AS fresh, 0::BIGINT AS k FROM events UNION ALL SELECT r.user_id, CASE WHEN x.even = fresh THEN NOT fresh ELSE fresh END, x.k FROM r JOIN x ON x.user_id = r.user_id AND x.k = r.k + 1), z AS (SELECT * FROM r QUALIFY k = max(k) OVER (PARTITION BY user_id)) SELECT z.user_id::VARCHAR AS video_id, 'TRACKED' AS status, min(ts) AS created_at FROM z JOIN events USING (user_id) WHERE NOT fresh GROUP BY 1"),
    "name_uuids": (name_uuids, f"SELECT c_custkey, {_uuid("('é:' || c_name)")} AS id FROM customer"),
    "import_tracklets": (import_tracklets, "SELECT event_id::VARCHAR AS tracklet_id, user_id::VARCHAR AS video_id, round(value, 6) AS start_s, 0.0::DOUBLE AS quality_score, CASE WHEN event_id % 4 > 0 THEN 'pending' ELSE 'rejected' END AS review_state, '{\"valid\":' || (event_id % 4 > 0)::VARCHAR || ',\"n_frames\":' || (event_id % 9) || '}' AS metadata_json FROM events WHERE event_id % 2 > 0"),
    "import_embeddings": (import_embeddings, f"SELECT event_id::VARCHAR AS tracklet_id, 'm:1' AS model_version, 2 AS dimensions, {_uuid("(event_id || ':m:1')")} AS embedding_id FROM events WHERE event_id % 3 > 0"),
    "import_entities": (import_entities, f"WITH {REG} SELECT {_uuid("('entity:' || name)")} AS entity_uuid, name AS display_id, CASE WHEN u % 10 = 0 THEN 'ambiguous' ELSE 'provisional' END AS identity_state FROM ent"),
    "import_assigned": (import_assigned, f"WITH {REG} SELECT event_id::VARCHAR AS tracklet_id, CASE WHEN named THEN CASE WHEN name IN (SELECT name FROM old) THEN 'old-' || name ELSE {_uuid("('entity:' || name)")} END END AS entity_uuid FROM e"),
    "import_edges": (import_edges, f"WITH {EDGES} SELECT {_uuid("('edge:' || left_id || ':' || right_id || ':' || decision)")} AS edge_id, left_id, right_id, decision FROM r"),
    "import_counts": (import_counts, f"WITH {REG}, {EDGES} SELECT count(*) FILTER (event_id % 2 > 0) AS tracklets, count(*) FILTER (event_id % 3 > 0) AS embeddings, (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM r) AS edges FROM events"),
    "register_models": (register_models, "SELECT DISTINCT event_type || ':' || sha256(event_type)[:16] AS model_version, event_type AS model_name, sha256(event_type) AS checkpoint_sha256, CASE WHEN length(event_type) % 2 = 1 THEN 'c0' ELSE 'c1' END AS code_commit, 'f1' AS config_hash FROM events"),
    "event_payloads": (event_payloads, """SELECT event_id::VARCHAR AS event_id, CASE event_id % 3 WHEN 0 THEN 'merge' ELSE 'split' END AS operation,
      CASE event_id % 3 WHEN 0 THEN '{"sources":["' || user_id || '","n' || event_id || '"],"target":"n' || event_id || '"}' ELSE '{"source":"' || user_id || '","target":"n' || event_id || '","tracklets":["' || event_id || '"]}' END AS payload,
      CASE event_id % 3 WHEN 0 THEN '{"from":"n' || event_id || '","restore":["' || user_id || '"]}' ELSE '{"from":"n' || event_id || '","to":"' || user_id || '","tracklets":["' || event_id || '"]}' END AS inverse FROM events WHERE event_id % 3 < 2"""),
    "registry_conflicts": (registry_conflicts, "SELECT 'e' || a.event_id AS edge_id, a.event_id::VARCHAR AS left_id, (a.event_id + 3)::VARCHAR AS right_id FROM events a JOIN events b ON b.event_id = a.event_id + 3 WHERE a.event_id % 2 = 0 AND a.event_id % 5 > 0 AND a.user_id < 60 AND b.user_id < 60"),
    "time_overrides": (time_overrides, f"WITH {GROUPS} SELECT id::VARCHAR AS video_id, s AS recording_start, CASE WHEN id % 5 = 0 THEN 'manual' ELSE 'camera_ocr' END AS timestamp_source, CASE WHEN id % 5 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS timestamp_confidence, overlap_group_id, canonical_video_id FROM o"),
    "canonical_manifest": (canonical_manifest, f"WITH {GROUPS} SELECT o.id::VARCHAR AS video_id, CASE WHEN o.id % 5 = 0 THEN 'manual' ELSE 'camera_ocr' END AS timestamp_source, CASE WHEN o.id % 2 = 0 THEN 0.5::DOUBLE END AS timestamp_confidence, o.overlap_group_id, CASE WHEN o.id % 7 = 1 THEN b.canonical_video_id ELSE o.canonical_video_id END AS canonical_video_id, false AS overlap_unverified FROM o LEFT JOIN o b ON b.id = o.id - 1"),
    "usable_recordings": (usable_recordings, "SELECT event_id::VARCHAR AS video_id FROM events WHERE (event_id % 4 = 0 OR event_id % 4 > 1) AND event_id % 3 < 2"),
    "duplicate_files": (duplicate_files, "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 > 0 THEN text END AS h, 'p' || (doc_id % 50) AS p FROM documents), f AS (SELECT *, CASE WHEN h IS NOT NULL THEN first_value(doc_id) OVER (PARTITION BY h ORDER BY p, doc_id) END AS o FROM d) SELECT doc_id AS video_id, coalesce(o <> doc_id, false) AS is_duplicate, CASE WHEN o <> doc_id THEN o END AS duplicate_of FROM f"),
    "orphan_tracks": (orphan_tracks, "SELECT event_id, user_id AS video_id FROM events WHERE event_id % 6 > 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 211 = 0)"),
    "split_frames": (split_frames, "WITH s AS (SELECT DISTINCT event_id % 900 AS t, CASE WHEN event_id % 3 > 0 THEN 'train' ELSE 'val' END AS split FROM events WHERE event_id % 10 < 4) SELECT t AS tracklet_id, split, event_id AS rank FROM s JOIN events ON event_id % 900 = t WHERE event_id % 5 > 0"),
    "best_tracks": (best_tracks, "SELECT event_id AS tracklet_id, round(CASE WHEN event_id % 9 > 0 THEN value END, 6) AS mean_quality FROM events WHERE event_id % 4 > 0 ORDER BY CASE WHEN event_id % 9 > 0 THEN value END DESC NULLS LAST, event_id LIMIT 25"),
    "least_consistent": (least_consistent, "SELECT event_id AS tracklet_id, round(value, 6) AS appearance_consistency FROM events WHERE event_id % 9 > 0 ORDER BY value, event_id LIMIT 25"),
    "rescaled_points": (rescaled_points, "WITH p AS (SELECT *, l_quantity * 8 * (((l_discount * 1000 + 200) - l_discount * 1000) / 448.0::DOUBLE) + l_discount * 1000 AS x FROM lineitem) SELECT l_orderkey, l_linenumber, round(x, 6) AS x_px, round((x - l_discount * 1000) / greatest(1, l_tax * 50), 6) AS x_normalized FROM p"),
    "keypoint_names": (keypoint_names, "SELECT event_id, CASE event_type WHEN 'click' THEN 'withers' WHEN 'view' THEN 'sacrum' ELSE event_type END AS keypoint_name FROM events"),
    "cache_keys": (cache_keys, "SELECT event_id, sha1('{\"v0\":' || user_id || ',\"v1\":\"' || event_type || '\"}')[1:12] AS key FROM events"),
    "load_labels": (load_labels, "WITH t AS (SELECT vec_id AS i, label, CASE WHEN vec_id % 14 = 1 THEN 'x' WHEN vec_id % 7 > 0 THEN printf('COW_%04d', (vec_id // 20)::INT) ELSE '' END AS e, CASE WHEN vec_id % 14 = 1 THEN false ELSE vec_id % 7 > 0 AND vec_id % 4 > 0 END AS c FROM embeddings WHERE vec_id % 6 > 0) SELECT i::VARCHAR AS tracklet_id, CASE WHEN i % 2 = 0 THEN 'P' || label END AS pseudo_id, 's' || (i % 4) AS session_id, e AS entity_id, c AS confirmed FROM t"),
    "merge_labels": (merge_labels, f"WITH {LABELS} SELECT i::VARCHAR AS tracklet_id, CASE WHEN e IN ('COW_0002', 'COW_0003', 'COW_0005') THEN 'COW_0002' ELSE e END AS entity_id, c OR e IN ('COW_0002', 'COW_0003', 'COW_0005') AS confirmed, CASE WHEN e IN ('COW_0002', 'COW_0003', 'COW_0005') THEN 'identity_merge' ELSE 'old' END AS assignment_source FROM l"),
    "rename_labels": (rename_labels, f"WITH {LABELS} SELECT i::VARCHAR AS tracklet_id, CASE WHEN e = 'COW_0003' THEN 'Bella' ELSE e END AS entity_id, c AS confirmed, CASE WHEN e = 'COW_0003' THEN 'identity_rename' ELSE 'old' END AS assignment_source FROM l"),
    "unassign_labels": (unassign_labels, f"WITH {LABELS} SELECT i::VARCHAR AS tracklet_id, CASE WHEN i IN (41, 42, 43) THEN '' ELSE e END AS entity_id, c AND i NOT IN (41, 42, 43) AS confirmed, CASE WHEN i IN (41, 42, 43) THEN '' ELSE 'old' END AS assignment_source FROM l"),
    "accept_pair": (accept_pair, f"WITH {LABELS} SELECT i::VARCHAR AS tracklet_id, CASE WHEN e = 'COW_0005' THEN 'COW_0002' ELSE e END AS entity_id, c OR e IN ('COW_0002', 'COW_0005') AS confirmed, CASE WHEN i IN (41, 101) THEN 'pair_review' WHEN e IN ('COW_0002', 'COW_0005') THEN 'identity_merge' ELSE 'old' END AS assignment_source FROM l"),
    "unite_pairs": (unite_pairs, f"WITH RECURSIVE {LABELS}, {FOLD} SELECT l.i::VARCHAR AS tracklet_id, CASE WHEN o.c IS NULL THEN l.e ELSE printf('COW_%04d', name::INT) END AS entity_id, o.c IS NOT NULL OR l.c AS confirmed FROM l JOIN o ON o.i = l.i LEFT JOIN m ON m.c = o.c"),
    "accepted_pairs": (accepted_pairs, f"WITH RECURSIVE {LABELS}, {FOLD} SELECT x AS left_id, y AS right_id, printf('COW_%04d', name::INT) AS entity_id FROM f JOIN q ON q.k = f.k AND f.ok JOIN o ON o.i = q.a JOIN m ON m.c = o.c"),
    "assign_checked": (assign_checked, f"WITH {LABELS} SELECT i::VARCHAR AS tracklet_id, CASE WHEN i IN (40, 45, 50) THEN 'COW_0009' ELSE e END AS entity_id, c OR i IN (40, 45, 50) AS confirmed, CASE WHEN i IN (40, 45, 50) THEN 'manual' ELSE 'old' END AS assignment_source FROM l"),
    "review_states": (review_states, "SELECT vec_id::VARCHAR AS tracklet_id, CASE WHEN vec_id = 17 THEN 'tracklet_error' ELSE 'valid' END AS state FROM embeddings"),
    "matching_labels": (matching_labels, f"WITH {LABELS} SELECT i::VARCHAR AS tracklet_id, e AS entity_id FROM l WHERE e LIKE '%COW_001%'"),
    "bundle_labels": (bundle_labels, "SELECT vec_id::VARCHAR AS tracklet_id, 'NEW_P' || label AS pseudo_id, '' AS entity_id, false AS confirmed, CASE WHEN vec_id % 2 = 0 THEN 'model_top1=' || CASE WHEN vec_id % 4 = 0 THEN 'E' || label ELSE '' END || ';similarity=' || printf('%.6f', label / 64) || ';prediction=UNKNOWN' ELSE '' END AS notes FROM embeddings WHERE vec_id % 3 > 0"),
    "import_scores": (import_scores, f"WITH {OBSERVED} SELECT t AS tracklet_id, e AS entity_id, seen AS observed_at, round(m, 6) AS score_median, n AS n_scored_frames, 'm' AS model_name, src AS source_scores FROM o"),
    "late_identity": (late_identity, f"WITH {OBSERVED} SELECT t AS tracklet_id, CASE WHEN u % 3 > 0 AND u % 2 = 0 THEN printf('COW_%04d', u::INT) ELSE '' END AS entity_id FROM o"),
}
