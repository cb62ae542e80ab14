"""Queries over recordings, registry and splits: a recording is ten minutes from an event, a camera user_id % 8."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import exprs, windows
from trackloom.operators import bundle, labels, manifest, registry, splits
from trackloom.plans.session import table


def _videos(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("video_id"), (F.col("user_id") % 8).alias("camera_id"), F.col("user_id"), F.when(F.col("event_id") % 50 > 0, F.col("ts")).alias("recording_start"), F.when(F.col("event_id") % 50 > 1, F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("recording_end"))


V = """v AS (SELECT event_id AS video_id, user_id % 8 AS camera_id, user_id, CASE WHEN event_id % 50 > 0 THEN ts END AS s, CASE WHEN event_id % 50 > 1 THEN ts + INTERVAL 10 MINUTES END AS e FROM events),
t AS (SELECT *, max(e) OVER (PARTITION BY camera_id ORDER BY s, video_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM v WHERE s IS NOT NULL AND e > s),
i AS (SELECT *, sum((reached IS NULL OR s >= reached)::INT) OVER (PARTITION BY camera_id ORDER BY s, video_id ROWS UNBOUNDED PRECEDING) AS island FROM t),
g AS (SELECT camera_id, island, 'ovl_' || sha1(string_agg(video_id::VARCHAR, '|' ORDER BY video_id::VARCHAR))[1:12] AS overlap_group_id, arg_min(video_id::VARCHAR, (s, video_id)) AS canonical_video_id FROM i GROUP BY 1, 2),
o AS (SELECT i.video_id, i.s, i.camera_id, overlap_group_id, canonical_video_id, false AS overlap_unverified FROM i JOIN g ON g.camera_id = i.camera_id AND g.island = i.island
      UNION ALL SELECT video_id, s, camera_id, 'ovl_' || sha1(video_id::VARCHAR)[1:12], video_id::VARCHAR, s IS NULL OR e IS NULL FROM v WHERE s IS NULL OR e IS NULL OR e <= s)"""


def overlap_groups(spark, sf):
    return manifest.overlap_groups(_videos(spark, sf)).select("video_id", "overlap_group_id", "canonical_video_id", "overlap_unverified")


def overlap_pairs(spark, sf):
    return manifest.overlapping_pairs(_videos(spark, sf), "video_id", "camera_id", "recording_start", "recording_end", digits=3)


def manifest_counts(spark, sf):
    return manifest.manifest_counts(manifest.overlap_groups(_videos(spark, sf)))


def hash_dedup(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("video_id"), F.sha2("text", 256).alias("sha256"))
    return manifest.mark_duplicates(d, order_col="video_id").select("video_id", "is_duplicate", "duplicate_of", exprs.content_id(F.col("sha256")).alias("content_id"))


def ingest(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    return registry.ingest(d.where("path % 3 = 0"), d.where("path % 3 > 0"), "side").select("path", "status", "camera_id")


def session_class(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", exprs.session_type(F.hour("ts")).alias("session_type"), exprs.session_id(F.concat(F.lit("cam"), (F.col("user_id") % 8).cast("string")), F.when(F.col("event_id") % 9 > 0, F.col("ts")), F.concat(F.lit("v"), F.col("event_id").cast("string"))).alias("session_id"))


def ocr_parse(spark, sf):
    e = table(spark, sf, "events")
    day = F.date_format(F.when(F.col("event_id") % 6 == 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("ts")), "E")
    text = F.concat(F.lit("CAM "), F.translate(F.date_format("ts", "MM-dd-yyyy"), "01-", "OI—"), F.lit(" "), F.when(F.col("event_id") % 2 == 0, day).otherwise(""), F.lit(" "), F.date_format("ts", "HH:mm:ss"))
    return e.select("event_id", exprs.overlay_time(F.when(F.col("event_id") % 11 == 0, "noise 13:00").otherwise(text)).alias("read_at"))


def filename_ts(spark, sf):
    e = table(spark, sf, "events")
    name = F.concat(F.lit("Video "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" at "), F.date_format("ts", "HH.mm.ss"), F.when(F.col("event_id") % 3 == 0, ".x").otherwise(""), F.lit(".mp4"))
    return e.select("event_id", exprs.file_time(F.when(F.col("event_id") % 7 == 0, "clip.mp4").otherwise(name)).alias("named_at"))


def normalize_id(spark, sf):
    c = table(spark, sf, "customer")
    text = F.element_at(F.array(F.concat(F.lit(" cow "), F.col("c_custkey")), F.concat(F.lit("COW_00"), F.col("c_custkey")), F.concat(F.lit("Cow-"), F.col("c_custkey"), F.lit(" ")), F.col("c_name"), F.lit("cow000")), (F.col("c_custkey") % 5 + 1).cast("int"))
    return c.select("c_custkey", exprs.normal_id(text).alias("entity_id"))


def bool_mask(spark, sf):
    d = table(spark, sf, "documents")
    texts = F.array(*map(F.lit, (" True", "no", "1", "0", "YES ", "off", "maybe", "")))
    return d.select("doc_id", exprs.bool_text(F.element_at(texts, (F.col("doc_id") % 8 + 1).cast("int"))).alias("by_default"), exprs.bool_text(F.element_at(texts, (F.col("doc_id") % 8 + 1).cast("int")), True).alias("by_true"))


def sample_offsets(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (F.col("l_quantity") - 5).alias("d"))
    o = exprs.sample_offsets(F.col("d"))
    return l.select("l_orderkey", "l_partkey", "l_suppkey", F.size(o).cast("long").alias("n"), F.round(F.element_at(o, 1), 6).alias("first"), F.round(F.element_at(o, -1), 6).alias("last"))


def timestamp_fit(spark, sf):
    e = table(spark, sf, "events").withColumns({"video": F.floor(F.col("event_id") / 4).cast("long"), "k": F.col("event_id") % 4})
    base = F.timestamp_micros((F.lit(1_704_067_200_000_000) + F.col("video") * 3_600_000_000).cast("bigint"))
    noise = F.when(F.col("value") > 80, F.expr("INTERVAL 500 SECONDS")).otherwise(F.expr("INTERVAL 1 SECONDS"))
    time = F.when(F.col("value") > 20, base + F.make_dt_interval(secs=(F.col("k") * 10).cast("decimal(18,6)")) + noise)
    rows = e.select("video", (F.col("k") * 10.0).alias("offset_s"), time.alias("timestamp"), F.lit(60.0).alias("duration_s"))
    out = manifest.timestamp_fit(rows, "video")
    return out.select("video", exprs.micros(F.col("recording_start")).alias("start_us"), exprs.micros(F.col("recording_end")).alias("end_us"), "timestamp_source", F.round("timestamp_confidence", 6).alias("confidence"), "error")


FIT = """WITH x AS (SELECT event_id // 4 AS video, CASE WHEN value > 20 THEN 1704067200.0 + event_id // 4 * 3600.0 + CASE WHEN value > 80 THEN 500.0 ELSE 1.0 END END AS s FROM events),
y AS (SELECT video, count(*) AS n, list(s ORDER BY s) FILTER (s IS NOT NULL) AS l FROM x GROUP BY video),
z AS (SELECT *, coalesce(len(l), 0) AS v, l[len(l) // 2 + 1] AS epoch FROM y),
w AS (SELECT *, coalesce(len(list_filter(l, lambda s: abs(s - epoch) <= 3)), 0) AS k FROM z),
q AS (SELECT *, CASE WHEN v = 0 THEN 'no_valid_ocr_sample' WHEN k < 2 AND n >= 2 THEN 'ocr_timeline_inconsistent' END AS error FROM w)
SELECT video, CASE WHEN error IS NULL THEN (epoch * 1e6)::BIGINT END AS start_us, CASE WHEN error IS NULL THEN ((epoch + 60) * 1e6)::BIGINT END AS end_us, CASE WHEN error IS NULL THEN 'camera_ocr' ELSE 'unknown' END AS timestamp_source,
  round(CASE WHEN error IS NOT NULL THEN 0 WHEN k = 1 THEN least(0.35, k / greatest(3, n)) ELSE least(1, k / greatest(3, n)) END, 6) AS confidence, error FROM q"""


def _split_manifest(spark, sf):
    return _videos(spark, sf).withColumn("overlap_unverified", F.col("recording_start").isNull() | F.col("recording_end").isNull())


def date_split(spark, sf):
    return splits.date_split(_split_manifest(spark, sf), ["2024-01-20"], ["2024-01-10", "2024-01-12"]).select("video_id", "split")


def auto_last_day_split(spark, sf):
    return splits.last_day_split(_split_manifest(spark, sf)).select("video_id", "split")


def tracklet_split(spark, sf):
    videos = splits.date_split(_split_manifest(spark, sf), ["2024-01-20"], ["2024-01-10", "2024-01-12"])
    e = table(spark, sf, "events")
    own = e.select(F.col("event_id").alias("tracklet_id"), F.col("user_id").cast("string").alias("entity_id"), (F.col("event_id") % 5 > 0).alias("confirmed"))
    tracks = e.select(F.col("event_id").alias("tracklet_id"), F.col("user_id").alias("session_id"), F.col("event_id").alias("video_id"))
    flagged = e.where("event_id % 13 = 0").select(F.col("event_id").alias("tracklet_id"))
    return splits.track_split(own, tracks, videos, flagged, ["3", "7"]).select("tracklet_id", "entity_id", "split")


SPLIT = "s AS (SELECT event_id AS video_id, user_id, CASE WHEN event_id % 50 <= 1 THEN 'train' WHEN ts::DATE = DATE '2024-01-20' THEN 'test' WHEN ts::DATE IN (DATE '2024-01-10', DATE '2024-01-12') THEN 'validation' ELSE 'train' END AS split FROM events)"


def correction_overlay(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("video_id"), F.col("o_totalprice").alias("duration_s"), F.col("o_orderpriority").alias("session_type"))
    fix = lambda n, m: o.where(f"video_id % {n} = 0").select("video_id", F.when(F.col("video_id") % 2 == 0, f"fixed{m}").alias("session_type"), F.when(F.col("video_id") % 3 == 0, F.lit(float(m))).alias("duration_s"), F.when(F.col("video_id") % 7 > 0, " Manual").otherwise("ocr").alias("timestamp_source"), F.lit(m).alias("seq"))
    return manifest.overlay(o, fix(4, 1).unionByName(fix(6, 2)), columns=("session_type", "duration_s"), sequence="seq")


OVERLAY = """WITH f AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'fixed' || m END AS t, CASE WHEN o_orderkey % 3 = 0 THEN m::DOUBLE END AS d, m FROM orders, (VALUES (1, 4), (2, 6)) x(m, n) WHERE o_orderkey % n = 0 AND o_orderkey % 7 > 0),
l AS (SELECT id, arg_max(t, m) FILTER (t IS NOT NULL) AS t, arg_max(d, m) FILTER (d IS NOT NULL) AS d FROM f GROUP BY id)
SELECT o_orderkey AS video_id, coalesce(d, o_totalprice) AS duration_s, coalesce(t, o_orderpriority) AS session_type FROM orders LEFT JOIN l ON id = o_orderkey"""


def conform_union(spark, sf):
    o = table(spark, sf, "orders")
    return bundle.keyed_union(o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus"), o.where("o_orderkey % 2 = 1 OR o_orderkey % 3 = 0").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


def keep_first_append(spark, sf):
    o = table(spark, sf, "orders")
    return bundle.keyed_union(o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("old").alias("src")), o.where("o_orderkey % 2 = 1 OR o_orderkey % 3 = 0").select("o_orderkey", F.lit("new").alias("src")), ["o_orderkey"], "first")


def latest_state(spark, sf):
    c = table(spark, sf, "conversations")
    return registry.latest_state(c.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n")), "conv_id", "turn")


def running_state(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return registry.running_state(e, "user_id", "event_id", "event_type").select("event_id", "previous")


def upsert(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return windows.keep_one(e, ["user_id", "event_type"], F.col("event_id").desc())


def idempotent_append(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type")
    return registry.anti_append(e.where("user_id % 2 = 0"), e, ["user_id", "event_type"])


def identity_state(spark, sf):
    e = table(spark, sf, "events")
    name = F.concat_ws("_", "user_id", F.col("event_id") % 40)
    conflicts = e.where("user_id % 10 = 0").select(name.alias("entity_id"))
    return registry.identity_states(e.select(name.alias("entity_id"), F.col("event_id").alias("video_id")), e.select(F.col("event_id").alias("video_id"), F.col("ts").alias("recording_start")), conflicts)


def _identity_events(spark, sf):
    """The log is the whole supplier table: two merges of a user into the next, a split of a track from its user, and an undo of the split or of the second merge."""
    k = F.col("s_suppkey")
    log = table(spark, sf, "supplier").select(k.alias("seq")).join(table(spark, sf, "events").select(F.col("event_id").alias("seq"), "user_id"), "seq", "left")
    k, turn = F.col("seq"), F.col("seq") % 4
    text = lambda c: c.cast("string")
    none = F.array().cast("array<string>")
    return log.select(
        "seq", text(k).alias("event_id"), F.when(turn < 2, "merge").when(turn == 2, "split").otherwise("undo").alias("operation"),
        F.when(turn < 2, text(k % 50 + 1)).when(turn == 2, F.concat(F.lit("n"), k)).alias("target"), F.when(turn < 2, F.array(text(k % 50), text(k % 50 + 1))).when(turn == 2, F.array(text(F.col("user_id")))).otherwise(none).alias("sources"),
        F.when(turn == 2, F.array(text(k))).otherwise(none).alias("tracklets"), F.lit("r").alias("reviewer"), F.when(turn == 3, text(F.when(k % 8 == 3, k - 1).otherwise(k - 2))).alias("undoes"),
    )


def registry_replay(spark, sf):
    own = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("tracklet_id"), F.col("user_id").cast("string").alias("entity_id"))
    return registry.replay(own, _identity_events(spark, sf))


LOG = """u AS (SELECT CASE WHEN s_suppkey % 8 = 3 THEN s_suppkey - 1 ELSE s_suppkey - 2 END AS k FROM supplier WHERE s_suppkey % 4 = 3),
ev AS (SELECT s_suppkey AS id, s_suppkey % 4 < 2 AS is_merge, CASE WHEN s_suppkey % 4 < 2 THEN (s_suppkey % 50)::VARCHAR ELSE user_id::VARCHAR END AS src, CASE WHEN s_suppkey % 4 < 2 THEN (s_suppkey % 50 + 1)::VARCHAR ELSE 'n' || s_suppkey END AS dst, row_number() OVER (ORDER BY s_suppkey) AS k
       FROM supplier LEFT JOIN events ON event_id = s_suppkey WHERE s_suppkey % 4 < 3 AND s_suppkey NOT IN (SELECT k FROM u))"""
REPLAY = f"""WITH RECURSIVE {LOG},
r AS (SELECT event_id AS t, user_id::VARCHAR AS entity_id, 0::BIGINT AS k FROM events
      UNION ALL SELECT r.t, CASE WHEN r.entity_id = ev.src AND (ev.is_merge OR ev.id = r.t) THEN ev.dst ELSE r.entity_id END, ev.k FROM r JOIN ev ON ev.k = r.k + 1)
SELECT t::VARCHAR AS tracklet_id, entity_id FROM r WHERE k = (SELECT coalesce(max(k), 0) FROM ev)"""


def merged_identities(spark, sf):
    users = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("display_id")).distinct().withColumn("identity_state", F.lit("provisional"))
    return registry.identity_view(users, _identity_events(spark, sf))


def video_states(spark, sf):
    e = table(spark, sf, "events")
    videos = e.select(F.col("user_id").cast("string").alias("video_id")).distinct().withColumn("status", F.lit("INGESTED"))
    steps = e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("video_id"), F.when(F.col("event_id") % 10 == 0, "error").otherwise("transition").alias("kind"), F.when(F.col("event_id") % 2 == 0, "INGESTED").otherwise("TRACKED").alias("expected"), F.when(F.col("event_id") % 2 == 0, "TRACKED").otherwise("INGESTED").alias("target"), F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("e"), F.col("event_id"))).alias("error"))
    return registry.video_states(videos, steps)


VIDEO_STATES = """WITH RECURSIVE x AS (SELECT user_id::VARCHAR AS v, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
r AS (SELECT DISTINCT user_id::VARCHAR AS v, 'INGESTED' AS status, 0::BIGINT AS attempts, NULL::VARCHAR AS last_error, 0::BIGINT AS k FROM events
      UNION ALL SELECT r.v, CASE WHEN event_id % 10 <> 0 AND status = CASE WHEN event_id % 2 = 0 THEN 'INGESTED' ELSE 'TRACKED' END THEN CASE WHEN event_id % 2 = 0 THEN 'TRACKED' ELSE 'INGESTED' END ELSE status END,
        attempts + CASE WHEN event_id % 10 = 0 OR status = CASE WHEN event_id % 2 = 0 THEN 'INGESTED' ELSE 'TRACKED' END THEN 1 ELSE 0 END,
        CASE WHEN event_id % 10 = 0 THEN 'e' || event_id WHEN status = CASE WHEN event_id % 2 = 0 THEN 'INGESTED' ELSE 'TRACKED' END THEN NULL ELSE last_error END, x.k FROM r JOIN x ON x.v = r.v AND x.k = r.k + 1)
SELECT v AS video_id, status, attempts, last_error FROM r QUALIFY k = max(k) OVER (PARTITION BY v)"""


def annotation_text(spark, sf):
    e = table(spark, sf, "events")
    status = F.element_at(F.array(*map(F.lit, ("PREDICTED", "AMBIGUOUS", "CONFIRMED"))), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select("event_id", exprs.annotation(F.when(F.col("event_id") % 4 > 0, F.col("event_type")), status, F.col("value") / 3, F.lit("A"), F.lit("B")).alias("label"))


def pair_keys(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.select(exprs.pair_key(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("pair_key")).groupBy("pair_key").agg(F.count("*").alias("n"))


def evidence_window(spark, sf):
    low, high = exprs.evidence_window(F.col("l_quantity") / 10, F.col("l_quantity") / 4, F.lit(10.0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def natural_order(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("COW_"), F.col("c_custkey"))).otherwise(F.col("c_name")).alias("e"))
    from pyspark.sql import Window

    return c.select("c_custkey", F.row_number().over(Window.partitionBy(F.substring("e", 1, 2)).orderBy(*labels.by_id("e"))).alias("n"))


def frame_sampling(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("frame_idx"), "user_id")
    return manifest.sampled_frames(e, F.lit(29.97), 5.0, 200.0)


def enriched_tracks(spark, sf):
    """Two manifests that share a fifth of the recordings; a fifth is in neither."""
    e = table(spark, sf, "events")
    tracks = e.select(F.col("event_id").alias("tracklet_id"), F.col("event_id").alias("video_id"), F.when(F.col("event_id") % 2 == 0, "own").alias("domain"))
    one = e.where("event_id % 5 < 3").select(F.col("event_id").alias("video_id"), F.lit("first").alias("domain"), F.lit("c1").alias("camera_id"))
    two = e.where("event_id % 5 IN (2, 3)").select(F.col("event_id").alias("video_id"), F.when(F.col("event_id") % 3 > 0, "second").alias("domain"))
    return manifest.with_recording_time(tracks, [one, two]).select("tracklet_id", "domain", "camera_id")


QUERIES = {
    "overlap_groups": (overlap_groups, f"WITH {V} SELECT video_id, overlap_group_id, canonical_video_id, overlap_unverified FROM o"),
    "overlap_pairs": (overlap_pairs, f"WITH {V} SELECT a.video_id AS left_id, b.video_id AS right_id, round((epoch_us(least(a.e, b.e)) - epoch_us(greatest(a.s, b.s))) / 1e6, 3) AS seconds FROM v a JOIN v b ON a.camera_id = b.camera_id AND a.video_id < b.video_id AND a.s < b.e AND b.s < a.e"),
    "manifest_counts": (manifest_counts, f"WITH {V}, c AS (SELECT overlap_group_id, count(*) AS n, count(*) FILTER (overlap_unverified) AS u FROM o GROUP BY 1) SELECT sum(n)::BIGINT AS recordings, count(*) AS groups, count(*) FILTER (n > 1) AS shared_groups, sum(u)::BIGINT AS unverified FROM c"),
    "hash_dedup": (hash_dedup, "WITH d AS (SELECT doc_id, sha256(text) AS h, min(doc_id) OVER (PARTITION BY text) AS f FROM documents) SELECT doc_id AS video_id, doc_id <> f AS is_duplicate, CASE WHEN doc_id <> f THEN f END AS duplicate_of, 'vid_' || h[1:12] AS content_id FROM d"),
    "ingest": (ingest, "SELECT min(doc_id) AS path, 'INGESTED' AS status, 'side' AS camera_id FROM documents WHERE doc_id % 3 > 0 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0) GROUP BY text"),
    "session_class": (session_class, "WITH s AS (SELECT event_id, user_id, ts, CASE WHEN hour(ts) BETWEEN 5 AND 9 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 17 THEN 'afternoon' WHEN hour(ts) >= 20 OR hour(ts) < 3 THEN 'night' ELSE 'other' END AS c FROM events) SELECT event_id, c AS session_type, CASE WHEN event_id % 9 > 0 THEN 'cam' || (user_id % 8) || '_' || strftime(ts, '%Y%m%d') || '_' || c ELSE 'v' || event_id END AS session_id FROM s"),
    "ocr_parse": (ocr_parse, "SELECT event_id, CASE WHEN event_id % 11 > 0 AND event_id % 6 > 0 THEN date_trunc('second', ts) END AS read_at FROM events"),
    "filename_ts": (filename_ts, "SELECT event_id, CASE WHEN event_id % 7 > 0 THEN date_trunc('second', ts) END AS named_at FROM events"),
    "normalize_id": (normalize_id, "SELECT c_custkey, CASE c_custkey % 5 WHEN 3 THEN c_name WHEN 4 THEN 'COW_0000' ELSE printf('COW_%04d', c_custkey) END AS entity_id FROM customer"),
    "bool_mask": (bool_mask, "SELECT doc_id, doc_id % 8 IN (0, 2, 4) AS by_default, doc_id % 8 IN (0, 2, 4, 6, 7) AS by_true FROM documents"),
    "sample_offsets": (sample_offsets, "WITH l AS (SELECT *, l_quantity - 5 AS d FROM lineitem), m AS (SELECT *, least(1, d / 10) AS g FROM l) SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN d <= 0 OR d <= 2 * g THEN 1 ELSE 3 END AS n, round(CASE WHEN d <= 0 THEN 0 WHEN d <= 2 * g THEN d / 2 ELSE g END, 6) AS first, round(CASE WHEN d <= 0 THEN 0 WHEN d <= 2 * g THEN d / 2 ELSE greatest(g, d - g) END, 6) AS last FROM m"),
    "timestamp_fit": (timestamp_fit, FIT),
    "date_split": (date_split, f"WITH {SPLIT} SELECT video_id, split FROM s"),
    "auto_last_day_split": (auto_last_day_split, "SELECT event_id AS video_id, CASE WHEN event_id % 50 > 1 AND ts::DATE = (SELECT max(ts::DATE) FROM events WHERE event_id % 50 > 1) THEN 'validation' ELSE 'train' END AS split FROM events"),
    "tracklet_split": (tracklet_split, f"WITH {SPLIT}, t AS (SELECT video_id AS tracklet_id, user_id::VARCHAR AS entity_id, CASE WHEN user_id IN (3, 7) THEN 'open_set_test' WHEN split = 'validation' THEN 'val' ELSE split END AS split FROM s WHERE video_id % 5 > 0 AND video_id % 13 > 0) SELECT * FROM t WHERE split = 'open_set_test' OR entity_id IN (SELECT entity_id FROM t WHERE split IN ('train', 'val') GROUP BY 1 HAVING count(DISTINCT split) = 2)"),
    "correction_overlay": (correction_overlay, OVERLAY),
    "conform_union": (conform_union, "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 > 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 2 = 1 OR o_orderkey % 3 = 0 THEN o_totalprice END AS o_totalprice FROM orders"),
    "keep_first_append": (keep_first_append, "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'new' END AS src FROM orders"),
    "latest_state": (latest_state, "SELECT conv_id, turn, role, length(text) AS n FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1"),
    "running_state": (running_state, "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events"),
    "upsert": (upsert, "SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1"),
    "idempotent_append": (idempotent_append, "SELECT DISTINCT user_id, event_type FROM events WHERE user_id % 2 <> 0"),
    "identity_state": (identity_state, "WITH s AS (SELECT user_id || '_' || (event_id % 40) AS entity_id, any_value(user_id) AS u, count(DISTINCT ts::DATE) AS dates FROM events GROUP BY 1) SELECT entity_id, dates, CASE WHEN u % 10 = 0 THEN 'ambiguous' WHEN dates >= 3 THEN 'stable_visual' WHEN dates >= 2 THEN 'visual_confirmed' ELSE 'provisional' END AS identity_state FROM s"),
    "registry_replay": (registry_replay, REPLAY),
    "merged_identities": (merged_identities, f"WITH {LOG}, m AS (SELECT src, arg_max(dst, id) AS a FROM ev WHERE is_merge GROUP BY 1) SELECT DISTINCT e.user_id::VARCHAR AS display_id, CASE WHEN a IS NULL THEN 'provisional' ELSE 'retired' END AS identity_state, a AS alias_of FROM events e LEFT JOIN m ON src = e.user_id::VARCHAR"),
    "video_states": (video_states, VIDEO_STATES),
    "annotation_text": (annotation_text, "WITH a AS (SELECT event_id, CASE WHEN event_id % 4 > 0 THEN event_type ELSE 'UNKNOWN' END AS n, value / 3 AS s FROM events) SELECT event_id, CASE event_id % 3 WHEN 0 THEN n || ' · PREDICTED · similarity=' || printf('%.3f', s) WHEN 1 THEN 'AMBIGUOUS · A / B' ELSE n END AS label FROM a"),
    "pair_keys": (pair_keys, "SELECT least(l_partkey::VARCHAR, l_suppkey::VARCHAR) || '||' || greatest(l_partkey::VARCHAR, l_suppkey::VARCHAR) AS pair_key, count(*) AS n FROM lineitem GROUP BY 1"),
    "evidence_window": (evidence_window, "WITH w AS (SELECT *, greatest(0, l_quantity / 10 - 2) AS a FROM lineitem) SELECT l_orderkey, l_partkey, l_suppkey, round(a, 6) AS low, round(greatest(a, least(l_quantity / 4 + 2, 10)), 6) AS high FROM w"),
    "natural_order": (natural_order, "WITH c AS (SELECT c_custkey, c_name, c_custkey % 3 > 0 AS k FROM customer) SELECT c_custkey, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN k THEN c_custkey END, c_name) AS n FROM c"),
    "frame_sampling": (frame_sampling, "SELECT event_id AS frame_idx, user_id FROM events WHERE event_id % 6 = 0 AND event_id < 5994"),
    "enriched_tracks": (enriched_tracks, "SELECT event_id AS tracklet_id, coalesce(CASE WHEN event_id % 5 IN (2, 3) THEN CASE WHEN event_id % 3 > 0 THEN 'second' END WHEN event_id % 5 < 2 THEN 'first' END, CASE WHEN event_id % 2 = 0 THEN 'own' END) AS domain, CASE WHEN event_id % 5 < 2 THEN 'c1' END AS camera_id FROM events"),
}
