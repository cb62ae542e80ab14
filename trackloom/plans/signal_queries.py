"""Queries over events and lineitem: an entity is a user, a model an event type, a track an order, a frame a line."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import exprs, windows
from trackloom.operators import posture, tracks
from trackloom.plans.session import table

KEYS = ("user_id", "event_type")


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")


def _lines(spark, sf):
    return table(spark, sf, "lineitem")


def longitudinal_baseline(spark, sf):
    rows = posture.baseline(_events(spark, sf), ("user_id",), "ts", "value")
    return rows.select("event_id", "baseline_day_count", *(F.round(c, 6).alias(c) for c in ("baseline", "mad", "delta", "robust_z")))


BASE = """WITH w AS (SELECT *, list(value) OVER f AS l, median(value) OVER f AS med, {days} AS baseline_day_count FROM events
  WINDOW f AS (PARTITION BY {keys} ORDER BY ts RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)),
b AS (SELECT *, CASE WHEN baseline_day_count >= 3 THEN med END AS baseline, CASE WHEN baseline_day_count >= 3 THEN list_aggregate(list_transform(l, lambda x: abs(x - med)), 'median') END AS mad FROM w),
z AS (SELECT *, value - baseline AS delta, (value - baseline) / (1.4826 * mad + 1e-6) AS robust_z FROM b)"""
DAYS = "coalesce(len(list_distinct(list(ts::DATE) OVER f)), 0)"


def health_summaries(spark, sf):
    rows = posture.health_summaries(_events(spark, sf), KEYS, "ts", "value", ratio=None, uncertainty=None, z_threshold=0.8)
    return rows.select("event_id", "baseline_day_count", F.round("robust_z", 6).alias("robust_z"), "status")


def posture_history(spark, sf):
    rows = posture.history(_events(spark, sf), ("user_id",), "value", F.col("ts").asc_nulls_last(), F.col("event_id"))
    return rows.select("event_id", "observation_order", F.round("personal_baseline", 6).alias("personal_baseline"), F.round("delta_from_baseline", 6).alias("delta_from_baseline"))


def review_alerts(spark, sf):
    rows = _events(spark, sf).withColumns({"z": (F.col("value") - 50) / 10, "ratio": (F.col("event_id") % 10) / 10, "u": (F.col("event_id") % 7) / 100})
    return posture.alerts(rows, ("user_id",), F.col("ts"), F.col("event_id"), z="z", ratio="ratio", uncertainty="u").select("event_id", "status")


def posture_summary(spark, sf):
    rows = posture.posture_summary(_lines(spark, sf), "l_orderkey", "l_quantity")
    return rows.select("l_orderkey", "n_scored", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p90", "max", "std", "valid_frame_ratio", "mad", "uncertainty")))


def feature_summary(spark, sf):
    rows = posture.feature_summary(_lines(spark, sf), "l_suppkey", "l_discount")
    return rows.select("l_suppkey", "valid_frame_count", *(F.round(c, 6).alias(c) for c in ("median", "p90", "standard_deviation", "valid_frame_ratio", "uncertainty")))


def valid_frame_ratio(spark, sf):
    scored = _events(spark, sf).withColumn("score", F.when(F.col("event_id") % 4 != 0, F.col("value")))
    return posture.posture_summary(scored, "user_id", "score").select("user_id", "n_scored", F.round("valid_frame_ratio", 6).alias("valid_frame_ratio"))


def grouped_mad(spark, sf):
    rows = windows.grouped_median_mad(_lines(spark, sf), ["l_partkey"], "l_extendedprice")
    return rows.select("l_partkey", F.round("median", 4).alias("median"), F.round("mad", 4).alias("mad"))


def observed_at(spark, sf):
    e = _events(spark, sf)
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return e.select("event_id", exprs.plus_seconds(F.when(F.col("event_id") % 5 > 0, text).otherwise("bad"), (F.col("event_id") % 100) + 0.75).alias("observed_at"))


def arch_score(spark, sf):
    own = _lines(spark, sf).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("o"), F.col("l_partkey").alias("o2"), F.col("l_suppkey").alias("o3"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y")))).alias("p"))
    return own.select("l_orderkey", F.round(posture.arch_score(F.col("p")), 6).alias("arch_score"))


def frame_scores(spark, sf):
    names = F.array(*map(F.lit, posture.BACK))
    own = windows.keep_one(_lines(spark, sf).where("l_linenumber <= 5"), ["l_orderkey", "l_linenumber"], *map(F.col, ("l_partkey", "l_suppkey", "l_quantity")))
    points = own.select(F.lit("t").alias("tracklet_id"), F.col("l_orderkey").alias("frame_idx"), (F.col("l_orderkey") / 25).alias("timestamp_s"), F.element_at(names, F.col("l_linenumber")).alias("keypoint_name"), F.col("l_quantity").alias("x_px"), (F.col("l_tax") * 100).alias("y_px"), (F.col("l_discount") * 10 + 0.2).alias("visibility"), F.lit("m").alias("model_name"), F.lit("1").alias("model_version"))
    return posture.frame_scores(points).select("frame_idx", F.round("arch_score", 6).alias("arch_score"))


def frame_reasons(spark, sf):
    point = lambda x, v: F.struct(x.alias("x"), F.lit(0.0).alias("y"), v.alias("visibility"))
    l = _lines(spark, sf)
    entries = F.create_map(F.lit("withers"), point(F.col("l_quantity"), F.lit(0.9)), F.lit("spine"), point(F.col("l_quantity") + F.col("l_tax") * 100 - 3, F.col("l_discount") * 10), F.lit("hip"), point(F.col("l_quantity") + 3, F.lit(0.8)))
    reasons = posture.frame_reasons(entries, ("withers", "spine", "hip"), F.col("l_tax") * 6, F.col("l_linenumber") == 7, F.col("l_discount") * 10 + 0.6)
    return l.select("l_orderkey", "l_linenumber", F.array_join(reasons, ";").alias("reasons"))


def track_summary(spark, sf):
    e = _events(spark, sf).withColumns({"cx": F.col("value") / 100, "seconds": exprs.seconds(F.col("ts"))})
    rows = tracks.track_summary(e, ["user_id", "event_type"], "cx", "event_id", "seconds", "value")
    return rows.select("user_id", "event_type", "n_frames", *(F.round(c, 8).alias(c) for c in ("span", "net_dx", "duration_s", "mean_confidence")))


def best_frames(spark, sf):
    return tracks.best_frames(_events(spark, sf), ["user_id"], "value", "event_id", 12, ("value", 5.0, 80.0)).select("user_id", "rank", "event_id", "value")


def _judged(spark, sf):
    e = _events(spark, sf).withColumns({"cx": F.col("value") / 100, "seconds": exprs.seconds(F.col("ts"))})
    rows = tracks.track_summary(e, ["user_id", "event_type"], "cx", "event_id", "seconds", "value")
    return tracks.judged_tracks(rows, F.least("n_frames", F.col("user_id") % 5))


def direction_class(spark, sf):
    return _judged(spark, sf).select("user_id", "event_type", "direction")


def reject_reasons(spark, sf):
    return _judged(spark, sf).select("user_id", "event_type", F.array_join("rejection_reasons", ";").alias("reasons"), "valid")


TRACKS = """WITH t AS (SELECT user_id, event_type, count(*) AS n, max((value / 100)::FLOAT) - min((value / 100)::FLOAT) AS span, arg_max((value / 100)::FLOAT, event_id) - arg_min((value / 100)::FLOAT, event_id) AS dx,
  (epoch_us(max(ts)) / 1e6) - (epoch_us(min(ts)) / 1e6) AS duration_s, avg(value) AS conf FROM events GROUP BY 1, 2),
d AS (SELECT *, CASE WHEN dx::DOUBLE >= 0.35 * 0.16 THEN 'ok' WHEN dx::DOUBLE <= -0.35 * 0.16 THEN 'wrong' ELSE 'uncertain' END AS direction FROM t),
j AS (SELECT *, list_filter([CASE WHEN n < 8 THEN 'too_short' END, CASE WHEN span::DOUBLE < 0.16 THEN 'small_motion_span' END, CASE direction WHEN 'wrong' THEN 'wrong_direction' WHEN 'uncertain' THEN 'uncertain_direction' END, CASE WHEN least(n, user_id % 5) < 3 THEN 'not_enough_clean_frames' END], lambda x: x IS NOT NULL) AS r FROM d)"""


def _boxes(spark, sf):
    l = _lines(spark, sf)
    x, y = F.col("l_quantity") * 10, F.col("l_discount") * 1000
    return l.select("l_orderkey", "l_linenumber", F.expr("l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey").alias("det_id"), x.alias("x1"), y.alias("y1"), (x + 100 + F.col("l_tax") * 1000).alias("x2"), (y + 80).alias("y2"), "l_tax", "l_discount")


BOXES = "b AS (SELECT l_orderkey, l_linenumber, l_linenumber::BIGINT * 1000000000000 + l_partkey * 1000000 + l_suppkey AS det_id, l_quantity * 10 AS x1, l_discount * 1000 AS y1, l_quantity * 10 + 100 + l_tax * 1000 AS x2, l_discount * 1000 + 80 AS y2, l_tax, l_discount FROM lineitem)"


def frame_overlap_max(spark, sf):
    return tracks.frame_overlap(_boxes(spark, sf), ["l_orderkey"], "det_id", ["x1", "y1", "x2", "y2"]).select("l_orderkey", "det_id", F.round("overlap", 6).alias("overlap"))


def box_iou(spark, sf):
    b = _boxes(spark, sf)
    fixed = [F.lit(v) for v in (150.0, 20.0, 350.0, 90.0)]
    return b.select("l_orderkey", "l_linenumber", F.round(exprs.box_iou([F.col(c) for c in ("x1", "y1", "x2", "y2")], fixed), 6).alias("iou"))


def torso_box(spark, sf):
    box = exprs.torso_box([F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(640), F.lit(120), "left_to_right")
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", *(c.alias(n) for c, n in zip(box, ("tx1", "ty1", "tx2", "ty2"))))


def expanded_box(spark, sf):
    box = exprs.grown_box([F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(640), F.lit(120))
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", *(c.alias(n) for c, n in zip(box, ("gx1", "gy1", "gx2", "gy2"))))


def quality_score(spark, sf):
    q = exprs.frame_quality([F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(800.0), F.lit(240.0), F.col("l_tax") * 10, F.lit(0.5), F.col("l_discount") * 5)
    return _boxes(spark, sf).select("l_orderkey", "l_linenumber", F.round(q, 9).alias("quality"))


def interpolate_track(spark, sf):
    e = _events(spark, sf).select("user_id", (exprs.seconds(F.col("ts"))).alias("t"), "value")
    asked = _events(spark, sf).where("event_type = 'click'").select("event_id", "user_id", (exprs.seconds(F.col("ts")) + 1800.0).alias("at"))
    samples = e.join(_events(spark, sf).where("event_type <> 'click'").select("user_id", (exprs.seconds(F.col("ts"))).alias("t")), ["user_id", "t"], "left_semi")
    return tracks.interpolated(samples, asked, "user_id", "t", ["value"]).select("event_id", F.round("value", 5).alias("value"))


INTERPOLATE = """WITH s AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, value, lead(epoch_us(ts) / 1e6) OVER w AS t2, lead(value) OVER w AS v2, row_number() OVER w AS n FROM events WHERE event_type <> 'click' WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
q AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 + 1800.0 AS asked FROM events WHERE event_type = 'click'),
m AS (SELECT q.*, s.t, s.value, s.t2, s.v2 FROM q ASOF LEFT JOIN s ON q.user_id = s.user_id AND q.asked >= s.t)
SELECT event_id, round(CASE WHEN m.t IS NULL THEN f.value WHEN m.t2 IS NULL THEN m.value ELSE (1 - (asked - m.t) / (m.t2 - m.t)) * m.value + (asked - m.t) / (m.t2 - m.t) * m.v2 END, 5) AS value
FROM m LEFT JOIN s f ON f.user_id = m.user_id AND f.n = 1"""


def trail(spark, sf):
    rows = tracks.trail(_events(spark, sf), "user_id", "event_id", "value")
    return rows.select("event_id", F.size("trail").cast("long").alias("points"), F.round(F.aggregate("trail", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def tracker(spark, sf):
    e = _events(spark, sf)
    hours = F.floor((exprs.seconds(F.col("ts")) - 1_704_067_200) / 3600).cast("long")  # since 2024
    boxes = e.select((F.col("user_id") % 8).alias("video_id"), hours.alias("frame_idx"), F.col("event_id").alias("det_id"), (F.col("value") * 10).alias("x1"), F.lit(0.0).alias("y1"), (F.col("value") * 10 + 50).alias("x2"), F.lit(40.0).alias("y2"))
    return tracks.track_boxes(boxes, width=1000.0)


def appearance_consistency(spark, sf):
    hist = _lines(spark, sf).select("l_orderkey", F.array("l_quantity", F.col("l_discount") * 100, F.col("l_tax") * 100).alias("h"))
    return tracks.appearance_consistency(hist, "l_orderkey", "h").select("l_orderkey", F.round("consistency", 6).alias("consistency"), "flagged")


QUERIES = {
    "longitudinal_baseline": (longitudinal_baseline, BASE.format(keys="user_id", days=DAYS) + " SELECT event_id, baseline_day_count, round(baseline, 6) AS baseline, round(mad, 6) AS mad, round(delta, 6) AS delta, round(robust_z, 6) AS robust_z FROM z"),
    "health_summaries": (health_summaries, BASE.format(keys="user_id, event_type", days=DAYS) + " SELECT event_id, baseline_day_count, round(robust_z, 6) AS robust_z, CASE WHEN count(*) OVER f = 3 AND sum(coalesce(abs(robust_z) >= 0.8, false)::INT) OVER f >= 2 THEN 'REVIEW_NEEDED' ELSE 'OK' END AS status FROM z WINDOW f AS (PARTITION BY user_id, event_type ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"),
    "posture_history": (posture_history, "WITH h AS (SELECT event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id) AS observation_order, CASE WHEN count(value) OVER f >= 3 THEN median(value) OVER f END AS b FROM events WINDOW f AS (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT event_id, observation_order, round(b, 6) AS personal_baseline, round(value - b, 6) AS delta_from_baseline FROM h"),
    "review_alerts": (review_alerts, "WITH a AS (SELECT *, (abs((value - 50) / 10) >= 3 AND event_id % 10 / 10 >= 0.6 AND event_id % 7 / 100 <= 0.05)::INT AS flag FROM events) SELECT event_id, CASE WHEN count(*) OVER f = 3 AND sum(flag) OVER f >= 2 THEN 'REVIEW_NEEDED' ELSE 'OK' END AS status FROM a WINDOW f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"),
    "posture_summary": (posture_summary, "SELECT l_orderkey, count(l_quantity) AS n_scored, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median, round(quantile_cont(l_quantity, 0.9), 6) AS p90, round(max(l_quantity), 6) AS max, round(coalesce(stddev_samp(l_quantity), 0), 6) AS std, round(count(l_quantity) / count(*), 6) AS valid_frame_ratio, round(mad(l_quantity), 6) AS mad, round(1.4826 * mad(l_quantity) / sqrt(count(l_quantity)), 6) AS uncertainty FROM lineitem GROUP BY l_orderkey"),
    "feature_summary": (feature_summary, "SELECT l_suppkey, count(l_discount) AS valid_frame_count, round(median(l_discount), 6) AS median, round(quantile_cont(l_discount, 0.9), 6) AS p90, round(stddev_pop(l_discount), 6) AS standard_deviation, 1.0::DOUBLE AS valid_frame_ratio, round(1.4826 * mad(l_discount) / sqrt(count(l_discount)), 6) AS uncertainty FROM lineitem GROUP BY l_suppkey"),
    "valid_frame_ratio": (valid_frame_ratio, "SELECT user_id, count(*) FILTER (event_id % 4 <> 0) AS n_scored, round(count(*) FILTER (event_id % 4 <> 0) / count(*), 6) AS valid_frame_ratio FROM events GROUP BY user_id HAVING count(*) FILTER (event_id % 4 <> 0) > 0"),
    "grouped_mad": (grouped_mad, "SELECT l_partkey, round(median(l_extendedprice), 4) AS median, round(mad(l_extendedprice), 4) AS mad FROM lineitem GROUP BY l_partkey"),
    "observed_at": (observed_at, "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN strftime(date_trunc('second', date_trunc('second', ts) + to_microseconds(((event_id % 100) * 1000000 + 750000)::BIGINT)), '%Y-%m-%d %H:%M:%S') ELSE '' END AS observed_at FROM events"),
    "arch_score": (arch_score, "WITH p AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS x, list(l_discount * 100 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS y FROM lineitem GROUP BY 1), c AS (SELECT *, x[-1] - x[1] AS dx, y[-1] - y[1] AS dy FROM p) SELECT l_orderkey, CASE WHEN len(x) >= 3 AND sqrt(dx * dx + dy * dy) > 1e-9 THEN round(list_max(list_transform(range(1, len(x) + 1), lambda i: abs(dx * (y[i] - y[1]) - dy * (x[i] - x[1])))) / (dx * dx + dy * dy), 6) END AS arch_score FROM c"),
    "frame_scores": (frame_scores, "WITH p AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber) AS x, list(l_tax * 100 ORDER BY l_linenumber) AS y, count(*) AS n, count(*) FILTER (l_discount * 10 + 0.2 < 0.25) AS hidden FROM (SELECT * FROM lineitem WHERE l_linenumber <= 5 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1) GROUP BY 1), c AS (SELECT *, x[-1] - x[1] AS dx, y[-1] - y[1] AS dy FROM p WHERE n = 5 AND hidden = 0) SELECT l_orderkey AS frame_idx, round(list_max(list_transform(range(1, 6), lambda i: abs(dx * (y[i] - y[1]) - dy * (x[i] - x[1])))) / (dx * dx + dy * dy), 6) AS arch_score FROM c WHERE sqrt(dx * dx + dy * dy) > 1e-9"),
    "frame_reasons": (frame_reasons, "WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_quantity + l_tax * 100 - 3 AS b, l_quantity + 3 AS c, l_discount * 10 AS v, l_tax * 6 AS o, l_discount * 10 + 0.6 AS s FROM lineitem) SELECT l_orderkey, l_linenumber, concat_ws(';', CASE WHEN v < 0.5 THEN 'low_visibility' END, CASE WHEN o > 0.35 THEN 'occlusion' END, CASE WHEN l_linenumber = 7 THEN 'tracker_jump' END, CASE WHEN NOT s BETWEEN 0.65 AND 1.55 THEN 'implausible_scale_change' END, CASE WHEN NOT (a <= b AND b <= c OR a >= b AND b >= c) THEN 'anatomical_order' END) AS reasons FROM p"),
    "track_summary": (track_summary, TRACKS + " SELECT user_id, event_type, n AS n_frames, round(span::DOUBLE, 8) AS span, round(dx::DOUBLE, 8) AS net_dx, round(duration_s, 8) AS duration_s, round(conf, 8) AS mean_confidence FROM t"),
    "best_frames": (best_frames, "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, event_id, value FROM events WHERE value BETWEEN 5 AND 80 QUALIFY rank <= 12"),
    "direction_class": (direction_class, TRACKS + " SELECT user_id, event_type, direction FROM d"),
    "reject_reasons": (reject_reasons, TRACKS + " SELECT user_id, event_type, array_to_string(r, ';') AS reasons, len(r) = 0 AS valid FROM j"),
    "frame_overlap_max": (frame_overlap_max, f"WITH {BOXES}, p AS (SELECT a.l_orderkey, a.det_id, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.det_id <> b.det_id), m AS (SELECT l_orderkey, det_id, max(i / greatest(1e-12, s - i)) AS o FROM p GROUP BY 1, 2) SELECT b.l_orderkey, b.det_id, round(coalesce(o, 0), 6) AS overlap FROM b LEFT JOIN m ON m.l_orderkey = b.l_orderkey AND m.det_id = b.det_id"),
    "box_iou": (box_iou, f"WITH {BOXES}, p AS (SELECT *, greatest(0, least(x2, 350) - greatest(x1, 150)) * greatest(0, least(y2, 90) - greatest(y1, 20)) AS i FROM b) SELECT l_orderkey, l_linenumber, round(i / greatest(1e-12, (x2 - x1) * (y2 - y1) + 200.0 * 70.0 - i), 6) AS iou FROM p"),
    "torso_box": (torso_box, f"WITH {BOXES}, p AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM b), q AS (SELECT *, greatest(0, least(639, round_even(x1 + 0.08 * w, 0)))::INT AS tx1, greatest(0, least(119, round_even(y1 + 0.04 * h, 0)))::INT AS ty1 FROM p) SELECT l_orderkey, l_linenumber, tx1, ty1, greatest(tx1 + 1, least(640, round_even(x2 - 0.22 * w, 0)::INT)) AS tx2, greatest(ty1 + 1, least(120, round_even(y1 + 0.76 * h, 0)::INT)) AS ty2 FROM q"),
    "expanded_box": (expanded_box, f"WITH {BOXES}, p AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM b), q AS (SELECT *, greatest(0, least(639, round_even(x1 - 0.06 * w, 0)))::INT AS gx1, greatest(0, least(119, round_even(y1 - 0.08 * h, 0)))::INT AS gy1 FROM p) SELECT l_orderkey, l_linenumber, gx1, gy1, greatest(gx1 + 1, least(640, round_even(x2 + 0.06 * w, 0)::INT)) AS gx2, greatest(gy1 + 1, least(120, round_even(y2 + 0.08 * h, 0)::INT)) AS gy2 FROM q"),
    "quality_score": (quality_score, f"WITH {BOXES}, p AS (SELECT *, greatest(0, least(1, 1 - abs((x1 + x2) / 2 / 800 - 0.5) / 0.32)) AS c, greatest(0, least(1, (x2 - x1) * (y2 - y1) / (0.12 * 800 * 240))) AS a, greatest(0, least(1, least(x1 / 800, (800 - x2) / 800, y1 / 240, (240 - y2) / 240) / 0.03)) AS e FROM b) SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, 0.30 * greatest(0, least(1, l_tax * 10)) + 0.22 * c + 0.18 * a + 0.17 * 0.5 + 0.13 * e - 0.35 * greatest(0, least(1, l_discount * 5)))), 9) AS quality FROM p"),
    "interpolate_track": (interpolate_track, INTERPOLATE),
    "trail": (trail, "WITH t AS (SELECT event_id, list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS l FROM events) SELECT event_id, len(l) AS points, round(list_sum(l), 4) AS total FROM t"),
    "tracker": (tracker, None),
    "appearance_consistency": (appearance_consistency, "WITH h AS (SELECT l_orderkey, row_number() OVER () AS n, [l_quantity, l_discount * 100, l_tax * 100] AS v FROM lineitem), p AS (SELECT a.l_orderkey, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS c FROM h a JOIN h b ON a.l_orderkey = b.l_orderkey AND a.n <> b.n), m AS (SELECT l_orderkey, least(1, min(c)) AS c FROM p GROUP BY 1) SELECT o.l_orderkey, round(c, 6) AS consistency, coalesce(c < 0.65, false) AS flagged FROM (SELECT DISTINCT l_orderkey FROM h) o LEFT JOIN m ON m.l_orderkey = o.l_orderkey"),
}
