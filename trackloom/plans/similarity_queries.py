"""Queries over the embeddings table: an entity is a label, a session is vec_id % 4, geometry the last 16 dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom.functions import exprs
from trackloom.operators import cluster, labels as ids, similarity as sim
from trackloom.plans.session import table

UNIT = "list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12))"
E = f"""e AS (SELECT id, s, label, {UNIT} AS v, {UNIT.replace("(v", "(g").replace(", v)", ", g)")} AS g
      FROM (SELECT vec_id AS id, vec_id % 4 AS s, label, embedding::DOUBLE[] AS v, (embedding::DOUBLE[])[49:64] AS g FROM embeddings))"""
PAIRS = f"""WITH {E},
p AS (SELECT a.id AS query_id, a.s AS query_session, b.id AS candidate_id, b.s AS candidate_session, list_dot_product(a.v, b.v) AS cosine, list_dot_product(a.g, b.g) AS geometry_cosine
      FROM e a JOIN e b ON a.s <> b.s AND a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, candidate_id) AS rank FROM p QUALIFY rank <= 5)"""


def _session():
    return F.col("vec_id") % 4


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return sim.candidate_pairs(_embeddings(spark, sf), session=_session(), geometry=F.slice("embedding", 49, 16))


def candidate_pairs_topk(spark, sf):
    return _pairs(spark, sf).withColumns({c: F.round(c, 6) for c in ("cosine", "geometry_cosine")})


def mutual_top1(spark, sf):
    return sim.mutual_best(_pairs(spark, sf)).withColumns({c: F.round(c, 6) for c in ("cosine", "geometry_cosine")})


def pair_top40(spark, sf):
    return ids.best_pairs(_pairs(spark, sf), 40).withColumn("cosine", F.round("cosine", 6))


def _identified(spark, sf):
    e = _embeddings(spark, sf)
    own = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.format_string("E%02d", F.col("label").cast("int")).alias("entity_id"))
    return sim.identify(own.where("id % 5 = 0"), own.where("id % 5 <> 0"), threshold=0.3, min_margin=0.02)


def gallery_identify(spark, sf):
    return _identified(spark, sf).select("id", "predicted", F.round("confidence", 6).alias("confidence"), "is_unknown", "is_ambiguous", F.round("margin", 6).alias("margin"))


def gallery_identify_wide(spark, sf):
    w = sim.wide(_identified(spark, sf), 3)
    return w.withColumns({f"top_{i}_score": F.round(f"top_{i}_score", 6) for i in (1, 2, 3)})


def gallery_summary(spark, sf):
    return sim.identify_summary(_identified(spark, sf))


IDENTIFY = f"""WITH {E},
x AS (SELECT q.id, printf('E%02d', c.label::INT) AS entity_id, list_reverse_sort(list(list_dot_product(q.v, c.v))) AS r FROM e q JOIN e c ON q.id % 5 = 0 AND c.id % 5 <> 0 GROUP BY q.id, c.label),
y AS (SELECT id, entity_id, CASE WHEN len(r) = 1 THEN r[1] ELSE 0.7 * r[1] + 0.3 * list_aggregate(r[1:3], 'median') END AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, entity_id) AS n FROM y),
w AS (SELECT id, max(entity_id) FILTER (n = 1) AS e1, max(score) FILTER (n = 1) AS s1, max(entity_id) FILTER (n = 2) AS e2, max(score) FILTER (n = 2) AS s2, max(entity_id) FILTER (n = 3) AS e3, max(score) FILTER (n = 3) AS s3 FROM z GROUP BY id),
i AS (SELECT *, round(s1, 9) < 0.3 AS is_unknown, NOT round(s1, 9) < 0.3 AND round(s1 - coalesce(s2, -1), 9) < 0.02 AS is_ambiguous, s1 - coalesce(s2, -1) AS margin FROM w)"""


def prototype_mean(spark, sf):
    rows = sim.mean_prototypes(_embeddings(spark, sf), "label")
    return rows.select("label", "members", F.posexplode("prototype").alias("dim", "x")).withColumn("x", F.round("x", 6))


def weighted_pool(spark, sf):
    e = _embeddings(spark, sf).withColumn("track", F.floor(F.col("vec_id") / 7).cast("long")).withColumn("quality", (F.col("vec_id") % 10) / 10)
    rows = sim.pooled_embeddings(e, "track", "embedding", "quality")
    return rows.select("track", F.posexplode("prototype").alias("dim", "x")).withColumn("x", F.round("x", 6))


def l2_normalize(spark, sf):
    return _embeddings(spark, sf).select("vec_id", F.posexplode(exprs.unit(F.col("embedding"))).alias("dim", "x")).withColumn("x", F.round("x", 6))


def retrieval_eval(spark, sf):
    return sim.evaluate_retrieval(_embeddings(spark, sf), entity="label", session=_session()).select("query_id", F.col("entity").alias("label"), "best_candidate_id", F.round("best_similarity", 6).alias("best_similarity"), "correct_rank", "top1", "top5", F.round("average_precision", 6).alias("average_precision"), "eligible")


def retrieval_summary(spark, sf):
    rows = sim.evaluate_retrieval(_embeddings(spark, sf), entity="label", session=_session())
    return sim.retrieval_summary(rows).withColumns({c: F.round(c, 6) for c in ("top1", "top5", "mean_ap")})


RETRIEVAL = f"""WITH {E},
p AS (SELECT a.id, a.label, b.id AS cid, round(list_dot_product(a.v, b.v), 9) AS s, a.label = b.label AS hit FROM e a JOIN e b ON a.id <> b.id AND a.s <> b.s),
r AS (SELECT *, row_number() OVER w AS n, sum(hit::INT) OVER (PARTITION BY id ORDER BY s DESC, cid ROWS UNBOUNDED PRECEDING) AS hits FROM p WINDOW w AS (PARTITION BY id ORDER BY s DESC, cid)),
q AS (SELECT id AS query_id, any_value(label) AS label, max(cid) FILTER (n = 1) AS best_candidate_id, max(s) FILTER (n = 1) AS best_similarity, min(n) FILTER (hit) AS correct_rank, avg(hits / n) FILTER (hit) AS average_precision, count(*) AS eligible FROM r GROUP BY id HAVING bool_or(hit))"""


def prototype_retrieval(spark, sf):
    e = _embeddings(spark, sf).select(F.col("vec_id").alias("id"), "embedding", "label")
    return sim.prototype_retrieval(e.where("id % 4 <> 0"), e.where("id % 4 = 0")).select("id", F.col("entity").alias("label"), "rank")


def _labels(spark, sf):
    return _embeddings(spark, sf).select(F.col("vec_id").alias("tracklet_id"), F.concat(F.lit("cow "), (F.col("label") * 1000 + F.floor(F.col("vec_id") / 60)).cast("string")).alias("entity_id"), F.concat(F.lit("s"), (F.col("vec_id") % 40).cast("string")).alias("session_id"), F.concat(F.lit("v"), (F.col("vec_id") % 40).cast("string")).alias("video_id"), (F.col("vec_id") % 3 > 0).alias("confirmed"))


def _reviews(spark, sf):
    """An edge from every row to the next; one in twelve says different, one same."""
    decision = F.when(F.col("vec_id") % 12 == 1, "different").when(F.col("vec_id") % 12 == 4, "same").otherwise("unsure")
    return _embeddings(spark, sf).select(F.col("vec_id").alias("left_id"), (F.col("vec_id") + 1).alias("right_id"), decision.alias("decision"))


def _states(spark, sf):
    state = F.when(F.col("vec_id") % 11 == 0, "tracklet_error").when(F.col("vec_id") % 11 == 1, "split_requested").otherwise("valid")
    return _embeddings(spark, sf).select(F.col("vec_id").alias("tracklet_id"), state.alias("state"))


L = """l AS (SELECT vec_id AS tracklet_id, printf('COW_%04d', (label * 1000 + vec_id // 60)::INT) AS entity_id, 's' || (vec_id % 40) AS session_id, 'v' || (vec_id % 40) AS video_id, vec_id % 3 > 0 AS confirmed FROM embeddings),
c AS (SELECT * FROM l WHERE confirmed),
r AS (SELECT vec_id AS left_id, vec_id + 1 AS right_id, CASE vec_id % 12 WHEN 1 THEN 'different' WHEN 4 THEN 'same' ELSE 'unsure' END AS decision FROM embeddings),
x AS (SELECT r.*, a.entity_id AS le, b.entity_id AS re, CASE WHEN decision = 'different' AND a.entity_id = b.entity_id THEN 'different_pair_inside_identity' WHEN decision = 'same' AND a.entity_id <> b.entity_id THEN 'same_pair_across_identities' END AS conflict_type
      FROM r LEFT JOIN c a ON a.tracklet_id = left_id LEFT JOIN c b ON b.tracklet_id = right_id),
y AS (SELECT conflict_type, le AS entity_id FROM x WHERE conflict_type IS NOT NULL UNION ALL SELECT conflict_type, re FROM x WHERE conflict_type LIKE 'same%'),
a AS (SELECT entity_id, count(DISTINCT tracklet_id) AS tracklets, count(DISTINCT session_id) AS sessions, count(DISTINCT video_id) AS videos,
             count(*) FILTER (tracklet_id % 11 < 2) AS excluded_flagged_tracklets, count(*) FILTER (tracklet_id % 11 >= 2) AS usable,
             (SELECT count(*) FROM (SELECT session_id FROM c d WHERE d.entity_id = c.entity_id GROUP BY session_id HAVING count(*) > 1)) AS same_session_duplicates,
             (SELECT count(*) FROM y WHERE y.entity_id = c.entity_id AND conflict_type LIKE 'different%') AS different_edges_inside_identity,
             (SELECT count(*) FROM y WHERE y.entity_id = c.entity_id AND conflict_type LIKE 'same%') AS same_edges_across_identities
      FROM c GROUP BY entity_id),
audit AS (SELECT * EXCLUDE usable, CASE WHEN different_edges_inside_identity + same_edges_across_identities > 0 THEN 'conflict' WHEN usable < 2 THEN 'needs_more_tracklets' WHEN same_session_duplicates > 0 THEN 'warning_same_session_duplicates' ELSE 'safe' END AS status,
                 usable >= 2 AND different_edges_inside_identity + same_edges_across_identities = 0 AS training_eligible FROM a)"""


def _audit(spark, sf):
    return ids.audit_identities(_labels(spark, sf), _reviews(spark, sf), ids.flagged_tracklets(_states(spark, sf)))


def pair_label_audit(spark, sf):
    return ids.label_conflicts(_labels(spark, sf), _reviews(spark, sf))


def safe_labels(spark, sf):
    return ids.safe_labels(_labels(spark, sf), _audit(spark, sf)).select("tracklet_id", "entity_id", "training_eligible", "audit_status")


def audit_summary(spark, sf):
    audit = _audit(spark, sf)
    return ids.audit_summary(audit, ids.safe_labels(_labels(spark, sf), audit))


def flagged_exclusion(spark, sf):
    return ids.without_flagged(_labels(spark, sf), _states(spark, sf)).select("tracklet_id", "session_id")


def triage_queue(spark, sf):
    return ids.triage_queue(_pairs(spark, sf), _labels(spark, sf), _reviews(spark, sf)).withColumn("cosine", F.round("cosine", 6))


def auto_confirm_candidates(spark, sf):
    found = ids.auto_confirm_candidates(_pairs(spark, sf), _reviews(spark, sf), cosine=0.2, geometry=0.1)
    return found.withColumns({c: F.round(c, 6) for c in ("cosine", "geometry_cosine")})


def catalog(spark, sf):
    return ids.catalog(_labels(spark, sf).withColumn("entity_id", exprs.normal_id(F.col("entity_id"))))


def next_id(spark, sf):
    return ids.next_id(_labels(spark, sf).withColumn("entity_id", exprs.normal_id(F.col("entity_id"))))


def different_constraints(spark, sf):
    return ids.different_within(_reviews(spark, sf), _labels(spark, sf).where("confirmed")).select("left_id", "right_id")


def identity_candidates(spark, sf):
    normal = _labels(spark, sf).withColumn("entity_id", exprs.normal_id(F.col("entity_id")))
    vectors = _embeddings(spark, sf).select(F.col("vec_id").alias("tracklet_id"), "embedding")
    found = sim.entity_candidates(vectors, normal.withColumn("session_id", (F.col("tracklet_id") % 40).cast("string")), "COW_3002", k=20, exclude_seen_sessions=False)
    return found.withColumn("similarity", F.round("similarity", 6))


def greedy_cluster(spark, sf):
    return cluster.greedy_clusters(_embeddings(spark, sf).withColumn("s", _session()), ["s", "vec_id"], id_col="vec_id", session_col="s", threshold=0.4, min_margin=0.02)


def cluster_summary(spark, sf):
    assigned = _embeddings(spark, sf).select(F.col("vec_id").alias("tracklet_id"), F.format_string("PSEUDO_%04d", (F.col("vec_id") / 9).cast("int")).alias("pseudo_id"), (F.col("vec_id") % 4).alias("session_id"))
    return cluster.cluster_summary(assigned, _labels(spark, sf).withColumn("entity_id", exprs.normal_id(F.col("entity_id"))))


QUERIES = {
    "candidate_pairs_topk": (candidate_pairs_topk, PAIRS + " SELECT query_id, query_session, rank, candidate_id, candidate_session, round(cosine, 6) AS cosine, round(geometry_cosine, 6) AS geometry_cosine FROM k"),
    "mutual_top1": (mutual_top1, PAIRS + " SELECT a.query_id AS left_id, a.candidate_id AS right_id, round(a.cosine, 6) AS cosine, round(a.geometry_cosine, 6) AS geometry_cosine FROM k a JOIN k b ON a.rank = 1 AND b.rank = 1 AND a.query_id = b.candidate_id AND a.candidate_id = b.query_id WHERE a.query_id < a.candidate_id"),
    "pair_top40": (pair_top40, PAIRS + " SELECT least(query_id, candidate_id) AS left_id, greatest(query_id, candidate_id) AS right_id, round(max(cosine), 6) AS cosine FROM k GROUP BY 1, 2 ORDER BY round(max(cosine), 9) DESC, 1, 2 LIMIT 40"),
    "gallery_identify": (gallery_identify, IDENTIFY + " SELECT id, CASE WHEN is_unknown THEN 'UNKNOWN' WHEN is_ambiguous THEN 'AMBIGUOUS' ELSE e1 END AS predicted, round(s1, 6) AS confidence, is_unknown, is_ambiguous, round(margin, 6) AS margin FROM i"),
    "gallery_identify_wide": (gallery_identify_wide, IDENTIFY + " SELECT id, CASE WHEN is_unknown THEN 'UNKNOWN' WHEN is_ambiguous THEN 'AMBIGUOUS' ELSE e1 END AS predicted, e1 AS top_1_id, round(s1, 6) AS top_1_score, e2 AS top_2_id, round(s2, 6) AS top_2_score, e3 AS top_3_id, round(s3, 6) AS top_3_score FROM i"),
    "gallery_summary": (gallery_summary, IDENTIFY + " SELECT count(*) AS queries, count(*) FILTER (NOT is_unknown) AS known, count(*) FILTER (is_unknown) AS unknown, count(*) FILTER (is_ambiguous) AS ambiguous, count(*) FILTER (NOT is_unknown AND NOT is_ambiguous) AS known_strict FROM i"),
    "prototype_mean": (prototype_mean, f"WITH {E}, u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM e), m AS (SELECT label, dim, avg(x) AS x, count(*) AS members FROM u GROUP BY 1, 2) SELECT label, members, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m"),
    "weighted_pool": (weighted_pool, "WITH u AS (SELECT vec_id // 7 AS track, greatest(vec_id % 10 / 10, 0.05) AS w, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), m AS (SELECT track, dim, sum(w * x) / sum(w) AS x FROM u GROUP BY 1, 2) SELECT track, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY track)), 6) AS x FROM m"),
    "l2_normalize": (l2_normalize, f"WITH {E} SELECT id AS vec_id, generate_subscripts(v, 1) - 1 AS dim, round(unnest(v), 6) AS x FROM e"),
    "retrieval_eval": (retrieval_eval, RETRIEVAL + " SELECT query_id, label, best_candidate_id, round(best_similarity, 6) AS best_similarity, correct_rank, correct_rank = 1 AS top1, correct_rank <= 5 AS top5, round(average_precision, 6) AS average_precision, eligible FROM q"),
    "retrieval_summary": (retrieval_summary, RETRIEVAL + " SELECT count(*) AS queries, round(avg((correct_rank = 1)::INT), 6) AS top1, round(avg((correct_rank <= 5)::INT), 6) AS top5, round(avg(average_precision), 6) AS mean_ap, median(correct_rank) AS median_rank FROM q"),
    "prototype_retrieval": (prototype_retrieval, f"WITH {E}, u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM e WHERE id % 4 <> 0), m AS (SELECT label, dim, avg(x) AS x FROM u GROUP BY 1, 2), p AS (SELECT label, list(x ORDER BY dim) AS v FROM m GROUP BY label), n AS (SELECT label, {UNIT} AS v FROM p), w AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 4 = 0), s AS (SELECT w.id, w.label, n.label AS other, round(list_dot_product(w.v, n.v), 9) AS s FROM w, n), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other DESC) AS rank FROM s) SELECT id, label, rank FROM r WHERE label = other"),
    "pair_label_audit": (pair_label_audit, f"WITH {L} SELECT conflict_type, le AS entity_id, CASE WHEN conflict_type LIKE 'same%' THEN re ELSE '' END AS other_entity_id, left_id, right_id, decision FROM x WHERE conflict_type IS NOT NULL"),
    "identity_audit": (_audit, f"WITH {L} SELECT * FROM audit"),
    "audit_summary": (audit_summary, f"WITH {L} SELECT count(*) AS identities, count(*) FILTER (training_eligible) AS safe_identities, count(*) FILTER (status = 'conflict') AS conflicted_identities, (SELECT count(*) FROM c JOIN audit USING (entity_id) WHERE training_eligible) AS training_safe_tracklets FROM audit"),
    "safe_labels": (safe_labels, f"WITH {L} SELECT tracklet_id, l.entity_id, coalesce(training_eligible, false) AND confirmed AS training_eligible, coalesce(status, 'unassigned') AS audit_status FROM l LEFT JOIN audit USING (entity_id)"),
    "flagged_exclusion": (flagged_exclusion, "SELECT vec_id AS tracklet_id, 's' || (vec_id % 40) AS session_id FROM embeddings WHERE vec_id % 11 >= 2"),
    "triage_queue": (triage_queue, PAIRS + " SELECT query_id AS tracklet_id, candidate_id, round(cosine, 6) AS cosine FROM k WHERE rank = 1 AND query_id % 3 = 0 AND abs(query_id - candidate_id) <> 1"),
    "auto_confirm_candidates": (auto_confirm_candidates, PAIRS + " SELECT a.query_id AS left_id, a.candidate_id AS right_id, round(a.cosine, 6) AS cosine, round(a.geometry_cosine, 6) AS geometry_cosine FROM k a JOIN k b ON a.rank = 1 AND b.rank = 1 AND a.query_id = b.candidate_id AND a.candidate_id = b.query_id WHERE a.query_id < a.candidate_id AND a.cosine >= 0.2 AND a.geometry_cosine >= 0.1 AND NOT (a.candidate_id = a.query_id + 1 AND a.query_id % 12 = 1)"),
    "catalog": (catalog, f"WITH {L} SELECT entity_id, count(DISTINCT tracklet_id) AS tracklets, count(DISTINCT video_id) AS videos, count(DISTINCT session_id) AS sessions FROM c GROUP BY entity_id"),
    "next_id": (next_id, "SELECT printf('COW_%04d', (max(label * 1000 + vec_id // 60) + 1)::INT) AS entity_id FROM embeddings"),
    "different_constraints": (different_constraints, f"WITH {L} SELECT left_id, right_id FROM r WHERE decision = 'different' AND left_id IN (SELECT tracklet_id FROM c) AND right_id IN (SELECT tracklet_id FROM c)"),
    "identity_candidates": (identity_candidates, f"WITH {E}, u AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM e WHERE label = 3 AND id // 60 = 2 AND id % 3 > 0), m AS (SELECT dim, avg(x) AS x FROM u GROUP BY 1), p AS (SELECT list(x ORDER BY dim) AS v FROM m), n AS (SELECT {UNIT} AS v FROM p) SELECT id AS tracklet_id, (id % 40)::VARCHAR AS session_id, round(list_dot_product(e.v, n.v), 6) AS similarity FROM e, n WHERE id % 3 = 0 ORDER BY round(list_dot_product(e.v, n.v), 9) DESC, id LIMIT 20"),
    "greedy_cluster": (greedy_cluster, None),
    "cluster_summary": (cluster_summary, f"WITH {L} SELECT printf('PSEUDO_%04d', (l.tracklet_id // 9)::INT) AS pseudo_id, count(*) AS tracklets, count(DISTINCT l.tracklet_id % 4) AS sessions, count(*) FILTER (c.entity_id IS NULL) AS unlinked, coalesce(min(c.entity_id), '') AS linked_entity FROM l LEFT JOIN c ON c.tracklet_id = l.tracklet_id GROUP BY 1"),
}
