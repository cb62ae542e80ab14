import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackloom.operators import bundle, cluster, labels as ids, registry, similarity as sim
from trackloom.sources.tables import schema_of

NOW = "2026-09-01T00:00:00"


def label_rows(spark, names):
    names = {t: f"COW_{int(e[3:]):04d}" if e[:3] == "cow" else e for t, e in names.items()}
    rows = [(t, "", f"s{i}", f"v{i}", e, bool(e), "", "", "") for i, (t, e) in enumerate(names.items())]
    return spark.createDataFrame(rows, schema_of("labels"))


def empty(spark, name):
    return spark.createDataFrame([], schema_of(name))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id string, embedding array<float>, session_id string, label string")


def by(df, key="tracklet_id", value="entity_id"):
    return {r[key]: r[value] for r in df.collect()}


def test_candidate_pairs_both_ways(spark):
    rng = np.random.default_rng(0)
    rows = [(f"t{i:03d}", rng.normal(size=8).astype(np.float32).tolist(), f"s{i % 5}", "x") for i in range(120)]
    v = vectors(spark, rows).withColumn("geo", F.slice("embedding", 1, 3))
    fast = {(r.query_id, r.rank): (r.candidate_id, round(r.cosine, 6)) for r in sim.candidate_pairs(v, 4, geometry="geo").collect()}
    slow = {(r.query_id, r.rank): (r.candidate_id, round(r.cosine, 6)) for r in sim.candidate_pairs_by_join(v, 4).collect()}
    assert fast == slow and len(fast) == 480
    assert sim.candidate_pairs(v.where("session_id = 's1'")).count() == 0
    small = sim.block_compare  # more blocks give the same result
    try:
        sim.block_compare = lambda q, c, k, s, candidate_key=None, block=0: small(q, c, k, s, candidate_key, 17)
        assert {(r.query_id, r.rank): (r.candidate_id, round(r.cosine, 6)) for r in sim.candidate_pairs(v, 4).collect()} == fast
    finally:
        sim.block_compare = small


def test_retrieval(spark):
    v = vectors(spark, [("t1", [1.0, 0.0], "s1", "a"), ("t2", [0.99, 0.01], "s2", "a"), ("t3", [0.0, 1.0], "s1", "b"), ("t4", [0.2, 0.8], "s2", "b")])
    rows = sim.evaluate_retrieval(v)
    s = sim.retrieval_summary(rows).first()
    assert (s.queries, s.top1, s.top5, s.mean_ap) == (4, 1.0, 1.0, 1.0)
    none = sim.retrieval_summary(sim.evaluate_retrieval(v.where("label = 'a' AND vec_id = 't1'"))).first()
    assert none.queries == 0 and none.top1 is None
    train = spark.createDataFrame([("1", [1.0, 0.0], "a"), ("2", [0.0, 1.0], "b")], "id string, embedding array<float>, label string")
    asked = spark.createDataFrame([("q1", [0.9, 0.1], "a"), ("q2", [0.1, 0.9], "b"), ("q3", [0.1, 0.9], "a"), ("q4", [1.0, 0.0], "new")], "id string, embedding array<float>, label string")
    assert by(sim.prototype_retrieval(train, asked), "id", "rank") == {"q1": 1, "q2": 1, "q3": 2}


def test_identify_and_contract(spark):
    q = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", [0.7, 0.7]), ("q3", [-1.0, 0.0])], "id string, vector array<float>")
    g = spark.createDataFrame([("p1", [1.0, 0.0], "a"), ("p2", [0.9, 0.1], "a"), ("p3", [0.0, 1.0], "b")], "id string, vector array<float>, entity_id string")
    got = {r.id: r for r in sim.identify(q, g, 0.5, 0.2).collect()}
    assert got["q1"].predicted == "a" and got["q2"].predicted == "AMBIGUOUS" and got["q3"].predicted == "UNKNOWN"
    one = sim.identify(q.where("id = 'q1'"), g.where("entity_id = 'a'"), 0.5, 0.2).first()
    assert one.margin == pytest.approx(one.confidence + 1)
    s = sim.identify_summary(sim.identify(q, g, 0.5, 0.2)).first()
    assert (s.known, s.unknown, s.ambiguous, s.known_strict) == (2, 1, 1, 1)
    known = lambda **c: spark.range(1).select(*(F.lit(v).alias(k) for k, v in c.items()))
    full = dict(checkpoint_sha256="x", preprocessing_profile="p", crop_version="1", embedding_schema_version="1", backend="b1")
    sim.check_contract(known(**full), known(**full | {"backend": "b2"}))
    with pytest.raises(ValueError, match="sha256"):
        sim.check_contract(known(**full), known(**full | {"checkpoint_sha256": "y"}))
    with pytest.raises(ValueError, match="backend"):
        sim.check_contract(known(**full | {"crop_version": "unknown"}), known(**full | {"backend": "b2"}))


def test_gallery_and_search(spark):
    labels = label_rows(spark, {"t1": "COW_0001", "t2": "COW_0001", "t3": "", "t4": "", "t5": "COW_0002"})
    e = spark.createDataFrame([("t1", [1.0, 0.0]), ("t2", [0.99, 0.01]), ("t3", [0.0, 1.0]), ("t4", [0.8, 0.2]), ("t5", [1.0, 0.0])], "tracklet_id string, embedding array<float>")
    assert [r.tracklet_id for r in sim.entity_candidates(e, labels, "COW_0001", 2).collect()] == ["t4", "t3"]
    barred = ids.reject_candidate(empty(spark, "identity_exclusions"), "cow1", "t4", NOW)
    assert [r.tracklet_id for r in sim.entity_candidates(e, labels, "COW_0001", 2, barred).collect()] == ["t3"]
    assert [(r.entity_id, r.tracklets) for r in ids.catalog(labels).orderBy("entity_id").collect()] == [("COW_0001", 2), ("COW_0002", 1)]
    flagged = ids.flagged_tracklets(ids.set_state(empty(spark, "tracklet_reviews"), "t2", "tracklet_error", NOW))
    tracks = spark.createDataFrame([("t1", "side")], "tracklet_id string, view string")
    gallery = sim.build_gallery(labels, e, tracks, flagged).collect()
    assert {(r.tracklet_id, r.view) for r in gallery} == {("t1", "side"), ("t5", "unknown")}


def test_clusters(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0], "s1"), ("b", [0.999, 0.01], "s1"), ("c", [0.998, 0.02], "s2")], "tracklet_id string, embedding array<float>, session_id string")
    got = by(cluster.greedy_clusters(v, ["session_id", "tracklet_id"], threshold=0.9), value="pseudo_id")
    assert got["a"] != got["b"] and got["c"] in (got["a"], got["b"])
    rows = cluster.greedy_clusters(v, ["session_id", "tracklet_id"], threshold=0.9, one_per_session=False)
    s = cluster.cluster_sizes(rows).first()
    assert (s.tracks, s.clusters, s.shared_clusters) == (3, 1, 1)


def reviews(spark, *edges):
    return spark.createDataFrame([(a, b, d, "", None, "", NOW) for a, b, d in edges], schema_of("pair_reviews"))


def test_audit(spark):
    labels = label_rows(spark, {"a1": "cow 1", "a2": "cow 1", "b1": "cow 2", "b2": "cow 2", "b3": "cow 2"})
    audit = {r.entity_id: r for r in ids.audit_identities(labels, reviews(spark, ("a1", "a2", "different"))).collect()}
    assert audit["COW_0001"].status == "conflict" and not audit["COW_0001"].training_eligible and audit["COW_0002"].training_eligible
    flagged = spark.createDataFrame([("a1",), ("b1",)], "tracklet_id string")
    audit = {r.entity_id: r for r in ids.audit_identities(labels, reviews(spark), flagged).collect()}
    assert audit["COW_0001"].status == "needs_more_tracklets" and audit["COW_0002"].status == "safe" and audit["COW_0002"].excluded_flagged_tracklets == 1
    across = {r.entity_id: r.status for r in ids.audit_identities(labels, reviews(spark, ("a1", "b1", "same"))).collect()}
    assert set(across.values()) == {"conflict"}


def test_assignment_changes(spark):
    labels = label_rows(spark, {"t1": "cow22", "t2": "cow22", "t3": "cow23", "t4": "cow23", "t5": ""})
    merged, log, entity = ids.accept_same(labels, reviews(spark), "t2", "t3", NOW)
    assert entity == "COW_0022" and set(by(merged.where("tracklet_id <> 't5'")).values()) == {"COW_0022"}
    assert [(r.decision, r.notes) for r in log.collect()] == [("same", "Merged COW_0023 into COW_0022")]
    with pytest.raises(ids.Conflict):
        ids.accept_same(labels, reviews(spark, ("t1", "t4", "different")), "t2", "t3", NOW)
    new, entity = ids.assign(labels, ["t5"], None, NOW)
    assert entity == "COW_0024" and by(ids.unassign(new, ["t5"]))["t5"] == ""
    with pytest.raises(ValueError, match="unknown tracks"):
        ids.assign(labels, ["zz"], None, NOW)
    assert by(ids.rename(labels, "cow22", "cow9", NOW))["t1"] == "COW_0009"
    with pytest.raises(ValueError, match="exists"):
        ids.rename(labels, "cow22", "cow23", NOW)
    with pytest.raises(ids.Conflict):
        ids.record_different(labels, reviews(spark), "t1", "t2", NOW)
    barred = ids.reject_candidate(empty(spark, "identity_exclusions"), "cow22", "t5", NOW)
    updated, barred, _ = ids.assign_checked(labels, reviews(spark), barred, ["t5"], "cow22", NOW)
    assert barred.count() == 0 and by(updated)["t5"] == "COW_0022"
    with pytest.raises(ids.Conflict):
        ids.assign_checked(labels, reviews(spark, ("t1", "t5", "different")), barred, ["t5"], "cow22", NOW)
    assert ids.save_review(reviews(spark, ("b", "a", "unsure")), "a", "b", "same", NOW).count() == 1
    with pytest.raises(ValueError):
        ids.save_review(reviews(spark), "a", "b", "maybe", NOW)
    states = ids.set_state(ids.set_state(empty(spark, "tracklet_reviews"), "t1", "valid", NOW), "t1", "split_requested", NOW, 12.5)
    assert [(r.state, r.split_at_s) for r in states.collect()] == [("split_requested", 12.5)]


def pair_table(spark, *rows):
    return spark.createDataFrame(rows, "query_id string, rank int, candidate_id string, cosine double, geometry_cosine double")


@pytest.mark.parametrize("case", ["plain", "geometry", "different", "excluded"])
def test_auto_confirm(spark, case):
    g = 0.1 if case == "geometry" else 0.8
    pairs = pair_table(spark, ("t1", 1, "t2", 0.97, g), ("t2", 1, "t1", 0.97, g), ("t3", 1, "t4", 0.99, 0.9), ("t4", 1, "t1", 0.99, 0.9))
    labels = label_rows(spark, {"t1": "cow1", "t2": "", "t3": "", "t4": ""})
    log = reviews(spark, *([("t1", "t2", "different")] if case == "different" else []))
    barred = empty(spark, "identity_exclusions")
    if case == "excluded":
        barred = ids.reject_candidate(barred, "cow1", "t2", NOW)
    applied = ids.auto_confirm(labels, log, barred, pairs, NOW)[2]
    assert applied == ([("t1", "t2", "COW_0001")] if case == "plain" else [])


def test_triage(spark):
    pairs = pair_table(spark, ("t1", 1, "t2", 0.99, 0.5), ("t2", 1, "t9", 0.98, 0.5), ("t3", 1, "t4", 0.97, 0.5), ("t4", 1, "t3", 0.96, 0.5))
    labels = label_rows(spark, {"t1": "cow1", "t2": "", "t3": ""})
    assert [r.tracklet_id for r in ids.triage_queue(pairs, labels, reviews(spark)).collect()] == ["t2", "t3"]
    assert [r.tracklet_id for r in ids.triage_queue(pairs, labels, reviews(spark, ("t9", "t2", "unsure"))).collect()] == ["t3"]
    assert [(r.left_id, r.right_id) for r in ids.best_pairs(pairs, 2).collect()] == [("t1", "t2"), ("t2", "t9")]


def test_load_labels(spark):
    tracks = spark.createDataFrame([("t1", "s", "v", True), ("t2", "s", "v", True), ("t3", "s", "v", False)], "tracklet_id string, session_id string, video_id string, valid boolean")
    old = spark.createDataFrame([("t1", "cow 3", True, 1), ("t1", "cow 4", True, 2), ("t2", "", True, 3)], "tracklet_id string, entity_id string, confirmed boolean, n int")
    got = {r.tracklet_id: r for r in ids.load_labels(tracks, None, old, "n").collect()}
    assert got["t1"].entity_id == "COW_0004" and got["t1"].confirmed and not got["t2"].confirmed and len(got) == 2
    with pytest.raises(Exception, match="more than one label"):
        ids.checked_unique(old).collect()


def registry_tables(spark):
    entities = spark.createDataFrame([("a", "provisional"), ("b", "provisional")], "display_id string, identity_state string")
    own = spark.createDataFrame([("t1", "a"), ("t2", "b")], "tracklet_id string, entity_id string")
    edges = spark.createDataFrame([("e1", "t1", "t2", "different", None)], "edge_id string, left_id string, right_id string, decision string, superseded_by string")
    return entities, own, edges, spark.createDataFrame([], registry.IDENTITY_EVENTS)


def test_merge_split_undo(spark):
    entities, own, edges, events = registry_tables(spark)
    with pytest.raises(ValueError, match="different"):
        registry.merge(entities, own, edges, events, ["b"], "a", "m1")
    events, edges2 = registry.merge(entities, own, edges, events, ["b"], "a", "m1", resolve=True)
    assert by(registry.replay(own, events)) == {"t1": "a", "t2": "a"} and edges2.first().superseded_by == "m1"
    assert by(registry.identity_view(entities, events), "display_id", "identity_state") == {"a": "provisional", "b": "retired"}
    more, events = registry.split(entities, own, events, "a", ["t2"], "c", "s1")
    assert by(registry.replay(own, events))["t2"] == "c"
    with pytest.raises(ValueError, match="later"):
        registry.undo(events, edges2, "m1", "u0")
    events, edges2 = registry.undo(events, edges2, "s1", "u1")
    assert by(registry.identity_view(more, events), "display_id", "identity_state")["c"] == "retired"
    events, edges2 = registry.undo(events, edges2, "m1", "u2")
    assert by(registry.replay(own, events)) == {"t1": "a", "t2": "b"} and edges2.first().superseded_by is None
    with pytest.raises(ValueError, match="already"):
        registry.undo(events, edges2, "m1", "u3")
    with pytest.raises(ValueError, match="source's"):
        registry.split(entities, own, events, "a", ["t2"], "d", "s2")
    with pytest.raises(ValueError):
        registry.create(entities, "z", "no state")


def test_registration_is_idempotent(spark):
    tracks = spark.createDataFrame([("t1", "v1", 1.0, 2.0, False, "x")], "tracklet_id string, video_id string, start_s double, end_s double, valid boolean, note string")
    none = spark.createDataFrame([], "tracklet_id string, model_version string")
    first = registry.new_tracklets(none, tracks)
    assert first.first().review_state == "rejected" and '"note":"x"' in first.first().metadata_json
    assert registry.new_tracklets(first, tracks).count() == 0
    e = spark.createDataFrame([("t1", [1.0, 2.0])], "tracklet_id string, embedding array<float>")
    added = registry.new_embeddings(none, e, registry.model_version("m", "0123456789abcdefff"))
    assert added.first().dimensions == 2 and added.first().model_version == "m:0123456789abcdef" and registry.new_embeddings(added, e, "m:0123456789abcdef").count() == 0


def test_video_work(spark):
    videos = spark.createDataFrame([("v1", "INGESTED"), ("v2", "INGESTED")], "video_id string, status string")
    events = spark.createDataFrame([(1, "v1", "transition", "INGESTED", "TRACKED", None), (2, "v1", "transition", "INGESTED", "EMBEDDED", None), (3, "v1", "error", None, None, "boom" * 2000)], registry.VIDEO_EVENTS)
    got = {r.video_id: r for r in registry.video_states(videos, events).collect()}
    assert got["v1"].status == "TRACKED" and got["v1"].attempts == 2 and len(got["v1"].last_error) == 4000 and got["v2"].status == "INGESTED"
    step = registry.next_step
    assert step({"video_id": "v", "status": "INGESTED", "canonical_video_id": "w"}, True) == [("INGESTED", "DUPLICATE_LINKED")]
    assert step({"video_id": "v", "status": "EMBEDDED"}, True, known=1, ambiguous=1) == [("EMBEDDED", "ID_UNRESOLVED")]
    assert [t for _, t in step({"video_id": "v", "status": "INGESTED"}, False)] == ["TRACKED", "EMBEDDED", "ID_PENDING"]


def test_bundle(spark):
    track = lambda *n: spark.createDataFrame([(t, "s", "v") for t in n], "tracklet_id string, session_id string, video_id string")
    e = lambda *n: spark.createDataFrame([(t, [1.0], "b") for t in n], "tracklet_id string, embedding array<float>, backend string")
    assigned = spark.createDataFrame([("n1", "P1")], "tracklet_id string, pseudo_id string")
    base = {"tracklets": track("o1"), "embeddings": e("o1"), "labels": label_rows(spark, {"o1": "cow1"}), "pair_reviews": reviews(spark, ("o1", "o2", "same"))}
    new = {"tracklets": track("n1"), "embeddings": e("n1"), "assignments": assigned, "pair_reviews": reviews(spark, ("n1", "n2", "same"))}
    out = bundle.review_bundle(base, new, NOW, "NEW_1_")
    assert out["embeddings"].count() == 2 and out["pair_reviews"].count() == 2
    assert by(out["labels"], value="pseudo_id")["n1"] == "NEW_1_P1" and by(out["labels"])["o1"] == "COW_0001"
    with pytest.raises(ValueError, match="share"):
        bundle.joined_embeddings(e("a"), e("a"))
    with pytest.raises(ValueError, match="backend"):
        bundle.joined_embeddings(e("a"), e("b").withColumn("backend", F.lit("c")))


def test_entity_scores_of_large_entities(spark, monkeypatch):
    rng = np.random.default_rng(3)
    owners = ["big"] * 40 + ["mid"] * 7 + [f"e{i % 11}" for i in range(25)] + ["lone"]
    g = [(f"p{i}", rng.normal(size=4).tolist(), e) for i, e in enumerate(owners)]
    q = [(f"q{i}", rng.normal(size=4).tolist()) for i in range(9)]
    size = lambda v: np.array(v) / np.linalg.norm(v)
    want = {}
    for name, v in q:
        for e in set(owners):
            best = sorted((float(size(v) @ size(p)) for _, p, o in g if o == e), reverse=True)
            want[name, e] = best[0] if len(best) == 1 else 0.7 * best[0] + 0.3 * float(np.median(best[:3]))
    queries, gallery = spark.createDataFrame(q, "id string, vector array<double>"), spark.createDataFrame(g, "id string, vector array<double>, entity_id string")
    plain = sim.block_compare
    monkeypatch.setattr(sim, "SLICE", 5)
    monkeypatch.setattr(sim, "block_compare", lambda *a, **k: plain(*a, **k | {"block": 20}))
    scores = lambda k: {(r.id, r.entity_id): r.score for r in sim.entity_scores(queries, gallery, k).collect()}
    assert scores(None) == pytest.approx(want)
    few = scores(2)
    assert len(few) < len(want) and all(want[x] == pytest.approx(few[x]) for x in few)
    for r in sim.identify(queries, gallery, -1.0, 0.0, 2).collect():
        ranked = sorted((e for e in set(owners)), key=lambda e: -want[r.id, e])
        assert [c.entity_id for c in r.candidates] == ranked[:2]


def test_retrieval_among_equal_scores(spark):
    rows = [(f"t{i:02}", [1.0, float(i % 3)], f"s{i % 5}", "ab"[i % 2]) for i in range(20)]
    got = {r.query_id: r for r in sim.evaluate_retrieval(vectors(spark, rows)).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, *_ in rows}
    for name, _, session, label in rows:
        ranked = sorted(((-round(float(unit[name] @ unit[i]), 9), i, e) for i, _, s, e in rows if s != session))
        places = [n + 1 for n, x in enumerate(ranked) if x[2] == label]
        assert got[name].correct_rank == places[0] and got[name].average_precision == pytest.approx(np.mean([(n + 1) / p for n, p in enumerate(places)]))


def test_candidates_among_copies(spark):
    """Thousands of copies of one vector beside others: ties go to the least ids, in few large blocks."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(7, 6)).astype(np.float32).tolist()
    rows = [(f"t{i:05d}", base[0 if i % 2 else i % 7], f"s{i % 3}", "x") for i in range(5000)]
    v = vectors(spark, rows)
    assert sim._large_blocks(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 6) == 3
    assert sim._large_blocks(spark.range(60000).select("id", F.array(F.lit(1.0)).alias("vector")), 6) == 6  # 15 blocks of BLOCK rows
    got = {}
    for r in sim.candidate_pairs(v, 3).where("query_id < 't00040'").collect():
        got.setdefault(r.query_id, {})[r.rank] = r.candidate_id
    unit = np.array([x[1] for x in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for i in range(40):
        score = np.round(unit @ unit[i], 9)
        ranked = sorted((-score[j], rows[j][0]) for j in range(5000) if j % 3 != i % 3)[:3]
        assert [got[f"t{i:05d}"][n] for n in (1, 2, 3)] == [name for _, name in ranked]


def test_evaluation_stores_no_positives(spark):
    v = vectors(spark, [(f"t{i}", [1.0, float(i % 5)], f"s{i % 4}", "ab"[i % 2]) for i in range(40)])
    plan = sim.evaluate_retrieval(v)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and "collect_list" not in plan


def test_evaluation_deals_blocks_by_range_and_sorts_short_keys(spark, monkeypatch):
    v = vectors(spark, [(f"t{i}", [1.0, float(i % 5)], f"s{i % 4}", "ab"[i % 2]) for i in range(40)])
    assert "rangepartitioning" in sim.evaluate_retrieval(v)._jdf.queryExecution().executedPlan().toString()
    import tracemalloc

    r, n = np.random.default_rng(2), 4000
    t = pa.table({"id": pa.array(range(n)), "vector": pa.array(r.normal(size=(n, 4)).tolist(), pa.list_(pa.float32())), "session": pa.array([i % 4 for i in range(n)]), "entity": pa.array([i % 10 for i in range(n)])})
    tracemalloc.start()
    try:
        assert len(sim._ranked_positives(t.slice(0, 600), t)) == 600
        assert tracemalloc.get_traced_memory()[1] < 24e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("seed", range(8))
def test_evaluation_ranks_equal_similarities_by_id(monkeypatch, seed):
    """Few distinct vectors, some not numbers, equal ids, null sessions and entities, in blocks of a few queries and columns."""
    monkeypatch.setattr(sim, "KEYS", 900)
    monkeypatch.setattr(sim, "COLUMNS", 16)
    r, n = np.random.default_rng(seed), 90
    v = r.integers(-1, 3, (n, 2)).astype(float)
    if seed % 2:
        v[r.integers(0, n, 3)] = np.nan
    ids = (r.permutation(n) // (1 + seed % 3)).tolist()
    sessions, entities = ([None if x == 2 else int(x) for x in r.integers(0, 2 + seed % 4, n)] for _ in range(2))
    t = pa.table({"id": pa.array(ids), "vector": pa.array(v.tolist(), pa.list_(pa.float32())), "session": pa.array(sessions), "entity": pa.array(entities)})
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    similar = np.round(unit @ unit.T, 9)
    want = []
    for i in range(n):
        far = lambda j: 9.0 if np.isnan(similar[i, j]) else -similar[i, j]
        ranked = sorted((j for j in range(n) if sessions[j] != sessions[i] and ids[j] != ids[i]), key=lambda j: (far(j), ids[j], [k for k in range(n) if ids[k] == ids[j]].index(j)))
        places = [k + 1 for k, j in enumerate(ranked) if entities[j] == entities[i]]
        if places:
            want.append((ids[i], str(entities[i]), ids[ranked[0]], str(-far(ranked[0]) + 0.0 if far(ranked[0]) < 9 else np.nan), places[0], round(float(np.mean([(k + 1) / p for k, p in enumerate(places)])), 12), len(ranked)))
    got = sim._ranked_positives(t, t).to_pylist()
    assert sorted((g["query_id"], str(g["entity"]), g["best_candidate_id"], str(g["best_similarity"] + 0.0), g["correct_rank"], round(g["average_precision"], 12), g["eligible"]) for g in got) == sorted(want)


def test_clusters_in_blocks_equal_one_by_one(monkeypatch):
    r = np.random.default_rng(3)
    v = r.normal(size=(400, 6))
    v[7], v[300, 2] = 0, np.nan
    for sessions in (sorted(map(str, r.integers(0, 4, 400))), list(map(str, r.integers(0, 4, 400)))):
        monkeypatch.setattr(cluster, "STRETCH", 4)
        got = cluster.assign_in_order(list(map(str, range(400))), v, sessions, 0.6, 0.02)
        units = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        sums, seen, expected = [], [], []
        for u, s in zip(units, sessions, strict=True):
            scores = {c: float(u @ x / max(np.linalg.norm(x), 1e-12)) for c, x in enumerate(sums) if s not in seen[c]}
            order = sorted((c for c in scores if scores[c] == scores[c]), key=lambda c: (-scores[c], c))
            best, second = (scores[order[0]] if order else None), (scores[order[1]] if len(order) > 1 else -1.0)
            if best is not None and best >= 0.6 and (second < 0 or best - second >= 0.02):
                own = order[0]
                sums[own], seen[own] = sums[own] + u, seen[own] | {s}
            else:
                own = len(sums)
                sums.append(u), seen.append({s})
            expected.append(f"PSEUDO_{own + 1:04d}")
        assert got.pseudo_id.tolist() == expected


def test_clusters_of_session_runs_take_block_products(monkeypatch):
    v, made, matmul = np.random.default_rng(4).normal(size=(2000, 16)), [], np.matmul
    monkeypatch.setattr(cluster.np, "matmul", lambda *a, **k: made.append(len(a[0])) or matmul(*a, **k))
    got = cluster.assign_in_order(list(map(str, range(2000))), v, [str(i // 500) for i in range(2000)], 0.6)
    assert got.groupby("pseudo_id").session_id.nunique().max() > 1 and not got.duplicated(["pseudo_id", "session_id"]).any()
    assert made == [256, 244] * 3  # the first session's vectors have no cluster to join
