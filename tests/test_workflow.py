from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from trackloom.operators import manifest, posture, similarity as sim, workflow as wf
from trackloom.plans import workflow_queries
from trackloom.sources import tables


@pytest.fixture(scope="module")
def oracle(small):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", ["extract_tracks", "extract_frames", "track_embeddings", "worker_states", "worker_process", "register_models", "import_assigned", "import_edges", "canonical_manifest", "duplicate_files", "accept_pair", "unite_pairs", "accepted_pairs", "import_scores", "merged_identities", "registry_replay", "retrieval_eval", "enriched_tracks"])
def test_queries_match_their_sql(spark, small, oracle, name):
    got, sql = entry.queries()[name](spark, small), oracle.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in sql.description]
    assert sorted(columns) == sorted(got.columns)
    text = lambda row: tuple("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in row)
    assert sorted(text(r[c] for c in columns) for r in got.collect()) == sorted(map(text, sql.fetchall()))


def test_best_frames_match_their_sql_to_the_last_digit(spark):
    """Many qualities are equal or end in a half on paper: the order of the arithmetic ranks and rounds them."""
    import duckdb

    con, data = duckdb.connect(), "/root/testdata/sf0.01"
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{data}/events.parquet'")
    got = {tuple(r) for r in entry.queries()["extract_frames"](spark, data).select("video_id", "track_id", "rank", "frame_idx", "quality").collect()}
    assert got == set(con.execute(f"SELECT video_id, track_id, rank, frame_idx, quality FROM ({entry.oracle_sql()['extract_frames']})").fetchall())


def test_every_workflow_query_has_sql():
    assert all(sql for _, sql in workflow_queries.QUERIES.values())


def test_files_without_a_hash_stay(spark):
    rows = [("a", None, "v1"), ("b", "h", "v2"), ("b", "h", "v3"), ("c", None, "v4")]
    out = manifest.mark_duplicates(spark.createDataFrame(rows, "path string, sha256 string, video_id string")).collect()
    assert {r.video_id: r.duplicate_of for r in out} == {"v1": None, "v2": None, "v3": "v2", "v4": None}


def test_readers_never_miss_a_version(spark, tmp_path):
    folder = f"{tmp_path}/t"
    assert not tables.has_version(spark, folder)
    for n in (1, 2, 3):
        tables.write_version(spark.range(n), folder, keep=2)
        assert tables.read_version(spark, folder).count() == n
    open(f"{folder}/claim.000004", "w").close()  # a writer that is still at work, or that died
    assert tables.read_version(spark, folder).count() == 3
    assert tables.write_version(spark.range(9), folder, keep=2).endswith("version=000005")
    assert tables.read_version(spark, folder).count() == 9 and tables.read_version(spark, folder, version=3).count() == 3
    assert len([p for p in Path(folder).iterdir() if p.name.startswith("version")]) == 2


def test_mixed_provenance_is_refused(spark):
    rows = lambda *x: spark.createDataFrame([(c, "unknown") for c in x], "checkpoint_sha256 string, crop_version string")
    sim.check_contract(rows("a", None, "a"), rows("a", "unknown", ""))
    for g, q in ((rows("a", "b"), rows("a")), (rows("a"), rows("a", None, "b")), (rows("a"), rows("b"))):
        with pytest.raises(ValueError):
            sim.check_contract(g, q)


def test_settings_and_paths(tmp_path):
    (tmp_path / "s.json").write_text('{"matching": {"top_k": 7}, "gate": [0.1, 0.9]}')
    s = tables.load_settings(f"{tmp_path}/s.json")
    assert (s.top_k, s.gate, s.min_days) == (7, (0.1, 0.9), 3)
    assert tables.resolved_path("m/x.pt", f"{tmp_path}/s.json") == f"{tmp_path}/m/x.pt" and tables.resolved_path("s3://b/x", "s") == "s3://b/x"
    with pytest.raises(ValueError):
        tables.Settings().with_changes({"nothing": 1})
    with pytest.raises(ValueError):
        wf.check_backend("metric", "unknown")
    wf.check_backend("metric", "metric_resnet50"), wf.check_backend("resnet18", "unknown")


def test_worker_keeps_the_last_good_state(spark):
    v = spark.createDataFrame([("a", "INGESTED", None), ("b", "INGESTED", "a"), ("c", "TRACKED", "c"), ("d", "EMBEDDED", None), ("e", "ID_ASSIGNED", None)], "video_id string, status string, canonical_video_id string")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "video_id string")
    guesses = spark.createDataFrame([("a", False, False), ("d", False, True), ("d", True, False)], "video_id string, is_unknown boolean, is_ambiguous boolean")
    asked = []

    def stage(fails):
        def run(df):
            asked.append({r.video_id for r in df.collect()})
            return df.select("video_id", F.when(F.col("video_id").isin(*fails), "e" * 5000).alias("error"))
        return run

    rows = wf.process_new(v, names(), names(), stage([]), stage(["c"]), lambda df: guesses.join(df.select("video_id"), "video_id")).collect()
    got = {r.video_id: (r.status, r.attempts, len(r.last_error or "")) for r in rows}
    assert got == {"a": ("ID_ASSIGNED", 0, 0), "b": ("DUPLICATE_LINKED", 0, 0), "c": ("TRACKED", 1, 4000), "d": ("ID_UNRESOLVED", 0, 0)}
    assert asked == [{"a"}, {"a", "c"}]


def test_models_are_named_by_order_not_by_partition(spark):
    scores = spark.createDataFrame([("t", "0.5", "z", 2), ("t", "0.6", "y", 1), ("t", "0.7", None, 0)], "tracklet_id string, score string, model_name string, n int").repartition(3)
    tracks = spark.createDataFrame([("t", "v", "s", 0.0)], "tracklet_id string, video_id string, session_id string, start_s double")
    own = spark.createDataFrame([("t", "")], "tracklet_id string, entity_id string")
    assert posture.import_scores(scores, tracks, own, None, sequence="n").first().model_name == "y"
