from pyspark.sql import functions as F

from trackloom import __main__ as cli
from trackloom.sources import tables


def test_embeddings_to_predictions(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.normal(size=(3, 6))
    ids = [f"t{i}" for i in range(12)]
    np.savez(tmp_path / "e.npz", tracklet_ids=np.array(ids), session_ids=np.array([f"s{i // 3}" for i in range(12)]), video_ids=np.array([f"v{i // 3}" for i in range(12)]), embeddings=np.array([base[i % 3] + rng.normal(size=6) * 0.01 for i in range(12)], np.float32), backend=np.array(["m"]))
    run = f"{tmp_path}/run"
    cli.main(["import-embeddings", run, "--npz", f"{tmp_path}/e.npz"])
    cli.main(["cluster", run, "--threshold", "0.9"])
    own = cli.Run(spark, run)
    assert own.read("pseudo_assignments").select("pseudo_id").distinct().count() == 3
    pairs = own.read("candidate_pairs").where("rank = 1")
    assert pairs.where("substring(query_id, 2) % 3 = substring(candidate_id, 2) % 3").count() == 12
    rows = own.read("embeddings").select("tracklet_id", F.lit("").alias("pseudo_id"), "session_id", "video_id", F.concat(F.lit("cow "), F.expr("substring(tracklet_id, 2) % 3").cast("int")).alias("entity_id"), F.lit(True).alias("confirmed"))
    own.write("labels", tables.conform(rows, tables.schema_of("labels")))
    cli.main(["audit-labels", run]), cli.main(["build-gallery", run]), cli.main(["identify", run, "--threshold", "0.5"]), cli.main(["evaluate", run])
    assert {r.predicted for r in own.read("identity_predictions").collect()} == {"COW_0000", "COW_0001", "COW_0002"}
    assert own.read("retrieval_summary").first().top1 == 1.0


def test_scores_to_health(spark, tmp_path):
    run = f"{tmp_path}/run"
    own = cli.Run(spark, run)
    (tmp_path / "s.csv").write_text("tracklet_id,arch_score,model_name\n" + "".join(f"t{i},{0.1 if i < 4 else 0.9},m\n" for i in range(6) for _ in range(3)))
    day = lambda c: F.concat(F.lit("2026-09-0"), (F.substring(c, 2, 1).cast("int") + 1).cast("string"), F.lit(" 07:00:00"))
    t = spark.range(6).select(F.concat(F.lit("t"), "id").alias("tracklet_id"), F.concat(F.lit("v"), "id").alias("video_id"), F.lit("s").alias("session_id"), F.lit(1.0).alias("start_s"))
    own.write("tracklets", tables.conform(t, tables.schema_of("tracklets")))
    own.write("video_manifest", tables.conform(t.select("video_id", day("video_id").cast("timestamp").alias("recording_start")), tables.schema_of("video_manifest")))
    own.write("labels", tables.conform(t.select("tracklet_id", F.lit("cow 1").alias("entity_id"), F.lit(True).alias("confirmed")), tables.schema_of("labels")))
    for _ in range(2):
        cli.main(["import-posture", run, "--scores", f"{tmp_path}/s.csv"])
    assert own.read("posture_observations").count() == 6
    cli.main(["health-refresh", run])
    rows = own.read("health_summaries").orderBy("observed_at").collect()
    assert [r.status for r in rows] == ["OK"] * 5 + ["REVIEW_NEEDED"] and rows[-1].entity_id == "COW_0001"
