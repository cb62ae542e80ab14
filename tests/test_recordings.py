import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trackloom.operators import manifest, splits
from trackloom.sources import tables

T0 = datetime(2026, 8, 5, 12, 0, 0)
SCHEMA = "video_id string, camera_id string, recording_start timestamp, recording_end timestamp, duplicate_of string"


def videos(spark, *rows):
    at = lambda m: None if m is None else T0 + timedelta(minutes=m)
    return spark.createDataFrame([(v, c, at(s), at(e), d) for v, c, s, e, d in rows], SCHEMA)


def groups(df):
    return {r.video_id: r for r in df.collect()}


def test_overlap_groups_by_camera(spark):
    g = groups(manifest.overlap_groups(videos(spark, ("a", "side", 0, 10, None), ("b", "side", 5, 20, None), ("c", "top", 5, 20, None), ("d", "side", 20, 30, None), ("e", "side", None, None, None), ("f", None, 0, 5, None), ("x", "side", 50, 50, None), ("g", "side", 1, 2, "e")), duplicate_col="duplicate_of"))
    assert g["a"].overlap_group_id == g["b"].overlap_group_id == g["g"].overlap_group_id != g["c"].overlap_group_id
    assert g["d"].overlap_group_id != g["a"].overlap_group_id, "touching intervals don't overlap"
    assert g["a"].canonical_video_id == g["b"].canonical_video_id == "a" and g["g"].canonical_video_id == "e"
    assert g["e"].overlap_unverified and not g["a"].overlap_unverified and g["f"].overlap_group_id == ""


@pytest.mark.parametrize("seed", range(3))
def test_overlap_groups_match_pairwise_components(spark, seed):
    rng = random.Random(seed)
    rows = [(f"v{i:02d}", rng.choice("xy"), s := rng.randrange(60), s + rng.randrange(0, 8), None) for i in range(40)]
    up = {r[0]: r[0] for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in rows:
        for b in rows:
            if a[1] == b[1] and min(a[3], b[3]) > max(a[2], b[2]):
                up[root(a[0])] = root(b[0])
    g = groups(manifest.overlap_groups(videos(spark, *rows)))
    for a in g:
        for b in g:
            assert (g[a].overlap_group_id == g[b].overlap_group_id) == (root(a) == root(b))


def test_an_islands_name_is_made_once_and_streams(spark):
    """Ids of an island are in no row of the plan, and its hash goes on from batch to batch."""
    import hashlib

    rows = [(f"v{i % 97:03d}" if i % 10 else None, c, i, i + 3, None) for c in ("x", "y") for i in range(200)] + [("z", "y", 900, 901, None)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = manifest.overlap_groups(videos(spark, *rows))
        assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
        got = {(r.camera_id, r.overlap_group_id, r.canonical_video_id) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    name = lambda ids: "ovl_" + hashlib.sha1("|".join(sorted(ids)).encode()).hexdigest()[:12]
    whole = name(v for v, c, *_ in rows if c == "x" and v)
    assert got == {("x", whole, None), ("y", whole, None), ("y", name(["z"]), "z")}


def test_corrections_apply_in_order_and_unknown_ids_fail(spark):
    raw = videos(spark, ("vid_a", "side", 0, 10, None), ("vid_b", "side", None, None, None))
    at = lambda m: T0 + timedelta(minutes=m)
    fix = spark.createDataFrame([("vid_b", at(5), at(12), "manual"), ("vid_a", at(99), at(100), "ocr")], "video_id string, recording_start timestamp, recording_end timestamp, timestamp_source string")
    g = groups(manifest.canonical_manifest([raw], [fix]))
    assert g["vid_a"].overlap_group_id == g["vid_b"].overlap_group_id and g["vid_a"].recording_start == T0
    with pytest.raises(Exception, match="isn't there"):
        manifest.overlay(raw, fix.withColumn("video_id", F.lit("nope"))).collect()


def test_timestamp_fit(spark):
    rows = [("good", float(o), T0 + timedelta(seconds=o), 60.0) for o in (0, 10, 20)] + [("bad", 0.0, T0, 60.0), ("bad", 10.0, T0 + timedelta(seconds=510), 60.0), ("none", 0.0, None, 60.0), ("one", 5.0, T0 + timedelta(seconds=5), 60.0)]
    out = {r.v: r for r in manifest.timestamp_fit(spark.createDataFrame(rows, "v string, offset_s double, timestamp timestamp, duration_s double"), "v").collect()}
    assert out["good"].recording_start == T0 and out["good"].timestamp_source == "camera_ocr" and out["good"].timestamp_confidence == 1.0
    assert out["good"].recording_end == T0 + timedelta(seconds=60)
    assert out["bad"].error == "ocr_timeline_inconsistent" and out["none"].error == "no_valid_ocr_sample" and out["bad"].timestamp_source == "unknown"
    assert out["one"].timestamp_confidence == pytest.approx(1 / 3)


def dated(spark, rows):
    return spark.createDataFrame([(v, d and datetime.fromisoformat(d), g, u) for v, d, g, u in rows], "video_id string, recording_start timestamp, overlap_group_id string, overlap_unverified boolean")


def test_date_split(spark):
    m = dated(spark, [("a", "2026-08-01", "g1", False), ("b", "2026-08-05", "g2", False), ("c", None, "g3", True), ("d", "2026-08-05", "g4", True)])
    assert {r.video_id: r.split for r in splits.date_split(m, [], ["2026-08-05"]).collect()} == {"a": "train", "b": "validation", "c": "train", "d": "train"}
    assert {r.video_id for r in splits.last_day_split(m).where("split = 'validation'").collect()} == {"b"}
    with pytest.raises(ValueError, match="both"):
        splits.date_split(m, ["2026-08-05"], ["2026-08-05"])
    with pytest.raises(Exception, match="has no recording"):
        splits.date_split(m, ["2030-01-01"]).collect()
    crossing = dated(spark, [("a", "2026-08-13", "g", False), ("b", "2026-08-14", "g", False)])
    with pytest.raises(Exception, match="crosses dataset splits"):
        splits.date_split(crossing, [], ["2026-08-14"]).collect()
    with pytest.raises(ValueError, match="verified"):
        splits.last_day_split(m.where("overlap_unverified"))


def test_track_split(spark):
    names = ["a1", "a2", "b1", "b2", "o1", "f1"]
    labels = spark.createDataFrame([(t, t[0], True, True) for t in names], "tracklet_id string, entity_id string, confirmed boolean, training_eligible boolean")
    tracks = spark.createDataFrame([(t, "s", f"v{t[1]}") for t in names], "tracklet_id string, session_id string, video_id string")
    video = spark.createDataFrame([("v1", "train"), ("v2", "validation")], "video_id string, split string")
    flagged = spark.createDataFrame([("b2",)], "tracklet_id string")
    got = {r.tracklet_id: r.split for r in splits.track_split(labels, tracks, video, flagged, ["o"]).collect()}
    assert got == {"a1": "train", "a2": "val", "o1": "open_set_test"}
    with pytest.raises(Exception, match="train day"):
        splits.track_split(labels.where("entity_id = 'b'"), tracks, video, flagged).collect()
    assert splits.track_split(labels.where("entity_id = 'o'"), tracks, video, None, ["o"]).count() == 1


def test_tables(spark, tmp_path):
    (tmp_path / "p.csv").write_text("left_id,decision,similarity\na,same,0.5\nb,different,NaN\n")
    rows = tables.read_csv(spark, f"{tmp_path}/p.csv", "pair_reviews").collect()
    assert [(r.left_id, r.right_id, r.similarity) for r in rows] == [("a", None, 0.5), ("b", None, None)]
    assert tables.read_csv(spark, f"{tmp_path}/none.csv", "labels").count() == 0
    for n in range(4):
        tables.write_version(spark.range(n), f"{tmp_path}/t", keep=2)
    assert tables.read_version(spark, f"{tmp_path}/t").count() == 3 and tables.read_version(spark, f"{tmp_path}/t", version=3).count() == 2
    assert len(list((tmp_path / "t").glob("version=*"))) == 2
    with pytest.raises(Exception, match="EXIST"):
        tables.write_once(spark.range(1), f"{tmp_path}/t/version=000004")
    for name, content in {"A.MP4": b"x", "b.mp4": b"x", "c.txt": b"y"}.items():
        (tmp_path / name).write_bytes(content)
    found = tables.scan_files(spark, str(tmp_path)).collect()
    assert [(r.filename, r.is_duplicate) for r in found] == [("A.MP4", False), ("b.mp4", True)] and found[1].duplicate_of == found[0].video_id
    existing, new = spark.createDataFrame([("a",)], "k string"), spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    assert [r.k for r in tables.anti_append(existing, new, ["k"]).collect()] == ["b"]
    assert tables.Settings().with_changes({"matching": {"top_k": 3}, "roi": [0, 0, 1, 1]}).top_k == 3
    with pytest.raises(ValueError):
        tables.Settings().with_changes({"nope": 1})


def test_npz_and_keypoints(spark, tmp_path):
    import numpy as np

    np.savez(tmp_path / "e.npz", tracklet_ids=np.array(["a", "b"]), embeddings=np.eye(2, dtype=np.float32), session_ids=np.array(["s", "s"]), backend=np.array(["m"]))
    rows = tables.read_npz(spark, f"{tmp_path}/e.npz").orderBy("tracklet_id").collect()
    assert rows[1].embedding == [0.0, 1.0] and rows[0].backend == "m" and rows[0].crop_version is None
    points = spark.createDataFrame([("t", 1, "nose", 0.5), ("t", 1, "tail", 0.5)], "tracklet_id string, frame_idx int, keypoint_name string, visibility double")
    assert {r.keypoint_name for r in tables.renamed_keypoints(points, {"nose": "muzzle"}).collect()} == {"muzzle", "tail"}
    assert tables.checked_keypoints(points, "t").count() == 2
    with pytest.raises(Exception, match="bad keypoint"):
        tables.checked_keypoints(points.withColumn("visibility", F.lit(1.5)), "t").collect()


def test_tables_are_created_once_and_functions_registered(spark):
    from trackloom.functions import register

    for _ in range(2):
        tables.create_tables(spark, "trackloom_test", ["labels", "video_manifest"])
    assert spark.table("trackloom_test.labels").schema.names == tables.schema_of("labels").names
    spark.sql("DROP DATABASE trackloom_test CASCADE")
    register.register(spark)
    row = spark.sql("SELECT tl_normal_id(' cow 7') AS a, tl_dot(array(1.0D, 2.0D), array(3.0D, 4.0D)) AS b, tl_uuid5('x') AS c, tl_overlap_seconds(TIMESTAMP '2026-01-01 00:00:00', TIMESTAMP '2026-01-01 00:01:00', TIMESTAMP '2026-01-01 00:00:30', TIMESTAMP '2026-01-01 00:02:00') AS d").first()
    assert (row.a, row.b, len(row.c), row.d) == ("COW_0007", 11.0, 36, 30.0)


def test_overlapping_pairs_equal_all_pairs_compared(spark):
    import datetime
    import random

    r, zero = random.Random(5), datetime.datetime(1970, 1, 1)
    lengths = [0, 1, 999_500, 150_000_000, 600_000_000, 3_600_000_000, 3_600_000_001, 40_000_000_000]
    rows = [(i // 2 if i < 6 else i, i % 2, s := r.choice([r.randrange(-20_000, 20_000) * 1_000_000, r.randrange(-40, 40) * 150_000_000, r.randrange(-(10**10), 10**10)]), s + r.choice(lengths)) for i in range(160)]
    at = lambda x: zero + datetime.timedelta(microseconds=x)
    v = spark.createDataFrame([(i, c, at(s), at(e)) for i, c, s, e in rows] + [(500, 0, None, at(0)), (501, 1, at(0), None)], "id bigint, camera int, s timestamp_ntz, e timestamp_ntz")
    v = v.select("id", "camera", F.col("s").cast("timestamp").alias("s"), F.col("e").cast("timestamp").alias("e"))
    shared = [(a[0], b[0], min(a[3], b[3]) - max(a[2], b[2])) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] < a[3] and b[2] < b[3]]
    expected = sorted((a, b, (n + 500) // 1000 / 1000) for a, b, n in shared if n > 0)
    got = manifest.overlapping_pairs(v, "id", "camera", "s", "e", digits=3)
    assert sorted(map(tuple, got.collect())) == expected and len(expected) > 100
    exact = manifest.overlapping_pairs(v, "id", "camera", "s", "e")
    assert sorted(r.seconds for r in exact.collect()) == sorted(n / 1e6 for *_, n in shared if n > 0)


def test_few_pairs_of_short_recordings_are_compared(spark):
    v = spark.range(7200).selectExpr("id", "0 AS camera", "timestamp_seconds(id) AS s", "timestamp_seconds(id + 2) AS e")
    pairs = manifest.overlapping_pairs(v, "id", "camera", "s", "e", digits=3)
    spread = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert pairs.count() == 7199 and "150000000" in spread  # buckets of 150 s, not of an hour


def test_pairs_shuffle_about_a_row_a_recording(spark):
    """Ten minutes in an hour's buckets: dealt once and a sixth, where 150 s take five rows and two more for the other side."""
    v = spark.range(7200).selectExpr("id", "id % 2 AS camera", "timestamp_seconds(id * 10) AS s", "timestamp_seconds(id * 10 + 600) AS e")
    pairs = manifest.overlapping_pairs(v, "id", "camera", "s", "e", digits=3)
    plan = pairs._jdf.queryExecution()
    assert pairs.count() == sum(min(29, (7199 - i) // 2) for i in range(7200))
    node = plan.optimizedPlan()
    while "RepartitionByExpression" not in node.nodeName():
        assert node.children().size() == 1, "no join"
        node = node.children().apply(0)
    from pyspark.sql import DataFrame

    dealt = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, node)
    assert 7200 <= DataFrame(dealt, spark).count() <= 7200 * 1.2


def test_pairs_run_on_over_batches(spark):
    """Small batches, equal ids, equal starts and recordings that run over many buckets give each pair once."""
    import random

    r = random.Random(7)
    rows = [(f"v{i // 2 if i < 20 else i}", r.choice("xy"), s := r.choice([r.randrange(20000), 3600 * r.randrange(5)]), s + r.choice([1, 600, 600, 9000])) for i in range(300)] + [(None, "x", 0, 9000), ("n", None, 0, 9000)]
    v = spark.createDataFrame(rows, "id string, camera string, s long, e long").select("id", "camera", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("e").alias("e"))
    want = sorted((*sorted((a[0], b[0])), float(min(a[3], b[3]) - max(a[2], b[2]))) for k, a in enumerate(rows[:300]) for b in rows[k + 1 : 300] if a[0] != b[0] and a[1] == b[1] and a[2] < b[3] and b[2] < a[3])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(tuple, manifest.overlapping_pairs(v, "id", "camera", "s", "e", digits=3).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want
