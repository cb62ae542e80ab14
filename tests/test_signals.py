from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from trackloom.operators import posture, tracks
from trackloom.streaming import incremental

T0 = datetime(2026, 9, 1)


def test_arch_score(spark):
    points = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (1, 1), (2, 0))))
    assert spark.range(1).select(posture.arch_score(points).alias("s")).first().s == 0.5
    assert spark.range(1).select(posture.arch_score(F.slice(points, 1, 2)).alias("s")).first().s is None


def test_summaries(spark):
    rows = spark.createDataFrame([("t1", "0.2"), ("t1", "0.4"), ("t2", "0.5"), ("t2", "0.7"), ("t2", "x"), ("t3", "nan")], "tracklet_id string, score string")
    got = {r.tracklet_id: r for r in posture.posture_summary(rows).collect()}
    assert got["t1"]["mean"] == pytest.approx(0.3) and got["t2"].valid_frame_ratio == pytest.approx(2 / 3) and "t3" not in got
    values = spark.createDataFrame([("k", v, 4) for v in (0.1, 0.2, float("nan"))], "k string, v double, total bigint")
    f = posture.feature_summary(values, "k", "v", "total").first()
    assert f.valid_frame_ratio == 0.5 and f.standard_deviation == pytest.approx(0.05)


def test_baseline_and_alerts(spark):
    rows = spark.createDataFrame([(1, T0 + timedelta(days=i), float(v)) for i, v in enumerate((1, 1, 1, 1, 2))], "k int, observed_at timestamp, value double")
    got = posture.baseline(rows, ["k"]).orderBy("observed_at").collect()
    assert got[2].baseline is None and got[-1].baseline == 1.0 and got[-1].delta == 1.0 and got[-1].baseline_day_count == 4
    series = spark.createDataFrame([(1, i, z, r, u) for i, (z, r, u) in enumerate([(9.0, 1.0, 0.0), (9.0, 1.0, 0.0), (0.0, 1.0, 0.0), (None, 1.0, 0.0), (-9.0, 0.1, 0.0), (-9.0, 1.0, None), (5.0, 1.0, 0.0), (5.0, 1.0, 0.0)])], "k int, n int, robust_z double, valid_frame_ratio double, uncertainty double")
    assert [r.status == "OK" for r in posture.alerts(series, ["k"], F.col("n")).orderBy("n").collect()] == [True, True, False, True, True, True, True, False]


def test_history(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate((1.0, None, 3.0, 5.0, 9.0))], "k int, n int, v double")
    got = posture.history(rows, ["k"], "v", F.col("n")).orderBy("n").collect()
    assert [r.personal_baseline for r in got] == [None, None, None, None, 3.0] and got[-1].delta_from_baseline == 6.0


def test_import_is_append_only(spark):
    scores = spark.createDataFrame([("t1", 0.2, "m"), ("t1", 0.4, "m"), ("t2", 0.5, "m")], "tracklet_id string, arch_score double, model_name string")
    place = spark.createDataFrame([("t1", "v", "s", 1.0)], "tracklet_id string, video_id string, session_id string, start_s double")
    labels = spark.createDataFrame([("t1", "cow1", True)], "tracklet_id string, entity_id string, confirmed boolean")
    manifest = spark.createDataFrame([("v", "2026-09-02 07:00:00")], "video_id string, recording_timestamp string")
    first = posture.import_scores(scores, place, labels, manifest)
    rows = {r.tracklet_id: r for r in first.collect()}
    assert rows["t1"].observed_at == "2026-09-02 07:00:01" and rows["t1"].entity_id == "COW_0001" and rows["t2"].observed_at == "" and rows["t1"].model_version == "unknown"
    again = posture.import_scores(scores.withColumn("arch_score", F.lit(9.0)), place, labels, manifest, first)
    assert again.count() == 2 and again.agg(F.max("score_max")).first()[0] == 0.5
    moved = labels.withColumn("entity_id", F.lit("cow2"))
    assert {r.entity_id for r in posture.with_current_identity(first, moved).collect()} == {"COW_0002", ""}


def test_keypoint_frames(spark):
    rows = [("t", f, 0.0, n, float(i), float(i == 2), v, "m", "1") for f, v in ((1, 0.9), (2, 0.1), (3, None)) for i, n in enumerate(posture.BACK)] + [("t", 4, 0.0, posture.BACK[0], 0.0, 0.0, 1.0, "m", "1")]
    schema = "tracklet_id string, frame_idx int, timestamp_s double, keypoint_name string, x_px double, y_px double, visibility double, model_name string, model_version string"
    assert {r.frame_idx: r.arch_score for r in posture.frame_scores(spark.createDataFrame(rows, schema)).collect()} == {1: 0.25, 3: 0.25}


@given(st.integers(1, 6), st.integers(1, 6), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_least_cost_assignment(n, m, seed):
    import itertools

    cost = np.random.default_rng(seed).random((n, m))
    found = tracks.least_cost(cost)
    short, wide = (n, m) if n <= m else (m, n)
    own = cost if n <= m else cost.T
    best = min(sum(own[i, p[i]] for i in range(short)) for p in itertools.permutations(range(wide), short))
    assert len(found) == short and sum(cost[r, c] for r, c in found) == pytest.approx(best)


@given(st.integers(1, 5), st.integers(1, 6), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_least_cost_with_ties_and_barred_pairs(n, m, seed):
    import itertools

    cost = np.random.default_rng(seed).choice([0.0, 1.0, 2.0, 1e6], (n, m))
    found = tracks.least_cost(cost)
    own = cost if n <= m else cost.T
    best = min(sum(own[i, p[i]] for i in range(len(own))) for p in itertools.permutations(range(own.shape[1]), len(own)))
    assert len({r for r, _ in found}) == len({c for _, c in found}) == len(own) and sum(cost[r, c] for r, c in found) == best


def test_tracks_link_move_and_end():
    box = lambda x: [x, 0.0, x + 10, 10.0]
    frames = [[box(10.0), box(80.0)], [box(14.0), box(76.0)], [], [box(22.0)], *[[]] * 9, [box(22.0)]]
    assert tracks.link_frames([np.array(f) for f in frames], 100) == [[1, 2], [1, 2], [], [1], *[[]] * 9, [3]]


def test_crowded_frames_hold_no_matrix():
    """1500 boxes a frame: a whole matrix of costs would be 18 MB, and its makings several times that."""
    import tracemalloc

    x = np.arange(1500.0)
    frames = [np.column_stack([x * 20 + k, 0 * x, x * 20 + k + 10, 0 * x + 10]) for k in (0, 2)]
    tracemalloc.start()
    try:
        assert tracks.link_frames(frames, 1000.0) == [list(range(1, 1501))] * 2
        assert tracemalloc.get_traced_memory()[1] < 16e6
    finally:
        tracemalloc.stop()


def test_copies_of_boxes_link_as_units(monkeypatch):
    """Equal boxes are one node with their number: 200 copies cost no more rows than one, and link alike."""
    r, asked = np.random.default_rng(5), []
    base = [np.column_stack([x := np.round(r.random(n) * 300), 0 * x, x + 50, 0 * x + 40]) for n in (6, 7, 5, 6, 8)]
    flow = tracks.least_cost_flow
    monkeypatch.setattr(tracks, "least_cost_flow", lambda costs, supply, room: asked.append((len(supply), len(room))) or flow(costs, supply, room))
    one = tracks.link_frames(base, 1000.0)
    few, asked[:] = list(asked), []
    many = tracks.link_frames([np.repeat(b, 200, axis=0) for b in base], 1000.0)
    assert asked == few
    for a, b in zip(one, many):
        for k, name in enumerate(a):
            assert all((n - 1) // 200 + 1 == name for n in b[200 * k : 200 * k + 200])


@given(st.lists(st.integers(1, 3), min_size=1, max_size=3), st.lists(st.integers(1, 3), min_size=2, max_size=4), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_flow_costs_what_an_assignment_of_units_costs(supply, room, seed):
    import itertools

    room = [*room, max(0, sum(supply) - sum(room)) + 1]
    cost = np.random.default_rng(seed).choice([0.0, 1.0, 2.0, 5.0, 1e6], (len(supply), len(room)))
    sent = tracks.least_cost_flow(cost.__getitem__, supply, room)
    assert [sum(u for r, _, u in sent if r == i) for i in range(len(supply))] == supply and all(sum(u for _, c, u in sent if c == j) <= n for j, n in enumerate(room))
    units = np.repeat(np.repeat(cost, supply, axis=0), room, axis=1)
    assert sum(cost[r, c] * u for r, c, u in sent) == sum(units[r, c] for r, c in tracks.least_cost(units))


def test_a_recording_streams_in_order(spark):
    """Batches of a few rows, frames over several, gaps and rows without a frame."""
    rows = [("v" if i % 3 else "w", None if i % 50 == 7 else i // 12 + (9 if i > 200 else 0) + (2 if i > 300 else 0), i, float(i * 37 % 400)) for i in range(420)]
    d = spark.createDataFrame([(v, f, i, x, 0.0, x + 50, 40.0) for v, f, i, x in rows], "video_id string, frame_idx int, det_id int, x1 double, y1 double, x2 double, y2 double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.det_id: r.track_id for r in tracks.track_boxes(d.repartition(5), width=100.0).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {i: 0 for _, f, i, _ in rows if f is None}
    for video in "vw":
        own = sorted((f, i, x) for v, f, i, x in rows if v == video and f is not None)
        span = range(own[0][0], own[-1][0] + 1)
        found = tracks.link_frames([np.array([[x, 0.0, x + 50, 40.0] for g, _, x in own if g == f]) for f in span], 100.0)
        for f, names in zip(span, found):
            want |= dict(zip([i for g, i, _ in own if g == f], names))
    assert got == want


def test_track_frame(spark):
    rows = [("v", 0, 1, 0.0), ("v", 0, 2, 50.0), ("v", 1, 3, 1.0), ("v", 1, 4, 51.0), ("w", 5, 5, 0.0)]
    d = spark.createDataFrame([(v, f, i, x, 0.0, x + 10, 10.0) for v, f, i, x in rows], "video_id string, frame_idx int, det_id int, x1 double, y1 double, x2 double, y2 double")
    assert {r.det_id: r.track_id for r in tracks.track_boxes(d, width=100.0).collect()} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 1}


@pytest.mark.parametrize("dx,orientation,want", [(0.2, "left_to_right", "ok"), (-0.2, "left_to_right", "wrong"), (0.01, "left_to_right", "uncertain"), (-0.2, "right_to_left", "ok")])
def test_direction(spark, dx, orientation, want):
    assert spark.range(1).select(tracks.direction(F.lit(dx), 0.16, orientation).alias("d")).first().d == want


def test_interpolation(spark):
    s = spark.createDataFrame([("t", 1.0, 0.0, 0.8), ("t", 3.0, 20.0, 1.0)], "k string, t double, x double, c double")
    q = spark.createDataFrame([("t", a) for a in (0.0, 2.0, 3.0, 9.0)], "k string, at double")
    got = {r.at: (r.x, round(r.c, 6)) for r in tracks.interpolated(s, q, "k", "t", ["x", "c"]).collect()}
    assert got == {0.0: (0.0, 0.8), 2.0: (10.0, 0.9), 3.0: (20.0, 1.0), 9.0: (20.0, 1.0)}


def test_consistency(spark):
    h = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [1.0, 0.001]), ("b", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0])], "k string, h array<double>")
    got = {r.k: (r.consistency, r.flagged) for r in tracks.appearance_consistency(h, "k", "h").collect()}
    assert got["a"][0] > 0.999 and got["b"] == (0.0, True) and got["c"] == (None, False)


def test_alert_stream_equals_batch(spark, tmp_path):
    rows = [(k, T0 + timedelta(days=i, hours=k), v) for k in (1, 2) for i, v in enumerate((1.0, 1.1, 0.9, 1.0, 9.0, 9.0, 1.0))]
    schema = "k int, t timestamp, v double"
    for n, part in enumerate((rows[:7], rows[7:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    alerts = incremental.alert_stream(stream, "k", "t", "v", watermark="60 days")
    q = alerts.writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.key, r.observed_at): (r.baseline, r.status) for r in spark.table("alerts").collect()}
    batch = posture.alerts(posture.baseline(spark.createDataFrame(rows, schema).withColumnRenamed("t", "observed_at").withColumnRenamed("v", "value"), ["k"]), ["k"], F.col("observed_at"), ratio=None, uncertainty=None)
    assert got == {(str(r.k), r.observed_at): (r.baseline, r.status) for r in batch.collect()}


def test_landing_runs_once(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    seen = []
    for _ in range(2):
        stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        incremental.process_landing(stream, lambda df, n: seen.append(df.count()), f"{tmp_path}/c").awaitTermination(120)
    assert sum(seen) == 5


def test_baseline_over_spans_and_long_history(spark):
    rng = np.random.default_rng(5)
    times = sorted(int(x) for x in rng.integers(0, 400 * 86_400, 300))
    rows = pd.DataFrame({"k": rng.choice(["a", "a", "b"], 300), "n": range(300), "observed_at": [T0 + timedelta(seconds=t) for t in times], "value": np.round(rng.normal(size=300), 1)})
    got = posture.baseline(spark.createDataFrame(rows), ["k"], window_days=20).toPandas().set_index("n")
    assert sorted(got.index) == list(range(300))
    told = posture.history(spark.createDataFrame(rows), ["k"], "value", F.col("n")).toPandas().set_index("n")
    for r in rows.itertuples():
        own = rows[(rows.k == r.k) & (rows.observed_at < r.observed_at)]
        frame = own[own.observed_at >= r.observed_at - timedelta(days=20)]
        days = frame.observed_at.dt.date.nunique()
        assert got.baseline_day_count[r.n] == days
        if days >= 3:
            middle = frame.value.median()
            assert got.baseline[r.n] == pytest.approx(middle) and got.mad[r.n] == pytest.approx((frame.value - middle).abs().median())
        else:
            assert pd.isna(got.baseline[r.n])
        before = rows[(rows.k == r.k) & (rows.n < r.n)].value
        assert told.observation_order[r.n] == len(before) + 1
        assert told.personal_baseline[r.n] == pytest.approx(before.median()) if len(before) >= 3 else pd.isna(told.personal_baseline[r.n])
