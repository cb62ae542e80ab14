from collections import Counter

import pytest
from pyspark.sql import functions as F

from trackloom import __main__ as cli
from trackloom.operators.worker import Worker

SCHEMA = "video_id string, status string, canonical_video_id string, created_at timestamp"
ran: Counter = Counter()


def videos(spark, n=10):
    rows = [(f"v/{i}", "INGESTED", "v/0" if i == 1 else None, None) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def stage(name, fails=(), crash=None):
    """A stage that counts each recording it is run for, on the driver."""

    def run(df):
        if crash and crash.pop("now", None):
            raise RuntimeError("lost")
        ids = [r.video_id for r in df.collect()]
        ran.update((name, i) for i in ids)
        return df.sparkSession.createDataFrame([(i, "no frames" if i in fails else None) for i in ids], "video_id string, error string")

    return run


def guesses(df):
    ran.update(("identify", r.video_id) for r in df.collect())
    return df.where("video_id <> 'v/4'").select("video_id", (F.col("video_id") == "v/3").alias("is_unknown"), F.lit(False).alias("is_ambiguous"))


@pytest.fixture(autouse=True)
def nothing_ran():
    ran.clear()


def states(worker):
    return {r.video_id: r.status for r in worker.states().collect()}


def test_each_stage_once_after_a_crash_and_with_a_second_worker(spark, tmp_path):
    now, crash = [1e10], {"now": True}
    first = Worker(spark, f"{tmp_path}/w", stage("extract"), stage("embed", crash=crash), guesses, clock=lambda: 0.0)
    first.land(videos(spark))
    with pytest.raises(RuntimeError):
        first.process()
    assert set(states(first).values()) == {"TRACKED", "DUPLICATE_LINKED"}
    early = Worker(spark, f"{tmp_path}/w", stage("extract"), stage("embed"), guesses, clock=lambda: 0.0)
    assert early.process() == 0  # the lost worker's claims still stand
    second = Worker(spark, f"{tmp_path}/w", stage("extract"), stage("embed"), guesses, clock=lambda: now[0])
    assert second.run() == 9
    own = [f"v/{i}" for i in range(10) if i != 1]
    assert ran == Counter((s, i) for s in ("extract", "embed", "identify") for i in own)
    assert states(second) == {i: "ID_ASSIGNED" for i in own} | {"v/1": "DUPLICATE_LINKED", "v/3": "ID_UNRESOLVED", "v/4": "ID_UNRESOLVED"}
    assert second.run() == 0 and sum(ran.values()) == 27


def test_a_recording_has_one_owner(spark, tmp_path):
    a, b = (Worker(spark, f"{tmp_path}/w", stage("extract"), stage("embed"), batch=4) for _ in range(2))
    mine = a.claims.take(["x", "y"])
    assert mine == {"x": 1, "y": 1} and b.claims.take(["x", "y", "z"]) == {"z": 1}
    a.claims.give_back({"x": 1})
    assert b.claims.take(["x", "y"]) == {"x": 2} and a.claims.take(["x"]) == {}
    a.land(videos(spark)), a.land(videos(spark))
    assert a.process() == 4 and a.states().count() == 10


def test_failures_keep_the_state_and_are_tried_again(spark, tmp_path):
    worker = Worker(spark, f"{tmp_path}/w", stage("extract", fails={"v/2"}), stage("embed"), max_attempts=2)
    worker.land(videos(spark, 3))
    worker.run()
    row = worker.states().where("video_id = 'v/2'").first()
    assert (row.status, row.last_error, row.attempts) == ("INGESTED", "no frames", 2) and ran[("extract", "v/2")] == 2
    assert states(worker)["v/0"] == "ID_PENDING" and ran[("extract", "v/0")] == ran[("embed", "v/0")] == 1 and worker.run() == 0
    more = Worker(spark, f"{tmp_path}/w", stage("extract"), stage("embed"), max_attempts=9)
    assert more.run() == 1 and states(more)["v/2"] == "ID_PENDING"


def good_stage(df):
    return df.select("video_id", F.lit(None).cast("string").alias("error"))


def test_the_command(spark, tmp_path):
    run = cli.Run(spark, f"{tmp_path}/run")
    run.write("videos", videos(spark, 4))
    for _ in range(2):
        cli.main(["process-new", run.folder, "--extract", f"{__name__}:good_stage", "--embed", f"{__name__}:good_stage"])
    assert Counter(r.status for r in run.read("video_states").collect()) == {"ID_PENDING": 3, "DUPLICATE_LINKED": 1}


def test_a_landing_stream(spark, tmp_path):
    from trackloom.operators.worker import work_on_stream

    worker = Worker(spark, f"{tmp_path}/w", stage("extract"), stage("embed"))
    for k in range(2):
        videos(spark, 3 + 3 * k).write.mode("append").parquet(f"{tmp_path}/landing")
        work_on_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/landing"), worker, f"{tmp_path}/c").awaitTermination()
    assert len(states(worker)) == 6 and set(states(worker).values()) == {"ID_PENDING", "DUPLICATE_LINKED"} and max(ran.values()) == 1
