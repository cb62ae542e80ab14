"""A worker that takes recordings, runs their stages once and keeps what it decides.

Below one folder of a shared file system lie

* videos/run=*: recordings as they came, appended, the first of an id counts;
* claims/ID.N: the N-th claim of a recording, an empty file that can be made
  only once: whoever makes it owns the recording, whatever other workers do;
  claims/ID.N.done gives it back;
* outputs/STAGE/run=*: what a stage gave, written once, read ever after;
* events/run=*: transitions that hold only from the state they expect.

Nothing is changed in place.  A worker that is lost leaves a claim that others
may follow once it is older than the lease, with N + 1; what it wrote stays and
is not made again, and its late events don't hold, as the state has moved on.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from trackloom.operators import registry
from trackloom.operators.workflow import Stage, queue
from trackloom.sources import tables

VIDEOS = "video_id string, status string, canonical_video_id string, created_at timestamp"
#: The stages in order, and the states before and after each that only does or fails.
STEPS = (("extract", "INGESTED", "TRACKED"), ("embed", "TRACKED", "EMBEDDED"))
OUTPUT = "video_id string, error string"
GUESSES = "video_id string, is_unknown boolean, is_ambiguous boolean, error string"


class Appended:
    """A table of whole runs: a run is there once its writer has finished."""

    def __init__(self, spark: SparkSession, folder: str, ddl: str):
        self.spark, self.folder, self.schema = spark, folder, T.StructType.fromDDL(ddl)

    def append(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/run={uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self) -> DataFrame:
        """Columns of the schema of all finished runs."""
        fs = tables._files(self.spark, self.folder)
        runs = [str(s.getPath()) for s in fs.listStatus(tables._path(self.spark, self.folder))] if tables.exists(self.spark, self.folder) else []
        whole = [r for r in runs if tables.exists(self.spark, f"{r}/_SUCCESS")]
        return self.spark.read.schema(self.schema).parquet(*whole) if whole else self.spark.createDataFrame([], self.schema)


class Claims:
    """Who works on what: files that can be made once."""

    def __init__(self, spark: SparkSession, folder: str, lease_s: float, clock: Callable[[], float]):
        self.spark, self.folder, self.lease_s, self.clock = spark, folder, lease_s, clock
        self.fs = tables._files(spark, folder)
        self.fs.mkdirs(tables._path(spark, folder))

    def standing(self) -> dict[str, tuple[int, float, bool]]:
        """Of each recording with a claim: the last claim's number, when it was made, whether it was given back."""
        last: dict[str, tuple[int, float, bool]] = {}
        done = set()
        for status in self.fs.listStatus(tables._path(self.spark, self.folder)):
            name = status.getPath().getName()
            if name.endswith(".done"):
                done.add(name[:-5])
            elif m := re.fullmatch(r"(.*)\.(\d+)", name):
                if int(m[2]) > last.get(m[1], (0,))[0]:
                    last[m[1]] = (int(m[2]), status.getModificationTime() / 1000, False)
        return {k: (n, at, f"{k}.{n}" in done) for k, (n, at, _) in last.items()}

    def take(self, ids: list[str]) -> dict[str, int]:
        """Those of ids that are free now, with the number of this worker's claim; each is a compare-and-set from the number before."""
        last, mine = self.standing(), {}
        for name in ids:
            key = quote(name, safe="")
            number, made, done = last.get(key, (0, 0.0, True))
            if (done or made + self.lease_s < self.clock()) and self.fs.createNewFile(tables._path(self.spark, f"{self.folder}/{key}.{number + 1}")):
                mine[name] = number + 1
        return mine

    def give_back(self, mine: dict[str, int]) -> None:
        for name, number in mine.items():
            self.fs.createNewFile(tables._path(self.spark, f"{self.folder}/{quote(name, safe='')}.{number}.done"))


class Worker:
    """process() takes up to batch pending recordings and carries them as far as their stages go.

    A stage takes the recordings it is for, all at once, and gives video_id and
    error (null where it went well); identify gives predictions with
    is_unknown and is_ambiguous, any number a recording; without it recordings
    end as ID_PENDING.  A stage's rows are written before they are looked at,
    so it runs once; rows of recordings that it was not asked for don't count;
    one it gives no row for has failed.  A failed recording keeps its state,
    counts an attempt and may be taken again, after max_attempts of them only
    by a worker with more.  A copy of another recording is linked.  batch
    bounds what the driver holds: ids, not data.
    """

    def __init__(self, spark: SparkSession, folder: str, extract: Stage, embed: Stage, identify: Stage | None = None, batch: int = 1000, lease_s: float = 6 * 3600, max_attempts: int = 3, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.batch, self.max_attempts = spark, folder.rstrip("/"), batch, max_attempts
        self.stages, self.identify = {"extract": extract, "embed": embed}, identify
        self.claims = Claims(spark, f"{self.folder}/claims", lease_s, clock)
        self.videos, self.events = Appended(spark, f"{self.folder}/videos", VIDEOS), Appended(spark, f"{self.folder}/events", registry.VIDEO_EVENTS)
        self.outputs = {name: Appended(spark, f"{self.folder}/outputs/{name}", OUTPUT) for name in self.stages}
        self.outputs["identify"] = Appended(spark, f"{self.folder}/outputs/identify", GUESSES)

    def land(self, found: DataFrame) -> None:
        """Adds recordings; those that are there already stay as they are."""
        self.videos.append(tables.conform(found, self.videos.schema))

    def states(self) -> DataFrame:
        """video_id, canonical_video_id, created_at, status, attempts and last_error of every recording."""
        first = Window.partitionBy("video_id").orderBy(F.col("created_at").asc_nulls_last(), "status", "canonical_video_id")
        own = self.videos.read().where("video_id IS NOT NULL").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
        return own.drop("status").join(registry.video_states(own, self.events.read()), "video_id")

    def _said(self, rows: DataFrame, order: int, target, expected=None) -> None:
        """Events of rows with video_id, claim, status and error."""
        failed = F.col("error").isNotNull()
        state = F.col("status") if expected is None else F.lit(expected)
        self.events.append(rows.select(
            (F.col("claim") * 10 + order).cast("bigint").alias("seq"), "video_id", F.when(failed, "error").otherwise("transition").alias("kind"),
            state.alias("expected"), F.when(~failed, target).alias("target"), F.col("error"),
        ))

    def _pending(self) -> DataFrame:
        return queue(self.states().where(F.coalesce("last_error", F.lit("")).eqNullSafe("") | (F.col("attempts") < self.max_attempts)))

    def process(self) -> int:
        """How many recordings this worker took; 0 where none is free."""
        waiting = [r.video_id for r in self._pending().select("video_id").limit(self.batch + len(self.claims.standing())).toLocalIterator()]
        mine: dict[str, int] = {}
        for at in range(0, len(waiting), self.batch):
            if len(mine) < self.batch:
                mine |= self.claims.take(waiting[at : at + self.batch - len(mine)])
        if not mine:
            return 0
        taken = F.broadcast(self.spark.createDataFrame(list(mine.items()), "video_id string, claim int"))  # batch rows at most
        own = lambda: self.states().join(taken, "video_id")
        linked = F.col("canonical_video_id").isNotNull() & (F.col("canonical_video_id") != F.col("video_id"))
        self._said(own().where(linked & F.col("status").isin(*registry.WORK_STATES)).withColumn("error", F.lit(None).cast("string")), 0, F.lit("DUPLICATE_LINKED"))
        for order, (name, before, after) in enumerate(STEPS, 1):
            at_step = own().where(F.col("status") == before)
            made = self._output(name, self.stages[name], at_step)
            self._said(made, order, F.lit(after), before)
        at_end = own().where("status = 'EMBEDDED'")
        if self.identify is None:
            self._said(at_end.withColumn("error", F.lit(None).cast("string")), 3, F.lit("ID_PENDING"))
        else:
            made = self._output("identify", self.identify, at_end)
            self._said(made, 3, F.when(F.col("sure") > 0, "ID_ASSIGNED").otherwise("ID_UNRESOLVED"), "EMBEDDED")
        self.claims.give_back(mine)
        return len(mine)

    def _output(self, name: str, stage: Stage, rows: DataFrame) -> DataFrame:
        """A stage's result for rows: of what is there already, and of one run for those that lack it."""
        table = self.outputs[name]
        good = table.read().where("error IS NULL").select("video_id").distinct()
        todo = rows.join(good, "video_id", "left_anti").drop("last_error", "attempts")
        sure = (F.count_if(~F.col("is_unknown") & ~F.col("is_ambiguous")) if name == "identify" else F.lit(0)).alias("sure")
        if not todo.isEmpty():
            found = tables.conform(stage(todo.drop("claim")), table.schema)
            if name == "identify":  # no guess is a result too: nobody is known there
                found = todo.select("video_id").join(found, "video_id", "left")
            else:
                found = todo.select("video_id").join(found.withColumn("__there", F.lit(True)), "video_id", "left").withColumn("error", F.when(F.col("__there").isNull(), "the stage gave no row").otherwise(F.col("error"))).drop("__there")
            new = table.append(found)
            failed = new.where("error IS NOT NULL").groupBy("video_id").agg(F.min("error").alias("error"))
        else:
            failed = self.spark.createDataFrame([], OUTPUT)
        done = table.read().where("error IS NULL").groupBy("video_id").agg(sure)
        known = rows.select("video_id", "claim", "status").join(failed, "video_id", "left").join(done, "video_id", "left")
        return known.where("error IS NOT NULL OR sure IS NOT NULL")

    def run(self) -> int:
        """Batches until none is free or a batch brings nothing on; how many recordings were taken."""
        total = 0
        while True:
            before = self.events.read().where("kind = 'transition'").count()
            taken = self.process()
            total += taken
            if not taken or self.events.read().where("kind = 'transition'").count() == before:
                return total


def work_on_stream(landing: DataFrame, worker: Worker, checkpoint: str, trigger: dict | None = None):
    """A running query: each batch of recordings of a stream lands and is worked on; a batch that is run again changes nothing."""

    def handle(batch: DataFrame, _: int) -> None:
        worker.land(batch)
        worker.run()

    return landing.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
