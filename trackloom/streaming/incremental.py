"""Structured Streaming forms: alerts over an event stream, and work on a landing table.

These extend the batch operators; the batch forms say what is right.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALERTS = "key string, observed_at timestamp, value double, baseline double, robust_z double, status string"
STATE = "times array<double>, values array<double>, flags array<int>"


def _median(values: list[float]) -> float:
    s = sorted(values)
    return (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2


def alert_stream(observations: DataFrame, key: str, time: str, value: str, watermark: str = "1 hour", window_days: int = 30, min_days: int = 3, z_threshold: float = 3.0, epsilon: float = 1e-6) -> DataFrame:
    """Baseline, robust z and alert status of each observation as it comes, by key, in the order of event times of a batch.

    A key's state holds its values of the last window_days and its last flags;
    rows later than the watermark are dropped by it.
    """

    def update(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values, flags = (list(x) for x in state.get) if state.exists else ([], [], [])
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        out = []
        for t, v in zip(rows["t"], rows["v"], strict=True):
            if pd.isna(v):
                continue
            now = t.timestamp()
            kept = [i for i, x in enumerate(times) if x >= now - window_days * 86400]
            times, values = [times[i] for i in kept], [values[i] for i in kept]
            before = [(x, y) for x, y in zip(times, values, strict=True) if x < now]
            base = z = None
            if len({int(x // 86400) for x, _ in before}) >= min_days:
                own = [y for _, y in before]
                base = _median(own)
                z = (v - base) / (1.4826 * _median([abs(y - base) for y in own]) + epsilon)
            flags = [*flags, int(z is not None and abs(z) >= z_threshold)][-3:]
            times.append(now), values.append(float(v))
            out.append((str(name[0]), t, float(v), base, z, "REVIEW_NEEDED" if len(flags) == 3 and sum(flags) >= 2 else "OK"))
        state.update((times, values, flags))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ALERTS.split(", ")])

    own = observations.select(F.col(key).cast("string").alias("key"), F.col(time).alias("t"), F.col(value).cast("double").alias("v")).withWatermark("t", watermark)
    return own.groupBy("key").applyInPandasWithState(update, ALERTS, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(observations: DataFrame, time: str, value: str, *keys: str, length: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Count and mean of a value by event-time window."""
    return observations.withWatermark(time, watermark).groupBy(F.window(time, length).alias("w"), *keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("window_start"), *keys, "n", "mean")


def process_landing(landing: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Runs handle on every batch of a landing table; with idempotent inserts a batch that runs twice changes nothing."""
    writer = landing.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def with_current_labels(stream: DataFrame, labels: DataFrame, key: str = "tracklet_id") -> DataFrame:
    """A stream of observations under the identities confirmed when its batch runs."""
    return stream.join(labels.where(F.coalesce("confirmed", F.lit(False))).select(key, "entity_id"), key, "left")
