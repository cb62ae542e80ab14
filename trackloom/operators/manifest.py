"""Recordings: duplicates, times, overlap groups and corrections."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from trackloom.functions import exprs, windows

#: Fixed value: columns that a reviewed correction may change.
CORRECTED = ("recording_start", "recording_end", "timestamp_source", "timestamp_confidence", "session_id", "session_type", "domain")


def mark_duplicates(files: DataFrame, hash_col: str = "sha256", order_col: str = "path", id_col: str = "video_id") -> DataFrame:
    """is_duplicate and duplicate_of: the id of the first row, by order and then id, with the same hash.

    A file without a hash is a duplicate of nothing.  The first of each hash is
    an aggregate that combines before the shuffle, so a hash of many copies
    costs one row a task; its join back may be split.
    """
    place = F.struct(F.col(order_col).alias("order"), F.col(id_col).alias("id"))
    hashed = files.where(F.col(hash_col).isNotNull())
    marked = hashed.join(hashed.groupBy(hash_col).agg(F.min(place).alias("__first")), hash_col)
    again = place > F.col("__first")
    known = marked.withColumns({"is_duplicate": again, "duplicate_of": F.when(again, F.col("__first.id"))}).drop("__first")
    unknown = files.where(F.col(hash_col).isNull()).withColumns({"is_duplicate": F.lit(False), "duplicate_of": F.lit(None).cast(files.schema[id_col].dataType)})
    return known.unionByName(unknown).select(*(c for c in files.columns if c not in ("is_duplicate", "duplicate_of")), "is_duplicate", "duplicate_of")


def usable(manifest: DataFrame) -> DataFrame:
    """Enabled recordings that aren't duplicates; a missing flag enables."""
    return manifest.where(F.coalesce("enabled", F.lit(True)) & ~F.coalesce("is_duplicate", F.lit(False)))


def timestamp_fit(samples: DataFrame, key: str, offset: str = "offset_s", time: str = "timestamp", duration: str = "duration_s", tolerance_s: float = 3.0) -> DataFrame:
    """One start a recording from overlay readings: key, recording_start, recording_end, source, confidence, error.

    Each reading less its offset is a start; the upper median is the start if
    two readings agree with it to tolerance_s (one, where there is one reading
    alone).  A recording has a handful of readings, so its starts fit a row.
    """
    start = F.when(F.col(time).isNotNull(), exprs.seconds(F.col(time)) - F.col(offset))
    gathered = samples.groupBy(key).agg(F.array_sort(F.collect_list(start)).alias("starts"), F.count("*").alias("n"), F.max(duration).alias("__duration"))
    epoch = F.try_element_at("starts", F.floor(F.size("starts") / 2).cast("int") + 1)
    fitted = gathered.withColumn("epoch", epoch).withColumn("inliers", F.size(F.filter("starts", lambda s: F.abs(s - F.col("epoch")) <= tolerance_s)))
    error = F.when(F.size("starts") == 0, "no_valid_ocr_sample").when((F.col("inliers") < 2) & (F.col("n") >= 2), "ocr_timeline_inconsistent")
    share = F.least(F.lit(1.0), F.col("inliers") / F.greatest(F.lit(3), F.col("n")))
    confidence = F.when(F.col("inliers") == 1, F.least(share, F.lit(0.35))).otherwise(share)
    micros = lambda s: F.timestamp_micros(F.round(s * 1e6).cast("bigint"))
    good = F.col("error").isNull()
    return fitted.withColumn("error", error).select(
        key,
        F.when(good, micros(F.col("epoch"))).alias("recording_start"),
        F.when(good, micros(F.col("epoch") + F.greatest(F.lit(0.0), F.col("__duration")))).alias("recording_end"),
        F.when(good, "camera_ocr").otherwise("unknown").alias("timestamp_source"),
        F.when(good, confidence).otherwise(0.0).alias("timestamp_confidence"),
        "error",
    )


def _island_names(numbered: DataFrame, camera_col: str, id_col: str) -> DataFrame:
    """camera, __island and overlap_group_id, the start of the SHA-1 of the island's ids, sorted and joined by a bar.

    The ids stream through the hash in sorted order, so an island of any size
    takes no more memory than a batch, and its text is made once.
    """
    own = numbered.select(F.col(camera_col).alias("__camera"), "__island", F.col(id_col).cast("string").alias("__id"))
    ranged = own.repartition("__camera", "__island").sortWithinPartitions("__camera", "__island", "__id")

    def run(batches):
        last = digest = None
        begun = False
        for batch in batches:
            cameras, islands, ids = batch.columns
            # a run ends where the camera or the island changes
            changed = np.ones(len(ids), bool)
            for k, c in enumerate((cameras, islands)):
                codes = np.asarray(c.dictionary_encode().indices.fill_null(-1))
                changed[1:] = codes[1:] != codes[:-1] if k == 0 else changed[1:] | (codes[1:] != codes[:-1])
            cuts, texts, done = [*np.flatnonzero(changed).tolist(), len(ids)], ids.to_pylist(), []
            for begin, end in zip(cuts, cuts[1:]):
                key = (cameras[begin].as_py(), islands[begin].as_py())
                if key != last or digest is None:
                    if digest is not None:
                        done.append((*last, digest.hexdigest()[:12]))
                    last, digest, begun = key, hashlib.sha1(), False
                known = [t for t in texts[begin:end] if t is not None]
                if known:
                    digest.update((("|" if begun else "") + "|".join(known)).encode())
                    begun = True
            if done:
                yield made(done)
        if digest is not None:
            yield made([(*last, digest.hexdigest()[:12])])

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = own.select("__camera", "__island", F.lit("").alias("__name")).schema
    arrow = to_arrow_schema(schema)

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return ranged.mapInArrow(run, schema).select(F.col("__camera").alias(camera_col), "__island", F.concat(F.lit("ovl_"), "__name").alias("overlap_group_id"))


def overlap_groups(manifest: DataFrame, id_col: str = "video_id", camera_col: str = "camera_id", start_col: str = "recording_start", end_col: str = "recording_end", duplicate_col: str | None = None) -> DataFrame:
    """overlap_group_id, canonical_video_id and overlap_unverified of every recording.

    Recordings of a camera that overlap, by steps too, are a group; those that
    only touch are not.  A row without both times, or that ends before it
    starts, is a group of its own; the former is unverified.  A row without a
    camera is in no group and its own canonical.  The canonical recording is the
    earliest, then the least id; a duplicate takes that of its original.
    """
    start, end = F.col(start_col), F.col(end_col)
    base = manifest.withColumn("__unverified", start.isNull() | end.isNull())
    alone = base.where(F.col(camera_col).isNull() | F.col("__unverified") | (end <= start))
    timed = base.where(F.col(camera_col).isNotNull() & ~F.col("__unverified") & (end > start))
    numbered = windows.islands(timed, [camera_col], start_col, end_col, id_col, "__island", "__first")
    grouped = numbered.join(_island_names(numbered, camera_col, id_col), [camera_col, "__island"]).withColumn("canonical_video_id", F.col("__first").cast("string")).drop("__island", "__first")
    own = F.col(id_col).cast("string")
    single = alone.withColumns({"canonical_video_id": own, "overlap_group_id": F.when(F.col(camera_col).isNull(), "").otherwise(exprs.short_sha1(own, "ovl_"))})
    out = grouped.unionByName(single).withColumnRenamed("__unverified", "overlap_unverified")
    if duplicate_col is None:
        return out.select(*manifest.columns, "overlap_group_id", "canonical_video_id", "overlap_unverified")
    originals = out.groupBy(own.alias("__id")).agg(F.max("canonical_video_id").alias("__canonical"))
    of = exprs.blank_to_null(F.col(duplicate_col).cast("string"))
    linked = out.join(originals, of == F.col("__id"), "left")
    canonical = F.when(of.isNotNull(), F.coalesce("__canonical", of)).otherwise(F.col("canonical_video_id"))
    return linked.withColumn("canonical_video_id", canonical).select(*manifest.columns, "overlap_group_id", "canonical_video_id", "overlap_unverified")


def overlapping_pairs(manifest: DataFrame, id_col: str, camera_col: str, start_col: str, end_col: str, bucket_s: int = 3600, digits: int | None = None) -> DataFrame:
    """left_id, right_id and seconds (rounded to digits, halves up) of recordings of a camera that overlap.

    A recording lies in all time buckets of its camera that it touches; of a
    pair the one that starts later counts in the bucket of its start alone, so a
    pair is met once.  Buckets are a 24th of bucket_s or as much longer, up to
    bucket_s, as makes them six times the mean length, so what is shuffled stays
    near a row a recording.  A bucket's rows come in order of their starts and
    those that still run are held; what starts before they end overlaps them, so
    nothing else is compared.
    """
    wide = bucket_s * 1_000_000
    known = F.col(id_col).isNotNull() & F.col(camera_col).isNotNull() & (F.col(end_col) > F.col(start_col))
    own = manifest.where(known).select(F.col(id_col).alias("id"), F.col(camera_col).alias("camera"), exprs.micros(F.col(start_col)).alias("s"), exprs.micros(F.col(end_col)).alias("e"))
    mean, size = own.agg(F.coalesce(F.avg(F.col("e") - F.col("s")), F.lit(0.0))).first()[0], max(wide // 24, 1)
    while size < min(6 * mean, wide):
        size = min(2 * size, wide)
    bucket = lambda time: F.expr(f"{time} div {size} - int({time} % {size} < 0)")
    dealt = own.select("*", F.explode(F.sequence(bucket("s"), bucket("(e - 1)"))).alias("bucket")).select("*", (F.col("bucket") == bucket("s")).alias("starts"))
    spark = manifest.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    ordered = dealt.repartition(parts, "camera", "bucket").sortWithinPartitions("camera", "bucket", "s")
    lists = ordered.mapInArrow(_running_pairs, own.select(F.col("id").alias("a"), F.array("id").alias("b"), F.array("s").alias("common")).schema)
    pairs = lists.select("a", F.posexplode("b").alias("n", "b"), "common").select("a", "b", F.get("common", F.col("n")).alias("common"))
    seconds = F.col("common") / F.lit(1e6) if digits is None else F.expr(f"(common + {10 ** (6 - digits) // 2}) div {10 ** (6 - digits)}") / F.lit(float(10**digits))
    return pairs.where("a <> b").select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), seconds.alias("seconds"))


#: Pairs of one batch, about.
PAIRS = 1 << 17


def _running_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a and, as lists, all b that overlap it and the common microseconds, from id, camera, s, e, bucket and starts in order of camera, bucket and s.

    Held are a batch and the rows of the current bucket that run on.
    """
    place = ids = ends = None
    for batch in batches:
        cuts = [0, *(np.flatnonzero(_changed(batch.column("camera")) | _changed(batch.column("bucket"))) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            if begin == end:
                continue
            run = batch.slice(begin, end - begin)
            here = run.column("camera")[0].as_py(), run.column("bucket")[0].as_py()
            s, e, starts = (run.column(c).to_numpy(zero_copy_only=False) for c in ("s", "e", "starts"))
            if here != place:
                place, ids, ends = here, run.column("id").slice(0, 0), e[:0]
            # the rows that start here, which each one held and each row meets from its place to its end
            later = np.flatnonzero(starts)
            ls, le, lid = s[later], e[later], run.column("id").take(pa.array(later))
            first = np.concatenate([np.zeros(len(ends), np.int64), np.cumsum(starts)])
            ids, ends = pa.concat_arrays([ids, run.column("id")]), np.concatenate([ends, e])
            counts = np.maximum(np.searchsorted(ls, ends, "left") - first, 0)
            total = np.cumsum(counts)
            lo = 0
            while lo < len(counts):
                before = total[lo] - counts[lo]
                hi = max(lo + 1, int(np.searchsorted(total, before + PAIRS, "right")))
                n = counts[lo:hi]
                if total[hi - 1] > before:
                    j = np.arange(total[hi - 1] - before) + np.repeat(first[lo:hi] - (total[lo:hi] - n - before), n)
                    common = np.minimum(np.repeat(ends[lo:hi], n), le[j]) - ls[j]
                    offsets = pa.array(np.concatenate([[0], total[lo:hi] - before]), pa.int32())
                    lists = (pa.ListArray.from_arrays(offsets, x) for x in (lid.take(pa.array(j)), pa.array(common)))
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *lists], names=["a", "b", "common"])
                lo = hi
            on = ends > s[-1]
            ids, ends = ids.filter(pa.array(on)), ends[on]


def _changed(column: pa.Array) -> np.ndarray:
    """Whether a value differs from the one before, from the second on."""
    codes = np.asarray(column.dictionary_encode().indices)
    return codes[1:] != codes[:-1]


def overlay(raw: DataFrame, corrections: DataFrame, key: str = "video_id", columns: Sequence[str] = CORRECTED, source_col: str | None = "timestamp_source", sequence: str | None = None) -> DataFrame:
    """raw with the non-null values of reviewed corrections; of a key's corrections the last applied wins, column by column.

    sequence says which of a key's corrections is applied later; without it one
    is chosen by a hash of the row, whatever the partitioning.  Only rows whose source is "manual" are applied, where there is a source
    column.  A correction of a key that raw hasn't is an error.
    """
    manual = corrections if source_col is None else corrections.where(F.lower(exprs.stripped(F.col(source_col))) == "manual")
    given = [c for c in columns if c in corrections.columns]
    order = F.col(sequence) if sequence else windows.row_hash(corrections)
    last = manual.withColumn("__o", order).groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__o"))).alias(f"__{c}") for c in given))
    if corrections.select(key).join(raw.select(key), key, "left_anti").head(1):
        raise ValueError("a correction names a recording that isn't there")
    joined = raw.join(last, key, "left")
    values = {c: F.coalesce(f"__{c}", *([c] if c in raw.columns else [])) for c in given}
    return joined.withColumns(values).select(*raw.columns, *(c for c in given if c not in raw.columns))


def canonical_manifest(raws: Iterable[DataFrame], corrections: Iterable[DataFrame] = ()) -> DataFrame:
    """All manifests with corrections applied in order, and overlap groups found anew from the corrected times."""
    merged: DataFrame | None = None
    for raw in raws:
        merged = raw if merged is None else merged.unionByName(raw, allowMissingColumns=True)
    if merged is None:
        raise ValueError("at least one manifest is needed")
    for reviewed in corrections:
        merged = overlay(merged, reviewed)
    dropped = [c for c in ("overlap_group_id", "canonical_video_id", "overlap_unverified") if c in merged.columns]
    return overlap_groups(merged.drop(*dropped), duplicate_col="duplicate_of" if "duplicate_of" in merged.columns else None)


def with_recording_time(tracks: DataFrame, manifests: Sequence[DataFrame]) -> DataFrame:
    """tracks with the manifests' times and places where they know them; of several manifests the last wins."""
    names = ("recording_start", "recording_timestamp", "camera_id", "session_id", "domain", "duration_s")
    merged = None
    for n, manifest in enumerate(manifests):
        one = manifest.withColumn("__n", F.struct(F.lit(n).alias("n"), windows.row_hash(manifest).alias("m")))
        merged = one if merged is None else merged.unionByName(one, allowMissingColumns=True)
    if merged is None:
        return tracks
    known = [c for c in names if c in merged.columns]
    latest = windows.latest_wins(merged, ["video_id"], "__n").select("video_id", *(F.col(c).alias(f"__{c}") for c in known))
    joined = tracks.join(latest, "video_id", "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", *([c] if c in tracks.columns else [])) for c in known}).drop(*(f"__{c}" for c in known))


def manifest_counts(manifest: DataFrame) -> DataFrame:
    """One row: recordings, groups, groups of more than one and unverified rows."""
    groups = manifest.groupBy("overlap_group_id").agg(F.count("*").alias("n"), F.count_if("overlap_unverified").alias("u"))
    return groups.agg(F.sum("n").alias("recordings"), F.count_if(F.expr("overlap_group_id <> ''")).alias("groups"), F.count_if(F.expr("n > 1 AND overlap_group_id <> ''")).alias("shared_groups"), F.sum("u").alias("unverified"))


def sampled_frames(frames: DataFrame, fps: Column, sample_fps: float = 5.0, max_seconds: float | None = None) -> DataFrame:
    """Every k-th frame, k being the whole ratio of rates, up to max_seconds."""
    step = F.greatest(F.lit(1), F.bround(fps / sample_fps, 0).cast("int"))
    out = frames.where(F.col("frame_idx") % step == 0)
    return out if max_seconds is None else out.where(F.col("frame_idx") < (max_seconds * fps).cast("int"))
