"""Exact dedup: only rows whose hash may be repeated shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trackloom.llm import repeats
from trackloom.llm.scratch import stored

#: A group of more than rows / HOT_SHARE rows joins by broadcast; there are fewer than HOT_SHARE such groups.
HOT_SHARE = 1000


def _flagged(hashed: DataFrame, rows: int, bits_per_row: int, max_filter_bytes: int) -> DataFrame:
    """hashed with maybe: whether the hash h may be repeated.

    Where the filter of all hashes would be larger than max_filter_bytes, ranges
    of hashes have one each, one after the other: rows of a range are sorted
    together in their files, so each pass reads its own part of the table.
    """
    passes = max(1, -(-rows * bits_per_row // (8 * max_filter_bytes)))
    parts = None
    for k in range(passes):
        low, high = (-(1 << 63) + (1 << 64) * x // passes for x in (k, k + 1))
        own = hashed.where(F.col("h").between(low, high - 1)) if passes > 1 else hashed
        maybe = repeats.tester(hashed.sparkSession, repeats.repeated_filter(own.select("h"), rows // passes, bits_per_row, max_bytes=max_filter_bytes))
        one = own.withColumn("maybe", maybe("h"))
        one = stored(one, "flagged") if passes > 1 else one
        parts = one if parts is None else parts.unionByName(one)
    return parts


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_filter_bytes: int = 32 << 20) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty.  Of equal
    texts the row with the largest id stays, null ids last; of rows that share
    id and text exactly one stays.  Other columns are ignored, an empty table
    gives an empty result.

    Pass one hashes every text and builds the filter of possibly repeated
    hashes; with more rows than max_filter_bytes holds at bits_per_row, a filter
    for each range of hashes.  Pass two tests each row: rows outside the filter
    are unique and pass straight through; the others are grouped by SHA-256, at
    any size the same share of rows.  Groups with a large share of all rows (a
    bounded number) are joined back by broadcast, the rest by a shuffle of (id,
    digest) rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select("doc_id", F.xxhash64("t").alias("h"), F.unhex(F.sha2("t", 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    hashed = stored(narrow.sortWithinPartitions("h"), "hashed")
    rows = hashed.count()
    flagged = _flagged(hashed, rows, bits_per_row, max_filter_bytes)
    single = flagged.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")

    # nulls compare lowest in a struct, so the largest id wins and nulls come last
    suspects = flagged.where("maybe").select("doc_id", "digest", "row")
    groups = stored(suspects.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("n")).where("n > 1"), "groups")
    hot_size = max(HOT_SHARE, rows // HOT_SHARE)
    hot = F.broadcast(groups.where(F.col("n") > hot_size))
    by_hot = suspects.join(hot, "digest")
    by_key = suspects.join(hot.select("digest"), "digest", "left_anti").join(groups.where(F.col("n") <= hot_size), "digest", "left")
    grouped = by_hot.unionByName(by_key).select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("best.row") == F.col("row"))).alias("kept"),
        "digest",
    )
    return single.unionByName(grouped).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
