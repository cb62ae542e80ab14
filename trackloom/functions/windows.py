"""Window helpers: which row of a key stays, islands, medians and their deviations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def keep_one(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; null keys are keys."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__n = 1").drop("__n")


def row_hash(df: DataFrame) -> Column:
    """A number for a row by its values: an order that doesn't depend on partitioning, for tables without a sequence."""
    return F.xxhash64(*(f"`{f.name}`" for f in df.schema if "map<" not in f.dataType.simpleString()))


def latest_wins(df: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    return keep_one(df, keys, F.col(sequence).desc_nulls_last())


def first_wins(df: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    return keep_one(df, keys, F.col(sequence).asc_nulls_last())


def top_k(df: DataFrame, keys: Sequence[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The k first rows of each key with their rank; the limit is pushed below the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str, tie: str, island: str = "island", opener: str | None = None) -> DataFrame:
    """Numbers the runs of intervals that overlap one of those before them; intervals that only touch don't.

    opener, where given, is a column for the tie of the row that opens the run.
    """
    own = Window.partitionBy(*keys).orderBy(start, tie)
    reached, so_far = F.max(end).over(own.rowsBetween(Window.unboundedPreceding, -1)), own.rowsBetween(Window.unboundedPreceding, 0)
    opened = df.withColumn("__new", F.when(reached.isNull() | (F.col(start) >= reached), 1).otherwise(0))
    numbered = opened.withColumns({island: F.sum("__new").over(so_far)} | ({opener: F.last(F.when(F.col("__new") == 1, F.struct(tie)), ignorenulls=True).over(so_far)[tie]} if opener else {}))
    return numbered.drop("__new")


def array_median(values: Column) -> Column:
    """Median of an array, the mean of the middle two where the count is even; null for none."""
    return F.transform(
        F.array(F.array_sort(values)),
        lambda a: F.when(F.size(a) > 0, (F.try_element_at(a, F.floor((F.size(a) + 1) / 2).cast("int")) + F.try_element_at(a, F.floor(F.size(a) / 2).cast("int") + 1)) / 2),
    )[0]


def array_mad(values: Column, median: Column) -> Column:
    return array_median(F.transform(values, lambda x: F.abs(x - median)))


def grouped_median_mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, median and mad of value; deviations are taken in a second aggregation, so that no group is gathered."""
    medians = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    deviations = df.select(*keys, value).join(medians, list(keys)).withColumn("__d", F.abs(F.col(value) - F.col("median")))
    return deviations.groupBy(*keys).agg(F.first("median").alias("median"), F.percentile("__d", F.lit(0.5)).alias("mad"))
