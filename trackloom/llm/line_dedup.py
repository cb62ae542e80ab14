"""Line dedup: lines that many sites share are boilerplate and stay in one document only."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from trackloom.llm.names import fresh
from trackloom.llm.scratch import stored

#: Standard error of a sketch with 2 ** 12 registers, about 1.04 / 64, and how many of them count as near.
SKETCH_LG, SKETCH_ERROR, NEAR = 12, 0.01625, 3
SALT = "second hash"
#: Fixed value: the seed of the engine's xxhash64.
SEED = 42


def _key(line: Column) -> Column:
    """128 bits of a line, in two longs."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(SALT), line).alias("h2"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _not_blank(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _keyed_lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    keys = F.transform(F.filter(_lines(F.col(text_col).cast("string")), _not_blank), _key)
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.explode(keys).alias("k")).select("id", "site", "k.h1", "k.h2")


def line_key(line: bytes, salted: int) -> tuple[int, int]:
    """_key in Python; salted is the hash of the salt."""
    return xxhash.xxh64_intdigest(line, SEED), xxhash.xxh64_intdigest(line, salted)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("removed", T.LongType())]))
def _without(texts: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.DataFrame:
    """Texts without the lines of the given keys; nulls stay."""
    salted, mask = xxhash.xxh64_intdigest(SALT.encode(), SEED), (1 << 64) - 1
    rows = []
    for text, a, b in zip(texts, h1, h2, strict=True):
        if text is None or a is None:
            rows.append((None, 0))
            continue
        gone = {(int(x) & mask, int(y) & mask) for x, y in zip(a, b, strict=True)}
        lines = text.split("\n")
        kept = [x for x in lines if line_key(x.encode(), salted) not in gone]
        rows.append(("\n".join(kept), len(lines) - len(kept)))
    return pd.DataFrame(rows, columns=["text", "removed"])


def boilerplate_lines(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """h1, h2 and first_id of every line on at least min_sites distinct sites.

    One aggregation merges a HyperLogLog sketch of sites per line.  Lines whose
    estimate is further from min_sites than NEAR standard errors (and one site)
    are decided by it; the lines between get exact distinct counts.
    """
    lines = _keyed_lines(docs, id_col, text_col, site_col)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", SKETCH_LG).alias("s"), F.min("id").alias("first_id"))
    low = min_sites * (1 - NEAR * SKETCH_ERROR) - 1
    high = min_sites * (1 + NEAR * SKETCH_ERROR) + 1
    wide = stored(spread.select("h1", "h2", "first_id", F.hll_sketch_estimate("s").alias("sites")).where(F.col("sites") >= low), "spread")
    near = wide.where(F.col("sites") <= high)
    exact = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count_distinct("site").alias("exact")).where(F.col("exact") >= min_sites)
    sure = wide.where(F.col("sites") > high).select("h1", "h2", "first_id")
    return stored(sure.unionByName(near.join(exact, ["h1", "h2"]).select("h1", "h2", "first_id")), "boilerplate")


def line_dedup(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """docs with boilerplate lines taken out of text, n_lines before and n_removed.

    A line is what stands between line feeds, compared unchanged; blank lines
    never count.  A boilerplate line stays where the document has the smallest
    id that holds it, so one copy survives and no document is lost: every row
    comes back, perhaps with an empty text.  A null site is the empty site.  A
    null text stays null with no lines.  Rows with equal ids (null ids too, as
    one id) keep or lose a line together.  Columns named n_lines or n_removed,
    in any case, are replaced, all others stay; an empty table gives an empty
    result.

    Rows of the final join are spread by document; a line's own key only ever
    meets pre-aggregated rows or a join that splits.  Documents with boilerplate
    look their lines up in a hash set (in Python: arrays and maps of the engine
    are searched from end to end), so a long one costs its length.
    """
    found = boilerplate_lines(docs, min_sites, id_col, text_col, site_col)
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    bad, owner, new = fresh([*docs.columns, "n_lines", "n_removed"], "bad", "owner", "new")
    lines = _keyed_lines(docs, id_col, text_col, site_col).select("id", "h1", "h2")
    hits = lines.join(found, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("first_id")))
    marks = hits.groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias(bad)).withColumnRenamed("id", owner)
    text = F.col(text_col).cast("string")
    joined = docs.join(marks, F.col(id_col).eqNullSafe(F.col(owner)), "left")
    touched = F.col(bad).isNotNull() & text.isNotNull()
    out = joined.withColumn(new, _without(F.when(touched, text), F.transform(bad, lambda k: k["h1"]), F.transform(bad, lambda k: k["h2"])))
    cleaned = F.when(touched, F.col(new)["text"]).otherwise(text)
    total = F.when(text.isNull(), 0).otherwise(F.size(F.filter(_lines(text), _not_blank)))
    removed = F.when(touched, F.col(new)["removed"]).otherwise(0)
    return out.select(*(cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in own), total.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))
