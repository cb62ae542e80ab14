"""Mixing sources to target weights by Pfair scheduling of blocks.

The target is a fluid: at every moment each source that isn't used up flows at
its share of the weights of those that aren't.  Block j of a source is released
when its fluid reaches j blocks and due when it reaches j + 1, in whole slots
that hold that span.  The fluid itself is a schedule in fractions that keeps to
all these windows, so a schedule in whole blocks does too, and earliest
deadline first finds it: at every slot each source is less than one block from
its fluid, also after others have ended.
"""

from __future__ import annotations

import bisect
import heapq
import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from trackloom.llm.names import fresh, own_columns

#: Rows of a source that one task ranks, about.
RANKED = 5_000
RESULTS = ("source_rank", "block", "slot", "release", "deadline", "position")


def whole_weights(shares: dict) -> dict:
    """Shares as whole numbers without a common divisor, in exactly the same proportions; a negative one is an error."""
    exact = {k: Fraction(v) for k, v in shares.items()}
    if any(v < 0 for v in exact.values()):
        raise ValueError("a weight is negative")
    scale = math.lcm(*(v.denominator for v in exact.values()))
    found = {k: int(v * scale) for k, v in exact.items()}
    common = math.gcd(*found.values()) or 1
    return {k: v // common for k, v in found.items()}


def windows(blocks: dict, weights: dict) -> list[tuple[int, int, int, int]]:
    """(release, deadline, number of the source, block) of every block; sources without weight follow the others, in equal shares.

    A source with b blocks and weight w ends at b / w of a clock on which all
    run at their weights.  Where the clock shows v, the sources that have ended
    count with their blocks and the others with v times their weight.
    """
    found, base = [], 0
    for zero in (False, True):
        own = [(n, blocks[k], 1 if zero else weights[k]) for n, k in enumerate(blocks) if blocks[k] and (weights[k] == 0) == zero]
        own.sort(key=lambda s: (Fraction(s[1], s[2]), s[0]))
        ended, running = [0], [sum(w for _, _, w in own)]
        for _, b, w in own:
            ended.append(ended[-1] + b)
            running.append(running[-1] - w)
        for place, (n, b, w) in enumerate(own):
            m, before = 0, 0
            for j in range(b):
                release = base + before
                # as many have ended when this block ends as have b / w of (j + 1) / its weight or less; this one at its last block
                m = bisect.bisect_left(own, True, m, place, key=lambda o: (j + 1) * o[2] < o[1] * w)
                whole, part = divmod((j + 1) * running[m], w)
                found.append((release, base + ended[m] + whole + (part > 0), n, j))
                before = ended[m] + whole
        base += ended[-1]
    return found


def schedule(blocks: dict, weights: dict) -> list[tuple[int, int, int, int, int]]:
    """(slot, release, deadline, number of the source, block) by slot: earliest deadline first among released blocks."""
    waiting = sorted(windows(blocks, weights))
    ready: list = []
    out, at = [], 0
    for slot in range(len(waiting)):
        while at < len(waiting) and waiting[at][0] <= slot:
            release, deadline, n, j = waiting[at]
            heapq.heappush(ready, (deadline, n, j, release))
            at += 1
        deadline, n, j, release = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a block missed its deadline")
        out.append((slot, release, deadline, n, j))
    return out


def _planned(sizes: dict, weights: dict, block_rows: int) -> pa.Table:
    """A row for each block: its source's key, block, slot, release, deadline and the position of its first row."""
    names = list(sizes)
    columns: dict[str, list] = {c: [] for c in ("s", "b", "slot", "release", "deadline", "first")}
    first = 0
    for slot, release, deadline, n, j in schedule({k: -(-v // block_rows) for k, v in sizes.items()}, weights):
        for c, v in zip(columns.values(), (_key(names[n]), j, slot, release, deadline, first), strict=True):
            c.append(v)
        first += min(block_rows, sizes[names[n]] - j * block_rows)
    return pa.table({n: pa.array(c, pa.string() if n == "s" else pa.int64()) for n, c in columns.items()})


def _key(source: str | None) -> str:
    """Never null, so that equal sources are dealt alike."""
    return "n" if source is None else f"s{source}"


def mix_sources(docs: DataFrame, weights: dict | None = None, alpha: float = 0.7, block_rows: int = 64, max_blocks: int = 250_000, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with source_rank, block, slot, release, deadline and position (from 0, without gaps).

    weights are target shares by source, zero or more; a source that isn't named
    gets the smallest share named.  Without weights a source's share goes with
    its rows to the power alpha.  Blocks of block_rows rows of a source, in the
    order of the MD5 of the id, are interleaved so that at every slot each
    source is less than one block from its share, which isn't rounded, among the
    sources that aren't used up; sources of weight 0 follow when all others are.
    Release and deadline are slots.  Every row gets a position.

    A null source is a source; null ids come in one place; equal ids follow in
    the order of a hash of their rows, so that repeated rows alone may change
    places.  An empty table gives an empty result.  Columns with the names of
    results are replaced, all others stay.

    A source's rows are ranked in ranges of the MD5, about RANKED rows each, so
    a hot source is split like the others.  Counts by source reach the driver,
    which plans a row for each block; the plan is broadcast and has max_blocks
    rows at most.  Where block_rows would make more (beyond 16 million rows by
    default), blocks are as much larger; max_blocks sources or more are an error.
    """
    spark = docs.sparkSession
    own = docs.select(*(c for c, name in zip(own_columns(docs), docs.columns, strict=True) if name.lower() not in RESULTS))
    s, key, part, tie, n, before, place, s2, part2 = fresh([*own.columns, *RESULTS], "source", "key", "range", "tie", "n", "before", "in", "source2", "range2")
    source = F.col(source_col).cast("string")
    counted = own.groupBy(source.alias("s")).agg(F.count("*").alias("n")).limit(max_blocks).collect()
    if len(counted) >= max_blocks:
        raise ValueError(f"{max_blocks} sources or more; group them first")
    sizes = {r["s"]: r["n"] for r in sorted(counted, key=lambda r: (r["s"] is not None, r["s"] or ""))}
    block_rows = max(block_rows, -(-sum(sizes.values()) // (max_blocks - len(sizes))))
    least = min(weights.values()) if weights else None
    target = whole_weights({k: weights.get(k, least) if weights else v**alpha for k, v in sizes.items()}) if sizes else {}
    names = fresh([*own.columns, *RESULTS], "ps", "pb", "ps1", "ps2", "ps3", "first")
    planned = spark.createDataFrame(_planned(sizes, target, block_rows), "s string, b long, slot long, release long, deadline long, first long").toDF(*names)

    digits = 1
    while 16**digits * RANKED < max(sizes.values(), default=0) and digits < 7:
        digits += 1
    hashed = [F.col(f"`{f.name}`") for f in own.schema if "map<" not in f.dataType.simpleString() and not isinstance(f.dataType, (T.VariantType, T.NullType))]
    keyed = own.withColumns({s: F.coalesce(F.concat(F.lit("s"), source), F.lit("n")), key: F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), tie: F.xxhash64(*hashed)}).withColumn(part, F.substring(key, 1, digits))
    running = Window.partitionBy(s2).orderBy(part2).rowsBetween(Window.unboundedPreceding, -1)
    ranges = keyed.groupBy(F.col(s).alias(s2), F.col(part).alias(part2)).agg(F.count("*").alias(n)).withColumn(before, F.coalesce(F.sum(n).over(running), F.lit(0)))
    within = Window.partitionBy(s, part).orderBy(key, id_col, tie)
    ranked = keyed.withColumn(place, F.row_number().over(within)).join(ranges, (F.col(s) == F.col(s2)) & (F.col(part) == F.col(part2)))

    rank = F.col(before) + F.col(place) - 1
    ranked = ranked.withColumns({"source_rank": rank.cast("long"), "block": F.floor(rank / block_rows).cast("long")})
    ranked = ranked.join(F.broadcast(planned), (F.col(s) == F.col(names[0])) & (F.col("block") == F.col(names[1])))  # max_blocks rows at most
    ranked = ranked.withColumns({"slot": F.col(names[2]), "release": F.col(names[3]), "deadline": F.col(names[4]), "position": F.col(names[5]) + F.col("source_rank") % block_rows})
    return ranked.select(*own_columns(own), *RESULTS)
