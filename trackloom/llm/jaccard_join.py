"""N-gram Jaccard join with Bayesian candidate pruning.

1. Every text becomes its set of word 5-grams (hashed) and a MinHash signature;
   equal sets are one class from here on.
2. Bands of the signature give buckets; buckets with equal members are one.
3. In a bucket, signatures are compared CHECK values at a time; a pair whose
   posterior probability of reaching the threshold falls below the tolerance is
   dropped.  What is left links the bucket's classes into families.
4. In a family all pairs are compared that way, and those left are verified
   exactly on the sets; verified links give counts and the final classes.

Buckets and families are cut into blocks, and pairs of blocks are compared
inside a task: no row is made for a pair, and no group grows with the data.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trackloom.llm import repeats
from trackloom.llm.components import components
from trackloom.llm.memory import trimmed
from trackloom.llm.names import fresh, own_columns
from trackloom.llm.scratch import stored

#: With 28 bands of 4 values a pair of similarity 0.8 shares no band once in 2.5 million.
BANDS, BAND = 28, 4
VALUES = BANDS * BAND
CHECK = 16
TEXTS, SLICE = 1 << 19, 1 << 20
M64 = (1 << 64) - 1
#: Members of a bucket block; members and 5-grams of a family block.
BUCKET_BLOCK, FAMILY_BLOCK, FAMILY_GRAMS = 2048, 512, 1 << 19
#: Rows a task compares, about.
ROWS = 20_000
HOT_SHARE = 1000
#: Bits an id has in the filter of families.
FILTER_BITS = 16
LAST = np.iinfo(np.int64).max

P = np.uint64(0x100000001B3)
INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_PARAMETERS = _mixed(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).reshape(2, VALUES)
SHIFTS, FACTORS = _PARAMETERS[0], _PARAMETERS[1] | np.uint64(1)


def _long_words(text: bytes) -> np.ndarray:
    """Hashes of a text's words, SLICE bytes at a time; a word that goes on over a cut is put together from its parts."""
    found, open_ = [], None
    for lo in range(0, len(text), SLICE):
        data = np.frombuffer(text[lo : lo + SLICE], np.uint8)
        gap = np.concatenate(([True], SPACE[data], [True]))
        begin, end = np.flatnonzero(~gap[1:] & gap[:-1]), np.flatnonzero(gap[1:] & ~gap[:-1])
        power, back = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(data), x, np.uint64)))) for x in (P, INVERSE))
        prefix = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1])))
        words, sizes = (prefix[end] - prefix[begin]) * back[begin], end - begin
        if open_ and len(words) and begin[0] == 0:
            words[0] = (open_[0] + pow(int(P), open_[1], 1 << 64) * int(words[0])) & M64
            sizes[0] += open_[1]
        elif open_:
            found.append(np.array([open_[0]], np.uint64))
        open_ = None
        if len(words) and end[-1] == len(data):
            open_ = (int(words[-1]), int(sizes[-1]))
            words = words[:-1]
        found.append(words)
    if open_:
        found.append(np.array([open_[0]], np.uint64))
    return _mixed(np.concatenate(found))


def _set_of(words: np.ndarray, n: int) -> np.ndarray:
    """gram_sets of one text whose words' hashes these are."""
    if len(words) < n:
        h = np.zeros(1 if len(words) else 0, np.uint64)
        for w in words:
            h = h * P + w
        return _mixed(h + np.uint64(len(words)))
    grams = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        grams = grams * P + words[k : k + len(grams)]
    return np.unique(_mixed(grams))


def gram_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each text; fewer words than n are one gram, none is no gram.

    A text of more than SLICE bytes is hashed in slices.
    """
    if any(len(t) > SLICE for t in texts):
        return [_set_of(_long_words(t), n) if len(t) > SLICE else gram_sets([t], n)[0] for t in texts]
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    edges = np.cumsum([1, *(len(t) + 1 for t in texts)])
    gap = SPACE[data]
    begin = np.flatnonzero(~gap[1:] & gap[:-1]) + 1
    end = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
    power, back = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(data), x, np.uint64)))) for x in (P, INVERSE))
    prefix = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1])))
    words = _mixed((prefix[end] - prefix[begin]) * back[begin])
    cut = np.searchsorted(begin, edges)
    grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        grams = grams * P + words[k : k + len(grams)]
    grams = _mixed(grams)
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for w in words[a:b]:
                h = h * P + w
            out.append(_mixed(h + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (uint32), VALUES a set; an empty set has all ones."""
    out = np.full((len(sets), VALUES), 0xFFFFFFFF, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        grams = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        for v in range(VALUES):
            out[full, v] = np.minimum.reduceat((grams ^ SHIFTS[v]) * FACTORS[v], starts) >> np.uint64(32)
    return out


def set_keys(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    return tuple(int(x.view(np.int64)) for x in (_mixed(s).sum(dtype=np.uint64), _mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)))


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For CHECK, 2 CHECK, ... values: the fewest matches at which a pair is kept.

    With a uniform prior the posterior of similarity after m of n matches is
    Beta(m + 1, n - m + 1); it reaches the threshold with the probability that
    a binomial of n + 1 trials at the threshold gives m or fewer.
    """
    found = []
    for n in range(CHECK, VALUES + 1, CHECK):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        found.append(m)
    return found


def plausible(left: np.ndarray, right: np.ndarray, least: list[int], pairs: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of left and right that stay after every CHECK values; all pairs, or those given."""
    if pairs is None:
        matches = np.zeros((len(left), len(right)), np.uint8)
        for v in range(CHECK):
            matches += left[:, v, None] == right[None, :, v]
        i, j = np.nonzero(matches >= least[0])
        done, count = CHECK, matches[i, j].astype(np.int64)
    else:
        i, j = pairs
        done, count = 0, np.zeros(len(i), np.int64)
    while done < VALUES and len(i):
        count = count + (left[i, done : done + CHECK] == right[j, done : done + CHECK]).sum(axis=1)
        done += CHECK
        keep = count >= least[done // CHECK - 1]
        i, j, count = i[keep], j[keep], count[keep]
    return i, j


def unite(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[k] and b[k]; up holds everyone's root, the least member, before and after."""
    while True:
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(up, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (up[up] != up).any():
            up[:] = up[up]


def bucket_forest(values: np.ndarray, least: list[int]) -> np.ndarray:
    """Root of each row when plausible pairs are joined.

    The first row meets all; each row that it doesn't absorb meets all as well.
    Pairs within the first row's set need no look: they are joined already.
    """
    up = np.arange(len(values))
    i, j = plausible(values[:1], values, least)
    unite(up, i, j)
    rest = np.flatnonzero(up != 0)
    for lo in range(0, len(rest), 256):
        own = rest[lo : lo + 256]
        i, j = plausible(values[own], values, least)
        unite(up, own[i], j)
    return up


def verified(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (i of left, j of right) reach the threshold exactly."""
    a, b = np.array([len(s) for s in left])[i], np.array([len(s) for s in right])[j]
    if len(i) < 64:
        both = np.array([len(np.intersect1d(left[x], right[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    else:
        rows, columns = np.unique(i), np.unique(j)
        grams = np.concatenate([left[x] for x in rows] + [right[y] for y in columns])
        owner = np.repeat(np.arange(len(rows) + len(columns)), [len(left[x]) for x in rows] + [len(right[y]) for y in columns])
        number, times = np.unique(grams, return_inverse=True, return_counts=True)[1:]
        shared = times[number] > 1
        owner, number = owner[shared], np.unique(number[shared], return_inverse=True)[1]
        by = np.argsort(number, kind="stable")
        owner, number = owner[by], number[by]
        counts = np.zeros((len(rows), len(columns)), np.float32)
        width = 4096
        cuts = np.searchsorted(number, np.arange(0, (number[-1] if len(number) else 0) + width + 1, width))
        for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if hi > lo:
                bits = np.zeros((len(rows) + len(columns), width), np.float32)
                bits[owner[lo:hi], number[lo:hi] - k * width] = 1
                counts += bits[: len(rows)] @ bits[len(rows) :].T
        both = counts[np.searchsorted(rows, i), np.searchsorted(columns, j)].astype(np.int64)
    return both >= threshold * (a + b - both) - 1e-9


def _portions(batches, column: int):
    """(batch, first row, texts as bytes) with TEXTS bytes together, or one long row."""
    for batch in batches:
        first, held, texts = 0, 0, []
        for k, t in enumerate(batch.column(column)):
            texts.append(t.as_buffer().to_pybytes())
            held += len(texts[-1])
            if held >= TEXTS:
                yield batch, first, texts
                first, held, texts = k + 1, 0, []
        if texts:
            yield batch, first, texts


def _sketch(words: int):
    def run(batches):
        for batch, first, texts in _portions(batches, 2):
            sets = gram_sets(texts, words)
            keys = [set_keys(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)), pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([v.tobytes() for v in signatures(sets)], pa.binary())],
                ["did", "th", "k1", "k2", "grams", "sig"],
            )

    return run


def _blocks(rows: DataFrame, group: list[str], parts: int) -> DataFrame:
    """rows with blocks (their number in column blocks) repeated for each pair of blocks, and the task part they go to."""
    paired = rows.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = paired.withColumns({"x": F.least("block", "other").cast("int"), "y": F.greatest("block", "other").cast("int")})
    return placed.withColumn("part", F.pmod(F.xxhash64(*group, "x", "y"), F.lit(parts)).cast("int")).drop("other", "blocks")


def _by_pair(group: pa.Table, keys: list[str]):
    """Row numbers of each (key, x, y) in a task's part."""
    columns = [group.column(c).to_numpy() for c in [*keys, "x", "y"]]
    order = np.lexsort(columns[::-1])
    changed = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    return np.split(order, np.flatnonzero(changed) + 1)


def _bucket_task(least: list[int]):
    def run(group: pa.Table) -> pa.Table:
        rid, sig = group.column("rid").to_numpy(), group.column("sig")
        values = np.frombuffer(b"".join(x.as_py() for x in sig), np.uint32).reshape(-1, VALUES)
        a, b = [], []
        for rows in _by_pair(group, ["key"]):
            rows = rows[np.argsort(rid[rows], kind="stable")]
            up = bucket_forest(values[rows], least)
            below = np.flatnonzero(up != np.arange(len(up)))
            a.append(rid[rows[below]]), b.append(rid[rows[up[below]]])
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in (a, b)], names=["a", "b"])

    return run


def _family_task(threshold: float, least: list[int]):
    def run(group: pa.Table) -> pa.Table:
        rid, copies, block = (group.column(c).to_numpy() for c in ("rid", "copies", "block"))
        x, y = group.column("x").to_numpy(), group.column("y").to_numpy()
        values = np.frombuffer(b"".join(s.as_py() for s in group.column("sig")), np.uint32).reshape(-1, VALUES)
        sets = [np.frombuffer(s.as_py(), np.uint64) for s in group.column("set")]
        out, place = [], np.zeros(len(rid), np.int64)
        for rows in _by_pair(group, ["fam"]):
            rows = rows[np.argsort(rid[rows], kind="stable")]
            one = x[rows[0]] == y[rows[0]]
            left = rows if one else rows[block[rows] == x[rows[0]]]
            right = rows if one else rows[block[rows] == y[rows[0]]]
            up, links = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            place[rows] = np.arange(len(rows))
            for lo in range(0, len(left), 256):
                own = left[lo : lo + 256]
                i, j = plausible(values[own], values[right], least)
                if one:
                    i, j = i[j > i + lo], j[j > i + lo]
                if not len(i):
                    continue
                ok = verified([sets[r] for r in own], [sets[r] for r in right], i, j, threshold)
                p, q = own[i[ok]], right[j[ok]]
                np.add.at(links, place[p], copies[q])
                np.add.at(links, place[q], copies[p])
                unite(up, place[p], place[q])
            found = np.flatnonzero(links)
            out.append((rid[rows[found]], links[found], rid[rows[up[found]]]))
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=["rid", "links", "root"])

    return run


def jaccard_join(docs: DataFrame, threshold: float = 0.8, words: int = 5, tolerance: float = 1e-6, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = 64 << 20) -> DataFrame:
    """One row per input row: doc_id, th (hash of its text), class_id, copy_of, n_links, n_grams.

    Two texts are linked when the Jaccard similarity of their sets of word
    n-grams is threshold or more; words stand between ASCII white space, as they
    are.  n_links counts the other rows linked to this one, copies included.
    class_id is the least id of the rows that links connect, copy_of the least
    id of the rows with the same set.  A text of fewer words than n is one gram;
    texts without a word (null ones too) are copies of each other.  Ids are
    integers; null ids come last and give null class ids only among themselves;
    rows with equal ids are rows of their own.  Other columns are ignored; an
    empty table gives an empty result.

    Texts with a possible partner are picked by a filter of their ids up to
    max_filter_bytes (33 million classes by default), beyond that by a semi
    join, which shuffles the texts once more and gives the same rows.
    """
    return _with_keys(docs, threshold, words, tolerance, id_col, text_col, max_filter_bytes).drop("class_key")


def _with_keys(docs: DataFrame, threshold: float = 0.8, words: int = 5, tolerance: float = 1e-6, id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = 64 << 20) -> DataFrame:
    """jaccard_join with class_key, one for each class, whatever the ids of its rows."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = least_matches(threshold, tolerance)
    text: Column = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    own = docs.select(F.col(id_col).cast("long").alias("did"), F.xxhash64(text).alias("th"), text.alias("t"))
    rows = stored(own.mapInArrow(trimmed(_sketch(words)), "did bigint, th bigint, k1 bigint, k2 bigint, grams int, sig binary"), "signatures")
    classes = rows.groupBy("k1", "k2").agg(F.min("did").alias("first_id"), F.count("*").alias("copies"), F.first("grams").alias("grams"), F.first("sig").alias("sig"))
    classes = stored(classes.withColumn("rid", F.monotonically_increasing_id()), "classes")

    key = lambda b: F.xxhash64(F.lit(b), F.substring(F.col("sig"), 4 * BAND * b + 1, 4 * BAND))
    banded = classes.where("grams > 0").select("rid", F.explode(F.array(*map(key, range(BANDS)))).alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("rid")).alias("e1"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("e2")).where("m > 1")
    distinct = stored(buckets.groupBy("m", "e1", "e2").agg(F.min("key").alias("key")).select("key", "m"), "buckets")
    members = stored(banded.join(distinct, "key"), "members")
    compared = members.join(classes.select("rid", "sig"), "rid").withColumn("blocks", F.ceil(F.col("m") / BUCKET_BLOCK).cast("int")).drop("m")
    total = members.agg(F.sum(F.ceil(F.col("m") / BUCKET_BLOCK))).first()[0] or 0
    edges = _blocks(compared, ["key"], max(partitions, int(total) // ROWS)).groupBy("part").applyInArrow(trimmed(_bucket_task(least)), "a bigint, b bigint")
    families = stored(components(edges).select(F.col("node").alias("rid"), F.col("root").alias("fam")).join(classes, "rid"), "families")

    # the families' texts, found before their sets are made: by a filter of their ids, or where they are more than it holds by a join
    wanted = families.select(F.coalesce("first_id", F.lit(int(LAST))).alias("did_"), "k1", "k2", "rid")
    keyed, n_wanted = own.withColumn("did", F.coalesce("did", F.lit(int(LAST)))), families.count()
    if n_wanted * FILTER_BITS <= 8 * max_filter_bytes:
        maybe = repeats.tester(spark, repeats.member_filter(wanted.select(F.xxhash64("did_").alias("h")), n_wanted, FILTER_BITS, max_bytes=max_filter_bytes))
        some = keyed.where(maybe(F.xxhash64("did")))
    else:
        some = keyed.join(wanted.select(F.col("did_").alias("did")).distinct(), "did", "left_semi")

    def with_sets(batches):
        for batch, first, texts in _portions(batches, 1):
            sets = gram_sets(texts, words)
            keys = [set_keys(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["did_", "k1", "k2", "set"])

    sets = some.select("did", "t").mapInArrow(trimmed(with_sets), "did_ bigint, k1 bigint, k2 bigint, set binary")
    found = sets.join(wanted, ["did_", "k1", "k2"]).select("rid", "set").groupBy("rid").agg(F.first("set").alias("set"))
    sizes = families.groupBy("fam").agg(F.greatest(F.ceil(F.count("*") / FAMILY_BLOCK), F.ceil(F.sum("grams") / FAMILY_GRAMS)).cast("int").alias("blocks"), F.count("*").alias("m"))
    sizes = stored(sizes, "sizes")
    total = sizes.agg(F.sum(F.col("m") * F.col("blocks"))).first()[0] or 0
    family_rows = families.select("rid", "fam", "copies", "sig").join(sizes.select("fam", "blocks"), "fam").join(found, "rid")
    checked = stored(_blocks(family_rows, ["fam"], max(partitions, int(total) * 8 // ROWS)).groupBy("part").applyInArrow(trimmed(_family_task(threshold, least)), "rid bigint, links bigint, root bigint"), "links")

    roots = components(checked.where("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b")))
    linked = checked.groupBy("rid").agg(F.sum("links").alias("links"))
    rooted = roots.join(classes.select(F.col("rid").alias("node"), "first_id"), "node")
    names = stored(rooted.groupBy("root").agg(F.min("first_id").alias("class_id")), "names")
    per_class = classes.select("k1", "k2", "rid", "first_id", "copies").join(roots, F.col("rid") == F.col("node"), "left").join(names, "root", "left").join(linked, "rid", "left")
    per_class = stored(per_class.select("k1", "k2", "copies", F.col("first_id").alias("copy_of"), F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("class_id")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rid").alias("class_key")), "per_class")
    bound = max(HOT_SHARE, rows.count() // HOT_SHARE)  # fewer than HOT_SHARE classes hold more rows than that
    hot, rest = F.broadcast(per_class.where(F.col("copies") > bound)), per_class.where(F.col("copies") <= bound)
    slim = rows.select("did", "th", "k1", "k2", "grams")
    out = slim.join(hot, ["k1", "k2"]).unionByName(slim.join(hot.select("k1", "k2"), ["k1", "k2"], "left_anti").join(rest, ["k1", "k2"]))
    return out.select(F.col("did").alias("doc_id"), "th", "class_id", "copy_of", F.col("n_links").cast("long").alias("n_links"), F.col("grams").cast("long").alias("n_grams"), "class_key")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, unchanged, with one row of each class of jaccard_join: the least id, null ids last, and of rows that share id and text any one.

    Texts without a word (null ones too) are one class.  An empty table gives an
    empty result; all columns stay.
    """
    joined = _with_keys(docs, id_col=id_col, text_col=text_col, **options)
    did, th = fresh(docs.columns, "did", "th")
    best = joined.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("best"))
    kept = best.select(F.coalesce("best.doc_id", F.lit(int(LAST))).alias(did), F.col("best.th").alias(th))
    keyed = docs.withColumns({did: F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST))), th: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))})
    return keyed.join(kept, [did, th], "left_semi").dropDuplicates([did, th]).select(*own_columns(docs))
