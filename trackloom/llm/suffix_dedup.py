"""Suffix-array dedup: bytes covered by a long string that also starts earlier.

Search.  The anchor of a string of `length` bytes is the GRAM-byte piece in it
with the smallest hash, the leftmost of equals.  Equal strings have equal
anchors at equal places, so occurrences of a string meet where rows are
grouped by the anchor's hash.  Neighbouring strings with one anchor form a
run; a run and the bytes its strings cover is a context.

1. A two-pass Bloom filter finds anchors that may occur more than once.
2. Contexts of those anchors are grouped by anchor, strings of very frequent
   anchors by their own hash; equal contexts of a task are first reduced to the
   earliest, so a hot passage is pre-aggregated.
3. Each group builds a suffix array of its contexts by two-stage sorting,
   compares neighbours, and marks all but the earliest of equal strings.
4. Marks are united by document and the covered bytes removed.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from trackloom.llm import repeats
from trackloom.llm.memory import trimmed

GRAM = 32
P = np.uint64(0x100000001B3)
INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
#: Bytes of text hashed at once, bytes of contexts held for reduction, bytes of contexts sorted at once.
TEXTS, HELD, SORTED = 1 << 19, 8 << 20, 1 << 20
#: Starts of strings in a long text whose anchors are found at once.
SLICE = 1 << 21
#: An anchor that occurs more often, by a count over one document in SAMPLE, has its strings dealt one by one; how many such anchors there are at most.
HOT, SAMPLE, MOST_HOT = 20_000, 32, 1_000_000
#: What a held context takes in memory besides its bytes, about.
OVERHEAD = 600
#: Bits an anchor has in the filter, and how many are set.
FILTER_BITS, FILTER_SET = 8, 3
LAST = np.iinfo(np.int64).max


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@functools.lru_cache(maxsize=2)
def _powers(n: int, factor: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, factor, np.uint64))))


def _power_table(n: int, factor: np.uint64) -> np.ndarray:
    """Powers 0 to n; tables are kept for sizes rounded up."""
    return _powers(1 << max(TEXTS.bit_length(), n.bit_length()), int(factor))[: n + 1]


def runs(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, document, first and last start of every run in documents that lie end to end.

    starts has the documents' first bytes and, last, the end.
    """
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    n, width = len(data), length - GRAM + 1
    if n < length:
        return none
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(data * _power_table(n - 1, P), out=prefix[1:])
    hashes = _mixed((prefix[GRAM:] - prefix[:-GRAM]) * _power_table(n - GRAM, INVERSE))
    # half a hash above the place: the smallest is the leftmost of equals
    rows = np.full(-(-len(hashes) // width) * width, np.iinfo(np.uint64).max)
    rows[: len(hashes)] = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - length + 1
    anchor = np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]).astype(np.uint32)
    valid = np.ones(m, bool)
    for end in starts[1:].tolist():
        valid[max(0, end - length + 1) : end] = False
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])  # no string crosses documents, so neither does a run
    first = np.flatnonzero(begins)
    if not len(first):
        return none
    ends = valid
    ends[:-1] &= ~valid[1:] | begins[1:]
    return hashes[anchor[first]], np.searchsorted(starts, first, side="right") - 1, first, np.flatnonzero(ends)


def sliced_runs(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """runs, SLICE starts at a time where a text is long; a run that goes on over a cut is two."""
    if len(data) <= SLICE:
        return runs(data, starts, length)
    parts = []
    for lo in range(0, len(data), SLICE):
        own = data[lo : lo + SLICE + length - 1]
        inside = starts[(starts > lo) & (starts < lo + len(own))] - lo
        anchor, _, first, last = runs(own, np.concatenate(([0], inside, [len(own)])), length)
        parts.append((anchor, np.searchsorted(starts, first + lo, side="right") - 1, first + lo, last + lo))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def words_at(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number in the order of the bytes; zeros follow the text."""
    padded = text.tobytes() + b"\0" * 8
    return np.ndarray((len(text),), ">u8", padded, strides=(1,)).astype(np.uint64)


def _direct_sort(text: np.ndarray, words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the depth bytes (and up to seven more) that follow; equals in any order.

    Eight bytes a round; a group whose members agree in all the bytes (by hash,
    which only saves rounds: order among hash-equal members is checked again by
    the common prefixes) needs no further round.
    """
    n, last = len(text), len(text) - 1
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(text * _power_table(n - 1, P), out=prefix[1:])
    back = _power_table(n, INVERSE)
    key = words[at]
    move = np.argsort(key)
    order, key = at[move], key[move]
    group = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
    h = (prefix[np.minimum(order + depth, n)] - prefix[order]) * back[order]  # zeros add nothing
    open_ = np.arange(len(order))
    for done in range(8, depth, 8):
        if not len(open_):
            break
        ids, own = group[open_], h[open_]
        bound = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        count = np.diff(np.append(bound, len(ids)))
        same = np.minimum.reduceat(own, bound) == np.maximum.reduceat(own, bound)
        open_ = open_[np.repeat((count > 1) & ~same, count)]
        if not len(open_):
            break
        ids = group[open_]
        key = words[np.minimum(order[open_] + done, last)]
        move = np.lexsort((key, ids))
        order[open_], h[open_], key = order[open_][move], h[open_][move], key[move]
        fresh = np.concatenate(([True], (ids[1:] != ids[:-1]) | (key[1:] != key[:-1])))
        # groups lie in order, so a new group may take the number of its first place, beyond all first numbers
        group[open_] = (open_[fresh] + len(order))[np.cumsum(fresh) - 1]
    return order


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """Places marked in wanted in the order of their suffixes, to depth bytes at least; two-stage sorting.

    text ends with depth + 8 zeros at least.  A suffix smaller than its
    successor's is sorted directly.  Any other follows from its successor: the
    buckets of first bytes are scanned in order, and each suffix met puts the
    one before it, if that is larger, at the next free place of its bucket.
    """
    n = len(text)
    words = words_at(text) if words is None else words
    # smaller than the successor: by the next byte that differs; the zeros at the end count as smaller
    turn = np.where(text[1:] != text[:-1], np.arange(n - 1), n)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    up = np.ones(n, bool)
    known = turn < n
    up[:-1][known] = text[turn[known]] < text[turn[known] + 1]
    # the places needed: wanted ones, and after the last of a stretch those up to one sorted directly
    ups = np.flatnonzero(up)
    tails = np.flatnonzero(wanted & ~np.append(wanted[1:], False) & ~up)
    needed = wanted.copy()
    stops = ups[np.searchsorted(ups, tails)]
    gain = np.zeros(n + 1, np.int32)
    np.add.at(gain, tails, 1)
    np.add.at(gain, stops + 1, -1)
    needed |= np.cumsum(gain[:-1]) > 0

    direct = _direct_sort(text, words, np.flatnonzero(needed & up), depth)
    direct_of = np.split(direct, np.searchsorted(text[direct], np.arange(1, 256)))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def put(placed: np.ndarray, byte: int) -> np.ndarray:
        """Deals the larger predecessors of placed to their buckets; those of this bucket come back."""
        before = placed[placed > 0] - 1
        before = before[needed[before] & ~up[before]]
        first = text[before]
        own = first == byte
        rest, first = before[~own], first[~own]
        by = np.argsort(first, kind="stable")
        rest, first = rest[by], first[by]
        cut = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1]))) if len(first) else []
        for i, lo in enumerate(cut):
            induced[first[lo]].append(rest[lo : cut[i + 1] if i + 1 < len(cut) else None])
        return before[own]

    for byte in range(256):
        queue = np.concatenate(induced[byte]) if induced[byte] else np.zeros(0, np.int64)
        while len(queue):
            out.append(queue)
            queue = put(queue, byte)
        if len(direct_of[byte]):
            out.append(direct_of[byte])
            put(direct_of[byte], byte)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def repeated_starts(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, start) of strings of `length` bytes that also start in an earlier context or earlier in the same."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    text = np.frombuffer(b"\0".join(contexts) + b"\0" * (length + 16), np.uint8)
    wanted = np.zeros(len(text), bool)
    strings = sizes - length + 1
    places = np.repeat(begins - np.concatenate(([0], np.cumsum(strings)[:-1])), strings) + np.arange(strings.sum())
    wanted[places] = True
    words = words_at(text)
    order = suffix_order(text, wanted, length, words)
    equal = shares(words, order, length)
    group = np.cumsum(~equal)
    bound = np.flatnonzero(~equal)
    earliest = np.minimum.reduceat(order, bound)
    later = np.sort(order[order != earliest[group - 1]])
    owner = np.searchsorted(ends, later, side="right")
    return owner, later - begins[owner]


def shares(words: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each place's common prefix with the one before it in order has `length` bytes."""
    equal = np.zeros(len(order), bool)
    open_ = np.arange(1, len(order))
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        open_ = open_[words[order[open_] + k] == words[order[open_ - 1] + k]]
    equal[open_] = True
    return equal


def _joined(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
    return np.frombuffer(b"".join(docs), np.uint8), starts


def _portions(batches):
    """(ids, text hashes, texts as bytes) of rows with TEXTS bytes together, or one long row."""
    for batch in batches:
        ids = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
        hashes = batch.column(1).to_numpy(zero_copy_only=False)
        first, held, texts = 0, 0, []
        for i, t in enumerate(batch.column(2)):
            texts.append(t.as_buffer().to_pybytes())
            held += len(texts[-1])
            if held >= TEXTS:
                yield ids[first : i + 1], hashes[first : i + 1], texts
                first, held, texts = i + 1, 0, []
        if texts:
            yield ids[first:], hashes[first:], texts


def _string_by_string(data: np.ndarray, anchor: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, hot: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of hot anchors as runs of one string each, with the string's hash for an anchor."""
    if not hot.any():
        return anchor, doc, lo, hi
    sizes = hi[hot] - lo[hot] + 1
    starts = np.repeat(lo[hot] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    own = np.array([xxhash.xxh64_intdigest(data[x : x + length].tobytes()) for x in starts.tolist()], np.uint64)
    kept = ~hot
    return np.concatenate((anchor[kept], own)), np.concatenate((doc[kept], np.repeat(doc[hot], sizes))), np.concatenate((lo[kept], starts)), np.concatenate((hi[kept], starts))


MARKED = [("b", pa.int32()), ("anchor", pa.int64()), ("did", pa.int64()), ("dh", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("context", pa.binary())]


def _marks(groups: int, length: int, shared, size: int, hot):
    """Contexts of anchors that may be repeated, the earliest of equal ones, and ranges of the rest.

    Strings of hot anchors are contexts of their own, dealt by their hash.
    """

    def run(batches):
        bitmap, often = np.frombuffer(shared.value, np.uint8, size), hot.value
        earliest: dict[bytes, tuple] = {}
        marked: list[tuple] = []
        held = 0

        def flush():
            rows = [(int(a % np.uint64(groups)), int(a.view(np.int64)), d, h, lo, hi, c) for c, (d, h, lo, hi, a) in earliest.items()]
            marked.sort()
            joined: list[list] = []
            for d, h, lo, hi in marked:
                if joined and joined[-1][:2] == [d, h] and lo <= joined[-1][3] + 1:
                    joined[-1][3] = max(hi, joined[-1][3])
                else:
                    joined.append([d, h, lo, hi])
            rows += [((d ^ h) % groups, h, d, h, lo, hi, None) for d, h, lo, hi in joined]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), MARKED, strict=True)], [n for n, _ in MARKED])
            earliest.clear(), marked.clear()

        for ids, hashes, texts in _portions(batches):
            data, starts = _joined(texts)
            anchor, doc, lo, hi = sliced_runs(data, starts, length)
            maybe = repeats._get(bitmap, repeats.positions(anchor, size * 8, FILTER_SET)).all(axis=1)
            anchor, doc, lo, hi = (x[maybe] for x in (anchor, doc, lo, hi))
            if len(often):
                anchor, doc, lo, hi = _string_by_string(data, anchor, doc, lo, hi, np.isin(anchor.view(np.int64), often), length)
            for a, d, x, y in zip(anchor, doc.tolist(), lo.tolist(), hi.tolist(), strict=True):
                context = data[x : y + length].tobytes()
                place = (int(ids[d]), int(hashes[d]), x - int(starts[d]), y - int(starts[d]), a)
                other = earliest.setdefault(context, place)
                if other is place:
                    held += len(context) + OVERHEAD
                elif other[:2] != place[:2] or other[2] != place[2]:
                    if place[:3] < other[:3]:
                        earliest[context], other = place, other
                        marked.append(other[:4])
                    else:
                        marked.append(place[:4])
            if held > HELD:
                yield from flush()
                held = 0
        yield from flush()

    return run


RANGES = "did bigint, dh bigint, lo bigint, hi bigint"


def _sorted_group(length: int):
    """Ranges of repeated starts among a group's contexts, in portions that keep an anchor together."""

    def run(group: pa.Table) -> pa.Table:
        columns = {c: group.column(c).to_numpy() for c in ("anchor", "did", "dh", "lo", "hi")}
        given = group.column("context")
        none = given.is_null().to_numpy(zero_copy_only=False) if hasattr(given.is_null(), "to_numpy") else np.array(given.is_null().to_pylist())
        out = [tuple(columns[c][none] for c in ("did", "dh", "lo", "hi"))]
        rows = np.flatnonzero(~none)
        rows = rows[np.lexsort((columns["lo"][rows], columns["dh"][rows], columns["did"][rows], columns["anchor"][rows]))]
        place = [columns[c][rows] for c in ("anchor", "did", "dh", "lo")]
        rows = rows[np.concatenate(([True], np.any([x[1:] != x[:-1] for x in place], axis=0)))] if len(rows) else rows  # a row that occurs twice
        texts = given.take(pa.array(rows)).to_pylist()
        anchors = columns["anchor"][rows]
        cuts = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1]))).tolist() + [len(rows)] if len(rows) else [0]
        first, held = 0, 0
        for i in range(len(cuts) - 1):
            held += sum(len(t) for t in texts[cuts[i] : cuts[i + 1]])
            if held < SORTED and i + 2 < len(cuts):
                continue
            own = slice(first, cuts[i + 1])
            portion = rows[own]
            by = np.lexsort((columns["lo"][portion], columns["dh"][portion], columns["did"][portion]))
            part = texts[own]
            owner, start = repeated_starts([part[j] for j in by], length)
            if len(owner):
                begins = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1))))
                ends = np.append(begins[1:], len(owner)) - 1
                at = portion[by[owner[begins]]]
                out.append((columns["did"][at], columns["dh"][at], columns["lo"][at] + start[begins], columns["lo"][at] + start[ends]))
            first, held = cuts[i + 1], 0
        return pa.table([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["did", "dh", "lo", "hi"])

    return run


def _cut(length: int):
    """Bytes outside the marked ranges, and how many were removed in how many spans."""

    def run(batches):
        for batch in batches:
            kept, sizes, removed, spans = [], [], [], []
            for text, marks in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_buffer().to_pybytes()
                own, at, gone, n = [], 0, 0, 0
                ranges = marks.values if marks.is_valid else None
                if ranges is not None and len(ranges):
                    lo, hi = (ranges.field(k).to_numpy() for k in (0, 1))
                    by = np.argsort(lo, kind="stable")
                    lo, end = lo[by], np.maximum.accumulate(hi[by] + length)
                    begins = np.flatnonzero(np.concatenate(([True], lo[1:] > end[:-1])))
                    for a, b in zip(lo[begins].tolist(), end[np.append(begins[1:], len(lo)) - 1].tolist(), strict=True):
                        own.append(data[at:a])
                        gone, n, at = gone + b - a, n + 1, b
                own.append(data[at:])
                kept.append(b"".join(own)), sizes.append(len(data)), removed.append(gone), spans.append(n)
            longs = [pa.array(x, pa.int64()) for x in (sizes, removed, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _hot_anchors(docs: DataFrame, anchors) -> np.ndarray:
    """Anchors that occur more than HOT times, by a count over one document in SAMPLE, MOST_HOT at most; they only say how strings are dealt."""
    counts = docs.where(F.pmod(F.xxhash64("did", "dh"), F.lit(SAMPLE)) == 0).mapInArrow(anchors, "anchor bigint").groupBy("anchor").agg(F.count("*").alias("n"))
    found = counts.where(F.col("n") > HOT // SAMPLE).orderBy(F.col("n").desc(), "anchor").limit(MOST_HOT).select("anchor").collect()
    return np.sort(np.array([r["anchor"] for r in found], np.int64))


def suffix_dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = 4 << 20, max_filter_bytes: int = 32 << 20) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans and kept, the bytes that stay.

    A byte goes if a string of `length` bytes that covers it also starts
    earlier: in a document with a smaller integer id, or earlier in the same
    one.  Strings are those of the input; matches don't cross documents.  A null
    text is empty.  Null ids come last.  Rows that share an id follow in the
    order of a hash of their texts; rows that share id and text count as one
    document and each get its result.  Other columns are ignored; an empty
    table gives an empty result.

    The filter, max_filter_bytes at most, and MOST_HOT anchors are sent to all
    executors.  When anchors outgrow the filter (from 1.2 GB of text by
    default), more contexts shuffle and the result is the same.  A group has
    about group_bytes of contexts: strings around an anchor of more than HOT
    occurrences are dealt one by one, and equal ones of a task are reduced to
    the earliest first.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    own = docs.select(F.col(id_col).cast("long").alias("did"), F.xxhash64(text).alias("dh"), text.alias("t"))
    total = own.agg(F.sum(F.length("t"))).first()[0] or 0

    def anchors(batches):
        for _, _, texts in _portions(batches):
            found = sliced_runs(*_joined(texts), length)[0]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["anchor"])

    long_enough = own.where(F.length("t") >= length)
    per_anchor = (length - GRAM + 2) // 2
    again = repeats.repeated_filter(long_enough.mapInArrow(trimmed(anchors), "anchor bigint"), total // per_anchor, FILTER_BITS, FILTER_SET, max_filter_bytes)
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // group_bytes)
    shared = spark.sparkContext.broadcast(again.tobytes())
    often = spark.sparkContext.broadcast(_hot_anchors(long_enough, trimmed(anchors)))
    marks = long_enough.mapInArrow(trimmed(_marks(groups, length, shared, len(again), often)), "b int, anchor bigint, did bigint, dh bigint, lo bigint, hi bigint, context binary")
    ranges = marks.groupBy("b").applyInArrow(trimmed(_sorted_group(length)), RANGES)
    per_doc = ranges.groupBy(F.col("did").alias("did_"), F.col("dh").alias("dh_")).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    joined = own.join(per_doc, (F.coalesce("did", F.lit(int(LAST))) == F.col("did_")) & (F.col("dh") == F.col("dh_")), "left")
    return joined.select("did", "t", "ranges").mapInArrow(trimmed(_cut(length)), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
