"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which tokens share bytes.

Each token is an end event at the byte where it ends.  The union of both
tokenizers' events is dealt by document and sorted by offset inside partitions;
a state machine goes through it and closes a group wherever both end.  Events
travel in slices of SLICE bytes of text, one row a slice and tokenizer, and the
machine works on a slice at a time: its state is the open group and the
document's sums.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackloom.llm.memory import trimmed
from trackloom.llm.scratch import stored

#: Bytes of text whose events travel in one row.
SLICE = 1 << 14
#: Links that are listed at once; groups with more are counted by distinct ids.
LISTED = 1 << 16
#: Pairs of ids beyond which their counts join by a shuffle (a row takes about 40 bytes), and the share of rows that makes a pair hot.
BROADCAST_PAIRS, HOT_SHARE = 1 << 20, 1000


@functools.lru_cache(maxsize=2)
def byte_level(path: str):
    """(encode, bytes of each id, their lengths) of a byte-level BPE file; special tokens' strings are plain text."""
    from tokenizers import Tokenizer

    from trackloom.llm.packing import _byte_symbols, plain_encoder

    library, symbols = Tokenizer.from_file(path), _byte_symbols()
    size = library.get_vocab_size(with_added_tokens=True)
    words = [library.id_to_token(i) or "" for i in range(size)]
    spelled = [bytes(symbols[c] for c in w) if all(c in symbols for c in w) else w.encode() for w in words]
    return plain_encoder(path), spelled, np.array([len(w) for w in spelled], np.int64)


@functools.lru_cache(maxsize=2)
def pieces(path: str):
    """(encode, bytes of each id, their lengths) of a sentencepiece model with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]
    return lambda text: np.array(model.encode(text), np.uint32), spelled, np.array([len(w) for w in spelled], np.int64)


def tokens(text: str, a, b) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """(ids, end offsets) of both tokenizers for space + text, or None where the joined bytes of either differ from it."""
    if not text:
        return None
    try:
        whole = f" {text}".encode()
    except UnicodeEncodeError:
        return None
    found = []
    for (encode, spelled, sizes), given in ((a, f" {text}"), (b, text)):
        ids = encode(given)
        if b"".join(map(spelled.__getitem__, ids.tolist())) != whole:
            return None
        found.append((ids.astype(np.int64), np.cumsum(sizes[ids])))
    return found


def end_events(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, size: int) -> DataFrame:
    """row (a number for each input row), doc_id, slice, side and events: ids (4 bytes each), then how far each end lies after the one before or the slice's start (2 bytes each), deflated.

    A document without tokens has one row without events.
    """
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "slice", "side", "events"]

    def run(batches):
        a, b = byte_level(path_a), pieces(path_b)
        for batch in batches:
            at, cells, held = [], [], 0

            def made():
                cut, side, events = zip(*cells, strict=True)
                each = pa.array(at)
                rest = [pa.array(c, k) for c, k in ((cut, pa.int64()), (side, pa.int32()), (events, pa.binary()))]
                return pa.RecordBatch.from_arrays([batch.column(0).take(each), batch.column(1).take(each), *rest], names)  # noqa: B023

            for i, text in enumerate(batch.column(2)):
                found = tokens(text.as_py() or "", a, b)
                if found is None:
                    at.append(i), cells.append((0, 0, zlib.compress(b"")))
                for side, (ids, ends) in enumerate(found or ()):
                    cut = (ends - 1) // size
                    edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(ids)]
                    for x, y in zip(edges, edges[1:], strict=False):
                        steps = np.diff(ends[x:y], prepend=cut[x] * size).astype("<u2")
                        at.append(i), cells.append((int(cut[x]), side, zlib.compress(ids[x:y].astype("<u4").tobytes() + steps.tobytes(), 1)))
                    held += len(ids)
                if held >= 1 << 19:
                    yield made()
                    at, cells, held = [], [], 0
            if cells:
                yield made()

    return own.mapInArrow(trimmed(run), f"row bigint, doc_id {kind}, slice bigint, side int, events binary")


def linked(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (A id * 2^32 + B id) of groups with so many tokens, and how many links each has."""
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    big = na * nb > LISTED
    first_a, first_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    for g in np.flatnonzero(big):
        ua, ca = np.unique(a[first_a[g] : first_a[g] + na[g]], return_counts=True)
        ub, cb = np.unique(b[first_b[g] : first_b[g] + nb[g]], return_counts=True)
        keys.append((ua[:, None] << 32 | ub).ravel()), counts.append((ca[:, None] * cb).ravel())
    group_a = np.repeat(np.arange(len(na)), na)
    use = ~big[group_a]
    group_a, own = group_a[use], a[use]
    for x in range(0, len(own), LISTED):
        g, ids = group_a[x : x + LISTED], own[x : x + LISTED]
        n = nb[g]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        k, c = np.unique(np.repeat(ids, n) << 32 | b[np.repeat(first_b[g], n) + within], return_counts=True)
        keys.append(k), counts.append(c)
    return merged(keys, counts)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, of arrays of distinct keys in order, and the sums of their counts."""
    full = [k for k in range(len(keys)) if len(keys[k])]
    if len(full) < 2:
        return (keys[full[0]], counts[full[0]]) if full else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    key, count = np.concatenate([keys[k] for k in full]), np.concatenate([counts[k] for k in full])
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    return key[first], np.add.reduceat(count[order], first)


def _spelled_ids(most: int) -> list[str]:
    """Decimal ids followed by a comma, a bar or a semicolon, at 3 * id, + 1 and + 2; the list grows to the vocabulary's size."""
    for i in range(len(_IDS) // 3, most // 3 + 1):
        _IDS.extend((f"{i},", f"{i}|", f"{i};"))
    return _IDS


_IDS: list[str] = []


class Sweep:
    """The machine over one document's slices: groups closed so far, and the open group."""

    def __init__(self):
        self.n = [0, 0]
        self.open = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.groups, self.hash, self.keys, self.counts, self.held = 0, hashlib.sha256(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def slice(self, side: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """(ids, ends) of both tokenizers inside one slice."""
        ends, other = side[0][1], side[1][1]
        if len(ends) and len(other):
            # both are sorted: look up, and take an end of empty tokens once
            ends = ends[other[np.minimum(np.searchsorted(other, ends), len(other) - 1)] == ends]
            ends = ends[np.diff(ends, prepend=-1) > 0]
        else:
            ends = ends[:0]
        sizes, closed = [], []
        for s, (ids, at) in enumerate(side):
            self.n[s] += len(ids)
            ids = np.concatenate([self.open[s], ids])
            upto = len(self.open[s]) + np.searchsorted(at, ends, "right")
            cut = int(upto[-1]) if len(ends) else 0
            sizes.append(np.diff(upto, prepend=0)), closed.append(ids[:cut])
            self.open[s] = ids[cut:]
        if len(ends):
            self.close(*closed, *sizes)

    def close(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> None:
        # each id with what follows it, at its place in the text
        each = np.zeros(len(a) + len(b), np.int64)
        a_after, b_after = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_after[np.cumsum(na) - 1], b_after[np.cumsum(nb) - 1] = 1, 2
        each[np.arange(len(a)) + np.repeat(np.cumsum(nb) - nb, na)] = 3 * a + a_after
        each[np.arange(len(b)) + np.repeat(np.cumsum(na), nb)] = 3 * b + b_after
        text = "".join(map(_spelled_ids(int(each.max())).__getitem__, each.tolist()))
        self.hash.update(((";" if self.groups else "") + text[:-1]).encode())
        self.groups += len(na)
        keys, counts = linked(a, b, na, nb)
        self.keys.append(keys), self.counts.append(counts)
        self.held += len(keys)
        if self.held > 1 << 18:
            keys, counts = merged(self.keys, self.counts)
            self.keys, self.counts, self.held = [keys], [counts], 0

    def row(self) -> tuple:
        keys, counts = merged(self.keys, self.counts)
        return *self.n, self.groups, int(counts.sum()), self.hash.hexdigest() if sum(self.n) else "", keys, counts


def swept(events: DataFrame, size: int) -> DataFrame:
    """A row for each input row: n_a, n_b, n_groups, n_links, groups_sha256, and its distinct pairs with their numbers of links."""
    kind = events.schema["doc_id"].dataType.simpleString()
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"]
    ordered = events.repartition("row").sortWithinPartitions("row", "slice", "side")
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def run(batches):
        row, doc, cut, sweep, side = None, None, None, None, [empty, empty]
        rows, held = [], 0

        def made():
            each, docs, results = zip(*rows, strict=True)
            rest = [pa.array(c, k) for c, k in zip(zip(*results, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(each, pa.int64()), pa.concat_arrays(docs), *rest], names)

        for batch in batches:
            columns = [batch.column(c).to_pylist() if c in (0, 2, 3) else batch.column(c) for c in range(5)]
            for i in range(batch.num_rows):
                if columns[0][i] != row:
                    if sweep:
                        sweep.slice(side)
                        rows.append((row, doc, sweep.row()))
                        held += len(rows[-1][2][5]) + 64
                        if held > 1 << 18:
                            yield made()
                            rows, held = [], 0
                    row, doc, cut, sweep, side = columns[0][i], columns[1].slice(i, 1), columns[2][i], Sweep(), [empty, empty]
                elif columns[2][i] != cut:
                    sweep.slice(side)
                    cut, side = columns[2][i], [empty, empty]
                raw = zlib.decompress(columns[4][i].as_buffer())
                n = len(raw) // 6
                side[columns[3][i]] = (np.frombuffer(raw, "<u4", n).astype(np.int64), cut * size + np.cumsum(np.frombuffer(raw, "<u2", n, 4 * n), dtype=np.int64))
        if sweep:
            sweep.slice(side)
            rows.append((row, doc, sweep.row()))
            yield made()

    schema = f"row bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, links array<bigint>"
    return ordered.mapInArrow(trimmed(run), schema)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE) -> DataFrame:
    """One row for each input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    slice_bytes, below 65536, is how much text's events travel in one row.

    A null or empty text, or one whose joined tokens don't spell space + text,
    has zeros and ''.  Repeated rows and equal or null ids are documents of
    their own and count as such; other columns are ignored; an empty table
    gives no row.  A long text is a sweep of one task over its slices, whose
    state is the open group and the distinct pairs so far.  Counts of pairs
    join by broadcast up to BROADCAST_PAIRS of them; beyond, pairs that more
    than 1/HOT_SHARE of the rows hold are split off to a broadcast bounded by
    that share, the rest shuffle.
    """
    found = stored(swept(end_events(docs, path_a, path_b, id_col, text_col, slice_bytes), slice_bytes), "sweeps")
    counts = stored(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")), "pairs")
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("most"))
    judged = stored(counts.withColumn("a", F.shiftright("pair", 32)).join(best, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "judged")
    each = found.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
    if judged.count() <= BROADCAST_PAIRS:
        joined = each.join(F.broadcast(judged), "pair")
    else:
        bound = max(HOT_SHARE, counts.agg(F.sum("docs")).first()[0] // HOT_SHARE)
        hot, rest = F.broadcast(judged.where(F.col("docs") > bound)), judged.where(F.col("docs") <= bound)
        joined = each.join(hot, "pair").unionByName(each.join(hot.select("pair"), "pair", "left_anti").join(rest, "pair"))
    sums = joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("docs")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return found.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
