import hashlib
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from trackloom.llm import suffix_dedup as sd
from trackloom.llm.queries import op7_suffix_dedup


def brute(docs, length):
    """{id: (bytes, removed, spans, kept)} for documents in the order of their ids."""
    seen, out = set(), {}
    for d, t in sorted(docs.items()):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        spans = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
        out[d] = (len(t), int(gone.sum()), spans, bytes(b for b, g in zip(t, gone) if not g))
    return out


@given(st.lists(st.binary(min_size=12, max_size=60).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6))
@settings(max_examples=80, deadline=None)
def test_suffix_order_is_sorted(parts):
    text = np.frombuffer(b"\0".join(parts) + b"\0" * 40, np.uint8)
    wanted = np.zeros(len(text), bool)
    wanted[: len(text) - 40] = np.arange(len(text) - 40) % 5 != 4
    order = sd.suffix_order(text, wanted, 16)
    assert sorted(order) == np.flatnonzero(wanted).tolist()
    keys = [text[i : i + 16].tobytes() for i in order]
    assert keys == sorted(keys)


@given(st.integers(0, 10**6))
@settings(max_examples=40, deadline=None)
def test_repeated_starts_match_brute_force(seed):
    rng = random.Random(seed)
    pool = bytes(rng.choice(b"ab\0c") for _ in range(200))
    parts = [pool[(i := rng.randrange(140)) : i + rng.randrange(40, 61)] for _ in range(8)]
    owner, start = sd.repeated_starts(parts, 40)
    seen, want = set(), []
    for k, p in enumerate(parts):
        for i in range(len(p) - 39):
            if p[i : i + 40] in seen:
                want.append((k, i))
            seen.add(p[i : i + 40])
    assert list(zip(owner.tolist(), start.tolist())) == want


def test_query_matches_brute_force(spark, small):
    docs = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    want = {d: (n, r, s, hashlib.sha256(k).hexdigest()) for d, (n, r, s, k) in brute(docs, 100).items()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op7_suffix_dedup(spark, small).collect()}
    assert got == want
    assert sum(r for _, r, _, _ in want.values()) > 1000


def test_overlaps_periods_and_edges(spark):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    a, b = noise(400), noise(300)
    texts = {5: a, 3: b + a[50:250] + noise(80), 9: a[20:180] + b[:150] + a[20:180], 1: "xy" * 300, 2: "xy" * 120 + noise(10), 7: noise(99), 8: "", 11: a[:130] + "\0" * 250, 12: "\0" * 140}
    rows = [(d, t, 1) for d, t in texts.items()] + [(10, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, did int")
    want = brute({d: (t or "").encode() for d, t, _ in rows}, 100)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.suffix_dedup(docs).collect()}
    assert got == want
    assert sd.suffix_dedup(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, a), (1, a), (None, a), (None, a)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_removed) for r in sd.suffix_dedup(twice).collect()) == [(False, 0)] * 2 + [(True, len(a.encode()))] * 2


@given(st.integers(0, 10**6))
@settings(max_examples=40, deadline=None)
def test_slices_have_the_same_strings(seed):
    """Every start of a long enough string lies in one run, with the anchor that it has in the whole."""
    rng = random.Random(seed)
    docs = [bytes(rng.choice(b"ab c") for _ in range(rng.randrange(0, 260))) for _ in range(4)]
    data, starts = sd._joined(docs)
    spread = lambda a, d, lo, hi: sorted((x, int(h), k) for h, k, i, j in zip(a, d.tolist(), lo.tolist(), hi.tolist()) for x in range(i, j + 1))
    whole = spread(*sd.runs(data, starts, 50))
    before, sd.SLICE = sd.SLICE, 70
    try:
        assert spread(*sd.sliced_runs(data, starts, 50)) == whole
    finally:
        sd.SLICE = before


def test_a_hot_anchor_is_split_and_long_texts_are_cut(spark, monkeypatch):
    """One 40-byte piece between different neighbours: no group gets all its strings, and the result is that of brute force."""
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    piece, common = noise(40), noise(130)
    texts = {i: noise(70) + piece + noise(70) + (common if i % 50 == 0 else "") for i in range(1500)}
    texts[2000] = noise(3000) + common + noise(2000) + texts[7]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want = brute({d: t.encode() for d, t in texts.items()}, 100)
    monkeypatch.setattr(sd, "HOT", 640)
    monkeypatch.setattr(sd, "SLICE", 5000)
    own = docs.selectExpr("doc_id AS did", "xxhash64(text) AS dh", "CAST(text AS BINARY) AS t")

    def anchors(batches):
        import pyarrow as pa

        for _, _, parts in sd._portions(batches):
            yield pa.RecordBatch.from_arrays([pa.array(sd.sliced_runs(*sd._joined(parts), 100)[0].view(np.int64))], ["anchor"])

    assert len(sd._hot_anchors(own, anchors)) >= 1
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.suffix_dedup(docs).collect()}
    assert got == want
    data, starts = sd._joined([t.encode() for t in texts.values()])
    a, d, lo, hi = sd.runs(data, starts, 100)
    hot = a == np.unique(a)[np.unique(a, return_counts=True)[1].argmax()]
    assert hot.sum() >= 500
    b, _, x, y = sd._string_by_string(data, a, d, lo, hi, hot, 100)
    groups = np.bincount((b % np.uint64(64)).astype(int), weights=y - x + 100)
    assert groups.max() < 3 * np.median(groups) and (y - x + 1).sum() == (hi - lo + 1).sum()
