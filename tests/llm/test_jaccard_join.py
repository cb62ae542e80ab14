import random

import numpy as np
from hypothesis import given, settings, strategies as st

from trackloom.llm import jaccard_join as jj


def grams(text, n=5):
    w = (text or "").split()
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, min(len(w), 1)))}


def brute(rows):
    """{(id, text): (class, links)} over rows (id, text) of different ids."""
    sets = {d: grams(t) for d, t in rows}
    near = {d: {e for e in sets if e != d and (sets[d] == sets[e] or sets[d] and sets[e] and 10 * len(sets[d] & sets[e]) >= 8 * len(sets[d] | sets[e]))} for d in sets}
    out = {}
    for d in sets:
        seen, todo = {d}, [d]
        while todo:
            for e in near[todo.pop()] - seen:
                seen.add(e), todo.append(e)
        out[d] = (min(seen), len(near[d]))
    return out


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = "".join(rng.choices("abcdef", k=6))
    return " ".join(words)


def test_join_matches_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows, d = [], 0
    for family in range(12):
        base = [word() for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 6, 25])):
            rows.append((d := d + 1, edited(base, rng, rng.choice([0, 0, 1, 2, 4, 8]))))
    shared = " ".join(word() for _ in range(60))
    rows += [(d := d + 1, " ".join(word() for _ in range(120)) + " " + shared) for _ in range(30)]
    rows += [(d := d + 1, t) for t in ["", None, " \n", "a b c", "a b  c", "a b", "é ü a b c", "é ü a b c d"]]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, rid int").repartition(5)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jj.jaccard_join(docs).collect()}
    assert got == brute(rows)
    kept = {r.doc_id for r in jj.one_of_each(docs).collect()}
    assert kept == {c for c, _ in brute(rows).values()}


def test_blocks_give_the_same_links(spark, monkeypatch):
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(150)]
    rows = [(d, edited(base, rng, rng.choice([0, 1, 2, 3]))) for d in range(150)]
    monkeypatch.setattr(jj, "BUCKET_BLOCK", 20)
    monkeypatch.setattr(jj, "FAMILY_BLOCK", 30)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in jj.jaccard_join(docs).collect()} == brute(rows)


@given(st.lists(st.sampled_from(["a", "bb", "é", " ", "\n", "  ", "word", "x" * 30]), max_size=60).map("".join), st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_slices_give_the_same_sets(text, size):
    whole = jj.gram_sets([text.encode()])[0]
    before, jj.SLICE = jj.SLICE, size
    try:
        assert jj.gram_sets([text.encode(), b"y z"])[0].tolist() == whole.tolist()
    finally:
        jj.SLICE = before


def test_very_long_texts_and_a_full_filter(spark):
    long = [f"w{i % 90_001}" for i in range(300_000)]
    rows = [(1, " ".join(long)), (2, " ".join(["other", *long])), (3, "x" * 3_000_000), (4, "x" * 3_000_000 + " y"), (5, "a b c d e f g h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0), 5: (5, 0)}
    for cap in (64 << 20, 0):
        assert {r.doc_id: (r.class_id, r.n_links) for r in jj.jaccard_join(docs, max_filter_bytes=cap).collect()} == want


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, "c d"), (2, None)], "doc_id long, text string")
    got = sorted((r.class_id is None, r.class_id or 0, r.n_links) for r in jj.jaccard_join(docs).collect())
    assert got == [(False, 1, 2), (False, 1, 2), (False, 1, 2), (False, 2, 0), (True, 0, 0)]
    assert jj.jaccard_join(docs.limit(0)).count() == 0
    assert sorted((r.doc_id or 0, r.text or "") for r in jj.one_of_each(docs).collect()) == [(0, "c d"), (1, "a b"), (2, "")]


def test_one_of_each_keeps_classes_that_share_an_id(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "c d"), (None, "e f"), (None, "e  f"), (7, "c d e"), (7, "e f g"), (7, "e f g"), (None, long), (None, long + " x"), (7, long.replace("w", "v")), (7, long.replace("w", "v") + " x")]
    kept = jj.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    words = sorted((r.doc_id or 0, r.text.split()[:3]) for r in kept)
    assert words == [(0, ["c", "d"]), (0, ["e", "f"]), (0, ["w0", "w1", "w2"]), (7, ["c", "d", "e"]), (7, ["e", "f", "g"]), (7, ["v0", "v1", "v2"])]


@given(st.integers(0, 10**6))
@settings(max_examples=50, deadline=None)
def test_pruning_keeps_what_the_posterior_allows(seed):
    rng = np.random.default_rng(seed)
    least = jj.least_matches(0.8, 1e-6)
    left = rng.integers(0, 2, (3, jj.VALUES)).astype(np.uint32)
    right = np.where(rng.random((4, jj.VALUES)) < 0.8, left[:1], 9).astype(np.uint32)
    i, j = jj.plausible(left, right, least)
    want = [(a, b) for a in range(3) for b in range(4) if all((left[a, :n] == right[b, :n]).sum() >= m for n, m in zip(range(16, 113, 16), least))]
    assert sorted(zip(i.tolist(), j.tolist())) == want


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 1000).astype(np.uint64)
    a, b = np.unique(pool[:900]), np.unique(pool[100:])
    s = jj.signatures([a, b, pool[:0]])
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.12 and (s[2] == 0xFFFFFFFF).all()
