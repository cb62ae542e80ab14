import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from trackloom.llm import classifier, repeats
from trackloom.llm.classifier import quality_classifier
from trackloom.llm.exact_dedup import exact_dedup
from trackloom.llm.line_dedup import boilerplate_lines, line_dedup
from trackloom.llm.quality_rules import quality_rules, text_metrics
from trackloom.llm.queries import op8_quality_classifier


@given(st.lists(st.integers(0, 2**63 - 1), max_size=300), st.lists(st.integers(0, 2**63 - 1), max_size=50))
@settings(max_examples=40, deadline=None)
def test_filter_has_no_false_negatives(hashes, more):
    seen, again = np.zeros(repeats.CHUNK, np.uint8), np.zeros(repeats.CHUNK, np.uint8)
    twice = np.array(hashes + more + more, np.uint64)
    for part in np.array_split(twice, 4):
        repeats.add(seen, again, part, 4)
    found = repeats._get(again, repeats.positions(np.array(more, np.uint64), len(again) * 8, 4)).all(axis=1)
    assert found.all()


def test_exact_dedup_edges_and_full_filter(spark):
    rows = [(1, "a"), (2, "a"), (2, "a"), (None, "a"), (3, None), (4, ""), (5, "b"), (None, "c"), (None, "c")] + [(n, f"t{n % 1500}") for n in range(10, 3010)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n int, digest int").repartition(6)
    for cap in (repeats.CHUNK, 32 << 20):
        out = exact_dedup(docs, bits_per_row=1 if cap == repeats.CHUNK else 16, max_filter_bytes=cap).collect()
        assert len(out) == len(rows)
        own = [r for r in out if r.text_sha256 == hashlib.sha256(b"a").hexdigest()]
        assert {r.keep_id for r in own} == {2} and {r.group_size for r in own} == {4} and [r.doc_id for r in own if r.kept] == [2]
        empty = [r for r in out if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
        assert sorted((r.doc_id, r.keep_id, r.kept) for r in empty) == [(3, 4, False), (4, 4, True)]
        assert sorted((r.keep_id, r.kept) for r in out if r.text_sha256 == hashlib.sha256(b"c").hexdigest()) == [(None, False), (None, True)]
        assert sum(r.kept for r in out) == 4 + 1500
    assert exact_dedup(docs.limit(0)).count() == 0


def test_filters_for_ranges_pass_the_same_share(spark):
    """With room for a tenth of the hashes the unique rows still pass: ten filters, not a full one."""
    hashed = spark.range(400_000).selectExpr("xxhash64(IF(id < 4000, id % 1000, id)) AS h")
    share = lambda cap: exact_dedup_flagged(hashed, cap).where("maybe").count()
    from trackloom.llm.exact_dedup import _flagged

    exact_dedup_flagged = lambda df, cap: _flagged(df, 400_000, 16, cap)
    whole, ranges = share(32 << 20), share(1 << 17)
    assert 4000 <= whole < 8000 and 4000 <= ranges < 8000


def test_line_dedup_near_threshold_and_edges(spark):
    rows = [(d, f"s{d % 12}", f"own line {d}\nwide\n{'nine' if d % 12 < 9 else 'x' + str(d)}\n{'ten' if d % 12 < 10 else 'y' + str(d)}\n\n \t") for d in range(36)]
    rows += [(100, "s1", None), (101, None, "wide\nwide"), (None, "s2", "wide\nlast"), (None, "s2", "wide\nlast")]
    docs = spark.createDataFrame([(*r, "n", 5, 6, 7) for r in rows], "doc_id long, source string, text string, N_lines string, __id int, __bad int, __n int")
    assert boilerplate_lines(docs).count() == 2
    assert line_dedup(docs).columns == ["doc_id", "source", "text", "__id", "__bad", "__n", "n_lines", "n_removed"]
    out = line_dedup(docs).collect()
    assert {(r["__id"], r["__bad"], r["__n"]) for r in out} == {(5, 6, 7)}
    assert len(out) == len(rows) and docs.columns[:3] == ["doc_id", "source", "text"]
    by_id = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by_id[0].text == rows[0][2] and by_id[0].n_removed == 0 and by_id[0].n_lines == 4
    assert by_id[1].text == "own line 1\nnine\n\n \t" and by_id[1].n_removed == 2
    assert by_id[100].text is None and by_id[100].n_lines == 0
    assert by_id[101].text == "" and by_id[101].n_removed == 2
    assert [r.text for r in out if r.doc_id is None] == ["last", "last"]
    assert line_dedup(docs.limit(0)).count() == 0


def test_a_very_long_document_of_boilerplate(spark):
    wide = [f"shared line é {i} " + "x" * (i % 90) for i in range(20_000)]
    rows = [(d, f"s{d}", "\n".join(wide)) for d in range(10)] + [(20, "s1", "\n".join([*wide, "own", *wide]))]
    out = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)).collect()}
    assert out[0].n_removed == 0 and out[0].text == rows[0][2]
    assert all(out[d].n_removed == 20_000 and out[d].text == "" for d in range(1, 10))
    assert out[20].text == "own" and (out[20].n_removed, out[20].n_lines) == (40_000, 40_001)


def plain_metrics(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_metrics_and_hosts(spark):
    import random

    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "b", "é😀", "#x"]) for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    texts += [None, "", "\n\n", "a b \x0b c", "one two\none two\n\none two", "w " * 500]
    docs = spark.createDataFrame([(i, t, "h", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words int")
    for r in text_metrics(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_metrics(texts[r.doc_id])
    good, bad = " ".join(f"word{i}" for i in range(40)), "too short"
    rows = [(i, good if i % 10 else bad, "fine") for i in range(400)] + [(1000 + i, bad if i % 10 else good, "poor") for i in range(400)] + [(2000, bad, "tiny"), (2001, good, "tiny2"), (None, good, None), (None, None, None)]
    out = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == len(rows)
    kept = {(r.host, r.failed): r.kept for r in out}
    assert kept["fine", False] and not kept["fine", True] and not kept["poor", False] and kept["tiny2", False]
    rate = {r.host: r.host_rate for r in out}
    assert rate["fine"] < 0.12 < 0.88 < rate["poor"] and 0.2 < rate["tiny"] < 1
    assert quality_rules(docs.limit(0)).count() == 0


M64 = (1 << 64) - 1


def plain_features(text, buckets):
    """{bucket: times} of a text, word by word and byte by byte, without numpy."""
    p, found = 0x100000001B3, {}

    def mixed(h, seed):
        h = (h + seed) * 0x9E3779B97F4A7C15 & M64
        return (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & M64

    def add(h, seed):
        at = (mixed(h, seed) >> 32) * (buckets - 1) >> 32
        found[at] = found.get(at, 0) + 1

    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", text.encode()) if w]
    if words:
        line = b" " + b" ".join(words) + b" "
        for n in (3, 4, 5):
            for i in range(len(line) - n + 1):
                if b" " not in line[i + 1 : i + n - 1]:
                    h = 0
                    for c in line[i : i + n]:
                        h = (h * p + c) & M64
                    add(h, n)
    for i, w in enumerate(words):
        add(sum(c * pow(p, k, 1 << 64) for k, c in enumerate(w)) & M64, 1)
        for d in (1, 2, 3, 4):
            if i >= d and words[i - d] == w:
                add(d, 2)
    found[buckets - 1] = 1
    return found


@given(st.lists(st.sampled_from(["a", "b", "uno", "é", "due", " ", "\n", "\t ", "abcdefg"]), max_size=25).map(" ".join))
@settings(max_examples=80, deadline=None)
def test_features_match_a_plain_count(text):
    ids, counts = classifier.bag(text, 1 << 10)
    assert dict(zip(ids.tolist(), counts.tolist())) == plain_features(text, 1 << 10)
    again = classifier.unpacked(classifier.packed((ids, counts)))
    assert again[0].tolist() == ids.tolist() and again[1].tolist() == counts.tolist()


def test_one_step_and_the_score_match_plain_arithmetic():
    buckets, dim, rate = 64, 3, 0.5
    rng = np.random.default_rng(3)
    vectors, output, bias = rng.normal(size=(buckets, dim)), rng.normal(size=(2, dim)), rng.normal(size=2)
    v, o, b = vectors.tolist(), output.tolist(), bias.tolist()
    text = "uno due due tre"
    own = plain_features(text, buckets)
    total = sum(own.values())
    hidden = [sum(n / total * v[k][x] for k, n in own.items()) for x in range(dim)]
    logits = [sum(o[c][x] * hidden[x] for x in range(dim)) + b[c] for c in (0, 1)]
    p = [math.exp(z) / sum(map(math.exp, logits)) for z in logits]
    logit = logits[1] - logits[0]
    model = classifier.Model(vectors @ (output[1] - output[0]), bias[1] - bias[0])
    assert abs(model.score(text) - 1 / (1 + math.exp(-logit))) < 1e-9 and abs(p[1] - model.score(text)) < 1e-9
    error = [p[0], p[1] - 1]
    back = [sum(error[c] * o[c][x] for c in (0, 1)) for x in range(dim)]
    ids, counts = classifier.bag(text, buckets)
    classifier.descend(vectors, output, bias, ids, counts / counts.sum(), 1, rate)
    for c in (0, 1):
        assert abs(bias[c] - (b[c] - rate * error[c])) < 1e-9
        assert all(abs(output[c, x] - (o[c][x] - rate * error[c] * hidden[x])) < 1e-9 for x in range(dim))
    for k in range(buckets):
        move = rate * min(len(own), 64) * own.get(k, 0) / total
        assert all(abs(vectors[k, x] - (v[k][x] - move * back[x])) < 1e-9 for x in range(dim))


def test_words_hash_alike_anywhere(monkeypatch):
    a, b = (classifier.features(t, 1 << 17) for t in ("uno due tre", "due tre uno"))
    assert sorted(a) == sorted(b) and a[-1] == (1 << 17) - 1 not in a[:-1]
    long = " ".join(f"w{i % 50 // (1 + i % 3)}" for i in range(3000))
    whole = classifier.features(long, 1 << 17)
    monkeypatch.setattr(classifier, "SLICE", 1000)
    assert sorted(classifier.features(long, 1 << 17)) == sorted(whole)


@pytest.mark.parametrize("labels", [[], [1, 1]])
def test_classifier_without_two_classes(labels):
    model = classifier.train([classifier.packed(classifier.bag("a b", 1 << 10))] * len(labels), labels, buckets=1 << 10)
    assert 0 < model.score("x") < 1 and model.score(None) == model.score("")


def test_training_bags_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"word{i} other") for i in range(50)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality")
    every, ys = classifier.training_bags(docs, labels, 1000, 10**6)
    assert len(every) == len(ys) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(50))
    few, _ = classifier.training_bags(docs, labels, 1000, 200)
    assert 1 <= len(few) < len(every) and sum(len(classifier.unpacked(b)[0]) for b in few) <= 200
    assert len(classifier.training_bags(docs, labels, 7, 10**6)[0]) == 7


def test_classifier_held_out_accuracy(spark):
    root = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{root}/labels.parquet").collect()}
    rows = op8_quality_classifier(spark, root).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.97
    pos, neg = ([r.score for r in held if truth[r.doc_id] == y] for y in (1, 0))
    assert np.mean([p > n for p in pos for n in neg]) >= 0.98


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, 5.0, "x"), (None, "a", 5.0, "x"), (1, "", 5.0, "x")], "doc_id long, text string, Score double, bag string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    out = quality_classifier(docs, labels)
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "bag", "score", "held_out", "predicted"] and len(rows) == 3 and all(0 <= r.score <= 1 for r in rows) and not any(r.held_out for r in rows if r.doc_id is None)
    assert quality_classifier(docs.limit(0), labels.limit(0)).count() == 0


def test_scratch_tables_are_cleared(spark):
    from trackloom.llm import scratch

    df = scratch.stored(spark.range(3), "numbers")
    assert df.count() == 3
    scratch.clear(spark)
    with pytest.raises(Exception):
        scratch.stored(spark.range(1), "x") and df.count()
