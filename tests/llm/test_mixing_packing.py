import functools
import hashlib
import math
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from trackloom.llm import mixing, packing
from trackloom.llm.queries import op2_source_mixing, op9_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def library():
    return Tokenizer.from_file(PATH)


def fluid(blocks, weights):
    """{source: its blocks' times of release and of end} by following the flow from one source's end to the next."""
    left, now, done = {k: Fraction(b) for k, b in blocks.items() if b}, Fraction(0), {k: Fraction(0) for k in blocks}
    times = {k: [Fraction(0)] for k in blocks}
    while left:
        rates = {k: Fraction(weights[k]) for k in left if weights[k]} or dict.fromkeys(left, Fraction(1))
        total = sum(rates.values())
        step = min(left[k] * total / rates[k] for k in rates)
        for k, r in rates.items():
            own = done[k] + step * r / total
            if len(times[k]) == 1 and not done[k]:
                times[k][0] = now
            times[k] += [now + (m - done[k]) * total / r for m in range(math.floor(done[k]) + 1, math.floor(own) + 1)]
            done[k] = own
            left[k] = blocks[k] - own
        now += step
        left = {k: v for k, v in left.items() if v}
    return times


def plain_schedule(blocks, weights):
    """Slot by slot the unscheduled, released block of the earliest deadline, looking at all of them."""
    times = fluid(blocks, weights)
    todo = {(n, j): (math.floor(times[k][j]), math.ceil(times[k][j + 1])) for n, k in enumerate(blocks) for j in range(blocks[k])}
    out = []
    for slot in range(len(todo)):
        n, j = min((b for b, (r, _) in todo.items() if r <= slot), key=lambda b: (todo[b][1], b))
        release, deadline = todo.pop((n, j))
        out.append((slot, release, deadline, n, j))
    return out


@given(st.lists(st.tuples(st.integers(0, 12), st.one_of(st.integers(0, 40), st.fractions(0, 3, max_denominator=50))), min_size=1, max_size=7))
@settings(max_examples=150, deadline=None)
def test_schedule_matches_a_plain_one_and_stays_within_a_block(given_):
    blocks = {n: b for n, (b, _) in enumerate(given_)}
    shares = {n: w for n, (_, w) in enumerate(given_)}
    got = mixing.schedule(blocks, mixing.whole_weights(shares))
    assert got == plain_schedule(blocks, shares)
    times = fluid(blocks, shares)
    seen = Counter()
    for t, (slot, release, deadline, n, j) in enumerate(got, 1):
        assert release <= slot < deadline
        seen[n] += 1
        for k, own in times.items():  # the fluid is at whole blocks, or between them and the next where that has begun
            whole = max(0, sum(x <= t for x in own) - 1)
            assert whole <= seen[k] <= whole + (own[whole] < t and whole < blocks[k])


def test_shares_are_not_rounded():
    """Every prefix of many blocks, against the shares as given, until the first source ends."""
    shares = {"a": 0.61234567, "b": 0.3875543, "c": 0.0001, "d": 20_000**0.7 / 1e9, "e": 1 / 3e6}
    blocks = {"a": 61_000, "b": 50_000, "c": 100, "d": 100, "e": 100}
    total, names, order = sum(shares.values()), list(shares), mixing.schedule(blocks, mixing.whole_weights(shares))
    assert [x[0] for x in order] == list(range(sum(blocks.values())))
    seen = Counter()
    for t, (_, _, _, n, _) in enumerate(order[:90_000], 1):
        seen[names[n]] += 1
        assert all(abs(seen[k] - t * v / total) < 1 + 1e-6 for k, v in shares.items())
    assert [n for _, _, _, n, _ in mixing.schedule({"a": 3, "b": 2}, {"a": 0, "b": 1})] == [1, 1, 0, 0, 0]
    with pytest.raises(ValueError):
        mixing.whole_weights({"a": -1.0, "b": 1.0})


def test_many_sources_get_their_shares():
    """Ten thousand sources of shares 1 / k ** 2: the largest is due 0.608 of the slots."""
    import time

    began = time.perf_counter()
    sizes = {f"h{k:05d}": 40 if k > 20 else 6000 for k in range(1, 10_001)}
    weights = mixing.whole_weights({h: 1 / k**2 for k, h in enumerate(sizes, 1)})
    plan = mixing._planned(sizes, weights, 64)
    slots = [s for s, slot in zip(plan["s"].to_pylist(), plan["slot"].to_pylist()) if slot < 90]
    assert len(slots) == 90 and abs(slots.count("sh00001") - 90 * 0.608) < 1.1 and time.perf_counter() - began < 60
    assert plan["first"].to_pylist()[-1] < sum(sizes.values())


def test_query_matches_a_plain_schedule(spark, small):
    """Row by row: MD5 order within a source, blocks of 64, the plain schedule."""
    rows = op2_source_mixing(spark, small).collect()
    ids = {}
    for r in rows:
        ids.setdefault(r.source, []).append(r.doc_id)
    ids = {s: sorted(own, key=lambda d: (hashlib.md5(str(d).encode()).hexdigest(), d)) for s, own in sorted(ids.items())}
    want, position = {}, 0
    for slot, release, deadline, n, j in plain_schedule({s: -(-len(x) // 64) for s, x in ids.items()}, {s: Fraction(len(x) ** 0.7) for s, x in ids.items()}):
        source = list(ids)[n]
        for k, d in enumerate(ids[source][64 * j : 64 * j + 64]):
            want[d] = (source, 64 * j + k, j, slot, release, deadline, position)
            position += 1
    assert {r.doc_id: (r.source, r.source_rank, r.block, r.slot, r.release, r.deadline, r.position) for r in rows} == want and len(rows) == len(want)


def test_fewer_larger_blocks_beyond_the_plan(spark):
    docs = spark.range(1000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS source")
    rows = mixing.mix_sources(docs, block_rows=1, max_blocks=20).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1000)) and 10 < len({(r.source, r.block) for r in rows}) <= 20
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, max_blocks=2)


def test_mixing_query_keeps_rows_and_shares(spark, small):
    rows = op2_source_mixing(spark, small).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(len(rows)))
    assert len({r.doc_id for r in rows}) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert all(r.release <= r.slot < r.deadline for r in rows)
    for s in {r.source for r in rows}:
        own = [r.source_rank for r in rows if r.source == s]
        assert own == list(range(len(own)))


def test_mixing_edge_rows(spark):
    schema = "doc_id long, source string, text string, position int, __extra string, __source string, __Key int, `a.b` int, m map<string,int>"
    rows = [(d, s, t, p, e, "q", 7, 1, {"x": 1}) for d, s, t, p, e in [(1, "a", "x", 9, "e"), (1, "a", "x", 9, "e"), (None, None, None, None, None), (3, None, "", 1, "e"), (2, "b", "y", 2, "f")]]
    docs = spark.createDataFrame(rows, schema)
    out = mixing.mix_sources(docs, {"a": 2.0, "b": 1.0}, block_rows=1)
    assert sorted(r.position for r in out.collect()) == [0, 1, 2, 3, 4]
    assert out.columns.count("position") == 1 and {(r["__source"], r["__Key"], r["a.b"]) for r in out.collect()} == {("q", 7, 1)}
    assert mixing.mix_sources(docs.limit(0)).count() == 0


@given(st.lists(st.integers(1, 300), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_plan_fills_every_sequence(lengths):
    size = 64
    pieces = packing.plan(np.array(lengths), size)
    for d, n in enumerate(lengths):
        own = sorted((s, k) for x, s, k, _, _ in pieces if x == d)
        assert own[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(own, own[1:])) and sum(own[-1]) == n
    total = Counter()
    for _, _, k, s, o in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert o == total[s]
        total[s] += k
    assert all(n <= size and n & (n - 1) == 0 for n in total.values())


def test_largest_go_to_the_cheapest():
    pieces = packing.plan(np.array([40, 40, 30, 10, 8]), 64)
    home = {d: s for d, _, _, s, _ in pieces}
    assert home[0] != home[1]


def test_fast_encoder_equals_the_library(spark, small):
    """The library as the contract calls it: no setting is changed."""
    slow = library()
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    end = "<|endoftext|>"
    texts += ["", " ", "\n\n a  b\t", f"{end} x", f"ab {end} cd", f"{end}{end}", f"a  {end}  b <|endoftext", end[:-1] + end, "naïve 😀 ‍ \u0000 ſ K", "'s're ''ll", "１２３ ½ a_b", "a\x1c\x1db\x85c\u3000\u3000d"]
    fast = packing.encoder(PATH)
    for t in texts:
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids, t[:50]


@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\x85", "\xa0", "a", "é", "7", "!", "'s", "<|endoftext|>", "<|", "\x1f"]), max_size=14).map("".join))
@settings(max_examples=200, deadline=None)
def test_cut_gaps_give_the_same_ids(text):
    gap, fast = packing.LONG_GAP, packing.encoder(PATH)
    packing.LONG_GAP = packing.re.compile(gap.pattern.replace("10000", "2"))
    try:
        assert fast(text).tolist() == library().encode(text, add_special_tokens=False).ids
    finally:
        packing.LONG_GAP = gap


@pytest.mark.parametrize("run", [" ", " \t", "a", "!"])
def test_long_runs_give_the_library_s_ids(run):
    text = "x " + run * (1_100_000 // len(run)) + "y"
    for t in (text, text[:-1]):
        assert packing.encoder(PATH)(t).tolist() == library().encode(t, add_special_tokens=False).ids


def test_packing_query_round_trip(spark, small):
    slow = library()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    pieces = op9_packing(spark, small).collect()
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    assert by_doc.keys() == docs.keys()
    for d, own in by_doc.items():
        ids = np.array([*slow.encode(docs[d], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    fill = Counter()
    for p in pieces:
        fill[p.sequence_id] += p.length
    assert max(fill.values()) <= 2048 and all(n & (n - 1) == 0 for n in fill.values())


def test_packing_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "e"), (None, "a b", "e"), (1, "", "e")], "doc_id long, text string, ids string")
    rows = packing.pack(docs, PATH).collect()
    assert sum(r.length for r in rows) == 5 and {r.doc_tokens for r in rows} == {1, 3}
    assert packing.pack(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, size=100)
