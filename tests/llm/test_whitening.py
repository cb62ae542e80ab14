import math

import numpy as np
import pytest

from trackloom.llm import whitening
from trackloom.llm.queries import op11_embedding_whitening

SCHEMA = "vec_id bigint, embedding array<double>"


def plain(rows, k=8):
    """{id: [(deviation, whitened, explained)]} by loops over whole integers and one eigen decomposition."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    y = np.array([[(n * r[j] - s[j]) / n for j in range(d)] for r in x])
    e, w = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-e)[:k]
    z = y @ w[:, order] / np.sqrt(e[order])
    return {i: [(sum((n * r[j] - s[j]) ** 2 for j in range(d)), float(a), float(e[o] / e.sum())) for a, o in zip(zr, order, strict=True)] for (i, _), r, zr in zip(kept, x, z, strict=True)}


def compare(got, expected):
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, c + 1) for i, rows in expected.items() for c in range(len(rows)))
    signs = {}
    for r in got:
        deviation, whitened, explained = expected[r.vec_id][r.component - 1]
        assert r.n == len(expected) and r.deviation == deviation
        assert r.explained == pytest.approx(explained, rel=1e-9) and r.identity_error < 1e-9
        if abs(whitened) > 1e-3:
            signs.setdefault(r.component, set()).add(math.copysign(1, whitened * r.whitened))
        assert abs(r.whitened) == pytest.approx(abs(whitened), rel=1e-6, abs=1e-7)
    assert all(len(s) == 1 for s in signs.values())


def test_the_query_equals_a_plain_version(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    compare(op11_embedding_whitening(spark, small).collect(), plain(rows))


def test_bad_vectors_extra_columns_and_many_partitions(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(c) for c in r.normal(size=5) * (1, 2, 3, 4, 5)]) for i in range(300)]
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0]), (902, [1.0, math.nan, 1.0, 1.0, 1.0]), (903, [math.inf, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows + bad, SCHEMA).selectExpr("*", "1 AS component", "'x' AS whitened").repartition(7)
    got = whitening.whiten(df)
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(got.collect(), plain(rows))


def test_nothing_varies_or_nothing_is_there(spark):
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], SCHEMA)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 2, 0, None, None, None), (2, 2, 0, None, None, None)] * 2
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [])], SCHEMA)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], SCHEMA)).collect()
    assert all((r.whitened is None) == (r.component > 1) and r.identity_error < 1e-9 for r in flat)


def test_vectors_of_two_lengths_are_an_error(spark):
    with pytest.raises(Exception, match="differ in length"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA).coalesce(1)).collect()


def test_deviations_at_the_edge_of_a_long():
    for top in (3_000_000_000, 3_037_000_499, 3_037_000_500, 2**40):
        x = np.array([[top], [-top]])
        assert whitening.deviations(x, 1, [0]) == [top * top if top * top < 2**63 else None] * 2
    assert whitening.deviations(np.array([[7, 9], [8, 8]]), 2, [15, 17]) == [2, 2]
    assert whitening.exact_sum(np.full((3, 1), 2**62)) == [3 * 2**62] and whitening.exact_sum(np.full((3, 1), -(2**62))) == [-3 * 2**62]
