import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from trackloom.llm import packing
from trackloom.llm.mixing import mix_sources
from trackloom.llm.queries import op2_source_mixing, op8_quality_classifier


def grams(text, n=5):
    w = (text or "").split()
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, min(len(w), 1)))}


def plain_lines(docs):
    """{id: text} without lines of ten sites or more, but in the first document that has them."""
    sites, first = defaultdict(set), {}
    for d, (text, source) in sorted(docs.items()):
        for line in text.split("\n"):
            if line.strip():
                sites[line].add(source)
                first.setdefault(line, d)
    return {d: "\n".join(x for x in text.split("\n") if len(sites.get(x, ())) < 10 or first[x] == d) for d, (text, _) in docs.items()}


def plain_representatives(docs):
    sets = {d: grams(t) for d, t in docs.items()}
    up = {d: d for d in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {root(d) for d in ids}


def test_stages_match_plain_versions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    good = {r.doc_id for r in op8_quality_classifier(spark, small).collect() if r.predicted}
    docs = cp.STAGES[0][1](spark, docs, small)
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == good
    want = plain_lines({r.doc_id: (r.text, r.source) for r in docs.collect()})
    docs = cp.STAGES[1][1](spark, docs, small).cache()
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == want
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    docs = cp.STAGES[2][1](spark, docs, small).cache()
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == plain_representatives(want)
    before = {tuple(r) for r in docs.collect()}
    docs = cp.STAGES[3][1](spark, docs, small)
    assert docs.columns == columns and {tuple(r) for r in docs.collect()} == before
    texts = {r.doc_id: r.text for r in docs.collect()}
    slow = Tokenizer.from_file(cp.TOKENIZER)
    got = defaultdict(list)
    for p in cp.STAGES[4][1](spark, docs, small).collect():
        got[p.doc_id].append(p)
    assert got.keys() == texts.keys()
    for d, own in got.items():
        ids = np.array([*slow.encode(texts[d], add_special_tokens=False).ids, 1], "<u4")
        assert sum(p.length for p in own) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own)


def test_packing_follows_the_mixing_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 2000)
    rows = [(i, f"document {i} " + "some words " * 8, "en", "a" if i % 10 else "b", 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema)
    position = {r.doc_id: r.position for r in mix_sources(docs).collect()}
    assert [position[r.doc_id] for r in cp.mixed(spark, docs, "").collect()] == list(range(3000))
    docs.repartitionByRange(7, F.col("doc_id").desc()).write.parquet(f"{tmp_path}/docs")
    pieces = sorted((p.sequence_id, p.offset, p.doc_id) for p in cp.packed(spark, spark.read.parquet(f"{tmp_path}/docs"), "").collect())
    order = list(dict.fromkeys(d for _, _, d in pieces))
    assert len(order) == 3000 and max(abs(i - position[d]) for i, d in enumerate(order)) <= 150
    share = 300**0.7 / (300**0.7 + 2700**0.7)
    seen = 0
    for t, d in enumerate(order[:1400], 1):
        seen += d % 10 == 0
        assert abs(seen - t * share) < 64 + 150


def test_stages_keep_columns_of_clashing_names(spark, small):
    """One further column for every result and temporary name, null ids, nulls, empty, long and repeated rows."""
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    extra = ["Score", "held_out", "predicted", "n_lines", "N_removed", "position", "slot", "Block", "source_rank", "release", "deadline", "__did", "__th", "__id", "__bad", "__owner", "__new", "__source", "__key", "__range", "__in", "__n", "__before", "id", "t", "h1", "k", "rid", "class_key", "fam", "key", "a.b"]
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "a", 0), (90_001, long, "en", "a", 1), (90_001, long, "en", "a", 1), (90_002, None, None, None, 7)], docs.schema)
    wide = docs.unionByName(odd).select("*", *(F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(-1))).alias(c) for c in extra))
    before = {r.doc_id: r for r in wide.collect()}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, wide, small)
        assert out.columns == wide.columns, name
        for r in out.collect():
            assert [r[c] for c in extra] == [f"{c}{-1 if r.doc_id is None else r.doc_id}" for c in extra], name
            if name != "line_dedup" and r.doc_id is not None:
                assert r == before[r.doc_id], name
    pieces = cp.STAGES[-1][1](spark, wide, small).collect()
    assert {p.doc_id for p in pieces} == set(before) and sum(p.start == 0 for p in pieces) == wide.count()


def test_tables_of_finished_stages_are_dropped(spark, small):
    import os

    from trackloom.llm import scratch

    scratch.clear(spark)
    rows = cp.run(spark, small)
    left = os.listdir(scratch._own_folder(spark).removeprefix("file:").replace("//", "/"))
    assert len(left) == 1 and rows.count() > 0


def test_run_and_edge_rows(spark, small, tmp_path):
    assert cp.run(spark, small).count() > 0
    schema = spark.read.parquet(f"{small}/documents.parquet").schema
    rows = [(1, None, None, None, None), (None, None, "en", "a", 3), (1, "x y z", "en", "a", 5), (1, "x y z", "en", "a", 5), (None, "", "en", None, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/few/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/few/labels.parquet"), labels.limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
    assert {r.doc_id for r in cp.run(spark, f"{tmp_path}/few").collect()} <= {1, None}
