import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from trackloom.llm import alignment
from trackloom.llm.packing import _byte_symbols
from trackloom.llm.queries import op13_tokenizer_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(docs):
    """[(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha)] by loops over tokens."""
    a, b, symbols = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), _byte_symbols()
    a.encode_special_tokens = True

    def spelled(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    found, holders = [], Counter()
    for doc, text in docs:
        groups = []
        if text:
            whole = (" " + text).encode()
            ta = [(i, bytes(symbols[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            tb = [(i, spelled(i)) for i in b.encode(text)]
            if b"".join(x for _, x in ta) == whole == b"".join(x for _, x in tb):
                left, right, x, y = list(ta), list(tb), 0, 0
                own = ([], [])
                while left or right:
                    if x <= y:
                        i, s = left.pop(0)
                        own[0].append(i)
                        x += len(s)
                    else:
                        i, s = right.pop(0)
                        own[1].append(i)
                        y += len(s)
                    if x == y:
                        groups.append(own)
                        own = ([], [])
        links = Counter((i, j) for g in groups for i in g[0] for j in g[1])
        holders.update(links.keys())
        found.append((doc, groups, links))
    most = defaultdict(int)
    for (i, _), n in holders.items():
        most[i] = max(most[i], n)
    out = []
    for doc, groups, links in found:
        text = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)
        out.append((doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()),
                    sum(m for p, m in links.items() if holders[p] == most[p[0]]), sum(m * holders[p] for p, m in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


ODD = [
    (1, None), (1, ""), (2, "plain words"), (2, "plain words"), (None, "a  b\n\n c\t"), (3, "▁x"), (4, "<|endoftext|> <s> <unk> <0x41>"),
    (5, "é漢字🙂 naïve Straße"), (6, "a\x00b"), (7, " lead and trail "), (8, "x" * 3000), (9, "ﬁ ½ é   　"), (10, "123456 " * 400), (11, " "),
]


def test_the_query_equals_a_plain_version(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted(map(tuple, op13_tokenizer_alignment(spark, small).collect()), key=str) == plain(docs)


@pytest.mark.parametrize(("size", "limits"), [(alignment.SLICE, {}), (7, {"BROADCAST_PAIRS": 0, "HOT_SHARE": 5})])
def test_odd_texts_repeats_and_clashing_columns(spark, monkeypatch, size, limits):
    for name, value in limits.items():
        monkeypatch.setattr(alignment, name, value)
    df = spark.createDataFrame(ODD, "doc_id bigint, text string").selectExpr("*", "1 AS pairs", "2 AS row", "3 AS slice").repartition(5)
    assert sorted(map(tuple, alignment.align(df, A, B, slice_bytes=size).collect()), key=str) == plain(ODD)


def test_links_of_large_groups_are_counted_like_those_of_small_ones(monkeypatch):
    import numpy as np

    r = np.random.default_rng(2)
    na, nb = r.integers(1, 9, 40), r.integers(1, 9, 40)
    a, b = r.integers(0, 5, na.sum()), r.integers(0, 5, nb.sum())
    expected = Counter((int(x), int(y)) for g in range(40) for x in np.split(a, np.cumsum(na))[g] for y in np.split(b, np.cumsum(nb))[g])
    for limit in (1, 9, 30, 1 << 16):
        monkeypatch.setattr(alignment, "LISTED", limit)
        keys, counts = alignment.linked(a, b, na, nb)
        assert {(int(k) >> 32, int(k) & 0xFFFFFFFF): int(c) for k, c in zip(keys, counts, strict=True)} == expected


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id bigint, text string"), A, B).count() == 0
