import functools
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from trackloom.llm import range_coder, token_output
from trackloom.llm.queries import op12_token_output

PATH = public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def library():
    return Tokenizer.from_file(PATH)


def ids_of(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 2]


def test_the_query_equals_the_library(spark, small):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    at, expected = 0, []
    for doc, text in docs:
        ids = ids_of(text)
        expected.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, op12_token_output(spark, small).collect())) == expected


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aZ é\n\t́  Σσ'st<|endoftext|>1漢🙂\x1c")), max_size=60))
def test_words_give_the_ids_of_whole_texts(text):
    assert token_output.word_encoder(PATH)(text).tolist() == ids_of(text)[:-1]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65535) | st.integers(0, 3), max_size=200), min_size=1, max_size=5))
def test_coder_round_trip(blocks):
    arrays = sorted((np.array(b, np.uint32) for b in blocks), key=len, reverse=True)
    codes = range_coder.encode_blocks(arrays, 16)
    back = range_coder.decode_blocks(codes, np.array([len(a) for a in arrays]), 16)
    assert [b.tolist() for b in back] == [a.tolist() for a in arrays]
    alone = range_coder.encode_blocks(arrays[:1], 16)
    assert alone[0] == codes[0]  # a block's code depends on that block alone


def test_coder_learns():
    r = np.random.default_rng(0)
    loop = np.tile(r.integers(0, 50000, 50), 80).astype(np.uint32)
    noise = r.integers(0, 65536, 4000).astype(np.uint32)
    loop_code, noise_code = range_coder.encode_blocks([loop, noise], 16)
    assert len(loop_code) < 600 and len(noise_code) < 2.5 * len(noise)  # an id costs 2 bytes plainly, 4 in the table


def test_files_round_trip_with_long_documents_nulls_and_ties(spark, tmp_path, monkeypatch):
    long = "ab cd " * 30000
    rows = [(5, "b"), (5, "a"), (5, "a"), (None, "n"), (None, None), (-3, ""), (9, long), (10, "end"), (2**40, "big")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS part", "2 AS ids")
    path = str(tmp_path / "ids")
    token_output.write_ids(df, path, PATH, 2)
    got = token_output.with_starts(token_output.read_ids(spark, path)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -3, 5, 5, 5, 9, 10, 2**40]
    found = sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got)
    assert found == sorted((str(d), ids_of(t)) for d, t in rows)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens


def test_empty_table(spark, tmp_path):
    token_output.write_ids(spark.createDataFrame([], "doc_id bigint, text string"), str(tmp_path / "none"), PATH, 2)
    assert token_output.with_starts(token_output.read_ids(spark, str(tmp_path / "none"))).count() == 0


def test_damage_is_an_error():
    ids = np.arange(3000, dtype=np.uint32)
    blocks = token_output.make_blocks([(False, ids, [1, None], [2000, 1000]), (True, ids[:10], [None], [10])], 16, 4, 0)
    whole = b"".join(b + b"\n" for b in blocks)
    (part, on, first, names, sizes), second = token_output.read_blocks(whole)
    assert (part, on, first.tolist(), names, sizes.tolist()) == (4, False, ids.tolist(), [1, None], [2000, 1000]) and second[1]
    for at in (len(blocks[0]) - 5, token_output.HEAD.size + 2):
        bad = bytearray(whole)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            list(token_output.read_blocks(bytes(bad)))
    for cut in (10, len(whole) - 1, len(blocks[0])):
        with pytest.raises(ValueError, match="cut off"):
            list(token_output.read_blocks(whole[:cut]))
    with pytest.raises(ValueError, match="should be"):
        list(token_output.read_blocks(blocks[1] + b"\n"))


def test_a_block_is_coded_in_lanes():
    r = np.random.default_rng(1)
    ids = r.zipf(1.3, 1 << 18).clip(0, 49407).astype(np.uint32)
    begin = time.process_time()
    (code,) = range_coder.encode_blocks([ids], 16)
    (back,) = range_coder.decode_blocks([code], np.array([len(ids)]), 16)
    assert (back == ids).all() and len(code) < 2 * len(ids)
    assert time.process_time() - begin < 10  # id by id it takes minutes


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aZéÉßàíÿ÷×Þ's|<1.!е²ª½ĿΣ\n <")), max_size=30))
def test_pieces_give_the_ids_of_whole_texts(text):
    for own in (text, text + "<|endoftext|>", text + "'LL", "I'm" + text):
        assert token_output.word_encoder(PATH)(own).tolist() == ids_of(own)[:-1]


def test_words_that_share_pieces_cost_the_library_each_piece_once(monkeypatch):
    made = []
    init = token_output.Known.__init__
    monkeypatch.setattr(token_output.Known, "__init__", lambda self, make, most: init(self, lambda text: made.append(text) or make(text), most))
    token_output.word_encoder.cache_clear()
    assert token_output.word_encoder(PATH)("Sole sole, SOLE. (sole)").tolist() == ids_of("Sole sole, SOLE. (sole)")[:-1]
    token_output.word_encoder.cache_clear()
    assert made.count("sole") == 1
