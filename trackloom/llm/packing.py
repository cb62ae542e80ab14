"""Packing: documents into token sequences of balanced attention cost."""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trackloom.llm.memory import trimmed

#: Fixed value: the split pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space so long that the pattern's engine would run out of steps (from 1,000,000); any length from 2 would do.
LONG_GAP = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")
#: Tokens that are packed together; a task holds no more than this and one Arrow batch.
GROUP = 1 << 21


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte: itself where it prints, else the next code point from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _split_at(pattern: re.Pattern, text: str):
    """(part, whether the pattern matched it) of a text, in order, empty parts left out."""
    at = 0
    for m in pattern.finditer(text):
        if m.start() > at:
            yield text[at : m.start()], False
        yield m[0], True
        at = m.end()
    if at < len(text):
        yield text[at:], False


def _fast_encoder(spec: dict, plain_text: bool = False):
    """The vocabulary of a plain byte-level BPE file run by tiktoken, or None if the file is of another kind; with plain_text, added tokens' strings are plain text."""
    model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
    plain = model.get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    if not plain or len(model["merges"]) + 256 > len(model["vocab"]) or any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
        return None
    symbols, names = _byte_symbols(), {x["content"]: x["id"] for x in added}
    ranks = {bytes(symbols[c] for c in word): i for word, i in model["vocab"].items() if word not in names}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if not all(model["vocab"][m] == 256 + i for i, m in enumerate(merged)):
        return None
    import tiktoken

    fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = re.compile("|".join(re.escape(x) for x in sorted(names, key=len, reverse=True)))

    def ordinary(text: str):
        """Arrays of ids; a long run of white space is one piece of the pattern, but for a last character that goes with what follows."""
        at = 0
        for m in LONG_GAP.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            yield fast.encode_to_numpy(text[at : m.start()], disallowed_special=())
            yield np.array(fast._encode_single_piece(text[m.start() : end]), np.uint32)
            at = end
        yield fast.encode_to_numpy(text[at:], disallowed_special=())

    def encode(text: str) -> np.ndarray:
        if plain_text or not names or not special.search(text):
            return np.concatenate([*ordinary(text)])
        return np.concatenate([ids for part, known in _split_at(special, text) for ids in ([np.array([names[part]], np.uint32)] if known else ordinary(part))])

    return encode


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """A function from text to ids (uint32): what tokenizers gives for the file with add_special_tokens=False.

    A plain byte-level BPE file is run by tiktoken over the same vocabulary,
    whose ids are the ranks of its merges; that is five times as fast and gives
    the same ids, those of added tokens' strings included.  Any other file is
    run by tokenizers itself.
    """
    with open(path, encoding="utf-8") as f:
        fast = _fast_encoder(json.load(f))
    if fast:
        return fast
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(maxsize=2)
def plain_encoder(path: str):
    """encoder, but with the strings of added tokens as plain text."""
    with open(path, encoding="utf-8") as f:
        fast = _fast_encoder(json.load(f), plain_text=True)
    if fast:
        return fast
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)


def piece_cost(n, linear: float, quadratic: float):
    """Estimated cost of a piece of n tokens that attends within itself."""
    return linear * n + quadratic * n * n


def capacities(tokens: int, size: int) -> list[int]:
    """Sequences that hold exactly so many tokens: full ones, then the rest as powers of two, which need no padding."""
    full, rest = divmod(tokens, size)
    return [size] * full + [1 << b for b in range(size.bit_length() - 1, -1, -1) if rest >> b & 1]


def plan(lengths: np.ndarray, size: int = 2048, linear: float = 1.0, quadratic: float = 1 / 2048) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with these lengths.

    Whole multiples of size fill sequences of their own.  The remainders go in
    descending order, each to the sequence of lowest cost that has room for all
    of it; where none has, it is cut and fills the lowest-cost sequence that has
    any room.  The sequences hold as many tokens as there are: no padding.
    """
    pieces, sequences = [], 0
    for d in np.flatnonzero(lengths >= size):
        for k in range(int(lengths[d]) // size):
            pieces.append((int(d), k * size, size, sequences, 0))
            sequences += 1
    rest = lengths % size
    room = np.array(capacities(int(rest.sum()), size), np.int64)
    whole, cost = room.copy(), np.zeros(len(room))
    order = np.argsort(-rest, kind="stable")
    for d in order[rest[order] > 0]:
        start, left = int(lengths[d] - rest[d]), int(rest[d])
        while left:
            fits = room >= left
            able = fits if fits.any() else room > 0
            s = int(np.where(able, cost, np.inf).argmin())
            n = min(left, int(room[s]))
            pieces.append((int(d), start, n, sequences + s, int(whole[s] - room[s])))
            cost[s] += piece_cost(n, linear, quadratic)
            room[s] -= n
            start, left = start + n, left - n
    return pieces


ARROW = [("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1 / 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    Every text's ids, then end_id, lie in exactly one piece each.  A null text
    is empty: one token.  The string of a special token in a text is that
    token, as the library has it.  Rows with equal or null ids are packed each by
    itself; other columns are ignored; an empty table gives no piece.  Each
    task packs groups of at most GROUP tokens of its own rows, so nothing
    shuffles and memory is bounded; a sequence's id is its task's number and
    its place there, the same when the task runs again.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        encode, first = encoder(tokenizer_path), TaskContext.get().partitionId() << 32
        names, tokens, held = [], [], 0

        def flush():
            nonlocal first
            lengths = np.array([len(t) for t in tokens], np.int64)
            pieces = plan(lengths, size, linear, quadratic)
            d, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            ids = [tokens[i][s : s + n].astype("<u4").tobytes() for i, s, n, _, _ in pieces]
            columns = [pa.concat_arrays(names).take(pa.array(d)), start, length, lengths[d], seq + first, offset, pa.array(ids, pa.binary())]
            first += int(seq.max()) + 1
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["doc_id", *(n for n, _ in ARROW)])
            names.clear(), tokens.clear()

        for batch in batches:
            at = 0
            for i, text in enumerate(batch.column(1)):
                tokens.append(np.append(encode(text.as_py() or ""), np.uint32(end_id)))
                held += len(tokens[-1])
                if held >= GROUP:
                    names.append(batch.column(0).slice(at, i + 1 - at))
                    yield from flush()
                    at, held = i + 1, 0
            names.append(batch.column(0).slice(at))
        if tokens:
            yield from flush()

    return own.mapInArrow(trimmed(run), f"doc_id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
