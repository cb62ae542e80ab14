"""Token-id output: documents as files of compressed ids, and the reader of those files.

A file holds blocks of BLOCK ids, a line feed after each.  A block is

* a header: mark, format, bits of an id, whether its first piece goes on the
  last document of the block before, the file's number, the block's number in
  the file, ids, pieces, bytes of the directory, bytes of the code, and the
  CRC-32 of what follows it and of the ids;
* a directory, deflated: for each piece of a document its id, whether that id
  is null, and how many of the block's ids it has;
* the ids, by the context-mixing coder of range_coder, which starts afresh.

Spark writes the files as rows of text without a character set (its committer
makes a lost task's file appear once or not at all) and reads them as binary
files, so any shared file system will do.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trackloom.llm.memory import trimmed
from trackloom.llm.range_coder import BLOCK, decode_block, encode_block

HEAD = struct.Struct("<4sBBBxIIIIIII")
MARK, FORMAT = b"TLid", 2
#: Distinct words and pieces of words whose ids a worker remembers, and the longest that it remembers.
WORDS, PIECES, LONGEST = 1 << 20, 1 << 19, 64
#: The split of the files that are read by pieces, and the same split for lower-case words of these letters, which NFC leaves alone.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS = "a-zß-öø-ÿ"
PLAIN, PIECE = re.compile("[!-~À-ÖØ-öø-ÿ]+"), re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+")
#: The byte-level letters of a plain word's UTF-8 bytes.
BYTES = {c: chr(b[0]) + {0x9F: "Ł", 0xA0: "ł", 0xAD: "Ń"}.get(b[1], chr(b[1])) for c in range(0xDF, 0x100) if (b := chr(c).encode())}


class Known(dict):
    """The ids (uint32 bytes) that make gives for texts, remembered for at most so many of them."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, text: str) -> bytes:
        ids = self.make(text)
        if len(text) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[text] = ids
        return ids


@functools.lru_cache(maxsize=2)
def word_encoder(path: str):
    """A function from text to ids (uint32): what tokenizers gives for the file with add_special_tokens=False.

    Where the file drops white space, no token crosses a blank or line feed, so
    each distinct word between them is given to the library once and then
    remembered; any other file gets whole texts.  Where the file lowers words
    and splits them by SPLIT, words of plain letters are split here, and each
    distinct piece is given to the library's model alone.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    whole = lambda text: library.encode(text, add_special_tokens=False).ids
    probe = ["a", " a", "a ", "\na", "don't", "<|endoftext|>", "é", "Σ"]
    if any(whole(f"{x} {y}") != whole(x) + whole(y) or whole(f"{x}\n\n{y}") != whole(x) + whole(y) for x in probe for y in probe) or whole(" \n "):
        return lambda text: np.array(whole(text), np.uint32)

    packed = lambda ids: np.array(ids, "<u4").tobytes()
    word, special = lambda text: packed(whole(text)), _plain_split(path)
    if special is not None:
        model = library.model
        piece = Known(lambda text: packed([t.id for t in model.tokenize(text.translate(BYTES) if not text.isascii() else text)]), PIECES).__getitem__

        def word(text: str) -> bytes:
            if PLAIN.fullmatch(text) and not any(s in text for s in special):
                return b"".join(map(piece, PIECE.findall(text.lower())))
            return packed(whole(text))

    known = Known(word, WORDS).__getitem__
    return lambda text: np.frombuffer(b"".join(map(known, text.replace("\n", " ").split(" "))), "<u4")


def _plain_split(path: str) -> list[str] | None:
    """The strings of a file's added tokens, if it lowers words and splits them by SPLIT into byte-level pieces; else None."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    steps = (file["normalizer"] or {}).get("normalizers", [])
    splits = (file["pre_tokenizer"] or {}).get("pretokenizers", [])
    lowers = [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
    cuts = len(splits) == 2 and splits[0].get("pattern") == {"Regex": SPLIT} and (splits[0]["behavior"], splits[0]["invert"]) == ("Removed", True) and (splits[1]["type"], splits[1]["add_prefix_space"], splits[1]["use_regex"]) == ("ByteLevel", False, False)
    plain = file["post_processor"] is None and file["truncation"] is None and file["padding"] is None and all(not t["lstrip"] and not t["rstrip"] and not t["normalized"] and not t["single_word"] for t in file["added_tokens"])
    return [t["content"] for t in file["added_tokens"]] if lowers and cuts and plain else None


def vocabulary_bits(path: str, end_id: int) -> int:
    """Bits that hold every id of the file and end_id."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) - 1, end_id, 1).bit_length()


def make_block(goes_on: bool, ids: np.ndarray, names: list, sizes: list[int], bits: int, part: int, number: int) -> bytes:
    """A block of ids whose pieces belong to the documents of these ids."""
    code = encode_block(ids, bits)
    null = np.array([x is None for x in names], np.uint8)
    table = zlib.compress(np.array([x or 0 for x in names], "<i8").tobytes() + np.array(sizes, "<u4").tobytes() + null.tobytes(), 6)
    check = zlib.crc32(ids.astype("<u4").tobytes(), zlib.crc32(code, zlib.crc32(table)))
    return HEAD.pack(MARK, FORMAT, bits, goes_on, part, number, len(ids), len(names), len(table), len(code), check) + table + code


def make_blocks(blocks: list[tuple], bits: int, part: int, first: int) -> list[bytes]:
    """Blocks of (goes on, ids, document ids, their lengths), numbered from first."""
    return [make_block(*b, bits, part, first + k) for k, b in enumerate(blocks)]


def split_blocks(content):
    """(header fields, directory, code) of each block of a file; an error where it is no such file or cut off."""
    at, view = 0, memoryview(content)
    while at < len(view):
        if len(view) - at < HEAD.size:
            raise ValueError(f"cut off at byte {at}")
        head = HEAD.unpack_from(view, at)
        mark, version, _, _, _, number, _, _, table, code, _ = head
        end = at + HEAD.size + table + code
        if mark != MARK or version != FORMAT:
            raise ValueError(f"no block at byte {at}")
        if end >= len(view) or view[end] != 10:
            raise ValueError(f"block {number} is cut off")
        yield head, bytes(view[at + HEAD.size : end - code]), bytes(view[end - code : end])
        at = end + 1


def read_blocks(content):
    """(part, goes on, ids, document ids, lengths) of each block of a file, in order; an error where a checksum differs."""
    for number, (head, table, code) in enumerate(split_blocks(content)):
        _, _, bits, goes_on, part, own, n, pieces, _, _, check = head
        ids = decode_block(code, n, bits).astype("<u4")
        if zlib.crc32(ids.tobytes(), zlib.crc32(code, zlib.crc32(table))) != check:
            raise ValueError(f"block {own} of part {part} is damaged")
        if own != number:
            raise ValueError(f"part {part} has block {own} where block {number} should be")
        raw = zlib.decompress(table)
        names = np.frombuffer(raw, "<i8", pieces).tolist()
        for k in np.flatnonzero(np.frombuffer(raw, np.uint8, pieces, 12 * pieces)).tolist():
            names[k] = None
        yield part, bool(goes_on), ids, names, np.frombuffer(raw, "<u4", pieces, 8 * pieces)


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes every text's ids and end_id to a new folder of files, by ascending document id, null ids first.

    The order goes on from file to file; rows with equal ids stand by the hash
    of their text, repeated rows one after the other.  A null text is empty:
    end_id alone.  Ids of documents are longs.  Other columns are ignored; an
    empty table gives no block.  A range of documents is a task and a file;
    ranges split between equal ids, so a hot id is no hot task.
    """
    bits = vocabulary_bits(tokenizer_path, end_id)
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = own.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    ranged = own.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")

    def run(batches):
        from pyspark import TaskContext

        encode, part, number = word_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        ids, names, sizes, held, goes_on = [], [], [], 0, False

        def close(cut: bool):
            nonlocal held, goes_on, number
            block = make_block(goes_on, np.concatenate(ids), names, sizes, bits, part, number)
            ids.clear(), names.clear(), sizes.clear()
            held, goes_on, number = 0, cut, number + 1
            return pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["block"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                at = 0
                while at < len(tokens):
                    n = min(BLOCK - held, len(tokens) - at)
                    ids.append(tokens[at : at + n]), names.append(name), sizes.append(n)
                    at, held = at + n, held + n
                    if held == BLOCK:
                        yield close(at < len(tokens))
        if held:
            yield close(False)

    ranged.drop("h").mapInArrow(trimmed(run), "block binary").select(F.col("block").cast("string").alias("value")).write.text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """part, place (in the part), doc_id, first (ids of the part before it), n_tokens and ids (little-endian unsigned 32-bit) of every document in the files.

    A file is read by one task, which decodes a block at a time; a damaged
    or cut file is an error.  A folder without a block gives no row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    names = ["part", "place", "doc_id", "first", "n_tokens", "ids"]

    def documents(content):
        at = place = 0
        name, pieces, part = None, [], 0
        for part, goes_on, ids, found, sizes in read_blocks(content):
            begin = 0
            for k, (own, n) in enumerate(zip(found, sizes.tolist(), strict=True)):
                if (k or not goes_on) and pieces:
                    yield part, place, name, at, pieces
                    at, place, pieces = at + sum(map(len, pieces)), place + 1, []
                name = own
                pieces.append(ids[begin : begin + n])
                begin += n
        if pieces:
            yield part, place, name, at, pieces

    def batch(rows):
        part, place, doc, first, n, ids = zip(*rows, strict=True)
        kinds = [pa.int64()] * 5 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((part, place, doc, first, n, ids), kinds, strict=True)], names)

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for part, place, name, first, pieces in documents(content.as_buffer()):
                    ids = np.concatenate(pieces)
                    rows.append((part, place, name, first, len(ids), ids.tobytes()))
                    held += len(ids)
                    if held >= 1 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return files.mapInArrow(trimmed(run), "part bigint, place bigint, doc_id bigint, first bigint, n_tokens bigint, ids binary")


def with_starts(documents: DataFrame) -> DataFrame:
    """Adds start, the ids of all documents before it in all files; the table of files has one row a file."""
    ends = documents.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return documents.join(F.broadcast(ends.select("part", before.alias("before"))), "part").withColumn("start", F.col("before") + F.col("first")).drop("before")
