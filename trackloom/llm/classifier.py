"""Quality classifier: supervised subword embeddings.

Features of a text: every word, the character n-grams (in bytes, 3 to 5) of the
word between boundary marks, and for a word that stands again within four words
how far back it stands, all hashed into buckets, and one end mark with a bucket
of its own.  A text's vector is the
mean of its features' learned vectors, the output a softmax over two classes;
both layers are trained by stochastic gradient descent in numpy.  For scoring,
a bucket's vector times the difference of the two output rows is one number, so
a text's logit is a mean of table look-ups.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from trackloom.llm.memory import trim
from trackloom.llm.names import own_columns
from trackloom.llm.scratch import stored

P = np.uint64(0x100000001B3)
INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
MIX = np.uint64(0x9E3779B97F4A7C15)
GRAMS = (3, 4, 5)
#: Distances at which a word is compared with those before it.
BACK = (1, 2, 3, 4)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are hashed at once; longer texts are hashed in slices that overlap at word ends.
SLICE = 1 << 20
#: Buckets of all features, the last one for the end mark.
BUCKETS = 1 << 17


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h + np.uint64(seed)) * MIX
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """All buckets but the last, by the upper half of a hash."""
    return (h >> np.uint64(32)) * np.uint64(buckets - 1) >> np.uint64(32)


def _word_hashes(b: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Hashes of the words between single gaps: polynomial prefix sums, brought to a common power."""
    ends = np.flatnonzero(gap)
    if len(ends) < 2:
        return np.zeros(0, np.uint64)
    power, back = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(b), x, np.uint64)))) for x in (P, INVERSE))
    prefix = np.concatenate(([np.uint64(0)], np.cumsum(b * power[:-1])))
    start, stop = ends[:-1] + 1, ends[1:]
    return (prefix[stop] - prefix[start]) * back[start]


def _slice_features(data: np.ndarray, buckets: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words, n-grams and distances of bytes that begin and end with white space, and hashes of the last words; before has those of the words before."""
    gap = SPACE[data]
    keep = ~(gap & np.concatenate(([False], gap[:-1])))  # one mark between words
    b = np.where(gap, 0x20, data)[keep].astype(np.uint64)
    gap = gap[keep]
    out = []
    for n in GRAMS:
        m = len(b) - n + 1
        if m <= 0:
            continue
        h, inner = np.zeros(m, np.uint64), np.zeros(m, bool)
        for k in range(n):
            h = h * P + b[k : k + m]
            if 0 < k < n - 1:
                inner |= gap[k : k + m]
        out.append(_mixed(h[~inner], n))
    words = _word_hashes(b, gap)
    out.append(_mixed(words, 1))
    line = np.concatenate((before, words))
    for d in BACK:
        # how far back the same word stands: a feature like a word, hashed and learned like one
        same = line[d:] == line[:-d] if len(line) > d else np.zeros(0, bool)
        out.append(_mixed(np.full(int(same[max(0, len(before) - d) :].sum()), d, np.uint64), 2))
    return _bucket(np.concatenate(out), buckets), line[-max(BACK) :]


def features(text: str, buckets: int) -> np.ndarray:
    """Bucket numbers of all features of a whole text, with repeats; the end mark comes last."""
    data = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", np.uint8)
    found, at, last = [], 0, np.zeros(0, np.uint64)
    while at < len(data) - 1:
        stop = min(at + SLICE, len(data))
        while stop < len(data) and not SPACE[data[stop - 1]]:
            stop += 1
        own, last = _slice_features(data[at:stop], buckets, last)
        found.append(own)
        at = stop - 1  # the mark that ends a slice begins the next
    found.append(np.array([buckets - 1], np.uint64))
    return np.concatenate(found).astype(np.int64)


@dataclass
class Model:
    """table: a bucket's contribution to the logit; bias: the logit's constant."""

    table: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        logit = float(self.table[features(text or "", len(self.table))].mean()) + self.bias
        return 1.0 / (1.0 + np.exp(-min(max(logit, -500.0), 500.0)))


def bag(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and how often it has them; a null text is an empty one."""
    return np.unique(features(text or "", buckets), return_counts=True)


def packed(found: tuple[np.ndarray, np.ndarray]) -> bytes:
    """A bag in a fifth of its size: the buckets' distances and the counts, compressed."""
    ids, counts = found
    return zlib.compress(np.concatenate((np.diff(ids, prepend=0), counts)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(found: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(found), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    half = len(both) // 2
    return np.cumsum(both[:half], dtype=np.intp), both[half:]


def train(bags: list[bytes], labels: list[int], buckets: int = BUCKETS, dim: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """Plain stochastic gradient descent, a packed bag at a time, with a linearly falling rate.

    No text, or one class alone, gives a model whose score is the share of label 1.
    """
    share = (sum(labels) + 1) / (len(labels) + 2)
    if len(set(labels)) < 2:
        return Model(np.zeros(buckets, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    output, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, counts = unpacked(bags[i])
            descend(vectors, output, bias, ids, (counts / counts.sum()).astype(np.float32), labels[i], rate * (1 - done / steps))
            done += 1
    return Model((vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0]))


def descend(vectors: np.ndarray, output: np.ndarray, bias: np.ndarray, ids: np.ndarray, weights: np.ndarray, label: int, step: float) -> None:
    """One step down the gradient of the cross entropy of one text, in place."""
    own = vectors.take(ids, axis=0)
    hidden = weights @ own
    logits = output @ hidden + bias
    p = np.exp(logits - logits.max())
    p /= p.sum()
    p[label] -= 1.0
    back = p @ output
    output -= step * np.outer(p, hidden)
    bias -= step * p
    # the mean's gradient, scaled back up so that rare features learn as fast as in short texts
    own -= np.outer((step * min(len(ids), 64)) * weights, back)
    vectors[ids] = own


def training_bags(docs: DataFrame, labels: DataFrame, max_rows: int, max_features: int, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[list[bytes], list[int]]:
    """Packed bags and labels of at most max_rows labelled texts outside the held-out fold, those with the smallest hash of their id.

    Executors make the bags; the driver gets at most max_features pairs of a
    bucket and a count (the first text always), packed, never a text.
    """

    @F.pandas_udf("bag binary, n bigint")
    def bags(texts: pd.Series) -> pd.DataFrame:
        found = [bag(t, buckets) for t in texts]
        return pd.DataFrame({"bag": [packed(b) for b in found], "n": [len(b[0]) for b in found]})

    held = F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").where(~held)
    chosen = own.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).join(F.broadcast(chosen), "id").select("id", "y", F.xxhash64("id").alias("h"), F.xxhash64("t").alias("th"), bags("t").alias("bag"))
    rows = stored(rows.select("h", "id", "th", "y", "bag.*"), "bags")
    sizes = rows.orderBy("h", "id", "th").select("h", "id", "th", "n").limit(max_rows).collect()  # four numbers a row
    kept, held_features = 0, 0
    for r in sizes:
        held_features += r["n"]
        if kept and held_features > max_features:
            break
        kept += 1
    got = rows.orderBy("h", "id", "th").limit(kept).select("bag", "y").collect() if kept else []
    return [bytes(r["bag"]) for r in got], [r["y"] for r in got]


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score of every whole text; a null text scores as an empty one.  No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.table.tobytes(), model.bias))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        table, bias = shared.value
        own = Model(np.frombuffer(table, np.float32), bias)
        found = pd.Series([own.score(t) for t in texts], dtype="float64")
        trim()
        return found

    return docs.withColumn(score_col, score(F.col(text_col).cast("string")))


def quality_classifier(docs: DataFrame, labels: DataFrame, max_training_rows: int = 4000, max_training_features: int = 16_000_000, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= threshold).

    Trains on at most max_training_rows labelled rows, with max_training_features
    different features of a text together, outside the fold where crc32 of the
    id, as text, leaves 0 modulo 5; ids, languages and sources are never inputs.
    Every whole text is scored.

    A null text is an empty one; a null id is not held out and never trains; an
    id with both labels counts as 1; repeated rows score alike; no usable
    labels give the prior, 0.5; an empty table gives an empty result.  Columns
    of docs named held_out, score or predicted, in any case, are replaced, all
    others stay.
    """
    model = train(*training_bags(docs, labels, max_training_rows, max_training_features, BUCKETS, id_col, text_col))
    new = ("score", "held_out", "predicted")
    own = docs.select(*(c for c, n in zip(own_columns(docs), docs.columns, strict=True) if n.lower() not in new))
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score_texts(own, model, text_col).withColumn("held_out", held).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
