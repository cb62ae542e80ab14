"""A training-data pipeline: five stages over documents.

Every stage takes (spark, docs, sf_dir) and returns what goes on: all but the
last give the columns of documents, each with the values it came with but for
what the stage is there to change, also where a column has the name of an
operator's result (Score, n_lines, position ...) or of a temporary column.  A
stage sees all rows that the one before it kept.  For all of them null texts
are empty texts, an empty table gives an empty result, and very long texts are
taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom.llm.classifier import quality_classifier
from trackloom.llm.jaccard_join import one_of_each
from trackloom.llm.line_dedup import line_dedup
from trackloom.llm.mixing import RESULTS, mix_sources
from trackloom.llm.names import aside
from trackloom.llm.packing import pack
from trackloom.llm.scratch import drop_but_last, stored, written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as label 1, unchanged.

    Equal texts have equal scores, so repeated rows stay or go together; rows
    with a null id are scored and never train; without labels of both classes
    all stay (the prior is above the bar, unless nearly all labels are 0).
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    own, back = aside(docs, "score", "held_out", "predicted")
    return back(quality_classifier(own, labels).where("predicted = 1"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of many sites but in the first document that has them; n_chars follows the text.

    Null texts stay null and their n_chars stays; a null source is a site of
    its own; rows with equal ids, null ones too, keep or lose a line together.
    """
    own, back = aside(docs, "n_lines", "n_removed")
    out = line_dedup(own)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return back(out)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, unchanged, of each group linked by similarity 0.8 or more of word 5-grams.

    That of the least id, null ids last; of rows that share id and text any one.
    Texts without a word, null ones too, are one group; groups that share an id
    stay apart.
    """
    return one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, unchanged, in the order that interleaves the sources by target weights.

    A null source is a source; null ids come together; rows with equal ids in
    the order of a hash of the row, so only repeated rows may change places.
    """
    own, back = aside(docs, *RESULTS)
    return back(mix_sources(own).orderBy("position"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, packed and numbered group by group in the mixing order.

    A table read again has no order of rows, so the positions, which depend on
    the rows alone, are found anew; a task packs a range of them.  Rows with
    equal or null ids, repeated rows too, are packed each by itself.
    """
    own, _ = aside(docs, *RESULTS)
    return pack(mix_sources(own).orderBy("position"), TOKENIZER).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", accepted),
    ("line_dedup", without_boilerplate),
    ("ngram_jaccard_join", distinct),
    ("source_mixing", mixed),
    ("packing", packed),
]

#: The classifier is learned, so SQL can't express the first stage; tests/llm/test_pipeline.py has brute-force stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's tables are dropped when its result is written."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        drop_but_last(spark, since)
    return STAGES[-1][1](spark, docs, sf_dir)
