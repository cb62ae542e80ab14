"""One query for each operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom.llm.alignment import align
from trackloom.llm.classifier import quality_classifier
from trackloom.llm.exact_dedup import exact_dedup
from trackloom.llm.jaccard_join import jaccard_join
from trackloom.llm.licenses import license_scan
from trackloom.llm.line_dedup import line_dedup
from trackloom.llm.mixing import mix_sources
from trackloom.llm.packing import pack
from trackloom.llm.quality_rules import quality_rules
from trackloom.llm.scratch import new_path, stored
from trackloom.llm.secrets import BASE_KINDS, secret_scan
from trackloom.llm.suffix_dedup import suffix_dedup
from trackloom.llm.token_output import read_ids, with_starts, write_ids
from trackloom.llm.whitening import whiten


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_documents(spark, sf_dir)).select("doc_id", "class_id", "copy_of", "n_links", "n_grams")


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM w)),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN g ON g.doc_id = w.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y, k = a.n AND k = b.n AS same FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 10 * k >= 8 * (a.n + b.n - k)
      UNION ALL SELECT a.doc_id, b.doc_id, true FROM n a JOIN n b ON a.n = 0 AND b.n = 0 AND a.doc_id <> b.doc_id),
c AS (SELECT doc_id AS x, doc_id AS root FROM documents UNION SELECT l.y, c.root FROM c JOIN l ON l.x = c.x)
SELECT n.doc_id, (SELECT min(root) FROM c WHERE c.x = n.doc_id) AS class_id,
       least(n.doc_id, (SELECT min(y) FROM l WHERE l.x = n.doc_id AND same)) AS copy_of,
       (SELECT count(*) FROM l WHERE l.x = n.doc_id) AS n_links, n.n AS n_grams
FROM n
"""


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir)).select("doc_id", "source", "source_rank", "block", "slot", "release", "deadline", "position")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secret_scan(_documents(spark, sf_dir))
    is_base = lambda s: s["kind"].isin(*BASE_KINDS)
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(F.filter("spans", is_base)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


OP4_SQL = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
full_lines AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
b AS (SELECT line, min(doc_id) AS first_id FROM full_lines GROUP BY line HAVING count(DISTINCT coalesce(source, '')) >= 10),
k AS (SELECT l.doc_id, i, l.line, regexp_matches(l.line, '[^\x20\x09-\x0D]') AS counts, first_id IS NOT NULL AND first_id <> l.doc_id AS gone
      FROM l LEFT JOIN b ON l.line = b.line)
SELECT doc_id, count(*) FILTER (counts) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS text_sha256
FROM k GROUP BY doc_id
"""


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(_documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


OP6_SQL = r"""
WITH t AS (SELECT doc_id, source AS host, coalesce(text, '') AS t,
                  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
           FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(8) r(k) GROUP BY doc_id),
m AS (SELECT t.doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
             len(regexp_extract_all(t, '[A-Z]{2,}')) AS n_upper, coalesce(n, 0) AS n_repeat_words
      FROM t LEFT JOIN covered c ON c.doc_id = t.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words
             OR 2 * n_dup_lines > n_lines OR 10 * n_upper > 3 * n_words AS failed FROM m),
h AS (SELECT host, count(*) AS n, count(*) FILTER (failed) AS k FROM f GROUP BY host),
g AS (SELECT sum(k) / sum(n) AS mean, sum(n) AS rows, count(*) AS hosts FROM h),
v AS (SELECT any_value(mean) AS mean, (sum(n * (k / n - mean) * (k / n - mean)) - any_value(mean * (1 - mean) * hosts)) / any_value(rows) AS b FROM h, g),
p AS (SELECT mean, CASE WHEN b > 0 THEN least(greatest(mean * (1 - mean) / b - 1, 1), 1000000) ELSE 1000000 END AS s FROM v),
r AS (SELECT host, (k + mean * s) / (n + s) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT failed AND rate <= 0.5 AS kept, round(rate, 6) AS host_rate
FROM f JOIN r ON f.host IS NOT DISTINCT FROM r.host
"""


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    files = docs.select("doc_id", "text", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    found = license_scan(files)
    return found.select("doc_id", "path", "license", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"), "first_line", "end_line", "origin", "license_dir")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "ids")
    write_ids(_documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    read = stored(read_ids(spark, path).select("part", "doc_id", "first", "n_tokens", F.crc32("ids").alias("ids_crc32")), "documents")
    return with_starts(read).select("doc_id", "start", "n_tokens", "ids_crc32")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_ngram_jaccard_join": (op1_ngram_jaccard_join, OP1_SQL),
    "op2_source_mixing": (op2_source_mixing, None),
    "op3_secret_scan": (op3_secret_scan, None),
    "op4_line_dedup": (op4_line_dedup, OP4_SQL),
    "op5_exact_dedup": (op5_exact_dedup, OP5_SQL),
    "op6_quality_rules": (op6_quality_rules, OP6_SQL),
    "op7_suffix_dedup": (op7_suffix_dedup, None),
    "op8_quality_classifier": (op8_quality_classifier, None),
    "op9_packing": (op9_packing, None),
    "op10_license_scan": (op10_license_scan, None),
    "op11_embedding_whitening": (op11_embedding_whitening, None),
    "op12_token_output": (op12_token_output, None),
    "op13_tokenizer_alignment": (op13_tokenizer_alignment, None),
}


def queries() -> dict:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
