"""Quality rules with host-level verdicts, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackloom.llm.scratch import stored

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
HOT_SHARE = 1000

#: name of a rule -> when it fails; all of them see the counts of text_metrics().
RULES = {
    "short": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "2 * n_dup_lines > n_lines",
    "shouting": "10 * n_upper_runs > 3 * n_words",
}
BASE = ("short", "repeats")


def _repeat_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the text, the first one included.

    Windows compare by a 64-bit hash of their words.  Only texts whose window
    hashes are not all distinct sort them; equal neighbours give the starts,
    and the starts in order give the length of the union of their windows.
    """
    starts = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))

    def covered(hashes: Column) -> Column:
        marked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def union(pairs: Column) -> Column:
            at = lambda i: F.try_element_at(pairs, i)["h"]
            repeated = F.filter(pairs, lambda p, i: ((i > 0) & (F.when(i > 0, at(i)) == p["h"])) | (at(i + 2) == p["h"]).eqNullSafe(True))
            found = F.array_sort(F.transform(repeated, lambda p: p["i"]))
            zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"))
            return F.aggregate(found, zero, step, lambda a: a["n"])

        return F.transform(F.array(marked), union)[0]  # binds the sorted array once

    counted = F.transform(F.array(starts), lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), 0).otherwise(covered(hs)))[0]
    return F.when(F.size(words) < WINDOW, 0).otherwise(counted).cast("long")


def text_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the counts of every whole text; a null text has none, a null host is a host of its own."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    split = base.select("doc_id", "host", "t", F.array_remove(F.split("t", SPACE), "").alias("words"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    return split.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("t", F.lit("[A-Z]{2,}")).cast("long").alias("n_upper_runs"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def host_rates(metrics: DataFrame) -> DataFrame:
    """host, n_docs, failures of each rule, n_failed and host_rate: the posterior mean of the failure rate.

    The beta prior is fitted over hosts by moments: mean m of all rows, between-
    host variance v (weighted by rows, less binomial noise), strength m(1-m)/v - 1.
    """
    hosts = stored(
        metrics.groupBy("host").agg(F.count("*").alias("n_docs"), F.count_if("failed").alias("n_failed"), *(F.count_if(F.expr(rule)).alias(f"n_{name}") for name, rule in RULES.items())),
        "hosts",
    )
    total = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count("*").alias("hosts")).first()
    n, mean = total["n"] or 0, (total["f"] or 0) / (total["n"] or 1)
    noise = mean * (1 - mean)
    spread = hosts.agg(F.sum(F.col("n_docs") * F.pow(F.col("n_failed") / F.col("n_docs") - mean, 2))).first()[0] or 0.0
    between = (spread - noise * total["hosts"]) / n if n else 0.0
    strength = min(max(noise / between - 1, 1.0), 1e6) if between > 0 else 1e6
    return hosts.withColumn("host_rate", (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_host_rate: float = 0.5) -> DataFrame:
    """One row per input row: counts, base_failed, failed rules, the host's shrunken failure rate and kept.

    kept is false where a rule fails or where the host's posterior failure rate
    is above max_host_rate.  A null or empty text has zero counts and fails
    "short".  Rows with equal ids are judged each by its own text.  An empty
    table gives an empty result; other columns are ignored.  Hosts with more
    than 1/HOT_SHARE of the rows are fewer than HOT_SHARE and join by broadcast.
    """
    measured = text_metrics(docs, id_col, text_col, host_col)
    fails = lambda names: F.expr(" OR ".join(f"({RULES[x]})" for x in names))
    metrics = stored(measured.withColumn("base_failed", fails(BASE)).withColumn("failed", fails(RULES)), "metrics")
    rates = host_rates(metrics).select(F.col("host").alias("host_"), "host_rate", "n_docs")
    bound = max(HOT_SHARE, metrics.count() // HOT_SHARE)
    hot, rest = F.broadcast(rates.where(F.col("n_docs") > bound)), rates.where(F.col("n_docs") <= bound)
    same = F.col("host").eqNullSafe(F.col("host_"))
    by_hot = metrics.join(hot, same)
    by_key = metrics.join(hot, same, "left_anti").join(rest, same)
    return by_hot.unionByName(by_key).select(*metrics.columns, "host_rate", (F.col("host_rate") <= max_host_rate).alias("host_ok"), (~F.col("failed") & (F.col("host_rate") <= max_host_rate)).alias("kept"))
