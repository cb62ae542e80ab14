"""The functions under SQL names, for sessions that query by text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from trackloom.functions import exprs, kernels

#: Name, parameters and result of the functions that SQL itself expresses.
SQL_FUNCTIONS = {
    "tl_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0.0D, (s, x) -> s + x)"),
    "tl_normal_id": (
        "value STRING",
        "STRING",
        rf"""CASE WHEN regexp_extract(trim(value), r'(?i)^{exprs.ID_PREFIX}[\s_-]*0*([0-9]+)$', 1) <> ''
             THEN format_string('{exprs.ID_PREFIX}_%04d', try_cast(regexp_extract(trim(value), r'(?i)^{exprs.ID_PREFIX}[\s_-]*0*([0-9]+)$', 1) AS BIGINT)) ELSE coalesce(trim(value), '') END""",
    ),
    "tl_uuid5": (
        "name STRING",
        "STRING",
        f"""concat_ws('-', substr(sha1(concat(unhex('{exprs.URL_NAMESPACE}'), cast(name AS BINARY))), 1, 8), substr(sha1(concat(unhex('{exprs.URL_NAMESPACE}'), cast(name AS BINARY))), 9, 4),
             '5' || substr(sha1(concat(unhex('{exprs.URL_NAMESPACE}'), cast(name AS BINARY))), 14, 3),
             translate(substr(sha1(concat(unhex('{exprs.URL_NAMESPACE}'), cast(name AS BINARY))), 17, 1), '{exprs.VARIANT_FROM}', '{exprs.VARIANT_TO}') || substr(sha1(concat(unhex('{exprs.URL_NAMESPACE}'), cast(name AS BINARY))), 18, 3),
             substr(sha1(concat(unhex('{exprs.URL_NAMESPACE}'), cast(name AS BINARY))), 21, 12))""",
    ),
    "tl_overlap_seconds": (
        "s1 TIMESTAMP, e1 TIMESTAMP, s2 TIMESTAMP, e2 TIMESTAMP",
        "DOUBLE",
        "CASE WHEN s1 IS NULL OR e1 IS NULL OR s2 IS NULL OR e2 IS NULL THEN 0.0D ELSE greatest(0.0D, (unix_micros(least(e1, e2)) - unix_micros(greatest(s1, s2))) / 1000000.0D) END",
    ),
}
#: Name and Arrow kernel of the others.
KERNELS = {"tl_sharpness": kernels.sharpness, "tl_layout": kernels.layout, "tl_histogram": kernels.histogram, "tl_fingerprint": kernels.fingerprint}


def register(spark: SparkSession) -> None:
    """Defines all functions for the session, replacing earlier definitions."""
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, kernel in KERNELS.items():
        spark.udf.register(name, kernel)
