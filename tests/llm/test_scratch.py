import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
CODE = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master({master!r}).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
assert not spark.sparkContext.getConf().get("spark.checkpoint.dir")
import __spark_entry__ as entry
for name in {names!r}:
    print(name, len(entry.queries()[name](spark, "/root/testdata/sf0.001").collect()))
"""


def run(tmp_path, names, master="local[4]"):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "TMPDIR": str(tmp_path)}
    return subprocess.run([sys.executable, "-c", CODE.format(master=master, names=names)], cwd=ROOT, env=env, capture_output=True, text=True, timeout=600)


def test_queries_that_store_tables_run_where_no_folder_is_named(tmp_path):
    names = ["op1_ngram_jaccard_join", "op4_line_dedup", "op5_exact_dedup", "op6_quality_rules", "op8_quality_classifier", "op10_license_scan", "op12_token_output", "op13_tokenizer_alignment", "pipeline"]
    done = run(tmp_path, names)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines()] == names
