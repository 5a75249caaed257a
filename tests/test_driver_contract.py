"""The driver imports the entry file from another working directory with its
own plain session: Python-side operators must still run on the workers."""

from __future__ import annotations

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
import __spark_entry__ as E
q = E.queries()
n = sum(q[k](spark, "/root/testdata/sf0.001").count() for k in ("policy_chunks", "vector_topk", "embed_chunks"))
print("OK", n, E.entry(spark).count())
"""


def test_python_operators_run_outside_the_repo(tmp_path):
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "OK" in out.stdout and out.stdout.strip().endswith(" 25")
