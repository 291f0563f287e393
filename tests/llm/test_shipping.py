"""Tasks find the package wherever the driver was started."""

import os
import subprocess
import sys

from conftest import SF_SMALL

SCRIPT = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
import __spark_entry__ as entry
for name in ("op6_pii_spans", "op7_line_dedup_bitmaps"):
    print(name, entry.queries()[name](spark, {SF_SMALL!r}).count())
"""


def test_queries_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.split() == ["op6_pii_spans", "200", "op7_line_dedup_bitmaps", "200"]
