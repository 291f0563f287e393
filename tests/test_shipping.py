"""Python that Spark runs in workers of its own is found wherever the driver was started."""

import os
import subprocess
import sys

from conftest import SF_SMALL

SCRIPT = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from storelens.plans.registry import QUERIES
for name in ("collector_source", "collector_source_stream", "stream_collector_health"):
    print(name, QUERIES[name](spark, {SF_SMALL!r}).count() > 0)
"""


def test_sources_and_processors_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.split() == ["collector_source", "True", "collector_source_stream", "True", "stream_collector_health", "True"]
