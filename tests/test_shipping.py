"""Python workers find the package when the driver was started in another folder."""

import os
import subprocess
import sys
from pathlib import Path

PROGRAM = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from kalmia.plans import catalogue
print("rows", catalogue.QUERIES["detect_labels"](spark, "/root/testdata/sf0.001").count())
"""


def test_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROGRAM.format(repo=str(Path(__file__).resolve().parent.parent))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "rows " in done.stdout, done.stderr[-3000:]
