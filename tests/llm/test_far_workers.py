"""Operators in a process whose workers can't import the package."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent.parent
CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
import __spark_entry__
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

@F.udf("boolean")
def here(x):
    import importlib.util
    return importlib.util.find_spec("quillspark") is not None

assert not spark.range(1).select(here("id")).first()[0]
for name, query in __spark_entry__.queries().items():
    if name.startswith("op") or name in ("pipeline", "tokenize_pages", "cosine_topk", "ann_topk", "split_table"):
        query(spark, "/root/testdata/sf0.001").count()
        print("ran", name, flush=True)
"""


def test_workers_need_no_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("ran op") == 13 and "ran pipeline" in done.stdout
