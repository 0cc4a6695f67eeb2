"""Python workers need no copy of the package: queries run in a fresh process whose folder is another one."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})  # the driver's path only; workers do not inherit it
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
seen = spark.range(1).select(F.udf(lambda k: __import__("importlib.util").util.find_spec("hopscale") is None, "boolean")("id")).first()[0]
assert seen, "workers see the package, so this test proves nothing"
import __spark_entry__
queries = __spark_entry__.queries()
for name in {names!r}:
    print(name, queries[name](spark, "/root/testdata/sf0.001").count())
from hopscale.llm import simhash
simhash.PAIRS_UP_TO = 0  # groups are searched by flips
print("flips", simhash.near_duplicates(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).count())
"""
NAMES = ["op3_repeats", "op5_simhash", "op9_warc", "op10_site_quality", "pipeline"]


def test_workers_without_the_package(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(root=ROOT, names=NAMES))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600, check=False)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [x.split()[0] for x in done.stdout.splitlines() if x.split()[0] in (*NAMES, "flips")] == [*NAMES, "flips"]
