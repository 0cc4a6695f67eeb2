"""Python workers need no copy of the package: searches and decay functions run in a fresh process whose folder is another one."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})  # the driver's path only; workers do not inherit it
import math
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
seen = spark.range(1).select(F.udf(lambda k: __import__("importlib.util").util.find_spec("hopscale") is None, "boolean")("id")).first()[0]
assert seen, "workers see the package, so this test proves nothing"
import hopscale as H
h = H.Hierarchy(H.generate_grid_network(spark, 5, 5), base_radius=2000)
ih = H.InteractionHierarchy(h, lambda c: math.pow(c + 2000.0, -1.0))
print("total", round(float(ih.matvec([1.0] * 25).sum()), 6))
"""


def test_workers_without_the_package(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(root=ROOT))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-3000:]
    assert "total " in done.stdout
