import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_workers_need_no_installed_package(tmp_path, data):
    """Run from another folder, with the package on the driver's path only."""
    code = f"""
import sys
sys.path.insert(0, {REPO!r})
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
q = __spark_entry__.queries()
assert q["p4_found"](spark, {data!r}).count() > 0
assert q["integrity"](spark, {data!r}).where("integra").count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
