"""Python workers find the package from a folder that doesn't hold it: by the shipped archive alone."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1])
entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[2]).config("spark.ui.enabled", "false").getOrCreate()
from pyspark.sql import functions as F
where = F.udf(lambda i: __import__("flowlens").__file__)
print("AT", spark.range(1).select(where("id")).first()[0] if entry.ship(spark) is None else "")
print("ROWS", entry.queries()["r9_emit_alerts"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_get_the_code(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    args = [sys.executable, "-c", CODE, f"{ROOT}/__spark_entry__.py", str(tmp_path / "shared")]
    done = subprocess.run(args, cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "flowlens.zip" in done.stdout, done.stderr[-2000:]
    assert "ROWS" in done.stdout and not done.stdout.strip().endswith("ROWS 0"), done.stderr[-2000:]
