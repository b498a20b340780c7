"""The queries where only the driver can import the package."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent.parent
CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[3]).getOrCreate()
import __spark_entry__
for name, query in sorted(__spark_entry__.queries().items()):
    if name.startswith("op") or name == "pipeline":
        print(name, query(spark, sys.argv[2]).count())
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_workers_need_no_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, str(ROOT), SF, str(tmp_path / "checkpoints")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len([x for x in done.stdout.splitlines() if x.startswith(("op", "pipeline"))]) == 14
