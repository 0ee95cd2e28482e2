"""The folder of staged tables when no setting names one."""

import os
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
from pyspark.sql import SparkSession
from groundloom.sources import staging
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
get = spark.conf.get
spark.conf.get = lambda key, *a: None if key == "spark.checkpoint.dir" else get(key, *a)
spark.sparkContext.getCheckpointDir = lambda: None
first, second = staging.staged(spark.range(3), "a"), staging.staged(spark.range(4), "b")
assert first.count() == 3 and second.count() == 4
assert staging.folder(spark) == staging.folder(spark) and "groundloom-" in staging.folder(spark)
import os
path = first.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
assert os.path.isdir(path)
staging.drop(first)
assert not os.path.isdir(path) and second.count() == 4
"""


def test_a_local_session_without_a_setting_gets_a_folder():
    done = subprocess.run([sys.executable, "-c", CODE], env=os.environ | {"PYTHONPATH": HERE}, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]
