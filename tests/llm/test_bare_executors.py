"""Every query of the subpackage and the pipeline in a session whose workers can't import this package."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
DATA = Path("/root/testdata/sf0.001")
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession

spark = (
    SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    .config("spark.checkpoint.dir", sys.argv[2]).config("spark.driver.memory", "4g").getOrCreate()
)
spark.sparkContext.setLogLevel("OFF")

def absent(batches):
    try:
        import dieframe
    except ImportError:
        yield from batches

assert spark.range(1).mapInArrow(absent, "id long").count() == 1, "workers have the package"
import corpus_pipeline
from dieframe.llm.queries import QUERIES

for name, query in (QUERIES | {"pipeline": corpus_pipeline.run}).items():
    print(name, query(spark, sys.argv[3]).count(), flush=True)
"""


@pytest.mark.skipif(not DATA.exists(), reason="needs the given tables")
def test_queries_on_executors_without_the_package(tmp_path):
    (tmp_path / "cwd").mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(ROOT), str(tmp_path / "shared"), str(DATA)], cwd=tmp_path / "cwd", env=env, capture_output=True, text=True, timeout=900, check=False)
    assert run.returncode == 0, run.stderr[-3000:]
    rows = dict(line.split() for line in run.stdout.splitlines())
    assert len(rows) == 14 and all(int(n) > 0 for n in rows.values())
