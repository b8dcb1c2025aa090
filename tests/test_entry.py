"""The driver contract holds with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
PROBE = """
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert set(s) <= set(q) and "gap_cluster" in q
print(sum(k.startswith("op") and k[2].isdigit() for k in q), "pipeline" in q)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print(q["upper_median"](spark, "/root/testdata/sf0.001").count(), e.entry(spark).count())
"""


def probe(folder: Path) -> list[str]:
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=folder, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout.strip().splitlines()[-2:]


def copied(target: Path) -> Path:
    shutil.copytree(ROOT, target, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.md", "*.json"))
    return target


def test_without_the_subpackage(tmp_path):
    for name, also in (("folder", False), ("all", True)):
        tree = copied(tmp_path / name)
        shutil.rmtree(tree / "svloom" / "llm", ignore_errors=True)
        shutil.rmtree(tree / "tests" / "llm", ignore_errors=True)
        if also:
            (tree / "corpus_pipeline.py").unlink(missing_ok=True)
        assert probe(tree) == ["0 False", "10 247"]
