"""The text modules reach workers that do not have the repository on their path."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", {entry!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = (
    SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
)
for name in ("op3_quality_rules", "op12_secret_scan"):
    print("rows", entry.queries()[name](spark, "/root/testdata/sf0.001").count())
print("archives", len(spark.sparkContext._python_includes))
"""


def test_from_an_empty_folder(tmp_path):
    folder = tmp_path / "empty"
    folder.mkdir()
    script = SCRIPT.format(entry=str(ROOT / "__spark_entry__.py"), shared=str(tmp_path / "shared"))
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", script],
        cwd=folder,
        env=environment,
        capture_output=True,
        text=True,
        timeout=300,
    )
    assert done.stdout.split("\n")[-4:] == ["rows 200", "rows 200", "archives 1", ""], done.stderr[-2000:]
    assert not any(folder.iterdir())
