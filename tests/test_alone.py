"""The library without the corpus operators, from another folder: workers find it all the same."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as entry
known = entry.queries()
assert not any(k.startswith("op") for k in known) and set(entry.oracle_sql()) <= set(known)
print("rows", *(known[k](spark, "/root/testdata/sf0.001").count() for k in ("x_javascript", "html_depth", "x_python")))
"""


def test_scripts_and_pages_are_read(tmp_path):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "lodestone", tmp_path / "copy" / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path / "copy")
    (tmp_path / "elsewhere").mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, str(tmp_path / "copy")], cwd=tmp_path / "elsewhere", env=env, capture_output=True, text=True, timeout=300)
    assert "rows 200 200 200" in done.stdout, done.stderr[-2000:]
