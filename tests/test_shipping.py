"""UDFs must run where the package is not importable (a driver started elsewhere, a
cluster without the package installed): everything is shipped by value."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_udf_queries_run_from_another_directory(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(
        "import importlib.util\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"spec = importlib.util.spec_from_file_location('__spark_entry__', '{ROOT}/__spark_entry__.py')\n"
        "E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)\n"
        "for name in ('batch_score_stub', 'row_metrics', 'normalize_turns', 'slugs', 'corpus_cer'):\n"
        f"    E.queries()[name](spark, '{SF}').collect()\n"
        "print('SHIPPED-OK')\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, str(script)], cwd=str(tmp_path), env=env, capture_output=True,
                       text=True, timeout=900)
    assert "SHIPPED-OK" in r.stdout, r.stderr[-3000:]
