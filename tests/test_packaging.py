"""The registered jobs with Python tasks run from any working directory, as on executors that lack the repository."""

import os
import subprocess
import sys

from tests.conftest import ROOT, SF

SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry_file", sys.argv[1])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", 2).config("spark.ui.enabled", "false").getOrCreate()
for name in "w6_distribution_gate w8_stake_with_cap x9_is_valid_pubkey t1_assemble_blocks_stream t4_advancing_slots_stream t11_slashing_stream".split():
    assert entry.queries()[name](spark, sys.argv[2]).count() >= 0
print("all ran")
"""


def test_jobs_run_from_another_directory(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT, f"{ROOT}/__spark_entry__.py", SF], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in run.stdout, run.stderr[-3000:]
