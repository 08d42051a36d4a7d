"""Queries whose workers cannot import the package: only the driver's path knows it."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from tracelight.session import build_session
from pyspark.sql import functions as F

spark = build_session("local[4]")
spark.conf.set("spark.sql.execution.pyspark.udf.faulthandler.enabled", "false")
folder = "/root/testdata/sf0.001"
for name in sys.argv[2:]:
    print(name, entry.queries()[name](spark, folder).count(), flush=True)
"""
NAMES = [
    "op1_language_id", "op3_pii", "op5_best_fit_packing", "op7_token_counts", "op8_secret_scans",
    "op9_minhash_near_dedup", "op10_lm_scoring", "op11_vector_codes", "op12_cost_packing",
    "op13_target_resampling", "pipeline",
]


def test_workers_need_no_package(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, str(script), str(REPO), *NAMES],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900, check=False,
    )
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line] == NAMES
