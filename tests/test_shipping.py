"""Tasks must not need the package on the executors' path."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as entry
from agestrata.session import local_session
spark = local_session("shipping", 2, partitions=2)
print("rows", entry.queries()["variance_shares"](spark, "/root/testdata/sf0.001").count())
print("refits", entry.queries()["rolling_rate_backtest"](spark, "/root/testdata/sf0.001").count())
"""


def test_python_steps_run_from_any_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", PROGRAM], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "rows 2" in done.stdout, done.stderr[-2000:]
    assert "refits " in done.stdout, done.stderr[-2000:]
