"""The Python parts reach the executors whatever folder the driver was started in."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
SCRIPT = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from tidemark.session import build_session
spark = build_session(master="local[2]", **{{"spark.sql.shuffle.partitions": "2"}})
import __spark_entry__ as driver
for name in ("deadband_sharded", "deadband_stream"):
    print(name, driver.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_from_another_folder(tmp_path):
    run = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-2000:]
    assert [line.split()[0] for line in run.stdout.splitlines()[-2:]] == ["deadband_sharded", "deadband_stream"]
