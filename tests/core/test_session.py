"""Written tables go when the application ends."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
from gleanspark.session import build_session, materialize
spark = build_session("scratch", "local[1]", 1, spark__checkpoint__dir={root!r})
assert materialize(spark.range(5), "five").count() == 5
import os
assert len(os.listdir({root!r} + "/gleanspark")) == 1
spark.stop()
"""


def test_scratch_is_deleted(tmp_path):
    subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(tmp_path))], cwd=Path(__file__).resolve().parents[2], check=True, timeout=300)
    assert list((tmp_path / "gleanspark").iterdir()) == []
