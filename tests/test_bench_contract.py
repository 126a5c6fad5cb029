"""bench.py prints exactly one JSON line with the fields the driver reads."""

from __future__ import annotations

import json
import os
import subprocess
import sys

from tests.conftest import ROOT, SF_SMALL


def test_bench_prints_one_json_line():
    env = dict(
        os.environ,
        BENCH_SF_DIR=SF_SMALL,
        BENCH_CPUS="2",
        BENCH_REPEATS="1",
        BENCH_QUERIES="on_time_rate,seller_risk",
    )
    out = subprocess.run(
        [sys.executable, os.path.join(ROOT, "bench.py")],
        env=env,
        cwd="/tmp",
        capture_output=True,
        text=True,
        timeout=600,
    )
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [line for line in out.stdout.splitlines() if line.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and d["sf"] == 0.001
    assert set(d["queries"]) == {"on_time_rate", "seller_risk"}
    assert set(d["prepared"]) == {"prepare", "seller_risk"} and d["calibration"] > 0
    assert d["value"] == round(sum(d["queries"].values()), 3)
