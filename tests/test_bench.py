"""bench.py prints exactly one JSON line with the fields the driver reads."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py"), "headline", "discount_tiers"],
                         capture_output=True, text=True, env=env, timeout=600, check=True)
    lines = [line for line in out.stdout.splitlines() if line.strip()]
    assert len(lines) == 1
    d = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= set(d)
    assert d["unit"] == "sec" and d["sf"] == 0.001 and d["errors"] == {}
    assert set(d["queries"]) == {"load_line_items", "headline", "discount_tiers"}
    assert all(v > 0 for v in d["queries"].values())
    assert set(d["warm_queries"]) == {"headline", "discount_tiers"} and d["warm_value"] > 0
