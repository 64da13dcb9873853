"""Workers that cannot import the package, and sessions that keep nothing."""

from __future__ import annotations

import os
import subprocess
import sys

from tallyhouse.llm import queries


def test_all_queries_reach_workers_from_another_folder(tmp_path):
    """The driver finds the package by a path that is not passed on."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from tallyhouse.session import build_session
import __spark_entry__
spark = build_session("elsewhere", "local[4]", spark__ui__enabled="false", spark__checkpoint__dir={str(tmp_path)!r},
                      spark__sql__shuffle__partitions="4")
for name in {sorted(queries.QUERIES)!r}:
    __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("RAN", name, flush=True)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    ran = {x.split()[1] for x in done.stdout.splitlines() if x.startswith("RAN")}
    assert ran == set(queries.QUERIES), done.stderr[-3000:]
