"""The package is on the driver's path only: tasks must bring all they need."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
sys.path.insert(0, {root!r})
from dueday.llm.queries import QUERIES
from dueday.session import local_session
spark = local_session(4, "bare")
try:
    spark.range(1).mapInArrow(lambda batches: __import__("dueday") and batches, "id long").collect()
    raise SystemExit("the workers see the package, so this run shows nothing")
except Exception as err:
    assert "No module named 'dueday'" in str(err), err
for name, query in QUERIES.items():
    assert query(spark, {sf!r}).count() > 0, name
print("all ran")
"""


def test_queries_run_on_executors_without_the_package(sf_dir, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = CODE.format(root=ROOT, sf=sf_dir)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.stdout.strip().endswith("all ran"), done.stdout[-500:] + done.stderr[-2000:]
