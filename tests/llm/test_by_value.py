"""Workers that cannot import the library run what learns or reads vocabularies."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from weir.session import build_session
spark = build_session("by-value", cores=2)

def importable(_):
    import importlib.util
    yield importlib.util.find_spec("weir") is not None

assert spark.sparkContext.parallelize([0], 1).mapPartitions(importable).collect() == [False]
for name, query in entry.queries().items():
    if name.split("_")[0] in ("op1", "op2", "op4", "op5", "op10", "op11", "op12", "op13"):
        assert query(spark, sys.argv[2]).count() > 0, name
print("all ran")
"""


def test_queries_with_workers_without_the_library(folder, tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    (tmp_path / "elsewhere.py").write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "elsewhere.py", repo, folder], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0 and "all ran" in run.stdout, run.stderr[-3000:]
