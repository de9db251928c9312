"""Python functions of the package run where it is not installed."""

import os
import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {root!r})
from pixelweave.session import local_session
from pixelweave.operators import enrich, lineage
spark = local_session("2", "foreign")
e = spark.createDataFrame([(0, 1, 2), (1, 2, 1), (2, 2, 3)], "ord long, source long, target long")
print(sorted(r.ord for r in lineage.drop_back_edges(e).collect()))
a = spark.createDataFrame([('{{"output": ["x", "y"]}}',), ('[["p"], "q", "r"]',)], "answer string")
print([r.t for r in enrich.resolve_outputs(a, "answer", "text", "t").collect()])
print([r.u for r in enrich.resolve_outputs(a, "answer", "url", "u").collect()])
"""


def test_functions_travel_with_the_tasks(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.splitlines() == ["[0, 2]", "[None, 'qr']", "['x', 'p']"], out.stderr[-2000:]
