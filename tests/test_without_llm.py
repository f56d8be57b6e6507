"""The library without its training-data subpackage and the pipeline."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.modules["citeweave.llm"] = sys.modules["corpus_pipeline"] = None  # as if both were gone
import __spark_entry__ as e
from citeweave.plans import catalog
assert set(e.queries()) == set(catalog.queries()) and set(e.oracle_sql()) == set(catalog.oracles())
assert not any(n.startswith("op") or n == "pipeline" for n in e.queries())
assert not any(n.startswith("citeweave.llm") for n, m in sys.modules.items() if m)
"""


def test_entry_without_the_training_data_operators():
    done = subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_nothing_else_imports_them():
    for folder, _, files in os.walk(os.path.join(ROOT, "citeweave")):
        if os.path.basename(folder) != "llm":
            for name in files:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "citeweave.llm" not in f.read(), name
