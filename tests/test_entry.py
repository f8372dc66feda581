"""What the driver's contract offers where a part of the repository is missing."""

import subprocess
import sys
from pathlib import Path

import pytest

HIDING = """
import sys
for name in sys.argv[1:]:
    sys.modules[name] = None
import __spark_entry__ as contract
assert len(contract.queries()) >= 38 and set(contract.oracle_sql()) <= set(contract.queries())
assert not any(name.startswith("op") or name == "pipeline" for name in contract.queries())
"""


@pytest.mark.parametrize("hidden", ["xxhash", "public_tokenizers", "corpus_pipeline", "clusterloom.llm"])
def test_rest_works_without(hidden):
    at = Path(__file__).resolve().parents[1]
    run = subprocess.run([sys.executable, "-c", HIDING, hidden], cwd=at, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    assert "without the training-data queries" in run.stderr
