"""The registered queries without the optional parts."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(*blocked: str) -> set[str]:
    """Queries that a fresh interpreter registers when these modules cannot be imported."""
    code = f"import sys\nfor m in {list(blocked)!r}: sys.modules[m] = None\nimport __spark_entry__ as e\nassert set(e.oracle_sql()) <= set(e.queries())\nprint(*e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    return set(out.stdout.split())


def test_optional_parts_may_be_missing():
    everything = names()
    plain = {n for n in everything if not n.startswith("op") and n != "pipeline"}
    assert len(plain) >= 158
    assert names("sirenfield.llm") == names("zstandard") == plain
    assert names("corpus_pipeline") == everything - {"pipeline"}
