"""The driver's entry points, with and without the llm folders."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "rank" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("gone", [("huespan.llm",), ("huespan.llm", "corpus_pipeline")])
def test_entry_without_the_subpackage(gone):
    code = f"import sys\nfor m in {gone!r}: sys.modules[m] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert 'linear_search' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q\nassert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
