"""Every registered query runs, and agrees with its SQL twin where it has one."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from twins import connect, differences

from quillspar import catalogue

PLANS = catalogue.plans()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in PLANS.items() if sql))
def test_twin(spark, sf, duck, name):
    query, sql = PLANS[name]
    assert differences(query(spark, sf), sql, duck) == []


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in PLANS.items() if not sql))
def test_runs(spark, sf, name):
    df = PLANS[name][0](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_training_data_package():
    """The entry module imports when the subpackage and the pipeline are gone."""
    import subprocess

    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("quillspar.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not any(n.startswith("op") for n in e.queries()) and "pipeline" not in e.queries()
"""
    root = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
