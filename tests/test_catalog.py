"""Every query against its SQL twin; the training chain is compared in test_boosting."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as contract
from compare import differences

TRAINED = {
    "grow_trees", "train_per_study", "grid_auc", "select_best", "refit_best", "feature_importance", "train_summary",
}
NAMES = [n for n in contract.CATALOG if n not in TRAINED]
ROOT = os.path.dirname(contract.__file__)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, duck, name):
    diff, rows = differences(contract.queries()[name](spark, sf), duck, contract.oracle_sql()[name])
    assert not diff
    assert rows > 0 or name == "signature_sample_gate"  # no study of the smallest tables has 270 samples


def test_entry(spark):
    assert contract.entry(spark).columns == ["study", "signature", "auc"]


def test_every_query_has_sql():
    assert all(sql for _, sql in contract.CATALOG.values())
    assert contract.CATALOG.keys() <= contract.queries().keys() and contract.CATALOG.keys() <= contract.oracle_sql().keys()


@pytest.mark.parametrize("hidden", ["cohortloom.llm", "zstandard", "corpus_pipeline"])
def test_catalog_without_the_corpus_operators(hidden):
    code = f"import sys; sys.modules[{hidden!r}] = None; import __spark_entry__ as e; print(*e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    names = set(done.stdout.split())
    assert contract.CATALOG.keys() <= names and "pipeline" not in names
