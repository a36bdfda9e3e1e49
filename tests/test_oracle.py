"""Every registered query against its SQL on the smallest tables."""

import importlib.util
from pathlib import Path

import pytest

from opsloom.catalogue import registry

FOLDER = "/root/testdata/sf0.001"
_spec = importlib.util.spec_from_file_location(
    "check_oracle", Path(__file__).resolve().parents[1] / "tools" / "check_oracle.py")
check = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check)
registry._load()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.REGISTRY))
def test_query(spark, name):
    q = registry.REGISTRY[name]
    df = q.run(registry.Tables(spark, FOLDER))
    if q.sql is None:
        assert df.count() > 0
        return
    error, _, _ = check.compare(df, q.sql, FOLDER)
    assert error is None, error


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
