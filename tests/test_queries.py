"""Every registered query on the smallest tables, against its SQL where there is one."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()
# Model choice fits forests on every fold, too slow for this suite; run it with oracle_check.py.
NAMES = [n for n in entry.queries() if n != "m5_choose_model"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    if name in ORACLE:
        ok, note = compare(df, con, ORACLE[name])
        assert ok, note
        assert "TYPES" not in note, note
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
