"""Every registered query against its SQL, and the survey views in both engines."""

import pytest

import __spark_entry__ as entry
from checks import registry, views
from checks.compare import connect, difference
from checks.framework import Check, shape, sql

SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
VIEW_COLUMNS = {
    "py": "pid:i hid:i year:i income:r4 GrossIncome:r4 age:i education:i Npersons:i sex:i head:i owner:i YearMoved:i pv:i "
    "garden:i elevator:i LodgeEnglish:s PowerCosts:i",
    "cw": "hid:i " + " ".join(f"{c}:r4" for c in views.CW_COLUMNS),
    "ww": "hid:i syear:i " + " ".join(f"{c}:r4" for c in views.WW_COLUMNS),
    "hw": "hid:i year:i income:r4 age:i education:i GrossWealth:r4 GrossDebts:r4 NetWealth:r4 financial:r4 business:r4",
    "hs": "hid:i run:s year:i income:r4 incomesd:r6 powercons:r4 liquidity:r4 trend:r6 discount:r6 house:i pv:i panelage:i debt:r4",
    "ps": "series:s t:i price:r6",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", VIEW_COLUMNS)
def test_view(spark, con, name):
    check = Check(name, VIEW_COLUMNS[name], None, f"SELECT * FROM {name}")
    got = shape(views.view(spark, SF, name), check.cols).toPandas()
    assert difference(got, con.execute(sql(check)).df()) is None


@pytest.mark.parametrize("key", QUERIES)
def test_query(spark, con, key):
    got = QUERIES[key](spark, SF).toPandas()
    assert len(got) > 0
    if key in ORACLES:
        assert difference(got, con.execute(ORACLES[key]).df()) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
