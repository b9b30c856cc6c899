"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from lakewright.plans import load_plans
from lakewright.sources.tables import TABLES
from tests.conftest import DATA
from tools.verify import compare

PLANS = load_plans()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(PLANS))
def test_query(spark, duck, key):
    text, _, good = compare(spark, DATA, key, PLANS[key], duck)
    assert good is not False, text


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 350
