"""Every query against its DuckDB SQL; those without SQL give rows of a stable schema."""

import pytest

from quirefold.plans import lookups, queries
from tests.conftest import canonical

QUERIES = {**queries.QUERIES, **lookups.QUERIES}
ORACLES = {**queries.ORACLES, **lookups.ORACLES}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        assert canonical(got) == canonical(duck.sql(ORACLES[name]).df())
    else:
        assert len(got.columns) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
