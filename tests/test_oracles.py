"""Every query against its DuckDB oracle."""

import math

import pandas as pd
import pytest
from conftest import SF

from voxloom.plans import catalog

ORACLES = catalog.oracles()


def rows(table: pd.DataFrame) -> list[tuple]:
    table = table[sorted(table.columns)]
    plain = lambda v: "~" if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(plain(v) for v in row) for row in table.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES)))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
