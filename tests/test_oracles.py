"""Every registered query with checking SQL equals it, row by row, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from beaconry.plans import load_all
from beaconry.sources.tables import TABLE_NAMES
from tests.conftest import FOLDER
from tools.check_oracles import rows_of

REGISTRY = load_all()
# slow to fit, covered by test_models
SKIP = {"train_forest", "quality_gate", "batch_score", "rob_perturb", "rob_boundary", "rob_extreme", "rob_repeat", "rob_results"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - SKIP))
def test_query(spark, duck, name):
    got = REGISTRY[name](spark, FOLDER).toArrow()
    if REGISTRY[name].sql is None:
        assert got.num_columns > 0
        return
    want = duck.execute(REGISTRY[name].sql).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    assert rows_of(got, columns) == rows_of(want, columns)


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())
