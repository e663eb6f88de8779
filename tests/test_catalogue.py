"""Every registered query of the graph engine against its SQL twin."""

import pytest

from plexgraph.plans import catalogue
from tests.oracle import connect, rows_of, rows_of_sql


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows(spark, data, con, name):
    assert rows_of(catalogue.QUERIES[name](spark, data)) == rows_of_sql(con, catalogue.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).columns


def test_entry_has_a_stable_schema(spark, data):
    assert catalogue.flagship(spark, data).columns == ["name", "n"]


def test_resolve_chain_of_a_frequent_name(spark, data, tmp_path):
    con = connect(data)
    con.execute(f"COPY (SELECT * REPLACE (p_partkey + k * 200 AS p_partkey, 'a b' AS p_name) FROM part, range(2) r(k)) TO '{tmp_path}/part.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (l_orderkey + k * 1000000 AS l_orderkey, l_partkey + k * 200 AS l_partkey) FROM lineitem, range(2) r(k)) TO '{tmp_path}/lineitem.parquet'")
    con = connect(data)
    for t in ("part", "lineitem"):
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    name, whole = "derive_resolve_chain", catalogue.QUERIES["derive_resolve_chain_whole"](spark, str(tmp_path))
    got = rows_of(catalogue.QUERIES[name](spark, str(tmp_path)))
    assert got == rows_of_sql(con, catalogue.ORACLE[name])
    assert 0 < len(got[1]) < whole.count()
