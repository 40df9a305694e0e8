"""Every query with a SQL oracle gives the same rows (order-free), columns and values as DuckDB on sf0.001."""

import pytest

from tools.check_oracle import digest, spark_rows
from tools.check_types import spark_type

import __spark_entry__ as E

ORACLES = E.oracle_sql()
QUERIES = E.queries()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["uf", "notices", "estimated_value"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    from conftest import SMALL
    df = QUERIES[name](spark, SMALL)
    cols, rows = spark_rows(df)
    rel = duck.sql(ORACLES[name])
    types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert {f.name: spark_type(f.dataType.simpleString()) for f in df.schema.fields} == types
    r = duck.execute(ORACLES[name])
    ocols = [d[0] for d in r.description]
    orows = r.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(cols, rows)[0] == digest(ocols, orows)[0]
