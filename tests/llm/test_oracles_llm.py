"""Registered queries with SQL against DuckDB."""

import pytest
from compare import canonical, connect

from axiomloom.llm import queries as q

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_matches_sql(spark, name):
    df = q.QUERIES[name](spark, FOLDER)
    cur = connect(FOLDER).execute(q.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(columns, cur.fetchall())


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    numbers = {int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in entry.queries()
