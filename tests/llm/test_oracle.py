"""The registered queries with SQL against DuckDB, values and column types."""

import importlib

from tests.llm.conftest import SF

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def test_queries_equal_their_sql(spark):
    from tools.oracle_check import duck, norm
    from waypoint.llm.queries import ORACLE, QUERIES
    entry = importlib.import_module("__spark_entry__")
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) == {"op4_mixing", "op6_licences", "op9_chat", "op11_centroids"}
    con = duck(SF)
    for name, sql in ORACLE.items():
        df = QUERIES[name](spark, SF)
        rel = con.sql(sql)
        types = dict(zip(rel.columns, map(str, rel.types)))
        assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema} == types, name
        cols = sorted(df.columns)
        got = sorted(repr([norm(v) for v in r]) for r in df.select(*cols).collect())
        want = sorted(repr([norm(v) for v in r]) for r in rel.select(*cols).fetchall())
        assert got == want, name


def test_names_start_with_their_number():
    from waypoint.llm.queries import QUERIES
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))
