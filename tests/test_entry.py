"""The registry, and agreement of its queries with their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SLOW = {"interaction_outcomes", "moderation", "interactions_monthly"}


def comparable(rows, columns):
    def plain(v):
        if v is None or v != v:
            return ""
        return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(plain(row[c]) for c in columns) for row in rows)


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 7)} <= set(queries)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_queries_agree_with_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    core = {k for n in entry.CORE_SQL for k in __import__(n, fromlist=["ORACLE"]).ORACLE}
    wrong = []
    for name in sorted(core - SLOW):
        df = entry.queries()[name](spark, DATA)
        want = con.execute(entry.oracle_sql()[name]).fetchdf().to_dict("records")
        columns = sorted(df.columns)
        if comparable([r.asDict() for r in df.collect()], columns) != comparable(want, columns):
            wrong.append(name)
    assert not wrong


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_library_does_not_import_the_extra_package():
    root = os.path.join(os.path.dirname(entry.__file__), "threadloom")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "threadloom.llm" not in open(os.path.join(folder, f)).read()
