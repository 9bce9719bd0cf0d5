"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from corvane.plans.registry import ORACLE_SQL, QUERIES, flagship

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float | decimal.Decimal):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(canon, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(name, spark, sf, con):
    frame = QUERIES[name](spark, sf)
    result = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(columns)
    names = sorted(columns)
    own = sorted("|".join(canon(r[c]) for c in names) for r in frame.collect())
    theirs = sorted("|".join(canon(r[columns.index(c)]) for c in names) for r in result.fetchall())
    assert own == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).columns


def test_flagship(spark, sf):
    rows = flagship(spark, sf).collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("name", ["view_filter_tree", "fielded_rank_plain", "graph_related", "scan_deltas", "validate_strict"])
def test_order_of_input_rows_changes_nothing(name, spark, sf, monkeypatch):
    import corvane.plans.queries_graph as qg
    import corvane.plans.queries_ops as qo
    import corvane.plans.queries_rank as qr
    import corvane.plans.queries_rules as qu
    import corvane.plans.star_graph as sg
    from corvane import session

    before = sorted(map(str, QUERIES[name](spark, sf).collect()))
    mixed = lambda s, d, n: session.table(s, d, n).repartition(7).orderBy(session.F.rand(3))
    monkeypatch.setattr(session, "_REMEMBERED", {})
    for module in (qg, qo, qr, qu, sg):
        if hasattr(module, "table"):
            monkeypatch.setattr(module, "table", mixed)
    assert sorted(map(str, QUERIES[name](spark, sf).collect())) == before
