"""The engine's queries against their SQL, on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from tidestat import queries  # noqa: E402


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.split('.')[0]} as select * from '{small}/{f}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: None if isinstance(v, float) and math.isnan(v) else round(float(v), 5) if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, tables, name):
    df = queries.QUERIES[name](spark, small)
    got = df.collect()
    if name in queries.ORACLE:
        want = tables.execute(queries.ORACLE[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert plain(got, df.columns) == plain(want.fetchall(), columns)
    else:
        assert got


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["nuc_msp_rate_khist_coarse", "nuc_msp_rate_exact"])
def test_rates_round_as_their_sql(spark, tmp_path, name):
    texts = [("x " * 28).ljust(200, "y"), ("x " * 28).ljust(28 * 2 + 1, "y"), "a" * 128, "ab " * 60]  # 29 words on 200 letters: 0.145 is below the tie
    rows = [(i, t, "en", f"src{i}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in want.description]
    df = queries.QUERIES[name](spark, str(tmp_path))
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), columns)
