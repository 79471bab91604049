import os

import pytest

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_oracle_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def oracles():
    from weftgraph.oracles import ORACLES

    return sorted(ORACLES)


def near(a, b):
    return abs(a - b) <= 1e-9 * max(1, abs(a)) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", oracles())
def test_query_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    key = lambda r: [str(round(x, 4) if isinstance(x, float) else x) for x in r]
    want = sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall(), key=key)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    assert len(got) == len(want)
    assert all(near(a, b) for x, y in zip(got, want) for a, b in zip(x, y))
