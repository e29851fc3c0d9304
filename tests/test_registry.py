import duckdb
import pytest

from textloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def order(row):
    return tuple((v is None, repr(round(v, 5)) if isinstance(v, float) else repr(v)) for v in row)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=order)
    assert got
    if name not in registry.ORACLE:
        return
    cur = oracle.execute(registry.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cur.fetchall()), key=order)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert list(g) == pytest.approx(list(w), abs=2e-6) if any(isinstance(v, float) for v in g) and all(isinstance(v, (int, float, type(None))) for v in g) else all(a == b or (isinstance(a, float) and abs(a - b) < 2e-6) for a, b in zip(g, w, strict=True)), (g, w)


def test_every_user_is_blinded(spark):
    d = "/root/testdata/sf0.01"  # sf0.001 has no user above 14
    got = sorted((r["case_id"], r["condition_id"]) for r in registry.QUERIES["blinded_items"](spark, d).collect())
    assert got == sorted(duckdb.sql(f"SELECT DISTINCT user_id::VARCHAR, event_type FROM '{d}/events.parquet'").fetchall())


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
