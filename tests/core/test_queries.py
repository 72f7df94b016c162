"""Every registered query against its SQL at the smallest scale, and the closed-form cases of those without."""

import math

import duckdb
import pytest

from fossilframe.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    return str(v)


HEAVY = {f"distance_{m}" for m in ("canberra", "correlation", "cosine", "jaccard", "hamming", "cityblock")} | {"simper"}


@pytest.mark.parametrize("name", sorted(set(SQL) - HEAVY))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(cols)
    pick = lambda rs, cs: sorted(tuple(norm(r[cs.index(c)]) for c in sorted(cs)) for r in rs)
    assert pick(rows, df.columns) == pick(want, cols)


def test_log_series_takes_all_rows(spark):
    got = QUERIES["log_series"](spark, SF).collect()
    assert sum(r["i"] * r["observed"] for r in got) == spark.read.parquet(f"{SF}/lineitem.parquet").count()


def test_ordination_takes_the_specimens(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert QUERIES["spanning_tree"](spark, SF).count() == n - 1
    assert QUERIES["linkage_ward"](spark, SF).count() == n - 1
    assert QUERIES["rda"](spark, SF).count() == 32
    assert QUERIES["mantel"](spark, SF).first()["permutations"] == 999
