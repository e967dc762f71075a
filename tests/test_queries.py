"""Every query with SQL against DuckDB at the smallest scale."""

import decimal
import re

import duckdb
import pytest

from folioscope.plans.queries import ORACLE_SQL, QUERIES, flagship

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return repr(round(float(v), 9) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert mine == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert mine or name in ("agg_duplicates",)


def test_flagship(spark, sf):
    assert flagship(spark, sf).count() > 0


@pytest.mark.parametrize("name", ["fmt_page_name", "parse_chapter", "chapter_key", "split_autosplit", "config_run"])
def test_code_of_a_page_is_compiled(spark, sf, name):
    """The JVM interprets methods of more than 8,000 bytes; what chapters and volumes share isn't worked out for each page."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = spark._jvm.PythonSQLUtils.explainString(QUERIES[name](spark, sf)._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert int(re.findall(r"maxMethodCodeSize:(\d+)", text)[-1]) < 8000
