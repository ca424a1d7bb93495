"""Every registered query of the library against its SQL on the smallest driver tables."""

import os

import duckdb
import pandas as pd
import pytest

from codexspark import plans

DATA = "/root/testdata/sf0.001"


def plain(value):
    if hasattr(value, "tolist") and getattr(value, "ndim", 0):
        return tuple(value.tolist())
    if isinstance(value, list):
        return tuple(value)
    if pd.isna(value):
        return None
    return int(value) if isinstance(value, float) and value == int(value) else value


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_equals_sql(spark, duck, name):
    wanted = rows(duck.execute(plans.ORACLES[name]).df())
    assert wanted[1], "two empty results would prove nothing"
    assert rows(plans.QUERIES[name](spark, DATA).toPandas()) == wanted


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLES)


def test_titles_of_odd_pages(spark, tmp_path):
    """Entities stay as the page has them; long URLs, empty titles and pages without one, page or number included."""
    titles = ["A &amp; B", "A & B", "&lt;x&gt; &#8364;&#x20ac; &amp;amp;lt; &amp", "ü € 漢 😀", "", " ", "&", "long &amp; " * 9000, "two\nlines"]
    pages = [(3 * i, "u", f"<title>{t}</title>") for i, t in enumerate(titles)] + [(60, "u", "<TITLE>none</TITLE>"), (63, "u", None), (-3, "u", "<title>&quot;</title>")]
    urls = ["http://x/?a=1&amp;b=2&lt;", "", None, "é" * 512, "é" * 512 + "x", "http://x/?y&amp;" * 5000]
    pages += [(3 * i + 1, u, "<title>t</title>") for i, u in enumerate(urls)] + [(2, None, None), (-1, "u", ""), (-2, "u", ""), (3 * 10**9 + 2, "u", ""), (None, "u", "<title>t</title>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    wanted = sorted(con.execute(plans.ORACLES["title_fallback"]).fetchall(), key=repr)
    assert len(wanted) == len(pages)
    assert sorted((tuple(r) for r in plans.QUERIES["title_fallback"](spark, str(tmp_path)).collect()), key=repr) == wanted


def against_sql(spark, folder, name, **tables):
    """A query's rows and its SQL's over tables (rows, schema)."""
    con = duckdb.connect()
    for table, (own, schema) in tables.items():
        spark.createDataFrame(own, schema).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    wanted = con.execute(plans.ORACLES[name])
    columns = [c[0] for c in wanted.description]
    wanted = sorted(wanted.fetchall(), key=repr)
    return sorted((tuple(r) for r in plans.QUERIES[name](spark, str(folder)).select(*columns).collect()), key=repr), wanted


def test_limits_of_odd_numbers(spark, tmp_path):
    """Negative, missing, repeated and long document numbers: each row gets a container of its own."""
    got, wanted = against_sql(spark, tmp_path, "limits", documents=([(i,) for i in (0, 1, 2, 2, -1, -2, None, 3 * 10**12 + 2)], "doc_id long"))
    assert len(wanted) == 24 and got == wanted


def test_manifest_of_long_numbers(spark, tmp_path):
    """Ids of numbers with more than five digits, negative ones and none."""
    ids = [(i,) for i in (0, 1, 99_999, 100_000, 1_234_567, 10**10 + 3, -1, -123_456, None)]
    got, wanted = against_sql(spark, tmp_path, "manifest_union", documents=(ids, "doc_id long"), pages=(ids, "page_id long"))
    assert len(wanted) == 23 and got == wanted
