"""Every query with SQL gives the same rows as DuckDB on the same Parquet tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from paneloom.plans import registry


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def canonical(df):
    def one(v):
        v = v.item() if hasattr(v, "item") else v
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(str(one(v)) for v in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, sf_dir, name):
    got = canonical(registry.QUERIES[name](spark, sf_dir).toPandas())
    want = canonical(duck.execute(registry.ORACLES[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs_without_sql(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_is_balanced(spark, sf_dir):
    rows = registry.QUERIES["tool_share_panel"](spark, sf_dir).toPandas()
    assert len(rows) == rows.source.nunique() * rows.lang.nunique()
    assert (rows.documents == 0).any()
    shares = rows[[c for c in rows if c.endswith("_hits_share")]].sum(axis=1)
    assert shares.round(9).isin([0.0, 1.0]).all()


def same_on_pages(spark, tmp_path, name, rows):
    """The query's rows and its SQL's on a table of pages that is made up of rows."""
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = canonical(registry.QUERIES[name](spark, str(tmp_path)).toPandas())
    assert got == canonical(con.execute(registry.ORACLES[name]).df())
    return got[1]


def test_cached_lookup_of_repeated_urls(spark, tmp_path):
    """Pages of one URL, or of URLs with one safe name, each have what is kept for them."""
    long = "http://h.org/" + "a" * 200
    urls = ["http://h.org/1", "http://h.org/1", "http://h.org/1", "https://h.org/1", "http://h.org/1?", "https://h.org/1#", None, None, long, long + "b", long + "c", long, "", "", ""]
    got = same_on_pages(spark, tmp_path, "cached_lookup", [(i, u, "") for i, u in enumerate(urls)] + [(0, urls[0], "")])
    assert len(got) == len(urls) + 1


def test_page_parse_of_character_references(spark, tmp_path):
    """References as the SQL decodes them, also where a title is cut within one and where the text is the whole page's."""
    page = "<html><head><title>{t}</title><script>var t='&amp';</script></head><body><h1>{t}</h1><article><p>{b}</p></article><footer>&copy; n &middot; {b}</footer></body></html>"
    titles = ["a &amp;&amp;&amp", "a &am", "a &", "a &quot", "b &lt;i&gt;", "&amp;lt; &amp;amp;", "&LT; &#39; &#39 &#x27;&#X27;", "&copy; &copy &eacute;", "x&nbsp;&nbsp y", "&ampx; &;&&amp;"]
    bodies = ["text &amp; &amp", "", "&quot;q&quot; &middot; &#8212; " * 20]
    got = same_on_pages(spark, tmp_path, "page_parse", [(i * 3 + k, f"http://h.org/{i}", page.format(t=t, b=b)) for i, t in enumerate(titles) for k, b in enumerate(bodies)])
    assert len(got) == len(titles) * len(bodies)
