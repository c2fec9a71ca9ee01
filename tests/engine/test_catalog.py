"""Every registered query against its oracle on the smallest tables."""

import duckdb
import pytest

from quire.plans import catalog, golden

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = catalog.REGISTRY.queries | golden.REGISTRY.queries
ORACLES = catalog.REGISTRY.oracles | golden.REGISTRY.oracles


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    cell = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DIR)
    rows = got.collect()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain(rows, got.columns) == plain(want.fetchall(), columns)


def test_html_clean_on_odd_pages(spark, tmp_path):
    """Cut entities, old names, other white space and entities that the SQL leaves alone."""
    pages = ["a &amp&am</title>p &ampp{x} &amp", "&amp;copy; &amp;amp; &copy &lt;b&gt; &#39; &nbsp;", "a  b \x0b c\x85\n\t", "", None, " <i\nclass=\"footnote\">1</i> x ", "<i>&quot;</i>&middot;"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = QUERIES["html_clean"](spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.clean) for r in got) == sorted(con.execute(ORACLES["html_clean"]).fetchall())
