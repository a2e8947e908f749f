import pytest

from strataweb.queries import ORACLES, QUERIES

from .conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, matches, name):
    assert matches(QUERIES[name](spark, SF), ORACLES[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_depths_have_no_bound(spark, tmp_path):
    """A chain of pages longer than a dozen."""
    rows = [(f"http://h{k:02}/", f'<a href="h{k + 1:02}">x</a>') for k in range(24)]
    spark.createDataFrame(rows, "url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.node: r.depth for r in QUERIES["bfs_depth"](spark, str(tmp_path)).collect()}
    assert got == {f"h{k:02}": k for k in range(25)}


def test_page_sightings(spark, tmp_path):
    """Hits of each bucket in the surfaces of pages."""
    html = "<style>p{margin:0}</style><p>p{0123456789abcdef} p{sixteen hexadecimal digits}</p>"
    spark.createDataFrame([("http://a/", html), ("http://b/", html), ("http://c/", "<p>none</p>")], "url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["sub"]: (r.n, r.strict, r.needs_review, r.ruled_out) for r in QUERIES["page_sightings"](spark, str(tmp_path)).collect()}
    assert got["raw"] == (2, 1, 1, 1)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
