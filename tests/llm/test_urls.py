import duckdb
import pytest

from txloom.llm import urls

CASES = [
    ("https://Example.NET/en/x", "example.net", "/en/x", "example.net/en/", "allow"), ("http://a.example.net/de/x", "a.example.net", "/de/x", "net/", "block"),
    ("http://example.com/de/1?q=/de/", "example.com", "/de/1", "example.com/de/", "block"), ("http://example.com/deutsch", "example.com", "/deutsch", None, "allow"),
    ("http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"), ("http://org/fr/a#b", "org", "/fr/a", "org/fr/", "allow"), ("http://forg/fr/a", "forg", "/fr/a", None, "allow"),
    ("http://x.net", "x.net", "", None, "allow"), ("http://x.net?a/", "x.net", "", None, "allow"), ("http://foo.com/a.net/", "foo.com", "/a.net/", None, "allow"),
    ("x.net/en/", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://myexample.net/en/", "myexample.net", "/en/", "net/", "block"),
    ("http://www.casino.example/x", "www.casino.example", "/x", None, "block"), ("http://a.b/wp-login.php?x", "a.b", "/wp-login.php", None, "block"), ("http://É.net/en/ü", "É.net", "/en/ü", "net/", "block"),
    ("a://b://c.net/", "b:", "//c.net/", None, "allow"), ("http://x.com/" + "a/" * 20_000, "x.com", "/" + "a/" * 20_000, None, "allow"),
]


def test_rules_and_oracle(spark, tmp_path):
    rows = [(i, c[0], "h", "clash") for i, c in enumerate(CASES)] + [(0, CASES[0][0], None, "clash")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, urls.op7_url_filter(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(i, *c[1:]) for i, c in enumerate(CASES)] + [(0, *CASES[0][1:])], key=repr)
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(c.sql(urls.OP7_SQL).fetchall(), key=repr) == got


def test_own_rules(spark):
    df = spark.createDataFrame([(1, "http://a.b/x"), (2, "http://q.b/track/1")], "page_id long, url string")
    got = urls.filter_urls(df, [("b/x", "allow"), ("b/", "block")], [(r"/track/", ["track"])], default="none").collect()
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in got} == {1: ("b/x", "allow"), 2: ("b/", "block")}
    assert {r["verdict"] for r in urls.filter_urls(df, [], [], default="none").collect()} == {"none"}
    assert urls.filter_urls(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        urls.filter_urls(df, [], [(r".*", [])])
