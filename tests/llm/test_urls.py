"""op8: parsing, rules, and exactness of the cascade."""

from slidegrid.llm import urls as U

URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/1?x=/de/", "https://example.org/en/12", "https://example.org/en/2#f", "ftp://a.com/fr/", "x://com/de/9",
    "http://b.com?u=http://c.org/", "http://c.net/a#b?c", "http://notorg/x", "http://org/", "http://org", "http://c.net/a?utm_source=feed", "http://\u00c9.org/\u00e9",
]


def judged(spark, values, blocked):
    pages = spark.createDataFrame(list(enumerate(values)), "page_id long, url string")
    keys = spark.createDataFrame([(k,) for k in blocked], "key string")
    return [tuple(r)[1:] for r in sorted(U.judge(pages, keys).collect())]


def test_parts_and_rules(spark):
    got = judged(spark, URLS, ["c.net/a"])
    assert [g[0] for g in got] == ["", "", "", "", "www.example.org", "example.org", "example.org", "a.com", "com", "b.com", "c.net", "notorg", "org", "org", "c.net", "\u00c9.org"]
    assert [g[1] for g in got] == ["", "", "", "", "/es/1", "/en/12", "/en/2", "/fr/", "/de/9", "", "/a", "/x", "/", "", "/a", "/\u00e9"]
    assert [g[2] for g in got] == [None] * 4 + ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, "org/", None, None, "org/"]
    assert [g[3] for g in got] == ["allow"] * 4 + ["block", "block", "allow", "allow", "block", "allow", "block", "allow", "allow", "allow", "block", "allow"]


def test_cascade_is_exact(spark):
    keys = spark.range(6000).selectExpr("concat('k', id) AS key", "id % 3 = 0 AS mine").union(spark.sql("SELECT CAST(NULL AS STRING), false"))
    wanted = keys.where("mine").select("key")
    for most in (U.MOST_BITS, 1 << 13):  # one segment, and several
        rows = U.listed(keys.unionByName(keys), wanted, most_bits=most)
        assert rows.where("listed != mine").count() == 0 and rows.count() == 12_002
    levels = U.cascade(keys.where("key IS NOT NULL").withColumnRenamed("mine", "listed"))
    assert len(levels) > 1  # false positives occurred and were encoded in turn


def test_nothing_listed(spark):
    assert {g[3] for g in judged(spark, ["http://a.net/x", None], [])} == {"allow"}
    assert judged(spark, [], []) == []


def test_contract_rules_literally():
    """The five rules as the contract words them."""
    assert {(r.verdict, r.host, r.path) for r in U.RULES} == {
        ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
    }


def test_repeats_clashing_columns_and_long_urls(spark):
    long = "http://a.example.org/en/1" + "x" * 200_000 + "?q"
    rows = [(i, u, "mine", "theirs") for i, u in enumerate([long, long, "http://b.net/k", "http://b.net/k", None])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, key string")
    got = sorted(U.judge(pages, spark.createDataFrame([("b.net/k",), ("b.net/k",)], "key string")).collect())
    assert [(g[3], g[4]) for g in got] == [("example.org/en/1", "block")] * 2 + [(None, "block")] * 2 + [(None, "allow")]
    assert len(got[0][2]) == 200_005
