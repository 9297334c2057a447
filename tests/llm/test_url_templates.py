import pytest
from pyspark.sql import functions as F

from lakeloom.llm import url_templates as U
from lakeloom.llm.queries import ALLOW, BLOCK

CASES = [
    (None, "", "", None), ("no scheme", "", "", None), ("", "", "", None), ("http://", "", "", None),
    ("http://A.Example.NET/de/1?x#y", "a.example.net", "/de/1", "net/"), ("http://example.net/en/1", "example.net", "/en/1", "example.net/en/"),
    ("http://example.net/En/1", "example.net", "/En/1", "net/"), ("http://example.net", "example.net", "", None),
    ("x://y.org/fr/://z.net/", "y.org", "/fr/://z.net/", "org/fr/"), ("http://notexample.com/de/1", "notexample.com", "/de/1", None),
    ("http://m.example.com/de/", "m.example.com", "/de/", "example.com/de/"), ("http://ÄB.com#f", "Äb.com", "", None),
    ("http://a.net?x=/en/", "a.net", "", None), ("http://a.b\nc/d\ne", "a.b\nc", "/d\ne", None),
]


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, c[0], "h") for i, c in enumerate(CASES)], "page_id long, url string, host string")
    got = {r.page_id: r for r in U.judge(pages, BLOCK, ALLOW).collect()}
    for i, (_, host, path, rule) in enumerate(CASES):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), CASES[i]
        if rule:
            assert got[i].verdict == ("block" if rule in BLOCK else "allow")


def page(n, path, host="h.test"):
    return [(i, f"http://{host}{path.replace('#', str(i))}") for i in range(n)]


def test_templates_wildcards_and_purity(spark):
    urls = page(30, "/ads/x#/a") + page(30, "/ads/y#/a") + page(3, "/ads/promo#.html") + page(40, "/news/#") + page(40, "/news/#.html")
    urls += page(2, "/deadbeef01#0/v") + page(1, "/a/b/c/d/e/f") + page(1, "") + page(1, "/")
    rules = ["h.test/ads/x"]
    pages = spark.createDataFrame([(None if i == 0 else i, u) for i, (_, u) in enumerate(urls + urls[:5])], "page_id long, url string")
    rows = U.judge(pages, rules, []).collect()
    assert len(rows) == len(urls) + 5
    by_path = {r.path: r for r in rows}
    assert by_path["/news/3"].template == "/news/{n}" and by_path["/news/3.html"].template == "/news/{n}.html"
    assert by_path["/ads/y7/a"].template == "/ads/*/a" == by_path["/ads/x7/a"].template
    assert by_path["/deadbeef0100/v"].template == "/{id}/v" and by_path["/a/b/c/d/e/f"].template == "/a/b/c/d/**"
    assert by_path[""].template == "" and by_path["/"].template == "/"
    assert by_path["/ads/y7/a"].verdict == "block" and by_path["/news/3"].verdict == "allow"  # the rule's pages label its template


def test_alike_branches_merge_but_not_with_labelled_ones(spark):
    urls = [u for lang in ("en", "fr", "es", "de") for u in page(20, f"/{lang}/#")]
    got = {r.path: r for r in U.judge(spark.createDataFrame(urls, "page_id long, url string"), ["h.test/de/"], []).collect()}
    assert {got[f"/{x}/5"].template for x in ("en", "fr", "es")} == {"/*/{n}"}
    assert got["/de/5"].template == "/de/{n}" and got["/en/5"].verdict == "allow"


def test_no_rules_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://a/b"), (1, "http://a/b"), (None, None)], "page_id long, url string")
    assert [r.verdict for r in U.judge(pages, [], []).collect()] == ["allow"] * 3
    assert U.judge(pages.where("false"), BLOCK, ALLOW).collect() == []


def test_no_python_in_the_plan(spark):
    plan = U.judge(spark.createDataFrame([(1, "http://a/b")], "page_id long, url string"), BLOCK, ALLOW)
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rules", [["a.b/", "b/"], ["b/", "a.b/"]])
def test_the_longest_rule_wins(spark, rules):
    row = spark.range(1).select(U.rule_of(F.lit("x.a.b"), F.lit("/q"), rules).alias("r")).first()
    assert row.r == "a.b/"
