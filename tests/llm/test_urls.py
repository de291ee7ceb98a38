import re

import pytest

from tablemere.llm import urls
from tablemere.llm.urls import UrlRule

URLS = [
    "https://www.example.com/en/1", "http://example.com/en/2?x=1", "http://EXAMPLE.com/EN/3", "http://a.example.com/en/4#t", "http://x.com", "http://x.com/",
    "http://x.net/es/5", "http://x.net/fr/", "http://x.net/en/", "ftp://x.org/a://b/c", "no scheme", None, "://h.net/fr/x", "http://", "http://notexample.com/en/",
    "http://user@h.com:80/en/?q", "http://comm/", "http://com/x", "a://b\nc/d", "http://example.com?/en/",
]


def judged(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = min(fits, key=lambda r: (-len(r.text), r.action), default=None)
    return host, path, best.text if best else None, best.action if best else "allow"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, "<p>x</p>") for i, u in enumerate(URLS)], "page_id long, url string, html string")


def test_rules(pages):
    for r in urls.judge(pages, urls.QUERY_RULES).collect():
        assert tuple(r)[1:] == judged(URLS[r["page_id"]], urls.QUERY_RULES)


def test_many_rules_are_joined(pages, monkeypatch):
    more = [*urls.QUERY_RULES, UrlRule("block", "com", "/"), *(UrlRule("block", f"h{i}.org", "/") for i in range(300)), UrlRule("block", "org", "/a")]
    for limit in (urls.BROADCAST_RULES, 0):
        monkeypatch.setattr(urls, "BROADCAST_RULES", limit)
        for r in urls.judge(pages, more).collect():
            assert tuple(r)[1:] == judged(URLS[r["page_id"]], more)


def link(href, kind="canonical"):
    if kind == "canonical":
        return f"<head><LINK data-x='1' href='{href}' rel=canonical></head>"
    return f'<meta http-equiv="Refresh" content="0; URL={href}">'


def test_aliases(spark):
    rules = [UrlRule("block", "bad.org", "/"), UrlRule("allow", "good.org", "/")]
    rows = [
        (1, "http://a.org/1", link("https://bad.org/x#frag")),  # blocked through its canonical
        (2, "https://b.org/2", link("http://a.org/1", "refresh")),  # through two links
        (3, "http://bad.org/x", ""), (4, "http://good.org/y", link("http://bad.org/x")),  # its own rules
        (5, "http://c.org/", link("http://good.org/z")), (6, "http://c.org/z", link("/")),  # allowed, one by a relative link
        (7, "http://d.org/", link("http://e.org/")), (8, "http://f.org/", ""), (9, "http://f.org/", None), (10, None, link("http://bad.org/q")),
        (11, "http://g.org/", ""), (12, "http://h.org/", link("")), (12, "http://h.org/", link("other.html")), (13, "http://i.org/#top", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS node", "1 AS host", "2 AS component")
    redirects = spark.createDataFrame([("http://g.org/", "http://bad.org/r"), (None, "http://bad.org/r"), ("http://i.org/", "http://bad.org/r")], "from_url string, to_url string")
    got = sorted((r["page_id"], r["verdict"]) for r in urls.judge(pages, rules, redirects).collect())
    # 4 joins good.org to bad.org: an explicit allow among the aliases precedes the block
    assert got == [
        (1, "allow"), (2, "allow"), (3, "block"), (4, "allow"), (5, "allow"), (6, "allow"), (7, "allow"), (8, "allow"), (9, "allow"),
        (10, "allow"), (11, "block"), (12, "allow"), (12, "allow"), (13, "block"),
    ]
    without = pages.where("page_id <> 4")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(without, rules).collect()}
    assert [got[i] for i in (1, 2, 3, 5, 6, 7, 8, 11)] == ["block", "block", "block", "allow", "allow", "allow", "allow", "allow"]
    assert urls.judge(pages.limit(0), rules).count() == 0


def test_plan_is_native(pages):
    assert not re.search("Python|Pandas|Arrow", urls.judge(pages, urls.QUERY_RULES)._jdf.queryExecution().toString())
