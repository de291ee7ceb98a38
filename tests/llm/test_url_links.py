import random
from urllib.parse import urldefrag, urljoin

from pyspark.sql import functions as F

from tablemere.llm import urls
from tablemere.llm.urls import UrlRule

BASE = "http://a.org/b/c/d;p?q=1"
REFS = ["g", "./g", "g/", "/g", "//g.org", "?y=2", "g?y", "g#s", ";x", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./g/.", "g/./h", "g/../h", "other.html"]


def test_references_are_resolved(spark):
    rows = [(u, r, urldefrag(urljoin(u, r))[0]) for u in (BASE, "http://a.org", "http://a.org/x") for r in REFS]
    df = spark.createDataFrame(rows, "base string, t string, want string")
    bad = [tuple(r) for r in df.select("base", "t", "want", urls._resolved(df.base, df.t).alias("got")).collect() if r["got"] != r["want"]]
    assert bad == []
    absolute = df.limit(1).select(urls._resolved(df.base, F.lit('https://x.org/a/../b?c'))).first()[0]
    assert absolute == 'https://x.org/b?c'  # by the RFC; urljoin leaves it


def test_each_form_of_link_carries_the_block(spark):
    forms = {
        "<link rel=canonical href='bad.html'>": "http://a.org/bad.html", "<link rel=canonical href='../bad'>": "http://b.org/bad", "<link rel='canonical' href='?p=2'>": "http://c.org/x/y?p=2",
        """<meta http-equiv="refresh" content="0; url='http://d.org/bad'">""": "http://d.org/bad", """<meta http-equiv=refresh content='0; url="http://e.org/bad"'>""": "http://e.org/bad",
        "<meta http-equiv=refresh content=0;url=http://f.org/bad>": "http://f.org/bad", "<meta http-equiv=refresh content='0; url=bad.html'>": "http://g.org/x/bad.html",
        "<link rel=canonical href='/bad?a=1&amp;b=2'>": "http://h.org/bad?a=1&b=2", "<link rel=canonical href='/bad?a=1&#38;b=2&#x26;c=&#233;'>": "http://i.org/bad?a=1&b=2&c=é",
        "<meta http-equiv=refresh content='0; url=&#39;http://j.org/bad&#39;'>": "http://j.org/bad",
    }
    rows, redirects = [], []
    for k, (html, target) in enumerate(forms.items()):
        rows.append((k, f"http://{'abcdefghij'[k]}.org/" + {0: ""}.get(k, "x/y"), html))
        redirects.append((target, f"http://blocked.net/{k}"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    moved = spark.createDataFrame(redirects, "from_url string, to_url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, [UrlRule("block", "blocked.net", "/")], moved).collect()}
    assert got == dict.fromkeys(range(len(forms)), "block")


def test_all_links_of_a_page_count_but_not_those_in_comments(spark):
    rows = [
        (1, "http://a.org/1", "<link rel=canonical href='http://a.org/x'><link rel=canonical href='http://bad.net/1'>"),
        (2, "http://b.org/2", "<!-- <link rel=canonical href='http://bad.net/2'> --><p>canonical</p>"),
        (3, "http://c.org/d/3", "<base href='http://bad.net/e/'><link rel='alternate canonical' href='3'>"),
        (4, "http://d.org/4", "<link title='a>b' rel=\"canonical\" href='http://bad.net/4'>"),
        (5, "http://e.org/5", "<p>x</p>" * 40_000 + "<meta content='1; url=http://bad.net/5' http-equiv=refresh>"),
        (6, "http://f.org/" + "y" * 200_000, "<link rel=canonical href='http://bad.net/6'>"), (7, "http://g.org/7", "<!-- canonical"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, [UrlRule("block", "bad.net", "/")]).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "block", 7: "allow"}


def slow_verdicts(rows, redirects, rules):
    """Verdicts by a plain search through the links of absolute addresses."""
    fit = lambda u: min((r for r in rules if u.split("/")[2] == r.host and ("/" + u.split("/", 3)[3]).startswith(r.path)), key=lambda r: (-len(r.text), r.action), default=None)
    near = {}
    for a, b in [(u, t) for _, u, ts in rows for t in ts] + redirects:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for i, u, _ in rows:
        seen, work = {u}, [u]
        while work:
            new = near.get(work.pop(), set()) - seen
            seen |= new
            work += new
        actions = {r.action for r in map(fit, seen) if r}
        out[i] = fit(u).action if fit(u) else "allow" if "allow" in actions or not actions else "block"
    return out


def test_generated_link_graphs(spark):
    rules = [UrlRule("block", "h0.net", "/0/"), UrlRule("allow", "h1.net", "/1"), UrlRule("block", "h1.net", "/"), UrlRule("block", "h2.net", "/2"), UrlRule("allow", "h2.net", "/22")]
    for seed in (1, 2):
        rng = random.Random(seed)
        name = lambda: f"http://h{rng.randrange(9)}.net/{rng.randrange(60)}/"
        known = [name() for _ in range(200)]
        rows = [(i, u, [rng.choice(known + [name()]) for _ in range(rng.choice((0, 0, 1, 1, 2)))]) for i, u in enumerate(known)]
        redirects = [(name(), rng.choice(known)) for _ in range(20)]
        html = lambda ts: "".join(f"<link rel=canonical href='{t}'>" if k % 2 else f'<meta http-equiv=refresh content="3;url={t}">' for k, t in enumerate(ts))
        pages = spark.createDataFrame([(i, u, html(ts)) for i, u, ts in rows], "page_id long, url string, html string")
        got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, rules, spark.createDataFrame(redirects, "from_url string, to_url string")).collect()}
        want = slow_verdicts(rows, redirects, rules)
        assert got == want and set(want.values()) == {"allow", "block"}
