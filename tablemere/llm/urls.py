"""URL filter rules and redirect equivalence, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemere.llm.common import checkpoint, let
from tablemere.llm.components import connected_components

#: Most rules that are tested one after another; longer lists are joined on the host.
INLINE_RULES = 200
#: Most rules whose joined list is broadcast (about 100 bytes each).
BROADCAST_RULES = 100_000
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_COMMENT = r"(?s)<!--.*?(?:-->|\z)"
_TAG = r"""(?i)<(?:link|meta|base)\b(?:[^>"']|"[^"]*"|'[^']*')*>"""
_HREF = r"""(?is)\bhref\s*=\s*(?:"\s*([^"]*)"|'\s*([^']*)'|([^"'\s>]+))"""
_IS_BASE = r"(?i)^<base\b"
_IS_CANONICAL = r"""(?is)^<link\b.*\brel\s*=\s*(?:"[^"]*\bcanonical\b|'[^']*\bcanonical\b|canonical\b)"""
_IS_REFRESH = r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?\s*refresh\b"""
_REFRESH = (
    r"""(?is)\bcontent\s*=\s*(?:"[^"]*?\burl\s*=\s*'?\s*([^"'\s]+)|'[^']*?\burl\s*=\s*"?\s*([^"'\s]+)|[^"'\s>]*?\burl\s*=\s*([^"'\s>]+))"""
)
_NAMED = {"amp;": "&", "lt;": "<", "gt;": ">", "quot;": '"', "apos;": "'"}


@dataclass(frozen=True)
class UrlRule:
    """``action`` is allow or block; fits ``host`` and its subdomains below ``path``."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/ ? #``, A-Z lowered; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _ordered(rules: list[UrlRule]) -> list[UrlRule]:
    """Longest first; of equal texts allow first."""
    return sorted(rules, key=lambda r: (-len(r.text), r.action != "allow", r.text))


def _fits(rule: UrlRule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def with_rules(urls: DataFrame, rules: list[UrlRule], host: str = "host", path: str = "path") -> DataFrame:
    """``urls`` with ``rule`` and ``action`` of the longest rule that fits, else null."""
    if len(rules) <= INLINE_RULES:
        rule = action = F.lit(None).cast("string")
        for r in reversed(_ordered(rules)):
            fits = _fits(r, F.col(host), F.col(path))
            rule, action = F.when(fits, r.text).otherwise(rule), F.when(fits, r.action).otherwise(action)
        return urls.withColumn("rule", rule).withColumn("action", action)
    spark = urls.sparkSession
    ranked = [(r.host, r.path, r.text, r.action, -k) for k, r in enumerate(_ordered(rules))]
    table = spark.createDataFrame(ranked, "rule_host string, rule_path string, rule string, action string, rank long")
    table = F.broadcast(table) if len(rules) <= BROADCAST_RULES else table.hint("merge")
    parts = F.split(F.col("h"), r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    places = urls.select(F.col(host).alias("h"), F.col(path).alias("p")).distinct()
    found = (
        places.withColumn("rule_host", F.explode(tails))
        .join(table, "rule_host")
        .where(F.col("p").startswith(F.col("rule_path")))
        .groupBy("h", "p")
        .agg(F.max_by(F.struct("rule", "action"), "rank").alias("r"))
        .select("h", "p", "r.rule", "r.action")
    )
    return urls.join(found, (F.col(host) == F.col("h")) & (F.col(path) == F.col("p")), "left").drop("h", "p")


def _without_dots(path: Column) -> Column:
    """RFC 3986, 5.2.4: a path without its segments ``.`` and ``..``."""
    up = lambda kept: F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
    step = lambda kept, x: F.when(x == ".", kept).when(x == "..", up(kept)).otherwise(F.concat(kept, F.array(x)))

    def made(p: Column) -> Column:
        kept = F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step)
        out = F.concat(F.array_join(kept, "/"), F.when(p.rlike(r"/\.\.?$"), "/").otherwise(""))
        return F.when(p.rlike(r"^/(.*/)?\.\.?(/|$)"), out).otherwise(p)

    return let(path, made)


def _node(url: Column) -> Column:
    """A url's identity: host, path without dot segments and query, without scheme and fragment; null if it has no host."""

    def made(u: Column) -> Column:
        query = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)
        return let(host_of(u), lambda h: F.when(h != "", F.concat(h, _without_dots(path_of(u)), query)))

    return let(url, made)


def _unescaped(text: Column) -> Column:
    """``text`` with numeric HTML entities and those of the five markup signs decoded once."""
    entity = r"^#([xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});?"

    def numbered(part: Column, number: Column) -> Column:
        code = F.when(number.rlike("^[xX]"), F.conv(F.substring(number, 2, 6), 16, 10)).otherwise(number).cast("int")

        def sign(c: Column) -> Column:
            char = F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
            known = ((c > 0) & (c < 0xD800)) | ((c > 0xDFFF) & (c <= 0x10FFFF))
            return F.when(known, F.concat(char, F.regexp_replace(part, entity, ""))).otherwise(F.concat(F.lit("&"), part))

        return let(code, sign)

    def decoded(part: Column) -> Column:
        out = F.when(part.rlike(entity), let(F.regexp_extract(part, entity, 1), lambda n: numbered(part, n)))
        for name, c in _NAMED.items():
            out = out.when(part.startswith(name), F.concat(F.lit(c), F.substring(part, len(name) + 1, 1 << 30)))
        return out.otherwise(F.concat(F.lit("&"), part))

    def made(t: Column) -> Column:
        parts = F.split(t, "&")
        joined = F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, 1 << 30), decoded), ""))
        return F.when(t.contains("&"), joined).otherwise(t)

    return let(text, made)


def _resolved(base: Column, target: Column) -> Column:
    """RFC 3986, 5.2: the address that ``target`` names on the page ``base``, without fragment."""

    def full(b: Column, t: Column) -> Column:
        root = F.regexp_extract(b, r"(?s)^(.*?://[^/?#]*)", 1)
        path, query = F.regexp_extract(t, r"(?s)^([^?#]*)", 1), F.regexp_extract(t, r"(?s)^[^?#]*(\?[^#]*)", 1)
        folder = F.when(path_of(b) == "", "/").otherwise(F.regexp_extract(path_of(b), r"(?s)^(.*/)", 1))
        return (
            F.when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), t)
            .when(t.startswith("//"), F.concat(F.lit("http:"), t))
            .when(root == "", F.lit(None))
            .when((path == "") & (query == ""), F.regexp_extract(b, r"(?s)^([^#]*)", 1))
            .when(path == "", F.concat(root, path_of(b), query))
            .when(t.startswith("/"), F.concat(root, path, query))
            .otherwise(F.concat(root, folder, path, query))
        )

    def clean(u: Column) -> Column:
        start = F.regexp_extract(u, r"(?s)^(.*?://[^/?#]*)", 1)
        rest = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)
        return F.when(start != "", F.concat(start, _without_dots(path_of(u)), rest))

    return let(base, lambda b: let(target, lambda t: let(full(b, t), clean)))


def _first_group(text: Column, pattern: str) -> Column:
    return F.concat(*[F.regexp_extract(text, pattern, k) for k in (1, 2, 3)])


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b, a_url, b_url) from each page to each of its canonical and refresh targets.

    Comments hold no links. Targets have their HTML entities decoded and are
    resolved against the page's ``base`` address if it names one, else against its url.
    """
    trimmed = lambda t: F.regexp_replace(_unescaped(t), r"""^["'\s]+|["'\s]+$""", "")
    tags = F.regexp_extract_all(F.regexp_replace(F.col(html), _COMMENT, ""), F.lit(_TAG), F.lit(0))
    found = pages.where(F.col(html).rlike(r"(?i)canonical|refresh")).select(F.col(url).alias("a_url"), tags.alias("tags"))

    def ends(a: Column, tag: Column, base: Column) -> Column:
        target = F.when(tag.rlike(_IS_CANONICAL), _first_group(tag, _HREF)).when(tag.rlike(_IS_REFRESH), _first_group(tag, _REFRESH))
        return let(
            F.when(target != "", _resolved(base, trimmed(target))),
            lambda b: F.struct(_node(a).alias("a"), _node(b).alias("b"), a.alias("a_url"), b.alias("b_url")),
        )

    def of_page(a: Column, tags: Column) -> Column:
        named = F.get(F.filter(tags, lambda t: t.rlike(_IS_BASE) & t.rlike(_HREF)), 0)
        base = F.coalesce(_resolved(a, trimmed(_first_group(named, _HREF))), a)
        return let(base, lambda b: F.transform(F.filter(tags, lambda t: ~t.rlike(_IS_BASE)), lambda t: ends(a, t, b)))

    # one expression whose parts are bound once: filters on it must not be pushed into it
    return (
        found.select(F.explode(of_page(F.col("a_url"), F.col("tags"))).alias("e"))
        .select("e.*")
        .where("a is not null and b is not null and a <> b")
    )


def judge(
    pages: DataFrame, rules: list[UrlRule], redirects: DataFrame | None = None,
    page_id: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every page.

    A page under a rule gets the longest rule's verdict. Any other is judged
    with its aliases: urls joined by canonical links, refresh links and the
    ``redirects`` table (from_url, to_url), transitively. If a rule allows one
    of them the page is allowed; else if a rule blocks one it is blocked; else
    it is allowed. Null urls have empty host and path, no alias and no rule;
    null html has no link; very long urls and html are read whole; repeated
    pages keep their rows; of rules as long as each other allow wins; an empty
    table gives none. Other columns are not read.
    """
    edges = link_edges(pages, url, html)
    if redirects is not None:
        named = redirects.select(F.col("from_url").alias("a_url"), F.col("to_url").alias("b_url"))
        edges = edges.union(
            named.select(_node(F.col("a_url")).alias("a"), _node(F.col("b_url")).alias("b"), "a_url", "b_url")
            .where("a is not null and b is not null and a <> b")
        )
    placed = with_rules(
        pages.select(page_id, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), _node(F.col(url)).alias("node")),
        rules,
    )
    edges = checkpoint(edges)
    if edges.isEmpty():
        return placed.select(page_id, "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"))
    ends = edges.select(F.col("a").alias("node"), F.col("a_url").alias("u")).union(edges.select("b", "b_url")).distinct()
    ruled = with_rules(ends.select("node", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path")), rules)
    groups = connected_components(edges, "a", "b")
    decided = checkpoint(
        ruled.where("action is not null").join(groups, "node").groupBy("component").agg(F.min("action").alias("passed"))
    )  # allow sorts before block
    passed = groups.join(decided, "component").select("node", "passed")
    return placed.join(checkpoint(passed), "node", "left").select(
        page_id, "host", "path", "rule", F.coalesce("action", "passed", F.lit("allow")).alias("verdict")
    )


#: The query's rules: fixed values.
QUERY_RULES = [
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
]

#: Holds where no page names a canonical or refresh target, as in the generated tables.
ORACLE_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS s FROM pages),
p AS (SELECT page_id, translate(regexp_extract(s, '^[\s\S]*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(s, '^[\s\S]*?://([^/?#]*)([^?#]*)', 2) AS path FROM u),
k(action, h, q) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                          ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
f AS (SELECT page_id, p.host, p.path, h || q AS rule, action,
      row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC, action) AS n
      FROM p LEFT JOIN k ON (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, q))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM f WHERE n = 1
"""
