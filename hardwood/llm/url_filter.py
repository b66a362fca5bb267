"""URL filters with redirect equivalence: block decisions reach all aliases of a page, allows come first.

Rules are ``host/path`` prefixes. A rule fits its host and all subdomains if the url's path starts with
the rule's path; the longest fitting rule wins. A url without a fitting rule takes the decision of its
class of aliases: connected components over redirect and canonical-link edges. Edges are

* the url and its canonical form (scheme, ``www.``/``m.``, a trailing slash, ``.html``, query and
  fragment are what sites redirect away),
* ``<link rel="canonical" href>`` and ``<meta http-equiv="refresh">`` targets found in the page's html,
  relative ones resolved against its ``<base href>`` or else its url,
* any further redirects given as a table ``(source, target)`` of urls.

A class with an explicitly allowed member is allowed, else one with a blocked member is blocked, else
allowed. All of it is DataFrame functions; decisions are aggregated per class before they are joined
back, so a hot class never meets in one task.

Null urls and urls without ``://`` have an empty host and path, fit no rule, and are allowed alone.
Rows that share a ``page_id`` each give a row. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import materialize

# The rules in force, as (verdict, rule).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    rule, verdict = F.coalesce(), F.coalesce()
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last that fits is the longest
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def canonical(host: Column, path: Column) -> Column:
    """The form that a site's own redirects lead to."""
    bare = F.regexp_replace(host, r"^(?:www|m)\.", "")
    plain = F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), r"/+$", "")
    return F.concat(F.lit("//"), bare, plain)


def links_in(html: Column) -> Column:
    """Targets, as written, that a page names as its canonical form or redirects to."""
    found = lambda p: F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(p), 1)
    return F.array_distinct(F.concat(
        found(r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?(?<![\w-])href\s*=\s*["']?\s*([^"'\s>]+)"""),
        found(r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?\s*([^"'\s>]+)""")))


def base_in(html: Column) -> Column:
    """The target of a page's first ``<base href>``; empty if it has none."""
    return F.coalesce(F.regexp_extract(html, r"""(?is)<base\b[^>]*?(?<![\w-])href\s*=\s*["']?\s*([^"'\s>]+)""", 1), F.lit(""))


def _without_dots(path: Column) -> Column:
    """A path that begins with ``/``, its segments ``.`` and ``..`` carried out."""
    up = lambda s, x: F.when(x == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).when(x == ".", s).otherwise(F.concat(s, F.array(x)))
    parts = F.split(F.substring(path, 2, 2**31 - 1), "/", -1)
    left = F.aggregate(parts, F.array().cast("array<string>"), up)
    end = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("/"), F.array_join(F.concat(left, end), "/"))


def resolve(target: Column, host: Column, path: Column) -> tuple[Column, Column]:
    """Host and path of a target that stands in a page at ``host`` and ``path``; nulls for ``mailto:`` and its like."""
    own = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    joined = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), own))
    whole = target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://")
    other = F.concat(F.lit(":"), target)
    to_host = F.when(whole, host_of(target)).when(target.startswith("//"), host_of(other)).when(~target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), host)
    to_path = F.when(whole, path_of(target)).when(target.startswith("//"), path_of(other)).when(own == "", path).otherwise(_without_dots(joined))
    return to_host, to_path


def judge_urls(pages: DataFrame, redirects: DataFrame | None = None, rules: tuple = RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict, alias)`` per row; alias is the smallest url of its class (null without ``://``)."""
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.instr(url, "://").alias("_at"),
                        links_in(F.col("html").cast("string")).alias("_links"), base_in(F.col("html").cast("string")).alias("_base"))
    node = canonical(F.col("host"), F.col("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", F.when(F.col("_at") > 0, node).alias("node"), rule.alias("rule"), verdict.alias("own"), "_links", "_base")
    rows = materialize(rows)
    to_node = lambda c: canonical(host_of(c), path_of(c))
    base = [F.coalesce(x, y) for x, y in zip(resolve(F.col("_base"), F.col("host"), F.col("path")), (F.col("host"), F.col("path")), strict=True)]
    linked = rows.where("size(_links) > 0 and node is not null").select("node", base[0].alias("host"), base[1].alias("path"), F.explode("_links").alias("t"))
    linked = linked.select(F.col("node").alias("a"), *[x.alias(k) for k, x in zip(("host", "path"), resolve(F.col("t"), F.col("host"), F.col("path")), strict=True)])
    edges = linked.where("host is not null").select("a", canonical(F.col("host"), F.col("path")).alias("b"))
    named = edges.select(F.col("b").alias("node"))
    if redirects is not None:
        more = redirects.where("source like '%://%' and target like '%://%'").select("source", "target")
        edges = edges.unionByName(more.select(to_node(F.col("source")).alias("a"), to_node(F.col("target")).alias("b")))
    classes = components(edges).withColumnRenamed("component", "class")
    # decisions per canonical url first, then per class: each a combinable aggregation
    decided = rows.where("own is not null and node is not null").groupBy("node").agg(
        F.max(F.col("own") == "allow").alias("allow"), F.max(F.col("own") == "block").alias("block"))
    others = [named] if redirects is None else [named, more.select(to_node(F.col("source")).alias("node")), more.select(to_node(F.col("target")).alias("node"))]
    for o in others:  # a target that is itself no page still decides by its own rule
        at = F.split_part(F.substring("node", 3, 2**31 - 1), F.lit("/"), F.lit(1))
        p = F.expr("substring(node, 3 + length(split_part(substring(node, 3), '/', 1)))")
        v = fitting_rule(at, p, rules)[1]
        decided = decided.unionByName(o.distinct().select("node", v.alias("v")).where("v is not null").select("node", (F.col("v") == "allow").alias("allow"), (F.col("v") == "block").alias("block")))
    decided = decided.join(classes, "node", "left").groupBy(F.coalesce("class", "node").alias("class")).agg(F.max("allow").alias("allow"), F.max("block").alias("block"))
    out = rows.drop("_links", "_base").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")).join(decided, "class", "left")
    return out.select("page_id", "host", "path", "rule", F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("allow"), "allow").when(F.col("block"), "block").otherwise("allow").alias("verdict"),
                      F.col("class").alias("alias"))


def keep_allowed(pages: DataFrame, redirects: DataFrame | None = None, rules: tuple = RULES) -> DataFrame:
    """The rows whose url is not blocked, each judged by itself, whatever its ``page_id``."""
    rows = pages.select(F.struct(*pages.columns).alias("page_id"), "url", *(["html"] if "html" in pages.columns else []))
    kept = judge_urls(rows, redirects, rules).where("verdict <> 'block'")
    return kept.select(*[F.col("page_id")[c].alias(c) for c in pages.columns])


# In the pages table no html names another url, so classes are those of the canonical form.
SQL = r"""
WITH u AS (SELECT page_id, url, strpos(url, '://') AS pos FROM pages),
p AS (SELECT page_id, coalesce(pos, 0) > 0 AS ok,
        coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(kind, rule, h, p) AS (VALUES ('block','com/en/','com','/en/'), ('allow','example.com/en/7','example.com','/en/7'), ('block','net/de/','net','/de/'),
        ('block','example.net/de/8','example.net','/de/8'), ('block','org/es/','org','/es/')),
f AS (SELECT p.*, '//' || regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '\.html?$', ''), '/+$', '') AS node,
        (SELECT arg_max(struct_pack(kind := r.kind, rule := r.rule), length(r.rule)) FROM r WHERE (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)) AS hit FROM p),
d AS (SELECT *, bool_or(ok AND hit.kind = 'allow') OVER (PARTITION BY node, ok) AS al, bool_or(ok AND hit.kind = 'block') OVER (PARTITION BY node, ok) AS bl FROM f)
SELECT page_id, host, path, hit.rule AS rule,
       CASE WHEN hit.kind IS NOT NULL THEN hit.kind WHEN coalesce(al, false) THEN 'allow' WHEN coalesce(bl, false) THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN ok THEN node END AS alias
FROM d
"""
