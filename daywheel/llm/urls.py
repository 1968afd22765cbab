"""URL filters with redirect equivalence, with DataFrame functions only.

Rules decide the URLs they fit. Redirects (meta refresh) and canonical links of the pages' HTML, and any further edges
that are given, make URLs aliases of each other; connected components over these edges carry block decisions to aliases
that no rule fits. An explicit allow takes precedence: a URL that an allow rule fits stays allowed, and a class that
holds an explicitly allowed URL isn't blocked through its other members.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end.
In the graph URLs are told apart by scheme and host in lower case, path with its dot segments resolved (`/` if empty) and
query; the fragment is dropped. Links are resolved against their page's base; those of other schemes (`mailto:`) are
none. Comments, scripts, styles, text areas, titles and quoted values hold no links.
Defined results: a null URL, or one without `://`, has empty host and path, no rule fits it and it is allowed; among the
rules that fit the longest (host and path together) wins, allow before block; all canonical links and refreshes of a
page count; rows that repeat give a row each; an empty table gives an empty result; further columns pass through
(internal columns start with `__uf_`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, let, salted_join, small_side
from .components import components

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Up to so many rules are written into the plan; more are joined by host suffix.
INLINE_RULES = 64

#: Blank characters of HTML.
_B = r"[ \t\r\n\f]"
_QUOTED = """(?:"[^"]*+"|'[^']*+')"""
_RAW = "|".join(rf"<{name}(?:{_B}|[/>]).*?(?:</{name}(?:{_B}|[/>])|\z)" for name in ("script", "style", "textarea", "title"))
_INNER = rf"""(?:[^>"']*+)(?:{_QUOTED}[^>"']*+)*+>"""
#: What a page consists of, besides text: comments and elements whose content isn't markup, as wholes, and tags with their
#: quoted values; a tag that isn't closed takes the rest. What lies within one of them isn't found by itself. For engines
#: without possessive repetition: `*` for `*+`.
MARKUP = rf"""(?is)<!--(?:-?>|.*?(?:--!?>|\z))|{_RAW}|<[a-z/](?:{_INNER}|.*\z)"""
WANTED = rf"(?is)^<(?:link|meta|base)(?:{_B}|/){_INNER}\z"
ATTRIBUTE = rf"""[^ \t\r\n\f"'<>/=]++{_B}*+={_B}*+(?:{_QUOTED}|[^ \t\r\n\f"'>]++)"""
#: What an attribute has around its value.
BARE = rf"""(?s)^[^=]*={_B}*["']?{_B}*|{_B}*["']?\z"""
#: Of a refresh's content what follows the seconds.
AFTER_SECONDS = rf"(?is)^{_B}*[0-9.]*{_B}*[;,]?{_B}*(?:url{_B}*={_B}*)?(.*)$"
DOTS = r"/\.\.?(?:/|\z)"
AMPERSAND = "&(?:amp|#38|#x26|#X26);"


def _rest(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def resolved(path: Column) -> Column:
    """A path without its dot segments; `/` if it is empty."""

    def fold(segments: Column) -> Column:
        def step(out: Column, x: Column) -> Column:
            return F.when(x == ".", out).when(x == "..", F.regexp_replace(out, r"/[^/]*\z", "")).otherwise(F.concat(out, F.lit("/"), x))

        out = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), F.lit(""), step)
        return F.concat(out, F.when(F.get(segments, F.size(segments) - 1).isin(".", "..") | (out == ""), F.lit("/")).otherwise(F.lit("")))

    return F.when(path.rlike(DOTS), let(F.split(path, "/"), fold)).when(path == "", F.lit("/")).otherwise(path)


def node_of(url: Column) -> Column:
    """What tells URLs apart in the graph."""
    scheme = F.translate(F.substring(url, F.lit(1), F.instr(url, "://") - 1), UPPER, LOWER)
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(scheme, F.lit("://"), host_of(url), resolved(path_of(url)), query))


def absolute(target: Column, base: Column) -> Column:
    """A link's target seen from the page base; null for what isn't a page."""
    t = F.regexp_replace(F.regexp_replace(target, AMPERSAND, "&"), "#.*", "")
    origin = F.regexp_extract(base, r"^([^:]*://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(base), r"^(.*/)", 1)
    return (
        F.when(t == "", None)
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t)
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(t.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:]*:)", 1), t))
        .when(t.startswith("/"), F.concat(origin, t))
        .when(t.startswith("?"), F.concat(origin, path_of(base), t))
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), t))
    )


def attribute(attributes: Column, name: str) -> Column:
    """The first value of this name among a tag's attributes, without quotes and outer blanks; null if there is none."""
    found = F.get(F.filter(attributes, lambda x: x.rlike(rf"(?i)^{name}{_B}*=")), F.lit(0))
    return F.regexp_replace(found, BARE, "")


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst): the canonical links and meta refreshes of each page, as nodes, resolved against its base."""
    rows = pages.where(F.contains(F.col(url), F.lit("://")) & F.col(html).rlike("(?i)canonical|refresh"))
    tags = F.filter(F.regexp_extract_all(F.col(html), F.lit(MARKUP), F.lit(0)), lambda x: x.rlike(WANTED))
    listed = lambda tag: F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0))

    def with_base(found: Column) -> Column:
        bases = F.filter(F.transform(F.filter(found, lambda x: x.rlike("(?i)^<base")), lambda x: attribute(listed(x), "href")), lambda x: x.isNotNull())
        return F.struct(found.alias("tags"), F.get(bases, F.lit(0)).alias("base"))

    # The base is taken before the tags become rows, lest each row carry all tags. The few links are cut off twice: filters
    # are pushed down through steps by copying what they use, which here would copy it again with every step.
    rows = rows.select(F.col(url).alias("__uf_page"), let(tags, with_base).alias("__uf_both"))
    rows = rows.select("__uf_page", F.col("__uf_both.base").alias("__uf_base"), F.explode("__uf_both.tags").alias("__uf_tag"))
    rows = rows.select("__uf_page", "__uf_base", "__uf_tag", listed(F.col("__uf_tag")).alias("__uf_listed"))
    value = lambda name: attribute(F.col("__uf_listed"), name)
    words = F.split(F.translate(value("rel"), UPPER, LOWER), f"{_B}+")
    link = F.when(F.col("__uf_tag").rlike("(?i)^<link") & F.array_contains(words, "canonical"), value("href"))
    refresh = F.col("__uf_tag").rlike("(?i)^<meta") & (F.translate(value("http-equiv"), UPPER, LOWER) == "refresh")
    refresh = F.when(refresh, F.regexp_extract(value("content"), AFTER_SECONDS, 1))
    rows = cut(rows.select("__uf_page", "__uf_base", link.alias("__uf_link"), refresh.alias("__uf_rest")))
    rows = rows.where("__uf_link is not null or __uf_rest is not null")
    rest = F.col("__uf_rest")
    rest = F.when(rest.startswith("'"), F.get(F.split(rest, "'"), F.lit(1))).when(rest.startswith('"'), F.get(F.split(rest, '"'), F.lit(1))).otherwise(rest)
    target = F.regexp_replace(F.regexp_replace(F.coalesce("__uf_link", rest), r"[\t\r\n]", ""), r"^ +| +\z", "")
    base = F.coalesce(absolute(F.col("__uf_base"), F.col("__uf_page")), F.col("__uf_page"))
    rows = cut(rows.select("__uf_page", base.alias("__uf_base"), target.alias("__uf_target")))
    rows = rows.select("__uf_page", absolute(F.col("__uf_target"), F.col("__uf_base")).alias("__uf_target"))
    return rows.select(node_of(F.col("__uf_page")).alias("src"), node_of(F.col("__uf_target")).alias("dst")).where("src != dst")


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host == rule_host) | F.endswith(host, F.concat(F.lit("."), rule_host))) & F.startswith(path, rule_path)


def _rank(rule_host: Column, rule_path: Column, verdict: Column) -> Column:
    """Longest first, allow before block, then by text."""
    name = F.concat(rule_host, rule_path)
    return F.struct(F.length(name).alias("len"), (verdict == "allow").cast("int").alias("a"), name.alias("rule"), verdict.alias("verdict"))


def with_rules(rows: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """rows (with __uf_host, __uf_path) with __uf_rule: struct of the winning rule, or null."""
    host, path = F.col("__uf_host"), F.col("__uf_path")
    if len(rules) <= INLINE_RULES:
        won = [F.when(_fits(host, path, F.lit(h), F.lit(p)), _rank(F.lit(h), F.lit(p), F.lit(v))) for v, h, p in rules]
        nothing = F.lit(None).cast("struct<len:int,a:int,rule:string,verdict:string>")
        best = F.greatest(nothing, nothing, *won)
        return rows.withColumn("__uf_rule", best)
    spark = rows.sparkSession
    table = spark.createDataFrame([tuple(r) for r in rules], "verdict string, rule_host string, rule_path string")
    side, _ = small_side(table)
    keys = rows.select("__uf_host", "__uf_path").distinct()
    labels = F.split(host, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = keys.withColumn("rule_host", F.explode(tails)).join(side, "rule_host").where(F.startswith(path, F.col("rule_path")))
    best = hits.groupBy("__uf_host", "__uf_path").agg(F.max(_rank(F.col("rule_host"), F.col("rule_path"), F.col("verdict"))).alias("__uf_rule"))
    return rows.join(best, ["__uf_host", "__uf_path"], "left")


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, url: str = "url", html: str | None = "html", edges: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict. edges: further (src, dst) URLs, such as a redirect log."""
    found = [link_edges(pages, url, html)] if html else []
    if edges is not None:
        found.append(edges.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")))
    rows = pages.withColumn("__uf_host", host_of(F.col(url))).withColumn("__uf_path", path_of(F.col(url)))
    rows = with_rules(rows, rules)
    blocked = F.lit(False)
    if found:
        graph = found[0] if len(found) == 1 else found[0].union(found[1])
        classes = cut(components(graph))
        nodes = with_rules(classes.withColumn("__uf_host", host_of(F.col("node"))).withColumn("__uf_path", path_of(F.col("node"))), rules)
        says = nodes.groupBy("label").agg(F.max((F.col("__uf_rule.verdict") == "block").cast("int")).alias("b"), F.max((F.col("__uf_rule.verdict") == "allow").cast("int")).alias("a"))
        says = cut(says.where("b = 1 and coalesce(a, 0) = 0").select("label", F.lit(True).alias("__uf_shut")))
        side, small = small_side(says)
        members = classes.join(side, "label") if small else salted_join(classes, says, "label").where("__uf_shut")
        bad = cut(members.select(F.col("node").alias("__uf_node"), F.lit(True).alias("__uf_bad")))
        side, small = small_side(bad)
        rows = rows.withColumn("__uf_node", node_of(F.col(url)))
        rows = (rows.join(side, "__uf_node", "left") if small else salted_join(rows, bad, "__uf_node")).drop("__uf_node")
        blocked = F.col("__uf_bad").isNotNull()
    verdict = F.coalesce(F.col("__uf_rule.verdict"), F.when(blocked, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select(*[F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")], F.col("__uf_host").alias("host"), F.col("__uf_path").alias("path"), F.col("__uf_rule.rule").alias("rule"), verdict.alias("verdict"))
