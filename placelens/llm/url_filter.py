"""URL filters with redirect equivalence.

Method: pages are nodes (host and path); redirects (meta refresh) and canonical
links are edges. A rule decides the pages it fits. Connected components over the
edges hand a block to aliases that no rule fits; an explicit allow on any alias
takes precedence, and a page's own rule is never overruled. Everything is DataFrame
expressions.

A page's node is its host, path and query; fragments do not count.

Defined results: a null url, or one without ``://``, has an empty host and path, no
rule, no aliases and is allowed; null html has no links; repeated rows keep their
rows; empty tables give empty tables. Only page_id, url and html are read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from placelens.operators.graph import components
from placelens.operators.tables import salted_join
from placelens.scratch import materialize


class Rule(NamedTuple):
    """A host with its subdomains and the start of a path."""

    verdict: str
    host: str
    path: str


# The rules.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    """From the first ? up to # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null: none), and its verdict."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: len(r.host + r.path), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.host + r.path) if name is None else name.when(fits, r.host + r.path)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return name, verdict


# The rest of a tag: quotes count behind an equals sign only. Possessive, so that long tags are read in a loop.
ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
# Comments, elements of plain text and all other tags are read over; group 2 is a tag that may hold a link.
TAGS = (
    r"(?is)<!---?>|<!--.*?(?:--!?>|\z)"
    rf"|<(script|style|title|textarea|xmp|iframe|noembed|noframes)(?=[\s/>]){ATTRIBUTES}>.*?(?:</\1(?=[\s/>])|\z)"
    rf"|(<(?:link|meta|base)(?=[\s/]){ATTRIBUTES}(?:>|\z))"
    rf"|</?[a-z]{ATTRIBUTES}(?:>|\z)"
)
ATTRIBUTE = r"""(?s)(?<=[\s"'/])([^\s"'<>/=]++)\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]++)"""
REFRESH = r"""(?is)^\s*(?:[\d.]+(?:\s*[;,]\s*|\s+)|(?=url\s*=))(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|(.*))"""


def node(host: Column, path: Column, query: Column) -> Column:
    return F.concat(host, F.when(path == "", "/").otherwise(path), query)


# Named character references that stand for what urls are made of.
REFERENCES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "Tab": "\t", "NewLine": "\n", "excl": "!", "num": "#", "dollar": "$", "percnt": "%", "lpar": "(", "rpar": ")", "ast": "*",
    "plus": "+", "comma": ",", "period": ".", "sol": "/", "colon": ":", "semi": ";", "equals": "=", "quest": "?", "commat": "@", "lsqb": "[", "rsqb": "]", "lowbar": "_", "bsol": "\\", "vert": "|",
}
# Some names count without a semicolon, unless a name or a value goes on behind them.
REFERENCE = rf"&(#[0-9]+|#[xX][0-9A-Fa-f]+|(?:{'|'.join(REFERENCES)})(?=;)|(?:amp|lt|gt|quot|nbsp)(?![=A-Za-z0-9;]));?"


def decoded(text: Column) -> Column:
    """``text`` with its character references, decimal, hexadecimal and named, replaced; numbers of no character become U+FFFD."""

    def one(name: Column) -> Column:
        hexadecimal = F.lower(name).startswith("#x")
        digits = F.regexp_replace(name, "^#[xX]?0*", "")
        # seven digits at most, so that the number has room
        number = F.when(F.length(digits) > 7, F.lit(-1)).when(hexadecimal, F.conv(digits, 16, 10).try_cast("int")).otherwise(digits.try_cast("int"))
        fits = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        char = F.when(fits, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("\ufffd")
        named = F.create_map(*(F.lit(x) for pair in REFERENCES.items() for x in pair))
        return F.when(name.startswith("#"), char).otherwise(F.try_element_at(named, name))

    gaps = F.split(text, REFERENCE, -1)
    found = F.concat(F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1)), one), F.array(F.lit("")))
    return F.when(text.contains("&"), F.array_join(F.zip_with(gaps, found, lambda a, b: F.concat(a, b)), "")).otherwise(text)


def attribute(tag: Column, name: str) -> Column:
    """The first value of an attribute without its quotes, as written; else null."""
    names, values = (F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(k)) for k in (1, 2))
    value = F.get(values, F.array_position(F.transform(names, F.lower), name).cast("int") - 1)
    return F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")


def target_of(tag: Column) -> Column:
    """(refresh, written): what a canonical link or a meta refresh says of where it leads; written is null for other tags."""
    rel = F.split(F.lower(attribute(tag, "rel")), r"\s+")
    canonical = F.lower(tag).startswith("<link") & F.array_contains(rel, "canonical")
    refreshes = F.lower(tag).startswith("<meta") & (F.lower(F.trim(attribute(tag, "http-equiv"))) == "refresh")
    written = F.when(canonical, attribute(tag, "href")).when(refreshes, attribute(tag, "content"))
    return F.struct(F.lower(tag).startswith("<meta").alias("refresh"), written.alias("written"))


def without_dots(path: Column) -> Column:
    """A path without the segments . and .."""
    steps = F.split(F.regexp_replace(path, "^/", ""), "/")
    back = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda done, s: F.when(s == ".", done).when(s == "..", back(done)).otherwise(F.concat(done, F.array(s))))
    joined = F.concat(F.lit("/"), F.array_join(walked, "/"))
    open_end = path.rlike(r"/\.\.?$") & (F.size(walked) > 0)
    return F.when(path.contains("/."), F.concat(joined, F.when(open_end, "/").otherwise(""))).otherwise(path)


def resolve(target: Column, host: Column, path: Column, query: Column) -> tuple[Column, Column, Column]:
    """Host, path and query of a target as seen from a page (RFC 3986); null where it is not a place of some host."""
    t = F.trim(F.regexp_replace(target, r"[\t\r\n]", ""))
    plain = F.regexp_extract(t, r"(?s)^([^?#]*)", 1)
    whole, network = t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t.startswith("//")
    other = t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    url = F.when(whole, t).when(network, F.concat(F.lit("http:"), t))
    beside = F.concat(F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1)), plain)
    there = F.when(plain == "", path).when(plain.startswith("/"), plain).otherwise(beside)
    far = whole | network
    same = (plain == "") & ~t.startswith("?") & ~far  # only a fragment
    return F.when(far, host_of(url)).when(~other, host), without_dots(F.when(far, path_of(url)).when(~other, there)), F.when(same, query).otherwise(query_of(t))


def links(pages: DataFrame) -> DataFrame:
    """(src, dst) nodes of canonical links and redirects anywhere in a page.

    Relative targets are resolved against the first base element that has a href, or
    else the page's url.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    found = pages.where("host <> ''").where(html.rlike("(?i)canonical|refresh"))
    own = ("host", "path", "query")
    tags = found.select(*own, "src", F.filter(F.regexp_extract_all(html, F.lit(TAGS), F.lit(2)), lambda t: t != "").alias("tags"))
    base = F.get(F.filter(F.transform(F.filter("tags", lambda t: F.lower(t).startswith("<base")), lambda t: attribute(t, "href")), lambda h: h.isNotNull()), F.lit(0))
    targets = F.filter(F.transform("tags", target_of), lambda t: t["written"].isNotNull())
    seen = tags.select(*own, "src", base.alias("base"), F.explode(targets).alias("t"))
    # written out, as what follows names base and value many times and the optimizer would repeat all of the above each time
    seen = materialize(seen.select(*own, "src", decoded(F.col("base")).alias("base"), "t.refresh", decoded(F.col("t.written")).alias("value")), "targets")
    address = F.concat(*(F.regexp_extract("value", REFRESH, k) for k in (1, 2, 3)))
    seen = seen.select(*own, "src", "base", F.when(F.col("refresh"), address).otherwise(F.col("value")).alias("target"))
    at = [F.coalesce(F.when(F.col("base").isNotNull(), b), F.col(c)).alias(c) for b, c in zip(resolve(F.col("base"), *map(F.col, own)), own)]
    seen = seen.select("src", "target", *at)
    ends = seen.select("src", "target", *(c.alias(k) for c, k in zip(resolve(F.col("target"), *map(F.col, own)), own))).where("target <> '' and host <> ''")
    return ends.select("src", node(*map(F.col, own)).alias("dst"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, source) of every page.

    ``redirects`` may add edges (src url, dst url). source tells where the verdict
    comes from: rule, alias or default.
    """
    url = F.col("url").cast("string")
    base = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), query_of(url).alias("query"), "html")
    # pages without a host are no node, and must not meet in one key
    nowhere = F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string"))
    base = base.withColumn("src", F.when(F.col("host") == "", nowhere).otherwise(node(F.col("host"), F.col("path"), F.col("query"))))
    edges = links(base)
    if redirects is not None:
        ends = [node(*(part(F.col(c).cast("string")) for part in (host_of, path_of, query_of))).alias(c) for c in ("src", "dst")]
        edges = edges.unionByName(redirects.select(*ends))
    edges = materialize(edges.where("src <> dst").distinct(), "links")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = base.select("page_id", "host", "path", "src", rule.alias("rule"), verdict.alias("own"))
    if edges.isEmpty():
        out = judged.withColumn("group", F.lit(None).cast("string"))
    else:
        alias = components(edges).withColumnsRenamed({"node": "src"})
        # nodes that only links name are judged as well: their rules count for their aliases
        at = F.substring_index("src", "/", 1)
        _, named = rule_of(at, F.expr("substring_index(substring(src, length(substring_index(src, '/', 1)) + 1), '?', 1)"), rules)
        known = alias.select("component", named.alias("own")).where("own is not null")
        group = known.groupBy("component").agg(F.min("own").alias("group"))  # allow sorts before block
        # one component may hold most nodes, one url most pages
        handed = salted_join(alias, group, "component").select("src", "group")
        out = salted_join(judged, handed, "src", "left")
    source = F.when(F.col("own").isNotNull(), "rule").when(F.col("group").isNotNull(), "alias").otherwise("default")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "group", F.lit("allow")).alias("verdict"), source.alias("source"))
