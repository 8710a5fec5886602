"""URL block and allow rules with redirect equivalence.

A url is judged by the longest rule that fits it. Urls without a rule take the decision of their
equivalence class: urls linked by redirects (meta refresh, or rows of a redirect table) and canonical
links form connected components, and a class with a blocked member blocks all its members that have no rule of
their own. An explicit allow has precedence for the urls that its rule fits, and for no others: were it to free
its whole class, any page under an allow rule could free a blocked page's aliases by naming one as canonical.
Everything else is allowed.

Links are read from all canonical and refresh tags outside of comments, with character references decoded, and resolved against
the page's base. Urls are one node if they agree in host, path (without dot segments; an empty one is /) and
query; scheme and fragment don't count.

Nulls and urls without `://` have an empty host and path, fit no rule, join no class and are allowed.
Repeated pages are judged alike, one row each. Empty tables give empty results. Only page_id, url and
html are read from pages, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terradrift.llm.common import BROADCAST_ROWS, Scratch, connected_components, lower_ascii

#: Rules given as a list of this length at most become one expression; more are joined.
INLINE_RULES = 256

Rule = tuple[str, str, str]  # host, path, allow or block


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and query with its question mark."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    part = lambda k: F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)(\?[^#]*)?", k)
    return lower_ascii(part(1)), part(2), part(3)


def _match_inline(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, decision in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):  # the longest is tested first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return urls.select("*", rule.alias("rule"), verdict.alias("rule_verdict"))


def _match_joined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for rules of any number: host suffixes are joined to the rules' hosts."""
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = urls.select("host", "path").distinct().select("host", "path", F.explode(suffix).alias("rule_host"))
    rules = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).distinct()
    if rules.count() <= BROADCAST_ROWS:
        rules = F.broadcast(rules)
    pairs = pairs.join(rules, "rule_host").where("startswith(path, rule_path)")
    text = F.concat("rule_host", "rule_path")
    best = pairs.groupBy("host", "path").agg(F.max(F.struct(F.length(text).alias("n"), F.length("rule_host").alias("h"), text.alias("rule"), "rule_verdict")).alias("m"))
    return urls.join(best.select("host", "path", "m.rule", "m.rule_verdict"), ["host", "path"], "left")


def match_rules(urls: DataFrame, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """Adds rule and rule_verdict to rows with host and path; of fitting rules the longest wins."""
    if isinstance(rules, DataFrame):
        return _match_joined(urls, rules)
    if len(rules) <= INLINE_RULES:
        return _match_inline(urls, rules)
    return _match_joined(urls, urls.sparkSession.createDataFrame(list(rules), "host string, path string, verdict string"))


_COMMENT = r"(?s)<!--.*?(?:-->|$)"
_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?(?:[^"'>]*\s)?canonical\b[^>]*>"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b[^>]*>"""
_BASE = r"(?is)<base\b[^>]*>"
# The named character references that matter in urls; & is last, so that nothing is decoded twice.
_NAMED = {"&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, quoted or not, with its references decoded; empty without one."""
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])
    code = lambda m: F.when(F.lower(m).startswith("x"), F.conv(F.substr(m, F.lit(2)), 16, 10)).otherwise(m).cast("int")
    some = F.regexp_extract_all(value, F.lit(r"(?i)&#(x0*[0-7]?[0-9a-f]|0*(?:1[01][0-9]|12[0-7]|[0-9]{1,2}));"), F.lit(1))  # ASCII
    value = F.aggregate(F.array_distinct(some), value, lambda v, m: F.replace(v, F.concat(F.lit("&#"), m, F.lit(";")), F.char(code(m))))
    for reference, plain in _NAMED.items():
        value = F.replace(value, F.lit(reference), F.lit(plain))
    return F.regexp_replace(F.trim(F.regexp_replace(value, r"^[\x00-\x20]+|[\x00-\x20]+$", "")), r"[\t\r\n]", "")


def _without_dots(path: Column) -> Column:
    """path with its . and .. segments carried out, by RFC 3986; an empty path is /."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)

    def step(done, part):
        return F.when(part == ".", done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))

    # the part before the first slash is empty
    folded = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), step)
    whole = F.concat(F.lit("/"), F.array_join(folded, "/"), F.when(last.isin(".", "..") & (F.size(folded) > 0), "/").otherwise(""))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), whole).when(path == "", "/").otherwise(path)


def _absolute(base: Column, target: Column) -> Column:
    """target as seen from base; a path without a leading slash is resolved in base's folder."""
    scheme = F.regexp_extract(base, r"^([^:/?#]+)://", 1)
    root = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*([^?#]*/)?", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    return (
        F.when(F.coalesce(target, F.lit("")) == "", None)
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("#"), base)
        .when(target.startswith("?"), F.concat(page, target))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), target))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) urls of canonical links and meta refreshes in the pages' html."""
    html = F.regexp_replace("html", _COMMENT, " ")
    found = pages.where(F.col("html").rlike("(?i)canonical|http-equiv") & F.col("url").isNotNull()).select("url", html.alias("html"))
    tags = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), F.lit(0))
    moved = F.regexp_extract("content", r"(?is)[;,\s]url\s*=\s*(.*)$", 1)
    quoted = F.regexp_replace(F.regexp_extract(moved, r"""(?s)^["']?([^"']*)""", 1), r"\s+$", "")
    base = F.regexp_extract("html", _BASE, 0)
    found = found.select("url", _absolute(F.col("url"), _attribute(base, "href")).alias("base"), F.concat(F.transform(tags(_CANONICAL), lambda t: F.struct(F.lit(True).alias("link"), t.alias("tag"))), F.transform(tags(_REFRESH), lambda t: F.struct(F.lit(False).alias("link"), t.alias("tag")))).alias("tags"))
    found = found.select("url", "base", F.explode("tags").alias("t")).select("url", "base", "t.link", "t.tag")
    found = found.withColumn("content", _attribute(F.col("tag"), "content"))
    found = found.withColumn("target", F.when(F.col("link"), _attribute(F.col("tag"), "href")).otherwise(quoted))
    return found.select(F.col("url").alias("src"), _absolute(F.coalesce("base", "url"), F.col("target")).alias("dst")).where("src is not null and dst is not null")


def _hash(host: Column, path: Column, query: Column) -> Column:
    return F.when(host != "", F.xxhash64(host, _without_dots(path), query))


def _keyed(urls: DataFrame, url: str) -> DataFrame:
    host, path, query = split_url(F.col(url))
    out = urls.withColumns({"host": host, "path": path, "query": query})
    return out.withColumn("node", _hash(F.col("host"), F.col("path"), F.col("query"))).drop("query")


def judge_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, and alias_of_blocked: whether the class decided. redirects: (src, dst) urls."""
    scratch = Scratch(pages.sparkSession, "urls")
    edges = link_edges(pages.select("url", "html"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select("src", "dst").where("src is not null and dst is not null"))
    edges = scratch.save(edges.distinct(), "edges")
    ends = edges.select(F.col("src").alias("u")).unionByName(edges.select(F.col("dst").alias("u"))).distinct()
    nodes = match_rules(_keyed(ends, "u"), rules).where("node is not null")
    links = edges.select(_node("src").alias("a"), _node("dst").alias("b")).where("a is not null and b is not null")
    roots = connected_components(scratch, links)
    member = nodes.select("node", "rule_verdict").join(roots, "node")
    decided = member.where("rule_verdict = 'block'").select("root").distinct()
    blocked = scratch.save(roots.join(decided, "root").select("node").distinct(), "blocked")
    if blocked.count() <= BROADCAST_ROWS:
        blocked = F.broadcast(blocked)
    judged = match_rules(_keyed(pages.select("page_id", "url"), "url"), rules).join(blocked.withColumn("alias", F.lit(True)), "node", "left")
    alias = F.col("rule").isNull() & F.col("alias").isNotNull()
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(alias, "block").otherwise("allow")).alias("verdict"), alias.alias("alias_of_blocked"))


def _node(url: str) -> Column:
    return _hash(*split_url(F.col(url)))
