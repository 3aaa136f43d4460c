"""URL rules with redirect equivalence, in DataFrame functions only.

Urls that redirect to one another, or name one another as canonical, are one resource. A
rule decides the urls that it fits. A url without a rule takes the decision of its aliases:
allow if a rule allows one of them, else block if a rule blocks one of them, else allow.

Links of a page may be absolute, start with ``//`` or ``/``, be relative to the page's folder or only
a query; dot segments are taken out. Links with a scheme that has no host, such as ``mailto:``, name nothing.

Edge cases, all defined: a null url, or one without ``://``, has empty host and path, no
rule and no alias, and is allowed. A null page body names no alias. Repeated rows get equal
verdicts. An empty table gives an empty result. Kept columns named like a result column are
refused with an error; all other names may clash freely, as nothing else is joined by name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.components import components
from panelspark.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

AFTER_SCHEME = r"(?s)^.*?://(.*)$"
HOST, PATH, QUERY = r"^([^/?#]*)", r"^[^/?#]*([^?#]*)", r"^[^?#]*([?][^#]*)"
CANONICAL = r"(?is)<link\b[^>]*\brel=[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv=[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref=[\"']?([^\"'\s>]+)"
REFRESH_URL = r"(?is)\burl=[\"']?([^\"'\s>]+)"
#: A scheme counts at the start of a link only; ``a:b`` is a scheme without a host.
WITH_SCHEME, OTHER_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://", r"^[A-Za-z][A-Za-z0-9+.-]*:"
PATH_OF_LINK, FOLDER = r"^([^?#]*)", r"(?s)^(.*/)"
#: Host prefixes, path ends and query parameters that sites redirect away.
HOST_PREFIX = r"^(www|m)[.]"
PATH_END = r"([.]html|/)$"
TRACKING = r"[?&](utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The production rules.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def after_scheme(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, AFTER_SCHEME, 1), F.lit(""))


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, HOST, 1), UPPER, LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, PATH, 1)


def key_of(rest: Column) -> Column:
    """Scheme and fragment do not tell resources apart; null without a host."""
    key = F.concat(host_of(rest), path_of(rest), F.regexp_extract(rest, QUERY, 1))
    return F.when(host_of(rest) != "", key)


def landing_of(rest: Column) -> Column:
    """The key that mobile, www, tracking and suffix variants redirect to."""
    query = F.regexp_replace(F.regexp_extract(rest, QUERY, 1), TRACKING, "")
    key = F.concat(
        F.regexp_replace(host_of(rest), HOST_PREFIX, ""),
        F.regexp_replace(path_of(rest), PATH_END, ""),
        F.regexp_replace(query, "^&", "?"))
    return F.when(host_of(rest) != "", key)


def without_dots(path: Column) -> Column:
    """A path from the root without ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    walked = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), lambda kept, part: (
        F.when(part == ".", kept).when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.concat(kept, F.array(part)))))
    inside = F.element_at(parts, -1).isin(".", "..")
    joined = F.concat(F.lit("/"), F.array_join(walked, "/"), F.when(inside & (F.size(walked) > 0), "/").otherwise(""))
    return F.when(path.contains("/."), joined).otherwise(path)


def resolved(link: Column, rest: Column) -> Column:
    """What follows the scheme of the url that a link means on the page with ``rest``; null for other schemes."""
    host, path = host_of(rest), path_of(rest)
    own = F.regexp_extract(link, PATH_OF_LINK, 1)
    tail = F.regexp_extract(link, QUERY, 1)
    here = host != ""
    full = F.when(link.rlike(WITH_SCHEME), F.regexp_extract(link, AFTER_SCHEME, 1)).when(
        link.startswith("//"), F.substring(link, 3, 1 << 30))
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, FOLDER, 1))
    near = (F.when(link.startswith("/"), own).when(own == "", path).otherwise(F.concat(folder, own)))
    return F.when(full.isNotNull(), F.concat(host_of(full), without_dots(path_of(full)), F.regexp_extract(full, QUERY, 1))).when(
        here & (link != "") & ~link.startswith("#") & ~link.rlike(OTHER_SCHEME), F.concat(host, without_dots(near), tail))


def named_in(html: Column, tag: str, target: str, rest: Column) -> Column:
    """Key of the url that a tag of the page names, else null."""
    link = F.replace(F.regexp_extract(F.regexp_extract(html, tag, 0), target, 1), F.lit("&amp;"), F.lit("&"))
    return key_of(resolved(link, rest))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(name, verdict) of the longest rule that fits, else null."""
    chosen = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.verdict)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    return chosen if chosen is not None else F.lit(None).cast("struct<name:string,verdict:string>")


def redirect_edges(urls: DataFrame) -> DataFrame:
    """(a, b) between a url's key and the keys that it is equal to; one row per pair."""
    return (
        urls.select(F.col("_key").alias("a"), F.explode("_aliases").alias("b"))
        .where("a is not null and b is not null and a != b").distinct())


def decisions(edges: DataFrame, rules=RULES) -> DataFrame:
    """(node, verdict) for the nodes of components in which some url has a rule."""
    members = written(components(edges), "url-components")
    fit = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    decided = (
        members.select("component", fit.alias("verdict")).where("verdict is not null")
        .groupBy("component").agg(F.min("verdict").alias("verdict")))  # allow sorts before block
    return members.join(decided, "component").select("node", "verdict")


def judge(pages: DataFrame, keep: list[str], url: str = "url", html: str | None = "html",
          redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """``keep`` columns of each page with host, path, rule and verdict.

    ``redirects`` may hold further (a, b) pairs of full urls, such as those of 3xx responses.
    """
    if clash := {"host", "path", "rule", "verdict"} & set(keep):
        raise ValueError(f"kept columns named like results: {sorted(clash)}")
    rest = after_scheme(F.col(url))
    aliases = [landing_of(rest)]
    if html is not None:
        aliases += [named_in(F.col(html), CANONICAL, HREF, rest), named_in(F.col(html), REFRESH, REFRESH_URL, rest)]
    urls = written(
        pages.select(F.struct(*keep).alias("_row"), host_of(rest).alias("_host"), path_of(rest).alias("_path"),
                     key_of(rest).alias("_key"), F.array(*aliases).alias("_aliases")), "urls")
    edges = redirect_edges(urls)
    if redirects is not None:
        pair = redirects.select(*(key_of(after_scheme(F.col(c))).alias(c) for c in ("a", "b")))
        edges = edges.unionByName(pair.where("a is not null and b is not null and a != b")).distinct()
    found = decisions(edges, rules).select(F.col("node").alias("_node"), F.col("verdict").alias("_aliased"))
    own = rule_of(F.col("_host"), F.col("_path"), rules)
    return urls.join(found, F.col("_key") == F.col("_node"), "left").select(
        "_row.*", F.col("_host").alias("host"), F.col("_path").alias("path"), own["name"].alias("rule"),
        F.coalesce(own["verdict"], "_aliased", F.lit("allow")).alias("verdict"))
