"""URL filters [native]: rules plus redirect equivalence.

A rule names a host and a path prefix and fits the host and its subdomains;
the longest fitting rule decides a url.  Urls that no rule fits inherit: a page
and what it redirects to (meta refresh, a table of redirects) or names as
canonical, in its markup and seen from its base, are aliases, and aliases form components.  In a component an explicit
allow takes precedence over an explicit block; with neither, a url is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .store import discard, materialize

#: (verdict, host, path)
Rule = tuple[str, str, str]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lowered; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path with its . and .. segments carried out."""
    parts = F.split(path, "/", -1)
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        return F.when(part == "..", F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    last = F.element_at(parts, -1)
    kept = F.aggregate(parts, none, step)
    kept = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(kept, "/")).otherwise(path)


def url_key(url: Column) -> Column:
    """Identity of a resource: host, path (dot segments carried out, empty as /) and query, without scheme and fragment; null without ://."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)?", 1)
    path = without_dots(url_path(url))
    return F.when(url.contains("://"), F.concat(url_host(url), F.when(path == "", F.lit("/")).otherwise(path), query))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null.

    The rules are configuration: they become one CASE in order of length (host
    and path together, then host, then allow before block).
    """
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0], r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or bare, with character references of &, quotes and angle brackets decoded; empty if absent."""
    pattern = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    value = F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])
    for reference, character in (("(?i)&lt;|&#60;|&#x3c;", "<"), ("(?i)&gt;|&#62;|&#x3e;", ">"), ("(?i)&quot;|&#34;|&#x22;", '"'), ("(?i)&apos;|&#39;|&#x27;", "'"), ("(?i)&amp;|&#38;|&#x26;", "&")):
        value = F.regexp_replace(value, reference, character)
    return F.trim(value)


#: Elements whose content is no markup of the page.
RAW_ELEMENTS = ("script", "style", "textarea", "title", "template", "xmp", "iframe", "noembed", "noframes")
#: What is not read: comments and the content of such elements, to the end of the page where one is not closed.
UNREAD = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{e}(?:\s[^>]*)?>.*?(?:</{e}\s*>|\z)" for e in RAW_ELEMENTS)


def markup(html: Column) -> Column:
    """A page without its comments, scripts, styles and other content that holds no tags."""
    return F.regexp_replace(html, UNREAD, " ")


def _tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\s[^>]*>"), F.lit(0))


def base_target(html: Column) -> Column:
    """The href of the first base element that has one, of a page's markup; else empty."""
    hrefs = F.filter(F.transform(_tags(html, "base"), lambda t: _attribute(t, "href")), lambda x: x != "")
    return F.coalesce(F.get(hrefs, F.lit(0)), F.lit(""))


def alias_targets(html: Column) -> Column:
    """The targets of all canonical links and meta refreshes of a page's markup, as they stand there; empty for null html."""

    def tags(name: str) -> Column:
        return _tags(html, name)

    links = F.filter(tags("link"), lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"))
    metas = F.filter(tags("meta"), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
    hrefs = F.transform(links, lambda t: _attribute(t, "href"))
    moves = F.transform(metas, lambda t: F.regexp_extract(_attribute(t, "content"), r"(?is)\burl\s*=\s*[\"']?([^\"'\s]+)", 1))
    found = F.filter(F.concat(hrefs, moves), lambda x: x != "")
    return F.coalesce(found, F.array().cast("array<string>"))


def absolute(target: Column, url: Column) -> Column:
    """A link as an absolute url, seen from the page it stands on (RFC 3986); null for schemes without ://, as mailto."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    origin = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    path = url_path(url)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)?", 1)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.startswith("?"), F.concat(origin, path, target))
        .when((target == "") | target.startswith("#"), F.concat(origin, path, query))
        .otherwise(F.concat(origin, folder, target))
    )


def judge_urls(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None, id_col: str = "page_id") -> DataFrame:
    """(id, host, path, rule, verdict, component) of every page; pages: id, url, html.

    redirects: optional (from_url, to_url).  A null url, or one without ://, has
    an empty host and path, fits no rule, has no aliases and is allowed.  Null
    html has no links.  Links in comments, scripts and the like are none; links
    are seen from the page's first base element that has an href, itself seen
    from the page's url.  Repeated rows are judged alike; other columns of pages
    are ignored; an empty table gives an empty result.
    """
    url = F.col("url")
    seen = pages.select(F.col(id_col).alias("id"), "url", markup(F.col("html")).alias("html"))
    seen = seen.select("id", "url", url_host(url).alias("host"), url_path(url).alias("path"), alias_targets(F.col("html")).alias("to"), base_target(F.col("html")).alias("base"))
    base = F.coalesce(F.when(F.col("base") != "", absolute(F.col("base"), url)), url)
    own = matching_rule(F.col("host"), F.col("path"), rules)
    lone = F.concat(F.lit("\x00"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    targets = F.array_distinct(F.transform("to", lambda t: url_key(absolute(t, F.col("base")))))
    light = materialize(
        seen.withColumn("base", base).select("id", "host", "path", own.alias("own"), url_key(url).alias("alias"), F.coalesce(url_key(url), lone).alias("key"), F.array_compact(targets).alias("to")),
        "pages",
    )
    edges = light.where("alias is not null and size(to) > 0").select("alias", F.explode("to").alias("other"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(url_key(F.col("from_url")).alias("alias"), url_key(F.col("to_url")).alias("other")))
    # written, both sides of the joins below can be split by Spark where one url or component is hot
    labels = materialize(connected_components(edges).select(F.col("node").alias("key"), "component"), "labels")
    linked = F.col("component").isNotNull().alias("linked")
    placed = light.join(labels, "key", "left").select("id", "host", "path", "own", linked, F.coalesce("component", "key").alias("component"))
    placed = materialize(placed, "placed")
    is_ = lambda v: F.max(F.coalesce(F.col("own.verdict") == v, F.lit(False)))
    # a url without aliases has nothing to inherit
    group = placed.where("linked").groupBy("component").agg(is_("allow").alias("any_allow"), is_("block").alias("any_block"))
    blocked = materialize(group.where("any_block and not any_allow").select("component", F.lit("block").alias("inherited")), "blocked")
    discard(light)
    discard(labels)
    return placed.join(blocked, "component", "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "inherited", F.lit("allow")).alias("verdict"), "component"
    )
