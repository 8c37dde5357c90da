"""URL filtering with redirect equivalence (operator 10).

Rules are (verdict, host, path prefix): a rule fits its host and all subdomains
if the URL's path starts with the rule's; the longest rule wins (host and path
together; between equals, allow). A URL that no rule fits takes the verdict of its
alias class: classes are the connected components of the graph of redirects
(meta refresh, and any redirect log handed in) and canonical links (``rel=canonical``),
found by star contraction over the edges. Within a class an explicit allow
prevails over any block; a class with neither is allowed.

Two spellings that differ in fragment, scheme or host case are one URL here, and
so one node. Nodes are 128-bit digests, so edges stay small whatever the URLs.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule
and belongs to no class (allow); a null html has no links; empty targets, fragments
and targets of schemes without ``://`` (mail, scripts) are no links; repeated rows each give
a row; an empty table gives no rows; unknown columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import written
from ..operators.components import weak_components


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: (host, path) of the rules that the queries use.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of name and verdict; else null."""
    longest_first = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "allow", r.name))
    known = F.array(
        *[F.struct(F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict")) for r in longest_first]
    )
    fits = F.filter(known, lambda r: ((host == r.host) | host.endswith(F.concat(F.lit("."), r.host))) & path.startswith(r.path))
    return F.get(fits, 0)


def node_of(url: Column) -> Column:
    """Digest of a URL without fragment and scheme, host lower-cased; null for what is no URL."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    key = F.concat(host_of(url), F.when(rest == "", F.lit("/")).otherwise(rest))
    return F.when(F.instr(url, "://") > 0, F.md5(key.cast("binary")))


def _attribute(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.when(quoted != "", quoted).otherwise(F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*([^\s\"'>]+)", 1))


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved; ``..`` at the top is dropped."""
    parts = F.split(path, "/", -1)

    def step(kept: Column, part: Column) -> Column:
        # the first, empty part stands for the root and stays
        up = F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(kept)
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.array_append(kept, part))

    whole = F.aggregate(parts, F.array().cast("array<string>"), step)
    # a last segment of dots names a folder
    return F.concat(F.array_join(whole, "/"), F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit("")))


def _absolute(target: Column, base: Column) -> Column:
    """A link target against its page: absolute, scheme-relative, host-relative, query only or relative; null for other schemes."""
    target = F.replace(F.trim(target), F.lit("&amp;"), F.lit("&"))
    origin, path = F.concat(F.lit("http://"), host_of(base)), path_of(base)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    named = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    rest = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    joined = F.when(target.startswith("/"), named).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), named))
    return (
        F.when((target == "") | target.startswith("#"), F.lit(None))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("?"), F.concat(origin, path, target))
        .otherwise(F.concat(origin, _without_dots(joined), rest))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, target): node digests of the canonical links and refresh redirects that pages declare, and the URL aimed at."""
    html, url = F.coalesce(F.col("html").cast("string"), F.lit("")), F.col("url").cast("string")
    tag = F.col("tag")
    return (
        pages.select(url.alias("url"), F.explode(F.regexp_extract_all(html, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), 1)).alias("tag"))
        # few tags go on from here; each step names a column once, so that no expression is computed twice
        .withColumns({"rel": F.lower(_attribute(tag, "rel")), "equiv": F.lower(_attribute(tag, "http-equiv"))})
        .where(F.col("rel").rlike(r"(^|\s)canonical(\s|$)") | (F.col("equiv") == "refresh"))
        .withColumns({"href": _attribute(tag, "href"), "content": _attribute(tag, "content")})
        .withColumn("moved", F.regexp_extract("content", r"(?is)url\s*=\s*['\"]?([^'\"]+)", 1))
        .withColumn("named", F.when(F.col("equiv") == "refresh", F.col("moved")).otherwise(F.col("href")))
        .withColumn("target", _absolute(F.col("named"), F.col("url")))
        # a generator between the digests and the filter, or the filter would be pushed down with all of them inside
        .select(F.explode(F.array(F.struct(node_of(F.col("url")).alias("src"), node_of(F.col("target")).alias("dst"), "target"))).alias("link"))
        .select("link.src", "link.dst", "link.target")
        .where("src <> dst")
    )


def verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_class) of every page.

    ``redirects`` may add a log of redirects: columns ``src`` and ``dst``, both URLs.
    """
    url = F.col("url").cast("string")
    judged = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    judged = judged.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    judged = judged.select("page_id", "host", "path", "node", F.col("hit.name").alias("rule"), F.col("hit.verdict").alias("own"))

    edges = link_edges(pages)
    if redirects is not None:
        logged = redirects.select(node_of(F.col("src").cast("string")).alias("src"), node_of(F.col("dst").cast("string")).alias("dst"), F.col("dst").cast("string").alias("target"))
        edges = edges.union(logged.where("src <> dst"))
    edges = written(edges, "alias-edges")
    classes = weak_components(edges.select("src", "dst").distinct())
    # the rules also speak on targets that were not crawled
    aimed = edges.withColumn("hit", rule_of(host_of(F.col("target")), path_of(F.col("target")), rules))

    # decisions: one row a node, and from nodes one row a class; alias classes without a decision drop out
    decisions = (
        judged.select("node", "own")
        .union(aimed.select("dst", "hit.verdict"))
        .where("node is not null and own is not null")
        .groupBy("node")
        .agg(F.max(F.col("own") == "allow").alias("allowed"))
        .join(classes, F.col("node") == F.col("id"), "left")
        .groupBy(F.coalesce("component", "node").alias("component"))
        .agg(F.max("allowed").alias("allowed"))
    )
    members = classes.join(decisions, "component").select(F.col("id").alias("node"), "component", "allowed")
    alone = decisions.join(classes.select(F.col("id").alias("component")), "component", "left_anti")
    known = written(members.union(alone.select(F.col("component").alias("node"), "component", "allowed")), "alias-classes")

    open_pages = judged.where("own is null and node is not null").join(known, "node", "left")
    closed = judged.where("own is not null or node is null")
    inherited = F.when(F.col("allowed") | F.col("allowed").isNull(), F.lit("allow")).otherwise(F.lit("block"))
    columns = ["page_id", "host", "path", "rule"]
    return open_pages.select(*columns, inherited.alias("verdict"), F.col("component").alias("alias_class")).union(
        closed.select(*columns, F.coalesce("own", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("alias_class"))
    )
