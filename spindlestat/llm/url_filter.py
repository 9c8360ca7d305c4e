"""URL filter: rules on hosts and paths, and block decisions carried over redirects and canonical links. Native.

Pages that redirect to each other (meta refresh, or a given table of redirects) or name the same canonical URL are
aliases: the connected components over these edges. A page without a rule of its own gets its component's decision:
allow if any alias is explicitly allowed, else block if any is blocked, else allow.

A null url, or one without `://`, has an empty host and path and no aliases; a null html has no edges. Repeated rows
are judged alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut_lineage
from .components import components, with_found

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) of the query's contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MOST_RULES = 1000


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty for null and for urls without it."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def with_node(rows: DataFrame, url: str, name: str) -> DataFrame:
    """Adds columns `name` and, for it, `name`_host and `name`_path.

    A node is the url's host, path (at least /, its dot segments removed) and query, without scheme and fragment; null without a host. Steps are
    columns of their own, so that the plan doesn't repeat one inside the other.
    """
    rows = rows.withColumn("_rest", after_scheme(F.col(url)))
    rows = rows.withColumns({f"{name}_host": F.translate(F.regexp_extract("_rest", "^[^/?#]*", 0), UPPER, LOWER), f"{name}_path": F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1), "_query": F.regexp_extract("_rest", r"^[^?#]*(\?[^#]*)", 1)})
    h, p = F.col(f"{name}_host"), F.col(f"{name}_path")
    return rows.withColumn(name, F.when(h != "", F.concat(h, F.when(p == "", "/").when(p.contains("/."), without_dots(p)).otherwise(p), "_query"))).drop("_rest", "_query")


def without_dots(path: Column) -> Column:
    """The path without its segments `.` and `..`, which remove nothing and the segment before."""
    parts = F.split(path, "/")
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.array_join(kept, "/"), F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))


def resolved(href: Column, base_host: Column, base_path: Column) -> Column:
    """An href of the page with this host and path as an absolute url; null if empty or of another scheme than http."""
    top = F.concat(F.lit("http://"), base_host)
    folder = F.regexp_extract(base_path, "^(.*/)[^/]*$", 1)
    return (
        F.when(href.rlike("(?i)^https?://"), href)
        .when(href.startswith("//"), F.concat(F.lit("http:"), href))
        .when((href == "") | href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), None)
        .when(href.startswith("/"), F.concat(top, href))
        .when(href.startswith("?"), F.concat(top, base_path, href))
        .otherwise(F.concat(top, F.when(folder == "", "/").otherwise(folder), href))
    )


def rule_of(host_col: Column, path_col: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits (of equally long ones an allow); null if none does.

    The rules are part of the plan, so there may be at most MOST_RULES.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES}")
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0])):
        fits = ((host_col == h) | host_col.endswith(f".{h}")) & path_col.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, hit) if found is None else found.when(fits, hit)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): nodes of pages and of the targets of their canonical links and refreshes."""
    url, html = F.col(url_col), F.col(html_col)
    attr = lambda tag, name: F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    bare = lambda x: F.regexp_replace(x, "^[\"']|[\"']$", "")
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), 0), lambda t: F.array_contains(F.split(F.lower(bare(attr(t, "rel"))), r"\s+"), "canonical"))
    metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), 0), lambda t: F.lower(bare(attr(t, "http-equiv"))) == "refresh")
    targets = F.concat(
        F.transform(links, lambda t: bare(attr(t, "href"))),
        F.transform(metas, lambda t: F.regexp_extract(bare(attr(t, "content")), r"(?is)url\s*=\s*['\"]?([^'\"]*)", 1)),
    )
    rows = pages.filter(html.rlike("(?i)canonical|http-equiv")).select(url.alias("url"), F.explode(targets).alias("href"))
    rows = with_node(rows, "url", "a").withColumn("href", F.trim(F.replace("href", F.lit("&amp;"), F.lit("&"))))
    rows = rows.withColumn("target", resolved(F.col("href"), F.col("a_host"), F.col("a_path")))
    return with_node(rows, "target", "b").select("a", "b")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """page_id, host, path, rule, verdict of every page. redirects: urls (source, target), besides what the pages say."""
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), *([F.col(html_col).alias("html")] if html_col else []))
    edges = [page_edges(pages)] if html_col else []
    if redirects is not None:
        edges.append(with_node(with_node(redirects.select("source", "target"), "source", "a"), "target", "b").select("a", "b"))
    rows = with_node(pages.select("page_id", "url"), "url", "node").select("page_id", F.col("node_host").alias("host"), F.col("node_path").alias("path"), "node")
    rows = rows.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    links = edges[0] if len(edges) == 1 else edges[0].union(edges[1]) if edges else None
    links = cut_lineage(links.distinct()).filter("a != b") if links is not None else None
    if links is None or links.isEmpty():
        return rows.select("page_id", "host", "path", "own.rule", F.coalesce("own.verdict", F.lit("allow")).alias("verdict"))
    members = components(links)
    # a component's targets count too, whether or not they are pages here
    named = with_node(members.withColumn("url", F.concat(F.lit("x://"), "node")), "url", "n")
    ruled = named.select("component", rule_of(F.col("n_host"), F.col("n_path"), rules).alias("own"))
    decided = ruled.groupBy("component").agg(F.max(F.col("own.verdict") == "allow").alias("allowed"), F.max(F.col("own.verdict") == "block").alias("blocked"), F.count(F.lit(1)).alias("n"))
    # no task gets all members of a large component, nor all pages of a url that is often repeated
    decided = with_found(members, "component", decided, members.count())
    carried = decided.select("node", F.when(F.coalesce("allowed", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow").alias("carried"))
    named_rows = rows.filter("node IS NOT NULL")
    of_node = named_rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(carried, "node", "left")
    rows = with_found(named_rows, "node", of_node, rows.count()).unionByName(rows.filter("node IS NULL").withColumn("carried", F.lit(None).cast("string")))
    return rows.select("page_id", "host", "path", "own.rule", F.coalesce("own.verdict", "carried", F.lit("allow")).alias("verdict"))
