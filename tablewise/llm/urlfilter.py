"""URL rules whose decisions reach aliases: urls that redirect to each other or name the same canonical page are one component."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.components import components
from tablewise.llm.shared import aside, bounded_broadcast, stash

#: A link element with rel=canonical or a meta refresh, and the address in it.
_CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url) -> F.Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url) -> F.Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url) -> F.Column:
    """The node of a url in the alias graph: host, path (empty is /) and query, without scheme and fragment; null if it has no host."""
    host, path = host_of(url), path_of(url)
    return F.when(host != "", F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)))


def absolute(base, link) -> F.Column:
    """A link read on the page base: absolute, without scheme, from the host's root, a query on the page's path, a fragment of the page, or
    beside the page."""
    scheme, path = F.regexp_extract(base, r"^([^:/?#]+)://", 1), path_of(base)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    return (F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/"), F.concat(root, link)).when(link.startswith("?"), F.concat(root, path, link)).when(link.startswith("#"), base)
            .otherwise(F.concat(root, F.regexp_replace(path, r"[^/]*$", ""), link)))


_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links with their character references (those that end in a semicolon) read; the few rows that declare a link reach Python."""
    for batch in batches:
        links = [_REFERENCE.sub(lambda m: html.unescape(m[0]), x) for x in batch.column("link").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("url"), pa.array(links, pa.string())], ["url", "link"])


def page_links(pages: DataFrame) -> DataFrame:
    """(source, target) addresses of all canonical links and refresh redirects that pages (url, html) declare, character references read."""
    def found(pattern: str) -> DataFrame:
        links = pages.where(F.col("url").isNotNull() & F.col("html").isNotNull()).select(F.col("url").cast("string").alias("url"), F.explode(F.regexp_extract_all("html", F.lit(pattern), 1)).alias("link"))
        return links.where("link != ''").mapInArrow(_decoded, "url string, link string").select(
            address_of(F.col("url")).alias("source"), address_of(absolute(F.col("url"), F.col("link"))).alias("target"))
    return found(_CANONICAL).union(found(_REFRESH))


def rule_matches(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action) for the distinct places that a rule fits: the rule's host or a subdomain of it, and a path that starts
    with the rule's. The longest rule wins; of equally long ones allow."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    keyed = places.select("host", "path").distinct().where("host != ''").withColumn("rule_host", F.explode(suffixes))
    sized = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("action"))
    hit = keyed.join(bounded_broadcast(sized), "rule_host").where(F.expr("startswith(path, rule_path)"))
    name = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(name).alias("n"), (F.col("action") == "allow").alias("allow"), name.alias("rule"), F.col("action").alias("action")))
    return hit.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.action")


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict (allow or block).

    pages: url, optionally html, other columns pass through (columns called host, path, rule or verdict are replaced). rules: action
    (allow or block), host, path. redirects: source and target urls, optional. A url that a rule fits has that rule's verdict. Any other
    takes it from its component of redirect and canonical links: allow if a rule explicitly allows one of its addresses, else block
    if one is blocked, else allow. A null url, or one without ``://``, has empty host and path, no aliases, and is allowed."""
    pages, back = aside(pages.drop("host", "path", "rule", "verdict"), {"action", "inherited", "_node"})
    pages = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    links = page_links(pages) if "html" in pages.columns else None
    if redirects is not None:
        told = redirects.select(address_of(F.col("source")).alias("source"), address_of(F.col("target")).alias("target"))
        links = told if links is None else links.union(told)
    alias = None
    if links is not None:
        links = stash(links.where("source is not null and target is not null and source != target").distinct(), "aliases")
        if not links.isEmpty():
            alias = components(links, "source", "target")
    ruled = pages.join(rule_matches(pages, rules), ["host", "path"], "left")
    if alias is None:
        return ruled.select(*back, "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"))
    # An address that only links name takes part in its component with its own rule.
    as_url = F.concat(F.lit("x://"), F.col("node"))
    nodes = alias.withColumn("host", host_of(as_url)).withColumn("path", path_of(as_url))
    judged = nodes.join(rule_matches(nodes, rules), ["host", "path"])
    group = judged.groupBy("component").agg(F.min("action").alias("inherited"))  # allow sorts before block
    inherited = alias.join(group, "component").select(F.col("node").alias("_node"), "inherited")
    return (ruled.withColumn("_node", address_of(F.col("url"))).join(inherited, "_node", "left")
            .select(*back, "host", "path", "rule", F.coalesce("action", "inherited", F.lit("allow")).alias("verdict")))
