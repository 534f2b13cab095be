"""URL filters with redirect equivalence, with DataFrame functions only.

Rules name a host and the beginning of a path; the longest that fits decides. Addresses that redirect
to each other or name each other as canonical are one class: connected components over those edges.
A class in which a rule blocks some address is blocked as a whole, but for the addresses that a rule
allows. Only addresses that have such an edge take part in a shuffle of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import bound
from corpusmill.llm.common import LOWER, UPPER, pick, stash
from corpusmill.llm.graph import components

# Patterns of the tags that name another address. Comments and scripts are stepped over; each is read once.
TAGS = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<(?:link|meta)\b[^<>]*"
CANONICAL = r"""(?is)^<link\b.*\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""
REFRESH = r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?\s*refresh\b"""
HREF = r"""(?is)\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
CONTENT = r"""(?is)\bcontent\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
WAIT = r"""(?is)^\s*[0-9.]*\s*[;,]\s*(?:url\s*=\s*)?["']?"""
WITH_HOST, OTHER_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://", r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def _rest(url: Column) -> Column:
    """What stands behind the first "://"; empty where there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _host(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*", 0)


def host_of(url: Column) -> Column:
    """Behind the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty for null or without "://"."""
    return F.translate(_host(_rest(url)), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Behind the host up to "?", "#" or the end."""
    rest = _rest(url)
    return F.regexp_extract(F.substr(rest, F.char_length(_host(rest)) + 1), r"^[^?#]*", 0)


def address_of(url: Column) -> Column:
    """Host, path and query: what an address is told by, whatever its scheme and fragment; null where there is no host."""
    rest = _rest(url)
    host = F.translate(_host(rest), UPPER, LOWER)
    whole = F.concat(host, F.regexp_extract(F.substr(rest, F.char_length(_host(rest)) + 1), r"^[^#]*", 0))
    return F.when(F.char_length(host) > 0, whole)


def node_of(url: Column) -> Column:
    """Sixteen bytes that stand for an address."""
    return F.substring(F.unhex(F.sha2(address_of(url), 256)), 1, 16)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (verdict, host, path) that fits; of equally long ones an allowing one. Null if none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r))
    if not ordered:
        return F.lit(None).cast("struct<host:string,path:string,verdict:string>")
    listed = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for v, h, p in ordered])
    fits = lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"])
    return F.get(F.filter(listed, fits), F.lit(0))


def _unquoted(value: Column) -> Column:
    return F.btrim(F.regexp_replace(value, r"""^["']|["']$""", ""), F.lit(" \t\n\x0c\r"))


def linked_addresses(url: Column, html: Column) -> Column:
    """Absolute addresses that a page names as canonical or refreshes to, in order.

    A tag ends before the next "<" or ">". Relative addresses stand on the page's own host and path; dots
    in them are kept. Addresses of other kinds (mailto and the like) and empty ones are left out.
    """
    tags = F.filter(F.regexp_extract_all(html, F.lit(TAGS), F.lit(0)), lambda t: t.rlike(CANONICAL) | t.rlike(REFRESH))
    goal = lambda t: F.when(t.rlike(CANONICAL), _unquoted(F.regexp_extract(t, HREF, 1))).otherwise(
        F.regexp_replace(F.regexp_extract(_unquoted(F.regexp_extract(t, CONTENT, 1)), WAIT + ".+", 0), WAIT, "")
    )
    plain = F.transform(F.transform(tags, goal), lambda t: F.btrim(F.replace(t, F.lit("&amp;"), F.lit("&")), F.lit(" '\"\t\n\x0c\r")))
    here = F.concat(F.lit("//"), host_of(url))
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")

    def whole(t: Column) -> Column:
        return (
            F.when((t == "") | F.startswith(t, F.lit("#")), None)
            .when(t.rlike(WITH_HOST), t)
            .when(F.startswith(t, F.lit("//")), F.concat(F.lit("http:"), t))
            .when(t.rlike(OTHER_SCHEME), None)
            .when(F.startswith(t, F.lit("/")), F.concat(F.lit("http:"), here, t))
            .when(F.startswith(t, F.lit("?")), F.concat(F.lit("http:"), here, path_of(url), t))
            .otherwise(F.concat(F.lit("http:"), here, F.when(folder == "", F.lit("/")).otherwise(folder), t))
        )

    return F.filter(F.transform(plain, whole), lambda t: t.isNotNull())


def blocked_aliases(links: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame | None:
    """links(url, target) -> nodes of all addresses whose class holds one that a rule blocks; None without links."""

    def end(column: str, to: str) -> list[Column]:
        found = rule_for(host_of(F.col(column)), path_of(F.col(column)), rules)
        return [node_of(F.col(column)).alias(to), F.coalesce(found["verdict"] == "block", F.lit(False)).alias(f"{to}_blocked")]

    edges = stash(links.select(*end("url", "u"), *end("target", "v")).where("u <> v").distinct(), "aliases")
    if edges.isEmpty():
        return None
    ends = edges.select(F.col("u").alias("node"), F.col("u_blocked").alias("blocked")).unionByName(edges.select(F.col("v").alias("node"), F.col("v_blocked").alias("blocked")))
    nodes = ends.groupBy("node").agg(F.bool_or("blocked").alias("blocked"))
    rooted = nodes.join(components(edges.select("u", "v")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    bad = rooted.groupBy("root").agg(F.bool_or("blocked").alias("any")).where("any").select("root")
    return stash(rooted.join(bad, "root", "left_semi").select("node"), "blocked-aliases")


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, alias.

    rules: (allow or block, host, beginning of the path); a rule fits its host and all hosts below it, and
    the longest decides. An address that no rule fits is blocked (alias true) if its class holds an
    address, of a page or not, that a rule blocks; all others are allowed. An address that a rule allows
    stays so whatever its aliases are, and is no bar between them. redirects(url, target): more edges, as
    a crawl has them. Null addresses, and those without "://", have empty host and path, no rule and no
    alias. Null html has no links. Repeated rows say the same. An empty table gives an empty result.
    Extra columns are not read.
    """
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col)
    links = rows.where("html is not null").select("url", F.explode(bound(F.col("html"), lambda x: linked_addresses(F.col("url"), x))).alias("target"))
    if redirects is not None:
        links = links.unionByName(pick(redirects, "url", "target"))
    judged = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    judged = judged.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    blocked = blocked_aliases(links, rules)
    if blocked is None:
        judged = judged.withColumn("alias", F.lit(False))
    else:
        judged = judged.join(blocked.withColumn("met", F.lit(True)), "node", "left").withColumn("alias", F.col("found").isNull() & F.col("met").isNotNull())
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("alias"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.concat("found.host", "found.path").alias("rule"), verdict.alias("verdict"), "alias")
