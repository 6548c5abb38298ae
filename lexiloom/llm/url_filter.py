"""URL filters with redirect equivalence.

1. Rules name a host with its subdomains and a path prefix; the longest that
   fits a URL decides it.
2. Redirects and canonical links join URLs: ``<link rel=canonical>`` and
   ``<meta http-equiv=refresh>`` of the pages' own HTML, and a table of
   redirects where one is given.  Links are resolved against the page's URL.
3. The connected components of these edges are the classes of URLs that name
   the same page.  A URL that no rule decides takes its class's decision: allow
   where a rule allows any URL of the class, else block where a rule blocks
   any, else allow.  URLs that were only linked to count as well.

Equivalence disregards scheme and fragment, and an empty path is ``/``.  URLs
take part in the components under numbers, given to the distinct URLs of edges
in a written table, so no two URLs can be taken for each other.  Only URLs on
edges are shuffled, not pages; keys that hold many rows are joined apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .skew import join_counted
from .storage import materialize, small

Rule = tuple[str, str, str]  # allow or block, host, path prefix
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 16_000_000  # of blocked aliases that go to all executors

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z as a-z; empty without ``://`` and for null."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """Host, path and query by which URLs are the same; null without a host."""
    path, query = path_of(url), F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)?", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(path == "", F.lit("/")).otherwise(path), query))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """``action, rule`` of the longest rule (host and path) that fits, else null; of equally long ones, one that allows."""
    if bad := [r for r in rules if r[0] not in ("allow", "block")]:
        raise ValueError(f"a rule allows or blocks: {bad[0]}")
    ordered = sorted({(a, _plain(h), p) for a, h, p in rules}, key=lambda r: (-len(r[1] + r[2]), r))
    if not ordered:
        return F.lit(None).cast("struct<action:string,rule:string>")
    table = F.array(*(F.struct(F.lit(a).alias("action"), F.lit(h + p).alias("rule"), F.lit(h).alias("host"), F.lit(p).alias("path")) for a, h, p in ordered))
    fits = F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    first = F.get(fits, F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["action"].alias("action"), first["rule"].alias("rule")))


def _plain(host: str) -> str:
    return host.translate(str.maketrans(_UPPER, _LOWER))


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute with any quotes or none."""
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.replace(F.trim(F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))), F.lit("&amp;"), F.lit("&"))


def declared(html: Column) -> Column:
    """Targets of the canonical links and refreshes of a page, outside comments and scripts."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>", "")
    links = F.filter(F.regexp_extract_all(bare, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0)), lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"))
    metas = F.filter(F.regexp_extract_all(bare, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0)), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
    refresh = lambda t: F.trim(F.regexp_extract(_attribute(t, "content"), r"""(?i)^[\s0-9.]*[;,]\s*url\s*=\s*["']?([^"']*)""", 1))
    return F.filter(F.concat(F.transform(links, lambda t: _attribute(t, "href")), F.transform(metas, refresh)), lambda u: u != "")


def resolved(link: Column, url: Column) -> Column:
    """A link as an absolute URL; null for schemes without ``://`` (such as ``mailto:``).  Dot segments stay."""
    scheme, site = F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*/)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(site, link))
        .when(F.startswith(link, F.lit("?")), F.concat(site, path_of(url), link))
        .when(F.startswith(link, F.lit("#")), url)
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def link_edges(pages: DataFrame, redirects: DataFrame | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Distinct pairs ``a, b`` of different keys: pages and their declared targets, and sources and targets of redirects."""
    u = F.col("u")
    some = pages.select(F.col(url_col).alias("u"), F.col(html_col).alias("h")).where(F.col("h").rlike("(?i)canonical|refresh"))
    own = some.select("u", F.explode(declared(F.col("h"))).alias("link")).select(u, resolved(F.col("link"), u).alias("v"))
    if redirects is not None:
        own = own.unionByName(redirects.select(F.col("source").alias("u"), F.col("target").alias("v")))
    keys = own.select(key_of(u).alias("x"), key_of(F.col("v")).alias("y")).where("x <> y")
    return keys.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def blocked_aliases(edges: DataFrame, rules: list[Rule]) -> DataFrame:
    """``key`` of all URLs without a rule of their own whose class is blocked; ``edges`` is a written table.

    Keys with the path ``/`` are among them even with a rule, since a URL of an
    empty path has the same key, but not their rule.
    """
    n = edges.count()
    ends = edges.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    nodes = materialize(ends.withColumn("id", F.monotonically_increasing_id()), "url-nodes")
    named = nodes.select(F.col("key").alias("a"), F.col("id").alias("from"), "n")
    half = materialize(join_counted(edges, named, "a", n).select("from", "b"), "url-half")
    links = join_counted(half, nodes.select(F.col("key").alias("b"), F.col("id").alias("to"), "n"), "b", n).select("from", "to")
    classes = connected_components(materialize(links, "url-links"), "from", "to", "url-components")
    whole = F.concat(F.lit("x://"), F.col("key"))
    decided = nodes.join(classes.withColumnRenamed("node", "id"), "id").select("key", "component_id", rule_for(host_of(whole), path_of(whole), rules)["action"].alias("action"), (path_of(whole) == "/").alias("root"))
    decided = materialize(decided, "url-decided")
    of = lambda action: F.coalesce(F.bool_or(F.col("action") == action), F.lit(False))
    sums = decided.groupBy("component_id").agg(F.count("*").alias("n"), of("block").alias("blocks"), of("allow").alias("allows"))
    blocked = materialize(sums.where("blocks and not allows").select("component_id", "n"), "url-classes")
    return join_counted(decided.where("action is null or root"), blocked, "component_id", nodes.count()).select("key")


def judge(
    pages: DataFrame, rules: list[Rule], *, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``id_col, host, path, rule, verdict`` (allow or block) of every row of ``pages``.

    ``rule``: the longest rule that fits (host and path as text), else null;
    its action is the verdict.  Without a rule the URL's class decides (see
    above); URLs without a host have none and are allowed.
    ``redirects``: a table ``source, target`` of absolute URLs.

    Null URLs, and ones without ``://``, have an empty host and path.  Null
    HTML declares nothing.  HTML is read whole.  Repeated rows and ids give
    repeated results, each by its own URL.  Other columns don't matter, and an
    empty table gives an empty one.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("u"))
    rows = rows.select("id", "u", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    rows = rows.withColumn("own", rule_for(F.col("host"), F.col("path"), rules))
    edges = materialize(link_edges(pages, redirects, url_col, html_col), "url-edges")
    alias = F.lit(None).cast("boolean")
    if not edges.isEmpty():
        aliases = materialize(blocked_aliases(edges, rules).withColumn("alias", F.lit(True)), "url-aliases")
        rows, alias = _marked(rows, aliases), F.col("alias")
    verdict = F.coalesce("own.action", F.when(alias, F.lit("block")), F.lit("allow"))
    return rows.select(F.col("id").alias(id_col), "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))


def _marked(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows with ``alias`` true where their key is one of ``aliases``."""
    keyed = rows.withColumn("key", key_of(F.col("u")))
    if small(aliases, BROADCAST_ROWS, F.length("key"), BROADCAST_CHARS):
        return keyed.join(F.broadcast(aliases), "key", "left").drop("key")
    keyed = materialize(keyed, "url-rows")
    open_rows = keyed.where("own is null and key is not null")
    counts = open_rows.groupBy("key").agg(F.count("*").alias("n")).join(aliases, "key", "left")
    found = join_counted(open_rows, materialize(counts, "url-counts"), "key", keyed.count()).drop("n")
    return found.unionByName(keyed.where("own is not null or key is null").withColumn("alias", F.lit(None).cast("boolean"))).drop("key")
