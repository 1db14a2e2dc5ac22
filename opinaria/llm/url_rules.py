"""URL verdicts: rules first, then redirect equivalence.

A rule blocks or allows a host, its subdomains and a path prefix; the longest fitting rule decides. URLs that redirect to each other or
name each other as canonical are aliases: they form the connected components of a graph whose nodes are URLs. A page without a rule
of its own is blocked when an alias is blocked by a rule; a page that a rule allows stays allowed whatever its aliases are.
Links are read from the pages (canonical and refresh) and may be given as a table of redirects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinaria.llm.common import components, join_hot
from opinaria.session import cut_lineage, fits_broadcast

# Fixed rules: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

LINK = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
REFRESH = (r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\bcontent\s*=\s*"
           r"(?:\"[^\"]*?url\s*=\s*'?([^\"']*)'?\s*\"|'[^']*?url\s*=\s*\"?([^\"']*)\"?\s*'|[^\s\"'>]*?url=([^\s\"'>]+))")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty without "://"."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host up to "?", "#" or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null. Of equally long rules, an allowing one."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in reversed(order):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _first_group(text: Column, pattern: str) -> Column:
    groups = [F.regexp_extract(text, pattern, k) for k in (1, 2, 3)]
    return F.concat(*groups)


def absolute(base: Column, target: Column) -> Column:
    """A link target made absolute: full URLs as they are, "//host" with the page's scheme, "/path" with its host, anything else below
    the page's folder; null for an empty one."""
    t = F.trim(F.regexp_replace(target, "&amp;", "&"))
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return F.when(t == "", None).when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), t).when(t.startswith("//"), F.concat(scheme, t)) \
        .when(t.startswith("/"), F.concat(origin, t)).otherwise(F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), t))


def node_of(url: Column) -> Column:
    """128-bit name of a URL in the graph: the fragment does not count, scheme and host are case-blind. Pages of one node fit the same rules."""
    head = lower_ascii(F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1))
    rest = F.regexp_extract(url, r"(?s)^(?:.*?://[^/?#]*)?([^#]*)", 1)
    return F.md5(F.concat(head, rest))


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): nodes of a page's URL and of its canonical or refresh target."""
    url, html = F.col(url_col), F.col(html_col)
    likely = html.rlike("(?i)canonical|refresh")
    targets = F.array(*[F.when(likely, absolute(url, _first_group(html, p))) for p in (LINK, REFRESH)])
    return (pages.where(url.isNotNull()).select(node_of(url).alias("a"), F.explode(F.array_compact(targets)).alias("target"))
            .select("a", node_of(F.col("target")).alias("b")).where("a <> b"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, redirects: DataFrame | None = None,
          id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, component (the alias class, null where a page has no alias).

    ``redirects`` holds further links (from_url, to_url). A null url and one without "://" have an empty host and path and no rule; a page
    without a rule and without a blocked alias is allowed. Repeated rows each give a row; other columns are ignored. Aliases that are
    not pages pass a block on and are judged by the rules like pages.
    """
    rules = RULES if rules is None else rules
    url = F.col(url_col)
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    judged = judged.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "node", "_rule.*")
    links = page_links(pages, url_col, html_col)
    judge_targets = None
    if redirects is not None:
        given = redirects.where("from_url is not null and to_url is not null")
        links = links.unionByName(given.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")).where("a <> b"))
        judge_targets = _blocked(given.select("from_url").union(given.select("to_url")), rules)
    links = cut_lineage(links.distinct())
    if links.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"),
                             F.lit(None).cast("string").alias("component"))
    judged = cut_lineage(judged)
    classes = cut_lineage(components(links))
    blocked = judged.where("verdict = 'block'").select("node")
    for more in (judge_targets, _blocked(_targets(pages, url_col, html_col), rules)):
        blocked = blocked if more is None else blocked.union(more)
    blocked = cut_lineage(blocked.distinct())
    bad = cut_lineage(classes.join(blocked, "node", "left_semi").select("root").distinct().withColumn("bad", F.lit(True)))
    member = classes.join(F.broadcast(bad), "root", "left") if fits_broadcast(bad) else join_hot(classes, bad, "root")
    found = join_hot(judged, cut_lineage(member), "node")
    verdict = F.coalesce("verdict", F.when(F.col("bad"), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("root").alias("component"))


def _targets(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    url, html = F.col(url_col), F.col(html_col)
    likely = pages.where(url.isNotNull() & html.rlike("(?i)canonical|refresh"))
    return likely.select(F.explode(F.array_compact(F.array(*[absolute(url, _first_group(html, p)) for p in (LINK, REFRESH)]))))


def _blocked(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Nodes of the URLs, pages or not, that a rule blocks."""
    url = F.col(urls.columns[0])
    return urls.where(rule_of(host_of(url), path_of(url), rules)["verdict"] == "block").select(node_of(url).alias("node"))
