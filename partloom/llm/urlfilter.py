"""URL filters that hold for aliases too: rules, redirect equivalence and explicit allow precedence. DataFrame functions only.

A rule (host, path, action) fits a url if its host is the rule's host or a subdomain of it and its path starts with the
rule's path; the longest rule wins, allow before block among equals. Hosts are compared by equality on every suffix of a
url's host, so rules are joined, not tried one by one.

Urls are aliases if redirects or canonical links connect them, over any number of steps; fragments don't count. A url
without a rule of its own takes the verdict of its class: allow if one of its aliases is allowed by a rule, else block if
one is blocked, else the default, which is allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.llm.components import connected_components
from partloom.llm.shared import ascii_lower, stored

#: The rules of op4.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"


def _behind_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def url_host(url: Column) -> Column:
    """Behind the first :// up to / ? # or the end, A-Z in lower case; empty for null or no ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(_behind_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end up to ? # or the end."""
    return F.coalesce(F.regexp_extract(_behind_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A url as a node of the alias graph: host in lower case, no fragment; null for urls without a host."""
    rest = F.regexp_extract(_behind_scheme(url), r"^[^/?#]*([^#]*)", 1)
    scheme = ascii_lower(F.substring_index(url, "://", 1))
    return F.when(url_host(url) != "", F.concat(scheme, F.lit("://"), url_host(url), F.when(rest == "", "/").otherwise(rest)))


def _attribute(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("([^"]*)"|'([^']*)'|([^\s"'>]+))""", 1)
    return F.regexp_replace(F.regexp_replace(quoted, r"""^["']|["']$""", ""), "&amp;", "&")


def _resolved(url: Column, to: Column) -> Column:
    """Path, query and fragment of a target without scheme and host, by RFC 3986: behind the page's path up to its last /,
    without . and .. segments; a query alone goes behind the whole path, a fragment alone behind the page's query too."""
    page = F.when(url_path(url) == "", "/").otherwise(url_path(url))
    path, tail = F.regexp_extract(to, r"^[^?#]*", 0), F.regexp_extract(to, r"^[^?#]*(?s:(.*))$", 1)
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.regexp_extract(page, r"^(?s:.*)/", 0), path))
    parts = F.split(F.substr(full, F.lit(2)), "/")
    up = lambda out, x: F.when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when(x == ".", out).otherwise(F.concat(out, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), up)
    folder = F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0)
    plain = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder, "/").otherwise(""))
    query = F.regexp_extract(_behind_scheme(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(path != "", F.concat(plain, tail)).when(to.startswith("#"), F.concat(page, query, to)).otherwise(F.concat(page, to))


def page_links(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """a, b: urls of pages and the targets of their canonical links and refresh redirects; targets without a scheme are
    resolved against the page's url."""
    tags = pages.where(F.col(html_col).rlike(r"(?i)canonical|http-equiv")).select(F.col(url_col).alias("url"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(_TAG), 0)).alias("tag"))
    canonical = F.lower(_attribute(F.col("tag"), "rel")) == "canonical"
    refresh = F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh"
    to = F.when(canonical, _attribute(F.col("tag"), "href")).when(refresh, F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)url\s*=\s*['\"]?([^'\"]+)", 1))
    links = stored(tags.select("url", F.trim(to).alias("to")).where("to <> ''"), "targets")  # ends one expression, which would be too long to compile
    scheme, host = F.substring_index("url", "://", 1), url_host(F.col("url"))
    full = F.when(F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("to")).when(F.col("to").startswith("//"), F.concat(scheme, F.lit(":"), "to")).when(~F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(scheme, F.lit("://"), host, _resolved(F.col("url"), F.col("to"))))
    links = stored(links.select("url", full.alias("full")), "links")
    return links.select(node_of(F.col("url")).alias("a"), node_of(F.col("full")).alias("b"))


def rule_matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (node, host, path) to node, rule and action of the rule that wins, where one fits."""
    n = F.size(F.split("host", r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))
    fits = urls.where("host <> ''").select("key", "path", F.explode(suffixes).alias("suffix")).join(rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), "action"), "suffix").where(F.col("path").startswith(F.col("start")))
    rule = F.concat("suffix", "start")
    best = F.max(F.struct(F.length(rule).alias("length"), (F.col("action") == "allow").alias("allowed"), rule.alias("rule"), "action")).alias("best")
    return fits.groupBy("key").agg(best).select("key", "best.rule", "best.action")


def judge_urls(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    links (a, b): further redirects between urls. Rows with equal urls are judged alike, whatever their ids; null urls and
    urls without :// have no host, no rule and no alias. Urls and pages of any length are read whole. Rules with nulls are ignored. An empty table gives no rows; extra
    columns are ignored.
    """
    edges = page_links(pages, url_col=url_col, html_col=html_col)
    if links is not None:
        edges = edges.union(links.select(node_of(F.col("a")), node_of(F.col("b"))))
    classes = connected_components(edges)
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"), node_of(url).alias("node"))
    rows = rows.withColumn("key", F.struct("host", "path"))
    # no rule and no alias reaches them, and as one key they would meet in one task
    unreachable = (F.col("host") == "") & F.col("node").isNull()
    named, nameless = rows.where(~unreachable), rows.where(unreachable)
    # aliases that are no pages can carry a rule as well
    known = named.select("node", "host", "path", "key").union(classes.select(F.explode(F.array("node", "component")).alias("node")).select("node", url_host(F.col("node")).alias("host"), url_path(F.col("node")).alias("path")).withColumn("key", F.struct("host", "path"))).distinct()
    matched = stored(rule_matches(known.select("key", "host", "path").distinct(), rules.dropna()), "rules")
    voices = known.where("node is not null").join(matched, "key")
    members = classes.select("node", "component").union(classes.select("component", "component")).distinct()
    of_class = voices.join(members, "node").groupBy("component").agg(F.max(F.col("action") == "allow").alias("allowed"))
    inherited = members.join(of_class, "component").select("node", F.when(F.col("allowed"), "allow").otherwise("block").alias("by_class"))
    judged = named.join(matched, "key", "left").join(inherited, "node", "left")
    judged = judged.select("page_id", "host", "path", "rule", F.coalesce("action", "by_class", F.lit(default)).alias("verdict"))
    return judged.unionByName(nameless.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, action string")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP4_SQL = r"""
with recursive p as (
  select page_id, url, html, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
r as (
  select page_id, url, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) tail from p),
n as (
  select *, case when host <> '' then concat(lower(split_part(url, '://', 1)), '://', host, case when tail = '' then '/' else tail end) end node from r),
rules(rh, rp, act) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m as (
  select distinct host, path, first_value(concat(rh, rp)) over w rule, first_value(act) over w act
  from (select distinct host, path from n) join rules on (host = rh or ends_with(host, concat('.', rh))) and starts_with(path, rp)
  window w as (partition by host, path order by length(concat(rh, rp)) desc, act)),
e as (
  select node a, regexp_extract(tag, '(?i)href="([^"]*)"', 1) b
  from (select node, unnest(regexp_extract_all(html, '(?i)<link[^>]*>')) tag from n) where tag ilike '%rel="canonical"%' and node is not null),
reach(node, other) as (
  select node, node from n where node is not null
  union
  select reach.node, case when e.a = reach.other then e.b else e.a end from reach join e on reach.other in (e.a, e.b)),
voice as (
  select reach.node, max(case when m.act = 'allow' then 1 else 0 end) allowed
  from reach join n on n.node = reach.other join m on m.host = n.host and m.path = n.path where reach.node <> reach.other group by 1)
select page_id, n.host, n.path, rule, coalesce(act, case when allowed = 1 then 'allow' when allowed = 0 then 'block' end, 'allow') verdict
from n left join m on m.host = n.host and m.path = n.path left join voice on voice.node = n.node
"""
