"""URL filters with redirect equivalence.

Rules judge a url by host and path, the longest rule winning.  Urls that no rule fits take the
verdict of their aliases: redirect edges (meta refresh) and canonical links join urls, connected
components of that graph are the alias groups, and a group with an explicit allow is allowed, else
one with a block is blocked.  A page's own rule always precedes its group's verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, written
from .components import connected_components

#: (verdict, host, path): the rules of the contract.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
CANONICAL = r"""(?i)<link\b[^<>]*\brel\s*=\s*["']?canonical\b[^<>]*>"""
REFRESH = r"""(?i)<meta\b[^<>]*\bhttp-equiv\s*=\s*["']?refresh\b[^<>]*>"""


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.lit(2147483647))
    return F.when(F.instr(url, "://") > 0, lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.lit(2147483647))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls. Of equal rules, allow precedes block."""
    name, verdict = None, None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def plain(url: Column) -> Column:
    """A url as a node: scheme and host lower-cased, the fragment gone."""
    u = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    return F.concat(lower_ascii(head), F.substring(u, F.length(head) + 1, F.lit(2147483647)))


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, to): canonical links and meta-refresh redirects of each page, targets made absolute."""
    url, html = F.col(url_col), F.col(html_col)
    link = F.transform(F.regexp_extract_all(html, F.lit(CANONICAL), F.lit(0)), lambda t: F.regexp_extract(t, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    meta = F.transform(F.regexp_extract_all(html, F.lit(REFRESH), F.lit(0)), lambda t: F.regexp_extract(t, r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    empty = F.array().cast("array<string>")
    link = F.when(html.rlike("(?i)canonical"), link).otherwise(empty)
    meta = F.when(html.rlike("(?i)http-equiv"), meta).otherwise(empty)
    rows = pages.filter(url.isNotNull() & (F.instr(url, "://") > 0)).select(url.alias("url"), F.explode(F.concat(link, meta)).alias("to")).filter("to <> ''")
    to = F.replace(F.col("to"), F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract("url", "^([^:]*):", 1)
    root = F.regexp_extract("url", r"^[^:]*://[^/?#]*", 0)
    folder = F.regexp_extract("url", r"^[^:]*://[^/?#]*(?:/(?:[^?#]*/)?)?", 0)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    full = F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.startswith("//"), F.concat(scheme, F.lit(":"), to)).when(to.startswith("/"), F.concat(root, to)).otherwise(F.concat(folder, to))
    return rows.select(plain(F.col("url")).alias("url"), plain(full).alias("to"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A null url, or one without ://, has empty host and path, fits no rule and has no aliases: allow.  A
    null html has no edges.  Repeated rows are judged alike; an empty table gives no rows; other
    columns are ignored.  Rules come as a list, so their number is the caller's.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"), F.when(F.instr(url, "://") > 0, F.xxhash64(plain(url))).alias("node"))
    rule, own = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("own", own)
    edges = written(alias_edges(pages, url_col, html_col).dropDuplicates(), "aliases")
    groups = connected_components(edges.select(F.xxhash64("url").alias("u"), F.xxhash64("to").alias("v")))
    ends = edges.select(F.explode(F.array("url", "to")).alias("url")).dropDuplicates()
    _, verdict = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)
    ends = ends.select(F.xxhash64("url").alias("id"), verdict.alias("v")).join(groups, "id")
    of_group = ends.groupBy("root").agg(F.max(F.col("v") == "allow").alias("allowed"), F.max(F.col("v") == "block").alias("blocked"))
    of_node = groups.join(of_group, "root").select(F.col("id").alias("node"), F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("group"))
    return rows.join(of_node, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("own", "group", F.lit("allow")).alias("verdict"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP10_SQL = r"""
with recursive p as (
  select page_id, url, html,
    case when contains(url, '://') then translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when contains(url, '://') then regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from pages
), r as (select * from (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) t(v, h, pre)),
e0 as (
  select page_id, url, replace(t, '&amp;', '&') as t, regexp_extract(url, '^([^:]*):', 1) as scheme, regexp_extract(url, '^[^:]*://[^/?#]*') as root,
    regexp_extract(url, '^[^:]*://[^/?#]*(?:/(?:[^?#]*/)?)?') as folder
  from (select page_id, url, unnest(list_concat(
      list_transform(regexp_extract_all(coalesce(html, ''), '(?i)<link\b[^<>]*\brel\s*=\s*["'']?canonical\b[^<>]*>'), lambda x: regexp_extract(x, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
      list_transform(regexp_extract_all(coalesce(html, ''), '(?i)<meta\b[^<>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^<>]*>'), lambda x: regexp_extract(x, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))) as t
    from pages where contains(url, '://')) where t <> ''
), e1 as (
  select regexp_replace(url, '#.*$', '') as a, regexp_replace(case when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') then t when starts_with(t, '//') then scheme || ':' || t
    when starts_with(t, '/') then root || t else case when ends_with(folder, '/') then folder else folder || '/' end || t end, '#.*$', '') as b from e0
), e2 as (select a, b, regexp_extract(a, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') as ha, regexp_extract(b, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') as hb from e1),
e as (
  select translate(ha, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(a, length(ha) + 1) as a, translate(hb, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(b, length(hb) + 1) as b from e2
), n as (select a, b from e union select b, a from e),
reach as (select a, b from n union select reach.a, n.b from reach join n on reach.b = n.a),
j as (
  select distinct x.b as url, first_value(r.v) over (partition by x.b order by length(r.h || r.pre) desc) as v
  from (select distinct b from n) x join r
    on (('.' || translate(regexp_extract(substr(x.b, instr(x.b, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) like '%.' || r.h)
    and starts_with(regexp_extract(substr(x.b, instr(x.b, '://') + 3), '^[^/?#]*([^?#]*)', 1), r.pre)
), g as (
  select reach.a, bool_or(j.v = 'allow') as allowed, bool_or(j.v = 'block') as blocked from reach join j on reach.b = j.url group by reach.a
), own as (
  select p.page_id, max_by(r.h || r.pre, length(r.h || r.pre)) as rule, max_by(r.v, length(r.h || r.pre)) as v
  from p join r on (p.host = r.h or ends_with(p.host, '.' || r.h)) and starts_with(p.path, r.pre) group by p.page_id
)
select p.page_id, coalesce(p.host, '') as host, coalesce(p.path, '') as path, own.rule,
  coalesce(own.v, case when g.allowed then 'allow' when g.blocked then 'block' end, 'allow') as verdict
from (select *, regexp_replace(url, '#.*$', '') as bare from p) p left join own using (page_id)
  left join g on g.a = translate(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(bare, length(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')) + 1)
"""
