"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression with the literal tokens (runs of a-z and 0-9) that every url it fits must hold as
whole tokens. Each rule is filed under the one of its tokens that fewest urls hold; a url's tokens fetch candidate
rules, and only those run their expression. The index is a literal map inside the expression, so judging is a
narrow projection: no shuffle, no join, whatever the skew of hosts. One small aggregate before it counts the
rules' tokens over all urls (at most one row for each token of a rule).

Edge cases: a null url or one without `://` has an empty host and path and gets the default verdict; repeated rows
are judged one by one; input columns other than the key and the url are dropped, so names cannot clash; of equally
long host rules the greater (rule, verdict) wins.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txloom.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (rule, verdict): a host and the start of a path; a rule also fits subdomains, and the longest that fits wins.
HOST_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

#: (pattern over the lower-cased url, tokens that it needs); they block urls that no host rule fits.
PATTERNS = [
    (r"[/.]casino[/.]", ["casino"]),
    (r"[/.]adserver[/.]", ["adserver"]),
    (r"/wp-login\.php($|[?#])", ["wp", "login", "php"]),
]


def lowered(c: Column) -> Column:
    """A-Z only."""
    return F.translate(c, UPPER, LOWER)


def tokens(c: Column) -> Column:
    return F.array_distinct(F.split(c, "[^a-z0-9]+"))


def host_rule(rule: str) -> tuple[str, list[str]]:
    """The expression over host and path of a host rule, and its whole tokens."""
    host = rule.partition("/")[0]
    whole = re.findall(r"(?<![a-z0-9])[a-z0-9]+(?=[^a-z0-9])", rule) if re.fullmatch(r"[^A-Z]*", rule) else re.findall(r"(?<![a-z0-9])[a-z0-9]+(?=[^a-z0-9])", host + "/")
    return rf"^(?:[^/?#]*\.)?\Q{rule}\E", whole


def with_host(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host (A-Z lower-cased) and path."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    df = df.withColumn("host", lowered(F.regexp_extract(rest, r"^[^/?#]*", 0)))
    return df.withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def filter_urls(pages: DataFrame, hosts=HOST_RULES, patterns=PATTERNS, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule (the longest host rule that fits, else null), verdict, for each row of pages."""
    rules = [(len(r), r, v, *host_rule(r)) for r, v in hosts] + [(0, None, "block", p, ts) for p, ts in patterns]
    if bad := [r for r in rules if not r[4]]:
        raise ValueError(f"rules without a literal token: {bad}")
    base = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"))
    base = with_host(base).withColumn("whole", lowered(F.col("url"))).withColumn("tokens", tokens(F.col("whole")))
    used = sorted({t for r in rules for t in r[4]})
    counts = dict(base.select(F.explode(F.array_intersect("tokens", F.array(*map(F.lit, used)))).alias("t")).groupBy("t").count().collect()) if used else {}
    index: dict[str, list] = {}
    for r in rules:
        index.setdefault(min(r[4], key=lambda t: (counts.get(t, 0), t)), []).append(r)
    quoted = lambda x: "cast(null as string)" if x is None else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    entry = lambda r: f"struct({r[0]} as size, {quoted(r[1])} as rule, {quoted(r[2])} as verdict, {quoted(r[3])} as pattern)"
    filed = ", ".join(f"{quoted(t)}, array({', '.join(map(entry, rs))})" for t, rs in index.items())
    fetched = f"flatten(filter(transform(tokens, t -> try_element_at(map({filed}), t)), x -> x is not null))" if filed else None
    if fetched is None:
        return base.select(F.col("key").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    base = base.withColumn("fit", F.expr(f"filter({fetched}, r -> if(r.rule is null, whole, concat(host, path)) rlike r.pattern)"))
    base = base.withColumn("best", F.array_max("fit"))
    return base.select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages under the host rules and patterns above."""
    return filter_urls(table(spark, sf_dir, "pages"))


OP7_SQL = f"""
with p as (
  select page_id, coalesce(url, '') as url,
    case when contains(coalesce(url, ''), '://') then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages),
q as (
  select page_id, translate(url, '{UPPER}', '{LOWER}') as whole,
    translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
rules(rule, rhost, rpath, rverdict) as (values
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
best as (
  select q.*, (select max_by(rule, length(rule)) from rules
    where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)) as rule from q)
select page_id, host, path, best.rule as rule,
  case when best.rule is not null then rverdict
    when regexp_matches(whole, '[/.]casino[/.]') or regexp_matches(whole, '[/.]adserver[/.]')
      or regexp_matches(whole, '/wp-login\\.php($|[?#])') then 'block'
    else 'allow' end as verdict
from best left join rules on best.rule = rules.rule
"""
