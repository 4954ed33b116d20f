"""URL rules by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.common import table

PREFIX_HEX = 8  # hex digits of the short hash the join runs on
DEFAULT_VERDICT = "allow"  # of a url that no rule fits

RULES = "values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), " \
        "('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')"


def standard_rules(spark: SparkSession) -> DataFrame:
    return spark.sql(f"select * from {RULES} as r(rule_host, rule_path, action)")


def with_parts(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path of its url; both empty without ``://``."""
    rest = F.expr("case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) end")
    rest = F.coalesce(rest, F.lit(""))
    return pages.withColumns({
        "host": F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1),
                            "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
        "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)})


def expressions(places: DataFrame, rules: DataFrame) -> DataFrame:
    """Host-suffix and path-prefix expressions of each (host, path).

    Only expressions of a shape (host length, path length) that some rule has can match one,
    so just these are made.  Shapes are bounded by the lengths of hosts and paths, however
    many rules there are.
    """
    shapes = [(r["h"], r["p"]) for r in rules.select(
        F.length("rule_host").alias("h"), F.length("rule_path").alias("p")).distinct().collect()]
    if not shapes:
        shapes = [(-1, -1)]
    made = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(p).alias("p")) for h, p in sorted(shapes)])
    return places.select("host", "path", F.explode(made).alias("s")).where(
        "s.h >= 0 and s.p <= length(path) and (s.h = length(host) or "
        "(s.h < length(host) and substring(host, length(host) - s.h, 1) = '.'))"
    ).select("host", "path", F.expr(
        "concat(substring(host, length(host) - s.h + 1), substring(path, 1, s.p))").alias("expression"))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``.

    ``rules`` has rule_host, rule_path, action; a missing host or path counts as empty.  The
    expressions of each distinct (host, path) meet the rules on the first ``PREFIX_HEX`` digits
    of their SHA-256, then full digests must agree.  Of the rules that fit, the longest
    expression wins; one stated twice with both actions blocks.  A missing url, an empty one
    or one without ``://`` has an empty host and path.  Repeated rows are judged each; an empty
    table gives no rows; other columns go.
    """
    rules = rules.select(F.coalesce("rule_host", F.lit("")).alias("rule_host"),
                         F.coalesce("rule_path", F.lit("")).alias("rule_path"), "action")
    digest = lambda c: F.sha2(c, 256)
    stated = rules.select(F.concat("rule_host", "rule_path").alias("rule"), "action").groupBy("rule").agg(
        F.max("action").alias("action")).withColumn("rule_digest", digest("rule"))
    stated = stated.withColumn("short", F.substring("rule_digest", 1, PREFIX_HEX))
    parts = with_parts(pages.select("page_id", "url")).drop("url")
    asked = expressions(parts.select("host", "path").distinct(), rules).withColumn("digest", digest("expression"))
    asked = asked.withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    fits = asked.join(stated, "short").where("digest = rule_digest")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(
        F.length("rule").alias("n"), F.col("rule"), F.col("action"))).alias("b"))
    return parts.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("b.rule").alias("rule"),
        F.coalesce("b.action", F.lit(DEFAULT_VERDICT)).alias("verdict"))


def op9_url_filters(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"), standard_rules(spark))


SQL = f"""
with p as (select page_id, case when contains(url, '://') then substring(url, instr(url, '://') + 3)
                                else '' end rest from pages),
q as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz') host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path, row_number() over () as rid from p),
r(rule_host, rule_path, action) as ({RULES}),
m as (select rid, first(rule_host || rule_path order by length(rule_host || rule_path) desc) rule,
             first(action order by length(rule_host || rule_path) desc) action
      from q join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
      group by rid)
select page_id, host, path, rule, coalesce(action, '{DEFAULT_VERDICT}') verdict from q left join m using (rid)
"""

QUERIES = {"op9_url_filters": op9_url_filters}
ORACLES = {"op9_url_filters": SQL}
