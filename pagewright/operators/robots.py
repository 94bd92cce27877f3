"""Robots files and the verdicts they give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.robots import chosen_group_sql, first_match_sql, groups_sql, lines_sql, target_sql
from ..functions.urls import netloc_of
from .lookup import lookup


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """``(host, sitemap_url)`` of the ``Sitemap:`` lines, in any letter case."""
    lines = robots.select("host", F.explode(F.expr(lines_sql("body"))).alias("line"))
    return lines.filter(F.lower("line").startswith("sitemap:")).select(
        "host", F.trim(F.expr("substring(line, 9)"), F.lit(" \t")).alias("sitemap_url")
    )


def parse_robots(robots: DataFrame) -> DataFrame:
    """``(host, group_no, agents, rule_no, allow, path, crawl_delay)``.

    A group without allow or disallow line gives one row without a rule.
    """
    groups = robots.select("host", F.posexplode(F.expr(groups_sql("body"))).alias("g", "grp"))
    rules = groups.select("host", "g", "grp", F.posexplode_outer("grp.rules").alias("r", "rule"))
    return rules.select(
        "host",
        (F.col("g") + 1).alias("group_no"),
        F.col("grp.agents").alias("agents"),
        (F.col("r") + 1).alias("rule_no"),
        F.col("rule.allow").alias("allow"),
        F.col("rule.path").alias("path"),
        F.col("grp.crawl_delay").alias("crawl_delay"),
    )


def robots_policy(robots: DataFrame, agent: str) -> DataFrame:
    """``(host, read, rules, crawl_delay)`` for one agent, one row per host.

    ``read`` tells how the file was met: ``rules``, ``allow`` (no such file) or
    ``deny`` (access refused, server error, never read).  Should a host come
    with several captures, the latest by ``captured_at`` counts, and without such
    a column, or at one time, the largest ``(status_code, body)``; they are merged
    before anything is parsed.
    """
    status = F.col("status_code")
    met = (
        F.when(status.isin(401, 403), F.lit("deny"))
        .when(status.between(400, 499), F.lit("allow"))
        .when((status >= 500) | F.col("body").isNull(), F.lit("deny"))
        .otherwise(F.lit("rules"))
    )
    time = ["captured_at"] if "captured_at" in robots.columns else []
    one = robots.groupBy("host").agg(F.max(F.struct(*time, "status_code", "body")).alias("m"))
    chosen = F.expr(let(groups_sql("body"), lambda g: chosen_group_sql(g, agent)))
    return (
        one.select("host", "m.status_code", "m.body")
        .select("host", met.alias("read"), chosen.alias("grp"))
        .select("host", "read", F.col("grp.rules").alias("rules"), F.col("grp.crawl_delay").alias("crawl_delay"))
    )


def robots_verdict(
    urls: DataFrame,
    robots: DataFrame,
    agent: str,
    on_missing: str = "allow",
    robots_host: str | None = None,
    ignore_robots: bool = False,
    column: str = "url",
) -> DataFrame:
    """``urls`` with ``allowed BOOLEAN``.

    Each host's own file decides, joined on the host; Spark broadcasts the
    policies when they are small and splits a hot host otherwise.
    ``robots_host`` judges every URL by that one host's file instead.
    """
    if on_missing not in ("allow", "deny"):
        raise ValueError("on_missing must be 'allow' or 'deny'")
    if ignore_robots:
        return urls.withColumn("allowed", F.lit(True))
    if robots_host is None:
        policy = robots_policy(robots, agent)
        keyed = urls.withColumn("__host", netloc_of(column))
    else:
        # one row by construction, so its size is that of one robots file
        policy = F.broadcast(robots_policy(robots.filter(F.col("host") == robots_host), agent))
        keyed = urls.withColumn("__host", F.lit(robots_host))
    policy = policy.select(
        F.col("host").alias("__host"), F.col("read").alias("__read"), F.col("rules").alias("__rules")
    )
    by_rules = F.expr(let(target_sql(f"`{column}`"), lambda t: first_match_sql("__rules", t)))
    allowed = (
        F.when(F.col("__read").isNull(), F.lit(on_missing == "allow"))
        .when(F.col("__read") == "deny", F.lit(False))
        .when((F.col("__read") == "allow") | F.col("__rules").isNull(), F.lit(True))
        .otherwise(by_rules)
    )
    return (
        lookup(keyed, policy, "__host")
        .withColumn("allowed", allowed)
        .drop("__host", "__read", "__rules")
    )
