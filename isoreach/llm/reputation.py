"""URL rules, and the reputation of a host from the pages that the rules have judged.

Only DataFrame and SQL functions. Pages are counted per host before anything is shuffled; the levels above work on
those counts. Each level shrinks its rate of blocked pages towards the level above by a beta-binomial prior:

    all pages -> suffix (last label) -> registered domain (last two labels) -> host

The prior's strength at a level is estimated from the data by the method of moments. A page without a rule is blocked
where the lower bound of its host's posterior, mean - z * standard deviation, exceeds ``cutoff``; the variance of a
level includes what is unsure about the level above, so a host without any evidence below the root is not blocked.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is judged at the root
of the hierarchy. Repeated rows are judged alike, each with its own row. No labelled page at all: prior mean 1/2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.session import materialise

#: (rule, verdict); the part before the first slash is the host.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end; A-Z lower-cased."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + F.lit(3))).otherwise(F.lit(""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + F.lit(3))).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    fits = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, start = rule.partition("/")
        fit = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        fits = F.when(fit, F.lit(rule)).otherwise(fits)
    return fits


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for text, verdict in rules:
        out = F.when(rule == text, F.lit(verdict)).otherwise(out)
    return out


def _strength(table: str) -> str:
    """Prior strength from the spread of rates around the parents' means, as a scalar subquery."""
    spread = "sum(n * pow(bad / n - parent, 2)) - sum(parent * (1 - parent))"
    most = "sum(parent * (1 - parent) * (n - 1))"
    share = f"CASE WHEN {most} > 0 THEN least(0.99D, greatest(0.001D, ({spread}) / ({most}))) ELSE 0.5D END"
    return f"(SELECT 1 / ({share}) - 1 FROM {table} WHERE n > 0)"


def _level(table: str) -> str:
    """Adds the strength, the posterior mean and its variance, with what the parent's own variance adds."""
    return f"""
    SELECT *, mean * (1 - mean) / (strength + n + 1) + pow(strength / (n + strength), 2) * parent_var AS var FROM (
      SELECT *, (bad + strength * parent) / (n + strength) AS mean FROM (
        SELECT t.*, {_strength(table)} AS strength FROM {table} t))"""


def reputation_sql(counts: str) -> str:
    """Posterior of every host from (host, n, bad), the same text for both engines."""
    return f"""
    WITH hosts AS (
      SELECT host, n, bad,
             CASE WHEN instr(host, '.') > 0 THEN regexp_extract(host, '([^.]*[.])?[^.]*$', 0) ELSE host END AS domain,
             regexp_extract(host, '[^.]*$', 0) AS suffix
      FROM {counts}),
    overall AS (SELECT (sum(bad) + 0.5D) / (sum(n) + 1) AS rate FROM hosts),
    suffix_counts AS (
      SELECT suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad, (SELECT rate FROM overall) AS parent,
             0.0D AS parent_var
      FROM hosts GROUP BY suffix),
    suffixes AS ({_level("suffix_counts")}),
    domain_counts AS (
      SELECT d.domain, d.n, d.bad, s.mean AS parent, s.var AS parent_var
      FROM (SELECT suffix, domain, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bad) AS BIGINT) AS bad
            FROM hosts GROUP BY suffix, domain) d
      JOIN suffixes s ON d.suffix = s.suffix),
    domains AS ({_level("domain_counts")}),
    host_counts AS (
      SELECT h.host, h.n, h.bad, d.mean AS parent, d.var AS parent_var FROM hosts h JOIN domains d ON h.domain = d.domain)
    {_level("host_counts")}"""


def judge_urls(pages: DataFrame, rules=RULES, z: float = 2.0, cutoff: float = 0.5) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the host's posterior mean and lower bound."""
    spark = pages.sparkSession
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = split.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = ruled.withColumn("said", verdict_of(F.col("rule"), rules))
    labelled = F.col("said").isNotNull()
    counts = materialise(
        ruled.groupBy("host").agg(
            F.sum(labelled.cast("long")).alias("n"), F.sum((F.col("said") == "block").cast("long")).alias("bad")
        ).select("host", "n", F.coalesce("bad", F.lit(0).cast("long")).alias("bad")),
        "host-counts",
    )
    scores = spark.sql(reputation_sql("{counts}"), counts=counts)
    scores = scores.select("host", F.col("mean").alias("reputation"), (F.col("mean") - z * F.sqrt("var")).alias("low"))
    own = F.when(F.col("low") > cutoff, "block").otherwise("allow")
    return ruled.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"),
        F.round("reputation", 6).alias("reputation"),
    )


def judge_sql(rules=RULES, z: float = 2.0, cutoff: float = 0.5) -> str:
    """The same rows for DuckDB."""
    start = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    rule = "NULL"
    said = "NULL"
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, path = text.partition("/")
        rule = f"CASE WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{path}') THEN '{text}' ELSE {rule} END"
        said = f"CASE WHEN rule = '{text}' THEN '{verdict}' ELSE {said} END"
    duck = reputation_sql("counts").replace("0.5D", "0.5::DOUBLE").replace("0.99D", "0.99::DOUBLE").replace("0.001D", "0.001::DOUBLE").replace("0.0D", "0.0::DOUBLE")
    return f"""
    WITH split AS (
      SELECT page_id,
             coalesce(translate(regexp_extract({start}, '^[^/?#]*', 0), '{UPPER}', '{LOWER}'), '') AS host,
             coalesce(regexp_extract({start}, '^[^/?#]*([^?#]*)', 1), '') AS path
      FROM pages),
    fitted AS (SELECT *, {rule} AS rule FROM split),
    ruled AS (SELECT *, {said} AS said FROM fitted),
    counts AS (
      SELECT host, count(said) AS n, count(CASE WHEN said = 'block' THEN 1 END) AS bad FROM ruled GROUP BY host),
    scores AS ({duck})
    SELECT r.page_id, r.host, r.path, r.rule, round(s.mean, 6) AS reputation,
           coalesce(r.said, CASE WHEN s.mean - {z} * sqrt(s.var) > {cutoff} THEN 'block' ELSE 'allow' END) AS verdict
    FROM ruled r LEFT JOIN scores s ON r.host = s.host"""
