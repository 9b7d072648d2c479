"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed on full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import LOWER, UPPER, fresh, lower_ascii

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
DEFAULT = "allow"
SHORT = 8  # hex digits of the digest that the join runs on


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    rows = ", ".join(f"(:r{i}, :a{i})" for i in range(len(rules)))
    args = {f"r{i}": r for i, (r, _) in enumerate(rules)} | {f"a{i}": a for i, (_, a) in enumerate(rules)}
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(rule, action)", args=args)


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """Adds host, path, rule and verdict to every row of `pages`.

    `rules` has rule (host, then a path that begins with / or is empty) and action. A rule fits its host and
    all subdomains where the path of the url begins with its path. The longest rule wins; of equally long ones
    that with the longer host, then a block, then the first by code point. A url that no rule fits gets a null
    rule and the verdict `default`.

    Only as many labels and as long path prefixes are tried as some rule has. Distinct (host, path) pairs are
    expanded, so that a page logged many times is judged once; nothing is broadcast unless Spark sees that the
    rules are below its own size threshold. A null url, or one without ://, has an empty host and path and fits
    no rule. Repeated rows are kept; columns of `pages` named host, path, rule or verdict are replaced; an
    empty table gives an empty result.
    """
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    pages = pages.select(*keep, host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    r = rules.where("rule is not null and action is not null").select(
        F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER).alias("rule_host"),
        F.expr("substr(rule, length(substring_index(rule, '/', 1)) + 1)").alias("rule_path"),
        "rule",
        "action",
    )
    r = r.withColumn("digest", F.sha2(F.concat("rule_host", "rule_path"), 256)).withColumn("short", F.substring("digest", 1, SHORT))
    shape = r.agg(F.collect_set(F.size(F.split("rule_host", r"\."))), F.collect_set(F.length("rule_path"))).head()
    depths, lengths = [sorted(x) or [1] for x in shape]

    pairs = pages.where("host != ''").select("host", "path").distinct()
    labels = F.size(F.split("host", r"\."))
    fitting = F.filter(F.array(*map(F.lit, depths)), lambda d: d <= F.size(F.split(F.col("host"), r"\.")))
    hosts = pairs.select("host", "path", labels.alias("labels"), F.explode(fitting).alias("depth"))
    hosts = hosts.select("host", "path", F.expr("substring_index(host, '.', -depth)").alias("suffix"))
    prefixes = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
    tried = hosts.select("host", "path", "suffix", F.explode(prefixes).alias("n"))
    tried = tried.select("host", "path", F.sha2(F.concat("suffix", F.expr("substr(path, 1, n)")), 256).alias("full"))
    tried = tried.withColumn("short", F.substring("full", 1, SHORT))
    hit = tried.join(r, "short").where("full = digest")
    order = F.struct((-F.length("rule")).alias("a"), (-F.length("rule_host")).alias("b"), F.when(F.col("action") == "block", 0).otherwise(1).alias("c"), F.col("rule"))
    best = hit.groupBy("host", "path").agg(F.min_by(F.struct("rule", "action"), order).alias("won"))

    won = fresh(pages, "won")
    out = pages.join(best.withColumnRenamed("won", won), ["host", "path"], "left")
    return out.select(*keep, "host", "path", F.col(f"{won}.rule").alias("rule"), F.coalesce(f"{won}.action", F.lit(default)).alias("verdict"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages, rule_table(spark)).drop("url")


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), q AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM p
), r(rule, action, rule_host, rule_path) AS (
  VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
         ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')
)
SELECT page_id, host, path,
       (SELECT max_by(rule, length(rule)) FROM r WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule,
       coalesce((SELECT max_by(action, length(rule)) FROM r WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)), 'allow') AS verdict
FROM q
"""
