"""Operator 7. URL filter lists: host-suffix and path-prefix expressions, joined on short hash prefixes.

Each distinct (host, path) is expanded into the expressions that a rule could name: suffixes of the host
with as many labels as some rule's host has, each with the prefixes of the path that are as long as some
rule's path. Expressions meet rules in an equi-join on the first 8 hex digits of their SHA-256; the whole
digest then confirms, and of the rules that fit the longest wins (then the longer host, then block).

Null urls and urls without ``://`` have an empty host and path, fit no rule and get the default verdict.
Every input row gives one row, repeated ones too. Input columns named like results are replaced; all others
are kept, whatever their names. A url is judged whole however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm._shared import table

#: up to so many rules go to every executor; more are joined by a shuffle on the hash prefix
BROADCAST_RULES = 100_000
#: hex digits of the short hash
SHORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _keys(expression: Column) -> tuple[Column, Column]:
    digest = F.sha2(expression, 256)
    return F.substring(digest, 1, SHORT).alias("short"), digest.alias("digest")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; ``rules`` has (verdict, host, path)."""
    rules = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")).where("host is not null").distinct()
    # how many labels and characters rules have: at most as many values as the longest rule is long
    labels = [r[0] for r in rules.select(F.size(F.split("host", "[.]"))).distinct().collect()]
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]
    n_rules = rules.count()

    h, p = host_and_path(F.col(url))
    # the input's columns travel in one, so no name of theirs can meet one of ours
    pages = pages.select(F.struct(*[c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]).alias("row"), h.alias("host"), p.alias("path"))
    if not n_rules:
        return pages.select("row.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    parts = F.split("host", "[.]")
    suffixes = F.transform(F.filter(F.array(*map(F.lit, labels)), lambda k: k <= F.size(parts)), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    wanted = (
        pages.select("host", "path").where("host <> ''").distinct()
        .withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
        .select("host", "path", *_keys(F.concat("suffix", "prefix")))
    )
    listed = rules.select(*_keys(F.concat("host", "path")), F.struct(
        (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), (F.col("verdict") == "block").cast("int").alias("block"),
        F.concat("host", "path").alias("rule"), "verdict").alias("fit"))
    if n_rules <= BROADCAST_RULES:
        listed = F.broadcast(listed)
    fits = (
        wanted.withColumnRenamed("digest", "own").join(listed, "short").where("own = digest")
        .groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(F.max("fit").alias("fit"))
    )
    joined = pages.join(fits, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    return joined.select("row.*", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.lit(default)).alias("verdict"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


SQL = """
with rules(verdict, host, path) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
split as (select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
fit as (select s.page_id, s.host, s.path, r.host || r.path as rule, r.verdict,
               row_number() over (partition by s.page_id order by length(r.host) + length(r.path) desc nulls last, length(r.host) desc, r.verdict desc) as k
        from split s left join rules r on (s.host = r.host or ends_with(s.host, '.' || r.host)) and starts_with(s.path, r.path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from fit where k = 1
"""
