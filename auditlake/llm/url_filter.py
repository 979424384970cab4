"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules that may be broadcast, one digest and one expression each; more are joined by shuffle with salted urls.
BROADCAST_RULES = 200_000
SALTS = 32
PARTS = r"://([^/?#]*)([^?#]*)"


def rule_table(rules: DataFrame) -> DataFrame:
    """(host, path, action) as (rule, action, digest, prefix); of equal rules block wins; rules without host are void."""
    return (
        rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
        .where("host != '' and action in ('allow', 'block')")
        .groupBy("host", "path")
        .agg(F.max("action").alias("action"))  # block > allow
        .withColumn("rule", F.concat("host", "path"))
        .withColumn("digest", F.sha2("rule", 256))
        .withColumn("prefix", F.substring("digest", 1, 8))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) for every row of pages.

    Each distinct (key, url) is expanded into host suffix + path prefix expressions, of those numbers of labels and
    path lengths only that some rule has. The expressions meet rules on 8 hex digits of their SHA-256; the full digest
    confirms; of the rules that fit, the longest wins, then the longer host. Without a rule the verdict is `default`.
    Null urls and urls without '://' have empty host and path. Repeated rows each come back. The rules' table is
    broadcast up to BROADCAST_RULES rows; beyond, the urls' expressions are salted, so that a hot suffix such as
    `com/` is dealt to SALTS tasks.
    """
    table = durable(rule_table(rules))
    shapes = table.select(F.size(F.split("host", r"\.")).alias("n"), F.length("path").alias("m")).distinct().collect()  # at most labels x path lengths
    # copies of a (key, url) are judged once
    urls = (
        pages.select(pages[key].alias("key"), pages[url].alias("url"))
        .groupBy("key", "url")
        .agg(F.count("*").alias("copies"))
        .withColumn("host", F.translate(F.coalesce(F.regexp_extract("url", PARTS, 1), F.lit("")), UPPER, LOWER))
        .withColumn("path", F.coalesce(F.regexp_extract("url", PARTS, 2), F.lit("")))
    )
    labels = F.split("host", r"\.")
    # label number and path length of each shape in one number; a constant array, however many rules there are
    codes = F.array(*(F.lit(s.n << 32 | s.m) for s in shapes)).cast("array<bigint>")
    n, m = lambda c: F.shiftright(c, 32).cast("int"), lambda c: c.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    fit = F.filter(codes, lambda c: (F.size(labels) >= n(c)) & (F.length("path") >= m(c)))
    made = F.transform(fit, lambda c: F.concat(F.array_join(F.slice(labels, -n(c), n(c)), "."), F.left(F.col("path"), m(c))))
    terms = urls.withColumn("term", F.explode_outer(made)).withColumn("t_digest", F.sha2("term", 256)).withColumn("t_prefix", F.substring("t_digest", 1, 8))
    rule = table.select("rule", "action", "digest", "prefix", F.length("host").alias("host_length"))
    if table.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        met = (F.col("t_prefix") == F.col("prefix")) & (F.col("t_digest") == F.col("digest"))
        joined = terms.join(F.broadcast(rule), met, "left")
    else:
        salted = rule.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        terms = terms.withColumn("t_salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int"))
        met = (F.col("t_prefix") == F.col("prefix")) & (F.col("t_salt") == F.col("salt")) & (F.col("t_digest") == F.col("digest"))
        joined = terms.join(salted, met, "left")
    # a url's rules differ in length or in their host's: both, and the verdict, in one number, which hashes aggregate; the
    # rule's text is then the url's own
    best = F.max(F.when(F.col("rule").isNotNull(), F.shiftleft(F.length("rule").cast("long"), 32) + F.col("host_length") * 2 + (F.col("action") == "block").cast("int")))
    host_length = F.shiftright(F.col("best").bitwiseAND(F.lit((1 << 32) - 1)), 1).cast("int")
    rule_length = F.shiftright("best", 32).cast("int")
    won = F.when(F.col("best").isNotNull(), F.concat(F.right(F.col("host"), host_length), F.left(F.col("path"), rule_length - host_length)))
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best").bitwiseAND(F.lit(1)) == 1, "block").otherwise("allow")
    return (
        joined.groupBy("key", "url", "host", "path", "copies")
        .agg(best.alias("best"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(F.col("key").alias(key), "host", "path", won.alias("rule"), verdict.alias("verdict"))
    )


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "host string, path string, action string"))


OP5_SQL = r"""
with rules(host, path, action) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
urls as (
  select page_id, row_number() over () as k,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
fits as (
  select k, r.host || r.path as rule, r.action, row_number() over (partition by k order by length(r.host || r.path) desc) as place
  from urls u join rules r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path))
select u.page_id, u.host, u.path, f.rule, coalesce(f.action, 'allow') as verdict
from urls u left join fits f on u.k = f.k and f.place = 1
"""
