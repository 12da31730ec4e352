"""URL filters: a sort-merge range join with a stack of nested rules (DataFrame only).

A host is written label by label from its end ("com.example.www."), so that a rule's
host and all its subdomains form one interval of keys and intervals of different
rules nest or are disjoint. Distinct hosts and rule starts are sorted together; at a
host, the last rule start before it carries the stack of rules that enclose that
start, and those whose interval has not ended yet are the stack at the host. The
path decides among them, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .util import lower_az, table

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def parse(url):
    """(host, path) columns; both empty for null or without "://"."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return lower_az(part(1)), part(2)


def _key(host):
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", id_col: str = "page_id", default: str = "allow", part: int = 100_000) -> DataFrame:
    """One row per page: id, host, path, rule (null: none fits), verdict.

    rules has host, path, verdict. Null urls and urls without "://" get an empty host
    and path, fit no rule and get the default verdict. Of equal longest rules "block"
    wins. Repeated pages stay repeated; other columns of pages are ignored; an empty
    table gives an empty table.

    Scale: only distinct hosts are swept. Sweeps are dealt by the two top labels; a domain
    of more than `part` hosts is cut into as many sweeps as it needs, and its rules are
    copied to them; a rule of one label goes to the domains below it that occur. The rules
    of one host, and those above it, are one array. No side is broadcast by this code.
    """
    host, path = parse(F.col(url))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    p2 = F.substring_index("key", ".", 2)
    hosts = urls.groupBy("host").agg(F.lit(1).alias("one")).select("host", _key(F.col("host")).alias("key")).withColumn("p2", p2)
    sweeps = hosts.groupBy("p2").agg(F.ceil(F.count(F.lit(1)) / part).alias("sweeps"))
    hosts = hosts.join(sweeps, "p2").select("host", "key", "p2", F.pmod(F.xxhash64("host"), F.col("sweeps")).alias("salt"))

    r = rules.select(lower_az(F.col("host")).alias("rhost"), F.coalesce(F.col("path"), F.lit("")).alias("rpath"), F.col("verdict").alias("rverdict")).where("rhost is not null and rverdict is not null").distinct()
    r = r.select(_key(F.col("rhost")).alias("rkey"), F.struct(_key(F.col("rhost")).alias("rkey"), "rpath", "rverdict", F.concat("rhost", "rpath").alias("rule")).alias("r"))
    nodes = r.groupBy("rkey").agg(F.collect_list("r").alias("own"))  # the rules of one host
    labels = F.split(F.expr("substring(rkey, 1, length(rkey) - 1)"), r"\.", -1)
    above = nodes.select("rkey", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))).alias("up"))
    stacks = above.join(nodes.select(F.col("rkey").alias("up"), "own"), "up").groupBy("rkey").agg(F.flatten(F.collect_list("own")).alias("stack"))
    stacks = stacks.withColumn("one", F.size(F.split("rkey", r"\.", -1)) <= 2)  # rules of one label

    parts = hosts.select("p2", "salt").distinct()
    deep = stacks.where("not one").withColumn("p2", F.substring_index("rkey", ".", 2)).join(parts, "p2")
    flat = stacks.where("one").withColumn("p1", F.substring_index("rkey", ".", 1)).join(parts.withColumn("p1", F.substring_index("p2", ".", 1)), "p1")
    starts = deep.select("p2", "salt", "rkey", "stack").unionByName(flat.select("p2", "salt", "rkey", "stack"))
    events = hosts.select("p2", "salt", "key", F.lit(1).alias("kind"), "host").unionByName(starts.select("p2", "salt", F.col("rkey").alias("key"), F.lit(0).alias("kind"), "stack"), allowMissingColumns=True)
    sweep = Window.partitionBy("p2", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    active = swept.select("host", F.filter("stack", lambda s: F.col("key").startswith(s["rkey"])).alias("active"))

    fits = F.filter("active", lambda s: F.col("path").startswith(s["rpath"]))
    best = F.array_max(F.transform(fits, lambda s: F.struct(F.length(s["rule"]).alias("n"), s["rverdict"].alias("v"), s["rule"].alias("rule"))))
    judged = urls.join(active, "host", "left").withColumn("best", best)
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))


def rules_frame(spark: SparkSession, rules=tuple(RULES)) -> DataFrame:
    """The rules as a table without Python rows."""
    names = ("host", "path", "verdict")
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r, strict=True))) for r in rules))))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages: page_id, host, path, rule, verdict. A null url has an empty host and path;
    see judge()."""
    return judge(table(spark, sf_dir, "pages"), rules_frame(spark))


ORACLE = r"""
WITH cut AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
rules(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT c.page_id, c.host, c.path, arg_max(rh || rp, length(rh || rp)) AS rule, coalesce(arg_max(rv, length(rh || rp)), 'allow') AS verdict
FROM (SELECT *, row_number() OVER () AS n FROM cut) c LEFT JOIN rules ON (c.host = rh OR c.host LIKE '%.' || rh) AND starts_with(c.path, rp)
GROUP BY c.n, c.page_id, c.host, c.path
"""
