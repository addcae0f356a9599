"""URL filter rules by a sort-merge range join, in DataFrame functions only.

A host is turned round label by label (``www.example.org`` becomes ``org.example.www.``), so a rule for a host and its subdomains is
an interval of keys, and intervals of two rules are nested or apart. Rules and pages are sorted together. Of all rules with d labels
only the last one opened can still be open, so the stack of open rules is one slot per depth: the last rule of that depth, dropped
when the key has left its interval. Path prefixes are then tested on the stack, longest rule first.

Rules and pages are sorted once into ranges of the key (pages of one host spread over several, by a hash), written, and swept range by range. What is open
where a range begins is the last rule of each depth in the ranges before it: one small row per range and depth. So a rule is one row however many pages
its interval holds, and no range holds more than its share. The ranges are written because a second sort could cut them elsewhere.
Nulls: a null url, or one without ``://``, has empty host and path. Repeated rules count once; of one (host, path) with two verdicts the
smaller word wins. An empty rule table gives every page the default verdict. Further page columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import LOWER, UPPER, table
from flowsieve.session import durable

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
RANGES_PER_PARTITION = 4


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def placed(pages: DataFrame, rules: DataFrame, ranges: int) -> DataFrame:
    """Pages (kind 1) and rules (kind 0, one row per host), sorted into numbered ranges of the reversed-host key."""
    by_host = (
        rules.groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path").agg(F.min("verdict").alias("verdict"))
        .groupBy("host").agg(F.sort_array(F.collect_list(F.struct(F.length("path").alias("size"), "path", "verdict")), asc=False).alias("paths"))
    )
    rows = (
        pages.withColumn("kind", F.lit(1))
        .unionByName(by_host.select("host", "paths", F.size(F.split("host", r"\.")).alias("depth"), F.lit(0).alias("kind")), allowMissingColumns=True)
        .withColumn("key", host_key(F.col("host"))).withColumn("spread", F.xxhash64("id", "path"))
    )
    return rows.repartitionByRange(ranges, "key", "kind", "spread").withColumn("part", F.spark_partition_id()).drop("spread")


def carried(rows: DataFrame, opened: Column, deepest: int) -> DataFrame:
    """Per range that holds pages, and depth, the rule opened last before the range."""
    local = rows.where("kind = 0").groupBy("part", "depth").agg(F.max_by(opened, "key").alias("opened"))
    wanted = rows.where("kind = 1").select("part").distinct().select("part", F.explode(F.sequence(F.lit(1), F.lit(deepest))).alias("depth"))
    before = Window.partitionBy("depth").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = wanted.join(local, ["part", "depth"], "full").withColumn("before", F.last("opened", ignorenulls=True).over(before))
    return every.groupBy("part").agg(*[F.first(F.when(F.col("depth") == d, F.col("before")), ignorenulls=True).alias(f"before{d}") for d in range(1, deepest + 1)])


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """Per page: id, host, path, the longest fitting rule and the verdict. ``ranges``: how many ranges of keys are swept, a few per shuffle partition if not given."""
    spark = pages.sparkSession
    url = pages[url_col]
    p = pages.select(pages[id_col].alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    ranges = ranges or RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = durable(placed(p, rules, ranges), "url-ranges")
    deepest = rows.agg(F.max("depth")).head()[0] or 0
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.struct("key", "host", "paths")
    swept = rows.select("part", "kind", "id", "host", "path", "key", *[F.last(F.when(F.col("depth") == d, opened), ignorenulls=True).over(sweep).alias(f"open{d}") for d in range(1, deepest + 1)]).where("kind = 1")
    if deepest:
        swept = swept.join(carried(rows, opened, deepest), "part", "left")
    fits = []
    for d in range(deepest, 0, -1):
        slot = F.coalesce(f"open{d}", f"before{d}")
        hit = F.get(F.filter(slot["paths"], lambda r: F.col("path").startswith(r["path"])), F.lit(0))
        fits.append(F.when(F.col("key").startswith(slot["key"]) & hit.isNotNull(), F.struct((F.length(slot["host"]) + hit["size"]).alias("size"), F.concat(slot["host"], hit["path"]).alias("rule"), hit["verdict"].alias("verdict"))))
    best = F.greatest(*fits) if len(fits) > 1 else fits[0] if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return swept.withColumn("best", best).select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "pages").select("page_id", "url"), rules_table(spark, RULES))


SQL = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, host, path) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
m AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
