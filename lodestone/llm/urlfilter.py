"""URL filters as a sort-merge range join.

A host's labels are written in reverse order, each with a full stop behind it, so that a host and all its subdomains
are one interval of sorted keys: com.example. up to, but without, com.example/ ('/' follows '.'). Rules turn into
events that open and close intervals; as intervals of hosts are nested or apart, the active rules form a stack, which
every event carries along. Urls and events are sorted into ranges of keys; in the sweep a url takes the stack of the
last event before it, and from the stack the longest rule whose path begins its own. A range begins with the stack that
the ranges before it leave, one row a range. The sweep is DataFrame functions, and one host's urls spread by their paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import LOWER, UPPER, written

#: The verdict for urls that no rule fits.
DEFAULT = "allow"
_STACK = "array<struct<host:string,path:string,verdict:string>>"


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def host_key(name: Column) -> Column:
    """The labels in reverse order, a full stop after each."""
    return F.concat(F.array_join(F.reverse(F.split(name, r"\.")), "."), F.lit("."))


def events(rules: DataFrame) -> DataFrame:
    """(at, opens, depth, stack): the stack of active rules from each border of a rule's interval on.

    ``rules`` has host, path and verdict. A rule's enclosing rules are those of its host's own suffixes, so stacks come
    from one equi-join on them. Several rules for one host and path count as one, block before allow.
    """
    one = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    by_host = one.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("host", "path", "verdict"))).alias("own"))
    by_host = written(by_host.withColumn("key", host_key(F.col("host"))), "rules")
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    above = by_host.select("key", F.col("host").alias("inner"), F.explode(suffixes).alias("host")).join(by_host.select("host", "own"), "host")
    stacks = above.groupBy("key", "inner").agg(F.flatten(F.collect_list("own")).alias("stack"))
    outer = above.where("host != inner").groupBy("key", "inner").agg(F.flatten(F.collect_list("own")).alias("outer"))
    s = stacks.join(outer, ["key", "inner"], "left")
    empty = F.array().cast(_STACK)
    opened = s.select(F.col("key").alias("at"), F.lit(1).alias("opens"), F.length("key").alias("depth"), F.col("stack").cast(_STACK).alias("stack"))
    closed = s.select(F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/")).alias("at"), F.lit(0).alias("opens"), (-F.length("key")).alias("depth"), F.coalesce(F.col("outer").cast(_STACK), empty).alias("stack"))
    return opened.unionByName(closed)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """The verdict on every url: page_id, host, path, rule (host and path of the rule, else null) and verdict.

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest (host and path
    together, of equals the one with the longer host) wins; without a rule the verdict is ``default``. A null url, or one
    without ://, has an empty host and path. Rows that repeat are judged each; a null page_id is carried along. Without
    rules all urls get the default. Other columns are not read.
    """
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    empty = F.lit(None).cast(_STACK)
    # within one key: closing events, then opening ones from the outermost, then urls
    points = urls.select(F.concat(host_key(F.col("host")), F.lit("\x00"), F.col("path")).alias("at"), F.lit(2).alias("opens"), F.lit(0).alias("depth"), empty.alias("stack"), "page_id", "host", "path")
    borders = events(rules).withColumns({"page_id": F.lit(None).cast(urls.schema["page_id"].dataType), "host": F.lit(None).cast("string"), "path": F.lit(None).cast("string")})
    order = ["at", "opens", "depth"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal keys may be many: the hash lets their urls spread over several ranges
    salt = F.when(F.col("opens") == 2, F.xxhash64("page_id")).otherwise(F.lit(0))
    ranged = points.unionByName(borders).withColumn("salt", salt).repartitionByRange(n, *order, "salt").withColumn("range", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    # the last event of each range, one row a range, carried over the ranges that have none
    last = ranged.where("opens < 2").groupBy("range").agg(F.max_by("stack", F.struct(*order)).alias("left"))
    every = spark.range(n).select(F.col("id").cast("int").alias("range"), F.lit(1).alias("one")).join(last, "range", "left")
    before = every.select("range", F.last("left", ignorenulls=True).over(Window.partitionBy("one").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    sweep = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ranged.withColumn("now", F.last("stack", ignorenulls=True).over(sweep)).where("opens = 2")
    active = swept.join(F.broadcast(before), "range", "left").withColumn("active", F.coalesce("now", "before", F.array().cast(_STACK)))  # n rows
    fits = F.filter("active", lambda r: F.startswith(F.col("path"), r["path"]))
    scored = F.transform(fits, lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("n"), F.length(r["host"]).alias("h"), r.alias("r")))
    best = F.array_max(scored)["r"]
    judged = active.withColumn("best", best)
    return judged.select("page_id", "host", "path", F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (host, path, verdict)."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")
