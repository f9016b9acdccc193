"""Roll-ups, rankings and histograms over functions and files, and the health score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import clamp, plural, round0, round1
from lodestone.operators.scope import first_rows, keys

# Limits beyond which a thing counts, and sizes of lists.
COMPLEXITY, FUNCTION_LINES, FILE_LINES, NESTING = 10, 50, 300, 4
TOP_FUNCTIONS = 500
DOM_DEPTH = 15
#: What is said about a file, in this order: the fact, the number it has to exceed, the text for one and for more.
WARNINGS = (
    ("lines", FILE_LINES, "File is {n} lines (limit 300)", "File is {n} lines (limit 300)"),
    ("risky_functions", 0, "{n} high-complexity function (CC > 10)", "{n} high-complexity functions (CC > 10)"),
    ("long_functions", 0, "{n} long function (> 50 lines)", "{n} long functions (> 50 lines)"),
    ("deep_functions", 0, "{n} deeply nested function (depth > 4)", "{n} deeply nested functions (depth > 4)"),
    ("max_depth", DOM_DEPTH, "DOM nesting depth {n} (limit 15)", "DOM nesting depth {n} (limit 15)"),
    ("missing_alt", 0, "{n} <img> tag missing alt text", "{n} <img> tags missing alt text"),
    ("duplicate_ids", 0, "{n} duplicate id attribute", "{n} duplicate id attributes"),
    ("deprecated_tags", 0, "{n} deprecated tag", "{n} deprecated tags"),
    ("inline_handlers", 0, "{n} inline event handler (onclick=...)", "{n} inline event handlers (onclick=...)"),
    ("inline_styles", 3, "{n} inline style attributes", "{n} inline style attributes"),
    ("missing_lang", 0, "<html> missing lang attribute", ""),
    ("missing_viewport", 0, "Missing viewport meta tag", ""),
    ("missing_title", 0, "Missing <title>", ""),
    ("duplicate-selector", 0, "{n} duplicate selector", "{n} duplicate selectors"),
    ("important", 0, "{n} !important declaration", "{n} !important declarations"),
    ("high-specificity", 0, "{n} high-specificity selector", "{n} high-specificity selectors"),
    ("duplicate-property", 0, "{n} duplicate property", "{n} duplicate propertys"),
    ("empty-rule", 0, "{n} empty rule", "{n} empty rules"),
    ("universal-selector", 0, "{n} universal (*) selector", "{n} universal (*) selectors"),
    ("long-selector", 0, "{n} overly long selector", "{n} overly long selectors"),
    ("z-index", 0, "{n} extreme z-index value", "{n} extreme z-index values"),
    ("sql_tables", 0, "Defines {n} table", "Defines {n} tables"),
    ("sql_issues", 0, "{n} SQL issue (SELECT *, missing WHERE, ...)", "{n} SQL issues (SELECT *, missing WHERE, ...)"),
    ("in_cycle", 0, "Part of a circular dependency", ""),
)
BUCKETS = (("1-2", 1, 2), ("3-5", 3, 5), ("6-10", 6, 10), ("11-20", 11, 20), ("21+", 21, 1 << 30))
#: Key, label and weight of each component of the score.
COMPONENTS = (("complexity", "Complexity", 0.3), ("duplication", "Duplication", 0.25), ("size", "Size", 0.2), ("dependencies", "Dependencies", 0.15), ("nesting", "Nesting", 0.1))


def function_sums(functions: DataFrame, *keys: str) -> DataFrame:
    return functions.groupBy(*keys).agg(
        F.count("*").alias("function_count"),
        F.sum("complexity").alias("complexity_sum"),
        F.max("complexity").alias("max_complexity"),
        F.max("nesting").alias("max_nesting"),
        F.count_if(F.col("complexity") > COMPLEXITY).alias("risky_functions"),
        F.count_if(F.col("lines") > FUNCTION_LINES).alias("long_functions"),
        F.count_if(F.col("nesting") > NESTING).alias("deep_functions"),
    )


def file_rollup(files: DataFrame, functions: DataFrame) -> DataFrame:
    """A row for each of ``files`` (path, language, lines, code_lines, ...) with the sums of its functions (file, ...)."""
    sums = function_sums(functions, "file")
    x = files.join(sums, files.path == sums.file, "left").drop("file")
    names = ("function_count", "complexity_sum", "max_complexity", "max_nesting", "risky_functions", "long_functions", "deep_functions")
    x = x.withColumns({c: F.coalesce(c, F.lit(0)) for c in names})
    average = F.when(F.col("function_count") > 0, F.col("complexity_sum") / F.col("function_count")).otherwise(0.0)
    return x.withColumns({"avg_complexity": round1(average), "is_long_file": F.col("lines") > FILE_LINES}).drop("complexity_sum")


def file_warnings(rollup: DataFrame) -> DataFrame:
    """Adds the texts about each file in the order of ``WARNINGS``; a fact is a column, or one of ``facts``, a map, if there is one."""

    def fact(name: str) -> Column:
        found = F.col(name).cast("long") if name in rollup.columns else F.try_element_at("facts", F.lit(name)) if "facts" in rollup.columns else F.lit(None)
        return F.coalesce(found, F.lit(0))

    said = [F.when(fact(name) > limit, F.replace(F.when(fact(name) == 1, one).otherwise(more), F.lit("{n}"), fact(name).cast("string"))) for name, limit, one, more in WARNINGS]
    return rollup.withColumn("warnings", F.array_compact(F.array(*said)))


def facts_by_file(*counted: DataFrame) -> DataFrame:
    """(file, facts): a map of the facts of each file, from tables (file, fact, n)."""
    every = counted[0]
    for more in counted[1:]:
        every = every.unionByName(more)
    sums = every.groupBy("file", "fact").agg(F.sum(F.col("n").cast("long")).alias("n"))
    return sums.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("fact", "n"))).alias("facts"))  # of the two dozen facts of WARNINGS


def mark_cyclic(rollup: DataFrame, cyclic: DataFrame) -> DataFrame:
    own = [k for k in keys(rollup) if k in cyclic.columns]
    c = cyclic.select(*own, F.col("file").alias("path"), F.lit(True).alias("in_cycle")).distinct()
    return rollup.join(c, [*own, "path"], "left").withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False)))


def languages(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("file_count"), F.sum("lines").alias("lines")).orderBy(F.desc("lines"), "language")


def histogram(functions: DataFrame) -> DataFrame:
    """Functions by complexity bucket; empty buckets have a row, too."""
    spark = functions.sparkSession
    table = F.broadcast(spark.createDataFrame([(k, *b) for k, b in enumerate(BUCKETS)], "bucket_ord int, bucket string, low int, high int"))  # five rows
    place = F.array_max(F.array(*(F.when(F.col("complexity") >= low, k) for k, (_, low, _) in enumerate(BUCKETS))))
    own = keys(functions)
    counts = functions.select(*own, place.alias("bucket_ord")).where("bucket_ord is not null").groupBy(*own, "bucket_ord").agg(F.count("*").alias("functions"))
    if own:  # a project without functions has no rows
        table = counts.select(*own).distinct().crossJoin(table)  # by five rows
    return table.join(counts, [*own, "bucket_ord"], "left").select(*own, "bucket_ord", "bucket", F.coalesce("functions", F.lit(0)).alias("functions"))


def top_functions(functions: DataFrame, most: int = TOP_FUNCTIONS, *ties: str) -> DataFrame:
    flags = {"risky": F.col("complexity") > COMPLEXITY, "long": F.col("lines") > FUNCTION_LINES, "deep": F.col("nesting") > NESTING}
    return first_rows(functions, most, F.desc("complexity"), F.desc("lines"), *ties).withColumns(flags)


def ranked_files(rollup: DataFrame, *ties: str) -> DataFrame:
    return rollup.orderBy(F.desc("risky_functions"), F.desc("max_complexity"), F.desc("lines"), *ties)


def search_files(rollup: DataFrame, text: str, key: str = "lines", descending: bool = True) -> DataFrame:
    """Files whose path has a text, whatever its case, by any column."""
    found = rollup.where(F.contains(F.lower("path"), F.lit(text.lower())))
    return found.orderBy(F.desc(key) if descending else F.asc(key), "path")


def bars(counts: DataFrame, value: str, least: float) -> DataFrame:
    """Widths of bars in per cent of the largest, and at least ``least``; for lists of bounded length."""
    top = F.broadcast(counts.agg(F.max(value).alias("top")))
    return counts.crossJoin(top).withColumn("width", F.greatest(F.lit(least), F.col(value) * 100 / F.greatest("top", F.lit(1)))).drop("top")  # one row


def summary(rollup: DataFrame, functions: DataFrame, *keys: str) -> DataFrame:
    """Totals of a project, or of each by ``keys`` that both tables have."""
    files = rollup.groupBy(*keys).agg(F.count("*").alias("file_count"), F.sum("lines").alias("total_lines"), F.sum("code_lines").alias("total_code_lines"), F.count_if("is_long_file").alias("long_file_count"))
    sums = function_sums(functions, *keys)
    both = files.join(sums, list(keys), "left") if keys else files.crossJoin(sums)  # one row each
    names = ("function_count", "complexity_sum", "max_complexity", "max_nesting", "risky_functions", "long_functions", "deep_functions")
    both = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in names})
    return both.withColumn("avg_complexity", F.when(F.col("function_count") > 0, F.col("complexity_sum") / F.col("function_count")).otherwise(0.0))


def score(stats: DataFrame) -> DataFrame:
    """Adds components (key, label, score, weight, detail), total and grade to a summary.

    Needs, beside the summary's columns, duplication_percentage and cycle_count.
    """
    n, files = F.greatest("function_count", F.lit(1)), F.greatest("file_count", F.lit(1))
    share = lambda c, of: F.col(c) / of * 100
    scores = {
        "complexity": 100 - F.greatest(F.lit(0.0), F.col("avg_complexity") - 2) * 9 - share("risky_functions", n) * 1.2,
        "duplication": 100 - F.col("duplication_percentage") * 3,
        "size": 100 - share("long_functions", n) * 1.6 - share("long_file_count", files) * 1.2,
        "dependencies": (100 - F.col("cycle_count") * 18).cast("double"),
        "nesting": 100 - share("deep_functions", n) * 2.2,
    }
    details = {
        "complexity": F.concat(F.lit("avg CC "), _number(round1(F.col("avg_complexity"))), F.lit(", "), plural(F.col("risky_functions"), "high-risk function", "high-risk functions")),
        "duplication": F.concat(_number(round1(F.col("duplication_percentage"))), F.lit("% duplicated lines")),
        "size": F.concat(plural(F.col("long_functions"), "long function", "long functions"), F.lit(", "), plural(F.col("long_file_count"), "long file", "long files")),
        "dependencies": plural(F.col("cycle_count"), "circular dependency", "circular dependencies"),
        "nesting": plural(F.col("deep_functions"), "deeply nested function", "deeply nested functions"),
    }
    x = stats.withColumns({f"{k}_score": round0(clamp(v, 0.0, 100.0)).cast("int") for k, v in scores.items()})
    total = None
    for key, _, weight in COMPONENTS:
        part = F.col(f"{key}_score") * F.lit(weight)
        total = F.lit(0.0) + part if total is None else total + part
    parts = [F.struct(F.lit(k).alias("key"), F.lit(label).alias("label"), F.col(f"{k}_score").alias("score"), F.lit(w).alias("weight"), details[k].alias("detail")) for k, label, w in COMPONENTS]
    x = x.withColumns({"total": round0(total).cast("int"), "components": F.array(*parts)})
    return x.withColumn("grade", F.when(F.col("total") >= 80, "healthy").when(F.col("total") >= 60, "warning").otherwise("critical"))


def _number(x):
    """Without '.0' at the end."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def dense_places(rows: DataFrame, column: str, order: str, cycle: int) -> DataFrame:
    """(column, place): the place of each value by first appearance, modulo ``cycle``; for small graphs' communities."""
    first = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("first"))
    return first.withColumn("place", (F.row_number().over(Window.orderBy("first")) - 1) % cycle).select(column, "place")
