"""What a page about a project shows: cards, labels, and the files behind graph nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import round1, severity

# Short names of languages.
LABELS = {
    "javascript": "JS", "typescript": "TS", "python": "PY", "php": "PHP", "html": "HTML", "css": "CSS", "go": "GO", "rust": "RS", "java": "JAVA",
    "c": "C", "cpp": "C++", "csharp": "C#", "kotlin": "KT", "swift": "SWIFT", "ruby": "RB", "sql": "SQL",
}


def stat_cards(summary: DataFrame, *keys: str) -> DataFrame:
    """Eight rows for each project: ord, label, value, class. Needs duplication_percentage and cycle_count."""
    some = lambda c, kind: F.when(F.col(c) > 0, kind).otherwise("good")
    none = F.lit(None).cast("string")
    average = round1(F.col("avg_complexity"))
    cards = [
        ("Files analyzed", F.col("file_count"), none), ("Total lines", F.col("total_lines"), none), ("Functions", F.col("function_count"), none),
        ("Avg complexity", average, severity(average, 10, 5)), ("High-risk functions", F.col("risky_functions"), some("risky_functions", "bad")),
        ("Duplicated code", F.col("duplication_percentage"), severity(F.col("duplication_percentage"), 10, 3)),
        ("Circular deps", F.col("cycle_count"), some("cycle_count", "bad")), ("Long files (>300)", F.col("long_file_count"), some("long_file_count", "warn")),
    ]
    rows = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(label).alias("label"), v.cast("double").alias("value"), c.alias("class")) for k, (label, v, c) in enumerate(cards)))
    return summary.select(*keys, F.explode(rows).alias("c")).select(*keys, "c.*")


def share_card(summary: DataFrame, *keys: str) -> DataFrame:
    """Six rows for each project: label, value, alarming; what is missing counts as 0."""
    s = {"Files": ("file_count", None), "Functions": ("function_count", None), "Avg complexity": ("avg_complexity", None), "Max complexity": ("max_complexity", 10), "Duplication": ("duplication_percentage", 15), "Dep. cycles": ("cycle_count", 0)}
    rows = F.array(*(F.struct(F.lit(label).alias("label"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value"), (F.coalesce(F.col(c) > limit, F.lit(False)) if limit is not None else F.lit(False)).alias("alarming")) for label, (c, limit) in s.items()))
    return summary.select(*keys, F.explode(rows).alias("c")).select(*keys, "c.*")


def badges(summary: DataFrame, *keys: str) -> DataFrame:
    """A row (label) for each of graphql_detected and knowledge_graph_detected that holds."""
    said = {"graphql_detected": "GraphQL detected", "knowledge_graph_detected": "Knowledge graph detected"}
    labels = F.array_compact(F.array(*(F.when(F.col(c), label) for c, label in said.items())))
    return summary.select(*keys, F.explode(labels).alias("label"))


def language_label(language: Column) -> Column:
    """The short name of a language; of an unknown one its own in capitals, of none an empty one."""
    names = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(names, language), F.upper(language), F.lit(""))


def formatted(number: Column) -> Column:
    """A number with commas between thousands, and at most three decimals."""
    return F.regexp_replace(F.regexp_replace(F.format_number(number.cast("double"), 3), r"\.?0+$", ""), r"^-0$", "0")


def node_file(node_id: Column, source: Column) -> Column:
    """The file of a graph node, from its id or its source."""
    rest = F.regexp_replace(node_id, "^[a-z]+:", "")
    return (
        F.when(node_id.startswith("file:"), rest).when(node_id.startswith("class:"), F.nullif(F.regexp_extract(rest, r"^(.+):[^:]*$", 1), F.lit("")))
        .when(node_id.startswith("fn:"), F.nullif(F.regexp_extract(rest, r"^([^#]+)#", 1), F.lit(""))).when(node_id.startswith("table:"), None)
        .when(source.rlike(r"[/\\\\.]"), source)
    )


def filled(template: Column, **values: Column) -> Column:
    """A template whose {names} are replaced."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def translated(rows: DataFrame, dictionary: DataFrame, language: str, key: str = "key") -> DataFrame:
    """Rows with ``text``: the dictionary's (key, language, text) in one language, or else the key."""
    d = dictionary.where(F.col("language") == language).groupBy(F.col("key").alias(key)).agg(F.min("text").alias("text"))
    return rows.join(d, key, "left").withColumn("text", F.coalesce("text", F.col(key)))


def node_details(node: str, edges: DataFrame, files: DataFrame) -> DataFrame:
    """One row about a file of the dependency graph: what it imports, who imports it, and its roll-up."""
    counts = edges.agg(F.count_if(F.col("from") == node).alias("imports"), F.count_if(F.col("to") == node).alias("dependents"))
    return counts.withColumn("path", F.lit(node)).join(files, "path", "left")
