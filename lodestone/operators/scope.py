"""Work across files that is kept apart by project.

A table that has a column project_id is grouped, ranked and joined by it; one without is a single project's. A file may be
a struct of project_id, ord and path: then it sorts in the order of its project, and ``scoped`` takes the project from it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources import tables

PROJECT = "project_id"


def keys(df: DataFrame) -> list[str]:
    return [PROJECT] if PROJECT in df.columns else []


def scoped(df: DataFrame) -> DataFrame:
    kind = df.schema["file"].dataType
    inside = kind.typeName() == "struct" and PROJECT in kind.names
    return df.withColumn(PROJECT, F.col(f"file.{PROJECT}")) if inside and PROJECT not in df.columns else df


def first_rows(df: DataFrame, most: int, *order: Column | str) -> DataFrame:
    """The first ``most`` rows of each project with their place, ``rank``, from 1 on; Spark keeps no more than these of a task."""
    if keys(df):
        ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys(df)).orderBy(*order)))
        # without a limit nothing is sorted where no one reads the rank
        return ranked if most >= 1 << 30 else ranked.where(F.col("rank") <= most)
    return df.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


#: Groups of files that a task keeps apart: many, so that tasks hold about the same.
GROUPS = 4


def first_distinct(df: DataFrame, most: int, key: Column, deals: int, *order: str) -> DataFrame:
    """``first_rows`` of rows with a ``file``, of those of one ``key`` only the first: with ``rank``.

    Files are dealt into groups, ``deals`` tasks in all, and only the first ``most`` of each group are compared with
    others: no row is among the first of all but not of its group.
    """
    own, rest = keys(scoped(df)), [c for c in df.columns if c not in order]
    group = F.pmod(F.xxhash64("file"), F.lit(GROUPS * deals))
    x = scoped(df).select(*own, group.alias("group"), key.alias("key"), F.struct(*order, *(c for c in rest if c not in own)).alias("r"))
    x = x.repartition(deals, "group").groupBy(*own, "group", "key").agg(F.min("r").alias("r"))
    nth = F.row_number().over(Window.partitionBy(*own, "group").orderBy("r"))
    x = x.withColumn("nth", nth).where(F.col("nth") <= most).groupBy(*own, "key").agg(F.min("r").alias("r"))
    return first_rows(x.select(*own, "r.*"), most, *order)


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """All rows of each project with their place, ``rank``, from 1 on; a project of many rows is ordered by many tasks.

    Rows are dealt by ranges of the order and stored as they are sorted; a row's place is that within its task, more by
    what tasks before it hold of the project.
    """
    own, rows = keys(df), tables.written(df, "unranked")
    if rows.count() <= tables.FEW:
        return first_rows(rows, 1 << 30, *order)
    by = [F.col(k) for k in own] + [F.col(c) if isinstance(c, str) else c for c in order]
    stored = tables.written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("nth", F.monotonically_increasing_id()), "ordered")
    stored = stored.withColumn("task", F.shiftright("nth", 33))
    held = tables.written(stored.groupBy(*own, "task").agg(F.min("nth").alias("first"), F.count("*").alias("held")), "held")  # a row for a task and project
    before = F.coalesce(F.sum("held").over(Window.partitionBy(*own).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = tables.written(held.withColumn("before", before).drop("held"), "starts")
    found = stored.join(tables.small(starts), [*own, "task"])
    return found.withColumn("rank", (F.col("nth") - F.col("first") + F.col("before") + 1).cast("int")).drop("nth", "task", "first", "before")


def side_by_side(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Tables with one row a project as one, rows of ``first``; or with one row each, where there is no project."""
    own = keys(first)
    return reduce(lambda a, b: a.join(b, own, "left") if own else a.crossJoin(b), more, first)  # one row each
