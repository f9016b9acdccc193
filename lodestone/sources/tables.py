"""Tables written between steps, in the folder that all executors share, and joins with them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which the side of a join is broadcast; its rows are measured first, and beyond the bound the join shuffles.
BROADCAST_BYTES = 16 << 20
#: Rows up to which all of them may share a key and be joined in one task.
FEW = 500_000
#: Bytes of contents that a task turns into pieces; the rows it holds of them at once take some fifty times as much.
SPREAD_BYTES = 2 << 20

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, as in tests, a temporary one, but only for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.applicationId not in _own:
        _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own[spark.sparkContext.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/lodestone/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it back: this cuts its lineage, and a lost executor costs nothing of it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def width(df: DataFrame) -> Column:
    """About the bytes of a row as a broadcast holds it."""
    sizes = [F.lit(8)]
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 16)
        elif kind in ("array", "map", "struct", "variant"):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0)))
        else:
            sizes.append(F.lit(8))
    return sum(sizes[1:], sizes[0]).cast("long")


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the (already written) table has at most ``limit`` bytes by its rows, otherwise a sort-merge join."""
    size = df.agg(F.sum(width(df))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df.hint("merge")


def splittable(sums: DataFrame, rows: int, name: str) -> DataFrame:
    """Sums by key that are about to be joined with the ``rows`` rows they sum up.

    Spark splits the rows of a hot key only if the sums come from a table, so they are written, unless the rows are few.
    """
    return written(sums, name) if rows > FEW else sums


def deals(files: DataFrame) -> int:
    """Into how many partitions files are dealt: each gets about ``SPREAD_BYTES`` of contents, or less while there are fewer
    partitions than cores. The contents are measured, as they may come from few bytes of a table, which one task would read."""
    held = files.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    cores = min(files.sparkSession.sparkContext.defaultParallelism, -(-held // (SPREAD_BYTES >> 5)))
    return max(-(-held // SPREAD_BYTES), cores, 1)


def spread(files: DataFrame) -> DataFrame:
    """Files dealt by a hash of ``file``, before their contents become many rows: windows over a file need no other shuffle."""
    return files.repartition(deals(files), "file")
