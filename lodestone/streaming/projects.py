"""Roll-ups of source files that keep arriving, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.text import code_line_count, line_count
from lodestone.sources.project import kind, language

SCHEMA = "project_id string, path string, content string, arrived timestamp"


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """Files (project_id, path, content, arrived) written to a folder as Parquet."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def measured(files: DataFrame) -> DataFrame:
    """Accepted code files with their language and lines; works on streams and tables alike."""
    x = files.withColumns({"kind": kind("path"), "language": language("path")}).where("kind = 'code'")
    return x.withColumns({"lines": line_count("content"), "code_lines": code_line_count("content", "language")})


def lines_by_window(files: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Lines by project, language and time window; files over ``late`` late are left out."""
    w = measured(files.withWatermark("arrived", late)).groupBy(F.window("arrived", width), "project_id", "language")
    return w.agg(F.count("*").alias("files"), F.sum("lines").alias("lines")).select(F.col("window.start").alias("start"), "project_id", "language", "files", "lines")


def on_arrival(files: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand every batch of arriving files to ``sink``, each once if the sink tells batches apart by their number."""
    return files.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
