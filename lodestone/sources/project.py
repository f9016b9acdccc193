"""File tables: project_id, ord, path, language, kind (code, graphql or schema_json), size, content.

A project tree is listed with Spark's binaryFile source; files are chosen by path and size, and only those that are
accepted, at most the limit of a project, are read. Archives and tables of (path, content) give the same rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import basename, extension, safe_relative_path
from lodestone.operators.scope import first_rows
from lodestone.sources.tables import small, written

# Extensions by language, ignored folders, and limits.
LANGUAGES = {
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "typescript": (".ts", ".tsx"),
    "python": (".py",),
    "php": (".php", ".phtml"),
    "html": (".html", ".htm", ".vue"),
    "css": (".css", ".scss", ".less"),
    "go": (".go",),
    "rust": (".rs",),
    "java": (".java",),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hh"),
    "csharp": (".cs",),
    "kotlin": (".kt", ".kts"),
    "swift": (".swift",),
    "ruby": (".rb",),
    "sql": (".sql",),
}
IGNORED_FOLDERS = ("node_modules", ".git", ".svn", ".hg", "dist", "build", "out", "coverage", "vendor", ".next", ".nuxt", ".cache", ".turbo", "__pycache__", ".idea", ".vscode", "venv", ".venv", "env", "target", "obj", "bin", "Pods", "DerivedData", ".gradle", "_build", "cmake-build-debug")
UPLOAD_SKIPPED = ("node_modules", ".git", "dist", "build", "coverage", "vendor", ".next", "__MACOSX", "__pycache__")
MAX_CODE_BYTES = 1024 * 1024
MAX_JSON_BYTES = 5 * 1024 * 1024
MAX_FILES = 5000
MAX_ARCHIVE_BYTES = 100 * 1024 * 1024
MAX_ZIP_ENTRIES = 10_000
MAX_ZIP_BYTES = 300 * 1024 * 1024
MAX_FOLDER_FILES, MAX_FOLDER_FILE_BYTES, MAX_FOLDER_BYTES = 3000, 5 * 1024 * 1024, 80 * 1024 * 1024
ASK_FOLDER_FILES, ASK_FOLDER_BYTES = 150, 15 * 1024 * 1024
FOLDER_SKIPPED = r"(^|/)(node_modules|\.git|dist|build|coverage|vendor|\.next|__pycache__|\.cache)(/|$)"


def language(path: Column | str) -> Column:
    pairs = [F.lit(x) for name, found in LANGUAGES.items() for e in found for x in (e, name)]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def kind(path: Column | str) -> Column:
    """code, graphql or schema_json by name; null for files that are not analysed."""
    name = F.lower(basename(path))
    return (
        F.when(extension(path).isin(".graphql", ".gql"), "graphql")
        .when(name.rlike(r"(schema|introspection|graph).*\.json$|\.json$") & name.rlike("schema|introspection|graph") & name.endswith(".json"), "schema_json")
        .when(name.rlike(r"\.(min|bundle)\.(js|cjs|mjs|css)$") | name.endswith(".d.ts"), None)
        .when(language(path).isNotNull(), "code")
    )


def in_ignored_folder(path: Column | str) -> Column:
    folders = F.split(F.regexp_replace(F.col(path) if isinstance(path, str) else path, "[^/]*$", ""), "/")
    return F.exists(folders, lambda s: s.isin(*IGNORED_FOLDERS) | s.startswith("."))


def walk_key(path: Column | str) -> Column:
    """Sorts the paths of a tree as a walk with a stack meets them: a folder's files by name, then its folders, the last first."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    # names by their bytes, those of folders turned round and closed by what is larger than any of them
    folder = lambda name: F.concat(F.lit("1"), F.translate(F.hex(F.encode(name, "utf-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    return F.transform(parts, lambda name, k: F.when(k == F.size(parts) - 1, F.concat(F.lit("0"), F.hex(F.encode(name, "utf-8")))).otherwise(folder(name)))


def route(listing: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """Decide for every file (project_id, path, size) what becomes of it: status accepted, skipped, capped or ignored.

    Skipped files are counted by the report: minified ones and those over their size limit. Files that a walk meets behind
    a project's last accepted one, if it has as many as it may, are capped and count as skipped too. The rest is ignored.
    ``ord`` is the place of an accepted file in the walk; only as many files of a project as it may have are ranked.
    """
    k, name = kind("path"), F.lower(basename("path"))
    limit = F.when(k == "schema_json", MAX_JSON_BYTES).otherwise(MAX_CODE_BYTES)
    minified = name.rlike(r"\.(min|bundle)\.(js|cjs|mjs|css)$")
    first = F.when(in_ignored_folder("path"), "ignored").when(minified, "skipped").when(k.isNull(), "ignored").when(F.col("size") > limit, "skipped").otherwise("accepted")
    x = listing.withColumns({"kind": k, "language": language("path"), "status": first, "walk": walk_key("path")})
    ranked = first_rows(x.select("project_id", "path", "status", "walk").where("status = 'accepted'"), max_files, "walk")
    ends = written(ranked.where(F.col("rank") == max_files).select("project_id", F.col("walk").alias("end")), "walk-ends")  # a row for each project that is full
    beyond = F.coalesce(F.col("walk") > F.col("end"), F.lit(False))
    places = ranked.select("project_id", "path", F.col("rank").cast("long").alias("ord")).distinct()
    out = x.join(small(ends), "project_id", "left").withColumn("status", F.when(beyond & ~in_ignored_folder("path"), "capped").otherwise(F.col("status")))
    return out.join(places, ["project_id", "path"], "left").drop("walk", "end")


def scan_tree(spark: SparkSession, root: str, project_id: str = "project", max_files: int = MAX_FILES) -> DataFrame:
    """The accepted files below a folder of any store Spark reads; invalid UTF-8 becomes U+FFFD."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?", ""), f"^{re.escape(base)}/*", "")
    listing = found.load(root).select(F.lit(project_id).alias("project_id"), F.col("path").alias("uri"), relative.alias("path"), F.col("length").alias("size"))
    chosen = route(listing, max_files).where("status = 'accepted'").select("uri", "project_id", "ord", "path", "language", "kind", "size")
    rows = chosen.collect()  # names of at most max_files files
    accepted = spark.createDataFrame(rows, chosen.schema)
    names = [re.sub(r"([\\\[\]{}*?,])", r"\\\1", r["uri"]) for r in rows]
    read = spark.read.format("binaryFile").option("ignoreCorruptFiles", True)
    content = (read.load(names) if names else found.load(root).where("false")).select(F.col("path").alias("uri"), "content")
    both = content.join(F.broadcast(accepted), "uri")
    return both.select("project_id", "ord", "path", "language", "kind", "size", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def folder_uploads(listing: DataFrame) -> DataFrame:
    """Whether the folders of a listing (project_id, ord, path, size) may be uploaded: one row a project.

    ``files`` and ``bytes`` are of what is left without skipped folders and files over 5 MiB. ``problem`` is empty if
    nothing is left, files or bytes for the limit that is passed first in the order of ``ord``, else null; ``ask`` tells
    that a folder within the limits is large enough to ask first. ``root`` is the first segment of the first file's path.
    """
    left = ~F.coalesce(F.regexp_like("path", F.lit(FOLDER_SKIPPED)), F.lit(False)) & ~F.coalesce(F.col("size") > MAX_FOLDER_FILE_BYTES, F.lit(False))
    so_far = Window.partitionBy("project_id", "left").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = listing.withColumn("left", left).withColumns({"n": F.count("*").over(so_far), "b": F.sum(F.coalesce("size", F.lit(0))).over(so_far)})
    mine = lambda c: F.when(F.col("left"), F.col(c))
    over = F.when(F.col("n") > MAX_FOLDER_FILES, "files").when(F.col("b") > MAX_FOLDER_BYTES, "bytes")
    sums = x.groupBy("project_id").agg(
        F.count_if("left").alias("files"),
        F.coalesce(F.sum(F.when(F.col("left"), F.col("size"))), F.lit(0)).alias("bytes"),
        F.min_by(over, F.when(F.col("left") & over.isNotNull(), F.col("n"))).alias("over"),
        F.min_by(F.split_part("path", F.lit("/"), F.lit(1)), mine("n")).alias("root"),
    )
    problem = F.when(F.col("files") == 0, "empty").otherwise(F.col("over"))
    ask = problem.isNull() & ((F.col("files") > ASK_FOLDER_FILES) | (F.col("bytes") > ASK_FOLDER_BYTES))
    return sums.select("project_id", "files", "bytes", "root", problem.alias("problem"), ask.alias("ask"))


def from_table(files: DataFrame) -> DataFrame:
    """The same rows from a table of project_id, path and content (string): the folder upload."""
    clean = files.withColumn("path", safe_relative_path("path", UPLOAD_SKIPPED)).where("path is not null")
    return _decoded(route(clean.withColumn("size", F.octet_length("content")).withColumn("content", F.encode("content", "utf-8"))))


def _archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, length, content) of the ZIP archives at a path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return found.select(F.regexp_replace(basename("path"), r"\.zip$", "").alias("project_id"), "length", "content")


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """(project_id, path, content, error): the files of each archive, or one row that says why it has none.

    Archives over the limit of bytes aren't read at all.
    """
    entries, most = MAX_ZIP_ENTRIES, MAX_ZIP_BYTES

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row(name: str, path: str | None, content: bytes | None, error: str | None) -> pd.DataFrame:
            return pd.DataFrame({"project_id": [name], "path": [path], "content": [content], "error": [error]})

        for frame in frames:
            for name, data in zip(frame["project_id"], frame["content"], strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(data))
                    found = [e for e in z.infolist() if not e.is_dir()]
                    if len(found) > entries or sum(e.file_size for e in found) > most:
                        yield row(name, None, None, "the archive is over the limits")
                        continue
                    bad = z.testzip()
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError) as e:
                    yield row(name, None, None, f"the archive can't be read: {e}")
                    continue
                if bad is not None:
                    yield row(name, None, None, f"the archive can't be read: {bad}")
                    continue
                for e in found:
                    yield row(name, e.filename, z.read(e), None)

    small_enough = _archives(spark, path).where(F.col("length") <= MAX_ARCHIVE_BYTES).select("project_id", "content")
    return small_enough.mapInPandas(unpack, "project_id string, path string, content binary, error string")


def from_zips(spark: SparkSession, path: str) -> DataFrame:
    """The same rows from ZIP archives, one project each; what can't be read is left to ``zip_errors``."""
    rows = _entries(spark, path).where("error is null").drop("error")
    clean = rows.withColumn("path", safe_relative_path("path", UPLOAD_SKIPPED)).where("path is not null")
    return _decoded(route(clean.withColumn("size", F.octet_length("content"))))


def zip_errors(spark: SparkSession, path: str) -> DataFrame:
    """(project_id, message) of the archives that are over the limits or can't be read; the others load all the same."""
    large = _archives(spark, path).where(F.col("length") > MAX_ARCHIVE_BYTES).select("project_id", F.lit("the archive is over the limits").alias("message"))
    return large.unionByName(_entries(spark, path).where("error is not null").select("project_id", F.col("error").alias("message")))


def _decoded(routed: DataFrame) -> DataFrame:
    kept = routed.where("status = 'accepted'")
    return kept.select("project_id", "ord", "path", "language", "kind", "size", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
