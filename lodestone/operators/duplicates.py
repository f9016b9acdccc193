"""Duplicate blocks of code: equal windows of normalised lines, extended to the longest run all occurrences share.

Windows are hashed and grouped by hash. A window whose predecessor begins a group of its own, all occurrences of which go
on alike, is covered by that group and dropped at once; that leaves about one group for each block. How far the occurrences
of a group agree is found by binary lifting: keys of 1, 2, 4, ... consecutive windows are compared at all occurrences at
once, so a run of n lines takes log n joins, and what a level finds is one row a group. A block is reported where no block
that begins earlier reaches it. Sorting is by file, grouping by hash; nothing is compared in pairs, and groups are joined
with their occurrences as tables, so that Spark can split those of a hash that very many files share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import collapse, lines, round1
from lodestone.operators.scope import first_rows, keys, scoped, side_by_side
from lodestone.sources.tables import small, splittable, spread, written

# Fixed values.
WINDOW_LINES = 6
MIN_CHARS = 60
MAX_BLOCKS = 100
SNIPPET_LINES = 12
TRIVIAL = ("{", "}", "};", "});", ")", ");", "]", "];", "},", "else {", "} else {", "try {", "return;", "break;", "continue;", "default:")


def normalized_lines(files: DataFrame) -> DataFrame:
    """(file_ord, file, idx, line_no, text) of the significant lines of (file_ord, file, content)."""
    tokens = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"(?s)/\*.*?\*/|[^/]+|/"), F.lit(0))
    blanked = F.transform(tokens, lambda t: F.when(F.regexp_like(t, F.lit(r"(?s)\A/\*.*\*/\z")) & (F.length(t) >= 4), F.regexp_replace(t, "[^\n]", " ")).otherwise(t))
    text = F.when(F.contains("content", F.lit("/*")), F.array_join(blanked, "")).otherwise(F.coalesce("content", F.lit("")))

    def code(line: Column) -> Column:
        return F.when(F.contains(line, F.lit("//")), F.regexp_replace(line, r"(^|[^:\\])//.*$", "$1")).otherwise(line)

    # lines are cleaned in their array: as columns behind it they would be cleaned again in each filter
    rows = spread(files).select("file_ord", "file", F.posexplode(F.transform(F.transform(lines(text), code), collapse)).alias("pos", "text"))
    kept = rows.select("file_ord", "file", (F.col("pos") + 1).alias("line_no"), "text").where((F.col("text") != "") & ~F.col("text").isin(*TRIVIAL))
    return kept.withColumn("idx", F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1)


def hashed(norm: DataFrame, size: int = WINDOW_LINES, least: int = MIN_CHARS) -> DataFrame:
    """Normalised lines with the hash of the run of ``size`` lines that begins at each; null where it is not long enough."""
    w = Window.partitionBy("file").orderBy("line_no")  # as in normalized_lines, whose sorting serves both
    following = [F.lead("text", k).over(w) for k in range(size)]
    joined = scoped(norm.withColumns({"run": F.concat_ws("\n", *following), "last": following[-1]}))
    # what is equal in two projects is none of either's duplicates
    found = F.when(F.col("last").isNotNull() & (F.length("run") >= least), F.concat_ws("/", *keys(joined), F.sha1("run")))
    return joined.select(*norm.columns, found.alias("hash"))


def windows(lines: DataFrame) -> DataFrame:
    """(file_ord, file, idx, hash) of every run of ``hashed`` lines that is long enough."""
    return lines.where(F.col("hash").isNotNull()).select("file_ord", "file", "idx", "hash")


def repeated(found: DataFrame) -> DataFrame:
    """Windows whose hash occurs more than once, with n and the first occurrence of their group."""
    groups = found.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("file_ord", "idx")).alias("first")).where("n > 1")
    return found.join(splittable(groups, found.count(), "groups"), "hash")


def _agreed(value: str) -> Column:
    """Of a group's occurrences: all have the value, and the same one."""
    return F.coalesce((F.min(value) == F.max(value)) & (F.count(value) == F.max("n")), F.lit(False))


def candidates(dups: DataFrame) -> DataFrame:
    """First occurrences (hash, n, file, file_ord, idx) of the groups that no group beginning one line earlier covers."""
    w = Window.partitionBy("file").orderBy("idx")
    is_first = (F.col("file_ord") == F.col("first.file_ord")) & (F.col("idx") == F.col("first.idx"))
    x = dups.withColumn("begins", is_first).withColumns({
        "next": F.when(F.lead("idx").over(w) == F.col("idx") + 1, F.lead("hash").over(w)),
        "before": F.when((F.lag("idx").over(w) == F.col("idx") - 1) & F.lag("begins").over(w), F.lag("hash").over(w)),
    })
    x = written(x.select("hash", "n", "file", "file_ord", "idx", "begins", "next", "before"), "neighbours")
    going_on = x.groupBy("hash").agg(_agreed("next").alias("agreed")).where("agreed").select(F.col("hash").alias("before"))
    firsts = x.where("begins").select("hash", "n", "file", "file_ord", "idx", "before")
    return firsts.join(small(written(going_on, "going-on")), "before", "left_anti").drop("before")


def extended(dups: DataFrame, firsts: DataFrame) -> DataFrame:
    """(hash, extra) of the groups of ``firsts``: by how many windows their occurrences agree beyond their own.

    Consecutive repeated windows make an island, which no run leaves. So a group can't agree beyond what the shortest of
    its islands holds behind it, and only islands in which such a group occurs are looked at.
    """
    w = Window.partitionBy("file").orderBy("idx")
    island = Window.partitionBy("file", "island")
    on_land = dups.select("hash", "file", "idx", "n").withColumn("island", F.col("idx") - F.row_number().over(w)).withColumn("room", F.max("idx").over(island) - F.col("idx"))
    wanted = small(written(firsts.select("hash", F.lit(True).alias("wanted")), "wanted"))
    held = on_land.join(wanted, "hash", "left").withColumn("held", F.coalesce(F.bool_or("wanted").over(island), F.lit(False))).where("held")
    held = written(held.select("hash", "file", "idx", "n", "island", "room", F.coalesce("wanted", F.lit(False)).alias("wanted")), "islands")
    places = held.where("wanted").select("hash", "file", "idx", "n")
    longest = held.where("wanted").groupBy("hash").agg(F.min("room").alias("room")).agg(F.max("room")).first()[0] or 0
    extents = written(firsts.select("hash", F.lit(0).alias("extra")), "extents")
    if not longest:
        return extents
    levels = int(longest).bit_length() - 1
    keys, key, run = held.select("file", "island", "idx", F.col("hash").alias("key0")), "key0", Window.partitionBy("file", "island").orderBy("idx")
    for k in range(levels):
        step = 1 << k
        keys = keys.withColumn(f"key{k + 1}", F.sha1(F.concat(F.col(key), F.lead(key, step).over(run))))  # null where the island ends
        key = f"key{k + 1}"
    keys = written(keys.drop("island"), "keys")
    for k in range(levels, -1, -1):
        at = keys.select("file", F.col("idx").alias("at"), F.col(f"key{k}").alias("key"))
        probe = places.join(small(extents), "hash").withColumn("at", F.col("idx") + F.col("extra") + 1).join(at, ["file", "at"], "left")
        found = probe.groupBy("hash").agg(F.max("extra").alias("extra"), _agreed("key").alias("agreed"))
        extents = written(found.select("hash", (F.col("extra") + F.when(F.col("agreed"), 1 << k).otherwise(0)).cast("int").alias("extra")), f"extents-{k}")
    return extents


def reported(dups: DataFrame) -> DataFrame:
    """The groups that make a block: hash, n, extra, file, first_idx, file_ord."""
    firsts = written(candidates(dups), "candidates")
    firsts = firsts.join(extended(dups, firsts), "hash")
    reach = F.max(F.col("idx") + F.col("extra")).over(Window.partitionBy("file").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    return firsts.withColumn("reach", reach).where(F.col("reach").isNull() | (F.col("reach") < F.col("idx"))).select("hash", "n", "extra", "file", F.col("idx").alias("first_idx"), "file_ord")


def search(files: DataFrame, size: int = WINDOW_LINES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tables: the normalised lines, the repeated windows, and the groups that make a block."""
    found = written(hashed(normalized_lines(files), size), "lines")
    dups = written(repeated(windows(found)), "repeated")
    return found.drop("hash"), dups, written(reported(dups), "blocks")


def _described(norm: DataFrame, found: DataFrame, size: int) -> DataFrame:
    total = size + F.col("extra")
    last = F.col("first_idx") + total - 1
    # the lines of the snippet and the last one, in one join with all lines
    shown = found.withColumn("idx", F.explode(F.array_union(F.sequence("first_idx", F.least(last, F.col("first_idx") + SNIPPET_LINES - 1)), F.array(last))))
    of_snippet = F.when(F.col("idx") < F.col("first_idx") + SNIPPET_LINES, F.struct("idx", "text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(of_snippet)), lambda x: x["text"]), "\n")  # SNIPPET_LINES lines
    x = shown.join(norm.select("file", "idx", "line_no", "text"), ["file", "idx"]).groupBy("hash", "n", "extra", "file", "first_idx", "file_ord")
    x = x.agg(text.alias("snippet"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"))
    return x.withColumns({"normalized_lines": total, "truncated_snippet": total > SNIPPET_LINES}).withColumnRenamed("n", "occurrence_count")


def blocks(files: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """All duplicate blocks: hash, normalized_lines, occurrence_count, snippet, truncated_snippet, and of the first occurrence
    file, file_ord, first_idx, start_line and end_line."""
    norm, _, found = search(files, size)
    return _described(norm, found, size).drop("extra")


def occurrences(norm: DataFrame, dups: DataFrame, found: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """A row for each place of each block: hash, file_ord, file, idx, start_line, end_line."""
    places = dups.select("hash", "file", "file_ord", "idx").join(small(found.select("hash", "extra")), "hash")
    start, end = norm.select("file", "idx", F.col("line_no").alias("start_line")), norm.select("file", F.col("idx").alias("at"), F.col("line_no").alias("end_line"))
    placed = places.withColumn("at", F.col("idx") + size + F.col("extra") - 1).join(end, ["file", "at"]).join(start, ["file", "idx"])
    return placed.select("hash", "file_ord", "file", "idx", "start_line", "end_line")


Search = tuple[DataFrame, DataFrame, DataFrame]


def top_blocks(files: DataFrame, most: int = MAX_BLOCKS, size: int = WINDOW_LINES) -> DataFrame:
    """The blocks of the most repeated lines, of each project, with all their places; ties stay in order of first occurrence."""
    return top_of(search(files, size), most, size)


def top_of(searched: Search, most: int = MAX_BLOCKS, size: int = WINDOW_LINES) -> DataFrame:
    """``top_blocks`` of stored tables. Places are looked up for these blocks alone and listed; ``rank`` orders them."""
    norm, dups, found = searched
    top = written(first_rows(scoped(found), most, ((size + F.col("extra")) * F.col("n")).desc(), "file_ord", "first_idx"), "top-blocks")
    listed = occurrences(norm, dups, top, size).groupBy("hash").agg(F.array_sort(F.collect_list(F.struct("file_ord", "idx", "file", "start_line", "end_line"))).alias("o"))
    listed = listed.select("hash", F.transform("o", lambda x: F.struct(x["file"].alias("file"), x["start_line"].alias("start_line"), x["end_line"].alias("end_line"))).alias("occurrences"))
    out = _described(norm, top, size).join(listed, "hash").join(top.select("hash", "rank", *keys(top)), "hash")
    return out.select(*keys(top), "normalized_lines", "occurrence_count", "occurrences", "snippet", "truncated_snippet", "file_ord", "first_idx", "rank").orderBy("rank")


def percentage(files: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """One row a project: total_blocks, duplicated_lines, normalized_lines and the percentage of lines that blocks cover."""
    return percentage_of(search(files, size), size)


def percentage_of(searched: Search, size: int = WINDOW_LINES) -> DataFrame:
    norm, dups, found = (scoped(x) for x in searched)
    own = keys(norm)
    covered = dups.join(small(found.select("hash", "extra")), "hash").select(*own, "file", F.explode(F.sequence("idx", F.col("idx") + F.col("extra") + size - 1)).alias("idx")).distinct()
    counted = lambda df, name: df.groupBy(*own).agg(F.count("*").alias(name))
    counts = side_by_side(counted(norm, "normalized_lines"), counted(covered, "duplicated_lines"), counted(found, "total_blocks")).na.fill(0)
    share = F.when(F.col("normalized_lines") > 0, F.col("duplicated_lines") / F.col("normalized_lines") * 100).otherwise(0.0)
    return counts.select(*own, "total_blocks", "duplicated_lines", "normalized_lines", round1(share).alias("percentage"))
