"""Tables, foreign keys and doubtful statements of SQL files, and those that program code names in its strings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import clean_identifier, collapse, js_trim, masked, newlines
from lodestone.operators.scope import first_distinct, first_rows, keys, scoped
from lodestone.sources.tables import deals, spread

# Patterns of SQL, words that are no table names, and sizes of lists.
_HIDDEN = r"--[^\n]*+|/\*.*?\*/|'[^']*+'"
_NAME = r'[`"\[]?([\w.]+)[`"\]]?'
CREATE_TABLE = rf"(?i)\bCREATE\s+(?:TEMPORARY\s+|TEMP\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{_NAME}\s*\("
_FOREIGN = rf"(?i)FOREIGN\s+KEY\s*\(([^)]*)\)\s*REFERENCES\s+{_NAME}\s*(?:\(([^)]*)\))?"
ALTER_FOREIGN = rf"(?i)\bALTER\s+TABLE\s+(?:ONLY\s+)?{_NAME}[^;]*?FOREIGN\s+KEY\s*\(([^)]*)\)\s*REFERENCES\s+{_NAME}\s*(?:\(([^)]*)\))?"
_CONSTRAINT = r"(?i)^(CONSTRAINT|PRIMARY\s|FOREIGN\s|UNIQUE\b|KEY\b|INDEX\b|CHECK\b|FULLTEXT\b|SPATIAL\b)"
_BRACKETS = re.compile("([(),])")
MAX_ISSUES = 100
MAX_TABLES, MAX_COLUMNS, MAX_RELATIONS = 200, 40, 500
MAX_CODE_TABLES, MAX_CODE_RELATIONS = 150, 300
NO_TABLES = ("select", "from", "where", "join", "on", "and", "or", "as", "set", "into", "values", "value", "table", "index", "if", "not", "exists", "dual", "order", "group", "by", "limit", "offset", "having", "union", "all", "distinct", "the", "this", "a", "an", "is", "in", "to", "of", "for", "with", "data", "true", "false", "null", "key", "using", "inner", "left", "right", "outer")
HINT = r"(?i)\b(?:SELECT\s[\s\S]{0,300}?\bFROM\b|INSERT\s+INTO\b|UPDATE\s+[`\"\w]+\s+SET\b|DELETE\s+FROM\b|CREATE\s+TABLE\b|(?:INNER|LEFT|RIGHT|FULL|CROSS)\s+JOIN\b)"
QUERY = r"(?i)\b(?:SELECT\s[\s\S]{0,300}?\bFROM\b|INSERT\s+INTO\b|UPDATE\s+[`\"\w]+\s+SET\b|DELETE\s+FROM\b)"
_FROM = r"(?i)\b(?:FROM|JOIN)\s+[`\"\[]?([A-Za-z_]\w*)[`\"\]]?(?:\s+(?:AS\s+)?([a-z]\w{0,15}))?"
_INSERT = r"(?i)\bINSERT\s+(?:IGNORE\s+)?INTO\s+[`\"\[]?([A-Za-z_]\w*)()"
_UPDATE = r"(?i)\bUPDATE\s+[`\"\[]?([A-Za-z_]\w*)[`\"\]]?\s+SET\b()"
_DELETE = r"(?i)\bDELETE\s+FROM\s+[`\"\[]?([A-Za-z_]\w*)()"
_TARGETS = (_FROM, _INSERT, _UPDATE, _DELETE)
_ON = r"(?i)\bON\s+[`\"\[]?([A-Za-z_]\w*)[`\"\]]?\s*\.\s*[`\"\[]?([A-Za-z_]\w*)[`\"\]]?\s*=\s*[`\"\[]?([A-Za-z_]\w*)[`\"\]]?\s*\.\s*[`\"\[]?([A-Za-z_]\w*)"
#: What a name, an alias or an end of a join condition tells.
_WORDS = {"key": "string", "nth": "struct<kind: int, k: int>", "name": "string", "on": "int", "side": "int", "word": "string", "column": "string"}


def _nullable(x: Column) -> Column:
    return F.nullif(clean_identifier(x), F.lit(""))


def _bodies(heads: list[str], between: list[str]) -> list[tuple[int, int, str, list[str]]]:
    """(table_ord, line, head, definitions) of a text's tables, by its heads and the texts before, between and behind them.

    A head inside another table's body is text of that; one whose parenthesis is not closed makes no table.
    """
    tokens, starts = [], {}
    for k, text in enumerate(between):
        if k:
            starts[len(tokens)] = heads[k - 1]
            tokens.append(heads[k - 1])
        tokens += filter(None, _BRACKETS.split(text))
    ends, opened = {}, []
    for k, t in enumerate(tokens):
        if t == "(" or k in starts:
            opened.append(k)
        elif t == ")" and opened:
            ends[opened.pop()] = k
    out, k, line, nth = [], 0, 1, 0
    while k < len(tokens):
        end = ends.get(k) if k in starts else None
        if end is not None:
            parts, level, filled = [[]], 0, False
            for at in range(k + 1, end):
                t = tokens[at]
                if t == "," and not level:
                    parts.append([])
                    continue
                level += (t == "(" or at in starts) - (t == ")")
                parts[-1].append(t)
                filled = True
            if filled:
                out.append((nth, line, tokens[k], ["".join(p) for p in parts]))
            nth += 1
        stop = k + 1 if end is None else end
        line += sum(t.count("\n") for t in tokens[k:stop])
        k = stop
    return out


def _definitions(masked_files: DataFrame) -> DataFrame:
    """(file, table_ord, line, table, definitions) of (file, s): a row for each CREATE TABLE with anything in its parentheses,
    which may nest as deep as they do. A text is at most 1 MiB; only those with such a statement leave the JVM."""
    kind = masked_files.schema["file"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("heads").to_pylist(), batch.column("between").to_pylist(), strict=True)
            rows = [(k, *r) for k, (heads, between) in enumerate(both) for r in _bodies(heads, between)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()))
            file = batch.column("file").take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([file, *(pa.array(c, t) for c, t in zip(columns[1:], types, strict=True))], ["file", "table_ord", "line", "head", "definitions"])

    x = masked_files.where(F.regexp_like("s", F.lit(CREATE_TABLE))).select("file", F.regexp_extract_all("s", F.lit(CREATE_TABLE), F.lit(0)).alias("heads"), F.split("s", CREATE_TABLE, -1).alias("between"))
    d = x.mapInArrow(run, f"file {kind}, table_ord long, line int, head string, definitions array<string>")
    return d.select("file", "table_ord", "line", clean_identifier(F.regexp_extract("head", CREATE_TABLE, 1)).alias("table"), F.transform("definitions", collapse).alias("definitions"))


def _masked(files: DataFrame) -> DataFrame:
    """(file, s): contents without comments and strings."""
    return spread(files).select("file", masked("content", _HIDDEN).alias("s"))


def tables(files: DataFrame) -> DataFrame:
    """(file, table_ord, name, line, columns): columns are structs of name, type and primary_key."""
    shape = r"^[`\"\[]?(\w+)[`\"\]]?\s+([A-Za-z]+(?:\s*\([^)]*\))?)"
    columns = F.filter("definitions", lambda d: ~d.rlike(_CONSTRAINT) & d.rlike(shape))
    column = lambda d: F.struct(F.regexp_extract(d, shape, 1).alias("name"), F.regexp_replace(F.upper(F.regexp_extract(d, shape, 2)), r"\s+", "").alias("type"), d.rlike(r"(?i)PRIMARY\s+KEY").alias("primary_key"))
    return _definitions(_masked(files)).select("file", "table_ord", F.col("table").alias("name"), "line", F.transform(columns, column).alias("columns"))


def relations(files: DataFrame) -> DataFrame:
    """Foreign keys: file, at, from, from_column, to, to_column (null if not named); of composite keys the first column.

    ``at`` orders those of a file: by table and definition, then those that ALTER TABLE adds.
    """
    s = _masked(files)
    d = _definitions(s).select("file", "table_ord", "table", F.posexplode("definitions").alias("def_ord", "d"))
    inline = rf"(?i)\bREFERENCES\s+{_NAME}\s*(?:\(([^)]*)\))?"
    column = r"^[`\"\[]?(\w+)[`\"\]]?\s+[A-Za-z]+"
    part = lambda k, pattern: F.regexp_extract("d", pattern, k)
    constraint = F.col("d").rlike(_CONSTRAINT)
    place = F.struct(F.lit(0).alias("kind"), F.col("table_ord").cast("int").alias("table"), F.col("def_ord").cast("int").alias("nth")).alias("at")
    of = lambda by_table, by_column: F.when(constraint, by_table).otherwise(by_column)
    found = d.where((constraint & F.col("d").rlike(_FOREIGN)) | (~constraint & F.col("d").rlike(inline) & F.col("d").rlike(column)))
    named = {"from": F.col("table"), "from_column": of(clean_identifier(part(1, _FOREIGN)), part(1, column)), "to": of(clean_identifier(part(2, _FOREIGN)), clean_identifier(part(1, inline))), "to_column": of(_nullable(part(3, _FOREIGN)), _nullable(part(2, inline)))}
    by_table = found.select("file", place, *(c.alias(k) for k, c in named.items()))
    altered = s.select("file", F.posexplode(F.regexp_extract_all("s", F.lit(ALTER_FOREIGN), F.lit(0))).alias("nth", "t"))
    part_of = lambda k: F.regexp_extract("t", ALTER_FOREIGN, k)
    last = F.struct(F.lit(1).alias("kind"), F.lit(0).alias("table"), "nth").alias("at")
    by_alter = altered.select("file", last, clean_identifier(part_of(1)).alias("from"), clean_identifier(part_of(2)).alias("from_column"), clean_identifier(part_of(3)).alias("to"), _nullable(part_of(4)).alias("to_column"))
    return by_table.unionByName(by_alter)


def issues(files: DataFrame, most: int = MAX_ISSUES) -> DataFrame:
    """Doubtful statements, at most ``most`` a file: file, line, type, table, joins, place (their order)."""
    s = spread(files).select("file", F.posexplode(F.split(masked("content", _HIDDEN), ";")).alias("nth", "statement"))
    before = F.sum(F.length("statement") - F.length(F.replace("statement", F.lit("\n")))).over(Window.partitionBy("file").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    lead = F.regexp_extract("statement", r"^(\s*)", 1)
    s = s.withColumn("line", F.coalesce(before, F.lit(0)) + 1 + F.length(lead) - F.length(F.replace(lead, F.lit("\n")))).withColumn("t", js_trim("statement")).where("t != ''")
    t = F.col("t")
    where = t.rlike(r"(?i)\bWHERE\b")
    joins = F.regexp_count("t", F.lit(r"(?i)\bJOIN\b"))
    found = [
        F.when(t.rlike(r"(?i)\bSELECT\s+\*"), F.struct(F.lit(0).alias("k"), F.lit("select-star").alias("type"), F.lit(None).cast("string").alias("table"), F.lit(None).cast("int").alias("joins"))),
        F.when(t.rlike(r"(?i)^DELETE\s+FROM\b") & ~where, F.struct(F.lit(1).alias("k"), F.lit("delete-no-where").alias("type"), clean_identifier(F.regexp_extract("t", rf"(?i)^DELETE\s+FROM\s+{_NAME}", 1)).alias("table"), F.lit(None).cast("int").alias("joins"))),
        F.when(t.rlike(r"(?i)^UPDATE\b") & ~where, F.struct(F.lit(2).alias("k"), F.lit("update-no-where").alias("type"), clean_identifier(F.regexp_extract("t", rf"(?i)^UPDATE\s+(?:ONLY\s+)?{_NAME}", 1)).alias("table"), F.lit(None).cast("int").alias("joins"))),
        F.when(joins >= 4, F.struct(F.lit(3).alias("k"), F.lit("many-joins").alias("type"), F.lit(None).cast("string").alias("table"), joins.cast("int").alias("joins"))),
    ]
    listed = s.select("file", "nth", "line", F.explode(F.array_compact(F.array(*found))).alias("i"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("nth", "i.k"))
    return listed.withColumn("place", place).where(F.col("place") <= most).select("file", "line", "i.type", "i.table", "i.joins", "place")


def counters(files: DataFrame) -> DataFrame:
    """(file, statements, selects)."""
    s = F.filter(F.split(masked("content", _HIDDEN), ";"), lambda x: js_trim(x) != "")
    return files.select("file", F.size(s).alias("statements"), F.size(F.filter(s, lambda x: x.rlike(r"(?i)\bSELECT\b"))).alias("selects"))


def likely_table(x: Column) -> Column:
    return x.rlike(r"^[A-Za-z_]\w*$") & F.length(x).between(2, 40) & ~F.lower(x).isin(*NO_TABLES)


def embedded_tables(files: DataFrame) -> DataFrame:
    """Tables that code's queries name: name as first seen (reads before writes in a file), in how many files, and where first."""
    seen = _targets(files).where(likely_table(F.col("name"))).withColumn("key", F.lower("name"))
    # files stay where they are, so that a task passes on a row a name
    seen = scoped(seen.groupBy("file", "key").agg(F.min(F.struct("nth", "line", "name")).alias("t")))
    first = seen.groupBy(*keys(seen), "key").agg(F.min(F.struct("file", "t")).alias("f"), F.count("*").alias("files"))
    return first.select(*keys(seen), "key", "f.t.name", "files", F.struct("f.file", "f.t.nth", "f.t.line").alias("at"))


def _seen(kind: int, pattern: str) -> Column:
    """What a pattern matches in a content: structs of nth, name, alias and the newlines before and inside it.

    The text is split at what the pattern matches, so the line of a match is one more than the newlines before it.
    """
    part = lambda t, g: F.regexp_extract(t, pattern, g)
    matches, between = F.regexp_extract_all("content", F.lit(pattern), F.lit(0)), F.split("content", pattern, -1)
    gap = lambda t, k: F.struct(newlines(F.get(between, k)).alias("before"), newlines(t).alias("inside"))
    return F.transform(matches, lambda t, k: F.struct(F.struct(F.lit(kind).alias("kind"), k.alias("k")).alias("nth"), part(t, 1).alias("name"), part(t, 2).alias("alias"), gap(t, k).alias("gap")))


def _targets(files: DataFrame) -> DataFrame:
    """(file, nth, name, alias, line): after FROM and JOIN, then INSERT, UPDATE and DELETE, each in the order of the text."""
    hinted = spread(files).where(F.col("content").rlike(HINT))
    found = [_seen(kind, pattern) for kind, pattern in enumerate(_TARGETS)]
    x = hinted.select("file", F.explode(F.concat(*found)).alias("t")).select("file", "t.*")
    w = Window.partitionBy("file", "nth.kind").orderBy("nth.k")
    line = 1 + F.sum("gap.before").over(w) + F.coalesce(F.sum("gap.inside").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.select("file", "nth", "name", "alias", line.cast("int").alias("line"))


def quoted(files: DataFrame) -> DataFrame:
    """Code with SQL in it whose single quotes are double ones, so that masking SQL strings leaves the statements."""
    return files.where(F.col("content").rlike(HINT)).select("file", F.replace("content", F.lit("'"), F.lit('"')).alias("content"))


def embedded_declared(files: DataFrame) -> DataFrame:
    """Tables that CREATE TABLE statements inside code declare, each once by its name's first declaration."""
    t = scoped(tables(quoted(files)))
    first = t.groupBy(*keys(t), F.lower("name").alias("key")).agg(F.min_by(F.struct("name", "file", "columns", "line", "table_ord"), F.struct("file", "table_ord")).alias("t"))
    return first.select(*keys(t), "t.*")


def _joined(files: DataFrame) -> DataFrame:
    """(file, at, from, from_column, to, to_column) that join conditions show, aliases resolved within their file, the last
    one of a name; no self-joins.

    Names, aliases and both ends of the conditions of a file are rows of one table, so that files stay where they are dealt.
    """
    row = lambda **c: F.struct(*((c[k] if k in c else F.lit(None).cast(kind)).alias(k) for k, kind in _WORDS.items()))
    part = lambda t, k: F.regexp_extract(t, _ON, k)
    ends = lambda k: F.transform("on", lambda t, n: row(key=F.lower(part(t, k)), on=n, side=F.lit(k), word=part(t, k), column=part(t, k + 1)))
    kinds = [_seen(kind, pattern) for kind, pattern in enumerate(_TARGETS)]
    hinted = spread(files).where(F.col("content").rlike(HINT)).select("file", "content", F.regexp_extract_all("content", F.lit(_ON), F.lit(0)).alias("on"))
    x = hinted.select("file", "on", F.filter(F.concat(*kinds), lambda t: likely_table(t["name"])).alias("t"))
    names = F.transform("t", lambda t: row(key=F.lower(t["name"]), nth=t["nth"], name=t["name"]))
    aliases = F.transform(F.filter("t", lambda t: likely_table(t["alias"])), lambda t: row(key=F.lower(t["alias"]), nth=t["nth"], name=t["name"]))
    x = x.select("file", F.explode(F.when(F.size("on") > 0, F.concat(names, aliases, ends(1), ends(3)))).alias("w")).select("file", "w.*")
    x = x.withColumn("meant", F.max_by("name", "nth").over(Window.partitionBy("file", "key"))).where(F.col("on").isNotNull())
    end = lambda k: F.max(F.when(F.col("side") == k, F.struct(F.coalesce("meant", "word").alias("name"), "column")))
    both = x.groupBy("file", "on").agg(end(1).alias("l"), end(3).alias("r"))
    last = F.struct(F.lit(2).alias("kind"), F.lit(0).alias("table"), F.col("on").alias("nth")).alias("at")
    both = both.select("file", last, F.col("l.name").alias("from"), F.col("l.column").alias("from_column"), F.col("r.name").alias("to"), F.col("r.column").alias("to_column"))
    return both.where(likely_table(F.col("from")) & likely_table(F.col("to")) & (F.lower("from") != F.lower("to")))


def embedded_relations(files: DataFrame) -> DataFrame:
    """Relations that join conditions in code show (see ``_joined``), each once."""
    return distinct_relations(_joined(files).drop("at"))


def code_schema(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables and relations of SQL inside code, each once, the first 150 and 300 of a project in order of appearance.

    Tables: name, file, line, columns, inferred, rank; those that code declares come before those that it only uses.
    Relations: from, from_column, to, to_column, file, inferred, rank.
    """
    at = lambda kind, own, k: F.struct(F.lit(kind).alias("kind"), "file", F.struct(own.alias("kind"), k.cast("int").alias("k")).alias("nth")).alias("at")
    declared = tables(quoted(files)).select(at(0, F.lit(0), F.col("table_ord")), "name", "file", "line", "columns", F.lit(False).alias("inferred"))
    used = _targets(files).where(likely_table(F.col("name")))
    none = F.array().cast(declared.schema["columns"].dataType).alias("columns")
    used = used.select(at(1, F.col("nth.kind"), F.col("nth.k")), "name", "file", "line", none, F.lit(True).alias("inferred"))
    found = relations(quoted(files)).withColumn("inferred", F.lit(False)).unionByName(_joined(files).withColumn("inferred", F.lit(True)))
    n = deals(files)
    first = first_distinct(declared.unionByName(used), MAX_CODE_TABLES, F.lower("name"), n, "at")
    return first.drop("at"), first_distinct(found, MAX_CODE_RELATIONS, _relation_key(), n, "file", "at").drop("at")


def schema(sql: DataFrame, code: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables and relations of SQL files and, where they don't name them, of SQL inside code, in order of appearance.

    Tables: name, file, line, columns, from_code, inferred, rank. Relations: from, from_column, to, to_column, file,
    inferred, from_code, rank. Nothing is cut here but what ``code_schema`` cuts.
    """
    declared, links = scoped(tables(sql)), scoped(relations(sql))
    more, joined = code_schema(code)
    own = keys(declared)
    known = declared.select(*own, F.lower("name").alias("key")).distinct()
    more = more.withColumn("key", F.lower("name")).join(known, [*own, "key"], "left_anti")
    shape = lambda df, place, *columns: df.select(*own, *columns, place.alias("place"))
    place = lambda kind, file, k: F.struct(F.lit(kind).alias("kind"), file.alias("file"), k.cast("int").alias("k"))
    nowhere = F.lit(None).cast(declared.schema["file"].dataType)
    one = shape(declared.withColumns({"from_code": F.lit(False), "inferred": F.lit(False)}), place(0, F.col("file"), F.col("table_ord")), "name", "file", "line", "columns", "from_code", "inferred")
    two = shape(more.withColumn("from_code", F.lit(True)), place(1, nowhere, F.col("rank")), "name", "file", "line", "columns", "from_code", "inferred")
    all_tables = first_rows(one.unionByName(two), 1 << 30, "place").drop("place")
    seen = links.select(*own, _relation_key().alias("key")).distinct()
    joined = joined.withColumn("key", _relation_key()).join(seen, [*own, "key"], "left_anti")
    names = ("from", "from_column", "to", "to_column", "file", "inferred", "from_code")
    within = lambda kind, file, table, k: F.struct(F.lit(kind).alias("kind"), file.alias("file"), table.alias("table"), k.cast("int").alias("k"))
    first = shape(links.withColumns({"inferred": F.lit(False), "from_code": F.lit(False)}), within(0, F.col("file"), F.struct("at.kind", "at.table"), F.col("at.nth")), *names)
    second = shape(joined.withColumn("from_code", F.lit(True)), within(1, nowhere, F.struct(F.lit(0).alias("kind"), F.lit(0).alias("table")), F.col("rank")), *names)
    return all_tables, first_rows(first.unionByName(second), 1 << 30, "place").drop("place")


def query_counts(files: DataFrame) -> DataFrame:
    """One row (a project): queries in files that hint at SQL, and how many such files there are."""
    hinted = scoped(files.where(F.col("content").rlike(HINT)))
    return hinted.groupBy(*keys(hinted)).agg(F.coalesce(F.sum(F.regexp_count("content", F.lit(QUERY))), F.lit(0)).alias("queries"), F.count("*").alias("files_with_sql"))


def merged_tables(declared: DataFrame, embedded: DataFrame) -> DataFrame:
    """Declared tables, and those of code (name) that none of them declares, whatever their case; each once."""
    new = embedded.select("name").withColumn("key", F.lower("name")).join(declared.select(F.lower("name").alias("key")).distinct(), "key", "left_anti")
    one = new.groupBy("key").agg(F.min("name").alias("name")).select("name", F.lit(True).alias("inferred"))
    return declared.select("name", F.lit(False).alias("inferred")).unionByName(one)


def _relation_key() -> Column:
    return F.lower(F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in ("from", "from_column", "to", "to_column"))))


def distinct_relations(found: DataFrame) -> DataFrame:
    """Relations that differ in more than case; a missing column equals an empty one."""
    return found.groupBy(_relation_key().alias("key")).agg(F.min(F.struct("from", "from_column", "to", "to_column")).alias("r")).select("r.*")


def external_tables(declared: DataFrame, found: DataFrame) -> DataFrame:
    """Ends of relations that no table declares."""
    return found.select(F.explode(F.array("from", "to")).alias("name")).distinct().join(declared.select("name"), "name", "left_anti")
