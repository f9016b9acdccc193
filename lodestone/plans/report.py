"""The whole analysis of the file tables of any number of projects, and a report of each as one JSON document.

A file is a struct of project_id, ord and path (see ``operators.scope``), so that every table knows its project and sorts in
the order in which a project's files were taken. Lists are cut to their lengths by project, in the order of appearance or
of their ranking; nothing is sorted or cut across projects, so a project's report is the same alone and among others.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import code_line_count, line_count, round1
from lodestone.operators import advisor, duplicates, extract, graphql, graphs, javascript, markup, rollup, sqlfacts
from lodestone.operators.scope import first_rows, keys, scoped, side_by_side
from lodestone.sources.tables import written

# Lengths of the report's lists.
MAX_STYLE, MAX_MARKUP, MAX_ERRORS = 200, 200, 50
#: What the report's summary holds, in its order.
SUMMARY = (
    "file_count", "total_lines", "code_lines", "function_count", "avg_complexity", "max_complexity", "risky_functions", "long_functions", "long_file_count", "deep_functions", "duplication_percentage",
    "cycle_count", "parse_error_count", "graphql_detected", "knowledge_graph_detected", "language_breakdown", "style_issue_count", "markup_issue_count", "sql_table_count", "sql_relation_count", "sql_issue_count", "project_graph_node_count",
)


@dataclass
class Analysis:
    """Tables of all projects, each with project_id. ``sections`` are the report's lists by their names, with their rank."""

    files: DataFrame
    functions: DataFrame
    imports: DataFrame
    edges: DataFrame
    cycles: DataFrame
    errors: DataFrame
    summary: DataFrame
    advice: DataFrame
    sections: dict[str, DataFrame] = field(default_factory=dict)


def read_functions(code: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Functions of (file, language, content), every language by its own extractor, and errors (file, message).

    A script that can't be read is a row of the errors; what other files hold doesn't depend on it.
    """
    found = extract.python_functions(code.where("language = 'python'"))
    found = found.unionByName(extract.ruby_functions(code.where("language = 'ruby'")))
    for name in extract.LANGUAGES:
        found = found.unionByName(extract.brace_functions(code.where(F.col("language") == name), name))
    errors = None
    for name in extract.SCRIPTS:
        read = written(javascript.read(code.where(F.col("language") == name)), "scripts")
        found = found.unionByName(javascript.shaped(read, name))
        some = read.where("error is not null").select("file", F.substring_index("error", "\n", 1).alias("message"))
        errors = some if errors is None else errors.unionByName(some)
    return found, errors


def inline_functions(inline: DataFrame) -> DataFrame:
    """Functions of scripts inside pages (see markup.inline_code), lines counted as the original does: one too many."""
    scripts = inline.where("language = 'javascript'").select(F.struct("file", "ord", "line").alias("file"), "content")
    found = extract.brace_functions(scripts, "javascript")
    shift = F.col("file.line")
    return found.withColumns({"name": F.concat(F.lit("<script> "), "name"), "line": F.col("line") + shift, "end_line": F.col("end_line") + shift, "file": F.col("file.file")})


def flat(df: DataFrame) -> DataFrame:
    """With the file's path in place of the struct."""
    return scoped(df).withColumn("file", F.col("file.path"))


def style_rows(sheets: DataFrame, inline: DataFrame) -> DataFrame:
    """(project_id, file, source, type, what, line, first_line, number, place, capped): issues of style sheets and of styles
    inside pages; capped tells those within the limit of their sheet, ``place`` orders them."""
    block = lambda x, nth, line: x.select(F.struct("file", nth.cast("int").alias("nth"), line.cast("int").alias("line")).alias("file"), "content")
    styled = block(sheets, F.lit(-1), F.lit(0)).unionByName(block(inline.where("language = 'css'"), F.col("ord"), F.col("line")))
    found = markup.listed(written(markup.style_issues(styled), "styles"))
    x = found.withColumn("place", F.struct("file", "ord")).withColumns({"source": F.col("file.file"), "inline": F.col("file.nth") >= 0, "line": F.col("line") + F.col("file.line")})
    label = F.concat(F.col("source.path"), F.when(F.col("inline"), " (inline <style>)").otherwise(""))
    return x.select(F.col("source.project_id").alias("project_id"), label.alias("file"), F.col("source"), "inline", "type", "what", "line", "first_line", "number", "place", "capped")


def graphql_sections(files: DataFrame, scripts: DataFrame, code: DataFrame) -> dict[str, DataFrame]:
    """Types, relations and issues of SDL files, templates that define something, and introspection results.

    All are empty for a project without a type, or without a root and any field.
    """
    source = lambda kind, nth: F.struct(F.col("file.project_id").alias("project_id"), F.lit(kind).alias("kind"), F.col("file.ord").alias("ord"), nth.cast("int").alias("nth"), F.col("file.path").alias("path")).alias("file")
    defines = F.col("content").rlike(r"\b(type|interface|input|enum|union|scalar|schema)\s+[A-Za-z_{]")
    sdl = files.where("kind = 'graphql'").select(source(0, F.lit(0)), "content")
    sdl = written(sdl.unionByName(extract.graphql_templates(scripts).where(defines).select(source(1, F.col("tpl_ord")), "content")), "sdl")
    r = graphql.registry(sdl, files.where("kind = 'schema_json'").select(source(2, F.lit(0)), "content"))
    r = graphql.Registry(*(written(x, "graphql") for x in (r.types, r.fields, r.members, r.interfaces, r.roots, r.sources)))
    present = written(graphql.present(r), "graphql")
    r = graphql.Registry(*(x.join(present, "project_id", "left_semi") for x in (r.types, r.fields, r.members, r.interfaces, r.roots, r.sources)))
    links = written(graphql.all_relations(r), "graphql")
    kinds = F.element_at(F.array(F.lit("SDL file"), F.lit("gql template"), F.lit("introspection JSON")), F.col("file.kind") + 1)
    ranked = graphql.ranked_types(r).withColumn("source_files", F.array_distinct(F.transform("source_files", lambda f: f["path"])))
    return {
        "graphql_sources": first_rows(r.sources.select("project_id", "file", kinds.alias("kind")), 1 << 30, "file").withColumn("file", F.col("file.path")),
        "graphql_types": ranked,
        "graphql_statistics": graphql.statistics(r.types, r.roots),
        "graphql_operations": graphql.operations(r),
        "graphql_relations": links,
        "graphql_edges": links.select("project_id", "from", "to").distinct(),
        "graphql_n_plus_one": graphql.n_plus_one(r.fields, r.types, r.roots),
        "graphql_oversized": graphql.oversized(r.fields, r.types, r.roots),
        "graphql_missing_resolvers": graphql.missing_resolvers(r.fields, r.roots, graphql.resolver_keys(code)),
        "graphql_data_loader": scoped(code.where(extract.uses_data_loader("content"))).select("project_id").distinct(),
    }


def graph_sections(nodes: DataFrame, edges: DataFrame, prefix: str, least: int = 1) -> dict[str, DataFrame]:
    """The largest of each project's graphs (see graphs.normalized), if it has ``least`` nodes: its numbers, nodes and edges,
    most connected nodes and relations."""
    nodes = written(nodes, "graph")
    enough = nodes.groupBy("project_id", "path").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("project_id", "path")
    largest = written(graphs.largest_graph(nodes.join(enough, ["project_id", "path"], "left_semi")), "graph")
    edges = written(edges.join(largest, ["project_id", "path"], "left_semi"), "graph")
    nodes = written(graphs.with_degrees(nodes.join(largest, ["project_id", "path"], "left_semi"), edges), "graph")
    top, between = graphs.capped(nodes, edges)
    return {f"{prefix}_stats": graphs.graph_stats(nodes, edges), f"{prefix}_nodes": top.withColumn("rank", F.col("ord")), f"{prefix}_edges": between.withColumn("rank", F.col("ord")), f"{prefix}_god_nodes": graphs.god_nodes(nodes), f"{prefix}_relations": graphs.relation_counts(edges)}


def _melted(checks: DataFrame) -> DataFrame:
    names = ("max_depth", "missing_alt", "deprecated_tags", "inline_handlers", "inline_styles", "missing_lang", "missing_viewport", "missing_title")
    return checks.select("file", F.explode(F.array(*(F.struct(F.lit(n).alias("fact"), F.col(n).cast("long").alias("n")) for n in names))).alias("f")).select("file", "f.*")


def analyse(files: DataFrame, whole_graph: bool = False) -> Analysis:
    """Analyse file tables (see sources.project); facts are written to tables, as many sections read them.

    The project graph is made of the first files, functions, classes, tables and edges, or of all with ``whole_graph``; its
    lists of nodes and edges have a fixed length either way.
    """
    named = F.struct("project_id", F.col("ord").cast("long").alias("ord"), "path").alias("file")
    files = written(files.select(named, "project_id", "kind", "language", "content"), "files")
    code = files.where("kind = 'code'")
    scripts, pages, sheets, sql = (code.where(F.col("language").isin(*x)) for x in (extract.SCRIPTS, ("html",), ("css",), ("sql",)))
    inline = written(markup.inline_code(pages), "inline")
    found, faults = read_functions(code)
    functions = written(scoped(found.unionByName(inline_functions(inline))), "functions")
    errors = written(scoped(faults), "errors")
    described = code.select(F.col("file").alias("path"), "language", line_count("content").alias("lines"), code_line_count("content", "language").alias("code_lines"))

    imports = extract.imports(scripts).select("file.project_id", F.col("file.path").alias("file"), F.col("file.ord").alias("file_ord"), "imp_ord", "source")
    resolved = written(graphs.resolve_imports(imports, scripts.select("project_id", F.col("file.path").alias("path"))), "imports")
    edges = written(graphs.dependency_edges(resolved), "edges")
    cycles = written(graphs.cycles(edges), "cycles").withColumn("rank", F.col("cycle_ord") + 1)
    cyclic = graphs.cyclic_files(cycles)

    checks = written(markup.page_checks(pages), "checks")
    page_issues = written(scoped(markup.page_issues(pages, checks)), "page-issues")
    styles = written(style_rows(sheets, inline), "styles")
    sql_issues = written(scoped(sqlfacts.issues(sql)), "sql-issues")
    sql_tables, sql_relations = (written(x, "schema") for x in sqlfacts.schema(sql, code.where("language != 'sql'")))
    counted = lambda df, fact, file="file": df.groupBy(F.col(file).alias("file"), F.lit(fact).alias("fact")).agg(F.count("*").alias("n"))
    facts = rollup.facts_by_file(
        _melted(checks), counted(page_issues.where("type = 'duplicate-id'"), "duplicate_ids"), styles.where("not inline").groupBy(F.col("source").alias("file"), F.col("type").alias("fact")).agg(F.count("*").alias("n")),
        counted(sql_tables.where("not from_code"), "sql_tables"), counted(sql_issues, "sql_issues"),
    )
    table = rollup.file_rollup(described, functions).join(facts.withColumnRenamed("file", "path"), "path", "left")
    table = table.withColumns({"project_id": F.col("path.project_id"), "ord": F.col("path.ord")}).withColumn("path", F.col("path.path"))
    messages = errors.select("project_id", F.col("file.path").alias("path"), F.col("message").alias("parse_error"))
    table = rollup.file_warnings(rollup.mark_cyclic(table, cyclic)).drop("facts").join(messages, ["project_id", "path"], "left")
    table = written(first_rows(table, 1 << 30, F.desc("risky_functions"), F.desc("max_complexity"), F.desc("lines"), "ord"), "files")

    searched = duplicates.search(code.select(F.struct("file.project_id", "file.ord").alias("file_ord"), "file", "content"))
    blocks = written(duplicates.top_of(searched), "top-blocks")
    by_rank = lambda most: first_rows(functions, most, F.desc("complexity"), F.desc("lines"), "file", "line", "name")
    ranked = written(by_rank(rollup.TOP_FUNCTIONS), "top-functions")
    ranked = flat(ranked).withColumns({"risky": F.col("complexity") > rollup.COMPLEXITY, "long": F.col("lines") > rollup.FUNCTION_LINES, "deep": F.col("nesting") > rollup.NESTING})
    path = F.transform("occurrences", lambda o: o.withField("file", o["file"]["path"]))

    style_list = first_rows(styles.where("capped"), MAX_STYLE, "place").select("project_id", "file", "type", "what", "line", "first_line", "number", "rank")
    markup_list = flat(first_rows(page_issues, MAX_MARKUP, "file", "ord")).drop("ord")
    issue_list = flat(first_rows(sql_issues, sqlfacts.MAX_ISSUES, "file", "place")).drop("place")
    error_list = flat(first_rows(errors, MAX_ERRORS, "file"))
    auto = graphs.project_graph(table.select("project_id", "path", "rank"), flat(by_rank(1 << 30)) if whole_graph else ranked, edges, flat(sql_tables), flat(sql_relations), whole_graph)
    sections = {
        "files": table,
        "functions": ranked,
        "histogram": rollup.histogram(functions).withColumn("rank", F.col("bucket_ord")),
        "style_issues": style_list,
        "markup_issues": markup_list,
        "parse_errors": error_list,
        "cycles": cycles,
        "duplicate_blocks": blocks.withColumn("occurrences", path).drop("file_ord", "first_idx"),
        "packages": graphs.external_packages(resolved),
        "dependency_nodes": graphs.dependency_nodes(edges, cyclic),
        "sql_tables": flat(sql_tables.where(F.col("rank") <= sqlfacts.MAX_TABLES)).withColumns({"column_count": F.size("columns"), "columns": F.slice("columns", 1, sqlfacts.MAX_COLUMNS)}),
        "sql_relations": flat(sql_relations.where(F.col("rank") <= sqlfacts.MAX_RELATIONS)),
        "sql_issues": issue_list,
        "sql_queries": sqlfacts.query_counts(code.where("language != 'sql'")),
        **graphql_sections(files, scripts, code),
        **graph_sections(*graphs.graph_of_json(files.where("kind = 'schema_json'").select("project_id", F.col("file.path").alias("path"), "content")), "knowledge"),
        **graph_sections(*auto, "project", least=3),
    }
    count = lambda df, name: df.groupBy("project_id").agg(F.count("*").alias(name))
    seen = lambda df, name: df.select("project_id").distinct().withColumn(name, F.lit(True))
    languages = table.groupBy("project_id", "language").agg(F.count("*").alias("file_count"), F.sum("lines").alias("lines"), F.min("ord").alias("ord"))
    languages = languages.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("lines")).alias("by"), "ord", "language", "file_count", "lines"))).alias("l"))  # of the 16 languages
    languages = languages.select("project_id", F.transform("l", lambda x: x.dropFields("by", "ord")).alias("language_breakdown"))
    projects = files.select("project_id").distinct()
    totals = side_by_side(
        projects, rollup.summary(table, functions, "project_id"), duplicates.percentage_of(searched).select("project_id", F.col("percentage").alias("duplication_percentage")), count(cycles, "cycle_count"), count(errors, "parse_error_count"),
        seen(sections["graphql_types"], "graphql_detected"), seen(sections["knowledge_nodes"], "knowledge_graph_detected"), languages, count(styles.where("capped"), "style_issue_count"), count(page_issues, "markup_issue_count"),
        count(sql_tables, "sql_table_count"), count(sql_relations, "sql_relation_count"), count(sql_issues, "sql_issue_count"), sections["project_stats"].select("project_id", F.col("node_count").alias("project_graph_node_count")),
    ).na.fill(0).na.fill(False).withColumnRenamed("total_code_lines", "code_lines")
    summary = written(rollup.score(totals), "summary")
    known = advisor.facts(summary.withColumn("avg_complexity", round1(F.col("avg_complexity"))), ranked, table.select("project_id", "path", "lines", "rank"), markup_list, style_list, issue_list, blocks, cycles)
    return Analysis(table, functions, resolved, edges, cycles, errors, summary, advisor.advise(known), sections)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row (value) for each project, or one, with a graph of bounded size, as a project's is, for ``write.text``; none if
    it has no nodes."""
    own = keys(nodes)
    sort = lambda df, *names: df.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct(*names, *(c for c in df.columns if c not in (*names, *own, "rank", "path"))))).alias("found"))
    of_nodes, of_edges = sort(nodes, "id").withColumnRenamed("found", "nodes"), sort(edges, "from", "to", "relation").withColumnRenamed("found", "edges")
    links = F.transform("edges", lambda e: F.struct(e["from"].alias("source"), e["to"].alias("target"), e["relation"].alias("relation"), e["confidence"].alias("confidence")))
    both = side_by_side(of_nodes, of_edges).where(F.size("nodes") > 0)
    return both.select(*own, F.to_json(F.struct("nodes", F.coalesce(links, F.array()).alias("edges")), {"pretty": "true"}).alias("value"))


def _rows(df: DataFrame, name: str) -> DataFrame:
    """The rows of a list as JSON, with what orders them: their rank, where they have one."""
    columns = [c for c in df.columns if c not in ("project_id", "rank")]
    rank = F.col("rank").cast("long") if "rank" in df.columns else F.lit(0).cast("long")
    return df.select("project_id", F.lit(name).alias("name"), rank.alias("rank"), F.to_json(F.struct(*columns) if columns else F.struct(F.lit(True).alias("found"))).alias("row"))


def report(a: Analysis) -> DataFrame:
    """One row a project (project_id, report): summary, score and all sections; a section without rows is an empty list.

    All lists are one table of JSON rows, put together once; each has a fixed length, or is as long as one schema.
    """
    lists = {"advice": a.advice, **a.sections}
    rows = reduce(DataFrame.unionByName, (_rows(df, name) for name, df in lists.items()))
    joined = rows.groupBy("project_id", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "row"))), lambda r: r["row"]), ",").alias("rows"))
    found = joined.groupBy("project_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "rows"))).alias("lists"))
    score, summary = F.struct("total", "grade", "components"), F.struct(*(round1(F.col(c)).alias(c) if c == "avg_complexity" else F.col(c) for c in SUMMARY))
    parts = [F.lit('{"score":'), F.to_json(score), F.lit(',"summary":'), F.to_json(summary)]
    for name in lists:
        parts += [F.lit(f',"{name}":['), F.coalesce(F.try_element_at("lists", F.lit(name)), F.lit("")), F.lit("]")]
    return side_by_side(a.summary, found).select("project_id", F.concat(*parts, F.lit("}")).alias("report"))
