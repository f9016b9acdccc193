"""Queries on tables large enough to pass the limits of the lists of a report."""

import os
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import TABLES, same

from lodestone.operators import duplicates, graphql, graphs, javascript, markup, scope, sqlfacts
from lodestone.plans import queries as plans
from lodestone.plans import report
from lodestone.plans.queries import oracle_sql, queries
from lodestone.sources import tables
from lodestone.sources.tables import spread
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def with_parts(tmp_path):
    """A folder with the smallest tables, but for part, whose keys are given."""

    def make(keys):
        for t in TABLES:
            if t != "part":
                os.symlink(f"{FOLDER}/{t}.parquet", tmp_path / f"{t}.parquet")
        part = pq.read_table(f"{FOLDER}/part.parquet").slice(0, 1).take(pa.array([0] * len(keys)))
        k = part.schema.get_field_index("p_partkey")
        pq.write_table(part.set_column(k, part.schema.field(k), pa.array(keys, part.schema.field(k).type)), tmp_path / "part.parquet")
        return str(tmp_path)

    return make


@pytest.mark.parametrize("name, keys", [("project_graph", range(1, 421)), ("report_summary", range(7, 7 * 421, 7)), ("scan_routes", range(8, 8 * 5003, 8))])
def test_what_has_no_limit_is_whole(spark, with_parts, name, keys):
    same(queries()[name], oracle_sql()[name], spark, with_parts(list(keys)))


def test_project_graph_of_a_report_keeps_its_limits(spark):
    files = spark.range(1, graphs.AUTO_FILES + 2).select(F.lit("p").alias("project_id"), F.concat(F.lit("f"), "id").alias("path"), F.col("id").alias("rank"))
    none = lambda schema: spark.createDataFrame([], f"project_id string, {schema}")
    rest = (none("file string, name string, line int, complexity int, lines int, rank int"), none("from string, to string, at struct<file_ord: long, imp_ord: int>"), none("name string, file string, rank int"), none("from string, to string, file string, rank int"))
    assert graphs.project_graph(files, *rest)[0].count() == graphs.AUTO_FILES
    assert graphs.project_graph(files, *rest, whole=True)[0].count() == graphs.AUTO_FILES + 1


def test_contents_are_spread_by_their_bytes(spark):
    files = spark.range(0, 80, 1, 1).select(F.col("id").alias("file"), F.repeat(F.lit("some text "), 26_214).alias("content"))
    assert spread(files).rdd.getNumPartitions() == 10  # 20 MB in 2 MiB each
    assert markup.pieces(files).rdd.getNumPartitions() == 10 and markup.blocks(files).rdd.getNumPartitions() == 10


def test_style_issues_meet_their_limit_without_a_join(spark):
    sheets = spark.range(2).select(F.struct(F.lit("p").alias("project_id"), F.col("id").alias("ord"), F.concat(F.lit("f"), "id").alias("path")).alias("file"), F.concat(F.lit("a{"), F.repeat(F.lit("x:1 !important;"), 130), F.lit("}")).alias("content"))
    rows = report.style_rows(sheets, sheets.limit(0).withColumns({"ord": F.lit(0), "line": F.lit(0), "language": F.lit("css")}))
    assert "Join" not in rows._jdf.queryExecution().toString()
    assert rows.groupBy("file").agg(F.count_if("capped").alias("n"), F.count("*").alias("all")).select("n", "all").distinct().collect() == [(120, 259)]


def test_only_types_that_fields_lead_to_are_held(spark):
    found = spark.sql("SELECT 'T' || id AS type, 'f' AS name, 'T' || id % 3 AS base_type, true AS is_list FROM range(1, 100)")
    known = spark.sql("SELECT 'T' || id AS name, 'type' AS kind FROM range(1, 100)")
    assert sorted(r.base_type for r in graphql._led_to(found, known).collect()) == ["T1", "T2"]
    assert graphql.relations(found, known).count() == graphql.n_plus_one(found, known, known.where("name = 'Q'")).count() == 66


def test_sql_definitions_are_cut_without_windows(spark):
    text = "CREATE TABLE a (x INT, CREATE TABLE n (y INT), z DECIMAL(1, 2), FOREIGN KEY (x) REFERENCES v);\n) CREATE TABLE e ();CREATE TABLE c (k INT REFERENCES u(i)); CREATE TABLE open (q INT"
    files = spark.createDataFrame([("f", text), ("g", None)], "file string, content string")
    found, links = sqlfacts.tables(files), sqlfacts.relations(files)
    assert [(r.table_ord, r.name, r.line, [c.name for c in r.columns]) for r in found.collect()] == [(0, "a", 1, ["x", "CREATE", "z"]), (2, "c", 2, ["k"])]
    assert sorted((r["from"], r.from_column, r.to, r.to_column) for r in links.collect()) == [("a", "x", "v", None), ("c", "k", "u", "i")]
    assert all("Window" not in x._jdf.queryExecution().toString() for x in (found, links))


def test_rows_are_dealt_before_they_become_contents(spark):
    folder = "/root/testdata/sf0.1"
    for made in (plans._part(spark, folder, "p_name"), plans._sources(spark, folder, "p_name"), plans._project(spark, folder)):
        assert made.rdd.getNumPartitions() == 20_000 // plans.MADE_ROWS


@pytest.mark.parametrize("own", [["project_id"], []])
def test_ranks_of_many_rows_are_those_of_one_task(spark, monkeypatch, own):
    rows = spark.range(0, 5000, 1, 7).selectExpr("id % 3 AS project_id", "id * 7919 % 100 AS a", "id").select(*own, "a", "id")
    want = {(r.id, r.rank) for r in scope.ranked(rows, F.desc("a"), "id").collect()}
    monkeypatch.setattr(tables, "FEW", 0)
    found = scope.ranked(rows, F.desc("a"), "id")
    assert {(r.id, r.rank) for r in found.collect()} == want and len(want) == 5000
    assert "Window" not in found._jdf.queryExecution().toString()


def test_a_copy_of_any_length_is_one_block(spark):
    text = "\n".join(f"line {i} of a text that stands here twice" for i in range(450))
    files = spark.createDataFrame([(k, f"d{k}", text) for k in range(2)], "file_ord long, file string, content string")
    assert duplicates.percentage(files).collect() == [(1, 900, 900, 100.0)]


def test_aliases_are_resolved_where_their_file_is(spark):
    texts = [
        "SELECT 1 FROM orders oo JOIN items AS ii ON oo.id = ii.order_id",
        "SELECT 1 FROM aa xx JOIN bb xx ON xx.k = cc.k OR ON aa.p = AA.q OR ON select.a = bb.b",  # the last alias counts; no self-joins, no words
        "SELECT 1 FROM aa yy JOIN yy zz ON YY.a = zz.b OR ON zz.c = dd.d",  # a name is its own alias, and the last
        "UPDATE up SET a = 1 WHERE b IN (SELECT 1 FROM cc up ON up.a = dd.a)",
        "no query ON a.b = c.d",
        None,
    ]
    files = spark.createDataFrame(list(enumerate(texts)), "file long, content string")
    found = sqlfacts._joined(files)
    assert sorted((r.file, r.at.nth, r["from"], r.from_column, r.to, r.to_column) for r in found.collect()) == [
        (0, 0, "orders", "id", "items", "order_id"), (1, 0, "bb", "k", "cc", "k"), (2, 1, "yy", "c", "dd", "d"), (3, 0, "up", "a", "dd", "a"),
    ]
    assert "Join" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("most", [1, 5, 40])
def test_first_of_equal_rows_are_those_of_one_task(spark, most):
    rows = [(f"p{k % 2}", k, f"k{k * 7919 % 97 % (9 if k % 2 else 60)}") for k in range(600)]
    x = spark.createDataFrame(rows, "project_id string, ord long, name string").select(F.struct("project_id", "ord").alias("file"), "name")
    want = set()
    for p in ("p0", "p1"):
        first = {}
        for project, k, name in rows:
            if project == p:
                first.setdefault(name, k)
        want |= {(p, k, name, n + 1) for n, (name, k) in enumerate(list(first.items())[:most])}
    found = scope.first_distinct(x, most, F.col("name"), 3, "file")
    assert {(r.project_id, r.file.ord, r.name, r["rank"]) for r in found.collect()} == want


def test_tasks_of_code_schemas_do_not_depend_on_the_shuffle(spark):
    rows = spark.range(0, 40, 1, 1).select(F.struct((F.col("id") % 2).alias("project_id"), "id").alias("file"), F.concat(F.lit("SELECT 1 FROM a JOIN b ON a.x = b.y "), F.repeat(F.lit("-"), 1 << 18)).alias("content"))
    for found in sqlfacts.code_schema(rows):
        assert re.search(r"hashpartitioning\(group#\w+, 6\), REPARTITION_BY_NUM", found._jdf.queryExecution().toString())  # 10 MiB, 2 in each


def test_page_checks_need_no_windows_or_groups(spark):
    text = '<!-- <img> --><html\nlang=x><IMG src="a"/>\n<script>"<img>"</script><img ALT=x><p onclick=y style=z>\n<a\nonblur=x>< b <font/><meta NAME="viewport"/></p></i><br><script><img>'
    pages = spark.createDataFrame([("f", text), ("g", None), ("h", "<b id='a'>\n<b id=\"a\"></b id='a'><i id='b'><!-- <u id='b'> -->\n<b id='a' ID='b'>")], "file string, content string")
    checks = markup.page_checks(pages)
    assert not any(word in checks._jdf.queryExecution().toString() for word in ("Window", "Aggregate", "Sort"))
    of = {r.file: r for r in checks.collect()}
    assert of["f"].asDict() | {"file": 0} == {
        "file": 0, "tag_count": 10, "missing_alt": 1, "inline_handlers": 2, "inline_styles": 1, "deprecated_tags": 1, "missing_alt_lines": [2], "inline_handler_lines": [3, 4],
        "missing_lang": False, "missing_viewport": False, "missing_title": True, "max_depth": 3,
    }
    assert (of["g"].tag_count, of["g"].missing_title, of["g"].max_depth, of["g"].missing_alt_lines) == (0, False, 0, [])
    found = markup.page_issues(pages)
    assert sorted((r.file, r.ord.kind, r.type, r.line, r.what, r.lines) for r in found.where("file = 'h'").collect()) == [("h", 1, "duplicate-id", None, "a", [1, 2]), ("h", 1, "duplicate-id", None, "a", [1, 3])]
    assert sorted((r.ord.kind, r.type, r.line) for r in found.where("file = 'f'").collect()) == [(0, "missing-alt", 2), (2, "deprecated-tag", 5), (3, "inline-handler", 3), (3, "inline-handler", 4), (4, "missing-title", 1)]
    # without an id twice, no row is made of a piece
    assert "PushedFilters" not in found._jdf.queryExecution().toString() and markup.duplicate_ids(pages).count() == 2


def test_only_fields_of_roots_are_merged_for_resolvers(spark):
    sdl = spark.createDataFrame([(k, f"type T{k} {{ a: Int }} extend type Query {{ q{k % 3}(x: Int): T{k} }} extend type Mutation {{ m: T{k} }}") for k in range(5)], "file long, content string")
    roots = graphql.roots(sdl)
    found = graphql.fields(sdl, roots.where("root = 'Query'"))
    assert sorted((r.type, r.name, r.base_type, r.has_args) for r in found.collect()) == [("Query", f"q{k}", f"T{k}", True) for k in range(3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join LeftSemi")  # the join is below
    have = spark.createDataFrame([("q1",)], "key string")
    assert sorted(r.key for r in graphql.missing_resolvers(graphql.fields(sdl, roots), roots, have).collect()) == ["m", "q0", "q2"]


def test_scripts_are_cut_into_tokens_once(spark, monkeypatch):
    cut = []
    make = javascript._Source.__init__
    monkeypatch.setattr(javascript._Source, "__init__", lambda self, text: (cut.append(text), make(self, text))[1])
    found = list(javascript._rows(0, "function f(a) { return `x\n${a ? {b: 1} : 2}` }\nclass K { type() { x.type; if (a?.b) { } } }\n)"))
    assert [r[1:4] for r in found] == [("f", 1, 2), ("K.type", 3, 3), (None, None, None)] and found[-1][-1].endswith("(line 4)")
    assert len(cut) == 1 and [r[-1] for r in javascript._rows(1, None)] == []


def test_lines_are_cleaned_and_hashed_once(spark):
    source = ["a \u0085 b \u0085", "x \t y", "﻿ z // c", "  one  two ", "http://k // d", "　"]
    files = spark.createDataFrame([(0, "f", "\n".join(source))], "file_ord long, file string, content string")
    norm = duplicates.normalized_lines(files)
    assert [r.text for r in norm.orderBy("idx").collect()] == ["a \u0085 b \u0085", "x y", "z", "one two", "http://k"]
    plan = duplicates.hashed(norm)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("//.*$") == 1 and plan.count("sha1") == 1
    assert plan.count("Sort [") == 1  # one sorting serves places and windows
