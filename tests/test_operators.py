"""Small fixtures, one for each peculiarity."""

import random

from lodestone.functions import text
from lodestone.operators import advisor, duplicates, extract, graphql, graphs, javascript, markup, rollup, sqlfacts
from pyspark.sql import functions as F


def table(spark, rows, schema="file string, content string"):
    return spark.createDataFrame(rows, schema)


def functions_of(spark, language, source):
    found = extract.python_functions if language == "python" else lambda f: extract.brace_functions(f, language)
    return {r["name"]: r for r in found(table(spark, [("a", source)])).collect()}


def test_python_methods_and_nested_functions(spark):
    f = functions_of(spark, "python", "class A:\n    def m(self, x=(1, 2)):\n        def inner():\n            return 1 if x else 2\n        for i in x:\n            if i and x:\n                pass\n        return inner\n\ndef last(): pass\n")
    assert f["A.m"]["complexity"] == 4 and f["A.m"]["nesting"] == 3 and f["A.m"]["params"] == 2
    assert f["inner"]["complexity"] == 2 and f["last"]["lines"] == 1 and f["A.m"]["end_line"] == 8


def test_python_words_within_words_do_not_count(spark):
    assert functions_of(spark, "python", "def f(x):\n    return notif + x.android  # if\n")["f"]["complexity"] == 1


def test_braces_in_strings_and_comments(spark):
    f = functions_of(spark, "java", 'class A {\n  void f(int a) { // {\n    s("}"); /* { */\n    if (g(a) || b) { x(); }\n  }\n}\n')
    assert f["A.f"]["complexity"] == 3 and f["A.f"]["nesting"] == 1 and f["A.f"]["line"] == 2 and f["A.f"]["end_line"] == 5


def test_go_methods_and_closures(spark):
    f = functions_of(spark, "go", "func (s *T) M(a, b int) {\n  go func() {\n    if x { y() }\n  }()\n  switch z {\n  case 1:\n  }\n}\n")
    assert f["M"]["complexity"] == 2 and f["(anonymous)"]["complexity"] == 2 and f["M"]["nesting"] == 1


def test_rust_impl_prefix(spark):
    assert "P.new" in functions_of(spark, "rust", "impl P {\n fn new() -> P { match x { _ => 1 } }\n}\n")


def test_unclosed_function_is_left_out(spark):
    assert functions_of(spark, "c", "int f(void) {\n if (x) {\n") == {}


def test_empty_files_have_no_functions(spark):
    for language in ("python", "java", "go"):
        assert functions_of(spark, language, "") == {}


def test_arrow_functions(spark):
    f = functions_of(spark, "javascript", "const f = (a, b) => {\n  return a ?? b;\n};\nclass K { m(x) { for (;;) {} } }")
    assert f["f"]["complexity"] == 2 and f["K.m"]["complexity"] == 2


def test_forms_of_javascript_functions(spark):
    for source in (
        "function f(a: number): number { return 1; }", "function f({ a, b }) {}", "const f = ({a}) => {}", "const f = (a = g()) => {}", "const f = async (a): Promise<void> => {}", "const f = x => {}", "const f = (a) => a + 1",
        "const f: (a: number) => void = (a) => { }", "const f = <T,>(a: T): a is A | B => !!a", "let f = function (a: Map<string, number>) {}", "const o = { f(a) {} }", "class A { f = async (a) => a; }", "const f = (a): ((b: number) => void) => { }",
    ):
        for language in ("javascript", "typescript"):
            got = functions_of(spark, language, source)
            assert {n: (r["params"], r["complexity"]) for n, r in got.items()} == {"f": (1, 1)}, source


def test_javascript_decisions_and_names(spark):
    source = "class K {\n  m(x?: T, y) {\n    do { x++; } while (a && b);\n    return a ? 1 : `${b ?? c ? '}' : 3}`;\n  }\n}\nfunction e() { if (a) b(); else if (c) d() }\nxs.map(x => x * 2)\ntype F = (a: number) => void;\ndeclare function f(a: F): void\nconst r = /[{/]'/.test(s), p = new Promise((r) => { switch (r) { case 1: try { r() } catch { } default: } });"
    got = {n: (r["line"], r["end_line"], r["params"], r["complexity"], r["nesting"]) for n, r in functions_of(spark, "typescript", source).items()}
    assert got == {"K.m": (2, 5, 2, 6, 1), "e": (7, 7, 0, 3, 2), "(callback in xs.map)": (8, 8, 1, 1, 0), "(anonymous)": (11, 11, 1, 3, 2)}
    assert functions_of(spark, "javascript", "function a() {") == functions_of(spark, "javascript", "") == {}


def test_paths(spark):
    got = spark.range(1).select(
        text.normalize_path(F.lit("a/./b/../c")).alias("a"), text.normalize_path(F.lit("../../x")).alias("b"), text.dirname(F.lit("x")).alias("c"), text.extension(F.lit("a/B.Min.JS")).alias("d"),
        text.safe_relative_path(F.lit("..\\a\\./b"), ("dist",)).alias("e"), text.safe_relative_path(F.lit("a/dist/b"), ("dist",)).alias("f"), text.round1(F.lit(2.25)).alias("g"),
    ).first()
    assert tuple(got) == ("a/c", "../../x", "", ".js", "a/b", None, 2.3)


def test_lines(spark):
    rows = spark.createDataFrame([("", "python"), ("a\n", "python"), ("# x\nx # y\n\n", "python"), ("// a\n* b\nc", "java"), ("-- a\nb", "sql"), (None, "sql")], "t string, l string")
    got = [tuple(r) for r in rows.select(text.line_count("t"), text.code_line_count("t", "l")).collect()]
    assert got == [(0, 0), (2, 1), (4, 1), (3, 1), (2, 1), (0, 0)]


def greedy(files, size, least):
    """Brute force: hashes in order of first appearance; a group is extended while all its occurrences agree."""
    windows = {f: [None if len("\n".join(t[i : i + size])) < least else "\n".join(t[i : i + size]) for i in range(len(t) - size + 1)] for f, t in files.items()}
    index, used, blocks = {}, set(), []
    for f, w in windows.items():
        for i, h in enumerate(w):
            if h:
                index.setdefault(h, []).append((f, i))
    at = lambda f, i: windows[f][i] if i < len(windows[f]) else None
    for occurrences in index.values():
        if len(occurrences) < 2 or any(o in used for o in occurrences):
            continue
        s = 0
        while True:
            used |= {(f, i + s) for f, i in occurrences}
            following = {at(f, i + s + 1) for f, i in occurrences}
            if len(following) > 1 or None in following:
                break
            s += 1
        blocks.append((size + s, len(occurrences), *occurrences[0]))
    covered = {(f, i + k) for f, i in used for k in range(size)}
    return sorted(blocks), len(covered)


def test_duplicate_blocks_match_brute_force(spark):
    r = random.Random(3)
    files = {}
    for k in range(25):
        t = [f"line number {r.randrange(6)} of the text" for _ in range(r.randrange(0, 25))]
        files[f"f{k:02}"] = t
    files["f24"] = files["f00"] + files["f01"]
    df = table(spark, [(k, f, "\n".join(t)) for k, (f, t) in enumerate(files.items())], "file_ord long, file string, content string")
    want, covered = greedy(files, duplicates.WINDOW_LINES, duplicates.MIN_CHARS)
    got = duplicates.blocks(df).select("normalized_lines", "occurrence_count", "file", "first_idx").collect()
    assert sorted(map(tuple, got)) == want
    assert duplicates.percentage(df).first()["duplicated_lines"] == covered


def test_normalized_lines(spark):
    source = "a  b // c\n{\n/* x\ny */ z\nhttp://w\n\n"
    got = duplicates.normalized_lines(table(spark, [(0, "f", source)], "file_ord long, file string, content string")).orderBy("idx").collect()
    assert [(r["line_no"], r["text"]) for r in got] == [(1, "a b"), (4, "z"), (5, "http://w")]


def test_imports_resolve_in_order(spark):
    files = spark.createDataFrame([("p", x) for x in ("a/x.js", "a/x.ts", "a/y/index.ts", "a/m.js")], "project_id string, path string")
    imports = spark.createDataFrame([("p", "a/m.js", 0, k, s) for k, s in enumerate(("./x", "./y", "../a/m", "./gone", "react", "@s/p/q", "./x.ts"))], "project_id string, file string, file_ord long, imp_ord int, source string")
    got = {r["source"]: r["target"] for r in graphs.resolve_imports(imports, files).collect()}
    assert got == {"./x": "a/x.js", "./y": "a/y/index.ts", "../a/m": "a/m.js", "./gone": None, "react": None, "@s/p/q": None, "./x.ts": "a/x.ts"}


def test_python_parameters_end_at_the_first_parenthesis(spark):
    rows = {"def f(a=(1,2), b=3): pass": 1, "def f(a=[1, 2], b={1: 2, 3: 4}, *c): pass": 3, "def f( ): pass": 0, "def f(a, b=g(), c=1): pass": 2, "def f(a,): pass": 2}
    got = {r["file"]: r["params"] for r in extract.python_functions(table(spark, [(k, k) for k in rows])).collect()}
    assert got == rows


def test_depth_handlers_and_viewport(spark):
    pages = {"a": "<div>" + "<div><p>a</div>" * 10 + "</div>", "b": "<a onclick=1 onblur=2><a ONFOCUS='x'>", "c": "<html><meta name=viewport><title/>", "d": "<b><i></b></i><u>", "e": "", "f": None, "g": "text only", "h": "<x><y><z></x></z></y></x>", "i": "<script>" + "<p>" * 30}
    got = {r["file"]: r for r in markup.page_checks(table(spark, list(pages.items()))).collect()}
    assert {k: r["max_depth"] for k, r in got.items()} == {"a": 3, "b": 2, "c": 1, "d": 2, "e": 0, "f": 0, "g": 0, "h": 3, "i": 0}
    assert got["b"]["inline_handlers"] == 2 and got["c"]["missing_viewport"] and not got["c"]["missing_title"]
    assert [got[k]["tag_count"] for k in "adegi"] == [32, 5, 0, 0, 0]


def test_scripts_that_cannot_be_read_are_rows(spark):
    deep = "if (a) " * 30_000 + "b();"
    files = table(spark, [("ok", "function f(a) { return a && 1; }"), ("deep", deep), ("open", "function g() {\n  h(1;\n}"), ("null", None)])
    read = {(r["file"], r["name"], (r["error"] or "")[:15]) for r in javascript.read(files).collect()}
    assert ("ok", "f", "") in read and ("open", None, "Unexpected toke") in read and {f for f, _, e in read if e} <= {"deep", "open"}
    assert {r["file"] for r in extract.brace_functions(files, "javascript").collect()} >= {"ok"}


def test_cycles_of_two_projects(spark):
    rows = [("p", "a", "b", 0), ("p", "b", "c", 1), ("p", "c", "a", 2), ("p", "c", "d", 3), ("q", "a", "b", 0)]
    edges = spark.createDataFrame([(p, a, b, (k, 0)) for p, a, b, k in rows], "project_id string, from string, to string, at struct<file_ord:long,imp_ord:int>")
    assert [(r["project_id"], r["path"]) for r in graphs.cycles(edges).collect()] == [("p", ["a", "b", "c", "a"])]
    assert {(r["project_id"], r["node"]) for r in graphs.on_cycles(edges).collect()} == {("p", "a"), ("p", "b"), ("p", "c")}


def walked_in_one_piece(edges, most=50):
    """Cycles of one project by a walk over the whole graph, files in file order and edges in import order."""
    after, order = {}, {}
    for a, b, at in sorted(edges, key=lambda e: e[2]):
        after.setdefault(a, []).append(b)
    gray, black, seen, found = [], set(), set(), []

    def visit(node):
        gray.append(node)
        for other in after.get(node, []):
            if other in gray:
                ring = gray[gray.index(other) :]
                if len(found) < most and frozenset(ring) not in seen:
                    seen.add(frozenset(ring))
                    found.append([*ring, other])
            elif other not in black:
                visit(other)
        gray.pop()
        black.add(node)

    for node in after:
        if node not in black:
            visit(node)
    return found


def random_graph(r, nodes, edges):
    """Edges with the place of their import; files come in a shuffled order."""
    names = [f"f{k:02}" for k in range(nodes)]
    r.shuffle(names)
    pairs = {(r.randrange(nodes), r.randrange(nodes)) for _ in range(edges)}
    return [(names[a], names[b], (a, k)) for k, (a, b) in enumerate(sorted(pairs, key=lambda _: r.random())) if a != b]


def test_cycles_and_parts_of_random_graphs(spark):
    """Sparse and dense graphs as projects of one run, against a walk over each; blocks of few edges exchange labels."""
    r = random.Random(11)
    projects = {f"p{k}": random_graph(r, n, m) for k, (n, m) in enumerate([(5, 8), (8, 11), (12, 16), (12, 18), (12, 30), (18, 24), (25, 90)])}
    edges = spark.createDataFrame([(p, a, b, at) for p, x in projects.items() for a, b, at in x], "project_id string, from string, to string, at struct<file_ord:long,imp_ord:int>")
    want = {p: walked_in_one_piece(x) for p, x in projects.items()}
    assert sum(len({n for c in x for n in c}) > 0 for x in want.values()) > 4
    got = {}
    for row in graphs.cycles(edges, block=7).orderBy("project_id", "cycle_ord").collect():
        got.setdefault(row.project_id, []).append(row.path)
    assert got == {p: x for p, x in want.items() if x}
    few = {}
    for row in graphs.cycles(edges.where("project_id in ('p4', 'p6')"), most=2).orderBy("project_id", "cycle_ord").collect():
        few.setdefault(row.project_id, []).append(row.path)
    assert few == {p: walked_in_one_piece(projects[p], 2) for p in ("p4", "p6")}

    def reach(x):
        after = {}
        for a, b, _ in x:
            after.setdefault(a, set()).add(b)
        out = {}
        for a in after:
            met, todo = set(), [a]
            while todo:
                for b in after.get(todo.pop(), ()):
                    if b not in met:
                        met.add(b)
                        todo.append(b)
            out[a] = met
        return out

    groups = {}
    for row in graphs.parts(edges, block=7).collect():
        groups.setdefault((row.project_id, row.part), set()).add(row.node)
    naive = set()
    for p, x in projects.items():
        to = reach(x)
        naive |= {(p, frozenset(b for b in to if b in to[a] and a in to[b])) for a in to if a in to[a]}
    assert {(p, frozenset(g)) for (p, _), g in groups.items()} == naive


def test_no_edges_no_cycles(spark):
    none = spark.createDataFrame([], "project_id string, from string, to string, at struct<file_ord:long,imp_ord:int>")
    assert graphs.cycles(none).count() == 0 and graphs.on_cycles(none).count() == 0
    line = spark.createDataFrame([("p", "a", "b", (0, 0)), ("p", "b", "c", (1, 0)), ("p", "c", "c", (2, 0))], none.schema)
    assert graphs.cycles(line).count() == 0 and graphs.on_cycles(line).count() == 0


def test_graph_json_with_given_degrees_and_aliases(spark):
    files = spark.createDataFrame([("g.json", '{"nodes":[{"name":"a","degree":3},{"id":"b","kind":"x"},{"id":"a"}],"edges":[{"from":"a","to":"b","status":"Inferred?"},{"source":"a","target":"zz"}]}'), ("i.json", '{"__schema":{}, "nodes":[{"id":"q"}]}'), ("bad.json", "{")], "path string, content string")
    nodes, edges = graphs.graph_of_json(files)
    assert {(r["id"], r["degree"]) for r in graphs.with_degrees(nodes, edges).collect()} == {("a", 3.0), ("b", 0.0)}
    assert [(r["from"], r["to"], r["confidence"]) for r in edges.collect()] == [("a", "b", "INFERRED")]


def test_project_graph(spark):
    files = spark.createDataFrame([("p", "s/a.js", 1), ("q", "s/a.js", 1)], "project_id string, path string, rank int")
    functions = spark.createDataFrame([("p", "s/a.js", "K.m", 3, 5, 9, 1), ("p", "s/a.js", "(x.y)", 1, 2, 2, 2), ("p", "gone.js", "f", 1, 1, 1, 3)], "project_id string, file string, name string, line int, complexity int, lines int, rank int")
    imports = spark.createDataFrame([], "project_id string, from string, to string, at struct<file_ord:long,imp_ord:int>")
    tables = spark.createDataFrame([("p", "t", "s/a.js", 1)], "project_id string, name string, file string, rank int")
    relations = spark.createDataFrame([("p", "t", "u", "s/a.js", 1)], "project_id string, from string, to string, file string, rank int")
    nodes, edges = graphs.project_graph(files, functions, imports, tables, relations)
    assert [r["id"] for r in nodes.where("project_id = 'p'").orderBy("ord").collect()] == ["file:s/a.js", "class:s/a.js:K", "fn:s/a.js#K.m@3", "fn:s/a.js#(x.y)@1", "table:t", "table:u"]
    assert [r["id"] for r in nodes.where("project_id = 'q'").collect()] == ["file:s/a.js"]
    assert [(r["from"], r["relation"]) for r in edges.orderBy("ord").collect()] == [("file:s/a.js", "declares"), ("class:s/a.js:K", "defines"), ("file:s/a.js", "defines"), ("file:s/a.js", "defines"), ("table:t", "references")]


def test_sql_quirks(spark):
    source = "CREATE TABLE IF NOT EXISTS `a` (x INT, key INT, y DOUBLE PRECISION, CONSTRAINT q FOREIGN KEY (x, y) REFERENCES b);\nALTER TABLE ONLY a ADD FOREIGN KEY (z) REFERENCES c (id);\n/* SELECT * */ SELECT t.* FROM 'SELECT *'"
    f = table(spark, [("s", source)])
    columns = sqlfacts.tables(f).first()["columns"]
    assert [(c["name"], c["type"]) for c in columns] == [("x", "INT"), ("y", "DOUBLE")]
    assert {tuple(r)[1:] for r in sqlfacts.relations(f).drop("at").collect()} == {("a", "x", "b", None), ("a", "z", "c", "id")}
    assert sqlfacts.issues(f).count() == 0


def test_graphql_unions_enums_and_introspection(spark):
    s = table(spark, [("a", 'enum E { A B }\nunion U = X | Y\nscalar D\ntype X implements I & J { "doc: no" a(b: Int): [E!]! }\nschema { query: X }')])
    assert {r["name"]: r["kind"] for r in graphql.types(s).collect()} == {"E": "enum", "U": "union", "D": "scalar", "X": "type"}
    assert {r["member"] for r in graphql.union_members(s).collect()} == {"X", "Y"}
    assert {r["interface"] for r in graphql.implemented(s).collect()} == {"I", "J"}
    assert [tuple(r) for r in graphql.roots(s).collect()] == [("Query", "X")]
    i = table(spark, [("i", '{"data":{"__schema":{"types":[{"kind":"OBJECT","name":"T","fields":[{"name":"f","type":{"kind":"NON_NULL","ofType":{"kind":"LIST","ofType":{"kind":"OBJECT","name":"T"}}}}]},{"kind":"SCALAR","name":"Int"}]}}}')])
    known, found = graphql.introspected(i)
    assert [tuple(r) for r in known.collect()] == [("T", "type")] and [tuple(r) for r in found.collect()] == [("T", "f", "T", True)]


def test_html_and_css_quirks(spark):
    page = table(spark, [("p", '<html><body><img data-alt="x"><img src=a><font onclick="x">t</font><!-- <img> --><script>"<img>"</script></body></html>')])
    r = markup.page_checks(page).first()
    assert (r["missing_alt"], r["inline_handlers"], r["deprecated_tags"], r["missing_lang"], r["missing_title"]) == (1, 1, 1, True, True)
    css = table(spark, [("c", "@media x { .a { color: red } } .a, #b.c { color: red; color: blue !important }")])
    assert {(r["type"], r["what"]) for r in markup.style_issues(css).collect()} == {("duplicate-selector", ".a"), ("high-specificity", "#b.c"), ("important", "color: blue !important"), ("duplicate-property", "color")}


def test_score_without_functions(spark):
    files = spark.createDataFrame([("a", "js", 10, 5, False)], "path string, language string, lines int, code_lines int, is_long_file boolean")
    none = spark.createDataFrame([], "file string, complexity int, lines int, nesting int")
    row = rollup.score(rollup.summary(files, none).withColumns({"duplication_percentage": F.lit(0.0), "cycle_count": F.lit(1)})).first()
    assert row["total"] == 97 and row["grade"] == "healthy" and row["components"][3]["detail"] == "1 circular dependency"


def test_ruby_quirks(spark):
    rows = [("a", "module M\n def a(x) = x ? 1 : 2\n def self.b(x, y)\n  z = if x\n   1\n  end\n  [1].each do |i|\n   p i if i && y\n  end\n end\nend\ndef open\n 1\n"), ("b", "=begin\ndef no\n=end\n")]
    got = {r["name"]: (r["lines"], r["params"], r["complexity"], r["nesting"]) for r in extract.ruby_functions(table(spark, rows)).collect()}
    assert got["M.a"] == (1, 1, 1, 0) and got["M.b"] == (8, 2, 4, 1) and got["open"][2] == 1 and len(got) == 3


def test_php_outside_its_tags(spark):
    f = functions_of(spark, "php", "function no() { }\n<?php\nclass A { function f($a, $b) { if ($a) { } } }\n?>\nfunction no2() { }")
    assert set(f) == {"A.f"} and f["A.f"]["line"] == 3 and f["A.f"]["params"] == 2 and f["A.f"]["complexity"] == 2


def test_all_is_well(spark):
    names = ("risky_functions", "long_functions", "deep_functions", "long_file_count", "duplicate_blocks", "cycle_count", "markup_issue_count", "style_issue_count", "dangerous_sql", "select_stars", "parse_error_count", "complexity_limit", "function_limit", "file_limit")
    row = ", ".join(f"0 AS {n}" for n in names) + ", 0D AS duplication_percentage, '' AS markup_parts, '' AS style_parts, '' AS chain"
    worst = "cast(null AS struct<name: string, file: string, complexity: int, lines: int, nesting: int, path: string, line: int>)"
    known = spark.sql(f"SELECT {row}, " + ", ".join(f"{worst} AS {n}" for n in ("complex", "longest", "deepest", "largest", "danger")))
    assert [(r["rank"], r["rule"], r["severity"]) for r in advisor.advise(known).collect()] == [(1, "all-clear", "success")]
    assert [(r["rule"], r["title"]) for r in advisor.advise(known.withColumn("cycle_count", F.lit(2))).collect()] == [("cycles", "Break circular dependencies (2 cycle(s))")]


def test_a_chain_into_a_part_takes_few_jobs(spark):
    """Every file of a long chain also imports one on a cycle: the walk follows the chain and enters at its end."""
    n = 60
    rows = [(f"c{k:02}", f"c{k + 1:02}", (k, 0)) for k in range(n)] + [(f"c{k:02}", f"r{k % 3}", (k, 1)) for k in range(n + 1)] + [(f"r{k}", f"r{(k + 1) % 3}", (n + 1 + k, 0)) for k in range(3)]
    edges = spark.createDataFrame([("p", a, b, at) for a, b, at in rows], "project_id string, from string, to string, at struct<file_ord:long,imp_ord:int>")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert [r.path for r in graphs.cycles(edges).collect()] == walked_in_one_piece(rows)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before < 150
