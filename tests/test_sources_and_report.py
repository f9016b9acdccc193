import json
import zipfile

import pytest

from lodestone.plans import report
from lodestone.sources import project
from lodestone.streaming import projects

FILES = {
    "src/a.js": 'import b from "./b";\nfunction f(a) {\n  if (a && b) { return 1; }\n}\n',
    "src/b.js": 'import a from "./a";\nexport function g() {\n}\n',
    "src/lib.min.js": "x",
    "node_modules/m/i.js": "x",
    "db/s.sql": "CREATE TABLE t (id INT);\nDELETE FROM t;\n",
    "p.html": "<html><body><img></body></html>",
    "types.d.ts": "x",
}


def tree(folder):
    for path, content in FILES.items():
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_text(content)


KEPT = {"src/a.js": "javascript", "src/b.js": "javascript", "db/s.sql": "sql", "p.html": "html"}


def test_tree_zip_and_table_give_the_same_files(spark, tmp_path):
    tree(tmp_path / "proj")
    with zipfile.ZipFile(tmp_path / "proj.zip", "w") as z:
        for path, content in FILES.items():
            z.writestr(path, content)
    rows = spark.createDataFrame([("proj", p, c) for p, c in FILES.items()], "project_id string, path string, content string")
    for found in (project.scan_tree(spark, str(tmp_path / "proj"), "proj"), project.from_zips(spark, str(tmp_path)), project.from_table(rows)):
        assert {r["path"]: r["language"] for r in found.collect()} == KEPT
        assert {r["path"]: r["content"] for r in found.collect()} == {p: FILES[p] for p in KEPT}


def test_file_limit(spark):
    listing = spark.createDataFrame([("p", f"f{k}.py", 1) for k in range(6)], "project_id string, path string, size long")
    got = project.route(listing, max_files=4).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in got} == {"accepted": 4, "capped": 2}


def test_folder_limits(spark):
    many = [("many", k, f"r/{k}.js", 1) for k in range(3001)]
    both = [("both", k, f"r/{k}.js", 5 << 20) for k in range(3001)]
    rest = [("none", 1, "a/dist/x.js", 1), ("none", 2, "a/y.js", 6 << 20), ("ok", 1, ".git/x", 1), ("ok", 2, "s/y.js", 10), ("ok", 3, "t/y.js", None), ("ask", 1, "s/a", 4 << 20), ("ask", 2, "s/b", 4 << 20), ("ask", 3, "s/c", 4 << 20), ("ask", 4, "s/d", 4 << 20)]
    got = project.folder_uploads(spark.createDataFrame(many + both + rest, "project_id string, ord long, path string, size long")).collect()
    assert {r["project_id"]: (r["files"], r["root"], r["problem"], r["ask"]) for r in got} == {
        "many": (3001, "r", "files", False), "both": (3001, "r", "bytes", False), "none": (0, None, "empty", False), "ok": (2, "s", None, False), "ask": (4, "s", None, True),
    }


def test_archives_that_cannot_be_read_are_rows(spark, tmp_path, monkeypatch):
    for name, count in (("good", 1), ("many", 5)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for k in range(count):
                z.writestr(f"a{k}.js", "x" * (9000 if name == "large" else 1))
    with zipfile.ZipFile(tmp_path / "large.zip", "w") as z:
        z.writestr("a.js", "x" * 9000)
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    monkeypatch.setattr(project, "MAX_ARCHIVE_BYTES", 2000)
    monkeypatch.setattr(project, "MAX_ZIP_ENTRIES", 3)
    assert [(r["project_id"], r["path"]) for r in project.from_zips(spark, str(tmp_path)).collect()] == [("good", "a0.js")]
    errors = {r["project_id"]: r["message"] for r in project.zip_errors(spark, str(tmp_path)).collect()}
    assert set(errors) == {"many", "large", "broken"} and errors["many"] == errors["large"] == "the archive is over the limits"


def walked(paths):
    """Files of a tree as a walk with a stack meets them; a folder is listed by name."""
    out, stack = [], [""]
    while stack:
        folder = stack.pop()
        names = sorted({p[len(folder) :].split("/")[0] for p in paths if p.startswith(folder)}, key=lambda n: n.encode())
        for name in names:
            if folder + name in paths:
                out.append(folder + name)
            else:
                stack.append(f"{folder}{name}/")
    return out


def test_files_stand_in_the_order_of_the_walk(spark):
    paths = ["b.js", "a/z.js", "a/b/c.js", "a/bc/d.js", "a/b-/d.js", "é/x.js", "ab/y.js", "Z.js", "ab/node_modules/n.js", "a/b/c/d.js", "zz/1.js", "zz/10.js", "zz/2.js", "zz/ü.js", "zz/a/a.js"]
    listing = spark.createDataFrame([("p", p, 1) for p in paths] + [("q", "x.js", 1)], "project_id string, path string, size long")
    order = [p for p in walked(set(paths)) if "node_modules" not in p]
    for most in (100, 5, len(order)):
        got = project.route(listing, max_files=most).where("project_id = 'p'").collect()
        assert [r["path"] for r in sorted((r for r in got if r["status"] == "accepted"), key=lambda r: r["ord"])] == order[:most]
        assert {r["path"] for r in got if r["status"] == "capped"} == set(order[most:])
        assert [r["path"] for r in got if r["status"] == "ignored"] == ["ab/node_modules/n.js"]


def test_graph_json(spark):
    nodes = spark.createDataFrame([("file:b", "b", None), ("file:a", "a", "x")], "id string, label string, source string")
    edges = spark.createDataFrame([("file:b", "file:a", "imports", "EXTRACTED")], "from string, to string, relation string, confidence string")
    doc = json.loads(report.graph_json(nodes, edges).first()["value"])
    assert doc["nodes"] == [{"id": "file:a", "label": "a", "source": "x"}, {"id": "file:b", "label": "b"}]
    assert doc["edges"] == [{"source": "file:b", "target": "file:a", "relation": "imports", "confidence": "EXTRACTED"}]
    assert json.loads(report.graph_json(nodes, edges.limit(0)).first()["value"])["edges"] == []
    assert report.graph_json(nodes.limit(0), edges.limit(0)).count() == 0


def test_report(spark, tmp_path):
    tree(tmp_path / "proj")
    done = report.analyse(project.scan_tree(spark, str(tmp_path / "proj"), "proj"))
    doc = json.loads(report.report(done).first()["report"])
    assert doc["summary"]["file_count"] == 4 and doc["summary"]["function_count"] == 2
    assert [c["path"] for c in doc["cycles"]] == [["src/a.js", "src/b.js", "src/a.js"]]
    assert {a["rule"] for a in doc["advice"]} == {"cycles", "dangerous-sql", "markup"}
    assert doc["score"]["components"][3]["score"] == 82


def test_report_has_all_sections(spark):
    page = "<html>\n<style>#a { }</style><body id='x' id2>\n<p id='x'></p><script>\nfunction f(a) { return a ? 1 : 2; }\n</script></body></html>"
    block = "\n".join(f"export const value{k} = 'a rather long line of text {k}';" for k in range(12))
    introspection = {"__schema": {"types": [{"kind": "OBJECT", "name": "Z", "fields": [{"name": "q", "type": {"kind": "LIST", "ofType": {"kind": "OBJECT", "name": "A"}}}]}]}}
    files = {
        "p.html": page, "a.js": "import x from 'lib/x';\nimport b from './b';\n" + block, "b.js": block, "q.py": "s = 'SELECT oo.x FROM orders oo JOIN items AS it ON oo.id = it.order_id'\n", "t.sql": "CREATE TABLE t (id INT);", "s.graphql": "type Query { a: [A] }\ntype A { bs: [A] }",
        "t.js": "const t = gql`type T { x: Int }`;", "schema.json": json.dumps(introspection), "graph.json": json.dumps({"nodes": [{"id": "n"}, {"id": "m"}], "links": [{"source": "n", "target": "m", "label": "r"}]}), "resolvers.js": "export default { Query: { z: 1 } }",
    }
    rows = spark.createDataFrame([("p", p, c) for p, c in files.items()], "project_id string, path string, content string")
    doc = json.loads(report.report(report.analyse(project.from_table(rows))).first()["report"])
    names = lambda section, key="name": {x.get(key) for x in doc[section]}
    assert [(f["name"], f["file"], f["line"], f["complexity"]) for f in doc["functions"]] == [("<script> f", "p.html", 5, 2)]
    assert ("p.html (inline <style>)", "empty-rule", 3) in {(x["file"], x["type"], x["line"]) for x in doc["style_issues"]}
    assert [(x["what"], x["lines"]) for x in doc["markup_issues"] if x["type"] == "duplicate-id"] == [("x", [2, 3])]
    assert {s["file"]: s["kind"] for s in doc["graphql_sources"]} == {"s.graphql": "SDL file", "t.js": "gql template", "schema.json": "introspection JSON"}
    assert names("graphql_types") == {"Query", "A", "T", "Z"} and names("graphql_n_plus_one", "type") == {"A", "Z"}
    assert names("sql_tables") == {"t", "orders", "items"} and names("sql_relations", "from") == {"orders"} and doc["sql_queries"][0]["queries"] == 1
    assert len(doc["duplicate_blocks"]) == 1 and names("packages") == {"lib"} and names("dependency_nodes", "id") == {"a.js", "b.js"}
    assert names("knowledge_nodes", "id") == {"n", "m"} and names("knowledge_relations") == {"r"} and "table:orders" in names("project_nodes", "id") and doc["project_edges"]


def test_two_projects_are_two_reports(spark):
    """Equal paths and contents in two projects, one of which has more: each report is that of the project alone."""
    block = "\n".join(f"export const value{k} = 'a rather long line of text {k}';" for k in range(9))
    one = {"src/a.js": f"import b from './b';\nimport r from 'react';\n{block}\nfunction f(a) {{ if (a) {{ return a; }} }}", "src/b.js": f"import a from './a';\n{block}", "p.html": "<html><img><p style=a></html>", "c.css": ".a { x: 1 } .a { }", "s.sql": "CREATE TABLE t (id INT REFERENCES u(id)); DELETE FROM t;", "q.graphql": "type Query { a: [A] } type A { q: Query }", "bad.js": "f(("}
    two = one | {"src/c.js": block, "s2.sql": "SELECT * FROM v", "r.py": "def g(a, b):\n    return a or b\n", "graph.json": json.dumps({"nodes": ["n", {"id": "m"}], "links": [{"source": "m", "target": "m"}]})}
    rows = [("one", p, c) for p, c in one.items()] + [("two", p, c) for p, c in two.items()]
    files = spark.createDataFrame(rows, "project_id string, path string, content string")
    both = {r["project_id"]: json.loads(r["report"]) for r in report.report(report.analyse(project.from_table(files))).collect()}
    assert both["one"]["summary"]["cycle_count"] == 1 and both["one"]["parse_errors"][0]["file"] == "bad.js" and both["two"]["summary"]["knowledge_graph_detected"]
    assert len(both["one"]["duplicate_blocks"]) == 1 and both["one"]["duplicate_blocks"][0]["occurrence_count"] == 2 and both["two"]["duplicate_blocks"][0]["occurrence_count"] == 3
    alone = report.report(report.analyse(project.from_table(files.where("project_id = 'two'")))).collect()
    assert [(r["project_id"], json.loads(r["report"])) for r in alone] == [("two", both["two"])]


def test_stream(spark, tmp_path):
    rows = [("p", "a.py", "x\ny", "2024-01-01 00:00:01"), ("p", "b.py", "x", "2024-01-01 00:00:02"), ("p", "c.png", "x", "2024-01-01 00:00:03")]
    df = spark.createDataFrame(rows, "project_id string, path string, content string, arrived string").selectExpr("project_id", "path", "content", "CAST(arrived AS timestamp) AS arrived")
    df.write.parquet(str(tmp_path / "in"))
    counts = projects.lines_by_window(projects.arriving(spark, str(tmp_path / "in")))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("lines").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["files"], r["lines"]) for r in spark.table("lines").collect()] == [(2, 3)]
    got = []
    projects.on_arrival(projects.measured(projects.arriving(spark, str(tmp_path / "in"))), str(tmp_path / "c"), lambda batch, _: got.append(batch.count())).awaitTermination(60)
    assert sum(got) == 2
