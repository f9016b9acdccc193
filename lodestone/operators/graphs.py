"""Dependency graphs of files, property graphs from JSON, and the graph of a whole project."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import basename, dirname, normalize_path, package_root, top_folder
from lodestone.operators.scope import first_rows, keys, side_by_side
from lodestone.sources.tables import written

#: Edges that one task floods with labels.
BLOCK = 1_000_000
#: Orders of the nodes by which labels are compared at once.
ORDERS = 8
# What an import may leave out, and sizes of graphs.
ENDINGS = ("", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", "/index.js", "/index.jsx", "/index.ts", "/index.tsx", "/index.mjs", "/index.cjs")
MAX_NODES, MAX_CYCLES, MAX_EXTERNAL = 400, 50, 50
KG_GOD_NODES, KG_RELATIONS = 12, 12
KG_NODES, KG_EDGES, KG_ALL_NODES, KG_ALL_EDGES = 400, 3000, 20_000, 150_000
AUTO_FILES, AUTO_FUNCTIONS, AUTO_CLASSES, AUTO_TABLES, AUTO_EDGES = 400, 250, 150, 120, 4000


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (project_id, file, file_ord, imp_ord, source) with ``target``, the file meant, or null.

    The 13 candidates of a relative import are exploded and meet the files in one equi-join; the first one wins.
    """
    relative = F.col("source").startswith("./") | F.col("source").startswith("../")
    base = normalize_path(F.concat(dirname("file"), F.lit("/"), F.col("source")))
    inside = imports.where(relative).withColumn("base", base)
    tried = inside.select("project_id", "file", "imp_ord", F.posexplode(F.array(*(F.concat("base", F.lit(e)) for e in ENDINGS))).alias("rank", "path"))
    hits = tried.join(files.select("project_id", "path").distinct(), ["project_id", "path"]).groupBy("project_id", "file", "imp_ord").agg(F.min_by("path", "rank").alias("target"))
    return imports.join(hits, ["project_id", "file", "imp_ord"], "left")


def dependency_edges(resolved: DataFrame) -> DataFrame:
    """Distinct edges between files, without loops: project_id, from, to, and the order of their first import."""
    edges = resolved.where("target is not null and target != file")
    return edges.groupBy("project_id", F.col("file").alias("from"), F.col("target").alias("to")).agg(F.min(F.struct("file_ord", "imp_ord")).alias("at"))


def external_packages(resolved: DataFrame, most: int | None = MAX_EXTERNAL) -> DataFrame:
    """Packages of each project by number of import statements; of equals the one imported first."""
    outside = resolved.where((F.col("target").isNull() | (F.col("target") == F.col("file"))) & ~F.col("source").startswith("."))
    counts = outside.groupBy(*keys(outside), package_root("source").alias("name")).agg(F.count("*").alias("imports"), F.min(F.struct("file_ord", "imp_ord")).alias("at"))
    return first_rows(counts, most or 1 << 30, F.desc("imports"), "at", "name").drop("at")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, out_degree) of each project; a loop counts twice."""
    ends = edges.select(*keys(edges), F.explode(F.array(F.struct(F.col("from").alias("node"), F.lit(1).alias("out")), F.struct(F.col("to").alias("node"), F.lit(0).alias("out")))).alias("e"))
    return ends.groupBy(*keys(edges), F.col("e.node").alias("node")).agg(F.count("*").alias("degree"), F.sum("e.out").alias("out_degree"))


def _flood(frame: pd.DataFrame) -> pd.DataFrame:
    """Labels of the nodes of one block of edges (a, b), in each of several orders: the smallest label first goes wherever
    its edges lead."""
    nodes, place = np.unique(frame[["a", "b"]].to_numpy().T.ravel(), return_inverse=True)
    a, b = place[: len(frame)], place[len(frame) :]
    given = np.full((len(nodes), ORDERS), np.iinfo(np.int64).max)
    np.minimum.at(given, a, np.stack(frame["la"]))
    np.minimum.at(given, b, np.stack(frame["lb"]))
    order = np.argsort(a, kind="stable")
    bounds, after = np.searchsorted(a[order], np.arange(len(nodes) + 1)).tolist(), b[order].tolist()
    found = np.empty_like(given)
    for k in range(ORDERS):
        known, out = given[:, k].tolist(), [None] * len(nodes)
        for root in np.argsort(given[:, k], kind="stable").tolist():
            if out[root] is not None:
                continue
            least, todo = known[root], [root]
            out[root] = least
            while todo:
                node = todo.pop()
                for other in after[bounds[node] : bounds[node + 1]]:
                    if out[other] is None:
                        out[other] = least
                        todo.append(other)
        found[:, k] = out
    return pd.DataFrame({"node": nodes, "label": list(found), "less": (found < given).any(axis=1)})


def least_labels(edges: DataFrame, rows: int, block: int = BLOCK) -> DataFrame:
    """(node, label): the least nodes, in each of ``ORDERS`` orders, of all from which edges (a, b), ``rows`` of them, lead to
    a node, itself included. The first order is that of the nodes' numbers, the others are those of hashes.

    Edges are dealt to blocks of about ``block`` by a hash. A block is flooded by one task, and what blocks have found is
    exchanged by joins until nothing changes: one round for a graph of a single block, and at most as many as the graph
    is wide for a larger one.
    """
    blocks = -(-rows // block) or 1
    own = lambda end: F.array(F.col(end), *(F.xxhash64(end, F.lit(k)) for k in range(1, ORDERS)))
    labelled = edges.select("a", "b", own("a").alias("la"), own("b").alias("lb"))
    while True:
        dealt = labelled.withColumn("block", F.pmod(F.xxhash64("a", "b"), F.lit(blocks)))
        found = written(dealt.groupBy("block").applyInPandas(_flood, "node long, label array<long>, less boolean"), "labels")
        if blocks == 1:
            return found.select("node", "label")
        least = F.array(*(F.min(F.col("label")[k]) for k in range(ORDERS)))
        labels = written(found.groupBy("node").agg(least.alias("label"), F.bool_or("less").alias("less")), "labels")
        if labels.where("less").isEmpty():
            return labels.select("node", "label")
        of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))  # noqa: E731, B023
        labelled = edges.join(of("a"), "a").join(of("b"), "b")


def parts(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(project_id, node, part) of the nodes of all strongly connected parts of more than one node; ``part`` is a number.

    Nodes of a part are reached from the same nodes and reach the same nodes. So edges whose ends differ in a least node
    that leads to them, or in one they lead to, lie in no part and are cut, until none is. Several orders of the nodes at
    once make that few rounds.
    """
    ends = edges.where(F.col("from") != F.col("to")).select("project_id", "from", "to")
    names = ends.select("project_id", F.explode(F.array("from", "to")).alias("node")).distinct()
    ids = written(names.withColumn("id", F.monotonically_increasing_id()), "nodes")
    of = lambda name, end: ids.select("project_id", F.col("node").alias(name), F.col("id").alias(end))
    left = written(ends.join(of("from", "a"), ["project_id", "from"]).join(of("to", "b"), ["project_id", "to"]).select("a", "b").distinct(), "edges")
    rest = left.count()
    labels = ids.select(F.col("id").alias("node"), F.array("id").alias("label"))
    while rest:
        before = rest
        for x, y in (("a", "b"), ("b", "a")):
            labels = least_labels(left.select(F.col(x).alias("a"), F.col(y).alias("b")), rest, block)
            at = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))  # noqa: E731, B023
            left = written(left.join(at("a"), "a").join(at("b"), "b").where("la = lb").select("a", "b"), "edges")
            rest = left.count()
        if rest == before:
            break
    inside = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return labels.join(inside, "node").select(F.col("node").alias("id"), F.col("label")[0].alias("part")).join(ids, "id").select("project_id", "node", "part")


def on_cycles(edges: DataFrame) -> DataFrame:
    """(project_id, node) of all nodes that lie on any cycle, whatever order a walk takes."""
    return parts(edges).select("project_id", "node")


def _walk(most: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The depth-first walk of one part from its entry: its cycles and the edges by which it leaves the part, by time."""

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        after: dict[str, list[tuple[str, bool]]] = {}
        for a, b, inner in frame.sort_values(["from", "nth"])[["from", "to", "inner"]].itertuples(index=False):
            after.setdefault(a, []).append((b, inner))
        root = frame["entry"].iloc[0]
        done: set[str] = set()
        seen: set[tuple[str, ...]] = set()
        out: list[tuple[int, str | None, str | None]] = []
        path, place, todo, time, found = [root], {root: 0}, [iter(after[root])], 0, 0
        while todo:
            step = next(todo[-1], None)
            if step is None:
                todo.pop()
                last = path.pop()
                del place[last]
                done.add(last)
                continue
            node, inner = step
            time += 1
            if not inner:
                out.append((time, node, None))
            elif node in place:
                ring = path[place[node] :]
                key = tuple(sorted(ring))
                if found < most and key not in seen:
                    seen.add(key)
                    found += 1
                    out.append((time, None, "\0".join([*ring, node])))
            elif node not in done:
                place[node] = len(path)
                path.append(node)
                todo.append(iter(after.get(node, ())))
        times, targets, rings = zip(*out, strict=True)
        return pd.DataFrame({"project_id": frame["project_id"].iloc[0], "part": frame["part"].iloc[0], "time": times, "to": targets, "path": rings})

    return walk


def _led_to_parts(tagged: DataFrame, cyclic: DataFrame, block: int) -> DataFrame:
    """(project_id, part, alone) of all parts, and of files in none that lead to any; alone: such a file leads to one only.

    A part's number is below zero. So the least number that a file leads to tells whether it leads to any, and that it leads
    to one only if the least is the same with the parts numbered the other way round.
    """
    between = written(tagged.where("not inner").select("project_id", "part", "next").distinct(), "between")
    real = cyclic.select("project_id", F.col("part").cast("string").alias("part"))
    names = between.select("project_id", F.explode(F.array("part", "next")).alias("part")).unionByName(real).distinct()
    ids = written(names.withColumn("id", F.monotonically_increasing_id()), "numbers")
    single, last = F.col("part").startswith("/"), 1 << 62
    rows, found = between.count(), ids
    for name, number in (("high", -F.col("id") - 1), ("low", F.col("id") - last)):
        numbered = ids.select("project_id", "part", F.when(single, F.col("id")).otherwise(number).alias("n"))
        end = lambda c, to: numbered.select("project_id", F.col("part").alias(c), F.col("n").alias(to))  # noqa: E731, B023
        ends = written(between.join(end("next", "a"), ["project_id", "next"]).join(end("part", "b"), ["project_id", "part"]).select("a", "b"), "between")
        labels = least_labels(ends, rows, block).select(F.col("node").alias("n"), F.col("label")[0].alias(name)) if rows else None
        of = numbered.join(labels, "n", "left").withColumn(name, F.coalesce(name, "n")) if rows else numbered.withColumn(name, F.col("n"))
        found = found.join(of.drop("n"), ["project_id", "part"])
    return written(found.where("high < 0").select("project_id", "part", (single & (-F.col("high") - 1 == F.col("low") + last)).alias("alone")), "led")


def _skipped(steps: DataFrame, alone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The steps without those from ``alone`` files, and the ways on which these begin: (project_id, part, entry, way).

    From a file that leads to one part only, a walk takes the first step that leads on, and so it enters that part, whatever
    else the file imports. Its first steps are followed by doubling (log n joins); a step to such a file is one to the part,
    and ``enters`` is the file of the part at which it ends. Ways that differ do so before they meet such a file.
    """
    own = ["project_id", "part"]
    begun = steps.join(alone, own, "left_semi").groupBy(*own).agg(F.min_by(F.struct("to", "next"), "nth").alias("s"), F.min("ord").alias("ord"))
    ends = written(begun.select(*own, "ord", F.col("s.to").alias("entry"), F.col("s.next").alias("next")), "ends")
    while not ends.where(F.col("next").startswith("/")).isEmpty():
        on = ends.select("project_id", F.col("part").alias("next"), F.col("entry").alias("e"), F.col("next").alias("n"))
        ends = written(ends.join(on, ["project_id", "next"], "left").select(*own, "ord", F.coalesce("e", "entry").alias("entry"), F.coalesce("n", "next").alias("next")), "ends")
    at = ends.select("project_id", F.col("part").alias("next"), F.col("entry").alias("e"), F.col("next").alias("n"))
    left = steps.join(alone, own, "left_anti").join(at, ["project_id", "next"], "left")
    left = left.withColumns({"enters": F.coalesce("e", "to"), "next": F.coalesce("n", "next")}).drop("e", "n")
    return written(left, "steps"), ends.select("project_id", F.col("next").alias("part"), "entry", F.array("ord").alias("way"))


def cycles(edges: DataFrame, most: int = MAX_CYCLES, block: int = BLOCK) -> DataFrame:
    """(project_id, cycle_ord, path): one closed path for each back edge of a depth-first walk in import order.

    Every cycle lies in one strongly connected part, and what the walk does inside a part depends only on the node at which
    it enters. So only parts are walked, each by one task. Which node comes first, and when, tells the least path to it
    from a file in file order, compared step by step: parts are taken in the order of their dependencies, all that wait for
    none at once, and hand their path, with the time of the step, to those they lead to. A file that leads to one part only
    is skipped, however long the chain of such files; one that leads to several parts and lies in none is taken like a part.
    """
    own = Window.partitionBy("project_id", "from").orderBy("at.file_ord", "at.imp_ord", "to")
    e = written(edges.where(F.col("from") != F.col("to")).select("project_id", "from", "to", F.col("at.file_ord").cast("long").alias("ord"), F.row_number().over(own).cast("long").alias("nth")), "edges")
    cyclic = written(parts(edges, block), "parts")
    of = lambda name, to: cyclic.select("project_id", F.col("node").alias(name), F.col("part").alias(to))
    # a file that is in no part is one by its name
    key = lambda c, part: F.coalesce(F.col(part).cast("string"), F.concat(F.lit("/"), c))
    tagged = e.join(of("from", "p"), ["project_id", "from"], "left").join(of("to", "q"), ["project_id", "to"], "left")
    tagged = written(tagged.select("project_id", "from", "to", "ord", "nth", key("from", "p").alias("part"), key("to", "q").alias("next"), F.col("p").isNotNull().alias("walked")).withColumn("inner", F.col("part") == F.col("next")), "edges")
    led = _led_to_parts(tagged, cyclic, block)
    # only files that lead to a part tell how it is entered
    useful = led.select("project_id", "part")
    steps = tagged.join(useful, ["project_id", "part"], "left_semi").join(useful.withColumnRenamed("part", "next"), ["project_id", "next"], "left_semi")
    steps, first = _skipped(written(steps, "steps"), led.where("alone").select("project_id", "part"))
    own_ways = steps.groupBy("project_id", "part", F.col("from").alias("entry")).agg(F.array(F.min("ord")).alias("way"))
    ways = written(own_ways.unionByName(first), "ways")
    waiting, found = steps.where("not inner").select("project_id", "part", "next").distinct(), None
    while True:
        ready = ways.join(waiting.select("project_id", F.col("next").alias("part")), ["project_id", "part"], "left_anti").groupBy("project_id", "part").agg(F.min(F.struct("way", "entry")).alias("w"))
        ready = written(ready.select("project_id", "part", "w.way", "w.entry"), "ready")
        if ready.isEmpty():
            break
        here = steps.join(ready, ["project_id", "part"])
        walks = here.where("walked").groupBy("project_id", "part").applyInPandas(_walk(most), "project_id string, part string, time long, to string, path string")
        events = written(walks.unionByName(here.where("not walked").select("project_id", "part", F.col("nth").alias("time"), "to", F.lit(None).cast("string").alias("path"))).join(ready.select("project_id", "part", "way"), ["project_id", "part"]), "events")
        events = events.withColumn("way", F.concat("way", F.array("time")))
        rings = events.where("path is not null").select("project_id", "way", "path")
        found = rings if found is None else found.unionByName(rings)
        target = steps.select("project_id", F.col("part").alias("at"), "to", "next", "enters").distinct()
        more = events.where("to is not null").withColumnRenamed("part", "at").join(target, ["project_id", "at", "to"]).select("project_id", F.col("next").alias("part"), "way", F.col("enters").alias("entry"))
        ways = written(ways.join(ready, ["project_id", "part"], "left_anti").unionByName(more), "ways")
        waiting = written(waiting.join(ready, ["project_id", "part"], "left_anti"), "waiting")
    if found is None:
        return e.sparkSession.createDataFrame([], "project_id string, cycle_ord int, path array<string>")
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("way"))  # of at most ``most`` cycles of each part
    return found.withColumn("cycle_ord", place - 1).where(F.col("cycle_ord") < most).select("project_id", "cycle_ord", F.split("path", "\0").alias("path"))


def cyclic_files(found: DataFrame) -> DataFrame:
    return found.select("project_id", F.explode("path").alias("file")).distinct()


def dependency_nodes(edges: DataFrame, cyclic: DataFrame, most: int = MAX_NODES) -> DataFrame:
    """Files that have edges: id, folder, in_cycle, degree, out_degree, rank; over the limit of a project, cyclic and
    well-connected ones come first."""
    own = [k for k in keys(edges) if k in cyclic.columns]
    c = cyclic.select(*own, F.col("file").alias("node"), F.lit(True).alias("c")).distinct()
    x = degrees(edges).join(c, [*own, "node"], "left").withColumn("in_cycle", F.coalesce("c", F.lit(False)))
    folder = F.when(dirname("node") == "", ".").otherwise(dirname("node"))
    top = first_rows(x, most, F.desc("in_cycle"), F.desc("degree"), "node")
    return top.select(*keys(edges), F.col("node").alias("id"), folder.alias("folder"), "in_cycle", "degree", "out_degree", "rank")


def edges_between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are among the nodes, of the same project if they have one."""
    own = keys(nodes)
    ids = nodes.select(*own, "id")
    return edges.join(ids.withColumnRenamed("id", "from"), [*own, "from"], "left_semi").join(ids.withColumnRenamed("id", "to"), [*own, "to"], "left_semi")


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """What a node is connected with: direction, other, and the edge's relation."""
    out = edges.where(F.col("from") == node).select(F.lit("out").alias("direction"), F.col("to").alias("other"), "relation")
    into = edges.where(F.col("to") == node).select(F.lit("in").alias("direction"), F.col("from").alias("other"), "relation")
    return out.unionByName(into).distinct()


# --- property graphs ---------------------------------------------------------------------------------------------------


def _first(v: Column, names: tuple[str, ...], truthy: bool = False) -> Column:
    """The first of several members; with ``truthy``, the first that is neither empty, 0 nor false."""
    found = [F.try_variant_get(v, f"$.{n}", "string") for n in names]
    return F.coalesce(*((F.when(~x.isin("", "0", "false"), x) if truthy else x) for x in found))


def confidence(x: Column) -> Column:
    up = F.upper(x)
    return F.when(up.contains("EXTRACT"), "EXTRACTED").when(up.contains("INFER"), "INFERRED").when(up.contains("AMBIG"), "AMBIGUOUS")


def graph_of_json(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the JSON files (path, content) that hold a graph, whatever its members are called."""
    own = keys(files)
    v = files.select(*own, "path", F.try_parse_json("content").alias("v")).where(F.try_variant_get("v", "$.__schema", "string").isNull() & F.try_variant_get("v", "$.data.__schema", "string").isNull())
    lists = lambda names: F.coalesce(*(F.try_variant_get("v", f"$.{n}", "array<variant>") for n in names))
    raw = v.select(*own, "path", F.posexplode(lists(("nodes", "graph.nodes"))).alias("ord", "n"))
    n = F.col("n")
    alone = F.when(F.schema_of_variant(n) == "STRING", F.try_variant_get(n, "$", "string"))  # a node may be just its id
    nodes = raw.select(
        *own, "path", "ord", F.coalesce(alone, _first(n, ("id", "name", "label"))).alias("id"), F.coalesce(alone, _first(n, ("label", "name", "id"))).alias("label"), _first(n, ("type", "kind", "category"), True).alias("type"),
        F.coalesce(*(F.to_json(F.try_variant_get(n, f"$.{k}", "variant")) for k in ("community", "group", "cluster"))).alias("community"), _first(n, ("source", "file", "path", "location"), True).alias("source"),
        F.coalesce(F.try_variant_get(n, "$.degree", "double"), F.lit(0.0)).alias("given_degree"),
    ).where("id is not null")
    nodes = nodes.withColumn("k", F.row_number().over(Window.partitionBy(*own, "path", "id").orderBy("ord"))).where("k = 1").drop("k")
    e = F.col("e")
    edges = v.select(*own, "path", F.posexplode(lists(("edges", "links", "graph.edges"))).alias("ord", "e")).select(
        *own, "path", "ord", _first(e, ("source", "from")).alias("from"), _first(e, ("target", "to")).alias("to"),
        _first(e, ("relation", "relationship", "label", "type"), True).alias("relation"), confidence(_first(e, ("confidence", "tag", "status"), True)).alias("confidence"),
    )
    return normalized(nodes, edges)


def normalized(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph by its path, from whichever source: edges between its nodes only, and nodes with their degrees.

    ``nodes``: path, ord, id, label, type, community, source and given_degree; ``edges``: path, ord, from, to, relation,
    confidence; both with project_id where there are several projects.
    """
    own = [*keys(nodes), "path"]
    ids = nodes.select(*own, "id")
    valid = edges.join(ids.withColumnRenamed("id", "from"), [*own, "from"], "left_semi").join(ids.withColumnRenamed("id", "to"), [*own, "to"], "left_semi")
    return nodes, valid


def with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with degree: the given one if any node of the graph gives a positive one, else the number of edge ends."""
    own = [*keys(nodes), "path"]
    given = nodes.groupBy(*own).agg((F.max("given_degree") > 0).alias("given"))
    counted = edges.select(*own, F.explode(F.array("from", "to")).alias("id")).groupBy(*own, "id").agg(F.count("*").alias("ends"))
    x = nodes.join(given, own).join(counted, [*own, "id"], "left")
    return x.withColumn("degree", F.when(F.col("given"), F.col("given_degree")).otherwise(F.coalesce("ends", F.lit(0))).cast("double")).drop("given", "ends", "given_degree")


def largest_graph(nodes: DataFrame) -> DataFrame:
    """The path of the graph with most nodes; the first by path of equals."""
    return first_rows(nodes.groupBy(*keys(nodes), "path").agg(F.count("*").alias("n")), 1, F.desc("n"), "path").select(*keys(nodes), "path")


def god_nodes(nodes: DataFrame, most: int = KG_GOD_NODES) -> DataFrame:
    return first_rows(nodes, most, F.desc("degree"), "ord").select(*keys(nodes), "label", "type", "degree", "source", "rank")


def relation_counts(edges: DataFrame, most: int = KG_RELATIONS) -> DataFrame:
    named = edges.where("relation is not null and relation != ''")
    counts = named.groupBy(*keys(edges), F.col("relation").alias("name")).agg(F.count("*").alias("total"), F.min("ord").alias("ord"))
    return first_rows(counts, most, F.desc("total"), "ord", "name").drop("ord")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    own = keys(nodes)
    a = nodes.groupBy(*own).agg(F.count("*").alias("node_count"), F.count_distinct("community").alias("community_count"))
    tags = [F.count_if(F.col("confidence") == c).alias(c.lower()) for c in ("EXTRACTED", "INFERRED", "AMBIGUOUS")]
    return side_by_side(a, edges.groupBy(*own).agg(F.count("*").alias("edge_count"), *tags, F.count_if(F.col("confidence").isNull()).alias("untagged"))).na.fill(0)


def capped(nodes: DataFrame, edges: DataFrame, most_nodes: int = KG_NODES, most_edges: int = KG_EDGES) -> tuple[DataFrame, DataFrame]:
    """The best-connected nodes, in the graph's order, and the first edges between them."""
    top = written(first_rows(nodes, most_nodes, F.desc("degree"), "ord").drop("rank"), "top-nodes")
    return top, first_rows(edges_between(edges, top), most_edges, "ord").drop("rank")


def project_graph(files: DataFrame, functions: DataFrame, imports: DataFrame, tables: DataFrame, relations: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """The graph of a project's files, classes, functions and tables, as ``normalized`` takes it.

    ``files``: path, rank; ``functions``: file, name, line, complexity, lines, rank (by complexity and lines); ``imports``:
    from, to, at; ``tables``: name, file, rank; ``relations``: from, to, file, rank; all with project_id. Every list but
    relations is cut to a fixed length for each project, and so are the edges, unless the ``whole`` graph is asked for.
    Nodes and edges stand in the order in which a project's lists name them; a later node of an id that is taken is none.
    """
    own = keys(files)
    most = lambda n: 1 << 30 if whole else n
    at = lambda *parts: F.array(*(p.cast("long") for p in parts)).alias("at")

    def node(df: DataFrame, place: Column, ident: Column, label: Column, kind: str, community: Column, source: Column) -> DataFrame:
        return df.select(*own, place, ident.alias("id"), label.alias("label"), F.lit(kind).alias("type"), community.alias("community"), source.alias("source"))

    def edge(df: DataFrame, place: Column, a: Column, b: Column, relation: str) -> DataFrame:
        return df.select(*own, place, a.alias("from"), b.alias("to"), F.lit(relation).alias("relation"))

    f = files.where(F.col("rank") <= most(AUTO_FILES))
    named = lambda kind, name: F.concat(F.lit(f"{kind}:"), name)
    path, name = F.col("path"), F.col("name")
    file_nodes = node(f, at(F.lit(0), F.col("rank"), F.lit(0)), named("file", path), basename("path"), "file", top_folder("path"), path)
    imported = first_rows(edges_between(imports, f.select(*own, path.alias("id"))), most(AUTO_EDGES), "at")
    import_edges = edge(imported, at(F.lit(1), F.col("rank"), F.lit(0)), named("file", F.col("from")), named("file", F.col("to")), "imports")
    top = functions.where(F.col("rank") <= most(AUTO_FUNCTIONS)).join(f.select(*own, path.alias("file")), [*own, "file"], "left_semi")
    dot = F.instr("name", ".")
    owned = (dot > 1) & ~name.startswith("(") & ~name.startswith("<")
    top = top.withColumn("cls", F.when(owned, F.substring_index("name", ".", 1)))
    classes = first_rows(top.where("cls is not null").groupBy(*own, "file", "cls").agg(F.min("rank").alias("first")), most(AUTO_CLASSES), "first").drop("rank")
    file, class_id = F.col("file"), F.concat(F.lit("class:"), "file", F.lit(":"), "cls")
    class_nodes = node(classes, at(F.lit(2), F.col("first"), F.lit(0)), class_id, F.col("cls"), "class", top_folder("file"), file)
    class_edges = edge(classes, at(F.lit(2), F.col("first"), F.lit(0)), named("file", file), class_id, "declares")
    fn_id = F.concat(F.lit("fn:"), "file", F.lit("#"), "name", F.lit("@"), F.col("line").cast("string"))
    short = F.when(dot > 1, F.expr("substring(name, instr(name, '.') + 1)")).otherwise(name)
    fn_nodes = node(top, at(F.lit(2), F.col("rank"), F.lit(1)), fn_id, short, "function", top_folder("file"), F.concat("file", F.lit(":"), F.col("line").cast("string")))
    parented = top.join(classes.select(*own, "file", "cls", F.lit(True).alias("has")), [*own, "file", "cls"], "left")
    fn_edges = edge(parented, at(F.lit(2), F.col("rank"), F.lit(1)), F.when(F.col("has"), class_id).otherwise(named("file", file)), fn_id, "defines")
    t = tables.where(F.col("rank") <= most(AUTO_TABLES))
    table_nodes = node(t, at(F.lit(3), F.col("rank"), F.lit(0)), named("table", name), name, "table", F.lit("database"), file)
    table_edges = edge(t, at(F.lit(3), F.col("rank"), F.lit(0)), named("file", file), named("table", name), "defines")
    ends = relations.select(*own, "rank", "file", F.posexplode(F.array("to", "from")).alias("k", "name"))
    end_nodes = node(ends, at(F.lit(4), F.col("rank"), F.col("k")), named("table", name), name, "table", F.lit("database"), file)
    relation_edges = edge(relations, at(F.lit(4), F.col("rank"), F.lit(0)), named("table", F.col("from")), named("table", F.col("to")), "references")
    every = file_nodes.unionByName(class_nodes).unionByName(fn_nodes).unionByName(table_nodes).unionByName(end_nodes)
    nodes = every.groupBy(*own, "id").agg(F.min(F.struct("at", "label", "type", "community", "source")).alias("n")).select(*own, "id", "n.*")
    nodes = written(first_rows(nodes, 1 << 30, "at"), "graph-nodes").withColumn("ord", F.col("rank") - 1)
    links = import_edges.unionByName(class_edges).unionByName(fn_edges).unionByName(table_edges).unionByName(relation_edges)
    links = edges_between(links.groupBy(*own, "from", "to", "relation").agg(F.min("at").alias("at")), nodes)
    links = written(first_rows(links, most(AUTO_EDGES), "at"), "graph-edges").withColumn("ord", F.col("rank") - 1)
    where = F.lit("auto-generated from code structure").alias("path")
    shown = nodes.select(*own, where, "ord", "id", "label", "type", F.col("community"), "source", F.lit(0.0).alias("given_degree"))
    return normalized(shown, links.select(*own, where, "ord", "from", "to", "relation", F.lit("EXTRACTED").alias("confidence")))
