"""Near-duplicate groups by min-max hashing, with every link confirmed on full shingle sets.

Min-max hashing (Ji et al., "Min-Max Hash for Jaccard Similarity", 2013) keeps the smallest and the largest value under
every permutation, so 96 permutations give 192 signature values, each of which two sets share with probability J.
They are banded by four into 48 bands: sets with J = 0.75 miss each other with probability (1 - 0.75^4)^48 = 1.2e-8.

Identical sets become one representative first. Buckets are never expanded into all their pairs:

1. Every representative is compared, by sketches, with four pivots of each of its buckets, and linked with the most
   alike if their full sets confirm it; twice more with other pivots, between components. Large groups of copies
   collapse here, in linear work.
2. Every representative is linked with the most alike member of another component in its buckets, likewise.
3. Pairs that still are in different components and whose sketches don't rule out the threshold are all confirmed.

A sketch holds a bit of each signature value and an odd sketch of the whole set (Mitzenmacher et al., "Efficient
Estimation for High Similarities using Odd Sketches", 2014), which tells 0.75 from 0.65 for sets of up to some 3,000
shingles. A pair is not confirmed if the sketches rule it out: surely, by more odd cells than sets at the threshold
differ in shingles, or with ``SLACK`` standard deviations.

Steps 2 and 3 look only into buckets that hold several components. Such a bucket is cut by the sets' sizes into classes
of the ratio 3/4, and only rows of one class or of neighbouring ones meet, in tiles of about ``TILE`` x ``TILE`` rows, so
no task ever holds a bucket. Components come from alternating large-star and small-star steps (Kiveris et al., 2014) over
tables in the shared folder. Of many rows, whatever is summed up by bucket or node is written before it is joined with
the rows of that bucket or node, so that Spark can split those of a hot one.

A representative is numbered when its table is written: doc_ids play no part in the links, so that null and repeated
ones do no harm; a component gets its smallest doc_id in the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, chunks, free_name, odd_ids, small, splittable, written
from lodestone.llm.shingles import mix, shingle_sets

THRESHOLD = 0.75
PERMUTATIONS = 96
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
WORDS = 2 * PERMUTATIONS // 64
PIVOTS = 4
#: Times that pivots are tried; what is still apart after them goes to the tiles.
TURNS = 3
TILE = 256
#: Longs of the odd sketch, one bit for each parity.
ODD = 16
#: Standard deviations by which a sketch may fall short of the threshold: one in 1e7 pairs at the threshold does.
SLACK = 5.2


def _keys() -> np.ndarray:
    """Odd multipliers of the permutations, from a rule."""
    return mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)


def signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each nonempty set under each permutation: two signature values for one hash evaluation."""
    out = np.empty((len(starts), 2 * PERMUTATIONS), np.uint64)
    for k, key in enumerate(_keys()):
        # multiplying by an odd number permutes; the high bits of the product depend on all bits of the value
        hashed = values * key
        out[:, k] = np.minimum.reduceat(hashed, starts)
        out[:, PERMUTATIONS + k] = np.maximum.reduceat(hashed, starts)
    return out


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print, n_shingles, set_a, set_b, bands, sketch): a hash of the text, two of its set, band keys and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            values, at = shingle_sets(batch.column("text"))
            size = np.diff(at)
            full = np.flatnonzero(size)
            n = len(size)
            whole = np.zeros((2, n), np.uint64)
            bands, sketch = np.zeros((n, BANDS), np.uint64), np.zeros((n, WORDS + ODD), np.uint64)
            if len(full):
                starts = at[:-1][full]
                for k in range(2):
                    whole[k, full] = np.add.reduceat(mix(values + np.uint64(k * 0x1234567 + 11)), starts)
                sig = signatures(values, starts)
                key = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64)), (len(full), BANDS)).copy()
                for r in range(ROWS):
                    key = mix(key * np.uint64(3) + sig[:, r * BANDS : (r + 1) * BANDS])
                bands[full] = key
                bits = (mix(sig) & np.uint64(1)).reshape(len(full), WORDS, 64)
                sketch[full, :WORDS] = (bits << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
                cell = (values >> np.uint64(20)).astype(np.int64) % (64 * ODD) + np.repeat(np.arange(n), size) * (64 * ODD)
                odd = (np.bincount(cell, minlength=n * 64 * ODD) & 1).astype(np.uint8)
                sketch[:, WORDS:] = np.packbits(odd, bitorder="little").view(np.uint64).reshape(n, ODD)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, n * w + 1, w), pa.int32()), pa.array(x.ravel().view(np.int64))) for x, w in ((bands, BANDS), (sketch, WORDS + ODD))]
            columns = [batch.column("doc_id"), batch.column("print"), pa.array(size), *(pa.array(x.view(np.int64)) for x in whole), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "n_shingles", "set_a", "set_b", "bands", "sketch"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_print(text_col).alias("print"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, print long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>")


def text_print(text_col: str = "text") -> Column:
    """A hash that tells the texts of one doc_id apart."""
    return F.xxhash64(F.col(text_col).cast("string"))


def full_sets(texts: DataFrame) -> DataFrame:
    """(rep, shingles) of (rep, text): the sorted 64-bit hashes of a text's distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            values, at = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))], ["rep", "shingles"])

    return texts.select("rep", "text").mapInArrow(run, "rep long, shingles array<long>")


def _different(a: str, b: str, start: int, end: int) -> Column:
    """Bits in which some longs of two sketches differ."""
    return sum((F.bit_count(F.col(f"{a}.sketch")[k].bitwiseXOR(F.col(f"{b}.sketch")[k])) for k in range(start, end)), F.lit(0))


def _agreement(a: str, b: str) -> Column:
    """How alike two sketches are: equal bits of the signature part, and of the odd part."""
    return F.lit(64 * (WORDS + ODD)) - _different(a, b, 0, WORDS + ODD)


def _most(threshold: float) -> int:
    """Bits in which the signatures of sets at the threshold differ, and the slack."""
    p = (1 - threshold) / 2
    return math.ceil(64 * WORDS * p + SLACK * math.sqrt(64 * WORDS * p * (1 - p)))


def _plausible(a: str, b: str, threshold: float) -> Column:
    """Sizes and sketches that don't rule the threshold out."""
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    # sets at the threshold differ in d shingles, and an odd sketch never differs in more cells; d balls fall into cells
    d, cells = (x + y) * ((1 - threshold) / (1 + threshold)), 64 * ODD
    once, twice = F.exp(d * math.log(1 - 2 / cells)), F.exp(d * math.log(1 - 4 / cells))
    mean = cells / 2 * (1 - once)
    spread = F.sqrt(F.greatest(cells / 4 * (1 - twice) + cells * cells / 4 * (twice - once * once), F.lit(0.0)))
    sizes = F.least(x, y) >= F.lit(threshold) * F.greatest(x, y)
    odd = _different(a, b, WORDS, WORDS + ODD)
    return sizes & (_different(a, b, 0, WORDS) <= _most(threshold)) & (odd <= d + 1e-6) & (odd <= mean + SLACK * spread + 1)


def confirm(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    first, second = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b").join(first, "a").join(second, "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("total"))
    percent = round(100 * threshold)
    return both.where(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches; roots themselves are not listed.

    Alternates large-star and small-star steps until the links are a forest of stars.
    """

    def lowest(edges: DataFrame) -> DataFrame:
        return splittable(edges.groupBy("u").agg(F.min("v").alias("m")), rows, "lowest")

    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    rows = 2 * edges.count()
    while True:
        # stars: a node below another one is below no third, and above none
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("below")), F.struct(F.col("v").alias("node"), F.lit(0).alias("below")))).alias("e"))
        if ends.groupBy("e.node").agg(F.sum("e.below").alias("below"), F.count("*").alias("n")).where("below > 0 and n > 1").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(lowest(both).select("u", F.least("u", "m").alias("m")), "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large, "large-star")
        low = lowest(large)
        star = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = written(star, "small-star")


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after further links between the nodes of written components ``roots``, or nodes that aren't in them.

    Only the links between roots are followed, so that a few late links cost little however large the components are.
    """
    a, b = (roots.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root")) for k in ("a", "b"))
    ends = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    upper = components(ends)
    moved = roots.join(upper.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return written(moved.select("node", F.coalesce("top", "root").alias("root")).unionByName(upper), "roots")


def _rooted(members: DataFrame, roots: DataFrame, rows: int) -> DataFrame:
    """Members of buckets that hold several components, each with its component."""
    x = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("root", "rep")).drop("root")
    mixed = x.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("key")
    return x.join(splittable(mixed, rows, "mixed"), "key")


def _across(rooted: DataFrame, threshold: float) -> DataFrame:
    """Plausible pairs of different components in one bucket, tile by tile: (a, b, agreement), a < b.

    Sets that reach the threshold are of one size class or of neighbouring ones. Of a pair of classes (c, c + 1) both are
    cut into blocks by a hash, and every block of the one meets every block of the other; of (c, c) each unordered pair.
    """
    x = rooted.withColumn("class", F.floor(F.log(F.col("size") + 0.5) / math.log(1 / threshold)).cast("int"))
    rows = rooted.count()
    counts = splittable(x.groupBy("key", "class").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks")), rows, "classes")
    above = counts.select("key", (F.col("class") - 1).alias("class"), F.col("blocks").alias("above"))
    below = counts.select("key", (F.col("class") + 1).alias("class"), F.col("blocks").alias("below"))
    sized = splittable(counts.join(above, ["key", "class"], "left").join(below, ["key", "class"], "left").na.fill(0), rows, "class-blocks")
    x = x.join(sized, ["key", "class"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    tile = lambda low, i, j: F.struct(low.alias("low"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # tile (2 c, i, j), i <= j, is of class c alone; (2 c + 1, i, j) has block i of class c on the left, j of class c + 1 on the right
    own = F.col("class") * 2
    left = F.concat(F.transform(F.sequence("block", F.col("blocks") - 1), lambda j: tile(own, F.col("block"), j)), F.transform(upto(F.col("above")), lambda j: tile(own + 1, F.col("block"), j)))
    right = F.concat(F.transform(F.sequence(F.lit(0), "block"), lambda i: tile(own, i, F.col("block"))), F.transform(upto(F.col("below")), lambda i: tile(own - 1, i, F.col("block"))))
    a, b = (x.select("key", F.explode(side).alias("t"), "rep", "comp", "size", "sketch").select("key", "t.*", "rep", "comp", "size", "sketch") for side in (left, right))
    a, b = a.alias("a"), b.alias("b")
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.low") == F.col("b.low")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    once = (F.col("a.low") % 2 != 0) | (F.col("a.i") != F.col("a.j")) | (F.col("a.rep") < F.col("b.rep"))
    pairs = a.join(b, same & (F.col("a.comp") != F.col("b.comp")) & once & _plausible("a", "b", threshold))
    return pairs.select(F.least("a.rep", "b.rep").alias("a"), F.greatest("a.rep", "b.rep").alias("b"), _agreement("a", "b").alias("agreement")).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Link documents whose shingle sets have at least this Jaccard similarity, and give each its component.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable, itself included) and kept (doc_id =
    component_id), one row for each row of ``docs``. A set holds the distinct five-word shingles of a text (words split
    at U+0009-U+000D and U+0020, A-Z lower-cased); with fewer words, the whole sequence as one. A null text is an empty
    one; without words a document is linked with nothing and keeps itself. Rows that repeat a doc_id are documents of
    their own, each linked by its own text. A null doc_id is linked like any other, but gives its name to a component
    only if all its doc_ids are null: component_id is null then, and its rows count as kept. Other columns are not read. An
    empty table gives an empty one.
    """
    x = _grouped(docs, id_col, text_col, threshold)
    return x.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(doc_id, print, n_shingles, component_id, root): root tells components apart; it is null for texts without words."""
    described = written(describe(docs, id_col, text_col), "described")
    # identical sets: one representative
    first = described.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct(F.col("doc_id").alias("of"), "print", "bands", "sketch"), F.struct("doc_id", "print")).alias("r"))
    # the number is stored with the table, so that it stays when a task is repeated later on
    reps = written(first.select(F.monotonically_increasing_id().alias("rep"), "doc_id", "set_a", "set_b", F.col("n_shingles").alias("size"), "r.of", "r.print", "r.bands", "r.sketch"), "representatives")
    spread = reps.select("rep", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low != high").select("key")
    shared = splittable(shared, BANDS * reps.count(), "shared")
    keyed = written(spread.join(shared, "key"), "buckets")
    involved = written(keyed.select("rep").distinct(), "involved")
    described_reps = written(reps.select("rep", "size", "sketch", "doc_id", "of", "print").join(small(involved), "rep"), "involved")
    members = written(keyed.join(described_reps.select("rep", "size", "sketch", "doc_id"), "rep"), "members")
    t = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("its", text_print())
    who = small(described_reps.select("rep", "of", "print"))
    sets = full_sets(t.join(who, t.id.eqNullSafe(who.of) & (t.its == who.print)))
    # rows that repeat both id and text have the same set
    sets = written(sets if described.groupBy("doc_id", "print").count().where("count > 1").isEmpty() else sets.dropDuplicates(["rep"]), "sets")

    # of the largest bucket; what is summed up by bucket is large, and stored only where a bucket has to be split
    rows = keyed.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    # 1. the most alike of the pivots, again as long as that finds links, with other pivots and between components only
    roots = None
    for turn in range(TURNS):
        now = members if roots is None else members.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        now = now.withColumn("comp", F.col("rep") if roots is None else F.coalesce("root", "rep"))
        who = F.struct("rep", "size", "sketch", "comp")
        # the smallest doc_id is a pivot in all of its buckets: an original often comes before its copies
        ranks = [F.struct(F.col("doc_id").isNull(), "doc_id", "rep"), *(F.xxhash64(F.lit(turn * PIVOTS + k), "rep") for k in range(1, PIVOTS))]
        pivots = splittable(now.groupBy("key").agg(*(F.min_by(who, rank).alias(f"p{k}") for k, rank in enumerate(ranks))), rows, "pivots")
        tried = now.join(pivots, "key").select("rep", who.alias("a"), F.explode(F.array(*(f"p{k}" for k in range(PIVOTS)))).alias("b"))
        tried = tried.where((F.col("a.comp") != F.col("b.comp")) & _plausible("a", "b", threshold))
        best = tried.groupBy("rep").agg(F.max_by("b.rep", F.struct(_agreement("a", "b"), -F.col("b.rep"))).alias("other"))
        pairs = best.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()
        found = written(confirm(written(pairs, "pivot-pairs"), sets, threshold), "pivot-links")
        if roots is not None and found.isEmpty():
            break
        roots = components(found) if roots is None else merged(roots, found)

    # 2. the most alike member of another component, 3. all that is left between components
    rooted = written(_rooted(members, roots, rows), "rooted")
    if not rooted.isEmpty():
        across = written(_across(rooted, threshold), "across")
        ends = across.select("a", "b", "agreement", F.explode(F.array("a", "b")).alias("rep"))
        best = ends.groupBy("rep").agg(F.max_by(F.struct("a", "b"), F.struct("agreement", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
        tried = written(best, "pairs")
        roots = merged(roots, written(confirm(tried, sets, threshold), "best-links"))
        x, y = (roots.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root")) for k in ("a", "b"))
        left = across.select("a", "b").join(tried, ["a", "b"], "left_anti").join(x, "a", "left").join(y, "b", "left")
        left = written(left.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b"), "left")
        more = written(confirm(left, sets, threshold), "last-links")
        if not more.isEmpty():
            roots = merged(roots, more)

    # components by their smallest doc_id; most sets are alone in theirs
    rooted = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    rooted = written(rooted.select("set_a", "set_b", "size", "doc_id", "root"), "rooted")
    named = splittable(rooted.groupBy("root").agg(F.min("doc_id").alias("component")), rooted.count(), "named")
    of_set = rooted.join(named, "root").select("set_a", "set_b", "size", "root", "component")
    d, r = described.select("doc_id", "print", "n_shingles", "set_a", "set_b").alias("d"), of_set.alias("r")
    joined = d.join(r, (F.col("d.set_a") == F.col("r.set_a")) & (F.col("d.set_b") == F.col("r.set_b")) & (F.col("d.n_shingles") == F.col("r.size")), "left")
    return joined.select("doc_id", "print", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), "root")


def keep_first(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: one document of each group, the one with the smallest doc_id, stays with all its columns.

    Documents without words stay. Null doc_ids come last; of rows of a group with the same smallest doc_id, or with null
    ones alone, the one whose text has the smallest hash stays, once.
    """
    found = written(_grouped(docs, "doc_id", "text", THRESHOLD), "near")
    if not odd_ids(found):
        ids = small(written(found.where("doc_id != component_id").select("doc_id"), "gone"))
        return docs.join(ids, "doc_id", "left_anti").select(*docs.columns)
    # ids alone don't tell rows apart: the text's hash has to as well
    chosen = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "print")).alias("c"))
    chosen = written(chosen.select(F.col("c.doc_id").alias("id"), F.col("c.print").alias("its")), "chosen")
    mark = free_name(docs, "text_print")
    keyed = docs.withColumn(mark, text_print())
    bare = ~F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False))
    rest, ids = keyed.where(~bare), small(chosen)
    left = rest.join(ids, rest.doc_id.eqNullSafe(ids.id) & (rest[mark] == ids.its), "left_semi").dropDuplicates(["doc_id", mark])
    return keyed.where(bare).unionByName(left).drop(mark)
