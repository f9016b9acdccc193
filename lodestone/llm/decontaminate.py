"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash containment search.

For the containment |Q n X| / |Q| of a short item Q in a long document X, signatures of both sides are useless: almost
every minimum of X lies outside Q. So only the items are sketched (as in containment MinHash, Koslicki and Zabeti 2019):
an item's sketch holds the shingles of its smallest hash values, and a document is a candidate for an item if it holds
any of them. Items are partitioned by the size of their shingle sets, and each partition's sketch is as long as its
largest possible item needs: an item contained to the threshold t lacks at most (1 - t) n of its n shingles, so one of
floor((1 - t) n) + 1 sketched ones is always found. Of a shorter item of the partition, whose sketch is longer than that,
more have to be found, and a document with fewer is no candidate. No contained item can be missed. Candidates are
verified, partition by partition, on the exact shingle strings of both texts.

Everything is DataFrame functions. The words of a document are hashed once, the hashes of its shingles are made of those,
exploded and joined with the sketches; nothing is compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import free_name, odd_ids, small, written

WIDTH = 5
THRESHOLD = 0.75
#: Bytes of sketches (40 an entry) up to which they are broadcast.
BROADCAST_SKETCH = 64 << 20


def words(text: Column) -> Column:
    """The words of a text in lower case; an empty array for null or a text without words."""
    trimmed = F.btrim(F.lower(text), F.lit("\t\n\x0b\x0c\r "))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def _starts(w: Column, width: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0)))


def shingle_hashes(w: Column, width: int = WIDTH) -> Column:
    """A 64-bit hash of every shingle of a word array; with fewer words than ``width``, of the whole sequence."""
    h = F.transform(w, lambda x: F.xxhash64(x))
    return combined(h, width)


def combined(h: Column, width: int = WIDTH) -> Column:
    """Hashes of shingles from those of the words."""
    long = F.transform(_starts(h, width), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width))))
    return F.when(F.size(h) >= width, long).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))


def shingles(w: Column, width: int = WIDTH) -> Column:
    """The shingles themselves, as strings."""
    long = F.transform(_starts(w, width), lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(width))))
    return F.when(F.size(w) >= width, long).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(hash, item_id, size_class, needed): the MinHash sketch of every item, as long as its size partition asks for.

    ``items`` has item_id and w, its words. A text that contains the item to the threshold holds ``needed`` of its
    sketch's hashes at least.
    """
    hashed = items.select("item_id", F.array_sort(F.array_distinct(shingle_hashes(F.col("w")))).alias("h")).where(F.size("h") > 0)
    size_class = F.floor(F.log2(F.size("h"))).cast("int")
    largest = F.pow(F.lit(2), F.col("size_class") + 1) - 1
    keep = F.floor(F.lit(1 - threshold) * largest + 1e-9) + 1
    lacking = F.floor(F.lit(1 - threshold) * F.size("h") + 1e-9)
    cut = hashed.withColumns({"size_class": size_class, "lacking": lacking}).withColumn("h", F.slice("h", F.lit(1), F.least(keep, F.size("h")).cast("int")))
    return cut.select("item_id", "size_class", (F.size("h") - F.col("lacking")).cast("int").alias("needed"), F.explode("h").alias("hash"))


def contained(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The items that documents contain: doc_id, item_id, n_item_shingles, n_found, containment (at least ``threshold``).

    Shingles are five words in lower case; a text with fewer words is one shingle, so an item of under five words is
    found only in documents that consist of just those words. Null and empty texts contain nothing and are contained in
    nothing. Null ids are matched like any other. Rows that repeat a document's or an item's id count as one whose best
    text decides. Empty tables give an empty result. Columns other than the ids and texts are not read.
    """
    items = written(benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text)).alias("w")).distinct(), "items")
    sketch = written(sketches(items, threshold).distinct(), "sketches")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # words and their hashes are columns of their own, so that the lambdas over them don't make them again
    hashed = texts.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    probes = hashed.select("doc_id", F.explode(combined(F.col("h"))).alias("hash"))
    # the sketches' partitions are probed together, but counted and verified each by its own measure
    hits = probes.join(small(sketch, BROADCAST_SKETCH), "hash").groupBy("size_class", "doc_id", "item_id").agg(F.count_distinct("hash").alias("n"), F.min("needed").alias("needed"))
    candidates = written(hits.where("n >= needed").select("size_class", "doc_id", "item_id"), "candidates")

    ids = small(written(candidates.select("doc_id").distinct(), "candidate-ids"))
    hit = texts.join(ids, texts.doc_id.eqNullSafe(ids.doc_id), "left_semi")
    full = hit.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.array_distinct(shingles(F.col("w"))).alias("x")).alias("f")
    parts = items.select("item_id", F.array_distinct(shingles(F.col("w"))).alias("q")).where(F.size("q") > 0).withColumn("size_class", F.floor(F.log2(F.size("q"))).cast("int"))
    c, i = candidates.alias("c"), parts.alias("i")
    pairs = c.join(i, (F.col("c.size_class") == F.col("i.size_class")) & F.col("c.item_id").eqNullSafe(F.col("i.item_id"))).select("c.doc_id", "c.item_id", "i.q")
    p = pairs.alias("p")
    both = p.join(full, F.col("p.doc_id").eqNullSafe(F.col("f.doc_id")))
    counted = both.select("p.doc_id", "p.item_id", F.size("q").cast("long").alias("n_item_shingles"), F.size(F.array_intersect("q", "x")).cast("long").alias("n_found"))
    scored = counted.withColumn("containment", F.col("n_found") / F.col("n_item_shingles")).where(F.col("n_found") >= F.lit(threshold) * F.col("n_item_shingles"))
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_found", "n_item_shingles")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_item_shingles", "b.n_found", "b.containment")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The pipeline's stage: documents that contain no item, with all their columns.

    Rows with null or repeated doc_ids are judged each by its own text.
    """
    if not odd_ids(docs):
        gone = small(written(contained(docs, benchmark).select("doc_id").distinct(), "contaminated"))
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # ids alone don't tell rows apart: the text's digest has to as well
    key = free_name(docs, "id_and_digest")
    keyed = docs.withColumn(key, F.struct("doc_id", F.sha2(F.encode(F.coalesce("text", F.lit("")), "utf-8"), 256).alias("digest")))
    gone = small(written(contained(keyed, benchmark, id_col=key).select("doc_id").distinct(), "contaminated"))
    return keyed.join(gone, keyed[key].eqNullSafe(gone.doc_id), "left_anti").drop(key)
