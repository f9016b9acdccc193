"""Exact deduplication of a batch of documents against an immutable snapshot.

The distinct digests of a snapshot are spread over shards, and every shard gets a static 3-wise binary fuse filter of
one byte a key (Graf and Lemire, "Binary Fuse Filters", 2022). Digests of a new batch are first grouped among themselves
(partial aggregation, so that a digest which holds a third of all rows is one row in the shuffle), then screened shard by
shard. What a filter lets pass is joined with the snapshot's exact buckets, and the bytes of both sides are compared;
what it refuses is certainly new and is never joined.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, chunks, free_name, odd_ids, small, written
from lodestone.llm.shingles import mix, text_bytes

#: Digests of a shard, the snapshot's or the batch's, whichever are more: a filter has at most about 75 kB.
SHARD_KEYS = 1 << 16


class BinaryFuse8:
    """A static set of 64-bit keys: no false negatives, about 1/256 false positives, 9 to 10 bits a key."""

    def __init__(self, seed: int, segment: int, count: int, table: np.ndarray):
        self.seed, self.segment, self.count, self.table = seed, segment, count, table

    @staticmethod
    def _slots(hashes: np.ndarray, segment: int, count: int) -> np.ndarray:
        mask = np.uint64(segment - 1)
        first = ((hashes >> np.uint64(32)) * np.uint64(segment * count)) >> np.uint64(32)
        second = (first + np.uint64(segment)) ^ ((hashes >> np.uint64(18)) & mask)
        return np.stack([first, second, (first + np.uint64(2 * segment)) ^ (hashes & mask)]).astype(np.int64)

    @staticmethod
    def _print(hashes: np.ndarray) -> np.ndarray:
        return (hashes ^ (hashes >> np.uint64(32))).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse8:
        keys = np.unique(keys.astype(np.uint64))
        n = max(len(keys), 2)
        segment = 1 << max(2, min(18, math.floor(math.log(n) / math.log(3.33) + 2.25)))
        size = round(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)))
        count = max(1, -(-size // segment) - 2)
        for seed in range(1, 200):
            hashes = mix(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
            slots = cls._slots(hashes, segment, count)
            total = (count + 2) * segment
            degree = np.bincount(slots.ravel(), minlength=total)
            owner = np.zeros(total, np.int64)  # the sum of the keys at each slot: at degree 1 it is the key
            for row in slots:
                np.add.at(owner, row, np.arange(len(keys)))
            peeled, left = [], len(keys)
            front = np.flatnonzero(degree == 1)
            while len(front):
                who, at = np.unique(owner[front], return_index=True)
                peeled.append((who, front[at]))
                left -= len(who)
                gone = slots[:, who]
                np.subtract.at(degree, gone.ravel(), 1)
                np.subtract.at(owner, gone.ravel(), np.tile(who, 3))
                touched = np.unique(gone)
                front = touched[degree[touched] == 1]
            if left:
                continue  # a cycle of keys is left over: another seed
            table = np.zeros(total, np.uint8)
            for who, at in reversed(peeled):  # all three slots of a key, without its own, are settled by then
                table[at] = cls._print(hashes[who]) ^ np.bitwise_xor.reduce(table[slots[:, who]], axis=0)
            return cls(seed, segment, count, table)
        raise ArithmeticError("no seed gives a filter for these keys")

    def holds(self, keys: np.ndarray) -> np.ndarray:
        hashes = mix(keys.astype(np.uint64) + np.uint64(self.seed) * np.uint64(0x9E3779B97F4A7C15))
        return self._print(hashes) == np.bitwise_xor.reduce(self.table[self._slots(hashes, self.segment, self.count)], axis=0)


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, digest binary[, body binary]): SHA-256 of each text in UTF-8 after A-Z are lower-cased; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, at = text_bytes(batch.column("text"))
            data = data.tobytes()
            bodies = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            columns = [batch.column("doc_id"), pa.array([hashlib.sha256(x).digest() for x in bodies], pa.binary())]
            if keep_text:
                columns.append(pa.array(bodies, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "body"][: len(columns)])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {_kind(source, 'doc_id')}, digest binary" + ", body binary" * keep_text)


def buckets(found: DataFrame) -> DataFrame:
    """One row for each digest: the largest doc_id and the number of rows, summed up before the shuffle."""
    return found.groupBy("digest").agg(F.max("doc_id").alias("last_id"), F.count("*").alias("n"))


def _keyed(groups: DataFrame, shards: int) -> DataFrame:
    key = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    return groups.select("digest", key.alias("key"), F.pmod(key, F.lit(shards)).cast("int").alias("shard"))


def build_filters(groups: DataFrame, shards: int) -> DataFrame:
    """One binary fuse filter for each shard of a snapshot's distinct digests."""

    def build(table: pa.Table) -> pa.Table:
        f = BinaryFuse8.build(table["key"].to_numpy())
        return pa.table({"shard": table["shard"][:1].cast(pa.int32()), "seed": pa.array([f.seed], pa.int32()), "segment": pa.array([f.segment], pa.int32()), "count": pa.array([f.count], pa.int32()), "prints": pa.array([f.table.tobytes()], pa.binary())})

    return _keyed(groups, shards).select("shard", "key").groupBy("shard").applyInArrow(build, "shard int, seed int, segment int, count int, prints binary")


def screen(groups: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The digests of a batch that a snapshot's filters let pass; the others are certainly not in it."""

    def test(new: pa.Table, known: pa.Table) -> pa.Table:
        if not known.num_rows:
            return new.select(["digest"]).slice(0, 0)
        row = known.to_pylist()[0]
        f = BinaryFuse8(row["seed"], row["segment"], row["count"], np.frombuffer(row["prints"], np.uint8))
        return new.select(["digest"]).filter(pa.array(f.holds(new["key"].to_numpy())))

    return _keyed(groups, shards).groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(test, "digest binary")


def dedup(snapshot: DataFrame, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Group the documents of a snapshot and of a new batch by equal text.

    Returns a row for each row of both: doc_id, keep_id (the largest doc_id of its group), group_size, kept
    (doc_id = keep_id) and text_sha256. Texts are equal if they are identical after A-Z are lower-cased. A null text is
    an empty one, and empty texts are equal to each other. A null doc_id is smaller than any other; in a group that has
    no other, keep_id is null and the rows count as kept. Repeated rows with the group's largest doc_id are all marked
    kept. Other columns, whatever their names, are not read. An empty snapshot or batch gives the other's groups.
    """
    known, new = (written(digests(x, id_col, text_col), f"digests-{k}") for k, x in enumerate((snapshot, batch)))
    old_groups, new_groups = written(buckets(known), "snapshot"), written(buckets(new), "batch")
    shards = max(1, math.ceil(max(old_groups.count(), new_groups.count()) / shard_keys))
    passed = screen(new_groups, build_filters(old_groups, shards), shards)
    o, n = old_groups.alias("o"), new_groups.alias("n")
    hits = written(
        passed.join(n, "digest").join(o, "digest").select("digest", F.col("o.last_id").alias("old_id"), F.col("n.last_id").alias("new_id"), (F.col("o.n") + F.col("n.n")).alias("n")),
        "hits",
    )

    def bodies(docs: DataFrame, which: str) -> DataFrame:
        """The normalised bytes of one text for each hit, from the rows whose ids are asked for."""
        ids = small(written(hits.select(F.col(which).alias("doc_id")).distinct(), "ids"))
        x = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        x = x.join(ids, x.doc_id.eqNullSafe(ids.doc_id), "left_semi")
        return digests(x, keep_text=True).groupBy("digest").agg(F.first("body").alias(f"{which}_body"))

    same = hits.join(bodies(snapshot, "old_id"), "digest").join(bodies(batch, "new_id"), "digest").where("old_id_body = new_id_body")
    both = written(same.select("digest", F.greatest("old_id", "new_id").alias("keep_id"), F.col("n").alias("group_size")), "both")

    def groups(own: DataFrame) -> DataFrame:
        """Groups of one side, as they are after the merge; groups of one row need no entry."""
        merged = own.join(both, "digest", "left")
        return merged.select("digest", F.coalesce("keep_id", "last_id").alias("keep_id"), F.coalesce("group_size", "n").alias("group_size")).where("group_size > 1")

    # the groups are a table of their own, so that Spark can split the rows of a digest that very many have
    sides = [rows.join(written(groups(own), "groups"), "digest", "left") for rows, own in ((known, old_groups), (new, new_groups))]
    out = sides[0].unionByName(sides[1])
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def halves(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Split one table as if it had come in two deliveries: by a hash of the id, null in the first."""
    late = F.coalesce(F.pmod(F.xxhash64(F.col(id_col)), F.lit(2)) == 1, F.lit(False))
    return docs.where(~late), docs.where(late)


def keep_last(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: of equal texts the row with the largest doc_id stays, with all its columns.

    Of repeated rows (same doc_id, same text) one stays. Rows whose doc_id is null stay only if no row of the group
    has one; then one of them does. Extra columns are kept as they are, whatever their names.
    """
    result = written(dedup(*halves(docs)), "exact")
    dropped = result.where(~F.col("kept"))
    if not odd_ids(result):
        ids = small(written(dropped.select("doc_id"), "dropped"))
        return docs.join(ids, "doc_id", "left_anti").select(*docs.columns)
    # ids that occur more than once don't tell rows apart: the digest has to as well
    gone = small(written(dropped.select(F.col("doc_id").alias("id"), "text_sha256").distinct(), "dropped"))
    sha = free_name(docs, "text_sha")
    keyed = docs.withColumn(sha, F.sha2(F.encode(ascii_lower("text"), "utf-8"), 256))
    left = keyed.join(gone, keyed.doc_id.eqNullSafe(gone.id) & (keyed[sha] == gone.text_sha256), "left_anti")
    return left.dropDuplicates(["doc_id", sha]).drop(sha)
