"""Toxicity scores from character n-grams whose features are scaled by naive Bayes log-count ratios.

A linear classifier after Wang and Manning, "Baselines and Bigrams" (2012): the presence of each hashed character n-gram
counts as the log ratio of its smoothed rates in toxic and other labelled texts, and a logistic regression over those
scaled features gives the score. Features are all buckets whose presence tells more of the label than ``EVIDENCE``, however
many they are. Learning takes at most ``SAMPLE`` labelled rows, chosen by a hash of doc_id; executors turn them into
counts and indices, so the driver sees arrays whose size doesn't depend on the data: 1 MB a label, and for each row of the
sample the features it has. Scoring reads every whole text once, in Python tasks over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import chunks, written

#: The most labelled rows that learning takes.
SAMPLE = 12_000
ORDERS = (3, 4, 5)
BITS = 18
#: What twice a feature's log-likelihood ratio has to exceed: chance gives one n-gram in 5,000 that much.
EVIDENCE = 14.0
THRESHOLD = 0.3
PENALTY = 1e-3
_TASKS = 12


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all character n-grams of a batch of texts in lower case, and the text that each belongs to.

    A text begins and ends with a space. Null counts as empty.
    """
    lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    joined = " " + "  ".join(lowered.to_pylist()) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where((codes >= 9) & (codes <= 13), np.uint32(32), codes)
    ends = np.cumsum(pc.utf8_length(lowered).to_numpy(zero_copy_only=False).astype(np.int64) + 2)
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    found, whose = [], []
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h = (h ^ codes[k : k + m]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        inside = owner[:m] == owner[n - 1 :]
        found.append((h * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS))[inside])
        whose.append(owner[:m][inside])
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(whose)


def _present(texts: pa.Array, index: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs; with an index from buckets to features, those of its features alone."""
    bucket, owner = grams(texts)
    if index is not None:
        bucket = index[bucket]
        hit = bucket >= 0
        bucket, owner = bucket[hit], owner[hit]
    pair = np.unique(owner.astype(np.int64) << BITS | bucket.astype(np.int64))
    return pair >> BITS, pair & ((1 << BITS) - 1)


@dataclass
class Model:
    index: np.ndarray  # of a bucket, -1 if it is no feature
    weight: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        """Between 0 and 1, higher where label 1 is likelier."""
        owner, feature = _present(texts, self.index)
        z = self.bias + np.bincount(owner, self.weight[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, rows: int, label: str) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents, by a hash of doc_id."""
    known = labels.where(f"doc_id is not null and {label} in (0, 1)").groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = F.broadcast(written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "labelled"))  # bounded by ``rows``
    one = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y"))
    return written(one.repartition(_TASKS, "doc_id"), "training")


def _logistic(row: np.ndarray, column: np.ndarray, value: np.ndarray, width: int, y: np.ndarray, penalty: float = PENALTY, steps: int = 200, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression over a sparse matrix, by Adam steps over all rows, at a rate that falls to nothing.

    Entries come sorted by row; every column has one.
    """
    share = np.clip(y.mean(), 1 / (len(y) + 2), 1 - 1 / (len(y) + 2))
    bias = np.log(share / (1 - share))
    if not width:
        return np.zeros(0), float(bias)
    w = np.append(np.zeros(width), bias)  # the last is the bias
    first, second = np.zeros_like(w), np.zeros_like(w)
    rows, row_starts = np.unique(row, return_index=True)
    order = np.argsort(column, kind="stable")
    column_starts = np.searchsorted(column[order], np.arange(width))
    by_row = value.astype(np.float32)
    by_column, row_of = by_row[order], row[order]
    z = np.zeros(len(y))
    for k in range(1, steps + 1):
        z[:] = w[-1]
        z[rows] += np.add.reduceat(by_row * w[:-1].astype(np.float32)[column], row_starts)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        slope = np.append(np.add.reduceat(by_column * error.astype(np.float32)[row_of], column_starts) + penalty * w[:-1], error.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        w -= rate * (1 - k / steps) * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return w[:-1], float(w[-1])


def _evidence(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Twice the log-likelihood ratio of each n-gram's presence against the label; 0 for the rarest and the commonest."""
    here, total = counts.sum(axis=0), sizes.sum()
    expected = here * (sizes / total)[:, None]
    parts = np.where(counts > 0, counts * np.log(np.maximum(counts, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return np.where((here < 3) | (here > 0.98 * total), 0.0, 2 * parts.sum(axis=0))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, label: str = "toxic") -> Model:
    """Learn from the documents that ``labels`` (doc_id, 0 or 1 in ``label``) marks; rows without a label are left out.

    A doc_id with several labels has the largest. Without any labelled row every score is 0.5; with one class alone no
    n-gram tells anything, and all texts have the same score, near its label.
    """
    sample = _sample(docs, labels, rows, label)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
        for batch in chunks(batches, "text", 1 << 18):
            y = batch.column("y").to_numpy()
            owner, bucket = _present(batch.column("text"))
            for k in (0, 1):
                sums[k] += np.bincount(bucket[y[owner] == k], minlength=1 << BITS).astype(np.int32)
                sizes[k] += (y == k).sum()
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(sizes), pa.array([x.tobytes() for x in sums], pa.binary())], ["y", "n", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py(), np.int32) for x in table["counts"]], axis=0, dtype=np.int32)
        return pa.table({"y": table["y"][:1], "n": pa.array([pc.sum(table["n"]).as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    counted = sample.mapInArrow(count, "y int, n long, counts binary").groupBy("y").applyInArrow(add, "y int, n long, counts binary")
    counts, sizes = np.zeros((2, 1 << BITS)), np.zeros(2)
    for r in counted.collect():  # two rows of 1 MB
        counts[r.y] += np.frombuffer(r.counts, np.int32)
        sizes[r.y] += r.n
    if not sizes.sum():
        return Model(np.full(1 << BITS, -1, np.int64), np.zeros(0), 0.0)
    rates = (counts + 1) / (counts + 1).sum(axis=1, keepdims=True)
    ratio = np.log(rates[1] / rates[0])
    evidence = _evidence(counts, sizes)
    best = np.flatnonzero(evidence > EVIDENCE)
    index = np.full(1 << BITS, -1, np.int64)
    index[best] = np.arange(len(best))

    def indices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 18):
            owner, feature = _present(batch.column("text"), index)
            at = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(feature.astype(np.int32)))], ["doc_id", "y", "f"])

    table = sample.mapInArrow(indices, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, y int, f array<int>").orderBy("doc_id").toArrow()
    lists = table["f"].combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    columns = lists.flatten().to_numpy(zero_copy_only=False)
    y = table["y"].to_numpy().astype(float)
    r = ratio[best]
    w, b = _logistic(np.repeat(np.arange(len(y)), lengths), columns, r[columns], len(r), y)
    return Model(index, w * r, b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; a null text counts as empty and scores as one without any feature."""
    handed = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB for the buckets and at most as much again for weights, fixed by BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 18):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(handed.value.score(batch.column("text")))], ["doc_id", "score"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")


def held_out(id_col: str = "doc_id"):
    """Rows that learning never sees: crc32 of the id as text leaves 2 when divided by 4. A null id is held out too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """Score every document by a model learnt from the labelled rows that aren't held out.

    Returns doc_id, held_out, score and predicted (1 if score >= 0.3, else 0), a row for each row of ``docs``, repeated
    ids included. Other columns are neither inputs nor outputs. Empty tables give an empty result.
    """
    model = fit(docs, labels.where(~held_out()), rows)
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pipeline's stage: documents that the classifier doesn't reject, with all their columns, in one pass.

    Without labels of both classes, or n-grams that tell them apart, all texts have one score; then all documents stay.
    """
    model = fit(docs, labels.where(~held_out()))
    if not len(model.weight):
        return docs
    handed = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 18):
            yield batch.filter(pa.array(handed.value.score(batch.column("text")) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
