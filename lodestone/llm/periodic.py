"""Runs of repeating words in texts: stretches with a period that repeats at least four times.

Power-of-two naming (Karp, Miller and Rosenberg): words of a document get names, and the name of the 2**(k+1) words at a
place is that of the pair of names of 2**k words at it and 2**k behind it, so that equal stretches have equal names. A
stretch that occurs once keeps a name of its own and takes no part in later levels.

A stretch of period p and at least max(6, 4p) words has a place i on the grid 0, p, 2p, ... where the words from i and
from i + p agree for more than p words, which one comparison of names tells. Of neighbouring places of the grid that do,
the first is extended to both sides by comparing names from the longest to the shortest. Periods are taken in ascending
order; a stretch that a smaller one has given is that one's.

Documents are independent: a task takes batches of whole texts, names all their words at once (a word is named with its
document, so nothing repeats across documents), and needs 4 bytes a word and level.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import chunks

#: A run has at least LEAST words and TIMES times its period.
LEAST, TIMES = 6, 4



def name_levels(words: np.ndarray, most: int) -> list[np.ndarray]:
    """Names of the 1, 2, 4, ... ``most`` words at every place; equal exactly where the words are. A negative name is unique."""
    n = len(words)
    place = np.arange(n)
    counts = np.bincount(words) if n else np.zeros(0, np.int64)
    name = np.where(counts[words] > 1, words, -1 - place) if n else words
    levels, width = [name.astype(np.int32)], 1
    while 2 * width <= most:
        now = levels[-1]
        at = np.flatnonzero(now[: max(0, n - width)] >= 0)
        at = at[now[at + width] >= 0]
        pairs = now[at].astype(np.int64) << 32 | now[at + width]
        _, found, times = np.unique(pairs, return_inverse=True, return_counts=True)
        name = (-1 - place).astype(np.int32)
        again = times[found] > 1
        name[at[again]] = found[again]
        levels.append(name)
        width *= 2
    return levels


def _extended(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words agree from a and b on, and how many before them; a < b."""
    n = len(levels[0])
    ahead, behind = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        name, width = levels[k], 1 << k
        # the highest level may fit several times, every other once
        todo = np.arange(len(a))
        while len(todo):
            i, j = a[todo] + ahead[todo], b[todo] + ahead[todo]
            same = (j < n) & (name[i] == name[np.minimum(j, n - 1)])
            ahead[todo[same]] += width
            todo = todo[same] if k == len(levels) - 1 else todo[:0]
        todo = np.arange(len(a))
        while len(todo):
            i, j = a[todo] - behind[todo] - width, b[todo] - behind[todo] - width
            same = (i >= 0) & (name[np.maximum(i, 0)] == name[j])
            behind[todo[same]] += width
            todo = todo[same] if k == len(levels) - 1 else todo[:0]
    return ahead, behind


def find_runs(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs of texts laid end to end; text d has the words bounds[d] to bounds[d + 1].

    Equal numbers mean equal words of the same text; texts have different numbers. Longest texts come first.
    """
    sizes = np.diff(bounds)
    longest = int(sizes.max()) if len(sizes) else 0
    top = longest // TIMES
    none = np.zeros(0, np.int64)
    if longest < LEAST:
        return none, none, none
    # how many words each level is needed for: the longest below what a place of the grid must agree in
    levels = name_levels(words, max(LEAST, TIMES * top) - 2 * top + 1)
    starts, lengths, periods = [], [], []
    for p in range(1, top + 1):
        need = max(LEAST, TIMES * p)
        level = (need - 2 * p + 1).bit_length() - 1
        # texts of at least ``need`` words are the first ones
        end = int(bounds[np.searchsorted(-sizes, -need, side="right")])
        name = levels[level][:end]
        grid = name[::p]
        hit = grid[:-1] == grid[1:]
        if not hit.any():
            continue
        first = hit.copy()
        first[1:] &= ~hit[:-1]
        a = np.flatnonzero(first) * p
        ahead, behind = _extended(levels, a, a + p)
        length = ahead + behind + p
        long = length >= need
        starts.append((a - behind)[long])
        lengths.append(length[long])
        periods.append(np.full(int(long.sum()), p, np.int64))
    if not starts:
        return none, none, none
    s, n, p = np.concatenate(starts), np.concatenate(lengths), np.concatenate(periods)
    order = np.lexsort((p, n, s))
    s, n, p = s[order], n[order], p[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (n[1:] != n[:-1])
    s, n, p = s[first], n[first], p[first]
    order = np.lexsort((p, s))
    return s[order], n[order], p[order]


def repeated_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where a text of ``n`` words is made to repeat, and by what period; None for texts that stay as they are.

    One in ten ids (by crc32) has its words from a on replaced by the p words at a, over and over. A null id never has.
    """
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tails: bool = False) -> DataFrame:
    """Runs of every text: doc_id, n_words, runs (array of start, length, period, by start, then period), collapsed.

    ``collapsed`` is the words joined by a space, without those that any run holds behind its first period. With ``tails``
    texts are first changed by ``repeated_tail``. A null text counts as empty; a text without runs has an empty array.
    Repeated rows and ids are taken row by row; other columns aren't read; an empty table gives an empty one.
    """
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            names, texts = batch.column("doc_id").to_pylist(), []
            for doc_id, text in zip(names, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = text.split() if text else []  # at the six white-space bytes of ASCII
                tail = repeated_tail(doc_id, len(words)) if tails else None
                if tail:
                    a, p = tail
                    words[a:] = (words[a : a + p] * (-(-(len(words) - a) // p)))[: len(words) - a]
                texts.append(words)
            order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
            bounds = np.concatenate([[0], np.cumsum([len(texts[k]) for k in order])]).astype(np.int64)
            numbers = np.empty(int(bounds[-1]), np.int64)
            base = 0
            for k, begin, end in zip(order, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                known: dict[bytes, int] = {}
                numbers[begin:end] = [known.setdefault(w, base + len(known)) for w in texts[k]]
                base += len(known)
            s, n, p = find_runs(numbers, bounds)
            covered = np.zeros(len(numbers) + 1, np.int64)
            np.add.at(covered, s + p, 1)
            np.add.at(covered, s + n, -1)
            kept = np.cumsum(covered)[:-1] == 0
            cut = np.searchsorted(s, bounds)
            out: list = [None] * len(texts)
            for d, k in enumerate(order):
                begin, end, low, high = int(bounds[d]), int(bounds[d + 1]), int(cut[d]), int(cut[d + 1])
                words = texts[k]
                if high > low:
                    rows = list(zip((s[low:high] - begin).tolist(), n[low:high].tolist(), p[low:high].tolist(), strict=True))
                    words = [words[i] for i in np.flatnonzero(kept[begin:end]).tolist()]
                else:
                    rows = []
                out[k] = len(texts[k]), [dict(zip(("start", "length", "period"), r, strict=True)) for r in rows], b" ".join(words)
            many, runs, collapsed = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(many, pa.int64()), pa.array(runs, pa.list_(struct)), pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """What a text's runs come to: doc_id, n_runs, the strongest run, and digests of all runs and of the collapsed text.

    The strongest has the greatest length / period, compared exactly as fractions; of equals the first start, then the
    smallest period, which is the order in which ``detect`` lists them.
    """
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    kind = "struct<start: long, length: long, period: long>"
    top = F.aggregate("runs", F.lit(None).cast(kind), lambda b, r: F.when(more(b, r), r).otherwise(b))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    x = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(F.encode(lines, "utf-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * top.length) div top.period")
    return x.select("doc_id", "n_runs", "top.start", "top.length", "top.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
