"""Spelling variants: words of a corpus that differ by one code point, and the frequent form each of them goes back to.

Pairs come from a self-join of the vocabulary in tries (Trie-Join). A trie's nodes are walked from its root down; each
carries its active nodes, those within one edit of it: nodes of its depth that differ in one code point, and nodes one
deeper that have one code point more. A child's active nodes are children, by its own code point, of its parent's, and
those that the edit happens at: its siblings, and its own children. So the distance never exceeds one, and where a word
ends at a node and another at an active node of it, that is a pair.

The vocabulary is dealt to tries by prefix. Two words of l, or of l and l + 1, code points that are one edit apart agree in
their first l // 2 code points or in all behind them (the last l - l // 2); so each word goes to the tries of its length
and of the next smaller one, by its first part, and, turned round so that this is a prefix too, by its last part. The trie
of a prefix is walked by one task from the node of that prefix on. A prefix of more than ``CROWD`` words is split in the
same way over what its words have left, until it is small or a single code point is left.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import LOWER, UPPER, chunks, written

#: Code points and occurrences a word has at least.
LETTERS, OCCURRENCES = 6, 5
#: A form is so many times as frequent as the word.
TIMES = 5
#: Words of a prefix that one task joins; larger prefixes are split.
CROWD = 20_000
#: Different words that a counting task holds before it passes their counts on.
HELD = 300_000
_WORD = re.compile("[A-Za-zÀ-ÿ]+")
_LOWERED = str.maketrans(UPPER, LOWER)


def misspelt(doc_id: int | None, word: str) -> str:
    """One (document, word) in 199, by crc32, loses a code point; a null id counts as an empty one."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % 199:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS) -> DataFrame:
    """(word, n) of whole texts; a task counts what it reads before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def taken() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in chunks(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for word, n in Counter(_WORD.findall(text)).items():
                    # deleting a code point makes no word longer
                    if len(word) >= letters:
                        word = misspelt(doc_id, word.lower() if word.isascii() else word.translate(_LOWERED))
                        if len(word) >= letters:
                            total[word] += n
            if len(total) > HELD:
                yield taken()
        if total:
            yield taken()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- tries -------------------------------------------------------------------------------------------------------------


class Node:
    """A trie's node: children by code point, the short and the long word that end here, and the active nodes."""

    __slots__ = ("children", "short", "long", "same", "longer")

    def __init__(self):
        self.children: dict[str, Node] = {}
        self.short = self.long = None
        #: Active nodes as deep as this one that differ in one code point, and those with one code point more.
        self.same: list[Node] = []
        self.longer: list[Node] = []


def trie_join(words: list[tuple[str, bool, object]]) -> Iterator[tuple[object, object]]:
    """Pairs of a trie: words are (text, whether it is one of the long ones, value), and long ones have one code point more.

    Pairs are of two short words, or of a short and a long one.
    """
    root = Node()
    for text, long, value in words:
        node = root
        for c in text:
            node = node.children.setdefault(c, Node())
        if long:
            node.long = value
        else:
            node.short = value
    level = [root]
    root.longer = list(root.children.values())
    while level:
        deeper = []
        for node in level:
            if node.short is not None:
                for other in node.same:
                    # the two are active nodes of each other; one of them tells
                    if other.short is not None and id(node) < id(other):
                        yield node.short, other.short
                for other in node.longer:
                    if other.long is not None:
                        yield node.short, other.long
            siblings = list(node.children.items())
            for c, child in siblings:
                child.same = [s for d, s in siblings if d != c]
                child.same += [x.children[c] for x in node.same if c in x.children]
                deleted = [x.children[c] for x in node.longer if c in x.children]
                child.longer = list(dict.fromkeys([*child.children.values(), *deleted]))
                deeper.append(child)
            node.same = node.longer = ()
        level = deeper


def split(rows: DataFrame) -> DataFrame:
    """Deal rows (key, size, long, rest, word, n) to longer keys.

    ``rest`` is what the key leaves of a word and ``size`` how much that is for the short words; the first half of it joins
    the key, and in another row the last half does.
    """
    # what is left is ``size`` code points, one more for long words
    parts = """array(
      named_struct('key', concat(key, '<', left(rest, size div 2)), 'size', cast(size - size div 2 as int), 'rest', right(rest, char_length(rest) - size div 2)),
      named_struct('key', concat(key, '>', right(rest, size - size div 2)), 'size', cast(size div 2 as int), 'rest', left(rest, char_length(rest) - (size - size div 2))))"""
    return rows.select(F.explode(F.expr(parts)).alias("s"), "long", "word", "n").select("s.key", "s.size", "long", "s.rest", "word", "n")


def _counted(rows: DataFrame, crowd: int) -> DataFrame:
    """Rows with whether their key is crowded; keys of a single word or of long words alone are left out."""
    sums = rows.groupBy("key").agg(F.count("*").alias("m"), F.count_if(~F.col("long")).alias("short")).where("m > 1 and short > 0")
    return rows.join(written(sums, "keys"), "key").withColumn("crowded", (F.col("m") > crowd) & (F.col("size") > 1)).drop("m", "short")


def near_pairs(vocabulary: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs of different words (a, an, b, bn) of a table (word, n) that are one edit apart, once each."""
    length = F.char_length("word")
    kinds = F.explode(F.array(F.struct(length.alias("size"), F.lit(False).alias("long")), F.struct((length - 1).alias("size"), F.lit(True).alias("long"))))
    rows = vocabulary.select(kinds.alias("k"), "word", "n").select(F.col("k.size").cast("string").alias("key"), F.col("k.size").alias("size"), F.col("k.long").alias("long"), F.col("word").alias("rest"), "word", "n")
    done = []
    while True:
        dealt = written(_counted(written(split(rows), "prefixes"), crowd), "prefixes")
        done.append(dealt.where("not crowded"))
        rows = dealt.where("crowded").drop("crowded")
        if rows.isEmpty():
            break
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def table() -> pa.RecordBatch:
            a, b = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in a], pa.string()), pa.array([x[1] for x in a], pa.int64()), pa.array([x[0] for x in b], pa.string()), pa.array([x[1] for x in b], pa.int64())], ["a", "an", "b", "bn"])

        for batch in batches:
            for k, rest, long, word, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if k != key:
                    out.extend(sorted(x) for x in trie_join(held))
                    key, held = k, []
                held.append((rest, long, (word, n)))
                if len(out) > 10_000:
                    yield table()
        out.extend(sorted(x) for x in trie_join(held))
        if out:
            yield table()

    dealt = every.select("key", "rest", "long", "word", "n").repartition("key").sortWithinPartitions("key")
    # a pair that agrees in both halves is found twice
    return dealt.mapInArrow(run, "a string, an long, b string, bn long").distinct()


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of a table (word, form) whose forms are ``TIMES`` as frequent each: where following forms ends.

    A chain that ends at a word of at most ``most`` occurrences has few steps; each round doubles those that are taken.
    """
    out = forms.select("word", F.col("form").alias("root"))
    steps = max(1, math.floor(math.log(max(most, 1), TIMES)) + 1)
    for _ in range(max(1, math.ceil(math.log2(steps)))):
        out = written(out, "roots")
        further = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        out = out.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return written(out, "roots")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, occurrences: int = OCCURRENCES, times: int = TIMES, crowd: int = CROWD) -> DataFrame:
    """Words of a corpus with the form they are a variant of: word, form, root, n, n_near, form_n.

    Words are runs of Latin letters of whole texts, A-Z lower-cased, some misspelt (see ``misspelt``), of at least
    ``letters`` code points and ``occurrences`` occurrences (n). n_near is the number of words one edit apart; form is the
    most frequent of them (of equals the first in code-point order) if it occurs ``times`` as often as the word, else null,
    as form_n, its n; root is where following forms ends, the word itself without a form. Null and empty texts have no
    words; a null id counts as an empty one; repeated rows count again. Other columns aren't read. Without words the
    result is empty.
    """
    words = written(word_counts(docs, id_col, text_col, letters).where(F.col("n") >= occurrences), "vocabulary")
    pairs = written(near_pairs(words, crowd), "pairs")
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("an").alias("m")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("near"))).alias("top"))
    known = written(words.join(best, "word", "left").withColumn("fits", -F.col("top.m") >= times * F.col("n")), "forms")
    fit = lambda x: F.when(F.col("fits"), x)
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), fit(F.col("top.near")).alias("form"), fit(-F.col("top.m")).alias("form_n"))
    most = known.agg(F.max("n")).first()[0] or 0
    found = roots(known.where("form is not null").select("word", "form"), most)
    return known.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
