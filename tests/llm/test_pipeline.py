"""The pipeline's stages against brute-force versions, and the queries against their SQL."""

import re

import corpus_pipeline
import pytest
from oracle import same

from lodestone.llm import queries, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    same(queries.queries()[name], queries.oracle_sql()[name], spark, FOLDER)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    items = [shingles(r["text"].lower()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = [r["doc_id"] for r in toxicity.classify(docs, labels).where("predicted = 0").collect()]
    lower = {i: re.sub("[A-Z]", lambda m: m.group().lower(), text[i]) for i in left}
    last = {}
    for i in sorted(left):
        last[lower[i]] = i
    left = sorted(last.values())
    sets, parent = {i: shingles(lower[i]) for i in left}, {i: i for i in left}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(left):
        for b in left[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    left = [i for i in left if root(i) == i]
    left = [i for i in left if not any(len(q & shingles(text[i].lower())) >= 0.75 * len(q) for q in items if q)]
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in got) == left
    assert sum(r["taken"] for r in got) == pytest.approx(1.5 * sum(r["size"] for r in got), rel=0.05)


def test_stages_keep_columns_and_bear_odd_rows(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long, digest string"
    odd = spark.createDataFrame([(1, None, None, None, None, "a"), (2, "", "x", "s", 0, None), (3, "One two", "x", "s", 7, "b"), (3, "One two", "x", "s", 7, "b"), (None, "z", "x", None, 1, "c")], columns)
    for docs in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            assert name.startswith("mixing") or out.columns == docs.columns
            # nothing here is rejected or in the benchmark: only copies go, and a null text is a copy of an empty one
            kept = {"exact dedup": 3, "MinHash near-dedup": 4}.get(name, 5) if docs is odd else 0
            assert out.count() == kept, name
