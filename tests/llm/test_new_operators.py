"""Spelling variants, periodic runs and token files against brute-force versions, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow.fs as pafs
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import periodic, queries, spelling, tokenfile
from lodestone.llm.common import new_path

FOLDER = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, n long, word string, key string, ids string, runs string, part string, file string"
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "One"), (5, "one"), (5, "one"), (None, "one"), (None, None), (6, "É é É"), (7, "a b " * 9), (7, "x " * 40), (8, "Ünïcödé" * 3000)]


def docs(spark, rows):
    """With further columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, 1, "w", "k", "i", "r", "p", "f") for i, t in rows], DOCS)


def given(spark):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


# --- spelling variants -------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, letters=6, occurrences=5, times=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= letters and k >= occurrences}
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if one_edit(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        top = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None))
    return sorted(out, key=str)


def got_variants(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_variants_of_the_table(spark):
    assert got_variants(queries.op11_spelling_variants(spark, FOLDER)) == brute_variants(given(spark))


def invented(seed, alphabet="abé×", sizes=(5, 9)):
    r = random.Random(seed)
    words = ["".join(r.choice(alphabet) for _ in range(r.randint(*sizes))) for _ in range(60)]
    return [(k, " ".join(w if r.random() < 0.8 else w.upper() for w in r.choices(words, weights=[5 ** (i % 5) for i in range(60)], k=150))) for k in range(40)]


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_variants_of_close_words(spark, crowd):
    """Few letters, so that most words have many neighbours; with small crowds every prefix is split to its end."""
    rows = invented(1) + [(None, "abbabba " * 6), (3, None), (3, "")]
    assert got_variants(spelling.variants(docs(spark, rows), crowd=crowd)) == brute_variants(rows)


def test_chains_of_forms(spark):
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate([("aaaaaaaa", 5), ("aaaaaaab", 25), ("aaaaaabb", 125), ("aaaaabbb", 625), ("aaaabbbb", 3125), ("aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", 5), ("aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", 25)])]
    want = brute_variants(rows)
    assert [r[2] for r in want if r[0] == "aaaaaaaa"] == ["aaaabbbb"]
    assert got_variants(spelling.variants(docs(spark, rows))) == want


def test_variants_of_odd_rows(spark):
    rows = [*ODD, *[(k, "spelling  Spelling,spelling-speling") for k in range(9)], (9, "z" * 300_000), (9, ("y" * 5000 + " ") * 5)]
    assert got_variants(spelling.variants(docs(spark, rows))) == brute_variants(rows)
    assert got_variants(spelling.variants(docs(spark, []))) == []


# --- periodic runs -----------------------------------------------------------------------------------------------------


def brute_runs(words):
    """(start, length, period) of every run, by following each period from every place."""
    found = {}
    n = len(words)
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((s, k, p) for (s, k), p in found.items())


def brute_periodic(rows):
    out = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        dropped = {i for s, k, p in runs for i in range(s + p, s + k)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{k},{p}\n" for s, k, p in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        out.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept))))
    return sorted(out, key=str)


def test_runs_of_the_table(spark):
    got = queries.op12_periodic_runs(spark, FOLDER)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert sorted(map(tuple, got.collect()), key=str) == brute_periodic(given(spark))


def test_runs_of_repeating_texts(spark):
    r = random.Random(5)
    rows = [(k, " ".join(r.choice("ab" if k % 3 else "abc") for _ in range(r.randrange(0, 120)))) for k in range(300)]
    rows += [(k, " ".join((["u", "v", "w"][: r.randrange(1, 4)] * 30)[: r.randrange(1, 60)] + ["x"] * r.randrange(0, 9) + ["y", "z"] * r.randrange(0, 9))) for k in range(200)]
    rows += [(1000 + k, "q " * 500 + "r s " * 300 + "q " * k) for k in range(4)]
    got = periodic.digests(periodic.detect(docs(spark, rows), tails=True))
    assert sorted(map(tuple, got.collect()), key=str) == brute_periodic(rows)


def test_runs_of_odd_rows(spark):
    rows = [*ODD, (9, "same " * 20_000), (10, " ".join(f"w{k % 700}" for k in range(9000)))]
    got = periodic.digests(periodic.detect(docs(spark, rows), tails=True))
    assert sorted(map(tuple, got.collect()), key=str) == brute_periodic(rows)
    assert periodic.detect(docs(spark, [])).count() == 0
    plain = {r.doc_id: r for r in periodic.detect(docs(spark, [(1, "a b c a b c a b c a b c d")])).collect()}[1]
    assert [tuple(x) for x in plain.runs] == [(0, 12, 3)] and plain.collapsed == "a b c d" and plain.n_words == 13


def test_names_agree_where_stretches_do():
    words = np.random.default_rng(2).integers(0, 3, 400)
    for k, name in enumerate(periodic.name_levels(words, 32)):
        seen = {}
        for i in range(len(words) - (1 << k) + 1):
            stretch = tuple(words[i : i + (1 << k)])
            assert seen.setdefault(stretch, name[i]) == name[i]
        assert len(set(seen.values())) == len(seen)


# --- token files -------------------------------------------------------------------------------------------------------


def brute_tokens(rows):
    library, out, start = Tokenizer.from_file(BPE), [], 0
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_of_the_table(spark):
    got = queries.op13_token_files(spark, FOLDER).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert [t for _, t in got.dtypes] == ["bigint"] * 4
    assert sorted(map(tuple, got.collect())) == brute_tokens(sorted(given(spark)))


def test_token_files_of_odd_rows(spark):
    rows = [(i, t) for i, t in ODD if i is not None] + [(9, "<|endoftext|> inside <|endoftext|>"), (10, "中文 русский \U0001f600 tail"), (11, "word " * 60_000)]
    rows = [r for k, r in enumerate(rows) if r not in rows[:k]]
    want = {i: sorted(x[2:] for x in brute_tokens(rows) if x[0] == i) for i, _ in rows}
    got = [tuple(r)[:4] for r in tokenfile.write_and_read(docs(spark, [*rows, (None, "one"), (None, None)]), BPE).collect()]
    by_start = sorted(got, key=lambda r: r[1])
    # nulls first, then ascending ids, each row where the one before it ends
    assert [r[0] for r in by_start] == [None, None, *sorted(i for i, _ in rows)]
    assert [r[1] for r in by_start] == [0, *np.cumsum([r[2] for r in by_start])[:-1].tolist()]
    assert {i: sorted(r[2:] for r in got if r[0] == i) for i, _ in rows} == want
    assert tokenfile.write_and_read(docs(spark, []), BPE).count() == 0


def test_one_id_many_rows(spark):
    rows = [(7, f"text {k % 3}") for k in range(400)] + [(k, "other") for k in range(100)]
    got = sorted((r.start, r.n_tokens, r.doc_id) for r in tokenfile.write_and_read(docs(spark, rows), BPE).collect())
    assert [r[0] for r in got] == [0, *np.cumsum([r[1] for r in got])[:-1].tolist()]
    assert [r[2] for r in got] == sorted(i for i, _ in rows)


@pytest.mark.parametrize(("block", "segment", "lanes", "roll"), [(64, 16, 4, 200), (1000, 100, 7, 1 << 20), (1 << 20, 1 << 17, 2048, 1 << 26)])
def test_blocks_segments_and_files_of_any_size(spark, block, segment, lanes, roll):
    """Documents that begin in one block and end some blocks later, files that roll, and single segments of the index."""
    r = random.Random(3)
    rows = [(k, " ".join(r.choice(["the", "of", "rain", "x9", "\n\n", "été"]) for _ in range(r.choice([0, 3, 40, 700])))) for k in range(60)]
    folder = new_path(spark, "token-files-test")
    index = tokenfile.write_files(tokenfile.encoded(docs(spark, rows), BPE), folder, roll, block, segment, lanes)
    library = Tokenizer.from_file(BPE)
    want = {k: np.array(library.encode(t).ids + [0], "<u4").tobytes() for k, t in rows}
    assert {x.doc_id: bytes(x.ids) for x in tokenfile.read_files(index, folder).collect()} == want
    some = index.where(F.pmod(F.hash("file", "first"), F.lit(3)) == 0)
    few = tokenfile.read_files(some, folder).collect()
    assert all(bytes(x.ids) == want[x.doc_id] for x in few)
    with pytest.raises(Exception, match="damaged|checksum|decompress"):
        fs, root = pafs.FileSystem.from_uri(folder)
        name = index.first().file
        data = bytearray(fs.open_input_file(f"{root}/{name}").read())
        data[-1] ^= 1
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(bytes(data))
        tokenfile.read_files(index, folder).collect()


def test_frequencies():
    r = np.random.default_rng(1)
    for n in (1, 2, 300, 50_000):
        table = tokenfile.table_of(np.arange(n) * 3, (r.zipf(1.3, n) % 10**9).astype(np.int64))
        assert table.freq.sum() == 1 << table.scale and table.freq.min() >= 1
        again = tokenfile.Table.unpack(table.pack())
        assert (again.ids == table.ids).all() and (again.freq == table.freq).all()
    # close to the entropy of the ids
    ids = r.choice(500, 200_000, p=(p := 1 / np.arange(1, 501)) / p.sum())
    counts = np.bincount(ids)
    table = tokenfile.table_of(np.flatnonzero(counts), counts[counts > 0])
    share = counts[counts > 0] / len(ids)
    bits = 8 * len(tokenfile.encode_block(ids, [], 0, table, 256)) / len(ids)
    assert bits < 1.06 * -(share * np.log2(share)).sum()


def test_pieces_are_the_library_s():
    """Every character that the pieces' pattern stands for, in all neighbourhoods that it may tell apart."""
    coder, library = tokenfile.Encoder(BPE), Tokenizer.from_file(BPE)
    texts = []
    for c in map(chr, range(0x250)):
        texts += [f"a{c}b{c}{c} {c}1{c} ", f"{c}", f" {c}\n{c}'s{c}'{c}", f"1{c}2  {c}!{c}?"]
    texts += ["it's we'll they're 'tis ''s  'd   x", "<|endoftext|>a", "tail  \n "]
    assert [np.frombuffer(coder.encode(x), coder.kind).tolist() for x in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_a_block_is_coded_in_few_rows():
    ids = np.random.default_rng(7).integers(0, 5000, tokenfile.BLOCK).astype(np.uint32)
    table = tokenfile.table_of(*np.unique(ids, return_counts=True))
    block = tokenfile.Block(tokenfile.encode_block(ids, [], 0, table), table)
    assert block.n // block.lanes <= 128 and len(block.checkpoints) == 2
    assert (block.ids(0, block.n)[0] == ids).all()
    found, skipped = block.ids(block.n - 5, block.n)
    assert skipped == block.segment and (found == ids[skipped:]).all()
