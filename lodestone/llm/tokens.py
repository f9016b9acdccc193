"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

Byte-pair encoding of a piece of text (a word with its leading space, say) has one last token for each prefix of it: the
token t whose predecessor, the last token of the prefix before t, stays unmerged beside it. So the count of a prefix is
the count before its last token plus one, and all counts of a piece come from one pass over its prefixes. Pieces are
taken in sorted order, so that one pass also serves all that share a beginning, and their counts are remembered.

A text's prefix counts are the pieces' counts on top of each other. They are stored with the text's id as steps, a signed
byte for each character: by how much the count of the prefix that ends with it exceeds that of the prefix before. The
number of tokens is the last prefix's count; truncation and budget questions read the steps and never encode again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import chunks

LIMIT = 512
#: Bytes of pieces that a task remembers before it starts anew.
REMEMBERED = 6 << 20
#: Bytes up to which pieces are worked on together, one matrix row each; a longer one is a matrix of its own.
WIDE = 64
#: Fixed value: how byte-level BPE of this kind cuts text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Letters, digits and white space up to U+024F, and the same cut of a text of them, which re makes faster.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t-\r \x85\xa0"
LATIN_PIECES = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_BEYOND = re.compile("[^\x00-ɏ]")
#: Pieces whose first two characters are two pieces by themselves.
_CUT_SHORT = ("'re", "'ve", "'ll")
_RUN, _MAY_RUN = regex.compile(r"\s{2,}"), re.compile(r"\s\s")
#: A step that doesn't fit a signed byte is this byte and four more.
_ESCAPE = 0x80


def latin(text: str) -> bool:
    """Whether no character is beyond U+024F, so that ``LATIN_PIECES`` cuts the text."""
    try:
        text.encode("latin-1")  # the quickest way to see that no character is beyond
    except UnicodeEncodeError:
        return not _BEYOND.search(text)
    return True


def encode_steps(steps: Iterable[int]) -> bytes:
    out = bytearray()
    for d in steps:
        if -128 < d < 128:
            out.append(d & 255)
        else:
            out.append(_ESCAPE)
            out += int(d).to_bytes(4, "little", signed=True)
    return bytes(out)


def decode_steps(data: bytes) -> np.ndarray:
    if _ESCAPE not in data:
        return np.frombuffer(data, np.int8).astype(np.int64)
    out, i = [], 0
    while i < len(data):
        if data[i] == _ESCAPE:
            out.append(int.from_bytes(data[i + 1 : i + 5], "little", signed=True))
            i += 5
        else:
            out.append(data[i] - 256 if data[i] > 127 else data[i])
            i += 1
    return np.array(out, np.int64)


def decode_counts(data: bytes) -> np.ndarray:
    """The token count of every prefix, from the empty one to the whole text, from a text's steps."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(decode_steps(data))])


def _byte_chars() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: itself if it prints, else the next from U+0100."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(spare)] = b
            spare += 1
    return out


_HASH = np.uint64(0x9E3779B97F4A7C15)


def _hash(data: bytes) -> int:
    found = 0
    for b in data:
        found = (found * int(_HASH) + b + 1) & ((1 << 64) - 1)
    return found


class PrefixCounter:
    """Token counts of all prefixes, as the tokenizer of a byte-level BPE file gives them.

    Tokens are numbered: the bytes first, then one for each merge in its order, so that a smaller number merges earlier.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_chars()
        text = lambda token: bytes(chars[c] for c in token)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        tokens = [bytes([b]) for b in range(256)]
        number = {t: i for i, t in enumerate(tokens)}
        left, right = list(range(256)), list(range(256))
        for a, b in pairs:
            a, b = text(a), text(b)
            number.setdefault(a + b, len(tokens))
            tokens.append(a + b)
            left.append(number[a])
            right.append(number[b])
        self.number, self.left, self.right = number, np.array(left), np.array(right)
        self.rank = {(text(a), text(b)): i for i, (a, b) in enumerate(pairs)}
        keys = self.left[256:] << 32 | self.right[256:]
        self.pair_order = np.argsort(keys, kind="stable")
        self.pair_keys = keys[self.pair_order]
        # tokens that are what their bytes are encoded as, by the hash of their bytes; the others never stand in an encoding
        whole = [t for t in number if self.merged(t) == [t]]
        hashes = np.array([_hash(t) for t in whole], np.uint64)
        order = np.argsort(hashes)
        self.token_hashes, self.token_numbers = hashes[order], np.array([number[t] for t in whole])[order]
        #: the length of the longest token by the three bytes it ends with; with other endings there are two bytes at most
        self.reach = np.full(1 << 24, 2, np.uint16)
        for t in whole:
            if len(t) > 2:
                end = int.from_bytes(t[-3:], "big")
                self.reach[end] = max(self.reach[end], len(t))
        self.special = [x["content"] for x in spec.get("added_tokens", []) if x.get("special")]
        self.pieces = regex.compile(PIECES)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.held = 0

    def merged(self, data: bytes) -> list[bytes]:
        """Byte-pair encoding by its definition: the pair of lowest rank merges first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts[:-1], parts[1:], strict=True)]
            best = min(ranks)
            if best == 1 << 60:
                break
            a, b = (parts[k] for k in (ranks.index(best), ranks.index(best) + 1))
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def stays(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b (numbers), side by side, stay apart.

        Merges are undone at the border, the latest first: at no time may the two tokens that meet there have a merge
        that is earlier than the one that changes them.
        """
        out, at = np.ones(len(a), bool), np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), 1 << 40)
        while len(at):
            key = a << 32 | b
            place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            merge = np.where(self.pair_keys[place] == key, self.pair_order[place] + 256, 1 << 50)
            bad = merge < limit
            out[at[bad]] = False
            # of two equal tokens the left one is merged first, so the right one is undone first
            undo_a = a > b
            go = ~bad & (np.where(undo_a, a, b) >= 256)
            at, a, b, undo_a = at[go], a[go], b[go], undo_a[go]
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        """Compute and remember the steps of pieces."""
        rows = sorted((p.encode("utf-8", "surrogatepass"), p) for p in pieces)
        self.held += sum(len(data) for data, _ in rows)
        for many, width in ((False, 0), (True, WIDE)):
            some = [x for x in rows if (len(x[0]) <= WIDE) == many]
            for i in range(0, len(some), 1 << 16 if many else 1):
                part = some[i : i + (1 << 16 if many else 1)]
                self._learn([d for d, _ in part], [p for _, p in part], width or len(part[0][0]))

    def need(self, pieces: set[str]) -> None:
        """Know all these pieces. Where others are forgotten to make room, those of them that were known are learnt anew, together."""
        new = [p for p in pieces if p not in self.known]
        if new and self.held > REMEMBERED:
            self.forget()
            new = pieces
        self.learn(new)

    def _learn(self, data: list[bytes], pieces: list[str], width: int) -> None:
        """The dynamic program over all prefixes of sorted pieces at once, by the prefixes' length.

        A prefix that several pieces begin with belongs to the first of them. Row r of the matrices is a piece, column
        j its prefix of j bytes.
        """
        n, size = len(data), np.array([len(d) for d in data])
        width = min(width, int(size.max()))
        flat = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in data), np.uint8).reshape(n, width)
        row = np.arange(n)
        differs = np.ones((n, width), bool)
        differs[1:] = np.logical_or.accumulate(flat[1:] != flat[:-1], axis=1)
        inside = np.arange(width) < size[:, None]
        # the sorted pieces differ, but padding may not: what lies behind the shorter one's end is new too
        differs[1:] |= np.arange(width) >= size[:-1, None]
        new = differs & inside
        owner = np.zeros((width + 1, n), np.int32)
        owner[1:] = np.maximum.accumulate(np.where(new, row[:, None], 0), axis=0).T
        hashes = np.zeros((width + 1, n), np.uint64)
        powers = np.ones(width + 1, np.uint64)
        for j in range(width):
            hashes[j + 1] = hashes[j] * _HASH + flat[:, j] + np.uint64(1)
            powers[j + 1 : j + 2] = powers[j : j + 1] * _HASH
        last, count = np.zeros((width + 1, n), np.int64), np.zeros((width + 1, n), np.int32)
        for j in range(1, width + 1):
            todo = np.flatnonzero(new[:, j - 1])
            if not len(todo):
                continue
            far = np.full(len(todo), min(j, 2))
            if j >= 3:
                end = flat[todo, j - 3].astype(np.int32) << 16 | flat[todo, j - 2].astype(np.int32) << 8 | flat[todo, j - 1]
                far = np.minimum(self.reach[end], j)
            for length in range(int(far.max()), 0, -1):
                may = np.flatnonzero(far >= length)
                r = todo[may]
                value = hashes[j, r] - hashes[j - length, r] * powers[length]
                place = np.minimum(np.searchsorted(self.token_hashes, value), len(self.token_hashes) - 1)
                hit = self.token_hashes[place] == value
                may, r, token = may[hit], r[hit], self.token_numbers[place[hit]]
                if not len(r):
                    continue
                own = owner[j - length, r]
                if length < j:
                    fits = self.stays(last[j - length, own], token)
                    may, r, token, own = may[fits], r[fits], token[fits], own[fits]
                last[j, r], count[j, r] = token, count[j - length, own] + 1
                far[may] = 0  # settled
        counts = np.take_along_axis(count, owner, axis=1).T[:, 1:]
        for k, piece in enumerate(pieces):
            if piece in _CUT_SHORT:
                counts[k, :3] = 1, 2, counts[k, 2]
        # steps from character to character: bytes in the midst of one have none
        ends = inside.copy()
        ends[:, :-1] &= ~inside[:, 1:] | (flat[:, 1:] & 0xC0 != 0x80)
        first = np.zeros(n + 1, np.int64)
        np.cumsum(ends.sum(axis=1), out=first[1:])
        here = counts[ends]
        step = np.diff(here, prepend=0)
        step[first[:-1]] = here[first[:-1]]
        if np.abs(step).max() < 128:
            steps, at = step.astype(np.int8).tobytes(), first.tolist()
            self.known.update((p, steps[at[k] : at[k + 1]]) for k, p in enumerate(pieces))
        else:
            self.known.update((p, encode_steps(step[first[k] : first[k + 1]].tolist())) for k, p in enumerate(pieces))

    def piece(self, text: str) -> int:
        """The number of tokens of one piece."""
        self.need({text})
        return int(decode_steps(self.known[text]).sum())

    def _of_part(self, part: str, pieces: list[str] | None = None) -> bytes:
        """The steps of a text without special strings, which may have been cut into its pieces already."""
        pieces = self.cut_up(part) if pieces is None else pieces
        try:
            data = b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            self.need(set(pieces))
            data = b"".join(map(self.known.__getitem__, pieces))
        if not _MAY_RUN.search(part):
            return data
        # white space at the end of a prefix is one piece, however the whole text goes on
        steps = None
        for m in _RUN.finditer(part):
            run = m[0]
            if m.end() < len(part) and (more := self.piece(run) - self.piece(run[:-1]) - self.piece(run[-1])):
                steps = decode_steps(data) if steps is None else steps
                steps[m.end() - 1] += more
                steps[m.end()] -= more
        return data if steps is None else encode_steps(steps.tolist())

    def cut_up(self, text: str) -> list[str]:
        return LATIN_PIECES.findall(text) if latin(text) else self.pieces.findall(text)

    def plain(self, text: str) -> bool:
        return self.cut is None or not any(s in text for s in self.special)

    def of_texts(self, texts: list[str]) -> list[bytes]:
        """The steps of some texts, whose new pieces are learnt together."""
        cut = [self.cut_up(x) if self.plain(x) else None for x in texts]
        self.need(set().union(*filter(None, cut)))
        return [self.steps(x) if pieces is None else self._of_part(x, pieces) for x, pieces in zip(texts, cut, strict=True)]

    def steps(self, text: str) -> bytes:
        """By how much each character raises the token count of the prefix that ends with it."""
        if self.plain(text):
            return self._of_part(text)
        counts, begin, place = [0], 0, 0  # begin: where the last piece before this place starts
        for k, part in enumerate(self.cut.split(text)):
            if not part:
                continue
            base = counts[-1]
            if k % 2:
                # a special string that is cut is ordinary text, which the piece before it may run into
                start = counts[begin]
                counts += [start + int(decode_steps(self.steps(text[begin : place + i])).sum()) for i in range(1, len(part))]
                counts.append(base + 1)
                begin = place
            else:
                counts += (np.cumsum(decode_steps(self._of_part(part))) + base).tolist()
                begin = place + len(part) - len(self.pieces.findall(part)[-1])
            place += len(part)
        return encode_steps(np.diff(counts).tolist())

    def total(self, text: str) -> int:
        return int(decode_steps(self.steps(text)).sum())

    def prefixes(self, text: str) -> np.ndarray:
        """The token count of text[:i], for every i from 0 to its length."""
        return decode_counts(self.steps(text))


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each Python worker and vocabulary."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Token counts of all prefixes of whole texts: doc_id, n_bytes, n_tokens, over_limit, prefix_steps.

    ``prefix_steps`` holds the count of each prefix (see the module), for ``prefix_tokens`` and ``longest_prefix``;
    n_tokens is the count of the last, the text itself, and over_limit whether it exceeds ``limit``. A null text counts as
    empty, with 0 bytes and tokens. Strings of special tokens inside a text are those tokens, the library's default; none
    is added. Repeated rows and ids are counted row by row; an empty table gives an empty one. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in chunks(batches, "text"):
            texts = ["" if x is None else x for x in batch.column("text").to_pylist()]
            size = pa.array([len(x.encode("utf-8", "surrogatepass")) for x in texts], pa.int64())
            steps = c.of_texts(texts)
            total = pa.array([int(decode_steps(x).sum()) for x in steps], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, total, pa.array(steps, pa.binary())], ["doc_id", "n_bytes", "n_tokens", "prefix_steps"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, prefix_steps binary")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "prefix_steps")


def prefix_tokens(length: Column | int, steps: str = "prefix_steps") -> Column:
    """The token count of the first ``length`` characters, from stored steps; null beyond the text."""

    @F.pandas_udf("long")
    def read(data: pd.Series, n: pd.Series) -> pd.Series:
        found = (decode_counts(x) for x in data)
        return pd.Series([int(c[k]) if 0 <= k < len(c) else None for c, k in zip(found, n, strict=True)], dtype="Int64")

    return read(F.col(steps), F.lit(length).cast("long"))


def longest_prefix(budget: Column | int, steps: str = "prefix_steps") -> Column:
    """The most characters whose tokens fit the budget, from stored steps (counts don't rise steadily)."""

    @F.pandas_udf("long")
    def read(data: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([int(np.flatnonzero(decode_counts(x) <= max(k, 0)).max()) for x, k in zip(data, n, strict=True)], dtype="int64")

    return read(F.col(steps), F.lit(budget).cast("long"))
