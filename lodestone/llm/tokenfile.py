"""Token ids of documents in files of entropy-coded blocks (static range asymmetric numeral system).

All files of a folder share one table of frequencies, counted over all ids and scaled to 2**SCALE, which the file
``frequencies`` holds. A file is a header and blocks. A block is coded by itself:

    magic, sizes, place of its first id in the file, checksum of the two sections that follow
    documents that begin in the block: id, place of the first token, number of tokens (deflated)
    checkpoints, one every SEGMENT ids: the coder's states, where its words go on, checksum of the segment's ids
    words of 32 bits

Its ids are dealt to LANES interleaved states, so that NumPy codes a row of ids at once; a checkpoint is the states in
front of a row, so that decoding may begin there. The index has a row for each segment. Tasks read runs of segments, each
the documents that begin in them, and follow a document that runs on into later ones.

An archive's name is its task attempt's own, and the index is stored before it is used, so a repeated or lost attempt
leaves a file that no row names.
"""

from __future__ import annotations

import itertools
import operator
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import chunks, new_path, small, written
from lodestone.llm.tokens import _byte_chars as byte_chars

#: The id that ends each document.
END = 0
#: Frequencies of the table add up to 2**SCALE.
SCALE = 20
#: Many, as each row of ids costs NumPy the same dozen calls.
LANES = 8192
#: Ids between two checkpoints, and in a block: multiples of LANES.
SEGMENT, BLOCK = 1 << 19, 1 << 20
#: Ids after which a task begins another file.
ROLL = 1 << 26
#: Ids that a reading task decodes, about.
TASK = 1 << 25
#: Pieces of text whose ids a task remembers before it starts anew.
REMEMBERED = 600_000

_LOW = np.uint64(1 << 31)
_MAGIC, _BLOCK_MAGIC, _TABLE_MAGIC = b"LSTI0001", b"LSTB", b"LSTF0001"
_HEAD = "<4sIIIIQIII"  # magic, ids, lanes, segment, words, first, bytes of documents, bytes of checkpoints, checksum

# Letters, digits and white space up to U+024F, and how byte-level BPE cuts a text of them into pieces.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t-\r \x85\xa0"
_PIECES = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_BEYOND = re.compile("[^\x00-ɏ]")


# --- text to ids -------------------------------------------------------------------------------------------------------


class Encoder:
    """Ids of whole texts by the tokenizers library.

    Byte-level BPE encodes piece by piece. Where the pieces of a text can be told by ``_PIECES``, as for all texts of
    Latin letters, the library gives the ids of each different piece once; any other text it encodes as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size()
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.plain = type(self.library.pre_tokenizer).__name__ == "ByteLevel" and self.library.normalizer is None and self.library.pre_tokenizer.use_regex and not self.library.pre_tokenizer.add_prefix_space
        #: The character that stands for each byte in the vocabulary; a newline stays, it never is in a piece of other characters.
        self.chars = {b: c for c, b in byte_chars().items() if b != 10}
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _cuttable(self, text: str) -> bool:
        if not self.plain or any(s in text for s in self.special):
            return False
        try:
            text.encode("latin-1")  # the quickest way to see that no character is beyond
        except UnicodeEncodeError:
            return not _BEYOND.search(text)
        return True

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces: those of white space as texts, the others by the library's model, which gets bytes as characters."""
        self.known.update((x, self._ids(x).tobytes()) for x in pieces if x.isspace())
        words = [x for x in pieces if not x.isspace()]
        spelt = "\n".join([x.encode().decode("latin-1") for x in words]).translate(self.chars).split("\n")
        model, code = self.library.model.tokenize, "H" if self.kind.itemsize == 2 else "I"
        self.known.update((x, array(code, [t.id for t in model(y)]).tobytes()) for x, y in zip(words, spelt, strict=bool(words)))

    def encode(self, text: str) -> bytes:
        if not self._cuttable(text):
            return self._ids(text).tobytes()
        pieces = _PIECES.findall(text)
        ids = list(map(self.known.get, pieces, itertools.repeat(b"")))
        missing = list(itertools.compress(range(len(ids)), map(operator.not_, ids)))
        if missing:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self._learn(list({pieces[i] for i in missing}))
            for i in missing:
                ids[i] = self.known[pieces[i]]
        return b"".join(ids)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """Write (part, nth, doc_id, n, ids, wide) of all documents: parts and, inside them, nth follow ascending doc_id.

    Null ids come first; of equal ids the order is that of a hash of the text. Rows are dealt by ranges of (id, hash, row),
    so one id with a third of all rows is split too.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keys = source.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = keys.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, nth = encoder(path), 0
        last = np.array([end], e.kind).tobytes()
        for batch in chunks(batches, "text"):
            ids = [e.encode(x) + last for x in batch.column("text").to_pylist()]
            n = pa.array([len(x) // e.kind.itemsize for x in ids], pa.int64())
            rows = pa.array(range(nth, nth + len(ids)), pa.int64())
            nth += len(ids)
            yield pa.RecordBatch.from_arrays([batch.column("part"), rows, batch.column("doc_id"), n, pa.array(ids, pa.binary()), pa.array([e.kind.itemsize] * len(ids), pa.int32())], ["part", "nth", "doc_id", "n", "ids", "wide"])

    spark, setting = docs.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")  # the shuffled texts aren't needed once the ids are written
    try:
        return written(dealt.mapInArrow(run, "part int, nth long, doc_id long, n long, ids binary, wide int"), "token-ids")
    finally:
        spark.conf.set(setting, before) if before is not None else spark.conf.unset(setting)


# --- the shared table --------------------------------------------------------------------------------------------------


def _numbers(data: bytes, wide: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if wide == 2 else "<u4")


def id_counts(ids: DataFrame) -> DataFrame:
    """(id, n) over all rows of (ids, wide): a row for each id of the vocabulary from each task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in chunks(batches, "ids"):
            for wide in (2, 4):
                found = pc.filter(batch.column("ids"), pc.equal(batch.column("wide"), wide)).to_pylist()
                if found:
                    more = np.bincount(_numbers(b"".join(found), wide))
                    if len(more) > len(total):
                        total = np.pad(total, (0, len(more) - len(total)))
                    total[: len(more)] += more
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    return ids.select("ids", "wide").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


@dataclass
class Table:
    """Frequencies that add up to 2**scale; ``ids`` are those that occur, in ascending order."""

    ids: np.ndarray
    freq: np.ndarray
    scale: int

    def __post_init__(self):
        size = int(self.ids.max()) + 1 if len(self.ids) else 0
        self.by_id, self.start = np.zeros(size, np.uint32), np.zeros(size, np.uint32)
        self.by_id[self.ids] = self.freq
        self.start[self.ids] = np.concatenate([[0], np.cumsum(self.freq)[:-1]]) if size else []
        self._slots = None

    @property
    def slots(self) -> np.ndarray:
        """The id of each of the 2**scale slots."""
        if self._slots is None:
            self._slots = np.repeat(self.ids.astype(np.uint32), self.freq.astype(np.int64))
        return self._slots

    def pack(self) -> bytes:
        body = struct.pack("<II", self.scale, len(self.ids)) + self.ids.astype("<u4").tobytes() + self.freq.astype("<u4").tobytes()
        return _TABLE_MAGIC + struct.pack("<I", zlib.crc32(body)) + body

    @classmethod
    def unpack(cls, data: bytes) -> Table:
        (checksum,) = struct.unpack_from("<I", data, 8)
        if data[:8] != _TABLE_MAGIC or zlib.crc32(data[12:]) != checksum:
            raise ValueError("the table of frequencies is damaged")
        scale, n = struct.unpack_from("<II", data, 12)
        both = np.frombuffer(data, "<u4", 2 * n, 20)
        return cls(both[:n].astype(np.int64), both[n:].astype(np.uint64), scale)


def table_of(ids: np.ndarray, counts: np.ndarray, scale: int = SCALE) -> Table:
    """Scale counts so that they add up to 2**scale and each is at least 1; what rounding leaves goes to the frequent."""
    order = np.argsort(ids)
    ids, counts = np.asarray(ids, np.int64)[order], np.asarray(counts, np.float64)[order]
    while len(ids) * 4 > 1 << scale:
        scale += 1
    size = 1 << scale
    freq = np.maximum(1, np.floor(counts / max(counts.sum(), 1) * size)).astype(np.int64)
    left = size - int(freq.sum())
    by_size = np.argsort(-freq, kind="stable")
    while left < 0:  # the ids raised to 1 are paid for in proportion
        cut = np.minimum(freq[by_size] - 1, np.ceil(freq[by_size] * (-left / size)).astype(np.int64))
        fits = np.minimum(cut, np.maximum(0, -left - (np.cumsum(cut) - cut)))
        freq[by_size] -= fits
        left += int(fits.sum())
    if len(freq):
        freq[by_size[0]] += left
    return Table(ids, freq.astype(np.uint64), scale)


# --- blocks ------------------------------------------------------------------------------------------------------------


def encode_block(ids: np.ndarray, starts: list[tuple[int | None, int, int]], first: int, table: Table, lanes: int = LANES, segment: int = SEGMENT) -> bytes:
    """A block of ids; ``starts`` has (doc_id, place in the block, number of tokens) of the documents that begin in it."""
    n = len(ids)
    lanes = max(1, min(lanes, n // 64))
    segment = max(1, segment // lanes) * lanes
    scale, most = np.uint64(table.scale), np.uint64(63 - table.scale)
    freq, start = table.by_id[ids].astype(np.uint64), table.start[ids].astype(np.uint64)
    state = np.full(lanes, _LOW)
    words, sizes, marks = [], [], {}
    for begin in range((n - 1) // lanes * lanes, -1, -lanes):
        f, c = freq[begin : begin + lanes], start[begin : begin + lanes]
        x = state[: len(f)]
        over = x >= f << most
        out = x[over]
        words.append(out.astype(np.uint32))
        sizes.append(len(out))
        x[over] = out >> np.uint64(32)
        q = x // f
        state[: len(f)] = (q << scale) + (x - q * f) + c
        if begin % segment == 0:
            marks[begin] = state.astype("<u8").tobytes(), len(sizes)
    words.reverse()
    before = np.concatenate([[0], np.cumsum(sizes[::-1])])
    rows = len(sizes)
    checkpoints = b"".join(struct.pack("<II", int(before[rows - marks[b][1]]), zlib.crc32(ids[b : b + segment].astype("<u4"))) + marks[b][0] for b in sorted(marks))
    names = np.array([0 if d is None else d for d, _, _ in starts], "<i8").tobytes() + bytes(d is None for d, _, _ in starts)
    documents = zlib.compress(struct.pack("<I", len(starts)) + names + np.array([p for _, p, _ in starts], "<u4").tobytes() + np.array([k for _, _, k in starts], "<u8").tobytes(), 1)
    data = np.concatenate(words).astype("<u4").tobytes() if words else b""
    head = struct.pack(_HEAD, _BLOCK_MAGIC, n, lanes, segment, len(data) // 4, first, len(documents), len(checkpoints), zlib.crc32(documents + checkpoints))
    return head + documents + checkpoints + data


class Block:
    """A block as read; ``ids(a, b)`` decodes the segments that hold ids a to b."""

    def __init__(self, data: bytes, table: Table):
        magic, self.n, self.lanes, self.segment, words, self.first, a, b, checksum = struct.unpack_from(_HEAD, data)
        at = struct.calcsize(_HEAD)
        if magic != _BLOCK_MAGIC or len(data) != at + a + b + 4 * words or zlib.crc32(data[at : at + a + b]) != checksum:
            raise ValueError("a block is damaged")
        self.table = table
        documents = zlib.decompress(data[at : at + a])
        (k,) = struct.unpack_from("<I", documents)
        names, null = np.frombuffer(documents, "<i8", k, 4), documents[4 + 8 * k : 4 + 9 * k]
        places, sizes = np.frombuffer(documents, "<u4", k, 4 + 9 * k), np.frombuffer(documents, "<u8", k, 4 + 13 * k)
        self.starts = [(None if z else int(d), int(p), int(s)) for d, z, p, s in zip(names, null, places, sizes, strict=True)]
        step = 8 + 8 * self.lanes
        self.checkpoints = [(*struct.unpack_from("<II", data, at + a + i), data[at + a + i + 8 : at + a + i + step]) for i in range(0, b, step)]
        self.words = np.frombuffer(data, "<u4", words, at + a + b)

    def ids(self, a: int, b: int) -> tuple[np.ndarray, int]:
        """Ids from the checkpoint at or before ``a`` on, up to the end of the segment that holds the one before ``b``; and where they begin."""
        low, high = a // self.segment, -(-min(b, self.n) // self.segment)
        t, scale, mask = self.table, np.uint64(self.table.scale), np.uint64((1 << self.table.scale) - 1)
        parts = []
        for word, checksum, states in self.checkpoints[low:high]:
            begin = (low + len(parts)) * self.segment
            out = np.empty(min(self.segment, self.n - begin), np.uint32)
            state = np.frombuffer(states, "<u8").astype(np.uint64)
            for i in range(0, len(out), self.lanes):
                x = state[: len(out) - i]
                slot = x & mask
                found = t.slots[slot]
                out[i : i + self.lanes] = found
                x >>= scale
                x *= t.by_id[found]
                x += slot - t.start[found]
                short = np.flatnonzero(x < _LOW)
                x[short] = x[short] << np.uint64(32) | self.words[word : word + len(short)]
                word += len(short)
                state[: len(x)] = x
            # a segment ends in the states of the next checkpoint, the last one in those that the encoder began with
            ends = self.checkpoints[low + len(parts) + 1][2] if begin + len(out) < self.n else np.full(self.lanes, _LOW, "<u8").tobytes()
            if zlib.crc32(out.astype("<u4")) != checksum or state.astype("<u8").tobytes() != ends:
                raise ValueError("a segment is damaged: its ids don't match their checksum")
            parts.append(out)
        return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), low * self.segment


# --- files -------------------------------------------------------------------------------------------------------------


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    folder = re.sub("^s3[an]://", "s3://", folder)
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_files(ids: DataFrame, folder: str, roll: int = ROLL, block: int = BLOCK, segment: int = SEGMENT, lanes: int = LANES) -> DataFrame:
    """Write rows of ``encoded`` into files of ``folder`` and return the stored index.

    Its rows: part, nth (of the first document of the file), file, offset and length of the block, file_bytes up to the
    block's end, first and n (place in the file and number of the segment's ids). A file holds documents that follow each
    other, whole; (part, nth) sorts the files by ascending doc_id. The table of frequencies has a row for each id of the
    vocabulary, which is why it may be collected.
    """
    counted = id_counts(ids).toPandas()
    packed = table_of(counted["id"].to_numpy(), counted["n"].to_numpy()).pack()
    fs, root = _file_system(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/frequencies", compression=None) as out:
        out.write(packed)
    shared = ids.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        fs.create_dir(root, recursive=True)
        table = Table.unpack(shared.value)
        out, name, at, first, key, due = None, "", 0, 0, (0, 0), (-1, -1)
        held: list[np.ndarray] = []
        size, starts, rows = 0, [], []

        def flush(last: bool) -> None:
            nonlocal held, size, starts, at, first
            while size >= block or (last and size):
                every = held[0] if len(held) == 1 else np.concatenate(held)
                now, later = every[:block], every[block:]
                inside, beyond = [s for s in starts if s[1] < len(now)], [(d, p - len(now), k) for d, p, k in starts if p >= len(now)]
                data = encode_block(now, inside, first, table, lanes, segment)
                out.write(data)
                step = struct.unpack_from(_HEAD, data)[3]
                rows.extend((*key, name, at, len(data), first + i, min(step, len(now) - i)) for i in range(0, len(now), step))
                at, first = at + len(data), first + len(now)
                held, size, starts = [later], len(later), beyond

        def close() -> None:
            nonlocal out
            if out is not None:
                flush(True)
                out.close()
                out = None

        def taken() -> Iterator[pa.RecordBatch]:
            nonlocal rows
            if rows:
                kinds = (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "nth", "file", "offset", "length", "first", "n"])
                rows = []

        for batch in chunks(batches, "ids"):
            for part, nth, doc, data, wide in zip(*(batch.column(k).to_pylist() for k in ("part", "nth", "doc_id", "ids", "wide")), strict=True):
                if (part, nth) != due or first + size >= roll:
                    close()
                if out is None:
                    name, key = f"{uuid.uuid4().hex}.ids", (part, nth)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(_MAGIC)
                    at, first, held, size, starts = len(_MAGIC), 0, [], 0, []
                due = part, nth + 1
                found = _numbers(data, wide)
                starts.append((doc, size, len(found)))
                held.append(found)
                size += len(found)
                if size >= block:
                    flush(False)
            yield from taken()
        close()
        yield from taken()

    return written(ids.select("part", "nth", "doc_id", "ids", "wide").mapInArrow(run, "part int, nth long, file string, offset long, length long, first long, n long"), "index")


def bases(index: DataFrame) -> DataFrame:
    """(file, base): the ids of all files before it. A row for each file, not for each document, meets in one window."""
    files = index.groupBy("part", "nth", "file").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_files(index: DataFrame, folder: str, task: int = TASK) -> DataFrame:
    """Decode the documents that begin in the index's segments: file, first (place in the file), doc_id, ids (32 bits each, little-endian).

    Segments are dealt in runs to as many tasks as their ids ask for, and decoding begins at their checkpoints; checksums
    that don't match are errors. ``index`` may be any selection of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        with fs.open_input_stream(f"{root}/frequencies", compression=None) as f:
            table = Table.unpack(f.read())
        opened = name = at = block = None

        def load(place: int) -> None:
            nonlocal at, block, after
            if at != place:
                opened.seek(place)
                head = opened.read(struct.calcsize(_HEAD))
                _, _, _, _, words, _, a, b, _ = struct.unpack(_HEAD, head)
                block, at, after = Block(head + opened.read(a + b + 4 * words), table), place, place + struct.calcsize(_HEAD) + a + b + 4 * words

        after = 0
        for batch in batches:
            for file, offset, first, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if file != name:
                    if opened is not None:
                        opened.close()
                    opened, name, at = fs.open_input_file(f"{root}/{file}"), file, None
                load(offset)
                low, high = first - block.first, first - block.first + n
                wanted = [s for s in block.starts if low <= s[1] < high]
                if not wanted:
                    continue
                begin, end = block.first + wanted[0][1], block.first + wanted[-1][1] + wanted[-1][2]
                wanted = [(d, block.first + p, k) for d, p, k in wanted]
                parts, place = [], begin
                while place < end:
                    found, skip = block.ids(place - block.first, end - block.first)
                    parts.append(found[place - block.first - skip :])
                    place = block.first + min(block.n, skip + len(found))
                    if place < end:
                        load(after)
                # the documents follow each other, so their ids are one buffer
                ends = np.cumsum([0, *(4 * k for _, _, k in wanted)], dtype=np.int32)
                data = np.concatenate(parts).astype("<u4")[: end - begin]
                column = pa.Array.from_buffers(pa.binary(), len(wanted), [None, pa.py_buffer(ends), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(wanted), pa.string()), pa.array([p for _, p, _ in wanted], pa.int64()), pa.array([d for d, _, _ in wanted], pa.int64()), column], ["file", "first", "doc_id", "ids"])
        if opened is not None:
            opened.close()

    ids, rows = index.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tasks = max(1, min(rows, max(-(-ids // task), index.sparkSession.sparkContext.defaultParallelism)))
    # a file's blocks are runs of one task; a block is never dealt to two
    dealt = index.select("file", "offset", "first", "n").repartition(tasks, "file", "offset").sortWithinPartitions("file", "first")
    return dealt.mapInArrow(run, "file string, first long, doc_id long, ids binary")


def write_and_read(docs: DataFrame, path: str) -> DataFrame:
    """Encode all documents, write the files, read them back: doc_id, start, n_tokens, ids_crc32, and the file.

    One row for each row of ``docs``. A null text is empty and has the end id only. Rows with a null id come first and keep
    it; rows of one id are told apart by their place. Other columns are not read; an empty table gives an empty one.
    """
    folder = new_path(docs.sparkSession, "token-files")
    index = write_files(encoded(docs, path), folder)
    found = read_files(index, folder).join(small(written(bases(index), "bases")), "file")
    return found.select("doc_id", (F.col("base") + F.col("first")).alias("start"), F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "file")
