"""WARC archives of pages: written with an index, read back by coalesced byte ranges.

Tasks write archives of gzip members, one a record, into the shared folder, and return an index row for each record:
file, offset, length, url and digest. An archive's name is its task attempt's own, and the index is stored before it is
used, so a repeated or lost attempt leaves a file that no row names. Reading starts at the index: the selected rows are
dealt by spans of the archives to as many tasks as their bytes ask for, sorted by offset, neighbouring ranges are joined
into one read, and the records are cut out of it.

Equal payloads of at least ``LEAST`` bytes are stored once, as the response of the smallest page_id; other pages with
that payload have a revisit record that names it.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import chunks, new_path, small, written

LEAST = 100
#: Bytes of an archive after which a task begins another.
ROLL = 64 << 20
#: Bytes between two wanted records that are read along rather than skipped.
GAP = 64 << 10
#: Bytes of one read at most, unless a single record is longer; also the span of an archive whose records one task reads.
SPAN = 8 << 20
#: Bytes of records that a reading task gets, about.
TASK = 64 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format


def arrow_uri(path: str) -> str:
    """A folder as Arrow names it: Hadoop's s3a and s3n are s3 there, and a bare path is a file's."""
    path = re.sub("^s3[an]://", "s3://", path)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Any store that Arrow opens by its URI: a shared folder (file:), an object store or HDFS."""
    return pafs.FileSystem.from_uri(arrow_uri(path))


def record(page_id: int | None, url: str | None, body: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit (refers_to is set) has no payload of its own but tells its size and digest."""
    clean = "".join(c for c in url or "" if c not in "\r\n")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http if refers_to is not None else http + body
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {clean} {digest}')}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {clean}"] if url is not None else []
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(body)}"]
    lines += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    lines += [f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page: {refers_to}"] if refers_to is not None else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers (names in lower case) and the payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def payload(html: Column) -> Column:
    return F.coalesce(html.cast("string"), F.lit(""))


def repeats(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that revisit another's payload; ``pages`` has page_id and html.

    Digests are summed up before the shuffle, so a payload that a third of all pages share is one row for each task. The
    sums are a table before they meet the pages, so that Spark can split the pages of such a payload.
    """
    hashed = written(pages.select("page_id", F.sha2(F.encode(payload(F.col("html")), "utf-8"), 256).alias("digest"), F.octet_length(payload(F.col("html"))).alias("n")).where(f"n >= {LEAST}"), "payloads")
    first = hashed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to != last").select("digest", "refers_to")
    return hashed.join(small(written(first, "first-pages")), "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll: int = ROLL) -> DataFrame:
    """Write a record for each row and return the stored index: file, offset, length, page_id, url, digest.

    A null html is an empty payload, a null url gives a record without target. Of repeated rows with the smallest
    page_id of a payload each is a response. A page with a null page_id is always one. Other columns are not read.
    """
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    again = written(repeats(source), "revisits")
    s, a = source.alias("s"), again.alias("a")
    digest = F.sha2(F.encode(payload(F.col("s.html")), "utf-8"), 256)
    todo = s.join(a, (F.col("s.page_id") == F.col("a.page_id")) & (digest == F.col("a.digest")), "left").select("s.page_id", "s.url", "s.html", "a.refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        fs.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in chunks(batches, "html"):
            rows = []
            for page, url, html, refers in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                body = (html or "").encode("utf-8", "surrogatepass")
                found = hashlib.sha256(body).hexdigest()
                member = gzip.compress(record(page, url, body, found, refers), compresslevel=1, mtime=0)
                out.write(member)
                rows.append((name, at, len(member), page, url, found))
                at += len(member)
                if at >= roll:
                    out.close()
                    out = None
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["file", "offset", "length", "page_id", "url", "digest"])
        if out is not None:
            out.close()

    return written(todo.mapInArrow(run, "file string, offset long, length long, page_id long, url string, digest string"), "index")


def read_records(selected: DataFrame, folder: str) -> DataFrame:
    """Read the records that index rows (file, offset, length) point to, by coalesced ranges.

    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null for revisits). The
    digest and size of a response are those of the bytes read; a record whose own digest differs is an error.
    """

    def ranges(rows: list[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
        """Runs of sorted ranges of one file, close to each other."""
        run: list[tuple[str, int, int]] = []
        for row in rows:
            if run and (row[0] != run[0][0] or row[1] - (run[-1][1] + run[-1][2]) > GAP or row[1] + row[2] - run[0][1] > SPAN):
                yield run
                run = []
            run.append(row)
        if run:
            yield run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        opened, name = None, None
        for batch in batches:
            for run in ranges(list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))):
                if run[0][0] != name:
                    if opened is not None:
                        opened.close()
                    name = run[0][0]
                    opened = fs.open_input_file(f"{root}/{name}")
                begin = run[0][1]
                opened.seek(begin)
                data = opened.read(max(o + n for _, o, n in run) - begin)
                out = []
                for _, offset, length in run:
                    headers, body = parse(zlib.decompress(data[offset - begin : offset - begin + length], 31))
                    kind, told = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
                    digest, size = (hashlib.sha256(body).hexdigest(), len(body)) if kind == "response" else (told, int(headers["x-payload-length"]))
                    if digest != told:
                        raise ValueError(f"a record of {name} at {offset} is damaged")
                    page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page")
                    out.append((page and int(page), headers.get("warc-target-uri"), size, digest, kind, refers and int(refers), body if kind == "response" else None))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if opened is not None:
            opened.close()

    size, rows = selected.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    # a number of its own, which Spark doesn't merge by the size of the index; few bytes still use all cores
    tasks = max(1, min(rows, max(-(-size // TASK), selected.sparkSession.sparkContext.defaultParallelism)))
    span = F.floor(F.col("offset") / max(1, min(SPAN, size // (4 * tasks))))
    dealt = selected.select("file", "offset", "length").repartition(tasks, "file", span).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read every record back, without the payloads.

    One row for each row of ``pages``; an empty table gives an empty one.
    """
    folder = new_path(pages.sparkSession, "warc")
    index = write_archives(pages, folder)
    return read_records(index, folder).drop("url", "payload")
