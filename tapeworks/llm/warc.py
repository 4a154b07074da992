"""WARC archives: a monolithic gzip normaliser with a sidecar offset index.

A crawl is first written as whole-file gzip streams, each record a response. The normaliser inflates
such a stream once, front to back, rewrites every record as a gzip member of its own (a revisit where
an equal payload is kept elsewhere) and writes an index of member offsets beside it. The archives are
read back member by member through the index. Records have the fields that WARC/1.1 demands, the page's
id as an extension field, and each file begins with a `warcinfo`. Files are written in a folder of their
own beside the archives and moved there when whole; an archive's bytes follow from the stream it
normalises, so a task that runs again puts the same file in the same place.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm._util import Stash
from tapeworks.sources.shared import delete_path, shared_path

#: A file is closed when its records reach this many bytes before compression.
ROLL_BYTES = 8 << 20
#: Tasks of a stage at most; a task takes as many files as come to it, one after the other.
MOST_TASKS = 1 << 14
READ_BYTES = 1 << 18
LEVEL_RAW, LEVEL_KEPT = 1, 6
#: Where files lie while they are written; deleted when all are whole.
OPEN = "_open"
SOFTWARE = "tapeworks"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _filesystem(path: str):
    """The file system of a path or URI, as far as pyarrow knows it (local, hdfs, s3, gcs), and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(path.replace("file:", "file://", 1) if path.startswith("file:") else "file://" + path)


class _Output:
    """A file that appears under its name only when whole."""

    def __init__(self, folder: str, name: str):
        self.fs, self.folder = _filesystem(folder)
        self.path, self.open = f"{self.folder}/{name}", f"{self.folder}/{OPEN}/{name}-{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.folder}/{OPEN}", recursive=True)
        self.stream = self.fs.open_output_stream(self.open, compression=None)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def close(self) -> None:
        from pyarrow import fs

        self.stream.close()
        try:
            self.fs.move(self.open, self.path)
        except OSError:
            # Another attempt of the task has put the same bytes there.
            there, here = self.fs.get_file_info([self.path, self.open])
            if there.type != fs.FileType.File or there.size != here.size:
                raise
            self.fs.delete_file(self.open)


def digest_of(payload: bytes) -> str:
    """The bare upper-case base32 SHA-1 of a payload."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _join(head: list[str], block: bytes) -> bytes:
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(kind: str, record_id: str, date: str, page_id: int | None, url: str | None, digest: str, length: int, payload: bytes = b"", refers_to: tuple[int, str] | None = None) -> bytes:
    """One WARC record: HTTP head and payload for a response, HTTP head alone for a revisit of (page, record id)."""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {date}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:?#[]@!$&()*+,;=~-._')}")
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {length}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{refers_to[1]}>", f"X-Refers-To-Page-ID: {refers_to[0]}"]
    return _join(head, _HTTP % length + payload)


def warcinfo(name: str, date: str) -> bytes:
    """The record that a file begins with; its id follows from the file's name."""
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return _join(head, f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\n".encode())


def parse(data: bytes | bytearray, at: int = 0) -> tuple[dict[str, str], bytes, int] | None:
    """Head, block and end of the record at a position; None if it is not whole yet."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
    size = int(head["Content-Length"])
    stop = end + 4 + size + 4
    if len(data) < stop:
        return None
    return head, bytes(data[end + 4 : end + 4 + size]), stop


def payload_of(block: bytes) -> bytes:
    return block[block.index(b"\r\n\r\n") + 4 :]


def stream_records(folder: str, name: str):
    """The records of a whole-file gzip stream, inflated once in small reads, whether it has one member or many."""
    fs, base = _filesystem(folder)
    inflate, held, at = zlib.decompressobj(31), bytearray(), 0
    with fs.open_input_stream(f"{base}/{name}", compression=None) as source:
        while data := source.read(READ_BYTES):
            while data:
                if inflate.eof:
                    inflate = zlib.decompressobj(31)
                held += inflate.decompress(data)
                data = inflate.unused_data
            while (got := parse(held, at)) is not None:
                yield got[0], got[1]
                at = got[2]
            del held[:at]
            at = 0
    if not inflate.eof or held:
        raise ValueError(f"{name} ends inside a record")


_PLACE = ["file", "ordinal", "page_id", "record_id", "length", "sha1", "sha256"]


def _write_raw(folder: str, roll: int, date: str):
    """Pages to whole-file gzip streams; rows tell each record's place and payload digests."""

    def run(batches):
        out = None
        rows: list[tuple] = []

        def close():
            nonlocal out
            out[1].write(out[2].flush())
            out[1].close()
            done = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()])], _PLACE
            )
            out = None
            rows.clear()
            return done

        for batch in batches:
            for i in range(len(batch)):
                page_id, url, page = (c[i].as_py() for c in batch.columns)
                payload = (page or "").encode()
                sha1 = digest_of(payload)
                own = str(uuid.uuid4())
                data = record("response", own, date, page_id, url, sha1, len(payload), payload)
                if out is None:
                    name = f"crawl-{uuid.uuid4().hex}.warc.gz"
                    out = [name, _Output(folder, name), zlib.compressobj(LEVEL_RAW, zlib.DEFLATED, 31), 0]
                    out[1].write(out[2].compress(warcinfo(name, date)))
                out[1].write(out[2].compress(data))
                out[3] += len(data)
                rows.append((out[0], len(rows), page_id, own, len(payload), sha1, hashlib.sha256(payload).hexdigest()))
                if out[3] >= roll:
                    yield close()
        if out is not None:
            yield close()

    return run


def _normalise(raw: str, folder: str, date: str):
    """Whole-file streams to one member a record, with a sidecar index; rows (file, records)."""

    def run(batches):
        for batch in batches:
            for name, revisits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                refers = {r["ordinal"]: (r["keep"], r["record_id"]) for r in revisits or []}
                final = name.replace("crawl-", "kept-")
                out, at, n, index = _Output(folder, final), 0, 0, []

                def put(data: bytes) -> int:
                    member = gzip.compress(data, LEVEL_KEPT, mtime=0)
                    out.write(member)
                    return len(member)

                at += put(warcinfo(final, date))
                for head, block in stream_records(raw, name):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    page, own, digest, keep = head.get("X-Page-ID"), head["WARC-Record-ID"][10:-1], head["WARC-Payload-Digest"][5:], refers.get(n)
                    kind = "response" if keep is None else "revisit"
                    payload = payload_of(block) if keep is None else b""
                    size = put(record(kind, own, head["WARC-Date"], None if page is None else int(page), head.get("WARC-Target-URI"), digest, int(head["X-Payload-Length"]), payload, keep))
                    index.append(f"{page or ''} {at} {size} {kind} {digest}\n")
                    at, n = at + size, n + 1
                out.close()
                side = _Output(folder, final + ".idx")
                side.write("".join(index).encode())
                side.close()
                yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([n], pa.int64())], ["file", "records"])

    return run


def _read_back(folder: str):
    """Records through the sidecar index, each from its own member, with digests checked."""

    def run(batches):
        fs, base = _filesystem(folder)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_stream(f"{base}/{name}.idx", compression=None) as f:
                    index = [line.split(" ") for line in f.read().decode().splitlines()]
                if len(index) != records:
                    raise ValueError(f"{name}: {len(index)} index lines for {records} records")
                rows = []
                with fs.open_input_file(f"{base}/{name}") as f:
                    for page, at, size, kind, digest in index:
                        head, block, _ = parse(gzip.decompress(f.read_at(int(size), int(at))))
                        length, keep = int(head["X-Payload-Length"]), None
                        if kind == "response":
                            payload = payload_of(block)
                            length = len(payload)
                            if digest_of(payload) != digest:
                                raise ValueError(f"{name} at {at}: digest differs")
                        else:
                            keep = int(head["X-Refers-To-Page-ID"])
                        if head["WARC-Type"] != kind or head.get("X-Page-ID", "") != page:
                            raise ValueError(f"{name} at {at}: index and record differ")
                        rows.append((int(page) if page else None, length, head["WARC-Payload-Digest"][5:], kind, keep, name, int(at), int(size)))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "at", "size"])

    return run


def archive_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, roll_bytes: int = ROLL_BYTES, date: datetime | None = None) -> DataFrame:
    """Writes every page to archives and returns what is read back from them, one row a page.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, file, at, size); `folder` (a fresh
    one in the shared folder by default) keeps the archives, `date` (now by default) is that of all records. Of equal payloads of at least
    `least_bytes` the largest page_id is the response and the others revisit it; equality is length,
    SHA-1 and SHA-256. Null html is an empty payload. A null id revisits like any other and is a
    response where its group has no id; rows that repeat the kept id are all responses. An empty table
    writes no archive and gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    stash = Stash(spark, "warc")
    stamp = (date or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    raw, kept = shared_path(spark, "warc-raw"), folder or shared_path(spark, "warc")
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    places = stash.write(slim.mapInArrow(_write_raw(raw, roll_bytes, stamp), "file string, ordinal long, page_id long, record_id string, length long, sha1 string, sha256 string"), "places")
    key = ["length", "sha1", "sha256"]
    last = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id")))
    groups = places.groupBy(*key).agg(last.alias("last"), F.count("*").alias("n")).where(F.col("n") > 1).where(F.col("length") >= least_bytes)
    groups = groups.select(*key, F.col("last.page_id").alias("keep"), F.col("last.record_id").alias("kept_record"))
    groups = stash.write(groups, "groups")  # so that the rows of a hot payload can be split between tasks
    again = places.join(groups, key).where("keep is not null and not (page_id <=> keep)")
    per_file = again.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("ordinal", "keep", F.col("kept_record").alias("record_id")))).alias("revisits"))
    files = places.select("file").distinct()
    ways = max(1, min(files.count(), MOST_TASKS))
    files = files.join(per_file, "file", "left").repartition(ways)
    archives = stash.write(files.mapInArrow(_normalise(raw, kept, stamp), "file string, records long"), "archives")
    delete_path(spark, raw)
    delete_path(spark, f"{kept}/{OPEN}")
    stash.drop(places)
    return archives.repartition(ways).mapInArrow(_read_back(kept), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, at long, size long")
