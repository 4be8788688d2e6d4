"""WARC archives with a two-level capture index.

Writing: equal payloads are one ``response`` (smallest page id) and ``revisit``
records that refer to it; every task writes one file of records, each its own gzip
member, and returns where they lie.  Index: captures are sorted by reversed-host
URL key over range partitions; each partition becomes one shard file of compressed
blocks of lines, with a sparse directory (first key and place of each block) at its
end.  Lookup: binary search over the shards' first keys, then over a shard's
directory, then within the one block read, and only then range reads of records.

Files lie in the shared folder and are renamed into place when complete, so a lost
executor or a second attempt never leaves half a file under a name in use.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.llm.common import Workspace, map_batches, text_or_empty

#: Lines of one compressed index block.
BLOCK_LINES = 500
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122, URLs
_DATE = "2020-01-01T00:00:00Z"


@lru_cache(maxsize=8)
def _filesystem(scheme_root: str) -> pafs.FileSystem:
    return pafs.FileSystem.from_uri(scheme_root)[0]


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path) of a shared place: local, HDFS or an object store."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    root = "/".join(uri.split("/", 3)[:3]) + "/"
    return _filesystem(root), pafs.FileSystem.from_uri(uri)[1]


class _NewFile:
    """A file that gets its name when it is complete."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = _at(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.part = self.path + ".part"
        self.out, self.size = self.fs.open_output_stream(self.part), 0

    def write(self, data: bytes) -> int:
        start = self.size
        self.out.write(data)
        self.size += len(data)
        return start

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def digest_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Reversed-host key of a URL: ``com,example,www)/path?query``; null is ``-``."""
    if url is None:
        return "-"
    clean = quote(url.strip(), safe="!#$%&'()*+,/:;=?@[]~-._|")
    try:
        parts = urlsplit(clean)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return clean or "-"
    if not host:
        return clean or "-"
    key = ",".join(reversed(host.split(".")))
    if port and port != {"http": 80, "https": 443}.get(parts.scheme):
        key += f":{port}"
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def capture_key(url: str | None, page_id: int | None) -> str:
    """Sort key of one capture: the URL key, a space, the page id in order."""
    return f"{url_key(url)} " + ("-" if page_id is None else f"{page_id + (1 << 63):020d}")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC record; ``first`` is the page it revisits, or None for a response.

    A revisit holds the response's HTTP header without the payload, so its length
    field still tells the full payload's length.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url.strip(), safe='!#$%&()*+,/:;=?@[]~-._|' + chr(39))}")
    if page_id is not None:
        head.append(f"WARC-X-Page-ID: {page_id}")
    if first is not None:
        head += [f"WARC-Refers-To: {_record_id(first, digest)}", f"WARC-X-Refers-To-Page-ID: {first}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http + (payload if first is None else b"")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Capture:
    """What a record read back says; payload is empty for a revisit."""

    page_id: int | None
    kind: str
    digest: str
    refers_to: int | None
    payload_bytes: int
    payload: bytes


def parse(raw: bytes) -> Capture:
    """Parse one record; the payload of a response is digested anew."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (digest_base32(payload) != digest or len(payload) != length):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return Capture(number("WARC-X-Page-ID"), fields["WARC-Type"], digest, number("WARC-X-Refers-To-Page-ID"), length, payload)


MANIFEST = "key string, file string, offset long, length long"


def write_archives(pages: DataFrame, place: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write a record a row of (page_id, url, html); returns the manifest, unmaterialised.

    Null html is an empty payload, a null url has no target and the key ``-``.
    Rows with a null page id revisit the group's smallest id; where a group has
    none, each is a response, as are rows that repeat the smallest id.
    """
    got = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(text_or_empty("html"), "utf-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    # one row a digest; the partial aggregate leaves one a task for a hot payload
    firsts = got.filter(F.octet_length("payload") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    joined = got.join(firsts, "digest", "left").select("page_id", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{place}/warc/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out = None
        rows: list[tuple[str, str, int, int]] = []
        for batch in batches:
            for page_id, url, payload, first in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out = out or _NewFile(name)
                member = gzip.compress(record(page_id, url, payload, digest_base32(payload), None if first == page_id else first), 5, mtime=0)
                rows.append((capture_key(url, page_id), name, out.write(member), len(member)))
        if out:
            out.close()
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000], strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "file", "offset", "length"])

    return joined.mapInArrow(run, MANIFEST)


@dataclass(frozen=True)
class CaptureIndex:
    """The shards of an index, by first key: one entry a range partition."""

    first_keys: list[str]
    files: list[str]


def _write_shard(name: str, lines: Iterator[str]) -> tuple[str, str, int] | None:
    out, directory, block = None, [], []

    def flush() -> None:
        data = zlib.compress("\n".join(block).encode(), 6)
        directory.append((block[0].split("\t", 1)[0], out.write(data), len(data)))
        block.clear()

    for line in lines:
        out = out or _NewFile(name)
        block.append(line)
        if len(block) == BLOCK_LINES:
            flush()
    if out is None:
        return None
    if block:
        flush()
    packed = zlib.compress(json.dumps(directory).encode(), 6)
    start = out.write(packed)
    out.write(struct.pack("<QQ", start, len(packed)))
    out.close()
    return directory[0][0], name, len(directory)


def build_index(manifest: DataFrame, place: str) -> CaptureIndex:
    """Sort the captures by key and write one shard file a range partition.

    ``manifest`` must be a written table.  The driver gets one row a shard.
    """
    spark = manifest.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        lines = ("\t".join(map(str, row)) for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        got = _write_shard(f"{place}/index/shard-{context.partitionId():06d}-{context.taskAttemptId()}.idx", lines)
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in got], names=["first_key", "file", "blocks"])

    rows = manifest.select("key", "file", "offset", "length").repartitionByRange(shards, "key").sortWithinPartitions("key").mapInArrow(run, "first_key string, file string, blocks long").collect()
    rows.sort(key=lambda r: r.first_key.encode())
    return CaptureIndex([r.first_key for r in rows], [r.file for r in rows])


class IndexReader:
    """Binary search in an index; keeps the last directories, blocks and open files."""

    def __init__(self, index: CaptureIndex) -> None:
        self.index = index
        self.first = [k.encode() for k in index.first_keys]
        self.directory = lru_cache(maxsize=16)(self._directory)
        self.block = lru_cache(maxsize=32)(self._block)
        self.file = lru_cache(maxsize=64)(self._open)

    @staticmethod
    def _open(uri: str) -> pa.NativeFile:
        fs, path = _at(uri)
        return fs.open_input_file(path)

    def _directory(self, shard: int) -> tuple[list[bytes], list[tuple[int, int]]]:
        f = self.file(self.index.files[shard])
        start, size = struct.unpack("<QQ", f.read_at(16, f.size() - 16))
        entries = json.loads(zlib.decompress(f.read_at(size, start)))
        return [e[0].encode() for e in entries], [(e[1], e[2]) for e in entries]

    def _block(self, shard: int, k: int) -> tuple[list[bytes], list[bytes]]:
        start, size = self.directory(shard)[1][k]
        lines = zlib.decompress(self.file(self.index.files[shard]).read_at(size, start)).split(b"\n")
        return [x.split(b"\t", 1)[0] for x in lines], lines

    def find(self, low: bytes, high: bytes) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of captures with low <= key < high."""
        shard = max(0, bisect.bisect_left(self.first, low) - 1)
        while shard < len(self.first) and self.first[shard] < high:
            firsts = self.directory(shard)[0]
            k = max(0, bisect.bisect_left(firsts, low) - 1)
            while k < len(firsts) and firsts[k] < high:
                keys, lines = self.block(shard, k)
                for i in range(bisect.bisect_left(keys, low), bisect.bisect_left(keys, high)):
                    _, file, offset, length = lines[i].decode().split("\t")
                    yield file, int(offset), int(length)
                k += 1
            shard += 1

    def url(self, url: str | None) -> list[Capture]:
        """All captures of a URL."""
        key = url_key(url).encode()
        return [self.read(*x) for x in self.find(key + b" ", key + b"!")]

    def read(self, file: str, offset: int, length: int) -> Capture:
        return parse(gzip.decompress(self.file(file).read_at(length, offset)))


CAPTURES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_captures(keys: DataFrame, index: CaptureIndex) -> DataFrame:
    """The captures of the rows' ``key`` column: range reads, in the index's order.

    Distinct keys are dealt out in ranges, so one task meets a run of blocks.
    """
    spark = keys.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = IndexReader(index)
        for batch in batches:
            places = [p for key in batch.column(0).to_pylist() for p in reader.find(key.encode(), key.encode() + b"\0")]
            found = [reader.read(*p) for p in sorted(places)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c.page_id for c in found], pa.int64()), pa.array([c.payload_bytes for c in found], pa.int64()), pa.array([c.digest for c in found], pa.string()), pa.array([c.kind for c in found], pa.string()), pa.array([c.refers_to for c in found], pa.int64())],
                names=[x.split()[0] for x in CAPTURES.split(", ")],
            )

    return keys.select("key").distinct().repartitionByRange(shards, "key").sortWithinPartitions("key").mapInArrow(run, CAPTURES)


def keys_of(pages: DataFrame) -> DataFrame:
    """The capture keys of rows (page_id, url)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([capture_key(u, p) for p, u in zip(*[c.to_pylist() for c in batch.columns], strict=True)], pa.string())], names=["key"])

    return map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")), run, "key string")


def archive(pages: DataFrame, min_revisit_bytes: int = 0) -> tuple[CaptureIndex, DataFrame]:
    """Write archives and index of (page_id, url, html) to the shared folder: (index, manifest)."""
    work = Workspace(pages.sparkSession, "warc")
    manifest = work.put(write_archives(pages, work.path, min_revisit_bytes), "manifest")
    return build_index(manifest, work.path), manifest


def round_trip(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Archive all pages and read every capture back through the index.

    One row a page; repeated rows come back as often as they are; an empty table
    gives no files and no rows.
    """
    index, _ = archive(pages, min_revisit_bytes)
    return read_captures(keys_of(pages), index)
