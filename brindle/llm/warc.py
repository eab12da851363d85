"""WARC records in ZIP packages, and a reader that needs no extraction.

A package is a ZIP of stored members: ``archive/data.warc.gz`` (one gzip member per record) and
``indexes/index.cdxj`` (id, offset and length of each record).  The reader parses the end record,
the ZIP64 locator and end record and the central directory (with ZIP64 extra fields), finds where
the stored bytes of the members begin, reads the index and then single records by range.

Writing is idempotent: each task attempt writes a package of its own and only packages whose
names it returned are read, so a lost executor costs a rewrite of its packages and no more.

Defined results: null html is an empty payload; of equal payloads the smallest non-null
``page_id`` responds (rows that repeat that id respond too) and, where all ids are null, all do;
null url is written as empty; an empty table makes no package.  Only ``page_id``, ``url`` and
``html`` are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_folder, table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payloads under this many bytes are written in full even if equal ones exist.
LEAST_REVISIT = 0
#: Records of a package that are read by one task, and reading tasks a core at most.
READ_RECORDS, READ_TASKS = 500, 8


def open_for(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class ZipWriter:
    """Stored members, streamed: sizes follow the data and the directory has ZIP64 fields."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.members.append([name.encode(), self.at, 0, 0])
        self._put(struct.pack("<4s5H3I2H", b"PK\3\4", 45, 8, 0, 0, 33, 0, 0, 0, len(name.encode()), 0) + name.encode())

    def write(self, data: bytes) -> None:
        member = self.members[-1]
        member[2], member[3] = zlib.crc32(data, member[2]), member[3] + len(data)
        self._put(data)

    def end(self) -> None:
        _, _, crc, size = self.members[-1]
        self._put(struct.pack("<4sI2Q", b"PK\7\10", crc, size, size))

    def close(self) -> None:
        start = self.at
        for name, offset, crc, size in self.members:
            extra = struct.pack("<2H3Q", 1, 24, size, size, offset)
            self._put(struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45, 8, 0, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra)
        end, n = self.at, len(self.members)
        self._put(struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, end - start, start))
        self._put(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        self._put(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))


class ZipReader:
    """The directory of a ZIP, and ranges of its stored members."""

    def __init__(self, file):
        self.file = file
        self.size = file.seek(0, io.SEEK_END) or file.tell()
        tail = self.at(max(0, self.size - 65_557 - 20), 65_557 + 20)
        end = tail.rfind(b"PK\5\6")
        if end < 0:
            raise ValueError("no end of central directory")
        n, length, offset = struct.unpack_from("<10xH2I", tail, end)
        if end >= 20 and tail[end - 20 : end - 16] == b"PK\6\7":
            where = struct.unpack_from("<8xQ", tail, end - 20)[0]
            record = self.at(where, 56)
            if record[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end record")
            n, length, offset = struct.unpack_from("<32x3Q", record)
        self.members = dict(self._directory(self.at(offset, length), n))

    def at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    @staticmethod
    def _directory(data: bytes, n: int) -> Iterator[tuple[str, tuple[int, int, int]]]:
        at = 0
        for _ in range(n):
            if data[at : at + 4] != b"PK\1\2":
                raise ValueError("bad central directory")
            method, packed, size, names, extras, comments, offset = struct.unpack_from("<10xH8x2I3H8xI", data, at)
            name = data[at + 46 : at + 46 + names].decode()
            extra, k = data[at + 46 + names : at + 46 + names + extras], 0
            while k + 4 <= len(extra):
                kind, length = struct.unpack_from("<2H", extra, k)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, k + 4))
                    size = next(wide) if size == 0xFFFFFFFF else size
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    offset = next(wide) if offset == 0xFFFFFFFF else offset
                k += 4 + length
            yield name, (method, packed, offset)
            at += 46 + names + extras + comments

    def start_of(self, name: str) -> tuple[int, int]:
        method, size, offset = self.members[name]
        if method:
            raise ValueError(f"{name} is not stored")
        names, extras = struct.unpack_from("<26x2H", self.at(offset, 30))
        return offset + 30 + names + extras, size

    def read(self, name: str) -> bytes:
        return self.at(*self.start_of(name))


def record_of(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("X-Payload-Length", str(len(payload)))]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        body += payload
    else:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head.append(("Content-Length", str(len(body))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(headers["Content-Length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes packages of ``page_id, url, payload, digest, refers_to``; returns what to read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        uri = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.wacz"
        out, archive, index, at = None, None, [], 0
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive is None:
                    system, path = open_for(uri)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path)
                    archive = ZipWriter(out)
                    archive.begin(DATA)
                data = gzip.compress(record_of(page_id, url, payload.encode(), base64.b32encode(bytes.fromhex(digest)).decode(), refers_to), 1, mtime=0)
                archive.write(data)
                index.append(json.dumps({"id": page_id, "offset": at, "length": len(data)}))
                at += len(data)
        if archive is not None:
            archive.end()
            archive.begin(INDEX)
            archive.write("\n".join(index).encode())
            archive.end()
            archive.close()
            out.close()
            ends = [0, *np.cumsum([len(line) + 1 for line in index]).tolist()]
            firsts = range(0, len(index), READ_RECORDS)
            lasts = [min(f + READ_RECORDS, len(index)) for f in firsts]
            yield pa.RecordBatch.from_arrays([pa.array([uri] * len(lasts)), pa.array([ends[f] for f in firsts], pa.int64()), pa.array([ends[n] - 1 for n in lasts], pa.int64())], ["path", "first", "last"])

    return pages.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, first long, last long")


def dealt(packages: DataFrame) -> DataFrame:
    """Reading tasks: a package's pieces go to different ones, a stated number, which stays as it is."""
    spark = packages.sparkSession
    tasks = min(packages.count(), READ_TASKS * spark.sparkContext.defaultParallelism)
    return packages.repartition(max(tasks, 1), "path", "first")


def read(packages: DataFrame, with_payload: bool = True) -> DataFrame:
    """Range-reads the records that ``first`` to ``last`` of the index of ``path`` list, in bytes."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", url string, payload string" if with_payload else "")
    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.string())][: 7 if with_payload else 5])

    def number(urn: str) -> int | None:
        return int(urn) if (urn := urn.removeprefix("<urn:page:").removesuffix(">")) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, name = open_for(path)
                rows = []
                with system.open_input_file(name) as file:
                    archive = ZipReader(file)
                    base, _ = archive.start_of(DATA)
                    entries, _ = archive.start_of(INDEX)
                    for line in archive.at(entries + first, last - first).decode().split("\n"):
                        entry = json.loads(line)
                        headers, payload = parse(gzip.decompress(archive.at(base + entry["offset"], entry["length"])))
                        original = headers["WARC-Type"] == "response"
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if original else headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        row = {"page_id": number(headers["WARC-Record-ID"]), "payload_bytes": len(payload) if original else int(headers["X-Payload-Length"]), "payload_digest": digest, "record_type": headers["WARC-Type"], "refers_to": None if original else number(headers["WARC-Refers-To"])}
                        rows.append(row | {"url": headers["WARC-Target-URI"], "payload": payload.decode() if original else None} if with_payload else row)
                        if len(rows) >= 500:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return packages.mapInArrow(run, schema)


def with_revisits(pages: DataFrame, folder: str) -> DataFrame:
    """Adds ``payload``, ``digest`` and ``refers_to``.

    Only digests that occur more than once meet the pages again.  They are counted with partial
    aggregation and written out, so the planner knows their size and broadcasts them only under
    its threshold; beyond it the join is dealt by digest and adaptive execution splits hot ones.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"), F.sha1(F.encode(payload, "utf-8")).alias("digest"))
    groups = plain.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
    groups.where("n > 1 AND original IS NOT NULL").select("digest", "original").write.mode("overwrite").parquet(folder)
    repeated = pages.sparkSession.read.parquet(folder)
    return plain.join(repeated, "digest", "left").select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original")).alias("refers_to"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    packages = cut(write(with_revisits(table(spark, sf_dir, "pages"), f"{folder}/repeated"), f"{folder}/packages"))
    return read(dealt(packages), with_payload=False)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS original FROM p)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS INTEGER) >> CAST(5 * (3 - (i % 4)) AS INTEGER)) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
FROM f
"""
