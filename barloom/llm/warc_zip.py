"""WARC records in ZIP-packaged archives, and a reader that never unpacks them.

Each archive is a ZIP file with two stored members: archive/data.warc.gz (a gzip member for
each record) and indexes/index.cdx (offset and length of each record). The reader finds the
central directory from the end of the file (through the ZIP64 records where there are any),
takes the members' places from it, reads the index, and range-reads the records.

Records with equal payloads of at least 1000 bytes are written once: the one with the
largest id is the response, the others revisit it. Rows that share the largest id are all
responses; a null id never is while another id is there. Null texts are empty payloads,
null URLs have no target. Rows may repeat; each is a record. Payloads of any length are written
and read whole, one at a time. Empty tables give no archives. Only the named columns are read,
so that extra columns of any name do no harm.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import ship

LEAST_BYTES = 1000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Records are read in runs of about so many bytes.
RUN_BYTES = 2 * 1024 * 1024
#: Fixed values of the ZIP and WARC formats.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN_AT = "2024-01-01T00:00:00Z"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def record(kind: str, name: str, page: str | None, url: str | None, payload: bytes, digest: str, refers: str | None) -> bytes:
    """One WARC record, gzipped. A revisit has the HTTP head of its payload alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", WRITTEN_AT),
        ("WARC-Target-URI", None if url is None else quote(url, safe="%:/?#[]@!$&'()*+,;=~")),
        ("WARC-Payload-Digest", f"sha1:{sha1}"), ("WARC-Profile", REVISIT if kind == "revisit" else None),
        ("WARC-X-Page", page), ("WARC-X-Refers-To-Page", refers),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def parse_record(data: bytes) -> dict:
    """type, page, refers, payload (None for a revisit), payload_bytes and digest."""
    raw = zlib.decompress(data, 47)
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = body[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    said = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != int(said["Content-Length"]) or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is not what its digest says")
    return {
        "type": fields["WARC-Type"], "page": fields.get("WARC-X-Page"), "refers": fields.get("WARC-X-Refers-To-Page"),
        "payload": payload if response else None, "payload_bytes": int(said["Content-Length"]), "digest": digest,
        "url": fields.get("WARC-Target-URI"),
    }


class _Counted(io.RawIOBase):
    """A stream that only goes forward: what object stores offer for writing."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)


class _Pages:
    """A random-access file, read by ranges."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)


def directory(pages: _Pages) -> dict[str, tuple[int, int]]:
    """Data offset and size of each stored member, from the central directory."""
    tail_at = max(0, pages.size - 22 - 65535 - 20)
    tail = pages.read(tail_at, pages.size - tail_at)
    # a note may look like the record that it belongs to
    ends = lambda at: at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail)
    at = tail.rfind(END)
    while at >= 0 and not ends(at):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    entries, size, first = struct.unpack_from("<10xHLL", tail, at)
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
        end64 = pages.read(struct.unpack_from("<8xQ", tail, at - 20)[0], 56)
        if end64[:4] != END64:
            raise ValueError("no ZIP64 end of a central directory")
        entries, size, first = struct.unpack_from("<32xQQQ", end64)
    data, found, at = pages.read(first, size), {}, 0
    for _ in range(entries):
        if data[at : at + 4] != ENTRY:
            raise ValueError("no entry of a central directory")
        method, packed, full, n_name, n_extra, n_note, local = struct.unpack_from("<10xH8xLLHHH8xL", data, at)
        name = data[at + 46 : at + 46 + n_name].decode("utf-8")
        extra, k = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, k)
            if tag == 1:
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            k += 4 + n
        at += 46 + n_name + n_extra + n_note
        if method == 0:
            head = pages.read(local, 30)
            if head[:4] != LOCAL:
                raise ValueError(f"no local header of {name}")
            a, b = struct.unpack_from("<HH", head, 26)
            found[name] = (local + 30 + a + b, packed)
    return found


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> None:
    """Writes path/part-*.zip and the list of them, path/list. An archive is written under
    another name first, so that a task that is run again leaves one whole file."""
    from pyspark import TaskContext

    ship(pages.sparkSession)
    payload = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    keys = rows.where(F.octet_length("payload") >= LEAST_BYTES).select("id", "digest")
    heads = keys.groupBy("digest").agg(F.max("id").alias("head"), F.count("*").alias("n")).where("n > 1 and head is not null").drop("n")
    # ids that revisit, so that no payload is dealt by its digest
    refers = (
        keys.join(heads, "digest")
        .where(~F.col("id").eqNullSafe(F.col("head")))
        .select(F.col("id").alias("i"), F.col("digest").alias("d"), F.col("head").cast("string").alias("refers"))
        .distinct()
    )
    joined = rows.join(refers, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left").select(
        F.col("id").cast("string").alias("id"), "url", "payload", "digest", "refers"
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, folder = file_system(path)
        store.create_dir(folder, recursive=True)
        name, n, at, index = f"part-{part:05d}.zip", 0, 0, []
        draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out, zipfile.ZipFile(_Counted(out), "w", zipfile.ZIP_STORED) as packed:
            info = zipfile.ZipInfo(DATA)
            with packed.open(info, "w", force_zip64=True) as member:
                for batch in batches:
                    for page, url, body, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                        key = uuid.uuid5(uuid.NAMESPACE_OID, f"{page}/{part}/{n}")
                        data = record("revisit" if refers_to is not None else "response", str(key), page, url, body, digest, refers_to)
                        member.write(data)
                        index.append(f"{at} {len(data)}\n")
                        at += len(data)
                        n += 1
            packed.writestr(zipfile.ZipInfo(INDEX), "".join(index))
        if n:
            store.move(draft, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["name", "records"])
        else:
            store.delete_file(draft)

    joined.mapInArrow(write, "name string, records long").write.parquet(f"{path}/list")


def read_archives(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type
    and refers_to of every record. A response whose payload is not what its digest says
    fails the read."""
    ship(spark)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = file_system(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                full = f"{folder}/{name}"
                out: list[tuple] = []
                with store.open_input_file(full) as file:
                    pages = _Pages(file, file.size())
                    members = directory(pages)
                    base, _ = members[DATA]
                    lines = pages.read(*members[INDEX]).decode().splitlines()
                first, lengths = None, []
                for at, n in (map(int, x.split()) for x in lines):
                    if first is None:
                        first = at
                    lengths.append(n)
                    if at + n - first >= RUN_BYTES:
                        out.append((name, base + first, lengths))
                        first, lengths = None, []
                if lengths:
                    out.append((name, base + first, lengths))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64()))],
                    names=["name", "at", "lengths"],
                )

    names = ["type", "page", "refers", "payload", "payload_bytes", "digest", "url"]
    types = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = file_system(path)
        for batch in batches:
            for name, at, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{folder}/{name}") as file:
                    data = _Pages(file, file.size()).read(at, sum(lengths))
                found, k = [], 0
                for n in lengths:
                    found.append(parse_record(data[k : k + n]))
                    k += n
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in zip(names, types)], names=names)

    listed = spark.read.parquet(f"{path}/list").select("name")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    records = (
        listed.repartition(parts, "name")
        .mapInArrow(runs, "name string, at long, lengths array<long>")
        .repartition(parts, "name", "at")
        .mapInArrow(read, "type string, page string, refers string, payload binary, payload_bytes long, digest string, url string")
    )
    return records.select(
        F.col("page").cast(id_type).alias("page_id"), "url", "payload", "payload_bytes", F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers").cast(id_type).alias("refers_to"),
    )
