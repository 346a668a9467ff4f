"""Web archives in ZIP packages: writing, and reading by byte ranges.

A package (WACZ layout) is a ZIP file with stored members: the records as
``archive/data.warc.gz``, each record a gzip member of its own, an index of
offsets and lengths, a page list and a manifest. The reader fetches the tail of
the file, follows the end-of-directory record or its ZIP64 form to the central
directory, finds the stored members, and then fetches single records by their
range. Nothing is unpacked to disk.

Files are reached through Arrow file systems, so ``root`` may be a shared folder
or an object store (file, s3, gs, hdfs addresses). A task writes under a name of
its attempt and moves the finished file to a name that depends only on its
partition, so a repeated task replaces its own file.

NULL payloads count as empty, NULL urls are left out, rows that repeat a page and
its payload are written each, an empty table gives no archive and no rows, other
columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import col
from tidyloom.session import cut_lineage

DATA, INDEX, PAGES = "archive/data.warc.gz", "indexes/index.cdx.gz", "pages/pages.jsonl"
PACKAGE_BYTES = 32_000_000
GATHER_BYTES = 1_000_000
DATE = "2024-01-01T00:00:00Z"


def file_system(address: str):
    """Arrow file system and path of an address (a bare path is local or mounted)."""
    from pyarrow import fs

    address = re.sub(r"^file:/*", "file:///", address)
    return fs.FileSystem.from_uri(address if "://" in address else f"file://{address}")


# --- records -----------------------------------------------------------------------------


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit keeps the headers of the page but not its payload."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}"] if url else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>",
           "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Page, payload size and digest, type and reference of one unpacked record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?mi)^Content-Length: (\d+)", http)[1])
    kind = fields["WARC-Type"]
    if kind == "response":
        if len(payload) != size:
            raise ValueError(f"payload of {len(payload)} bytes, {size} announced")
        digest = hashlib.sha1(payload).hexdigest()
    else:
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")

    def page(name: str):
        found = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))
        return int(found[1]) if found else None

    return {
        "page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload": payload,
        "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": page("WARC-Refers-To") if kind == "revisit" else None,
    }


# --- packages ----------------------------------------------------------------------------


class Package:
    """A package in the making, held in memory up to a size."""

    def __init__(self):
        self.data, self.index, self.pages = io.BytesIO(), [], []

    def add(self, page_id, url, payload: bytes, digest: str, refers_to) -> None:
        packed = gzip.compress(record(page_id, url, payload, digest, refers_to), 6, mtime=0)
        entry = {"offset": self.data.tell(), "length": len(packed), "digest": f"sha1:{digest}"}
        self.index.append(f"{page_id} {json.dumps(entry)}")
        self.pages.append(json.dumps({"id": page_id, "url": url}))
        self.data.write(packed)

    def finish(self) -> bytes:
        members = {
            DATA: self.data.getvalue(),
            INDEX: gzip.compress("\n".join(self.index).encode(), 6, mtime=0),
            PAGES: "\n".join(self.pages).encode(),
        }
        listing = [
            {"path": k, "hash": f"sha256:{hashlib.sha256(v).hexdigest()}", "bytes": len(v)}
            for k, v in members.items()
        ]
        members["datapackage.json"] = json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": listing}).encode()
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, body in members.items():
                z.writestr(zipfile.ZipInfo(name), body)
        return out.getvalue()


def directory(read, size: int) -> dict[str, tuple[int, int]]:
    """Offset and length of each stored member's bytes.

    ``read(offset, length)`` fetches a range of the file of ``size`` bytes.
    """
    tail_from = max(0, size - 65_557 - 20)
    tail = read(tail_from, size - tail_from)
    at = tail.rfind(b"PK\5\6", 0, max(0, len(tail) - 18))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\6\7":
        end = struct.unpack_from("<Q", tail, at - 12)[0]
        wide = read(end, 56)
        if wide[:4] != b"PK\6\6":
            raise ValueError("broken ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", wide, 32)
    listing, members, p = read(start, length), {}, 0
    for _ in range(count):
        if listing[p : p + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        method, packed, full, n, m, k, local = struct.unpack_from("<10xH8xIIHHH8xI", listing, p)
        name = listing[p + 46 : p + 46 + n].decode()
        extra, q = listing[p + 46 + n : p + 46 + n + m], 0
        while q + 4 <= len(extra):
            tag, span = struct.unpack_from("<HH", extra, q)
            if tag == 1:  # only the fields that did not fit are there, in this order
                wide = iter(struct.unpack_from(f"<{span // 8}Q", extra, q + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            q += 4 + span
        if method == 0 and packed == full:
            head = read(local, 30)
            skip = sum(struct.unpack_from("<HH", head, 26))
            members[name] = (local + 30 + skip, full)
        p += 46 + n + m + k
    return members


def locate_records(read, size: int) -> list[tuple[int, int]]:
    """Ranges of all records of a package, by its index."""
    members = directory(read, size)
    at, length = members[INDEX]
    base, limit = members[DATA]
    ranges = []
    for line in gzip.decompress(read(at, length)).decode().splitlines():
        entry = json.loads(line.split(" ", 1)[1])
        if entry["offset"] + entry["length"] > limit:
            raise ValueError("record outside its member")
        ranges.append((base + entry["offset"], entry["length"]))
    return ranges


# --- jobs --------------------------------------------------------------------------------


def revisits(df: DataFrame, least: int = 1000) -> DataFrame:
    """``page_id, digest, refers_to`` of pages whose payload a larger page_id has too.

    ``df`` has ``page_id, digest, size``. Counts are combined before the shuffle;
    only digests met at different pages are joined back.
    """
    big = df.where(F.col("size") >= least)
    first = big.groupBy("digest").agg(F.min("page_id").alias("__a"), F.max("page_id").alias("refers_to"))
    first = first.where(F.col("__a") < F.col("refers_to")).drop("__a")
    pairs = big.select("page_id", "digest").join(first, "digest")
    return pairs.where(F.col("page_id") < F.col("refers_to")).distinct()


def write_archives(
    pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least: int = 1000, package_bytes: int = PACKAGE_BYTES,
) -> DataFrame:
    """Write all pages as packages under ``root``; returns ``path, records``, materialised."""
    rows = pages.select(
        col(id_col).cast("bigint").alias("page_id"), col(url_col).cast("string").alias("url"),
        F.coalesce(col(payload_col).cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1("html"))
    decided = revisits(rows.select("page_id", "digest", F.octet_length("html").alias("size")), least)
    told = rows.join(decided, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, base = file_system(root)
        made, package = 0, Package()

        def close() -> pa.RecordBatch:
            name = f"{base}/part-{task.partitionId():06d}-{made:04d}.wacz"
            draft = f"{base}/.draft-{task.taskAttemptId()}-{made:04d}"
            with files.open_output_stream(draft) as f:
                f.write(package.finish())
            files.move(draft, name)
            return pa.RecordBatch.from_pydict({"path": [name], "records": [len(package.index)]})

        for batch in batches:
            for r in batch.to_pylist():
                package.add(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["refers_to"])
                if package.data.tell() >= package_bytes:
                    yield close()
                    made, package = made + 1, Package()
        if package.index:
            yield close()

    files, base = file_system(root)
    files.create_dir(base, recursive=True)
    return cut_lineage(told.mapInArrow(write, "path string, records bigint"))


def read_archives(spark, manifest: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """Records of the packages in ``manifest``.

    First each package's directory and index give the ranges of its records;
    ranges are then dealt out in runs of about a megabyte, which are fetched and
    parsed one record at a time.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = file_system(root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with files.open_input_file(path) as f:
                    found = locate_records(lambda at, n, f=f: f.read_at(n, at), f.size())
                runs, held = [], 0
                for at, n in found:
                    if not runs or held > GATHER_BYTES:
                        runs.append([])
                        held = 0
                    runs[-1].append((at, n))
                    held += n
                yield pa.RecordBatch.from_pydict({
                    "path": [path] * len(runs),
                    "at": pa.array([[a for a, _ in r] for r in runs], pa.list_(pa.int64())),
                    "length": pa.array([[n for _, n in r] for r in runs], pa.list_(pa.int64())),
                })

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = file_system(root)
        for batch in batches:
            for run in batch.to_pylist():
                with files.open_input_file(run["path"]) as f:
                    got = [
                        parse_record(zlib.decompress(f.read_at(n, at), 31))
                        for at, n in zip(run["at"], run["length"])
                    ]
                if not payloads:
                    for r in got:
                        r["payload"] = None
                yield pa.RecordBatch.from_pylist(got, schema=ARROW)

    located = manifest.repartition("path").mapInArrow(ranges, "path string, at array<bigint>, length array<bigint>")
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = located.repartition(tasks, F.xxhash64("path", F.element_at("at", 1)))
    return dealt.mapInArrow(fetch, RECORD)


RECORD = (
    "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint"
)
ARROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
])


def fresh_root(folder: str) -> str:
    return f"{folder.rstrip('/')}/archives-{uuid.uuid4().hex}"
