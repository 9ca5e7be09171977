"""WARC records in ZIP packages: writer, and a reader that never unpacks a package.

A package is a ZIP file whose members are stored: ``archive/data.warc.gz`` (one gzip member per record) and
``indexes/index.cdxj`` (one line per record with its offset and length). The reader finds the end-of-directory record
in the file's tail, or the ZIP64 one when that record's fields are full, parses the central directory, locates the
stored members through their local headers, range-reads the index and then range-reads records. Listing packages'
indexes and reading records are two Spark stages, so a large package is read by many tasks.

Files go to the session's shared folder through Arrow's file systems (local paths, hdfs, s3, gs). A package's name
holds the attempt that wrote it, and the table of packages those of the attempts that Spark committed: what a lost or
doubled attempt leaves behind is never read.

Of records with equal payloads of at least ``MIN_BYTES``, the one with the smallest page_id is a response and others
are revisits that name it.

Defined cases: a null html is an empty payload; a null url is an empty target; a null page_id is written as ``-`` and
comes last where the smallest id counts; a payload that only rows without an id have is a response in each, since a
revisit could name none; of rows that share id and payload one is the response and others revisit it; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symloom.llm.common import materialise, new_folder, text_or_empty

MIN_BYTES = 100
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed values of the formats.
END, CENTRAL, LOCAL, END64, LOCATOR64 = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
DATE = "2024-01-01T00:00:00Z"
#: Records per package, at most.
PACKAGE_ROWS = 4000
#: Packages whose indexes one task lists, and bytes of records that one task reads, about.
PACKAGES_A_TASK, BYTES_A_TASK = 16, 8 << 20


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.removeprefix("file:") if uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def record(ident: str, kind: str, page_id: str, url: str, digest: str, size: int, payload: bytes, refers_to: str | None) -> bytes:
    """One record, uncompressed. A revisit's block is empty; WARC-Payload-Length is an extension field."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{ident}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url.replace("\r", "").replace("\n", "")), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(size))]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page-ID", refers_to)]
        payload = b""
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(payload)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


class PackageWriter:
    """A ZIP of stored members, written front to back; ZIP64 fields where sizes or offsets need them, or always."""

    def __init__(self, sink, always64: bool = False):
        self.sink, self.at, self.members, self.always64 = sink, 0, [], always64

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        # Sizes are known at the end: bit 3 announces a data descriptor.
        self.members.append([name.encode(), self.at, 0, 0])
        self._put(struct.pack("<4sHHHHHIIIHH", LOCAL, 45, 8, 0, 0, 0x21, 0, 0, 0, len(self.members[-1][0]), 0) + self.members[-1][0])

    def write(self, data: bytes) -> int:
        """Returns the data's offset in the member."""
        m = self.members[-1]
        at, m[2], m[3] = m[3], zlib.crc32(data, m[2]), m[3] + len(data)
        self._put(data)
        return at

    def end(self) -> None:
        _, _, crc, size = self.members[-1]
        self._put(struct.pack("<4sIQQ", b"PK\x07\x08", crc, size, size) if self._big(size) else struct.pack("<4sIII", b"PK\x07\x08", crc, size, size))

    def _big(self, n: int) -> bool:
        return self.always64 or n >= FULL32

    def close(self) -> None:
        start = self.at
        for name, at, crc, size in self.members:
            wide = self._big(size) or self._big(at)
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
            low = [FULL32] * 3 if wide else [size, size, at]
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 8, 0, 0, 0x21, crc, low[0], low[1], len(name), len(extra), 0, 0, 0, 0, low[2]) + name + extra)
        size, n = self.at - start, len(self.members)
        if self._big(start) or n >= FULL16:
            at = self.at
            self._put(struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start) + struct.pack("<4sIQI", LOCATOR64, 0, at, 1))
            n, size, start = FULL16, FULL32, FULL32
        self._put(struct.pack("<4sHHHHIIH", END, 0, 0, n, n, size, start, 0))


def read_range(f, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def directory(f, size: int) -> list[tuple[str, int, int, int]]:
    """(name, compression method, size, offset of the local header) of a package's members."""
    tail = read_range(f, max(0, size - 65557), min(size, 65557))
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, n, length, start, _ = struct.unpack_from("<4sHHHHIIH", tail, at)
    if n == FULL16 or length == FULL32 or start == FULL32:
        place = max(0, size - 65557) + at - 20
        mark, _, there, _ = struct.unpack("<4sIQI", read_range(f, place, 20))
        if mark != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        mark, _, _, _, _, _, _, n, length, start = struct.unpack("<4sQHHIIQQQQ", read_range(f, there, 56))
        if mark != END64:
            raise ValueError("no ZIP64 directory")
    raw, out, i = read_range(f, start, length), [], 0
    for _ in range(n):
        mark, *_, method, _, _, _, packed, plain, names, extras, notes, _, _, _, offset = struct.unpack_from("<4sHHHHHHIIIHHHHHII", raw, i)
        if mark != CENTRAL:
            raise ValueError("damaged central directory")
        name = raw[i + 46 : i + 46 + names].decode()
        j, end = i + 46 + names, i + 46 + names + extras
        while j + 4 <= end:
            kind, width = struct.unpack_from("<HH", raw, j)
            if kind == 1:  # only the fields that are full stand here, in this order
                wide = list(struct.unpack_from(f"<{width // 8}Q", raw, j + 4))
                plain = wide.pop(0) if plain == FULL32 else plain
                packed = wide.pop(0) if packed == FULL32 else packed
                offset = wide.pop(0) if offset == FULL32 else offset
            j += 4 + width
        out.append((name, method, packed, offset))
        i += 46 + names + extras + notes
    return out


def locate(f, members: list[tuple[str, int, int, int]], name: str) -> tuple[int, int]:
    """(offset, size) of a stored member's bytes in the package."""
    _, method, size, at = next(m for m in members if m[0] == name)
    if method:
        raise ValueError(f"{name} is compressed; only stored members can be read in ranges")
    head = read_range(f, at, 30)
    if head[:4] != LOCAL:
        raise ValueError("damaged local header")
    names, extras = struct.unpack_from("<HH", head, 26)
    return at + 30 + names + extras, size


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, body, digest, size, record_type, refers_to of every row."""
    body = F.encode(text_or_empty(F.col(f"`{html_col}`")), "UTF-8")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"), body.alias("body"))
    rows = rows.select("*", F.sha2("body", 256).alias("digest"), F.octet_length("body").cast("long").alias("size"))
    long_ones = rows.where(F.col("size") >= MIN_BYTES).groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    firsts = materialise(long_ones.select("digest", F.col("first.page_id").alias("first_id")), "first-payloads")
    # Rows that share the first's id: all but one revisit it.
    twins = rows.where(F.col("size") >= MIN_BYTES).groupBy("page_id", "digest").count().where("count > 1").select(F.col("page_id").alias("t_id"), F.col("digest").alias("t_digest"))
    twins = materialise(twins, "repeated-pages")
    if not twins.isEmpty():
        pair = F.col("page_id").eqNullSafe(F.col("t_id")) & (F.col("digest") == F.col("t_digest"))
        order = Window.partitionBy("page_id", "digest").orderBy("url")
        rows = rows.join(twins, pair, "left_anti").withColumn("turn", F.lit(1)).union(rows.join(twins, pair, "left_semi").withColumn("turn", F.row_number().over(order)))
    else:
        rows = rows.withColumn("turn", F.lit(1))
    rows = rows.join(firsts, "digest", "left")
    # A null id can only be first when all copies have none.
    revisit = F.col("copies_exist") & ~(F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("turn") == 1))
    rows = rows.withColumn("copies_exist", F.col("first_id").isNotNull() & (F.col("size") >= MIN_BYTES))
    return rows.select("page_id", "url", F.when(~revisit, F.col("body")).alias("body"), "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", always64: bool = False) -> DataFrame:
    """Write a WARC record per row; returns (package, size, records) of the packages, as a table that is written too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, n_package, writer = TaskContext.get(), 0, None
        part = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)

        def finish() -> pd.DataFrame:
            writer.end()
            writer.begin(INDEX)
            writer.write(b"".join(json.dumps(x).encode() + b"\n" for x in lines))
            writer.end()
            writer.close()
            sink.close()
            return pd.DataFrame({"package": [f"{folder}/{name.rpartition('/')[2]}"], "size": [writer.at], "records": [len(lines)]})

        for pdf in batches:
            for page_id, url, body, digest, size, kind, refers in pdf.itertuples(index=False, name=None):
                if writer is None:
                    name, lines = f"{base}/part-{part}-{n_package:04d}.zip", []
                    sink = fs.open_output_stream(name)
                    writer = PackageWriter(sink, always64)
                    writer.begin(DATA)
                ident = uuid.uuid5(uuid.NAMESPACE_URL, f"{name} {len(lines)}").urn
                raw = gzip.compress(record(ident, kind, "-" if page_id is None else page_id, url, digest, size, body or b"", refers), 1, mtime=0)
                lines.append({"page": page_id, "offset": writer.write(raw), "length": len(raw)})
                if len(lines) >= PACKAGE_ROWS:
                    yield finish()
                    writer, n_package = None, n_package + 1
        if writer is not None:
            yield finish()

    rows = classify(pages, id_col, url_col, html_col).withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    return materialise(rows.mapInPandas(run, "package string, size long, records long"), "packages")


def list_records(packages: DataFrame) -> DataFrame:
    """(package, page, offset, length) of every record, offsets in the package file, from the packages' indexes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for package, size in zip(pdf["package"], pdf["size"], strict=True):
                fs, path = open_fs(package)
                with fs.open_input_file(path) as f:
                    members = directory(f, int(size))
                    at, n = locate(f, members, INDEX)
                    start, _ = locate(f, members, DATA)
                    lines = [json.loads(x) for x in read_range(f, at, n).splitlines()]
                if lines:
                    yield pd.DataFrame({"package": package, "page": [x["page"] for x in lines], "offset": [start + x["offset"] for x in lines], "length": [x["length"] for x in lines]})

    # A number of partitions, for adaptive execution would put so few bytes into one task.
    n = max(1, -(-packages.count() // PACKAGES_A_TASK))
    return packages.select("package", "size").repartition(n, "package").mapInPandas(run, "package string, page string, offset long, length long")


def read_records(records: DataFrame, with_payload: bool = False) -> DataFrame:
    """page, payload_bytes, payload_digest, record_type, refers_to of each listed record, read by its range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for package, own in pdf.groupby("package", sort=False):
                fs, path = open_fs(package)
                with fs.open_input_file(path) as f:
                    for page, at, n in zip(own["page"], own["offset"], own["length"], strict=True):
                        fields, payload = parse_record(gzip.decompress(read_range(f, int(at), int(n))))
                        digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["WARC-Payload-Length"])
                        if fields["WARC-Type"] == "response":
                            if hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"payload of page {page} in {package} is damaged")
                            size = len(payload)
                        out.append((page, size, digest, fields["WARC-Type"], fields.get("WARC-Refers-To-Page-ID"), *([payload] if with_payload else [])))
            yield pd.DataFrame(out, columns=names)

    names = ["page", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]
    return records.mapInPandas(run, "page string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages to packages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    kind = pages.schema[id_col].dataType.simpleString()
    packages = write_packages(pages, new_folder(pages.sparkSession, "warc"), id_col, url_col, html_col)
    # Records are dealt to tasks by stretches of their package, so one large package is read by many.
    n = max(1, -(-(packages.agg(F.sum("size")).first()[0] or 0) // BYTES_A_TASK))
    stretch = F.floor(F.col("offset") / BYTES_A_TASK)
    found = read_records(list_records(packages).repartition(n, "package", stretch).sortWithinPartitions("package", "offset"))
    return found.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
