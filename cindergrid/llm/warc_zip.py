"""WARC in ZIP packages: written as stored members, read by directory and byte range, never extracted.

A package is a ZIP file with one or more stored members ``archive/*.warc.gz`` (a gzip stream for each record) and an index member ``indexes/index.cdxj`` that
names every record's member, offset and length. The reader parses the end record, the ZIP64 locator and directory where
present, and the central directory, finds stored members and their data offsets, reads the indexes, and then
reads single records by range. Compressed or encrypted members and damaged directories raise errors.

Writing deals pages to packages by a hash of their id; equal payloads of at least ``least`` bytes are kept once, as the
response of the smallest page id, and other pages become revisit records that name it. A task names its files
uniquely and only the listed files of finished tasks count, so repeated attempts do no harm.

Null payloads are empty; null urls are written without target; null ids aren't written (they couldn't be named) and
repeated ids are written each. Empty tables give no packages. A package holds at most ``roll`` bytes plus one record.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from cindergrid.session import cut_lineage, shared_folder

#: Fixed values of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
MOST32, MOST16 = 0xFFFFFFFF, 0xFFFF
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page}')}>"


def warc_record(page: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head alone and names its response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page)),
            ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c for c in url if c >= " ")))
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to))]
    head += [("X-Page-Id", page), ("Content-Length", len(block))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block."""
    at = raw.index(b"\r\n\r\n")
    lines = raw[:at].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(head["content-length"])
    block = raw[at + 4 : at + 4 + size]
    if len(block) != size:
        raise ValueError("a WARC record is cut short")
    return head, block


class ZipWriter:
    """Stored members one after the other into an open stream; ZIP64 fields where sizes or counts need them (or ``wide``)."""

    def __init__(self, stream, wide: bool = False):
        self.stream, self.at, self.members, self.wide = stream, 0, [], wide

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])
        # Sizes and check sum follow the data (flag 3), names are UTF-8 (flag 11).
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x808, 0, 0, 0x21, 0, 0, 0, len(raw), 0) + raw)

    def write(self, data: bytes) -> int:
        """Append to the open member; the offset within it."""
        member = self.members[-1]
        offset, member[2], member[3] = member[2], member[2] + len(data), zlib.crc32(data, member[3])
        self._put(data)
        return offset

    def end(self) -> None:
        _, _, size, crc = self.members[-1]
        big = self.wide or size >= MOST32
        self._put(struct.pack("<IIQQ" if big else "<IIII", 0x08074B50, crc, size, size))

    def close(self) -> None:
        start = self.at
        for name, offset, size, crc in self.members:
            big = self.wide or max(size, offset) >= MOST32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if big else b""
            small = (MOST32,) * 3 if big else (size, size, offset)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x808, 0, 0, 0x21, crc, small[0], small[1], len(name), len(extra),
                                  0, 0, 0, 0, small[2]) + name + extra)
        size, count = self.at - start, len(self.members)
        if self.wide or count >= MOST16 or self.at >= MOST32:
            end = self.at
            self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, count, count, size, start))
            self._put(struct.pack("<IIQI", LOCATOR, 0, end, 1))
            self._put(struct.pack("<IHHHHIIH", END, 0, 0, MOST16, MOST16, MOST32, MOST32, 0))
        else:
            self._put(struct.pack("<IHHHHIIH", END, 0, 0, count, count, size, start, 0))


class ZipReader:
    """Directory of a ZIP file opened for random access; members by name with offset of their data and size."""

    def __init__(self, file):
        self.file, self.members = file, {}
        size = file.size()
        tail = self._at(max(0, size - 65557), min(size, 65557))
        at = tail.rfind(struct.pack("<I", END))
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack("<10xHII2x", tail[at : at + 22])
        end = size - len(tail) + at
        if MOST16 == count or MOST32 in (length, start):
            mark, where = struct.unpack("<I4xQ4x", self._at(end - 20, 20))
            if mark != LOCATOR:
                raise ValueError("no ZIP64 locator")
            mark, count, length, start = struct.unpack("<I28xQQQ", self._at(where, 56))
            if mark != END64:
                raise ValueError("no ZIP64 end record")
        directory, at = self._at(start, length), 0
        for _ in range(count):
            mark, flags, method, packed, plain, name, extra, comment, offset = struct.unpack("<I4xHH8xIIHHH8xI", directory[at : at + 46])
            if mark != CENTRAL:
                raise ValueError("damaged central directory")
            label = directory[at + 46 : at + 46 + name].decode()
            more = directory[at + 46 + name : at + 46 + name + extra]
            at += 46 + name + extra + comment
            packed, plain, offset = self._wide(more, packed, plain, offset)
            self.members[label] = flags, method, packed, plain, offset

    def _at(self, offset: int, size: int) -> bytes:
        return self.file.read_at(size, offset)

    @staticmethod
    def _wide(extra: bytes, packed: int, plain: int, offset: int) -> tuple[int, int, int]:
        at = 0
        while at + 4 <= len(extra):
            kind, size = struct.unpack("<HH", extra[at : at + 4])
            if kind == 1:
                values = iter(struct.unpack(f"<{size // 8}Q", extra[at + 4 : at + 4 + size // 8 * 8]))
                plain = next(values) if plain == MOST32 else plain
                packed = next(values) if packed == MOST32 else packed
                offset = next(values) if offset == MOST32 else offset
            at += 4 + size
        return packed, plain, offset

    def place(self, name: str) -> tuple[int, int]:
        """Offset and size of a stored member's data."""
        flags, method, packed, plain, offset = self.members[name]
        if method or flags & 1 or packed != plain:
            raise ValueError(f"{name} isn't stored")
        mark, label, extra = struct.unpack("<I22xHH", self._at(offset, 30))
        if mark != LOCAL:
            raise ValueError(f"{name} has no local header")
        return offset + 30 + label + extra, plain

    def read(self, name: str, offset: int = 0, size: int | None = None) -> bytes:
        start, whole = self.place(name)
        size = whole - offset if size is None else size
        if offset + size > whole:
            raise ValueError(f"range beyond the end of {name}")
        return self._at(start + offset, size)


def with_originals(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int) -> DataFrame:
    """id, url, payload, digest and, for revisits, the page whose payload they repeat.

    Equal payloads meet as (digest, smallest id, count), summed before the shuffle; only repeated ones are joined back, to
    ids and digests without payloads, where adaptive execution splits a digest that many pages share. Payloads move once,
    by page."""
    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"),
                                                         F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= least).select("page", "digest")
    first = large.groupBy("digest").agg(F.min("page").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = large.join(first, "digest").where("page <> original").select("page", "digest", "original").distinct()
    return rows.join(again.hint("merge"), ["page", "digest"], "left")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100,
          roll: int = 64 << 20, wide: bool = False) -> DataFrame:
    """Write packages below ``folder`` (a path or URI) and list them: path, records, bytes."""
    rows = with_originals(pages, id_col, url_col, payload_col, least)

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(base, recursive=True)
        stream = package = None
        done = []

        def finish():
            package.end()
            package.begin("indexes/index.cdxj")
            package.write("".join(index).encode())
            package.end()
            package.close()
            stream.close()
            done.append((path, len(index), package.at))

        for batch in batches:
            for page, url, payload, digest, original in zip(*(c.to_pylist() for c in batch.columns)):
                if package is None:
                    path = f"{base}/{uuid.uuid4().hex}.wacz"
                    stream = store.open_output_stream(path)
                    package, index = ZipWriter(stream, wide), []
                    package.begin("archive/data.warc.gz")
                raw = gzip.compress(warc_record(page, url, payload.encode(), digest, original), mtime=0)
                index.append(f"{page} {{\"member\":\"archive/data.warc.gz\",\"offset\":{package.write(raw)},\"length\":{len(raw)}}}\n")
                if package.at >= roll:
                    finish()
                    package = None
        if package is not None:
            finish()
        columns = list(zip(*done)) or [(), (), ()]
        yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["path", "records", "bytes"])

    # Dealt by page and digest, so that a payload that many pages share spreads over all packages.
    dealt = rows.select("page", "url", "payload", "digest", "original")
    return cut_lineage(dealt.mapInArrow(run, "path string, records long, bytes long"))


def read(packages: DataFrame, folder: str) -> DataFrame:
    """Records of the listed packages: page, type, digest and length of the payload as read, and the id it refers to.

    A row of the index is one range; ranges are dealt anew before they are read, so one large package is read by many."""
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def opened(path):
        store, _ = fs.FileSystem.from_uri(uri)
        return store.open_input_file(path)

    def index(batches):
        import json

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path) as file:
                    package = ZipReader(file)
                    rows = []
                    for name in sorted(m for m in package.members if m.startswith("indexes/")):
                        for line in package.read(name).decode().splitlines():
                            entry = json.loads(line.partition(" ")[2])
                            rows.append((path, package.place(entry["member"])[0] + entry["offset"], entry["length"]))
                columns = list(zip(*rows)) or [(), (), ()]
                yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
                                      ["path", "offset", "length"])

    def records(batches):
        path = file = None
        for batch in batches:
            out = []
            for own, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if own != path:
                    if file is not None:
                        file.close()
                    path, file = own, opened(own)
                head, block = parse_record(gzip.decompress(file.read_at(length, offset)))
                at = block.index(b"\r\n\r\n") + 4
                payload = block[at:]
                kind = head["warc-type"]
                out.append((head["warc-record-id"], int(head["x-page-id"]), kind, head.get("warc-refers-to"),
                            hashlib.sha256(payload).hexdigest() if kind == "response" else None, len(payload) if kind == "response" else None,
                            payload.decode() if kind == "response" else None))
            columns = list(zip(*out)) or [()] * 7
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)],
                                  ["record", "page", "record_type", "refers", "payload_digest", "payload_bytes", "payload"])
        if file is not None:
            file.close()

    ranges = packages.select("path").repartition(F.col("path")).mapInArrow(index, "path string, offset long, length long")
    # Runs of about a megabyte of one file stay together and in order.
    # The rows are tiny, what they name is not: a stated number of tasks keeps adaptive execution from merging them.
    tasks = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges.repartition(tasks, F.col("path"), (F.col("offset") / (1 << 20)).cast("long")).sortWithinPartitions("path", "offset")
    return ranges.mapInArrow(records, "record string, page long, record_type string, refers string, payload_digest string, payload_bytes long, payload string")


def resolved(records: DataFrame) -> DataFrame:
    """Per page: payload digest and size, those of the response for a revisit, and the page it refers to."""
    known = cut_lineage(records.drop("payload"))
    named = known.where("refers is not null").select(F.col("refers").alias("wanted")).distinct()
    target = known.where("record_type = 'response'").join(named.hint("shuffle_hash"), F.col("record") == F.col("wanted"), "left_semi").select(
        F.col("record").alias("target"), F.col("page").alias("target_page"), F.col("payload_digest").alias("target_digest"),
        F.col("payload_bytes").alias("target_bytes")).dropDuplicates(["target"])
    out = known.join(target, F.col("refers") == F.col("target"), "left")
    return out.select("page", F.coalesce("payload_bytes", "target_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "target_digest").alias("payload_digest"),
                      "record_type", F.col("target_page").alias("refers_to"))


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to the shared folder and read every record back."""
    folder = shared_folder(pages.sparkSession)
    return resolved(read(write(pages, folder, **options), folder))
