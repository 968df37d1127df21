"""Web archives: WARC records in ZIP packages, written and read by range.

A package is a ZIP file whose members are all stored, not compressed:

``archive/data.warc.gz``  WARC records, each a gzip member of its own;
``indexes/index.cdxj``    a line per record: key, date, and as JSON its file, offset and length.

The reader never extracts a member. It finds the end of the central directory from the
file's tail, follows the ZIP64 locator where there is one, walks the central
directory and takes a stored member's place from its local header. The index then
tells where each record lies, and only those bytes are read. Packages without an
index, or members that it doesn't name, are walked record by record through bounded reads.

Writing: each task streams its rows into packages of a bounded size in the shared folder. File
names carry the task attempt, and only the manifest (a row per package) says which
count, so lost attempts leave nothing that a reader sees. Reading: the indexes give spans of
neighbouring records of bounded size, Spark deals the spans out, and each is one range read.

Of records with equal payloads (by SHA-256) of at least ``least`` bytes, those with the largest
id are responses; the others are revisits without a payload, which name the response's
id. Defined cases: a null payload is empty; a null id is smaller than all, and where it is the largest
its rows are all responses; rows that repeat the largest id with the same payload are all responses; a null
url is left out of the record; an empty table gives no packages and no rows; other columns are ignored.
A package that is cut off, encrypted, split over disks or compressed is an error that names it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.common import cut, scratch_path, small_batches

#: Bytes of records after which a task starts its next package; bytes of one range read, unless a record is longer; range reads of a task.
PACKAGE, SPAN, SPANS_A_TASK = 256 << 20, 1 << 20, 16
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "path string, n_records long, n_bytes long"
SPANS = "path string, member string, starts array<long>, lengths array<long>"
RECORDS = "page_id long, record_type string, refers_to long, target_uri string, record_id string, date string, payload_digest string, payload_bytes long, payload binary, path string, offset long, length long"
# Signatures of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_IDS = uuid.UUID("5f1d6a0e-6f0c-4f0e-9f43-0d6b0a1b7c55")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# Records


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = DATE) -> bytes:
    """One WARC record: a response with its payload, or a revisit of ``refers_to`` with the headers alone."""
    digest = base32_sha1(payload)
    name = lambda i: f"<urn:uuid:{uuid.uuid5(_IDS, f'{i}/{digest}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        # Control characters and spaces would end the line or the value.
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and out:
            last = next(reversed(out))
            out[last] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            key, _, value = line.partition(b":")
            out[key.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


def parse(data: bytes) -> dict:
    """The fields of one record; its payload is the body of its HTTP message, else its block."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/"):
        raise ValueError("no WARC record begins here")
    fields = _fields(head)
    n = int(fields["content-length"])
    if len(rest) < n:
        raise ValueError("a WARC record is cut off")
    block, kind = rest[:n], fields.get("warc-type", "")
    payload, declared = block, None
    if fields.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        declared = _fields(http).get("content-length")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        size = int(declared) if declared and declared.isdigit() else None
        payload = None
    else:
        size, own = len(payload), base32_sha1(payload)
        if digest and digest != own:
            raise ValueError(f"payload digest {own} isn't the recorded {digest}")
        digest = own
    number = lambda key: int(fields[key]) if re.fullmatch(r"-?\d+", fields.get(key, "")) else None
    return {
        "page_id": number("x-page-id"),
        "record_type": kind,
        "refers_to": number("x-refers-to-page-id"),
        "target_uri": fields.get("warc-target-uri"),
        "record_id": fields.get("warc-record-id"),
        "date": fields.get("warc-date"),
        "payload_digest": digest or None,
        "payload_bytes": size,
        "payload": payload,
    }


# Packages


class Package:
    """A ZIP file written front to back, with stored members and ZIP64 records throughout."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.members: list[tuple[bytes, int, int, int]] = []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """Sizes and checksum follow the data (flag 8), as they aren't known yet; names are UTF-8 (flag 2048)."""
        self.name, self.start, self.crc = name.encode(), self.at, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 8 | 2048, 0, 0, 33, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(self.name), len(extra)) + self.name + extra)
        self.data = self.at

    def add(self, data: bytes) -> int:
        """Append to the open member; gives where in it the data begin."""
        place = self.at - self.data
        self.crc = zlib.crc32(data, self.crc)
        self._put(data)
        return place

    def end(self) -> None:
        size = self.at - self.data
        self._put(b"PK\7\10" + struct.pack("<IQQ", self.crc, size, size))
        self.members.append((self.name, self.start, size, self.crc))

    def close(self) -> None:
        directory = self.at
        for name, start, size, crc in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, start)
            most = 0xFFFFFFFF
            self._put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 8 | 2048, 0, 0, 33, crc, most, most, len(name), len(extra), 0, 0, 0, 0, most) + name + extra)
        size, end = self.at - directory, self.at
        n = len(self.members)
        self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, directory))
        self._put(LOCATOR64 + struct.pack("<IQI", 0, end, 1))
        self._put(END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))


class Members:
    """The members of a ZIP file that can be read at any place."""

    def __init__(self, file, path: str):
        self.file, self.path = file, path
        self.size = file.size()
        tail_at = max(0, self.size - 22 - 0xFFFF)
        tail = self._at(tail_at, self.size - tail_at)
        end = len(tail) - 22
        # The last end record whose comment reaches the end of the file.
        while end >= 0 and not (tail[end : end + 4] == END and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] == len(tail)):
            end = tail.rfind(END, 0, end + 3)
        if end < 0:
            raise ValueError(f"{path} is no ZIP file, or cut off")
        disk, first, here, n, size, start = struct.unpack_from("<HHHHII", tail, end + 4)
        stop = tail_at + end
        if stop >= 20 and (locator := self._at(stop - 20, 20))[:4] == LOCATOR64:
            at, disks = struct.unpack_from("<QI", locator, 8)
            head = self._at(at, 56)
            if head[:4] != END64:
                raise ValueError(f"{path}: its ZIP64 locator points nowhere")
            disk, first, here, n, size, start = struct.unpack_from("<IIQQQQ", head, 16)
            stop = at
            if disks > 1:
                raise ValueError(f"{path} is split over disks")
        if disk or first or here != n:
            raise ValueError(f"{path} is split over disks")
        # What precedes the archive, if anything, moves all offsets.
        self.shift = stop - size - start
        self.count, self.directory = n, (start + self.shift, size)

    def _at(self, place: int, n: int) -> bytes:
        if place < 0:
            raise ValueError(f"{self.path}: a place before its beginning")
        data = self.file.read_at(n, place)
        if len(data) < n:
            raise ValueError(f"{self.path} is cut off")
        return data

    def __iter__(self) -> Iterator[dict]:
        """Each member of the central directory: name, method, flags, size (as stored) and place of its local header."""
        at, size = self.directory
        stop = at + size
        for _ in range(self.count):
            head = self._at(at, 46)
            if head[:4] != CENTRAL:
                raise ValueError(f"{self.path}: its directory is damaged")
            flags, method = struct.unpack_from("<HH", head, 8)
            stored, plain, n_name, n_extra, n_comment, disk = struct.unpack_from("<IIHHHH", head, 20)
            offset = struct.unpack_from("<I", head, 42)[0]
            rest = self._at(at + 46, n_name + n_extra)
            name, extra = rest[:n_name], rest[n_name:]
            place = 0
            while place + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, place)
                if kind == 1:
                    # Only the fields that are all ones in the entry are given here, in this order.
                    values = iter(struct.unpack_from(f"<{n // 8}Q", extra, place + 4))
                    plain = next(values) if plain == 0xFFFFFFFF else plain
                    stored = next(values) if stored == 0xFFFFFFFF else stored
                    offset = next(values) if offset == 0xFFFFFFFF else offset
                place += 4 + n
            yield {"name": name.decode("utf-8" if flags & 2048 else "cp437"), "method": method, "flags": flags, "size": stored, "header": offset + self.shift}
            at += 46 + n_name + n_extra + n_comment
            if at > stop:
                raise ValueError(f"{self.path}: its directory is damaged")

    def place(self, member: dict) -> int:
        """Where a stored member's bytes begin."""
        if member["method"] or member["flags"] & 1:
            raise ValueError(f"{self.path}: {member['name']} is compressed or encrypted, so its records can't be read by range")
        head = self._at(member["header"], 30)
        if head[:4] != LOCAL:
            raise ValueError(f"{self.path}: {member['name']} has no local header")
        return member["header"] + 30 + sum(struct.unpack_from("<HH", head, 26))

    def pieces(self, member: dict, size: int = 1 << 20) -> Iterator[bytes]:
        at = self.place(member)
        for k in range(0, member["size"], size):
            yield self._at(at + k, min(size, member["size"] - k))


def _lines(pieces: Iterator[bytes]) -> Iterator[bytes]:
    rest = b""
    for piece in pieces:
        *whole, rest = (rest + piece).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _unpacked(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a series of gzip members."""
    inner = zlib.decompressobj(31)
    for piece in pieces:
        while piece:
            yield inner.decompress(piece)
            piece = inner.unused_data
            if inner.eof:
                inner = zlib.decompressobj(31)


def _walked(pieces: Iterator[bytes], packed: bool) -> Iterator[tuple[int, int]]:
    """(offset, length) of each record of a member that no index names."""
    at, start = 0, 0
    if packed:
        inner = zlib.decompressobj(31)
        for piece in pieces:
            while piece:
                inner.decompress(piece)
                rest = inner.unused_data
                at += len(piece) - len(rest)
                piece = rest
                if inner.eof:
                    yield start, at - start
                    start, inner = at, zlib.decompressobj(31)
        if start < at:
            raise ValueError("a WARC record is cut off")
        return
    held, skip = b"", 0
    for piece in pieces:
        held += piece
        while True:
            if skip:
                used = min(skip, len(held))
                held, skip, at = held[used:], skip - used, at + used
                if skip:
                    break
                yield start, at - start
                start = at
            head, gap, _ = held.partition(b"\r\n\r\n")
            if not gap:
                break
            skip = len(head) + 4 + int(_fields(head)["content-length"]) + 4
    if held or skip:
        raise ValueError("a WARC record is cut off")


def located(file, path: str) -> Iterator[tuple[str, int, int]]:
    """(member, place in the package, length) of each record: from the indexes, else by walking a member that no index names."""
    members = Members(file, path)
    archives, indexes = {}, []
    for m in members:
        name = m["name"].lower()
        if re.search(r"\.warc(\.gz)?$", name):
            archives[m["name"]] = m | {"place": members.place(m)}
        elif re.search(r"(^|/)indexes/.*\.cdxj?(\.gz)?$", name):
            indexes.append(m)
    files = {name.rpartition("/")[2]: name for name in archives}
    named = set()
    for m in indexes:
        pieces = members.pieces(m)
        for line in _lines(_unpacked(pieces) if m["name"].lower().endswith(".gz") else pieces):
            brace = line.find(b"{")
            if brace < 0 or line.startswith(b"!"):
                continue
            said = json.loads(line[brace:])
            name = files.get(str(said["filename"]).rpartition("/")[2])
            if name is None:
                raise ValueError(f"{path}: its index names {said['filename']}, which isn't there")
            offset, length = int(said["offset"]), int(said["length"])
            if offset < 0 or offset + length > archives[name]["size"]:
                raise ValueError(f"{path}: its index points outside {name}")
            named.add(name)
            yield name, archives[name]["place"] + offset, length
    for name, m in archives.items():
        if name not in named:
            for offset, length in _walked(members.pieces(m), name.lower().endswith(".gz")):
                yield name, m["place"] + offset, length


# Spark


def verdicts(pages: DataFrame, least: int, key: str, url: str, html: str) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is null for responses. Payloads travel once, to meet their group's largest id."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("same", F.sha2("payload", 256))
    largest = rows.groupBy("same").agg(F.max("page_id").alias("largest"))
    refers = F.when((F.octet_length("payload") >= least) & ~F.col("largest").eqNullSafe(F.col("page_id")), F.col("largest"))
    return rows.join(largest, "same").select("page_id", "url", "payload", refers.alias("refers_to"))


def write(pages: DataFrame, least: int = 0, path: str | None = None, key: str = "page_id", url: str = "url", html: str = "html", package: int = PACKAGE, date: str = DATE) -> DataFrame:
    """Write a record per row into packages under ``path``; gives the manifest (path, n_records, n_bytes)."""
    spark = pages.sparkSession
    folder = path or scratch_path(spark, "warc")

    def packages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        files, root = fs.FileSystem.from_uri(f"{folder}/packages")
        piece, out, zipped, index = 0, None, None, []

        def done() -> pa.RecordBatch:
            zipped.end()
            zipped.begin("indexes/index.cdxj")
            for line in sorted(index):
                zipped.add(line)
            zipped.end()
            zipped.close()
            out.close()
            row = pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([len(index)], pa.int64()), pa.array([zipped.at], pa.int64())], ["path", "n_records", "n_bytes"])
            index.clear()
            return row

        for batch in batches:
            for k in range(batch.num_rows):
                page, address, payload, refers = (batch.column(c)[k].as_py() for c in ("page_id", "url", "payload", "refers_to"))
                if out is None:
                    files.create_dir(root, recursive=True)
                    name = f"pages-{context.partitionId():06d}-{piece:04d}-{context.taskAttemptId()}.wacz"
                    out, uri = files.open_output_stream(f"{root}/{name}"), f"{folder}/packages/{name}"
                    zipped = Package(out)
                    zipped.begin("archive/data.warc.gz")
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = packer.compress(record(page, address, payload, refers, date)) + packer.flush()
                place = zipped.add(data)
                said = json.dumps({"url": address, "digest": f"sha1:{base32_sha1(payload)}", "filename": "data.warc.gz", "offset": str(place), "length": str(len(data))})
                index.append(f"{quote(address or '-', safe='/:?&=.,')} {re.sub('[^0-9]', '', date)} {said}\n".encode())
                if zipped.at >= package:
                    yield done()
                    piece, out = piece + 1, None
        if out is not None:
            yield done()

    with small_batches(spark):
        verdicts(pages, least, key, url, html).mapInArrow(packages, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def spans(packages: DataFrame, span: int = SPAN) -> DataFrame:
    """Runs of neighbouring records of each package of ``packages.path``: a row is read at once, some ``span`` bytes or one record."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(path: str, member: str, own: list[tuple[int, int]]) -> pa.RecordBatch:
            longs = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([member]), pa.array([[a for a, _ in own]], longs), pa.array([[n for _, n in own]], longs)], ["path", "member", "starts", "lengths"])

        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, inner = fs.FileSystem.from_uri(path)
                with files.open_input_file(inner) as file:
                    # An index is in the order of its keys; of a bounded package the places fit and are put in order.
                    for member, held in _by_member(located(file, path)):
                        own: list[tuple[int, int]] = []
                        for at, n in held:
                            if own and at + n - own[0][0] > span:
                                yield row(path, member, own)
                                own = []
                            own.append((at, n))
                        if own:
                            yield row(path, member, own)

    paths = packages.select("path")
    return paths.repartition(max(1, paths.count()), "path").mapInArrow(find, SPANS)


def _by_member(places: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    held: dict[str, list[tuple[int, int]]] = {}
    for member, at, n in places:
        held.setdefault(member, []).append((at, n))
    for member, own in held.items():
        yield member, sorted(own)


def read(packages: DataFrame, span: int = SPAN) -> DataFrame:
    """Every record of the packages: RECORDS. Only the records' own bytes are read."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("record_id", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        for batch in batches:
            for x in batch.to_pylist():
                files, inner = fs.FileSystem.from_uri(x["path"])
                first, stop = x["starts"][0], max(a + n for a, n in zip(x["starts"], x["lengths"], strict=True))
                with files.open_input_file(inner) as file:
                    data = memoryview(file.read_at(stop - first, first))
                rows, size = [], 0
                for at, n in zip(x["starts"], x["lengths"], strict=True):
                    own = data[at - first : at - first + n]
                    own = zlib.decompress(own, 31) if x["member"].lower().endswith(".gz") else bytes(own)
                    rows.append(parse(own) | {"path": x["path"], "offset": at, "length": n})
                    size += len(own)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    # A span is a short row for a long read, so tasks are counted out by spans, not by the size of their rows.
    found = cut(spans(packages, span), "warc-spans")
    return found.repartition(-(-max(1, found.count()) // SPANS_A_TASK), "path", F.element_at("starts", 1)).mapInArrow(records, RECORDS)


def packages_at(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The packages at these paths, for ``read``."""
    return spark.createDataFrame([(p,) for p in paths], "path string")
