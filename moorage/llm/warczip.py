"""Web archive records in ZIP packages: written per task, read back by byte ranges.

A package is a ZIP file whose members are stored as they are: ``archive/data.warc.gz``, every
record a gzip member of its own, and ``indexes/index.cdxj``, a line of JSON per record. Since
nothing is compressed a second time, a record of the archive is a byte range of the package.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.groups import lookup
from ..sources.scratch import shared_folder, written
from .components import cut

# Payloads from this many bytes on are stored once.
LEAST_REVISIT = 1000
# A package is closed at so many bytes of records or so many records.
PACKAGE_BYTES, PACKAGE_RECORDS = 256 << 20, 200_000
# Records are dealt to readers by ranges of this size, and fetched in reads of at most READ.
RANGE_BYTES, READ = 32 << 20, 4 << 20
# Rows that one payload may have in a task of the join before they are spread.
HOT_ROWS = 20_000
LEVEL = 5
# Pages carry no time of capture.
DATE = "1970-01-01T00:00:00Z"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:x-record:"

# Signatures and sizes of the parts of a ZIP file.
_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
_COMMENT, _UNSET16, _UNSET32, _ZIP64_FIELD = 65535, 0xFFFF, 0xFFFFFFFF, 1


class PackageError(ValueError):
    """A package that is no ZIP file as this reader knows it."""


def store_of(uri: str):
    """(file system, path) of a local path or of a URI that Spark writes."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


class Ranges:
    """Byte ranges of one file."""

    def __init__(self, uri: str):
        system, path = store_of(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read(self, at: int, length: int) -> bytes:
        if at < 0 or length < 0 or at + length > self.size:
            raise PackageError("a range ends outside the file")
        return self.file.read_at(length, at)

    def close(self) -> None:
        self.file.close()


# Reading the directory.


def directory_of(ranges: Ranges) -> tuple[int, int, int]:
    """(where the central directory begins, its size, its entries), from the file's end.

    The end record may be followed by a comment, so it is looked for backwards. Where a field
    is filled with ones, the ZIP64 end record has it; a locator just before points to that.
    """
    tail_size = min(ranges.size, 22 + _COMMENT)
    tail = ranges.read(ranges.size - tail_size, tail_size)
    at = tail.rfind(_END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(_END, 0, at)
    if at < 0:
        raise PackageError("no end record")
    disk, first_disk, here, entries, size, begin = struct.unpack_from("<4H2L", tail, at + 4)
    place = ranges.size - tail_size + at
    if _UNSET16 in (disk, first_disk, here, entries) or _UNSET32 in (size, begin):
        locator = ranges.read(place - 20, 20) if place >= 20 else b""
        if locator[:4] == _LOCATOR:
            large = ranges.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if large[:4] != _END64:
                raise PackageError("no ZIP64 end record where the locator points")
            disk, first_disk, here, entries, size, begin = struct.unpack_from("<2L4Q", large, 16)
    if disk or first_disk or here != entries:
        raise PackageError("the archive spans several files")
    if begin + size > place:
        raise PackageError("the central directory overlaps the end record")
    return begin, size, entries


def entries_of(ranges: Ranges) -> Iterator[tuple[str, int, int, int, int]]:
    """(name, method, flags, size, local header) of every member, a strip of the directory at a time."""
    begin, size, entries = directory_of(ranges)
    held, at, found = b"", begin, 0
    while True:
        place = 0
        while place + 46 <= len(held):
            if held[place : place + 4] != _ENTRY:
                raise PackageError("no entry where the directory has one")
            fields = struct.unpack_from("<6H3L5H2L", held, place + 4)
            flags, method, packed, plain = fields[2], fields[3], fields[7], fields[8]
            names, extras, comments, header = fields[9], fields[10], fields[11], fields[15]
            end = place + 46 + names + extras + comments
            if end > len(held):
                break
            name = held[place + 46 : place + 46 + names]
            extra = held[place + 46 + names : place + 46 + names + extras]
            wanted = [value == _UNSET32 for value in (plain, packed, header)]
            if any(wanted):
                large = _large_values(extra, sum(wanted))
                plain, packed, header = (large.pop(0) if w else v for w, v in zip(wanted, (plain, packed, header)))
            if method == 0 and plain != packed:
                raise PackageError("a stored member has two sizes")
            yield name.decode("utf-8" if flags & 0x800 else "cp437"), method, flags, packed, header
            found, place = found + 1, end
        if at >= begin + size:
            break
        strip = min(1 << 20, begin + size - at)
        held, at = held[place:] + ranges.read(at, strip), at + strip
    if found != entries:
        raise PackageError("the directory has another number of entries")


def _large_values(extra: bytes, count: int) -> list[int]:
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<2H", extra, at)
        if kind == _ZIP64_FIELD:
            if size < 8 * count or at + 4 + 8 * count > len(extra):
                break
            return list(struct.unpack_from(f"<{count}Q", extra, at + 4))
        at += 4 + size
    raise PackageError("a size of 64 bits is missing")


def data_of(ranges: Ranges, header: int) -> int:
    """Where a member's data begins: its own header may hold other extra fields than the directory."""
    local = ranges.read(header, 30)
    if local[:4] != _LOCAL:
        raise PackageError("no member where the directory has one")
    names, extras = struct.unpack_from("<2H", local, 26)
    return header + 30 + names + extras


# Records.


def record(kind: str, identity: str, url: str | None, payload: bytes, refers_to: str | None = None) -> tuple[bytes, str]:
    """(the record's bytes, the hexadecimal SHA-1 of its payload); a revisit leaves the payload out."""
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{identity}>", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_line(url)}"] if url else []),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"] if kind == "revisit" else []),
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def _line(url: str) -> str:
    """A URL without what would end or split a header line, percent-encoded instead."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.split(b":", 1) for line in lines.split(b"\r\n")[1:] if b":" in line)
    return {name.decode(errors="replace").strip().lower(): value.decode(errors="replace").strip() for name, value in pairs}


def parsed(data: bytes) -> dict:
    """The parts of one record, packed or plain; ``problem`` tells what is wrong with it."""
    out = dict.fromkeys(
        ["record_id", "record_type", "target_uri", "date", "payload", "payload_bytes", "payload_digest", "refers_to", "problem"]
    )
    try:
        if data[:2] == b"\x1f\x8b":
            data = zlib.decompress(data, 31)
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = _headers(head)
        length = int(fields.get("content-length", ""))
        if not head.startswith(b"WARC/") or length > len(rest):
            raise ValueError
    except (ValueError, zlib.error):
        return out | {"problem": "malformed"}
    block, kind = rest[:length], fields.get("warc-type")
    payload, claimed = block, None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        claimed = _headers(http).get("content-length")
    own = lambda value: value.strip("<>").removeprefix(_ID) if value is not None else None
    out |= {
        "record_id": own(fields.get("warc-record-id")), "record_type": kind, "date": fields.get("warc-date"),
        "target_uri": fields.get("warc-target-uri"), "refers_to": own(fields.get("warc-refers-to")),
    }
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "revisit":
        size = int(claimed) if (claimed or "").isdigit() else None
        return out | {"payload_bytes": size, "payload_digest": digest, "problem": None if digest else "no digest"}
    found = hashlib.sha1(payload).hexdigest()
    problem = "digest differs" if digest and digest != found else None
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": found, "problem": problem}


def walked(ranges: Ranges, at: int, size: int) -> Iterator[tuple[int, int]]:
    """(where, length) of the records of a stored archive without an index, by reading it through."""
    end = at + size
    while at < end:
        if ranges.read(at, min(2, end - at)) == b"\x1f\x8b":
            unpacker, place = zlib.decompressobj(31), at
            while not unpacker.eof:
                if place >= end:
                    raise PackageError("the last record is cut off")
                strip = ranges.read(place, min(1 << 16, end - place))
                place += len(strip)
                unpacker.decompress(strip)
            length = place - len(unpacker.unused_data) - at
        else:
            head = b""
            while b"\r\n\r\n" not in head:
                if at + len(head) >= end:
                    raise PackageError("the last record is cut off")
                head += ranges.read(at + len(head), min(1 << 12, end - at - len(head)))
            lines = head.partition(b"\r\n\r\n")[0]
            value = _headers(lines).get("content-length", "")
            if not lines.startswith(b"WARC/") or not value.isdigit():
                raise PackageError("no record where one should begin")
            length = len(lines) + 4 + int(value) + 4
        yield at, min(length, end - at)
        at += length


# Writing.


class _Plain:
    """What the ZIP writer needs of a stream that cannot go back."""

    def __init__(self, stream):
        self.stream = stream

    def write(self, data) -> int:
        self.stream.write(data)
        return len(data)

    def flush(self) -> None:
        pass


class Package:
    """A package that grows record by record; its index stays in memory until the end."""

    def __init__(self, folder: str):
        system, path = store_of(folder)
        system.create_dir(path, recursive=True)
        # Another attempt of the same task writes another file; only what a finished task lists is read.
        name = f"{uuid.uuid4().hex}.wacz"
        self.path = f"{folder}/{name}"
        self.stream = system.open_output_stream(f"{path}/{name}")
        self.zip = zipfile.ZipFile(_Plain(self.stream), "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(ARCHIVE, "w", force_zip64=True)
        self.size, self.index = 0, []
        self._put(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%b>\r\nWARC-Date: %b\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
                  % (str(uuid.uuid4()).encode(), DATE.encode()))

    def _put(self, data: bytes) -> tuple[int, int]:
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        packed = packer.compress(data) + packer.flush()
        self.member.write(packed)
        at, self.size = self.size, self.size + len(packed)
        return at, len(packed)

    def add(self, identity: str, url: str | None, payload: bytes, refers_to: str | None) -> None:
        kind = "response" if refers_to is None else "revisit"
        data, digest = record(kind, identity, url, payload, refers_to)
        at, length = self._put(data)
        line = {"url": url, "digest": f"sha1:{digest}", "offset": str(at), "length": str(length), "filename": ARCHIVE.split("/")[1]}
        self.index.append(f"{_line(url) if url else '-'} {re.sub('[^0-9]', '', DATE)} {json.dumps(line)}\n")

    @property
    def full(self) -> bool:
        return self.size >= PACKAGE_BYTES or len(self.index) >= PACKAGE_RECORDS

    def close(self) -> dict:
        self.member.close()
        self.zip.writestr(INDEX, "".join(self.index).encode())
        self.zip.close()
        size = self.stream.tell()
        self.stream.close()
        return {"path": [self.path], "n_records": [len(self.index)], "n_bytes": [size]}


def with_responses(pages: DataFrame, key: str, payload: str, least: int = LEAST_REVISIT) -> DataFrame:
    """``pages`` with ``_refers``: the largest key of an equal payload of ``least`` bytes, if another.

    Only digests and keys meet; the payloads move once, and those of a frequent payload are
    dealt out over many tasks. Smaller payloads do not move.
    """
    size, digest = F.octet_length(F.coalesce(payload, F.lit(""))), F.unhex(F.sha2(F.col(payload), 256))
    none = F.lit(None).cast(pages.schema[key].dataType)
    large = pages.where(size >= least).withColumn("_digest", digest)
    narrow = cut(large.select("_digest", F.col(key).alias("_response")))
    heads = (
        narrow.groupBy("_digest")
        .agg(F.max("_response").alias("_response"), F.count(F.lit(1)).alias("_times"))
        .where("_times > 1")
        .drop("_times")
    )
    joined = lookup(large, heads, ["_digest"], [key], HOT_ROWS, narrow)
    refers = F.when(F.col(key) < F.col("_response"), F.col("_response"))
    return (
        joined.withColumn("_refers", refers).drop("_digest", "_response")
        .unionByName(pages.where(size < least).withColumn("_refers", none))
    )


def write_packages(
    pages: DataFrame,
    folder: str | None = None,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least: int = LEAST_REVISIT,
) -> DataFrame:
    """(path, n_records, n_bytes) of the packages that hold a record per row of ``pages``.

    The payload is the text in UTF-8, NULL as the empty one. Of equal payloads of at least
    ``least`` bytes the row of the largest key is a response and those of smaller keys revisit
    it; rows that repeat the largest key are responses as well, and so is every row with a NULL
    key or a smaller payload. A NULL or empty URL leaves its header out; spaces and control
    characters in one are percent-encoded. Further columns are left out; an empty table has
    no packages. Every task writes packages of its own to ``folder``, which all executors share.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(payload).alias("_payload"))
    marked = with_responses(rows, "_key", "_payload", least)
    ready = marked.select(
        F.coalesce(F.col("_key").cast("string"), F.lit("")), "_url", F.col("_payload").cast("binary"), F.col("_refers").cast("string")
    )

    def write(batches):
        package = None
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for row in range(batch.num_rows):
                if package is None:
                    package = Package(folder)
                identity, address, body, refers = (column[row].as_py() for column in columns)
                package.add(identity, address, body or b"", refers)
                if package.full:
                    yield pa.RecordBatch.from_pydict(package.close())
                    package = None
        if package is not None:
            yield pa.RecordBatch.from_pydict(package.close())

    # Written once: the list of what finished tasks wrote, whatever other attempts left behind.
    return written(ready.mapInArrow(write, "path string, n_records bigint, n_bytes bigint"), "warc-packages")


# Reading.


def _located(paths: Iterator[pa.RecordBatch], rows_of, names: list[str], kinds: list) -> Iterator[pa.RecordBatch]:
    """Rows of every package; one that cannot be read gives a row that says why."""
    for batch in paths:
        for path in batch.column(0).to_pylist():
            held: list[list] = [[] for _ in names]
            count, problem = 0, None
            try:
                ranges = Ranges(path)
                try:
                    for row in rows_of(ranges):
                        for column, value in zip(held, (path, *row, None)):
                            column.append(value)
                        count += 1
                        if count % 10_000 == 0:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds)], names=names)
                            held = [[] for _ in names]
                finally:
                    ranges.close()
            except (PackageError, OSError, UnicodeDecodeError, struct.error, zlib.error) as error:
                problem = str(error) or type(error).__name__
            if problem is not None:
                for column, value in zip(held, (path, *[None] * (len(names) - 2), problem)):
                    column.append(value)
            if held[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(held, kinds)], names=names)


def _members(ranges: Ranges) -> Iterator[tuple]:
    for name, method, flags, size, header in entries_of(ranges):
        if not name.endswith("/"):
            yield name, method, data_of(ranges, header) if method == 0 and not flags & 1 else None, size


def package_members(packages: DataFrame, path: str = "path") -> DataFrame:
    """(path, member, method, at, size, problem): the members of every package, by its directory.

    ``at`` is where a stored member's data begins in the package; NULL for a compressed or
    encrypted one, which has no ranges to read. A package that cannot be read is one row
    with a ``problem``.
    """

    def run(batches):
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        yield from _located(batches, _members, ["path", "member", "method", "at", "size", "problem"], kinds)

    return _spread(packages, path).mapInArrow(
        run, "path string, member string, method int, at bigint, size bigint, problem string"
    )


def _spread(packages: DataFrame, path: str) -> DataFrame:
    parts = max(1, int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return packages.select(path).where(F.col(path).isNotNull()).repartition(parts, path)


def _places(ranges: Ranges) -> Iterator[tuple[str, int, int]]:
    """(member, where, length) of every record, by the indexes, else by reading archives through."""
    stored, archives, indexes = {}, [], []
    for name, method, at, size in _members(ranges):
        if name.startswith("archive/") and re.search(r"\.warc(\.gz)?$", name):
            if at is None:
                raise PackageError(f"{name} is not stored")
            archives.append(name)
            stored[name] = at, size
        elif re.fullmatch(r"indexes/.*\.cdxj?", name) and at is not None:
            indexes.append((at, size))
    for at, size in indexes:
        for line in _lines(ranges, at, size):
            try:
                fields = json.loads(line[line.index(b"{") :])
                member, offset, length = f"archive/{fields['filename']}", int(fields["offset"]), int(fields["length"])
            except (ValueError, KeyError, TypeError):
                raise PackageError("a line of the index cannot be read") from None
            begin, whole = stored.get(member, (0, -1))
            if offset < 0 or length < 0 or offset + length > whole:
                raise PackageError("the index points outside its archive")
            yield member, begin + offset, length
    if not indexes:
        for name in archives:
            for at, length in walked(ranges, *stored[name]):
                yield name, at, length


def _lines(ranges: Ranges, at: int, size: int) -> Iterator[bytes]:
    held, end = b"", at + size
    while at < end:
        strip = min(1 << 20, end - at)
        *lines, held = (held + ranges.read(at, strip)).split(b"\n")
        at += strip
        yield from (line for line in lines if line.strip())
    if held.strip():
        yield held


def record_places(packages: DataFrame, path: str = "path") -> DataFrame:
    """(path, member, at, length, problem): the byte range of every record of every package.

    The ranges come from the packages' indexes; a package without one is read through. A
    package that is damaged gives the records before the damage and a row with a ``problem``.
    """

    def run(batches):
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield from _located(batches, _places, ["path", "member", "at", "length", "problem"], kinds)

    return _spread(packages, path).mapInArrow(run, "path string, member string, at bigint, length bigint, problem string")


_RECORD = (
    "path string, at bigint, record_id string, record_type string, target_uri string, date string, payload binary, "
    "payload_bytes bigint, payload_digest string, refers_to string, problem string"
)


def read_records(packages: DataFrame, path: str = "path", payloads: bool = True) -> DataFrame:
    """(path, at, record_id, record_type, target_uri, date, payload, payload_bytes, payload_digest,
    refers_to, problem): every record of the packages, by range reads.

    Ranges of a package go to several tasks, neighbours to one, and neighbours are fetched by
    one read. Size and digest are those of the whole payload; a revisit has both from its
    headers and no payload. What is malformed, or holds another digest than it claims, has a
    ``problem``, as has a package that cannot be read; nothing fails the job. Rows of
    ``packages`` with a NULL path are left out. Without ``payloads`` that column is NULL.
    """
    places = record_places(packages, path)
    parts = max(1, int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    block = F.expr(f"at div {RANGE_BYTES}")
    dealt = places.repartition(parts, "path", block).sortWithinPartitions("path", "at")
    names = _RECORD.replace(",", "").split()[::2]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.int64(), *[pa.string()] * 3]

    def run(batches):
        ranges, opened = None, None
        for batch in batches:
            paths, ats, lengths, problems = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            row = 0
            while row < len(paths):
                if problems[row] is not None:
                    values = [paths[row], ats[row], *[None] * 8, problems[row]]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)
                    row += 1
                    continue
                last = row + 1
                while (
                    last < len(paths) and paths[last] == paths[row] and ats[last] == ats[last - 1] + lengths[last - 1]
                    and ats[last] + lengths[last] - ats[row] <= READ
                ):
                    last += 1
                if opened != paths[row]:
                    if ranges is not None:
                        ranges.close()
                    opened, ranges = paths[row], Ranges(paths[row])
                data = ranges.read(ats[row], ats[last - 1] + lengths[last - 1] - ats[row])
                rows = []
                for at, length in zip(ats[row:last], lengths[row:last]):
                    one = parsed(data[at - ats[row] : at - ats[row] + length])
                    one |= {"path": opened, "at": at} | ({} if payloads else {"payload": None})
                    rows.append([one[name] for name in names])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)
                row = last
        if ranges is not None:
            ranges.close()

    return dealt.mapInArrow(run, _RECORD)
