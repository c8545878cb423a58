"""WARC records in ZIP archives: a writer and a range reader (operator 8).

The writer packs pages as WARC records into archives of stored (uncompressed) members: WARC files
of bounded size and, for each, an index of where its records begin. Directories are written as
ZIP64 where sizes or counts ask for it, or always if told so.

The reader never extracts an archive. It range-reads the end of the file, follows the ZIP64
locator if there is one, reads the central directory, finds the stored members and their indexes,
and range-reads the members' records, a bounded piece at a time.

Archives live in the shared folder of the cluster, reached through ``pyarrow.fs`` by URI. A task
writes to a name of its own attempt and then renames, so a task that runs again leaves one archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import binaries, gathered, shared_dir, written

# The ZIP format's signatures and limits.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
MOST_16, MOST_32, ZIP64_FIELD = 0xFFFF, 0xFFFFFFFF, 1
#: A member holds records up to about this size.
MEMBER_BYTES = 8 << 20
#: Records that follow each other are read at once up to this size; a larger one is read alone.
READ_BYTES = 1 << 20
ARCHIVE_BYTES = 256 << 20
DATE = "2000-01-01T00:00:00Z"


class Stored:
    """Writes stored members to a stream, then the central directory."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.zip64, self.members = out, 0, zip64, []

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        crc, raw, at = zlib.crc32(data), name.encode(), self.at
        wide = self.zip64 or len(data) >= MOST_32
        extra = struct.pack("<HHQQ", ZIP64_FIELD, 16, len(data), len(data)) if wide else b""
        size = MOST_32 if wide else len(data)
        self.put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra)
        self.put(data)
        self.members.append((raw, crc, len(data), at))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, at in self.members:
            wide = self.zip64 or size >= MOST_32 or at >= MOST_32
            extra = struct.pack("<HHQQQ", ZIP64_FIELD, 24, size, size, at) if wide else b""
            s, o = (MOST_32, MOST_32) if wide else (size, at)
            self.put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 0x21, crc, s, s, len(raw), len(extra), 0, 0, 0, 0, o) + raw + extra)
        length, n = self.at - start, len(self.members)
        if wide := self.zip64 or n >= MOST_16 or start >= MOST_32 or length >= MOST_32:
            end = self.at
            self.put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, length, start))
            self.put(LOCATOR64 + struct.pack("<IQI", 0, end, 1))
        c, s, o = (MOST_16, MOST_32, MOST_32) if wide else (n, length, start)
        self.put(END + struct.pack("<HHHHIIH", 0, 0, c, c, s, o, 0))


def directory(source, size: int) -> list[tuple[str, int, int, int]]:
    """Members of an archive as (name, method, size, where its local header is), by range reads.

    A file that is cut short or has no complete directory raises ValueError.
    """
    tail = _range(source, max(0, size - 65_557), size)
    found = tail.rfind(END)
    while found >= 0 and (found + 22 > len(tail) or found + 22 + struct.unpack_from("<H", tail, found + 20)[0] != len(tail)):
        found = tail.rfind(END, 0, found)  # these bytes stand in the archive's comment
    if found < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, found + 10)
    at = size - len(tail) + found
    if MOST_16 == count or MOST_32 in (length, start):
        locator = _range(source, at - 20, at)
        if locator[:4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        where = struct.unpack_from("<Q", locator, 8)[0]
        count, length, start = struct.unpack_from("<QQQ", _range(source, where, where + 56), 32)
    raw, members, k = _range(source, start, start + length), [], 0
    for _ in range(count):
        if raw[k : k + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, n, n_name, n_extra, n_note, offset = (struct.unpack_from(f, raw, k + o)[0] for f, o in (("<H", 10), ("<I", 24), ("<H", 28), ("<H", 30), ("<H", 32), ("<I", 42)))
        packed = struct.unpack_from("<I", raw, k + 20)[0]
        name = raw[k + 46 : k + 46 + n_name].decode()
        extra, e = raw[k + 46 + n_name : k + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, m = struct.unpack_from("<HH", extra, e)
            if kind == ZIP64_FIELD:
                values = iter(struct.unpack_from(f"<{m // 8}Q", extra, e + 4))
                n = next(values) if n == MOST_32 else n
                packed = next(values) if packed == MOST_32 else packed
                offset = next(values) if offset == MOST_32 else offset
            e += 4 + m
        members.append((name, method, n, offset))
        k += 46 + n_name + n_extra + n_note
    return members


def _range(source, start: int, end: int) -> bytes:
    source.seek(start)
    return source.read(end - start)


def member_start(source, header: int) -> int:
    """Where a member's data begins: after its local header, whose fields may differ from the directory's."""
    local = _range(source, header, header + 30)
    if local[:4] != LOCAL:
        raise ValueError("no local header")
    return header + 30 + sum(struct.unpack_from("<HH", local, 26))


def base32_sha1(column: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column, as a native expression."""
    digest = F.sha1(column)
    groups = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda k: F.lpad(F.conv(F.substring(digest, k * 5 + 1, F.lit(5)), 16, 32), 4, "0"),
    )
    # conv counts 0-9A-V; base32 counts A-Z2-7
    return F.translate(F.array_join(groups, ""), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, sha: str, kind: str, refers_to, number: int) -> bytes:
    """One WARC/1.1 record. A revisit has no payload of its own and names the record it repeats."""
    block = b"" if kind == "revisit" else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}#{number}')}>",
        f"WARC-Date: {DATE}",
        "Content-Type: text/html",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"X-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def classified(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages with payload (binary), payload_digest, record_type and refers_to.

    Of pages with equal payloads of at least ``least`` bytes, the one with the largest page_id is a
    response and the others revisit it; repeated rows with that page_id are all responses, and so
    are pages whose group has no page_id at all. Null html is an empty payload.

    Only groups of more than one row go back to the rows, by an outer join whose two sides are
    shuffled by the digest, so that the engine can split a digest that many pages share.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumns({"payload_digest": base32_sha1(F.col("payload")), "payload_bytes": F.length("payload").cast("long")})
    light = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    groups = (
        light.where(F.length("payload") >= least)
        .select(base32_sha1(F.col("payload")).alias("digest"), "page_id")
        .groupBy("digest")
        .agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
        .where("n > 1 and original is not null")
        .select("digest", "original")
    )
    groups = written(groups, "warc-groups")
    joined = base.join(groups, (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") >= least), "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("original")).alias("refers_to"),
    )


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, member_bytes: int = MEMBER_BYTES, zip64: bool = False) -> DataFrame:
    """Write the records of classified pages to ZIP archives under ``folder``; returns (archive, size, n_records).

    The returned table must be written or collected once: it is the run of the writer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        part, made = context.partitionId(), []
        out = held = temporary = None
        number = 0

        def finish() -> None:
            nonlocal held, index, records
            if held.tell():
                name = f"data-{len(out.members) // 2:05d}.warc"
                out.add(name, held.getvalue())
                out.add(name + ".idx", json.dumps(index).encode())
            held, index = io.BytesIO(), []

        def close() -> None:
            nonlocal out
            finish()
            out.close()
            size = out.at
            out.out.close()
            final = f"{base}/part-{part:05d}-{len(made):04d}.zip"
            store.move(temporary, final)
            made.append((f"part-{part:05d}-{len(made):04d}.zip", size, records))
            out = None

        index: list[int] = []
        records = 0
        for batch in batches:
            for page, url, payload, sha, kind, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")), strict=True):
                if out is None:
                    store.create_dir(base, recursive=True)
                    temporary = f"{base}/.part-{part:05d}-{len(made):04d}-{context.taskAttemptId()}"
                    out, held, index, records = Stored(store.open_output_stream(temporary), zip64), io.BytesIO(), [], 0
                index.append(held.tell())
                held.write(record(page, url, payload, sha, kind, refers, number))
                records += 1
                number += 1
                if held.tell() >= member_bytes:
                    finish()
                if out.at >= archive_bytes:
                    close()
        if out is not None:
            close()
        if made:
            yield pa.RecordBatch.from_pydict(dict(zip(("archive", "size", "n_records"), map(list, zip(*made, strict=True)), strict=True)))

    return pages.mapInArrow(run, "archive string, size long, n_records long")


def members(spark: SparkSession, folder: str, archives: DataFrame) -> DataFrame:
    """The stored WARC members of archives with the place of their data and of their index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, size in zip(batch.column("archive").to_pylist(), batch.column("size").to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{name}") as source:
                    found = {m: (method, n, at) for m, method, n, at in directory(source, size)}
                    rows = []
                    for m, (method, n, at) in found.items():
                        if method == 0 and m.endswith(".warc"):
                            _, n_index, at_index = found.get(m + ".idx", (0, 0, -1))
                            rows.append({"archive": name, "member": m, "at": member_start(source, at), "n": n, "index_at": member_start(source, at_index) if at_index >= 0 else -1, "index_n": n_index})
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows)

    return archives.mapInArrow(run, "archive string, member string, at long, n long, index_at long, index_n long")


RECORDS = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def read(found: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the members that ``members`` found: the records of the index are range-read, small ones that follow each other at once.

    A member without an index is walked from header to header. Records that are cut short, are no
    WARC records or do not match their digest raise ValueError with the archive's name.
    """

    def records(store, base, row) -> Iterator[tuple[tuple, int]]:
        with store.open_input_file(f"{base}/{row['archive']}") as source:
            if row["index_at"] >= 0:
                starts = json.loads(_range(source, row["index_at"], row["index_at"] + row["index_n"]))
            else:
                starts = boundaries(source, row["at"], row["n"])
            ends = [*starts[1:], row["n"]]
            for first, last in together(starts, ends):
                data = _range(source, row["at"] + starts[first], row["at"] + ends[last])
                for k in range(first, last + 1):
                    yield one(data[starts[k] - starts[first] : ends[k] - starts[first]], row["archive"])

    def one(raw: bytes, archive: str) -> tuple[tuple, int]:
        try:
            head, block = parsed(raw)
            number = lambda k: int(head[k]) if k in head else None
            sha = head["warc-payload-digest"].removeprefix("sha1:")
            if len(block) != int(head["content-length"]) or head["warc-type"] == "response" and digest(block) != sha:
                raise ValueError("payload does not match its length or digest")
            return (
                (number("x-page-id"), head.get("warc-target-uri"), head["warc-type"], sha, number("x-payload-length"), number("x-refers-to-page-id"), block if payloads else None),
                len(block) if payloads else 64,
            )
        except (ValueError, KeyError, IndexError) as e:
            raise ValueError(f"broken record in {archive}: {e}") from e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                yield from gathered(RECORDS, records(store, base, row))

    return found.mapInArrow(run, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def together(starts: list[int], ends: list[int]) -> Iterator[tuple[int, int]]:
    """Runs (first, last) of consecutive records of ``READ_BYTES`` together, or of one larger record."""
    first = 0
    for k in range(len(starts)):
        if k > first and ends[k] - starts[first] > READ_BYTES:
            yield first, k - 1
            first = k
    if starts:
        yield first, len(starts) - 1


def boundaries(source, start: int, size: int) -> list[int]:
    """Where the records of a member begin, by reading their headers alone."""
    starts, at = [], 0
    while at < size:
        starts.append(at)
        head, upto = b"", at
        while b"\r\n\r\n" not in head:
            if upto >= size:
                raise ValueError("a record's header is cut short")
            head += _range(source, start + upto, start + min(upto + 4096, size))
            upto = min(upto + 4096, size)
        end = head.index(b"\r\n\r\n")
        length = next((int(x[16:]) for x in head[:end].split(b"\r\n") if x.startswith(b"Content-Length: ")), None)
        if length is None:
            raise ValueError("a record without a length")
        at += end + 4 + length + 4
    return starts


def round_trip(pages: DataFrame, least: int = 0, **options) -> DataFrame:
    """Write pages to archives in the shared folder and read the records back."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/tessera/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    folder = "file://" + folder.removeprefix("file:").removeprefix("//") if folder.startswith("file:") else folder
    archives = written(write(classified(pages, least), folder, **options), "warc-archives")
    found = written(members(spark, folder, archives), "warc-members")
    return read(found.repartition(max(1, found.count() // 4 or 1)), folder)


def report(records: DataFrame) -> DataFrame:
    """The contract's columns, from what was read back."""
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
