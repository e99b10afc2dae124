"""WARC records in ZIP-packaged archives: write them, and read them back by range without extraction.

An archive is a ZIP64 file of stored members: archive/data.warc.gz (one gzip member per record) and indexes/index.cdx
(one line per record: offset and length within the data member). Reading follows the end record, the ZIP64 locator and
end record, the central directory and the local headers, then fetches byte ranges.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import checked, discard, group_extreme, released, scratch_path, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 4 << 20
#: Archive bytes that one task of the read-back is given.
TASK_BYTES = 4 << 20
EPOCH = "2024-01-01T00:00:00Z"
_STAMP = struct.pack("<HH", 0, 0x5821)  # 2024-01-01 in DOS form


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that all executors share, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.FileSystem.from_uri("file://" + path.removeprefix("file:")))


# ---- ZIP64 writing


def _local_header(name: bytes, crc: int, size: int) -> bytes:
    extra = struct.pack("<HHQQ", 1, 16, size, size)
    return struct.pack("<IHHH", 0x04034B50, 45, 0x800, 0) + _STAMP + struct.pack("<IIIHH", crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra)) + name + extra


def _central_header(name: bytes, crc: int, size: int, at: int) -> bytes:
    extra = struct.pack("<HHQQQ", 1, 24, size, size, at)
    return (
        struct.pack("<IHHHH", 0x02014B50, 45, 45, 0x800, 0) + _STAMP
        + struct.pack("<IIIHHHHHII", crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    )


def write_zip64(out: BinaryIO, members: list[tuple[str, bytes]]) -> int:
    """Stored members, a central directory with ZIP64 sizes and offsets, both end records. Returns the file's size."""
    at, central = 0, []
    for name, body in members:
        raw, crc = name.encode(), zlib.crc32(body)
        head = _local_header(raw, crc, len(body))
        out.write(head)
        out.write(body)
        central.append(_central_header(raw, crc, len(body), at))
        at += len(head) + len(body)
    directory = b"".join(central)
    out.write(directory)
    n = len(members)
    out.write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, len(directory), at))
    out.write(struct.pack("<IIQI", 0x07064B50, 0, at + len(directory), 1))
    out.write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    return at + len(directory) + 56 + 20 + 22


# ---- ZIP reading


class ArchiveError(ValueError):
    pass


def members_of(read_at, size: int) -> list[dict]:
    """Entries of the central directory: name, method, compressed size, size, offset of the local header.

    read_at(offset, length) returns bytes. Plain and ZIP64 archives are read; comments up to 65,535 bytes are allowed.
    """
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = read_at(tail_at, size - tail_at)
    i = tail.rfind(b"PK\x05\x06")
    while i >= 0 and (i + 22 > len(tail) or i + 22 + struct.unpack_from("<H", tail, i + 20)[0] != len(tail)):
        i = tail.rfind(b"PK\x05\x06", 0, i)
    if i < 0:
        raise ArchiveError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, i + 10)
    end_at = tail_at + i
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = read_at(end_at - 20, 20) if end_at >= 20 else b""
        if locator[:4] != b"PK\x06\x07":
            raise ArchiveError("no ZIP64 locator")
        record = read_at(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ArchiveError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, at, out = read_at(start, length), 0, []
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ArchiveError("broken central directory")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed, plain, n, m, k = struct.unpack_from("<IIHHH", directory, at + 20)
        offset = struct.unpack_from("<I", directory, at + 42)[0]
        name, extra = directory[at + 46 : at + 46 + n], directory[at + 46 + n : at + 46 + n + m]
        j = 0
        while j + 4 <= len(extra):
            tag, length64 = struct.unpack_from("<HH", extra, j)
            if tag == 1:
                values = iter(struct.unpack_from(f"<{length64 // 8}Q", extra, j + 4))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                offset = next(values) if offset == 0xFFFFFFFF else offset
            j += 4 + length64
        out.append({"name": name.decode("utf-8", "replace"), "method": method, "packed": packed, "size": plain, "offset": offset})
        at += 46 + n + m + k
    return out


def stored_at(read_at, member: dict) -> int:
    """Where a stored member's bytes begin."""
    if member["method"] != 0:
        raise ArchiveError(f"{member['name']} is compressed as a whole")
    head = read_at(member["offset"], 30)
    if head[:4] != b"PK\x03\x04":
        raise ArchiveError("no local header")
    n, m = struct.unpack_from("<HH", head, 26)
    return member["offset"] + 30 + n + m


# ---- WARC records


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page: int | None) -> str:
    return f"<urn:residua:page:{'' if page is None else page}>"


def make_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, str]:
    """A WARC/1.1 record and its payload digest. A revisit keeps the HTTP head, with the payload's length, and no body."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A").replace("\x00", "%00")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page)}", f"WARC-Target-URI: {target}",
        f"WARC-Date: {EPOCH}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def _page(urn: str | None) -> int | None:
    text = (urn or "").rstrip(">").rpartition(":")[2]
    return int(text) if text else None


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ArchiveError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = next(int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != declared or base32_sha1(payload) != digest):
        raise ArchiveError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")
    return {
        "page_id": _page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": declared, "payload_digest": digest, "record_type": kind,
        "refers_to": _page(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(folder)
        fs.create_dir(root, recursive=True)
        parts, index, at = [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"pages-{uuid.uuid4().hex}.wacz"  # a retried task writes other files; only those it reports are read
            with fs.open_output_stream(f"{root}/{name}") as out:
                size = write_zip64(out, [(DATA, b"".join(parts)), (INDEX, "".join(index).encode())])
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([len(index)], pa.int64())], ["archive", "bytes", "records"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                for page, url, html, to in zip(*[part.column(i).to_pylist() for i in range(4)]):
                    raw, digest = make_record(page, url, (html or "").encode("utf-8", "surrogatepass"), to)
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    packed = packer.compress(raw) + packer.flush()
                    index.append(f"{'' if page is None else page} {at} {len(packed)} {digest} {'response' if to is None else 'revisit'}\n")
                    parts.append(packed)
                    at += len(packed)
                    if at >= ARCHIVE_BYTES:
                        yield flush()
                        parts.clear(), index.clear()
                        at = 0
        if index:
            yield flush()

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Writes a record per row into archives below folder (shared storage); returns the written table (archive, bytes,
    records) of the archives that hold them.

    Of rows with equal payloads of at least min_revisit_bytes, the largest id is a response and the others revisit it;
    shorter payloads are all responses. A null html is an empty payload. A null id never is what others refer to: such
    rows revisit the group's largest id, or are responses if it has none. Rows that repeat the largest id are responses.
    """
    base = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    raw = F.col("html").cast("binary")
    keyed = base.withColumn("_size", F.octet_length(raw)).withColumn("_digest", F.unhex(F.sha1(raw)))
    # heads are found on digests alone; the payloads are not shuffled while the revisits fit a checked broadcast
    heads = group_extreme(keyed.select("page", "_digest", "_size"), ["_digest", "_size"], "page", "_head", largest=True)
    other = (F.col("_size") >= min_revisit_bytes) & F.col("_head").isNotNull() & ~F.col("page").eqNullSafe(F.col("_head"))
    again = written(heads.where(other).select(F.col("page").alias("_p"), F.col("_digest").alias("_d"), F.col("_size").alias("_s"), F.col("_head").alias("to")).distinct(), "revisits")
    same = F.col("page").eqNullSafe(F.col("_p")) & (F.col("_digest") == F.col("_d")) & (F.col("_size") == F.col("_s"))
    rows = keyed.join(checked(again), same, "left").select("page", "url", "html", "to")
    archives = written(rows.mapInArrow(released(_writer(folder)), "archive string, bytes long, records long"), "archives")
    discard(again)
    return archives


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, inner = opened(path)
            with fs.open_input_file(inner) as f:
                read_at = lambda at, n, f=f: f.read_at(n, at)
                names = {m["name"]: m for m in members_of(read_at, f.size())}
                data = stored_at(read_at, names[DATA])
                lines = read_at(stored_at(read_at, names[INDEX]), names[INDEX]["size"]).decode().splitlines()
            cells = [x.split(" ") for x in lines]
            at = [data + int(c[1]) for c in cells]
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(at)), pa.array([a // RANGE_BYTES for a in at], pa.int64()), pa.array(at, pa.int64()), pa.array([int(c[2]) for c in cells], pa.int64())],
                ["archive", "block", "at", "length"],
            )


def locate_records(archives: DataFrame) -> DataFrame:
    """(archive, block, at, length): the byte range of every record, from the directories and index members alone."""
    return archives.select("archive").mapInArrow(_locate, "archive string, block long, at long, length long")


def _fetch(keep_payload: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        path, at, length = table.column("archive")[0].as_py(), table.column("at").to_pylist(), table.column("length").to_pylist()
        fs, inner = opened(path)
        with fs.open_input_file(inner) as f:
            span = f.read_at(at[-1] + length[-1] - at[0], at[0])
        rows = [parse_record(zlib.decompress(span[a - at[0] : a - at[0] + n], 31)) for a, n in zip(at, length)]
        columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if keep_payload else [])]
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        return pa.table({c: pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in columns})

    return run


def read_archives(archives: DataFrame, *, keep_payload: bool = True) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload if wanted.

    Records are located first; then each group of neighbouring records (RANGE_BYTES of one archive) is one range read.
    Responses are checked against their digest. An empty table of archives gives an empty table.
    """
    ranges = locate_records(archives)
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if keep_payload else "")
    volume = archives.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    spread = ranges.repartition(max(1, -(-volume // TASK_BYTES)), "archive", "block")
    return spread.groupBy("archive", "block").applyInArrow(_fetch(keep_payload), ddl)


def archive_folder(spark) -> str:
    return scratch_path(spark, "warc")
