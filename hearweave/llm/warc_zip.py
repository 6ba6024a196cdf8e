"""WARC records in ZIP packages: writing them, and reading them back by ranges.

A package is a ZIP whose members are stored, not compressed: archive/data.warc.gz (a gzip member for
each record) and indexes/index.cdx (a line for each record: key, offset and length). The reader
finds the central directory from the end of the file, with its ZIP64 forms, and then reads only
the byte ranges it needs: the directory, the index, and the records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from hearweave.llm.common import BATCH_BYTES, new_path, slices, stored

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: A package is closed when its records pass this size; a task keeps one package in memory.
PACKAGE_BYTES = 32 << 20
#: Payloads below this many bytes are never revisits.
LEAST_BYTES = 100
#: Records of a range, and the most tasks that ranges are dealt to.
RANGE, MOST_TASKS = 2_000, 20_000

# Signatures of the ZIP format.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
# Fixed value: the profile of a WARC 1.1 revisit record of an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the place in it of a path or URI that executors share."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


# Records


def record(page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    """A WARC record as a gzip member; a revisit leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    lines += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parsed(member: bytes) -> dict:
    """What a record says, with its payload's size and digest. For responses both are of the payload
    that was read; for revisits of the one they refer to, as the record states them."""
    data = zlib.decompress(member, 47)
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = warc["warc-type"]
    stated = warc["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response":
        digest = hashlib.sha256(payload).hexdigest()
        if digest != stated:
            raise ValueError(f"payload of {warc['warc-record-id']} has digest {digest}, not {stated}")
        length = len(payload)
    else:
        digest, length = stated, int(_headers(http)["content-length"])
    return {
        "page_id": _page(warc["warc-record-id"]), "url": warc.get("warc-target-uri"), "payload": payload, "payload_bytes": length,
        "payload_digest": digest, "record_type": kind, "refers_to": _page(warc.get("warc-refers-to")),
    }


# Packages


def package(records: list[bytes], keys: list[str], zip64: bool = False) -> bytes:
    """A ZIP of the records and their index, all stored."""
    lines, at = [], 0
    for key, data in zip(keys, records):
        lines.append(f"{key} {at} {len(data)}\n")
        at += len(data)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ((ARCHIVE, b"".join(records)), (INDEX, "".join(lines).encode())):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as member:
                member.write(data)
    return out.getvalue()


class Ranges:
    """Reads byte ranges of a file."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()

    def at(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        data = self.file.read(length)
        if len(data) != length:
            raise ValueError(f"file ends at {start + len(data)}, before {start + length}")
        return data


def members(file: Ranges) -> dict[str, tuple[int, int]]:
    """Start and length of the data of each stored member, from the central directory."""
    tail_at = max(0, file.size - 65_557)
    tail = file.at(tail_at, file.size - tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack("<H2L", tail[end + 10 : end + 20])
    if count == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = file.at(tail_at + end - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        record64 = file.at(struct.unpack("<Q", locator[8:16])[0], 56)
        if record64[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, size, start = struct.unpack("<3Q", record64[32:56])
    directory, at, found = file.at(start, size), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != ENTRY:
            raise ValueError("damaged central directory")
        method, _, _, _, packed, full, n_name, n_extra, n_comment = struct.unpack("<HHHLLLHHH", directory[at + 10 : at + 34])
        offset = struct.unpack("<L", directory[at + 42 : at + 46])[0]
        name = directory[at + 46 : at + 46 + n_name].decode()
        full, packed, offset = _zip64(directory[at + 46 + n_name : at + 46 + n_name + n_extra], full, packed, offset)
        at += 46 + n_name + n_extra + n_comment
        if method == 0:
            local = file.at(offset, 30)
            if local[:4] != LOCAL:
                raise ValueError("damaged local header")
            found[name] = (offset + 30 + sum(struct.unpack("<HH", local[26:30])), full)
    return found


def _zip64(extra: bytes, *values: int) -> list[int]:
    """values, where 0xFFFFFFFF stands for the next number in the ZIP64 extra field."""
    at, numbers = 0, iter(())
    while at + 4 <= len(extra):
        kind, length = struct.unpack("<HH", extra[at : at + 4])
        if kind == 1:
            numbers = iter(struct.unpack(f"<{length // 8}Q", extra[at + 4 : at + 4 + length // 8 * 8]))
        at += 4 + length
    return [next(numbers) if v == 0xFFFFFFFF else v for v in values]


# On Spark


def with_roles(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, url, payload, payload_bytes, payload_digest, record_type, refers_to for each page.

    Of equal payloads of LEAST_BYTES or more, the rows with the smallest key are responses and the
    others revisit it; a null key is larger than all. Rows that repeat under the smallest key are all
    responses. The groups are counted before anything is moved, and only those of several pages are
    joined, by digest; Spark splits the partitions of hot digests.
    """
    payload = F.coalesce(F.encode(html, "utf-8"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "_sha": F.unhex(F.sha2("payload", 256))})
    groups = rows.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy("_sha")
    groups = groups.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = rows.join(groups.select("_sha", "first", F.lit(True).alias("several")), "_sha", "left")
    revisit = F.col("several").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", F.lower(F.hex("_sha")).alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"),
    )


def write_packages(roles: DataFrame, folder: str) -> DataFrame:
    """Writes roles as packages in folder; returns (path, records), of finished tasks only.

    A task that runs again writes under another name, so nothing half-written is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, place = opened(folder)
        where.create_dir(place, recursive=True)
        context, n = TaskContext.get(), 0
        records: list[bytes] = []
        keys: list[str] = []

        def close() -> pa.RecordBatch:
            nonlocal n
            name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{n}-{uuid.uuid4().hex[:8]}.wacz"
            with where.open_output_stream(f"{place}/{name}") as out:
                out.write(package(records, keys))
            done = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([len(records)], pa.int64())})
            records.clear()
            keys.clear()
            n += 1
            return done

        size = 0
        for batch in slices(batches, "payload"):
            for r in batch.to_pylist():
                records.append(record(*(r[c] for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"))))
                keys.append(str(r["page_id"]))
                size += len(records[-1])
                if size >= PACKAGE_BYTES:
                    size = 0
                    yield close()
        if records:
            yield close()

    columns = ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return roles.select(*columns).mapInArrow(run, "path string, records long")


def read_packages(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the packages in manifest: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, and with payloads also payload.

    Each task takes ranges of RANGE records: it parses the package's directory, reads the index,
    and then the bytes of its records only.
    """
    tasks = manifest.agg(F.sum(F.ceil(F.col("records") / RANGE)).alias("n")).first()["n"] or 1
    ranges = manifest.select("path", F.explode(F.sequence(F.lit(0), F.col("records") - 1, F.lit(RANGE))).alias("start"))
    fields = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    schema = fields + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                where, place = opened(r["path"])
                with where.open_input_file(place) as file:
                    reader = Ranges(file)
                    found = members(reader)
                    base, _ = found[ARCHIVE]
                    lines = reader.at(*found[INDEX]).decode().splitlines()[r["start"] : r["start"] + RANGE]
                    rows, size = [], 0
                    for line in lines:
                        _, offset, length = line.rsplit(" ", 2)
                        found_ = parsed(reader.at(base + int(offset), int(length)))
                        size += len(found_["payload"]) if payloads else 0
                        rows.append({n: found_[n] for n in names})
                        if size > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return ranges.repartition(min(int(tasks), MOST_TASKS), "path", "start").mapInArrow(run, schema)


def archived(pages: DataFrame) -> DataFrame:
    """Writes pages as WARC packages to the shared folder and reads the records back.

    Null html is an empty payload; null urls give records without a target; an empty table gives no
    packages and no rows; each repeated row has a record of its own. Columns besides page_id, url and
    html are not archived.
    """
    manifest = stored(write_packages(with_roles(pages), new_path(pages.sparkSession, "warc")), "manifest")
    return read_packages(manifest)
