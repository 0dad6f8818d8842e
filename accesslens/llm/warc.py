"""WARC archives: write records, normalise whole-file gzip, read by offset.

``write_archives`` writes each partition as one *monolithic* gzip stream, the
form many producers deliver.  ``normalise`` inflates such a file once from
front to back, compresses every record as a gzip member of its own and writes
a sidecar index of offsets next to it, so that any record can be read alone.
``read_records`` reads the records back through that index.

Defined cases: a null payload is an empty one; a null URL leaves the target
header out; a null id is written without an id, is always a response and never
a target; rows repeated with the smallest id of their payload are all
responses.  Columns beside the three named ones are ignored.  Records are
streamed, so memory is bounded by the largest record, not by the file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accesslens.llm import files
from accesslens.llm.staging import output_folder, staged

GZIP = 31  # zlib's window setting for gzip framing
CHUNK = 1 << 20
MANIFEST = "path string, records long, bytes long"
INDEX = "path string, offset long, length long, record_id string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
RESPONSE, REVISIT = "response", "revisit"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header of our own: a revisit carries no payload, but the length of the one it stands for.
FULL_LENGTH = "X-Full-Payload-Length"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line: controls and ``%`` percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def _unclean(value: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    kind = RESPONSE if refers_to is None else REVISIT
    block = payload if kind == RESPONSE else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"{FULL_LENGTH}: {len(payload)}"]
    if kind == REVISIT:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def revisit_targets(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """``digest, first_id`` of every payload that more than one row carries."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    return (
        pages.where(F.octet_length(payload) >= min_bytes)
        .groupBy(F.sha2(payload, 256).alias("digest"))
        .agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first_id IS NOT NULL")
        .drop("n")
    )


def write_archives(
    pages: DataFrame, folder: str | None = None, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0
) -> DataFrame:
    """Write one monolithic ``.warc.gz`` a partition; returns its manifest.

    Payloads equal to one of at least ``min_bytes`` bytes under a smaller id
    become revisit records.  A file name is unique to its task attempt and
    only the manifest of successful attempts counts, so a repeated task leaves
    at worst a file that nothing refers to.
    """
    spark = pages.sparkSession
    folder = output_folder(spark, folder, "warc")
    targets = revisit_targets(pages, id_col, payload_col, min_bytes)
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    refers = F.when((F.octet_length("payload") >= min_bytes) & (F.col("first_id") < F.col("page_id")), F.col("first_id")).alias("refers_to")
    rows = rows.withColumn("digest", F.sha2("payload", 256)).join(targets, "digest", "left").select("page_id", "url", "payload", refers)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, records, total, out, packer = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0, None, None
        for batch in batches:
            for page_id, url, body, target in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if out is None:
                    out, packer = files.writer(f"{folder}/raw", name), zlib.compressobj(6, zlib.DEFLATED, GZIP)
                data = packer.compress(record_bytes(page_id, url, body, target))
                out.write(data)
                records, total = records + 1, total + len(data)
        if out is not None:
            data = packer.flush()
            out.write(data)
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/raw/{name}"], "records": [records], "bytes": [total + len(data)]})

    return staged(rows.mapInArrow(write, MANIFEST), "warc-manifest")


class _Stream:
    """The inflated bytes of a gzip file, of any number of members."""

    def __init__(self, source):
        self.source, self.inflate, self.buffer, self.done = source, zlib.decompressobj(GZIP), bytearray(), False
        self.inside = False  # whether a member has begun and not ended

    def _more(self) -> bool:
        if self.done:
            return False
        data = self.inflate.unconsumed_tail or self.inflate.unused_data
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(GZIP)
        data = data or self.source.read(CHUNK)
        if not data:
            if self.inside:
                raise ValueError("the archive ends inside a gzip member")
            self.done = True
            return False
        self.buffer += self.inflate.decompress(data, CHUNK)
        self.inside = not self.inflate.eof
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the stream."""
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self._more():
                if self.buffer:
                    raise ValueError("the archive ends inside a record header")
                return None
        return self.take(at + len(mark))

    def take(self, size: int) -> bytes:
        while len(self.buffer) < size:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.buffer[:size])
        del self.buffer[:size]
        return out


def headers_of(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:] if line)}


def records_in(source) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """Every record of a gzip stream: its header bytes, headers and block."""
    stream = _Stream(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        headers = headers_of(head)
        block = stream.take(int(headers["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield head, headers, block


def normalise(manifest: DataFrame, folder: str | None = None, tasks: int | None = None) -> DataFrame:
    """Rewrite every file of ``manifest.path`` with a member per record.

    Each file is inflated once, as a stream, by one task: a monolithic gzip
    stream has no point to start from but its beginning.  Beside each output
    file lies ``<file>.idx``, a JSON line a record.  Returns the same index as
    a table: path, offset, length, record_id.
    """
    spark = manifest.sparkSession
    folder = output_folder(spark, folder, "warc")
    tasks = tasks or max(1, manifest.count())

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = f"part-{uuid.uuid4().hex}.warc.gz"
                index: dict[str, list] = {"path": [], "offset": [], "length": [], "record_id": []}
                at = 0
                with files.reader(path) as source, files.writer(f"{folder}/members", name) as out, files.writer(f"{folder}/members", f"{name}.idx") as sidecar:
                    for head, headers, block in records_in(source):
                        packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                        member = packer.compress(head + block + b"\r\n\r\n") + packer.flush()
                        out.write(member)
                        entry = {"path": f"{folder}/members/{name}", "offset": at, "length": len(member), "record_id": headers["warc-record-id"]}
                        sidecar.write(json.dumps(entry).encode() + b"\n")
                        for key, value in entry.items():
                            index[key].append(value)
                        at += len(member)
                        if len(index["path"]) >= 10_000:
                            yield pa.RecordBatch.from_pydict(index)
                            index = {key: [] for key in index}
                if index["path"]:
                    yield pa.RecordBatch.from_pydict(index)

    return staged(manifest.select("path").repartition(tasks).mapInArrow(rewrite, INDEX), "warc-index")


def _page_of(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read_records(index: DataFrame) -> DataFrame:
    """The records an index names, each inflated from its own member.

    The digest and the length of a response are computed from its payload and
    must agree with its header; a revisit's are those of the payload it stands
    for, from its header.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows: list[tuple] = []
            for path, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if path != name:
                    if source is not None:
                        source.close()
                    name, source = path, files.reader(path)
                source.seek(offset)
                head, _, rest = zlib.decompress(source.read(length), GZIP).partition(b"\r\n\r\n")
                headers = headers_of(head)
                digest, size = headers["warc-payload-digest"].removeprefix("sha1:"), int(headers[FULL_LENGTH.lower()])
                if headers["warc-type"] == RESPONSE:
                    payload = rest[: int(headers["content-length"])]
                    if (payload_digest(payload), len(payload)) != (digest, size):
                        raise ValueError(f"the payload at {path}:{offset} differs from its header")
                url = headers.get("warc-target-uri")
                rows.append((_page_of(headers["warc-record-id"]), None if url is None else _unclean(url), size, digest, headers["warc-type"], _page_of(headers.get("warc-refers-to"))))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)],
                ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )
        if source is not None:
            source.close()

    return index.select("path", "offset", "length").mapInArrow(read, RECORD)


def archive_round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None, *, min_bytes: int = 0, **columns: str) -> DataFrame:
    """Write ``pages``, normalise the files, and read every record back."""
    return read_records(normalise(write_archives(pages, folder, min_bytes=min_bytes, **columns), folder))
