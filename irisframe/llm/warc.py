"""WARC archives: writing with segments and revisits, and reassembly on reading.

Writing is an ordinary text sink whose line separator ends a record, so archives
are plain (gzip) files in a folder. Reading splits files into records, groups
continuation records by the identifier of their origin, orders them by segment
number, verifies the total length, and undoes the chunked transfer framing.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irisframe.llm.common import stored

#: Payloads below this are never revisits.
MIN_REVISIT = 100
CHUNK = 4096
SEGMENT = 16384
RECORDS_PER_FILE = 2000
_BATCH_BYTES = 8 << 20
_END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of payloads that a smaller page_id has already."""
    slim = pages.filter(F.col("page_id").isNotNull()).select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    slim = slim.filter(F.octet_length("html") >= MIN_REVISIT).select("page_id", F.sha2("html", 256).alias("digest"))
    first = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    first = first.filter("last > refers_to").drop("last")
    return slim.join(first, "digest").filter("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def _record(fields: dict[str, object], block: str) -> str:
    named = {**fields, "Content-Length": len(block.encode())}
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named.items() if v is not None) + "\r\n" + block


def _segments(text: str, size: int) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text), size)] or [""]


def page_records(identity: str, page_id: int | None, url: str | None, html: str, refers_to: int | None) -> list[str]:
    """The records of one page; a response above one segment gets continuations."""
    raw = html.encode()
    target = "".join(c if c.isprintable() else "%" for c in url) if url else None
    own = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{identity}>",
        "WARC-Date": "2026-01-01T00:00:00Z",
        "WARC-Target-URI": target,
        "WARC-Page-ID": page_id,
        "WARC-Payload-Digest": f"sha256:{hashlib.sha256(raw).hexdigest()}",
        "WARC-Refers-To-Page-ID": refers_to,
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        return [_record(own, _HTTP)]
    body = "".join(f"{len(part.encode()):x}\r\n{part}\r\n" for part in _segments(html, CHUNK) if part)
    block = f"{_HTTP}{body}0{_END}"
    parts = _segments(block, SEGMENT)
    if len(parts) == 1:
        return [_record(own, block)]
    out = [_record({**own, "WARC-Segment-Number": 1}, parts[0])]
    for number, part in enumerate(parts[1:], 2):
        fields = {
            "WARC-Type": "continuation",
            "WARC-Record-ID": f"<urn:page:{identity}/{number}>",
            "WARC-Date": own["WARC-Date"],
            "WARC-Segment-Origin-ID": own["WARC-Record-ID"],
            "WARC-Segment-Number": number,
            "WARC-Segment-Total-Length": len(block.encode()) if number == len(parts) else None,
        }
        out.append(_record(fields, part))
    return out


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``pages`` (page_id, url, html) as gzip WARC files under ``path``.

    A null html is an empty payload; a page without page_id is always a response;
    repeated rows get records of their own. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, size = [], 0
            for page in zip(*[batch.column(n).to_pylist() for n in ("page_id", "url", "html", "refers_to")]):
                records = page_records(f"{task}-{row}", page[0], page[1], page[2] or "", page[3])
                row += 1
                out += records
                size += sum(map(len, records))
                if size > _BATCH_BYTES:
                    yield pa.record_batch({"value": pa.array(out, pa.string())})
                    out, size = [], 0
            yield pa.record_batch({"value": pa.array(out, pa.string())})

    html = F.col("html").cast("string")
    # Rows that share a page_id can have different payloads.
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(F.coalesce(html, F.lit("")), 256).alias("digest")
    ).join(revisits(pages), ["page_id", "digest"], "left")
    rows.mapInArrow(run, "value string").write.option("compression", "gzip").option(
        "maxRecordsPerFile", RECORDS_PER_FILE
    ).text(path, lineSep=_END)


class _Records:
    """Records of a stream of bytes, given out as soon as they are complete."""

    def __init__(self):
        self._held, self._done = bytearray(), 0

    def add(self, raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        held = self._held
        held += raw
        at = 0
        while True:
            while held.startswith(b"\r\n", at):
                at += 2
            cut = held.find(b"\r\n\r\n", at)
            if len(held) >= at + 5 and not held.startswith(b"WARC/", at):
                raise ValueError(f"bytes outside records at {self._done + at}")
            if cut < 0:
                break
            lines = bytes(held[at:cut]).decode("utf-8", "replace").split("\r\n")[1:]
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            if not fields.get("content-length", "").isdecimal():
                raise ValueError(f"record without length at {self._done + at}")
            start, size = cut + 4, int(fields["content-length"])
            if start + size > len(held):
                break
            yield fields, bytes(held[start : start + size])
            at = start + size
        del held[:at]
        self._done += at

    def end(self) -> None:
        if bytes(self._held).strip():
            raise ValueError(f"archive ends inside a record at {self._done}")


def parse_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of every record of one archive file.

    Gzip archives may have any number of members; one is unpacked at a time, in
    steps, and records may also run from one into the next.
    """
    records = _Records()
    if raw[:2] != b"\x1f\x8b":
        yield from records.add(raw)
    while raw[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            rest = raw
            while not member.eof:
                made = member.decompress(rest, _BATCH_BYTES)
                rest = member.unconsumed_tail
                yield from records.add(made)
                if not made and not rest and not member.eof:
                    raise ValueError("gzip member cut off")
        except zlib.error as error:
            raise ValueError("broken gzip member") from error
        raw = member.unused_data.lstrip(b"\0")
        if raw and raw[:2] != b"\x1f\x8b":
            raise ValueError("bytes after the last gzip member")
    records.end()


def decode_http(block: bytes) -> bytes:
    """The payload of an HTTP message, without headers and chunked framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _number(value: str | None) -> int | None:
    """A whole number, or None for anything else."""
    return int(value) if value is not None and value.removeprefix("-").isdecimal() else None


_PARTS = "origin string, number int, total long, page_id long, record_type string, refers_to long, refers_id string, digest string, block binary, reason string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; ``number`` is null where a record is not segmented.

    A file that is cut off, damaged or no archive gives the records before the fault
    and a row with ``reason`` (the fault and the file) and nothing else. Record ids
    are text as they stand; a field that should be a number and is none counts as
    missing, and a record without id or type has a reason.
    """
    names = [c.split()[0] for c in _PARTS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def row(f: dict[str, str], block: bytes, name: str) -> tuple:
        number, kind, own = _number(f.get("warc-segment-number")), f.get("warc-type"), f.get("warc-record-id")
        origin, digest = f.get("warc-segment-origin-id", own), f.get("warc-payload-digest")
        reason = None if kind and own else f"record without id or type in {name}"
        numbers = [_number(f.get(k)) for k in ("warc-segment-total-length", "warc-page-id", "warc-refers-to-page-id")]
        return (origin, number, numbers[0], numbers[1], kind, numbers[2], f.get("warc-refers-to"), digest and digest.partition(":")[2], block, reason)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for name, file in zip(files.column("path").to_pylist(), files.column("content")):
                rows, size = [], 0
                try:
                    for fields, block in parse_records(file.as_py()):
                        if fields.get("warc-type") in ("warcinfo", "metadata", "request", "resource", "conversion"):
                            continue
                        rows.append(row(fields, block, name))
                        size += len(block)
                        if size > _BATCH_BYTES:
                            yield batch(rows)
                            rows, size = [], 0
                except ValueError as error:
                    rows.append((*[None] * 9, f"{error} in {name}"))
                yield batch(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, _PARTS)


def reassembled(records: DataFrame) -> DataFrame:
    """(page_id, record_id, record_type, refers_to, refers_id, digest, block, error): one
    row per page record, and one for each fault of a file.

    Segments of an origin are joined in order; a gap or a total length that does
    not fit is named in ``error`` and leaves a null block. An origin's segments
    are one record, so no group exceeds what a reader holds at once anyway.
    """
    record = F.col("origin").alias("record_id")
    single = F.col("number").isNull() | F.col("reason").isNotNull()
    whole = records.filter(single).select("page_id", record, "record_type", "refers_to", "refers_id", "digest", "block", F.col("reason").alias("error"))
    parts = (
        records.filter(~single)
        .groupBy("origin")
        .agg(
            F.array_sort(F.collect_list(F.struct("number", "block"))).alias("s"),
            F.max("total").alias("total"),
            F.max("page_id").alias("page_id"),
            F.max(F.when(F.col("number") == 1, F.col("record_type"))).alias("record_type"),
            F.max("digest").alias("digest"),
        )
    )
    size = F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["block"]))
    gap = F.exists(F.transform("s", lambda x, i: x["number"] != i + 1), lambda x: x)
    error = F.when(gap, "missing segment").when(~F.equal_null(size, F.col("total")), "wrong total length")
    # Joined at once: concatenating segment by segment would copy a page again and again.
    block = F.unhex(F.array_join(F.transform("s", lambda x: F.hex(x["block"])), ""))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("refers_to", "long"), ("refers_id", "string"))]
    joined = parts.select("page_id", record, "record_type", *none, "digest", F.when(error.isNull(), block).alias("block"), error.alias("error"))
    return whole.unionByName(joined)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_id, record_type, refers_to, refers_id, digest, payload, error) of
    every page record, and a row with an error alone for each fault of a file.

    A response without a digest is taken as it is. Revisits have a null payload. A payload that its digest does not fit, broken
    framing and incomplete segments are named in ``error``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[bytes | None, str | None]] = []
            for kind, digest, block, error in zip(*[batch.column(n).to_pylist() for n in ("record_type", "digest", "block", "error")]):
                payload = None
                if error is None and kind == "response":
                    try:
                        payload = decode_http(block)
                        if digest is not None and len(digest) == 64 and hashlib.sha256(payload).hexdigest() != digest:
                            payload, error = None, "wrong digest"
                    except ValueError:
                        error = "broken framing"
                out.append((payload, error))
            same = ["page_id", "record_id", "record_type", "refers_to", "refers_id", "digest"]
            found = [pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())]
            yield pa.record_batch([*[batch.column(n) for n in same], *found], [*same, "payload", "error"])

    schema = "page_id long, record_id string, record_type string, refers_to long, refers_id string, digest string, payload binary, error string"
    return reassembled(read_records(spark, path)).mapInArrow(run, schema)


def page_payloads(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, reason: one row per
    page record. A revisit's figures are those of the response it refers to. Records
    with an error, and revisits without a sound response, have no figures but a reason.
    """
    facts = read_pages(spark, path).select(
        "page_id",
        "record_id",
        "record_type",
        "refers_to",
        "refers_id",
        "digest",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        F.col("error").alias("reason"),
    )
    facts = stored(facts, "warc-facts")
    again = F.coalesce((F.col("record_type") == "revisit") & F.col("reason").isNull(), F.lit(False))
    # A revisit names its response by page or, as archives do, by record.
    responses = facts.filter("record_type = 'response' AND reason IS NULL")
    names = F.array(F.concat(F.lit("page "), F.col("page_id").cast("string")), F.concat(F.lit("record "), F.col("record_id")))
    named = responses.select(F.explode(names).alias("_to"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_n"), F.col("payload_digest").alias("_d"))
    named = named.filter("_to IS NOT NULL").distinct()
    wanted = F.coalesce(F.concat(F.lit("page "), F.col("refers_to").cast("string")), F.concat(F.lit("record "), F.col("refers_id")))
    fits = F.col("digest").isNull() | (F.length("digest") != 64) | (F.col("digest") == F.col("_d"))
    referring = facts.filter(again).withColumn("_name", wanted).join(named, (F.col("_name") == F.col("_to")) & fits, "left")
    reason = F.when(F.col("_to").isNull(), "no sound response").alias("reason")
    return facts.filter(~again).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "reason").unionByName(
        referring.select(
            "page_id", F.col("_n").alias("payload_bytes"), F.col("_d").alias("payload_digest"), "record_type", F.coalesce("refers_to", "_page").alias("refers_to"), reason
        )
    )
