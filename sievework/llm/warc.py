"""WARC archives: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own.  The reader deals out byte ranges of
the files.  A task looks for the gzip magic in its range, takes a place for a
member only if it decodes to a WARC header, owns the records that start inside
the range and reads on past its end to finish the last one.  So a large file is
read by many tasks, and none has to know where records start.

Payloads that occur again are stored once: of the records with an equal digest
the one of the smallest id holds the payload, the others refer to it.

Defined cases: a null payload is empty; payloads under ``LEAST_REVISIT`` bytes
are always stored; rows that repeat the smallest id are all stored; a null id
is written as no number and read as null; line breaks in addresses are
percent-encoded; other columns are ignored.
"""

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.files import create, new_file, open_file
from sievework.llm.shared import dealt, scratch_path, text_bytes, written

LEAST_REVISIT = 100
#: Bytes of a range a task reads, and of one read call.
SPLIT, READ = 8 << 20, 1 << 20
DATE = "1970-01-01T00:00:00Z"
_MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One gzip member; ``first`` is the id of the record that holds the payload, None for this one."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first is not None else http + payload
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", f"<{_ID}{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if first is not None:
        fields[3:3] = [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{_ID}{first}>")]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write a file per task under ``folder``; (path, size, records) of the files that count, already written."""
    html = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    given = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), html.alias("html"))
    given = given.withColumn("digest", F.sha2("html", 256))
    firsts = given.filter(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    told = given.join(firsts, "digest", "left").select("page_id", "url", "digest", "first", F.col("html").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, records, size, out = new_file(folder, ".warc.gz"), 0, 0, None
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            raw, cut = data.tobytes(), offsets.tolist()
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "first"))
            for k, (name, address, digest, first) in enumerate(zip(*columns)):
                out = out or create(path)
                member = record(name, address, raw[cut[k]:cut[k + 1]], digest, None if first == name else first)
                out.write(member)
                size += len(member)
                records += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([records])], ["path", "size", "records"])

    return written(told.mapInArrow(run, "path string, size bigint, records bigint"), "manifest")[0]


class _Window:
    """Bytes of a file from a place on, read as they are asked for."""

    def __init__(self, uri: str, start: int):
        self.file, self.base, self.data = open_file(uri), start, b""
        self.size = self.file.size()

    def more(self) -> bool:
        at = self.base + len(self.data)
        if at >= self.size:
            return False
        self.data += self.file.read_at(min(READ, self.size - at), at)
        return True

    def forget(self, before: int) -> None:
        """Drop what lies before a place in the file."""
        self.data, self.base = self.data[before - self.base:], before


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """Decoded member that starts at a place and the place after it; None if there is no WARC record."""
    unpack, out, fed = zlib.decompressobj(31), b"", at - window.base
    while True:
        try:
            out += unpack.decompress(window.data[fed:])
        except zlib.error:
            return None
        fed = len(window.data)
        if len(out) >= 7 and not out.startswith(b"WARC/1."):
            return None
        if unpack.eof:
            return (out, window.base + len(window.data) - len(unpack.unused_data)) if out.startswith(b"WARC/1.") else None
        if not window.more():
            return None


def records(uri: str, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of the records that start in a byte range."""
    window, at = _Window(uri, start), start
    while at < end:
        found = window.data.find(_MAGIC, at - window.base)
        if found < 0:
            at = max(at, window.base + len(window.data) - len(_MAGIC) + 1)
            window.forget(min(at, window.base + len(window.data)))
            if not window.more():
                return
            continue
        at = window.base + found
        if at >= end:
            return
        member = _member(window, at)
        if member is None:
            at += 1
            continue
        head, _, block = member[0].partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
        fields = {k.lower(): v for k, v in fields.items()}
        yield fields, block[:int(fields["content-length"])]
        at = member[1]
        window.forget(at)


def _number(value: str | None) -> int | None:
    tail = (value or "").strip("<>").removeprefix(_ID)
    return int(tail) if tail.lstrip("-").isdigit() else None


def read_archives(manifest: DataFrame, split: int = SPLIT, with_payload: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of every record of the files.

    Length and digest of a stored payload are those of the bytes read; they
    must agree with the header, else the job fails.
    """
    ranges = manifest.select("path", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(split))).alias("start"))
    ranges = dealt(ranges.select("path", "start", F.least(F.col("start") + split, "size").alias("end")))
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
             ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload

    def one(fields: dict[str, str], block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        length = int(next(x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
        digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
        if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"payload of {fields['warc-record-id']} does not agree with its header")
        out = (_number(fields["warc-record-id"]), fields["warc-target-uri"], length, digest, kind, _number(fields.get("warc-refers-to")))
        return (*out, payload) if with_payload else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
                for fields, block in records(path, start, end):
                    rows.append(one(fields, block))
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [n for n, _ in kinds])
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [n for n, _ in kinds])

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return ranges.mapInArrow(run, schema + ", payload binary" * with_payload)


def round_trip(pages: DataFrame) -> DataFrame:
    """What is read back from archives written from the pages."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), with_payload=False).drop("url")
