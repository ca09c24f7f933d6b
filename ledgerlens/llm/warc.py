"""WARC archives: writing captures, reading records back, and transaction assembly.

A capture is three records: a response (or a revisit of an equal payload), the
request and a metadata record.  The latter two name the response's record id in
WARC-Concurrent-To.  Files are read record by record into rows; ``assemble``
joins request, response and metadata rows through those ids and emits one
nested row per capture.

Of captures with equal payloads of at least ``REVISIT_BYTES`` bytes, the one
with the largest page_id is written as response, the others as revisits (server
not modified: HTTP head only) that refer to it by payload digest and URI.

Payloads travel once, to the task that writes them, keyed by page_id and digest;
which capture is the response is decided on rows without payload, so a payload
shared by a third of all pages adds no skew to the heavy shuffle.

Defined results: null html is an empty payload; null url leaves out the target
URI; a null page_id sorts first and comes back null; repeated rows are written
each, and those equal in page_id and payload have the same record type; a
record without partner gives a row with nulls for the missing side; of several
requests (metadata records) of one response the one with the smallest record id
counts, ``n_requests`` / ``n_metadata`` tell how many there were; an empty
table gives no file and no row; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import common as C
from ledgerlens.llm import part_files

REVISIT_BYTES = 1000
#: Date of all records written; archives of one table are equal up to record ids.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LEVEL = 1


# --- writing -----------------------------------------------------------------

def _record(kind: str, headers: list[tuple[str, str | None]], content_type: str, block: bytes) -> bytes:
    head = [("WARC-Type", kind), *headers, ("WARC-Date", DATE), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None) + "\r\n"
    z = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)  # a gzip member for each record
    return z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()


def _digest(hex_sha1: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_sha1)).decode()


def _uri(url: str | None) -> str | None:
    return None if url is None else quote(url, safe="".join(map(chr, range(0x21, 0x7F))))


def _capture(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_uri: str | None) -> bytes:
    uri = _uri(url)
    response, request, metadata = (f"<urn:uuid:{uuid.uuid4()}>" for _ in range(3))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    named = [("WARC-Record-ID", response), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", _digest(digest))]
    if revisit:
        out = _record("revisit", [*named, ("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", _uri(refers_uri)), ("WARC-Refers-To-Date", DATE)], "application/http; msgtype=response", http)
    else:
        out = _record("response", named, "application/http; msgtype=response", http + payload)
    try:
        parts = urlsplit(uri or "")
    except ValueError:
        parts = urlsplit("")
    path = (parts.path or "/") + ("?" + parts.query if parts.query else "")
    out += _record("request", [("WARC-Record-ID", request), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", response)], "application/http; msgtype=request", f"GET {path} HTTP/1.1\r\nHost: {parts.netloc}\r\n\r\n".encode())
    fields = b"" if page_id is None else f"pageId: {page_id}\r\n".encode()
    return out + _record("metadata", [("WARC-Record-ID", metadata), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", response)], "application/warc-fields", fields)


def _write(folder: str):
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_captures", pa.int64())])

    def run(batches):
        stream, n = None, 0
        for batch in batches:
            for t in C.chunks(batch, "html"):
                if stream is None:
                    part, path, stream = part_files.writer(folder, ".warc.gz")
                    stream.write(_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>")], "application/warc-fields", b"format: WARC File Format 1.1\r\n"))
                columns = [t.column(c).to_pylist() for c in ("page_id", "url", "digest", "revisit", "refers_url")]
                for page_id, url, digest, revisit, refers_url, payload in zip(*columns, C.texts(t.column("html")), strict=True):
                    stream.write(_capture(page_id, url, payload, digest, revisit, refers_url))
                n += t.num_rows
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_captures": [n]}, schema)

    return run


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC files; returns the manifest (part, path, n_captures)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), C.id_key("page_id").alias("k"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("bytes"))
    shared = p.filter(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.max("k").alias("response_k"), F.max_by("url", F.struct("k", "url")).alias("refers_url"))
    verdicts = (p.select("k", "digest", "bytes").distinct().filter(F.col("bytes") >= REVISIT_BYTES).join(shared, "digest")
                .filter("k <> response_k").select("k", "digest", "refers_url", F.lit(True).alias("is_revisit")))
    rows = p.join(verdicts, ["k", "digest"], "left").select("page_id", "url", "html", "digest", F.coalesce("is_revisit", F.lit(False)).alias("revisit"), "refers_url")
    return C.keep(rows.mapInArrow(_write(part_files.qualified(pages.sparkSession, folder)), "part int, path string, n_captures long").repartition(1), "warc-manifest")  # a row per file


# --- reading -----------------------------------------------------------------

_RECORD_FIELDS = [("part", pa.int32()), ("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
                  ("content_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_uri", pa.string()), ("status", pa.int32()),
                  ("method", pa.string()), ("page_id", pa.int64())]
_RECORD_DDL = ("part int, record_id string, type string, concurrent_to string, target_uri string, date string, content_type string, payload_bytes long, "
               "payload_digest string, refers_to_uri string, status int, method string, page_id long")


def _headers(lines: Iterator[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and name and text:  # a folded line goes on with the one before
            out[name] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record of an open WARC file, gzipped or not."""
    lead = stream.read(2)
    stream.seek(0)
    f = gzip.GzipFile(fileobj=stream) if lead == b"\x1f\x8b" else io.BufferedReader(stream)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        lines = []
        while (line := f.readline()).strip():
            lines.append(line)
        headers = _headers(iter(lines))
        if not headers.get("content-length", "").isdigit():
            raise ValueError("WARC record without a length")
        size = int(headers["content-length"])
        block = f.read(size)
        if len(block) != size:
            raise ValueError("truncated WARC record")
        yield headers, block


def _hex(digest: str | None) -> str | None:
    """Lower-case hex of a sha1 digest header, given in base 32 or hex."""
    m = re.fullmatch(r"sha1:(\w+)", digest or "", re.IGNORECASE)
    if not m:
        return None
    return m[1].lower() if len(m[1]) == 40 else base64.b32decode(m[1].upper()).hex()


def _row(part: int, h: dict[str, str], block: bytes, with_payload: bool) -> dict:
    kind = h.get("warc-type")
    row = {"part": part, "record_id": h.get("warc-record-id"), "type": kind, "concurrent_to": h.get("warc-concurrent-to"), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"),
           "content_type": h.get("content-type"), "payload_digest": _hex(h.get("warc-payload-digest")), "refers_to_uri": h.get("warc-refers-to-target-uri")}
    if kind in ("response", "revisit", "request"):
        head, _, payload = block.partition(b"\r\n\r\n")
        first, _, rest = head.partition(b"\r\n")
        words = first.decode("latin-1").split(" ", 2)
        if kind == "request":
            row["method"] = words[0]
        else:
            row["status"] = int(words[1]) if len(words) > 1 and words[1].isdigit() else None
            if kind == "response":  # the digest and length of what is there
                row["payload_bytes"], found = len(payload), hashlib.sha1(payload).hexdigest()
                if row["payload_digest"] not in (None, found):
                    raise ValueError(f"payload digest of {row['record_id']} does not match")
                row["payload_digest"] = found
                if with_payload:
                    row["payload"] = payload
            else:
                length = _headers(iter(rest.split(b"\r\n"))).get("content-length", "")
                row["payload_bytes"] = int(length) if length.isdigit() else None
    elif kind == "metadata":
        page = _headers(iter(block.split(b"\r\n"))).get("pageid", "")
        row["page_id"] = int(page) if re.fullmatch(r"-?\d+", page) else None
    return row


def read_warc(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the files in ``manifest`` (part, path)."""
    schema = pa.schema(_RECORD_FIELDS + [("payload", pa.binary())] * with_payload)

    def run(batches):
        for b in batches:
            for part, path in zip(b.column("part").to_pylist(), b.column("path").to_pylist(), strict=True):
                rows, held = [], 0
                with part_files.opened(path) as stream:
                    for headers, block in read_records(stream):
                        if headers.get("warc-type") != "warcinfo":
                            rows.append(_row(part, headers, block, with_payload))
                            held += len(block) * with_payload + 300
                        if held > C.CHUNK_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return part_files.spread(manifest, manifest.count()).mapInArrow(run, _RECORD_DDL + ", payload binary" * with_payload)


# --- assembly ----------------------------------------------------------------

def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata, n_requests, n_metadata.

    The three kinds of records are joined (full outer) on the response's record id, which
    requests and metadata records give in concurrent_to (their own id if it is absent).
    The join is one grouped pass over the records: each side keeps its least record id
    before the shuffle, so the archive is read once and an id that thousands of records
    name moves a row per task.
    """
    kind = F.col("type")
    main = kind.isin("response", "revisit")
    side = [c for c in records.columns if c not in ("part", "concurrent_to")]
    key = F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))

    def of(which, columns: list[str]):
        return F.min(F.when(which, F.struct(*columns)))  # record_id comes first

    r = records.filter(main | kind.isin("request", "metadata")).withColumn("capture_id", key)
    return r.groupBy("capture_id").agg(
        of(main, ["record_id", *(c for c in side if c != "record_id")]).alias("response"),
        of(kind == "request", ["record_id", "target_uri", "date", "method"]).alias("request"),
        of(kind == "metadata", ["record_id", "target_uri", "date", "content_type", "page_id"]).alias("metadata"),
        F.count_if(kind == "request").alias("n_requests"), F.count_if(kind == "metadata").alias("n_metadata"))
