"""WARC archives: writing segmented records, and putting them together again."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feederflow.llm.shared import stored

VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
#: Parts that pages of one digest are dealt to.
SALTS = 16
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # for URLs, RFC 4122


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, '|'.join(map(str, parts)))}>"


def _record(fields: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    return VERSION + head.encode() + block


def _cuts(block: bytes, size: int) -> list[bytes]:
    """Cut into about ``size`` bytes each, between characters, as Spark's text writer takes UTF-8."""
    out, at = [], 0
    while at < len(block):
        end = min(len(block), at + size)
        while end < len(block) and block[end] & 0xC0 == 0x80:
            end += 1
        out.append(block[at:end])
        at = end
    return out


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing, in chunks of about ``size`` bytes."""
    return b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in _cuts(payload, size)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if len(out[-1]) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("broken chunk")
        at = end + 4 + n


def records(page_id: int | None, url: str, payload: bytes, digest: str, kind: str, refers: int | None, segment: int, chunk: int) -> list[bytes]:
    """The records of a page; a response longer than ``segment`` bytes has continuation records."""
    own = record_id("page", page_id, digest)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields = {"WARC-Type": kind, "WARC-Record-ID": own, "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": uri, "X-Page-ID": page_id, "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http;msgtype=response"}
    if kind == "revisit":
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id("page", refers, digest), "X-Refers-To-Page-ID": refers}
        return [_record(fields, f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode())]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    parts = _cuts(block, segment)
    if len(parts) == 1:
        return [_record(fields, block)]
    out = [_record(fields | {"WARC-Segment-Number": 1}, parts[0])]
    for k, part in enumerate(parts[1:], 2):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": record_id(own, k), "WARC-Date": fields["WARC-Date"], "WARC-Target-URI": uri, "WARC-Segment-Origin-ID": own, "WARC-Segment-Number": k}
        out.append(_record(more | {"WARC-Segment-Total-Length": len(block) if k == len(parts) else None}, part))
    return out


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, segment: int = 16_384, chunk: int = 4_096, file_bytes: int = 64 << 20, max_copies: int = 1 << 18) -> None:
    """A record for each page, in gzip-compressed WARC files in the folder ``path``.

    The payload is the html in UTF-8. Of the records with equal payloads of ``least`` bytes or
    more, the one with the smallest id is a response and the others are revisits; smaller ones are
    all responses. Responses have chunked framing and are cut into segments of about ``segment``
    bytes; the records of a page follow each other in a file. Files end after as many records as
    hold ``file_bytes`` at the table's mean page size. Up to ``max_copies`` digests that several pages have are sent to all
    tasks (about 100 bytes each), so that no html is shuffled; beyond it pages and digests are joined, with equal results.

    Null html or url is empty. A null id is written without its field: such a page is never the one
    that others refer to, unless it alone holds the payload. Repeated rows are written each:
    those with the smallest id are all responses with one record id. Control characters and blanks in a
    url are percent-encoded. Other columns are not read. An empty table writes a folder without records.
    """
    pages = df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2(F.col("html"), 256))
    # the digests without the pages, so that many copies of one page are counted and not gathered
    marks = stored(pages.select("page_id", "digest", F.octet_length("html").alias("size")), "warc-digests")
    n, total = marks.agg(F.count(F.lit(1)), F.sum("size")).head()
    records_per_file = max(1, file_bytes * n // max(1, total or 0)) if n else 1
    copies = marks.where(F.col("size") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1").select("digest", "first")
    copies = stored(copies, "warc-copies")
    if copies.count() <= max_copies:
        joined = pages.join(F.broadcast(copies), "digest", "left")
    else:
        # pages of one digest are dealt to several tasks
        copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        joined = pages.withColumn("salt", salt).join(copies, ["digest", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = joined.select("page_id", "url", "html", "digest", revisit.alias("again"), F.when(revisit, F.col("first")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                made = []
                for page, url, html, digest, again, refers in zip(*(c.to_pylist() for c in batch.slice(k, 500).columns), strict=True):
                    made += records(page, url, html.encode(), digest, "revisit" if again else "response", refers, segment, chunk)
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()).cast(pa.string())], ["record"])

    # every record ends in two line breaks, which the text writer sets after each row
    rows.mapInArrow(run, "record string").write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", min(records_per_file, (1 << 31) - 1)).text(path)


def parse(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an archive that comes in pieces."""
    held, ended = bytearray(), False

    def more() -> bool:
        nonlocal ended
        piece = next(data, None)
        if piece is None:
            ended = True
            return False
        held.extend(piece)
        return True

    while True:
        while (end := held.find(END)) < 0 and more():
            pass
        if end < 0:
            if held.strip():
                raise ValueError("broken record")
            return
        lines = bytes(held[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        while len(held) < end + 8 + size and more():
            pass
        if bytes(held[end + 4 + size : end + 8 + size]) != END:
            raise ValueError("broken record")
        yield fields, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 8 + size]


def _pieces(content: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The archive's bytes; gzip files may have many members."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    at = zlib.decompressobj(31)
    view, k = memoryview(content), 0
    while k < len(content):
        piece = at.decompress(view[k : k + size])
        k += size
        while at.eof and (at.unused_data or k < len(content)):
            rest = at.unused_data
            at = zlib.decompressobj(31)
            piece += at.decompress(rest) if rest else b""
            if not rest:
                break
        yield piece


FIELDS = "origin string, segment int, total long, kind string, page_id long, url string, digest string, refers_to long, payload_bytes long, part binary, payload binary"


def read_records(spark: SparkSession, path: str, cut: bool) -> DataFrame:
    """The records in a folder's archives: the segments with their blocks, or those that were never cut with their payloads."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in FIELDS.split(", ")]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                for f, block in parse(_pieces(content.as_py())):
                    number = lambda k, f=f: int(f[k]) if k in f else None
                    kind, segment = f["warc-type"], number("warc-segment-number")
                    origin = f.get("warc-segment-origin-id", f["warc-record-id"])
                    if (segment is not None) != cut:
                        continue
                    size, part, payload, digest = None, None, None, f.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    if kind == "revisit":
                        size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", block)[1])
                    elif segment is None:
                        payload = payload_of(block)
                        size = len(payload)
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"digest of {origin} differs")
                    else:
                        part = block
                    rows.append((origin, segment or 1, number("warc-segment-total-length"), kind, number("x-page-id"), f.get("warc-target-uri"), digest, number("x-refers-to-page-id"), size, part, payload))
                    if len(rows) >= 500:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(run, FIELDS)


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block, out of its chunks if it has them."""
    head, _, body = block.partition(END)
    return unchunked(body) if re.search(rb"(?i)\r\ntransfer-encoding: *chunked", head) else body


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each page record: ``page_id``, ``url``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, ``payload``.

    Segments are grouped by their origin's record id and put in order by number; their summed
    length must be the total that the last one states, and the payload, out of its chunked
    framing, must have the stated digest. Records that were never cut are whole
    where they are read, and are not shuffled. ``payload`` is null for revisits alone, which hold
    none; ``refers_to`` has the page with it. Repeated records, with equal ids, give equal rows.
    """
    whole = read_records(spark, path, False).select("page_id", "url", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", "payload")
    rows = read_records(spark, path, True)
    parts = rows.groupBy("origin").agg(
        F.max("total").alias("total"),
        F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("segment", "part")))).alias("parts"),
        F.collect_list(F.when(F.col("kind") != "continuation", F.struct("kind", "page_id", "url", "digest", "refers_to"))).alias("heads"),
    )

    def join(total: pd.Series, digest: pd.Series, segments: pd.Series, blocks: pd.Series, n_heads: pd.Series) -> pd.DataFrame:
        out = []
        for t, d, numbers, held, n in zip(total, digest, segments, blocks, n_heads, strict=True):
            once = dict(zip(map(int, numbers), held, strict=True))
            block = b"".join(once[k] for k in sorted(once))
            if sorted(once) != list(range(1, len(once) + 1)) or len(held) != n * len(once) or len(block) != t:
                raise ValueError("a record lacks segments")
            payload = payload_of(block)
            if hashlib.sha256(payload).hexdigest() != d:
                raise ValueError("digest differs")
            out.append((len(payload), payload))
        return pd.DataFrame(out, columns=["n", "payload"]).astype({"n": "Int64"})

    put = F.pandas_udf(join, "n long, payload binary")
    field = lambda k: F.transform("parts", lambda p: p[k])
    joined = parts.withColumn("w", put("total", F.get("heads", F.lit(0))["digest"], field("segment"), field("part"), F.size("heads")))
    one = joined.select(F.explode("heads").alias("h"), "w")
    one = one.select("h.page_id", "h.url", F.col("w.n").alias("payload_bytes"), F.col("h.digest").alias("payload_digest"), F.col("h.kind").alias("record_type"), "h.refers_to", "w.payload")
    return whole.unionByName(one)
