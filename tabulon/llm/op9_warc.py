"""Legacy archive converter: ARC to WARC.

`read_arc` parses ARC archives of version 1 and 2: the version block, then header lines whose fields
depend on the version, each followed by as many bytes as it declares.  `to_warc` synthesises what
WARC asks for and ARC lacks: record identifiers, ISO timestamps, record types, payload digests.
`write_warc` runs pages through both and commits gzipped archives with Spark's own writer, so lost
tasks leave nothing behind; `read_warc` parses the archives again.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path

#: Payloads of fewer bytes are always stored whole.
LEAST_REVISIT = 1000
#: Records in one archive file at most.
FILE_RECORDS = 1000
#: Field names of ARC header lines by version.
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PAGE = "X-Page-Id"
#: Crawl date of pages that carry none.
NO_DATE = "20000101000000"


def write_arc(records: list[tuple[str, bytes]], version: int = 1, date: str = NO_DATE) -> bytes:
    """An ARC archive of (url, network response) pairs."""
    names = "URL IP-address Archive-date Content-type Archive-length" if version == 1 else "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    block = f"{version} 0 tabulon\n{names}\n".encode()
    extra = "" if version == 1 else " 200 - - 0 pages.arc"
    out = io.BytesIO()
    out.write(f"filedesc://pages.arc 0.0.0.0 {date} text/plain{extra} {len(block)}\n".encode() + block + b"\n")
    for url, body in records:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "-"
        more = "" if version == 1 else f" 200 - - {out.tell()} pages.arc"
        out.write(f"{safe} 0.0.0.0 {date} text/html{more} {len(body)}\n".encode("utf-8", "surrogatepass") + body + b"\n")
    return out.getvalue()


def read_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC archive: fields of its version, plus `body` (bytes) and `at` (byte offset)."""
    at, version = 0, 1
    while at < len(data):
        if data[at : at + 1] == b"\n":  # the separator after a record
            at += 1
            continue
        stop = data.index(b"\n", at)
        parts = data[at:stop].decode("utf-8", "surrogatepass").rstrip("\r").split(" ")
        length = int(parts[-1])
        body = data[stop + 1 : stop + 1 + length]
        if len(body) < length:
            raise ValueError(f"record at byte {at} is cut short: {len(body)} of {length} bytes")
        if parts[0].startswith("filedesc:"):
            version = int(body.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
        fields = FIELDS[version]
        if len(parts) > len(fields):  # content types with spaces
            parts = [*parts[:3], " ".join(parts[3 : len(parts) - len(fields) + 4]), *parts[len(parts) - len(fields) + 4 :]]
        yield dict(zip(fields, parts, strict=False)) | {"version": version, "at": at, "body": body}
        at = stop + 1 + length


def record_id(page: int | None, *more: str) -> str:
    """A record identifier, the same in every run; a page number can be read back from it."""
    top = hashlib.sha1("\n".join(more).encode("utf-8", "surrogatepass")).digest()
    if page is None:
        raw = b"\x00" + top[:15]
    else:
        raw = b"\x01" * 8 + page.to_bytes(8, "big", signed=True)
    return f"<urn:uuid:{uuid.UUID(bytes=raw)}>"


def page_of(ident: str) -> int | None:
    raw = uuid.UUID(ident.strip("<>").removeprefix("urn:uuid:")).bytes
    return int.from_bytes(raw[8:], "big", signed=True) if raw[:8] == b"\x01" * 8 else None


def split_http(body: bytes) -> tuple[bytes, bytes]:
    head, gap, payload = body.partition(b"\r\n\r\n")
    return (head + gap, payload) if gap else (b"", body)


def to_warc(rec: dict, refers_to: str | None = None) -> bytes:
    """The WARC record of an ARC record, without the two line ends that close it."""
    d = (rec["date"] + NO_DATE[len(rec["date"]) :])[:14]
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    url = rec["url"]
    head, payload = split_http(rec["body"])
    m = re.search(rb"(?im)^X-Page-Id: (-?\d+)\r?$", head)
    ident = record_id(int(m[1]) if m else None, url, rec["date"], str(rec["at"]), hashlib.sha1(rec["body"]).hexdigest())
    if url.startswith("filedesc:"):
        kind, block, ctype = "warcinfo", b"software: tabulon\r\nformat: WARC File Format 1.0\r\n", "application/warc-fields"
    elif not url.lower().startswith(("http:", "https:")) and not head:
        kind, block, ctype = "resource", rec["body"], rec["type"]
    elif refers_to:
        kind, block, ctype = "revisit", head, "application/http; msgtype=response"
    else:
        kind, block, ctype = "response", rec["body"], "application/http; msgtype=response"
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", f"WARC-Date: {date}"]
    if kind != "warcinfo":
        lines += [f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: {sha1(payload)}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {REVISIT_PROFILE}", "WARC-Truncated: length"]
    lines += [f"WARC-Block-Digest: {sha1(block)}", f"Content-Type: {ctype}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block


def parse_warc(stream) -> Iterator[tuple[dict, bytes]]:
    """(headers with lower-case names, block) of each record; a closing blank pair is skipped."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        heads = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(": ")
            heads[k.lower()] = v
        block = stream.read(int(heads["content-length"]))
        yield heads, block


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 200):
            page, url, html, refers = (c.to_pylist() for c in b.slice(at, 200).columns)
            arcs = []
            for p, u, h in zip(page, url, html, strict=True):
                body = (h or "").encode()
                own = f"{PAGE}: {p}\r\n" if p is not None else ""
                arcs.append((u or "urn:none", f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(body)}\r\n\r\n".encode() + body))
            recs = [r for r in read_arc(write_arc(arcs)) if not r["url"].startswith("filedesc:")]
            out = [to_warc(r, record_id(to) if to is not None else None).decode() for r, to in zip(recs, refers, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Archives of all pages below `path`, one record for each row.

    Of rows with equal payloads of at least LEAST_REVISIT bytes the largest id is a response and the
    others revisit it; rows with that same id are responses too.  A null html is an empty payload; a row
    with a null id is a response that none refers to; a null url becomes urn:none.  An empty table gives
    an archive without records; other columns are ignored.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    digest = F.when(F.octet_length("html") >= LEAST_REVISIT, F.sha1(F.col("html").cast("binary")))
    best = p.select("page_id", digest.alias("sha")).filter("sha is not null and page_id is not null").groupBy("sha").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1").select("sha", "top")
    # Small payloads are responses anyway and meet no join.
    refers = F.when(F.col("page_id") != F.col("top"), F.col("top"))
    large = p.withColumn("sha", digest).filter("sha is not null").join(best, "sha", "left").select("page_id", "url", "html", refers.alias("refers"))
    small = p.filter(F.octet_length("html") < LEAST_REVISIT).select("page_id", "url", "html", F.lit(None).cast("long").alias("refers"))
    rows = large.unionByName(small).mapInArrow(_convert, "value string")
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


PARSED = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, sound boolean"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b.column(0):
            cols: list[list] = [[], [], [], [], [], [], []]
            with gzip.open(io.BytesIO(content.as_py())) as stream:
                for heads, block in parse_warc(stream):
                    if heads["warc-type"] not in ("response", "revisit"):
                        continue
                    head, payload = split_http(block)
                    told = base64.b32decode(heads["warc-payload-digest"].removeprefix("sha1:")).hex()
                    revisit = heads["warc-type"] == "revisit"
                    size = int(re.search(rb"(?im)^Content-Length: (\d+)\r?$", head)[1]) if revisit else len(payload)
                    found = told if revisit else hashlib.sha1(payload).hexdigest()
                    row = (page_of(heads["warc-record-id"]), size, found, heads["warc-type"], page_of(heads["warc-refers-to"]) if revisit else None, heads["warc-target-uri"], found == told)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "sound"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response and revisit records of gzipped archives; `sound`: the payload has the digest its header tells."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parse, PARSED)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as d from pages
), b as (select d, max(page_id) as top from p where n >= 1000 group by d)
select page_id, n::bigint as payload_bytes, p.d as payload_digest,
  case when page_id < top then 'revisit' else 'response' end as record_type,
  case when page_id < top then top end as refers_to
from p left join b on p.d = b.d and p.n >= 1000
"""
