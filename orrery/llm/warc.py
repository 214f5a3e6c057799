"""WARC archives, index first: records are written with an index of offset, length, URL and digest,
and selected records are read back by sorted byte ranges, joined where they touch.

One file per task; each record is a gzip member of its own, so a byte range can be read alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filesystem, fresh_path, materialize

DATE = "2024-01-01T00:00:00Z"
#: Ranges of one file are read together while they touch and stay within so many bytes.
READ = 4 << 20
SALTS = 32


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page: int | None, digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}:{kind}')}>"


def _safe(url: str) -> str:
    """White space and control characters of a URL percent-encoded: a header is one line."""
    return re.sub(r"[\x00-\x20\x7f-\xa0]", lambda m: quote(m[0]), url)


def _record(page: int, url: str, kind: str, digest: str, size: int, payload: bytes, first: int | None) -> bytes:
    """One record: a response holds HTTP headers and payload, a revisit the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page, digest, kind)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_safe(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(first, digest, 'response')}", f"WARC-Refers-To-Page-ID: {first}"]
    head += [f"WARC-Page-ID: {'' if page is None else page}", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case, ``:status`` for the HTTP length) and the HTTP payload of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    for x in http.decode().split("\r\n")[1:]:
        k, _, v = x.partition(":")
        fields[f"http-{k.strip().lower()}"] = v.strip()
    return fields, payload


def roles(pages: DataFrame) -> DataFrame:
    """``pages`` with __first: the smallest page_id with an equal payload (a null html is empty).

    The minimum is pre-aggregated per digest; digests met once need no join, and the others are
    joined in SALTS parts, so a payload that a third of all pages share is spread over tasks.
    """
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("__digest", F.sha1(F.encode("html", "UTF-8")))
    shared = keyed.groupBy("__digest").agg(F.min("page_id").alias("__min"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    shared = shared.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = keyed.withColumn("__salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    out = salted.join(shared, ["__digest", "__salt"], "left")
    return out.select("page_id", "url", "html", F.when(F.col("page_id") > F.col("__min"), F.col("__min")).alias("__first"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row to WARC files in ``folder``; returns the index, written as a table first.

    Index: (file, offset, length, url, digest, page_id). A file has the name of the attempt that wrote it
    and the index holds rows of committed attempts only, so file and index always agree. Of
    equal payloads the smallest page_id is the response (all rows of that page_id are), others
    revisit it. Null urls are empty; a null page_id is a response; an empty table gives no file. Headers hold URLs with white space and control characters
    percent-encoded (the index keeps them as they are); pages of any length are one record. Other
    columns play no part.
    """
    files, root = filesystem(folder)
    files.create_dir(root, recursive=True)
    kind = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64())])

    def write(batches):
        from pyspark import TaskContext

        store, base = filesystem(folder)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        at, out = 0, None
        for b in batches:
            for i in range(0, b.num_rows, 256):
                rows: dict[str, list] = {n: [] for n in kind.names}
                for r in b.slice(i, 256).to_pylist():
                    data = r["html"].encode()
                    digest = _digest(data)
                    role = "response" if r["__first"] is None else "revisit"
                    press = zlib.compressobj(2, zlib.DEFLATED, 31)
                    member = press.compress(_record(r["page_id"], r["url"] or "", role, digest, len(data), data, r["__first"])) + press.flush()
                    out = out or store.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(member)
                    for k, v in (("file", name), ("offset", at), ("length", len(member)), ("url", r["url"]), ("digest", digest), ("page_id", r["page_id"])):
                        rows[k].append(v)
                    at += len(member)
                yield pa.RecordBatch.from_pydict(rows, schema=kind)
        if out:
            out.close()

    index = roles(pages).mapInArrow(write, "file string, offset long, length long, url string, digest string, page_id long")
    return materialize(index, "warc-index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` selects: (page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload).

    Ranges are sorted by file and offset and spread by range, so a task reads neighbouring bytes;
    touching ranges are fetched in one read. A response's payload is checked against its digest;
    a revisit has no payload of its own and reports the referred payload's size and digest.
    """
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches):
        store, base = filesystem(folder)
        for b in batches:
            file, offset, length = (b.column(b.schema.names.index(n)).to_pylist() for n in ("file", "offset", "length"))
            at = 0
            while at < len(file):
                end = at + 1
                while end < len(file) and file[end] == file[at] and offset[end] == offset[end - 1] + length[end - 1] and offset[end] + length[end] - offset[at] <= READ:
                    end += 1
                with store.open_input_file(f"{base}/{file[at]}") as f:
                    f.seek(offset[at])
                    data = f.read(offset[end - 1] + length[end - 1] - offset[at])
                rows: dict[str, list] = {n: [] for n in names}
                for i in range(at, end):
                    o = offset[i] - offset[at]
                    fields, payload = parse(zlib.decompress(data[o : o + length[i]], 31))
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    revisit = fields["warc-type"] == "revisit"
                    size = int(fields["http-content-length"])
                    if not revisit and (len(payload) != size or _digest(payload) != digest):
                        raise ValueError(f"{file[i]} at {offset[i]}: the payload does not match its digest")
                    for k, v in zip(names, (int(fields["warc-page-id"]) if fields["warc-page-id"] else None, fields["warc-target-uri"], fields["warc-type"], int(fields["warc-refers-to-page-id"]) if revisit else None, size, digest, None if revisit else payload), strict=True):
                        rows[k].append(v)
                yield pa.RecordBatch.from_pydict(rows, schema=kind)
                at = end

    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    n = max(2, index.rdd.getNumPartitions())
    ordered = index.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(read, schema)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x FROM p),
g AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(x, CAST(5 * i + 1 AS INTEGER), 5))::BIGINT) AS v FROM d),
b AS (SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY x) AS first,
  array_to_string(list_transform(v, lambda n: list_extract(a, (n >> 15) + 1) || list_extract(a, ((n >> 10) & 31) + 1) || list_extract(a, ((n >> 5) & 31) + 1) || list_extract(a, (n & 31) + 1)), '') AS payload_digest
  FROM g, (SELECT string_split('A B C D E F G H I J K L M N O P Q R S T U V W X Y Z 2 3 4 5 6 7', ' ') AS a))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""
