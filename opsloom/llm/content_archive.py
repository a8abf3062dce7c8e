"""Content-addressed archive of WARC records.

``write_archive`` makes a WARC/1.1 record of every row and stores it in two
tables: ``headers`` (the record's exact header block and the payload's SHA-256,
one row a record) and ``payloads`` (one row a distinct payload: SHA-256, length
and the gzip member of its bytes). ``read_archive`` joins the two and gives back
every record's original bytes, after checking length and SHA-256.

Of the records with one payload, the one with the largest id is the response;
the others are revisits that refer to it. Payloads shorter than ``min_bytes``
are always responses.

Only (id, digest) pairs are grouped. Payloads move once, by the unique id of
their response record, and only those of responses are compressed. A payload
that a third of all records share is one row of ``payloads``; the join that
rebuilds records is left to adaptive execution, which splits such a key since
both sides are plain scans.

Defined results: a null payload is empty; a null url leaves its header out; a
url with a line break is percent-encoded and marked by a header of its own, so
that it can neither end its line nor forge another, and reading decodes it; a
null id sorts before all others and is written as an empty id; rows that repeat
both id and payload are all responses if theirs is the largest id; an empty
table gives an empty archive. Other columns of the input are not stored.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm.workspace import Workspace

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
NULL_ID = -(2**63)


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a 40-digit hexadecimal string: 5 digits are 4 letters."""
    parts = []
    for k in range(8):
        value = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _records(df: DataFrame, record_id: str, url: str, payload: str) -> DataFrame:
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    return df.select(F.col(record_id).cast("long").alias("record_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))


def _urn(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">"))


ESCAPES = {"%": "%25", "\r": "%0D", "\n": "%0A"}
ESCAPED = "X-Target-URI-Escaped"


def _url_lines(url: Column, line) -> Column:
    """The header of a url; one with line breaks is escaped, which a second header says."""
    safe = url
    for raw, code in ESCAPES.items():
        safe = F.replace(safe, F.lit(raw), F.lit(code))
    broken = url.contains("\r") | url.contains("\n")
    lines = F.when(broken, F.concat(line("WARC-Target-URI", safe), line(ESCAPED, F.lit("percent")))).otherwise(line("WARC-Target-URI", url))
    return F.coalesce(lines, F.lit(""))


def _header_block() -> Column:
    """The record's header lines up to and with the empty line."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _urn(F.col("record_id"))),
        _url_lines(F.col("url"), line),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _urn(F.col("owner"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.col("n_bytes").cast("string")),
        F.lit(CRLF),
    ]
    return F.concat(*lines).cast("binary")


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        packed = [gzip.compress(x.as_buffer(), 5, mtime=0) for x in b.column("payload")]
        yield pa.RecordBatch.from_arrays([b.column("sha256"), b.column("n_bytes"), pa.array(packed, pa.binary())], names=["sha256", "n_bytes", "member"])


def write_archive(df: DataFrame, space: Workspace, record_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> None:
    """Writes the tables ``headers`` and ``payloads`` of the archive."""
    records = _records(df, record_id, url, payload)
    digest = records.select("record_id", "url", F.sha2("payload", 256).alias("sha256"), base32_of_hex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes"))
    owners = space.save(digest.filter(F.col("n_bytes") >= min_bytes).groupBy("sha256").agg(F.max(F.coalesce("record_id", F.lit(NULL_ID))).alias("owner")), "owners")
    own = F.coalesce("record_id", F.lit(NULL_ID)) == F.col("owner")
    headers = digest.join(owners, "sha256", "left").withColumn("record_type", F.when(F.col("owner").isNull() | own, F.lit("response")).otherwise(F.lit("revisit")))
    space.save(headers.select("sha256", _header_block().alias("header")), "headers")
    # A payload is stored with its owner. Payloads under the limit have no owner: their first holder stores them.
    small = digest.filter(F.col("n_bytes") < min_bytes).groupBy("sha256").agg(F.max(F.coalesce("record_id", F.lit(NULL_ID))).alias("owner"))
    keep = owners.unionByName(small) if min_bytes > 0 else owners
    held = records.withColumns({"sha256": F.sha2("payload", 256), "n_bytes": F.octet_length("payload").cast("long"), "record_id": F.coalesce("record_id", F.lit(NULL_ID))})
    held = held.join(keep, (held.record_id == keep.owner) & (held.sha256 == keep.sha256), "left_semi")
    # Repeated rows are next to each other: the join has already put equal keys together.
    once = held.dropDuplicates(["record_id", "sha256"]).select("sha256", "n_bytes", "payload")
    space.save(once.mapInArrow(_compress, "sha256 string, n_bytes long, member binary"), "payloads")
    space.drop("owners")


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for b in batches:
        out = []
        for header, member, sha256 in zip(b.column("header").to_pylist(), b.column("member").to_pylist(), b.column("sha256").to_pylist(), strict=True):
            body = gzip.decompress(member)
            if hashlib.sha256(body).hexdigest() != sha256:
                raise ValueError(f"the payload stored as {sha256} has other bytes")
            out.append(header + body + b"\r\n\r\n")
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def read_archive(space: Workspace) -> DataFrame:
    """``record``: the bytes of every record, as written."""
    joined = space.read("headers").join(space.read("payloads"), "sha256", "left")
    return joined.select("sha256", "header", "member").mapInArrow(_rebuild, "record binary")


PARSED = "record_id long, record_type string, target_uri string, payload_digest string, refers_to long, payload_bytes long, payload binary"


def parse_record(record: bytes) -> dict:
    """The fields of one record's bytes; its Content-Length bounds the payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split(CRLF)
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) for x in lines[1:])
    payload = rest[: int(field["Content-Length"])]
    uri = field.get("WARC-Target-URI")
    if ESCAPED in field:
        for raw, code in reversed(ESCAPES.items()):
            uri = uri.replace(code, raw)
    number = lambda urn: int(urn[len("<urn:record:") : -1]) if urn and len(urn) > len("<urn:record:>") else None
    return {"record_id": number(field["WARC-Record-ID"]), "record_type": field["WARC-Type"], "target_uri": uri, "payload_digest": field["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": number(field.get("WARC-Refers-To")), "payload_bytes": len(payload), "payload": payload}


PARSED_ARROW = pa.schema([("record_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_pylist([parse_record(x) for x in b.column(0).to_pylist()], schema=PARSED_ARROW)


def parse_records(records: DataFrame) -> DataFrame:
    """A row of fields for each ``record``."""
    return records.select("record").mapInArrow(_parse, PARSED)


def without_body(record: bytes) -> bytes:
    """A revisit as common readers expect it: the headers, an empty block. Other records stay as they are."""
    head, mark, _ = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if b"WARC-Type: revisit" not in lines:
        return record
    return b"\r\n".join(b"Content-Length: 0" if x.startswith(b"Content-Length: ") else x for x in lines) + mark + b"\r\n\r\n"


def export_warc(records: DataFrame, bodies: bool = True) -> DataFrame:
    """``member``: each record as a gzip member; members put one after another are a .warc.gz file.

    Without ``bodies`` revisits have an empty block and only refer to their response.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(0).to_pylist()
            rows = rows if bodies else map(without_body, rows)
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(x, 6, mtime=0) for x in rows], pa.binary())], names=["member"])

    return records.select("record").mapInArrow(pack, "member binary")


def split_warc(data: bytes) -> Iterator[bytes]:
    """The records of a .warc.gz or .warc file's bytes."""
    while data:
        if data[:2] == b"\x1f\x8b":
            z = zlib.decompressobj(31)
            one = z.decompress(data) + z.flush()
            data = z.unused_data
            yield one
            continue
        head = data.index(b"\r\n\r\n") + 4
        length = next(int(x.split(b":")[1]) for x in data[:head].split(b"\r\n") if x.lower().startswith(b"content-length:"))
        yield data[: head + length + 4]
        data = data[head + length + 4 :]


def op1_content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "op1")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), space)
    fields = parse_records(read_archive(space))
    again = base32_of_hex(F.sha1("payload"))
    same = F.when(again == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload does not match its record's digest")))
    return fields.select(F.col("record_id").alias("page_id"), "payload_bytes", same.alias("payload_digest"), "record_type", "refers_to")


QUERIES = {"op1_content_archive": op1_content_archive}
# DuckDB has no base32; the hexadecimal digits are regrouped by fives.
_B32 = " || ".join(f"substr('{BASE32}', (((('0x' || substr(h, {5 * k + 1}, 5))::BIGINT >> {s}) & 31) + 1)::BIGINT, 1)" for k in range(8) for s in (15, 10, 5, 0))
ORACLE = {
    "op1_content_archive": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY sha256(body)) AS owner FROM p)
SELECT page_id, payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM d"""
}
