"""WARC archives: write pages as records, read archives back by verifying the chain of record boundaries.

Archives are read in splits. Every occurrence of the magic is a candidate; its headers give the offset of the record
that would follow. Pointer jumping from the start of each file keeps the candidates that a chain of whole records
reaches, in a logarithmic number of rounds, so magic inside a payload is never taken for a record. Only numbers and
header fields are joined; payloads that hold the magic are fetched piece by piece in a second scan.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedimenta.llm.common import cut, release, scratch_path, ship

MAGIC = "WARC/1.1\r\n"
#: Records of an archive at most.
ARCHIVE_RECORDS = 1000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Base 32 digits as Spark's conv() writes them, and as RFC 4648 does.
DIGITS, RFC4648 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload):
    """SHA-1 as upper-case base 32: five hex digits make four."""
    hex_ = F.sha1(F.encode(payload, "UTF-8"))
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(hex_, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]), DIGITS, RFC4648)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, compression: str = "gzip") -> None:
    """Write a record for each row of pages (page_id, url, html) into archives under path.

    Of records with equal payloads of at least least_bytes, that with the largest page_id is a response (so are rows
    that repeat its id) and the others revisit it; smaller ones are all responses. A null html is an empty payload, a null
    url is left out, a null page_id is written as none and is a response only among its own kind. Archives are compressed
    as whole files, which readers then take in one piece, or plain ("none"). An empty table gives an archive without records.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    kept = cut(rows.groupBy("digest").agg(F.max("page_id").alias("keeper")), "keepers")
    rows = rows.join(kept, "digest")
    revisit = (F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), line("WARC-Record-ID", name("page_id")), line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", "%0A")), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, line("WARC-Refers-To", name("keeper"))).otherwise(F.lit("")), line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block, F.lit("\r\n\r"),
    )
    rows.select(record.alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", ARCHIVE_RECORDS).option("compression", compression).text(path)
    del rows
    release(pages.sparkSession)


def _headers(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n"))
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


_FIELDS = pa.schema([("path", pa.string()), ("block", pa.int64()), ("rel", pa.int64()), ("size", pa.int64()), ("head", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("page", pa.string()), ("refers", pa.string()), ("declared", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
#: A length of more digits is none: offsets stay whole numbers of 64 bits whatever a page claims.
_LENGTH = re.compile("[0-9]{1,15}").fullmatch
_PAGE = re.compile(r"<urn:page:(.*)>").fullmatch


def _payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Each batch with its pieces' places relative to the start of their split; a split's pieces come in order."""
    now, at = None, 0
    for b in batches:
        places = []
        for key, size in zip(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True), pc.binary_length(b.column(0)).to_pylist(), strict=True):
            if key != now:
                now, at = key, 0
            places.append(at)
            at += size + len(MAGIC)
        yield b, places


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece between two magics; head and the fields are null if no record can begin there."""
    for b, places in _places(batches):
        rows = []
        for value, path, block, rel in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), places, strict=True):
            raw = value.as_py()
            row = {"path": path, "block": block, "rel": rel, "size": len(raw)}
            head, mark, _ = raw.partition(b"\r\n\r\n")
            h = _headers(head) if mark else {}
            if _LENGTH(h.get("content-length", "")) and "warc-type" in h:
                page, refers = (m[1] if (m := _PAGE(h.get(k, ""))) else None for k in ("warc-record-id", "warc-refers-to"))
                row |= {"head": len(head) + 4, "length": int(h["content-length"]), "type": h["warc-type"], "page": page, "refers": refers, "declared": h.get("warc-payload-digest", "").removeprefix("sha1:")}
                if len(raw) == row["head"] + row["length"] + 4:
                    own = _payload(raw[row["head"] : -4])
                    row |= {"payload_bytes": len(own), "payload_digest": _digest(own)}
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, places in _places(batches):
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(places, pa.int64()), b.column(0)], ["path", "block", "rel", "raw"])


def _assemble(table: pa.Table) -> pa.Table:
    """One record from its pieces."""
    t = table.sort_by("piece")
    head, length = t.column("head")[0].as_py(), t.column("length")[0].as_py()
    own = _payload(MAGIC.encode().join(t.column("raw").to_pylist())[head : head + length])
    return pa.table({"file": t.column("file")[:1], "off": t.column("off")[:1], "b": pa.array([len(own)], pa.int64()), "d": [_digest(own)]})


def reachable(links: DataFrame) -> DataFrame:
    """(file, off) of what the chain from offset 0 of each file reaches; links has file, off and the next offset, next."""
    jump = cut(links.select("file", "off", "next"), "jump")
    reached = jump.where("off = 0").select("file", "off").distinct()
    reached, n = cut(reached, "reached"), -1
    while (m := reached.count()) != n:
        n = m
        ahead = jump.join(reached, ["file", "off"]).select("file", F.col("next").alias("off")).where("off is not null")
        reached = cut(reached.unionByName(ahead).distinct(), "reached")
        twice = jump.select("file", F.col("off").alias("next"), F.col("next").alias("then"))
        jump = cut(jump.join(twice, ["file", "next"]).select("file", "off", F.col("then").alias("next")).where("next is not null"), "jump")
    return reached


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under path: file, off, type, page, refers, declared, payload_bytes, payload_digest.

    Archives are WARC 1.1, plain (read in splits) or compressed as a whole; offsets are those of the plain bytes. A chain that breaks, at a damaged record, ends there: what follows
    in that file is left out. An empty folder or file has no records.
    """
    ship(spark)
    pieces = spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    kinds = ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'string'}" for f in _FIELDS)
    parsed = cut(pieces.mapInArrow(_parse, kinds), "pieces")
    splits = parsed.groupBy("path", "block").agg(F.max(F.col("rel") + F.col("size") + len(MAGIC)).alias("bytes"))
    base = F.coalesce(F.sum("bytes").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = cut(splits.select("path", "block", base.alias("base")), "splits")
    files = splits.select("path").distinct().select("path", (F.row_number().over(W.orderBy("path"))).alias("file"))
    splits = cut(splits.join(files, "path"), "splits")
    placed = parsed.join(splits, ["path", "block"]).withColumn("off", F.col("base") + F.col("rel") - len(MAGIC))
    could = placed.where("head is not null and off >= 0").withColumn("next", F.col("off") + len(MAGIC) + F.col("head") + F.col("length") + 4)
    could = cut(could.select("file", "off", "next", "head", "length", "type", "page", "refers", "declared", "payload_bytes", "payload_digest"), "candidates")
    found = cut(could.join(reachable(could), ["file", "off"]), "records")
    parts = found.where("payload_digest is null").select("file", F.col("off").alias("start"), F.col("next").alias("end"), "head", "length")
    if parts.isEmpty():
        return found.drop("next", "head", "length")
    parts = cut(placed.select("file", "path", "block", "rel", F.col("off").alias("piece")).join(parts, "file").where("piece >= start and piece < end"), "parts")
    raw = pieces.mapInArrow(_raw, "path string, block bigint, rel bigint, raw binary").join(parts, ["path", "block", "rel"])
    raw = raw.select("file", F.col("start").alias("off"), "piece", "head", "length", "raw")
    whole = cut(raw.groupBy("file", "off").applyInArrow(_assemble, "file int, off long, b long, d string"), "assembled")
    out = found.join(whole, ["file", "off"], "left")
    return out.withColumns({"payload_bytes": F.coalesce("payload_bytes", "b"), "payload_digest": F.coalesce("payload_digest", "d")}).drop("next", "head", "length", "b", "d")


def resolve(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record; a revisit takes its size from what it refers to."""
    rows = cut(records.select("type", F.expr("try_cast(page as bigint)").alias("page_id"), F.expr("try_cast(refers as bigint)").alias("refers_to"), "declared", "payload_bytes", "payload_digest"), "resolved")
    heads = cut(rows.where("type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("declared")).agg(F.max("payload_bytes").alias("full")), "heads")
    again = rows.where("type = 'revisit'").join(heads, ["refers_to", "declared"], "left")
    again = again.select("page_id", F.col("full").alias("payload_bytes"), F.col("declared").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    plain = rows.where("type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"))
    return plain.unionByName(again)


def op7_warc(spark, sf_dir):
    path = scratch_path(spark, "archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return resolve(read_archives(spark, path))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages
), h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p
), d AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (list_sum(list_transform(range(5), lambda b:
      (((instr('0123456789abcdef', substr(hex, (i * 5 + b) // 4 + 1, 1)) - 1) >> (3 - (i * 5 + b) % 4)::INTEGER) & 1) << (4 - b)::INTEGER)) + 1)::BIGINT, 1)), '') AS payload_digest FROM h
), k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM k
"""
