"""Content-addressed WARC archive.

An archive is two Parquet tables in one folder:

* `payloads`: digest (SHA-256 hex), payload (one Zstandard frame), shares; each distinct payload is stored once.
* `records`: header (the exact bytes of the WARC/1.1 record header, blank line included), digest, length, share; one row per
  record.

Reading joins them on the digest and unpacks each record's payload; one whose length or SHA-256 is not that of the record, or a record
without its payload, raises an error. A record is `header + payload + CRLF CRLF` (`revisit` records carry no block of their own; their
payload is that of the record they refer to). The records of a payload are spread over `shares` keys of the join, one for
about every `PER_SHARE` of them, and the packed payload travels once to each.

Of records with equal payloads of at least `min_revisit` bytes, the one with the largest id is the `response` and
the others are `revisit`s of it; shorter ones are all `response`.

Defined results: null payloads are empty; null URLs are written as an empty field; line breaks in URLs are
percent-encoded, so they cannot break a header; null ids are written as an empty id and read back as null, and
never chosen as the response while another id exists; repeated rows are repeated records: of equal ids and equal
payloads one group is formed, and all rows with the response's id are responses; further columns of the pages are not archived.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaweft.llm import textvec
from chromaweft.llm.common import discard, materialize

MIN_REVISIT = 1000
#: Copies of one payload are spread over so many keys in the join that names their response.
SALTS = 16
PER_SHARE = 500
RECORD_DATE = "1970-01-01T00:00:00Z"


def _keyed(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload")).select("*", F.sha2("payload", 256).alias("digest"))


def _pack(batches):
    pack = zstandard.ZstdCompressor(3).compress
    for batch in batches:
        for piece in textvec.pieces(batch, "payload"):
            yield pa.RecordBatch.from_arrays([piece.column("digest"), pa.array([pack(x) for x in piece.column("payload").to_pylist()], pa.binary())], names=["digest", "payload"])


def write_archive(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Write one record per row of (page_id, url, html)."""
    keyed = _keyed(pages)
    shares = (F.floor(F.count(F.lit(1)) / PER_SHARE) + 1).cast("int")
    # each payload once; equal ones meet already on the map side
    packed = keyed.select("digest", "payload").mapInArrow(_pack, "digest string, payload binary")
    packed.groupBy("digest").agg(F.first("payload").alias("payload"), shares.alias("shares")).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/payloads")
    index = materialize(keyed.select("page_id", "url", F.sha1("payload").alias("sha1"), "digest", F.octet_length("payload").cast("long").alias("length")), "warc-index")
    groups = (
        index.groupBy("digest")
        .agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("copies"), shares.alias("shares"))
        .filter("copies > 1")
        .select(F.col("digest").alias("g_digest"), "response_id", "shares", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("g_salt"))
    )
    number = F.xxhash64(F.coalesce("page_id", F.xxhash64("url")))
    salted = index.withColumn("salt", F.pmod(number, F.lit(SALTS)).cast("int"))
    typed = salted.join(groups, (F.col("digest") == F.col("g_digest")) & (F.col("salt") == F.col("g_salt")), "left")
    other = F.coalesce(F.col("response_id") != F.col("page_id"), F.lit(False)) | (F.col("page_id").isNull() & F.col("response_id").isNotNull())
    revisit = (F.col("length") >= min_revisit) & other
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.lit(f"WARC-Date: {RECORD_DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("response_id").cast("string"), F.lit(">"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("length")).cast("string")),
    ]
    header = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))
    share = F.pmod(F.shiftright(number, 8), F.coalesce("shares", F.lit(1))).cast("int")
    typed.select(F.encode(header, "UTF-8").alias("header"), "digest", "length", share.alias("share")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/records")
    discard(index)


def _fields(header: str = "header") -> list:
    """Columns read from the header bytes; each field is looked for at the start of a line."""
    text = F.decode(header, "UTF-8")

    def field(name: str, pattern: str = r"([^\r\n]*)"):
        return F.regexp_extract(text, rf"(?:^|\r\n){name}: {pattern}\r\n", 1)

    def page(name: str):
        return F.nullif(field(name, "<urn:page:(-?[0-9]*)>"), F.lit("")).cast("long")

    return [
        field("WARC-Type").alias("record_type"),
        page("WARC-Record-ID").alias("page_id"),
        field("WARC-Target-URI").alias("target_uri"),
        field("WARC-Payload-Digest", "sha1:([0-9a-f]*)").alias("header_sha1"),
        page("WARC-Refers-To").alias("refers_to"),
    ]


def _unpack(batches):
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for piece in textvec.pieces(batch, "payload", limit=1 << 20):
            whole = []
            for packed, digest, length in zip(*[piece.column(c).to_pylist() for c in ("payload", "digest", "length")]):
                if packed is None:
                    raise ValueError(f"record without payload {digest}")
                data = unpack(packed) if length else b""
                if len(data) != length or hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"corrupt payload {digest}")
                whole.append(data)
            yield pa.RecordBatch.from_arrays([piece.column("header"), piece.column("length"), pa.array(whole, pa.binary())], names=["header", "length", "payload"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record with its header fields, payload (of the referred record for revisits) and exact bytes."""
    records = spark.read.parquet(f"{path}/records")
    stored = spark.read.parquet(f"{path}/payloads").select(F.col("digest").alias("p_digest"), "payload", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("p_share"))
    joined = records.join(stored, (F.col("digest") == F.col("p_digest")) & (F.col("share") == F.col("p_share")), "left").select("header", "digest", "length", "payload")
    out = joined.mapInArrow(_unpack, "header binary, length bigint, payload binary").select(*_fields(), "header", "length", "payload")
    block = F.when(F.col("record_type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return out.withColumn("record", F.concat("header", block, F.encode(F.lit("\r\n\r\n"), "UTF-8")))


def digest_rows(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records as rebuilt; a digest that the header denies is an error."""
    found = read_records(spark, path).withColumn("sha1", F.sha1("payload"))
    sound = F.when(F.col("sha1") == F.col("header_sha1"), F.col("sha1")).otherwise(F.raise_error(F.lit("header and payload differ")))
    return found.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), sound.alias("payload_digest"), "record_type", "refers_to")
