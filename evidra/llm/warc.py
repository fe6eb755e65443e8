"""WARC records in a content-addressed archive, native.

An archive is two Parquet tables. ``payloads`` stores each distinct payload once under its SHA-256; whether equal
digests mean equal bytes is verified with a second digest (SHA-1) and the length when payloads are merged, and the
stored bytes are hashed again on reading. ``records`` stores the exact header block of every record and the digest
its payload is found under. The original records come back through a join on the digest.

Defined cases: a null html is an empty payload; the response among records of equal payload is the smallest page_id
(nulls last), rows that repeat it are responses too; a null url leaves an empty target URI; white space and control
characters of a url, which could end a header line, are percent-encoded in UTF-8, all else of it is kept; extra columns
are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import scratch_path, table

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE, CONTENT_TYPE = "1970-01-01T00:00:00Z", "text/html; charset=utf-8"
#: Characters that may not stand in a header's URI: controls, white space and what some readers take for a line end.
UNSAFE = [*range(0x21), 0x7F, 0x85, 0x2028, 0x2029]


def base32_sha1(sha1_hex: Column) -> Column:
    """Upper-case base32 of a SHA-1 given in hex: 32 letters of 5 bits, read from four 40-bit parts."""
    letters = []
    for part in range(4):
        bits = F.conv(F.substring(sha1_hex, 10 * part + 1, 10), 16, 10).cast("long")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, 35 - 5 * i).bitwiseAND(31).cast("int") + 1, F.lit(1)) for i in range(8)]
    return F.concat(*letters)


def safe_uri(url: Column) -> Column:
    """A url in one line: unsafe characters are percent-encoded; an empty text for null."""
    plain = F.coalesce(url, F.lit(""))
    encoded = plain
    for code in UNSAFE:
        encoded = F.replace(encoded, F.lit(chr(code)), F.lit("".join(f"%{b:02X}" for b in chr(code).encode())))
    return F.when(F.rlike(plain, F.lit(r"[\x00-\x20\x7F\x{85}\x{2028}\x{2029}]")), encoded).otherwise(plain)


def _merge_payloads(pages: DataFrame, min_payload: int) -> DataFrame:
    """One row per payload: its bytes, digests, and the record that stands for it."""
    with_digest = pages.select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    merged = with_digest.groupBy("sha256").agg(
        F.min("page_id").alias("owner"),
        F.first("payload").alias("payload"),
        F.min(F.sha1("payload")).alias("sha1"),
        F.max(F.sha1("payload")).alias("sha1_max"),
        F.min(F.octet_length("payload")).alias("n"),
        F.max(F.octet_length("payload")).alias("n_max"),
    )
    same = (F.col("sha1") == F.col("sha1_max")) & (F.col("n") == F.col("n_max"))
    return merged.select(
        F.when(same, F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("two payloads share digest "), "sha256"))).alias("sha256"),
        "owner",
        base32_sha1(F.col("sha1")).alias("digest"),
        F.col("n").cast("long").alias("payload_bytes"),
        (F.col("n") >= min_payload).alias("revisitable"),
        "payload",
    )


def write_archive(pages: DataFrame, path: str, min_payload: int = 0, date: str = DATE) -> None:
    """Write ``payloads`` and ``records`` of an archive under ``path``; page_id and url of a page name its record,
    ``date`` (UTC, in ISO 8601) is when they were captured."""
    _merge_payloads(pages, min_payload).write.parquet(f"{path}/payloads")
    stored = pages.sparkSession.read.parquet(f"{path}/payloads").drop("payload")
    named = pages.select("page_id", "url", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("sha256"))
    is_response = ~F.col("revisitable") | F.col("page_id").eqNullSafe(F.col("owner"))

    def field(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(CRLF))

    def identifier(page: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(">"))

    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        field("WARC-Type", F.when(is_response, "response").otherwise("revisit")),
        field("WARC-Record-ID", identifier("page_id")),
        field("WARC-Date", date),
        field("WARC-Target-URI", safe_uri(F.col("url"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(is_response, F.lit("")).otherwise(
            F.concat(field("WARC-Refers-To", identifier("owner")), field("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        ),
        field("Content-Type", CONTENT_TYPE),
        field("Content-Length", F.when(is_response, F.col("payload_bytes")).otherwise(0).cast("string")),
        F.lit(CRLF),
    )
    named.join(stored, "sha256").select("page_id", "sha256", header.alias("header")).write.parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: their exact headers, payload digests and the payload they stand for."""
    payloads = spark.read.parquet(f"{path}/payloads")
    sound = F.sha2("payload", 256) == F.col("sha256")
    checked = payloads.select(
        "sha256",
        F.when(sound, F.octet_length("payload").cast("long")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "sha256"))).alias("payload_bytes"),
        base32_sha1(F.sha1("payload")).alias("payload_digest"),
        "payload",
    )
    of = lambda name: F.regexp_extract("header", rf"\n{name}: ([^\r\n]*)\r\n", 1)
    records = spark.read.parquet(f"{path}/records")
    return records.join(checked, "sha256").select(
        "page_id",
        "header",
        of("WARC-Type").alias("record_type"),
        of("WARC-Target-URI").alias("url"),
        F.nullif(F.regexp_extract(of("WARC-Refers-To"), r"(-?\d+)>$", 1), F.lit("")).cast("long").alias("refers_to"),
        F.substring(of("WARC-Payload-Digest"), 6, 32).alias("header_digest"),
        "payload_digest",
        "payload_bytes",
        "payload",
    )


def record_bytes() -> Column:
    """A record of an archive that was read, as a WARC file holds it: header block, payload of responses, two line
    ends."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return F.concat(F.col("header").cast("binary"), body, F.lit((CRLF * 2).encode()))


def original_records(archive: DataFrame) -> DataFrame:
    """The bytes of each record."""
    return archive.select("page_id", record_bytes().alias("record"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archive back, and tell what each record is; its bytes are rebuilt and digested."""
    path = scratch_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    archive = read_archive(spark, path)
    return archive.select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        "record_type",
        "refers_to",
        F.octet_length(record_bytes()).cast("long").alias("record_bytes"),
        F.sha2(record_bytes(), 256).alias("record_sha256"),
    )


def _base32_sql(hex_sql: str) -> str:
    letter = "substr('" + BASE32 + "', 1 + ((('0x' || substr({h}, {a}, 10))::BIGINT >> {s}) & 31)::INTEGER, 1)"
    return " || ".join(letter.format(h=hex_sql, a=10 * part + 1, s=35 - 5 * i) for part in range(4) for i in range(8))


def _safe_sql(url: str) -> str:
    for code in UNSAFE:
        if code:  # DuckDB's texts hold no NUL
            url = f"replace({url}, chr({code}), '{''.join(f'%{b:02X}' for b in chr(code).encode())}')"
    return url


OP10_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), o AS (
  SELECT *, min(page_id) OVER (PARTITION BY body) AS owner FROM p
), r AS (
  SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, {_base32_sql("h")} AS payload_digest,
         page_id = owner AS is_response, owner, url, body, chr(13) || chr(10) AS e FROM o
), w AS (
  SELECT *, 'WARC/1.1' || e || 'WARC-Type: ' || CASE WHEN is_response THEN 'response' ELSE 'revisit' END || e
    || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e || 'WARC-Date: {DATE}' || e
    || 'WARC-Target-URI: ' || {_safe_sql("url")} || e || 'WARC-Payload-Digest: sha1:' || payload_digest || e
    || CASE WHEN is_response THEN '' ELSE 'WARC-Refers-To: <urn:page:' || owner || '>' || e
         || 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || e END
    || 'Content-Type: {CONTENT_TYPE}' || e
    || 'Content-Length: ' || CASE WHEN is_response THEN payload_bytes ELSE 0 END || e || e
    || CASE WHEN is_response THEN body ELSE '' END || e || e AS record FROM r
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN is_response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN is_response THEN NULL ELSE owner END AS refers_to,
       octet_length(encode(record))::BIGINT AS record_bytes, sha256(record) AS record_sha256
FROM w
"""
