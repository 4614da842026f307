"""A content-addressed web archive: each distinct payload is stored once, record headers apart from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, shared_path, table

MIN_REVISIT = 1000
_CRLF = "\r\n"
_DATE = "1970-01-01T00:00:00Z"
#: Header of this archive: says that WARC-Target-URI is percent-encoded because of a line break in it.
_CODED = "X-Target-URI-Encoding"


def _payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def _record_headers() -> Column:
    """The exact bytes of a record up to its payload: WARC headers, blank line, HTTP headers, blank line.

    A null URL has no header. A line break inside a URL would end the header: such a URL is percent-encoded, and a
    header of its own says so.
    """
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(_CRLF * 2),
    )
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    ident = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    url = F.col("url")
    coded = F.replace(F.replace(F.replace(url, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    target = F.when(url.isNull(), F.lit("")).when(url.rlike(r"[\r\n]"), F.concat(F.lit(f"{_CRLF}{_CODED}: percent{_CRLF}WARC-Target-URI: "), coded)).otherwise(F.concat(F.lit(f"{_CRLF}WARC-Target-URI: "), url))
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{_CRLF}WARC-Record-ID: <urn:page:"), ident, F.lit(f">{_CRLF}WARC-Date: {_DATE}"), target,
        F.lit(f"{_CRLF}WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(revisit, F.concat(F.lit(f"{_CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_CRLF}WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{_CRLF}Content-Type: application/http; msgtype=response{_CRLF}Content-Length: "), block.cast("string"), F.lit(_CRLF * 2),
    )
    return F.encode(F.concat(head, http), "UTF-8")


def write_archive(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> str:
    """Writes path/payloads (sha256, payload; one row per distinct payload) and path/records (headers, sha256).

    Of records with equal payloads of at least min_revisit bytes, that with the largest page_id is the response
    and others revisit it; smaller ones are all responses. A null html is an empty payload. Rows that repeat the
    largest page_id are all responses. A null page_id never is referred to, unless equal payloads have no other,
    when all are responses. Other columns of pages are not archived. An empty table gives an empty archive.
    """
    p = pick(pages, "page_id", "url", "html").withColumn("payload", _payload(F.col("html")))
    light = p.select("page_id", "url", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha256"))
    firsts = light.where(F.col("n") >= min_revisit).groupBy("sha256").agg(F.max("page_id").alias("response"))
    linked = light.join(firsts, "sha256", "left")
    refers = F.when(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    records = linked.withColumn("refers_to", refers)
    records.select("sha256", _record_headers().alias("headers")).write.parquet(f"{path}/records")
    # first() merges the copies of a payload in each task before any is shuffled
    stored = p.select(F.sha2("payload", 256).alias("sha256"), "payload").groupBy("sha256").agg(F.first("payload").alias("payload"))
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """sha256, payload, after the digest of every payload has been checked; a damaged one raises an error."""
    p = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    ok = F.sha2("payload", 256) == F.col("sha256")
    return p.withColumn("payload", F.when(ok, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), "sha256")).cast("binary")))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("sha256 string, headers binary").parquet(f"{path}/records")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """record: the exact bytes of every record, with headers and payload, the full one that the record stands for.

    Every record meets its payload by a join on the strong digest. Of a revisit, record has the headers alone, and
    payload what the record referred to has. Records are the side that streams, so a payload that a third of all
    records share is held once a task, and the join can split it.
    """
    end = F.encode(F.lit(_CRLF * 2), "UTF-8")
    joined = read_records(spark, path).join(read_payloads(spark, path), "sha256")
    body = F.when(header("WARC-Type", F.decode("headers", "UTF-8")) == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.select(F.concat("headers", body, end).alias("record"), "payload")


def header(name: str, head: Column) -> Column:
    """A header of a record's head (text); null if it has none."""
    found = rf"(?:\A|\r\n){name}: ([^\r\n]*)(?:\r\n|\z)"
    return F.when(head.rlike(found), F.regexp_extract(head, found, 1))


def parse_records(records: DataFrame) -> DataFrame:
    """Per record, from its bytes alone: page_id, url, record_type, refers_to, header_digest, http_head, body.

    The record's length must be what its headers say, or an error is raised; body is what follows the HTTP headers.
    """
    blank = _CRLF * 2
    # headers end at the first blank line; what follows is counted in bytes
    r = records.withColumn("head", F.substring_index(F.decode("record", "UTF-8"), blank, 1))
    r = r.withColumn("at", F.octet_length("head") + len(blank))
    size = header("Content-Length", F.col("head")).cast("int")
    fits = F.octet_length("record") == F.col("at") + size + len(blank)
    r = r.withColumn("block", F.when(fits, F.substring(F.col("record"), F.col("at") + 1, size)).otherwise(F.raise_error(F.concat(F.lit("a record is not as long as its headers say: "), "head")).cast("binary")))
    r = r.withColumn("http_head", F.substring_index(F.decode("block", "UTF-8"), blank, 1))
    uri = lambda name: F.regexp_extract(F.coalesce(header(name, F.col("head")), F.lit("")), r"<urn:page:(-?\d+)>", 1)
    number = lambda name: F.when(uri(name) != "", uri(name).cast("long"))
    url = header("WARC-Target-URI", F.col("head"))
    plain = F.replace(F.replace(F.replace(url, F.lit("%0A"), F.lit("\n")), F.lit("%0D"), F.lit("\r")), F.lit("%25"), F.lit("%"))
    return r.select(
        number("WARC-Record-ID").alias("page_id"), F.when(header(_CODED, F.col("head")) == "percent", plain).otherwise(url).alias("url"), header("WARC-Type", F.col("head")).alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"), F.substring_index(header("WARC-Payload-Digest", F.col("head")), ":", -1).alias("header_digest"), "http_head",
        F.expr(f"substring(block, octet_length(http_head) + {len(blank) + 1})").alias("body"), *[c for c in ("payload",) if c in records.columns],
    )


def scan_archive(spark: SparkSession, path: str) -> DataFrame:
    """Per record, parsed out of its reconstructed bytes: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A response's payload is the body of its record; a revisit's is that of the record it refers to. Its digest and its
    length are computed anew, and must be those that the record's headers name, or an error is raised.
    """
    r = parse_records(reconstruct(spark, path))
    full = F.when(F.col("record_type") == "revisit", F.col("payload")).otherwise(F.col("body"))
    r = r.withColumns({"payload_digest": F.sha1(full), "payload_bytes": F.octet_length(full).cast("long")})
    said = (F.col("payload_digest") == F.col("header_digest")) & (F.col("payload_bytes") == header("Content-Length", F.col("http_head")).cast("long"))
    digest = F.when(said, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("a record's headers don't name its payload: "), F.coalesce("header_digest", F.lit("no digest")))).cast("string"))
    return r.select("page_id", "url", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archive(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    return scan_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as n, sha1(html) as digest, sha256(html) as strong from p),
r as (select strong, max(page_id) as response from d where n >= {MIN_REVISIT} group by strong)
select page_id, n as payload_bytes, digest as payload_digest,
  case when response is not null and page_id is distinct from response then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from response then response end as refers_to
from d left join r using (strong)
"""
