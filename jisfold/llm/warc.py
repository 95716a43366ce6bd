"""A content-addressed archive of WARC records.

Payloads are stored once each, by their SHA-256; the exact headers of every
record lie in a table of their own, and original records come back by a join
of the two.  Of records with equal payloads the one with the smallest id is
the response, and the others are revisits of it without a payload of their own.

Only narrow rows (id, digests, size) are grouped by digest.  A payload that
more than one in 4,096 records has is dropped at once in all records but the
response, by a broadcast of those digests, of which there are 4,096 at most;
others are shuffled once, after copies within a task are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jisfold.llm.common import stash

CRLF = "\r\n"
#: A payload is hot from one in so many records on.
HOT = 4096
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NO_ID = "<urn:page-without-id>"


def base32(hexed: Column) -> Column:
    """Base 32 of 40 hexadecimal digits (a SHA-1), 5 bytes at a time."""
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uri(page_id: Column) -> Column:
    return F.when(page_id.isNull(), F.lit(_NO_ID)).otherwise(F.concat(F.lit("<urn:page:"), F.url_encode(page_id.cast("string")), F.lit(">")))


def _id_of(uri: Column) -> Column:
    return F.url_decode(F.nullif(F.regexp_extract(uri, r"^<urn:page:(.*)>$", 1), F.lit("")))


def _field(header: Column, name: str) -> Column:
    """A header field's value, null where it is absent."""
    return F.nullif(F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes the archive of a table of pages: folder/payloads and folder/records.

    A null html is an empty payload; an empty payload is one like any other.
    Payloads below ``least_bytes`` are never revisited: each such record is a
    response.  Ids may be of any type that becomes text; a null id is larger
    than all others, and where all ids of a payload are null, all are
    responses.  Rows that repeat the smallest id with the same payload are all
    responses.  Line ends in a url are escaped, a null url gives no field.
    Other columns of the table, whatever their names, don't matter.  A payload
    of any length is one cell.  An empty table gives an empty archive.
    """
    body = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    own = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    digest = F.unhex(F.sha2("payload", 256)).alias("digest")
    facts = stash(own.select("id", "url", digest, F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"), F.xxhash64("payload").alias("check")), "warc-facts")
    # a second, independent hash and the size tell whether equal digests are equal payloads
    same = (F.min("check") == F.max("check")) & (F.min("size") == F.max("size"))
    groups = facts.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("keeper"), same.alias("same"))
    groups = stash(groups.withColumn("n", F.when(F.col("same"), F.col("n")).otherwise(F.raise_error(F.lit("different payloads share a SHA-256")).cast("long"))).drop("same"), "warc-groups")
    hot = groups.where(F.col("n") >= max(2, facts.count() // HOT)).orderBy(F.desc("n")).limit(2 * HOT)

    kept = own.select("id", "payload", digest).join(F.broadcast(hot.select("digest", F.col("keeper").alias("only"), F.lit(True).alias("hot"))), "digest", "left")
    kept = kept.where(F.col("hot").isNull() | F.col("id").eqNullSafe(F.col("only")))
    kept.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{folder}/payloads")

    cold = facts.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(groups.select("digest", "keeper"), "digest")
    warm = facts.join(F.broadcast(hot.select("digest", "keeper")), "digest")
    _headers(cold.unionByName(warm), least_bytes, date).write.option("compression", "zstd").parquet(f"{folder}/records")


def _headers(rows: DataFrame, least_bytes: int, date: str) -> DataFrame:
    """(digest, header, http) of each record, exactly as a WARC file has them."""
    revisit = (F.col("size") >= least_bytes) & F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    size = F.col("size").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF + CRLF))
    rows = rows.select("id", "url", "digest", "sha1", "size", "keeper", kind.alias("kind"), http.alias("http"))
    block = F.length("http") + F.when(F.col("kind") == "response", F.col("size")).otherwise(F.lit(0))
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    fields = [
        F.concat(F.lit("WARC-Type: "), F.col("kind")),
        F.concat(F.lit("WARC-Record-ID: "), _uri(F.col("id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha1"))),
        F.when(F.col("kind") == "revisit", F.concat(F.lit(f"WARC-Profile: {_REVISIT}{CRLF}WARC-Refers-To: "), _uri(F.col("keeper")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    header = F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *fields), F.lit(CRLF + CRLF))
    return rows.select("digest", header.alias("header"), "http")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The archive's records with their payloads, verified.

    page_id and refers_to (text), record_type, payload (of revisits too),
    payload_digest (bare base 32 of the SHA-1 of the stored bytes), header and
    http (exact).  A payload whose bytes don't have the digest that it is
    stored by, or that the record's header states, fails the job, as does a
    record whose payload is missing.
    """
    payloads = spark.read.schema("digest binary, payload binary").parquet(f"{folder}/payloads")
    records = spark.read.schema("digest binary, header string, http string").parquet(f"{folder}/records")
    checked = payloads.select("digest", F.unhex(F.sha2("payload", 256)).alias("found"), base32(F.sha1("payload")).alias("sha1"), "payload")
    whole = records.join(checked, "digest", "left")
    good = F.col("found").eqNullSafe(F.col("digest")) & (_field(F.col("header"), "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("sha1")))
    payload = F.when(good, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload is missing or is not what its digest says")).cast("binary"))
    header = F.col("header")
    return whole.select(
        _id_of(_field(header, "WARC-Record-ID")).alias("page_id"),
        _field(header, "WARC-Type").alias("record_type"),
        _id_of(_field(header, "WARC-Refers-To")).alias("refers_to"),
        F.col("sha1").alias("payload_digest"),
        payload.alias("payload"),
        "header",
        "http",
    )


def original(records: DataFrame) -> DataFrame:
    """``record``: each record's bytes as in a WARC file, without the two line
    ends after it; revisits have no payload."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.withColumn("record", F.concat(F.col("header").cast("binary"), F.col("http").cast("binary"), body))


def export(records: DataFrame, folder: str) -> None:
    """WARC files (gzip) of the records, one for each partition.

    Spark's text sink writes a cell's bytes as they are, whatever they hold,
    and after each what stands between WARC records.
    """
    cells = original(records).select(F.col("record").cast("string").alias("value"))
    cells.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(folder)
