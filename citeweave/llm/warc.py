"""WARC records in a content-addressed archive.

An archive is a folder with two tables. ``payloads`` holds each payload's bytes once, under its SHA-256 (the address)
with its length. ``records`` holds a record's exact header block (binary), its id, type, address and, for a revisit, the
record it refers to. A record's original bytes are its header, its payload (a response's) and the closing line ends:
``reconstruct`` joins the tables on the address. What is read is verified: the payload's SHA-256 must be its address and
its length the header's; ``reconstruct`` marks records that fail.

Of the records with equal payloads of ``min_bytes`` or more, the one with the smallest id carries the payload (response),
the others are revisits of it. The smallest id is a grouped minimum, combined before the shuffle; the joins are between
a record and one row of its payload, where Spark may split the partition of a payload that very many records share.

Everything is DataFrame operations; the writer's commit protocol covers lost executors.

Edge cases: a null html is an empty payload; a null url is an empty target; rows that repeat an id and payload are all
responses if the id is the smallest (their payload is still stored once); null ids come after all others, and records
of a payload that only null ids have are responses; an empty table gives an empty archive; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import fresh_path

DATE = "2020-01-01T00:00:00Z"
#: The record format's names, and the digits of base 32.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PAYLOAD_OPTIONS = {"compression": "zstd", "parquet.block.size": str(32 << 20)}


def base32_sha1(payload) -> F.Column:
    """Upper-case base-32 SHA-1 of a binary column: four groups of 40 bits, eight digits each."""
    hexed = F.sha1(payload)
    digits = F.array(*(F.lit(c) for c in BASE32))
    groups = [F.conv(F.substring(hexed, 1 + 10 * g, 10), 16, 10).cast("long") for g in range(4)]
    return F.concat(*(F.element_at(digits, (F.shiftright(v, 5 * i).bitwiseAND(31) + 1).cast("int")) for v in groups for i in range(7, -1, -1)))


def _identity(id_):
    """An id as a name in a header: percent-encoded, so that it may hold any character."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(id_.cast("string")), F.lit("")), F.lit(">"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = DATE) -> None:
    """Write ``pages`` as an archive under ``path``."""
    spark = pages.sparkSession
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    narrow = own.select("id", "url", F.sha2("payload", 256).alias("address"), base32_sha1(F.col("payload")).alias("sha1"), F.length("payload").cast("long").alias("bytes"))
    narrow.write.options(compression="zstd").parquet(f"{path}/index")
    narrow = spark.read.parquet(f"{path}/index")
    first = narrow.groupBy("address").agg(F.min("id").alias("first"))
    records = narrow.join(first, "address")
    revisit = (F.col("bytes") >= min_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    records = records.withColumn("type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    safe_url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    header = F.concat(
        F.lit(f"{VERSION}\r\n"), line("WARC-Type", F.col("type")), line("WARC-Record-ID", _identity(F.col("id"))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", safe_url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")), line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.when(revisit, F.sha2(F.lit(b""), 256)).otherwise(F.col("address")))), F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _identity(F.col("refers_to"))))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(revisit, "0").otherwise(F.col("bytes").cast("string"))), F.lit("\r\n"),
    )
    records.select("id", "type", "refers_to", "address", F.encode(header, "UTF-8").alias("header")).write.options(compression="zstd").parquet(f"{path}/records")
    # each payload once: the rows of the smallest id. Address and id deal the rows out, so copies don't meet in one
    # task; rows that repeat both are told apart where they already lie
    key = F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("key")  # never null: join and distinct share one shuffle
    kept = spark.read.parquet(f"{path}/records").groupBy("address").agg(F.min("id").alias("id")).select("address", key)
    own = own.select(F.sha2("payload", 256).alias("address"), key, "payload")
    chosen = own.join(kept, ["address", "key"], "left_semi").dropDuplicates(["address", "key"])
    chosen.select("address", F.length("payload").cast("long").alias("bytes"), "payload").write.options(**PAYLOAD_OPTIONS).parquet(f"{path}/payloads")


def records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/records")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """The payload table with ``verified``: the bytes' SHA-256 is their address, their number the stored one."""
    stored = spark.read.parquet(f"{path}/payloads")
    return stored.withColumn("verified", (F.sha2("payload", 256) == F.col("address")) & (F.length("payload") == F.col("bytes")))


def field(header, name: str) -> F.Column:
    """A field of a header block."""
    return F.regexp_extract(header, rf"(?m)^{name}: ([^\r\n]*)$", 1)


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """id, record (the original bytes), verified; a revisit's block is empty, as its payload is another record's."""
    joined = records(spark, path).where("type = 'response'").join(payloads(spark, path), "address", "left")
    end = F.lit(b"\r\n\r\n")
    whole = joined.select("id", F.concat("header", "payload", end).alias("record"), F.coalesce(F.col("verified") & (field(F.decode("header", "UTF-8"), "Content-Length") == F.col("bytes").cast("string")), F.lit(False)).alias("verified"))
    rest = records(spark, path).where("type <> 'response'").select("id", F.concat("header", end).alias("record"), F.lit(True).alias("verified"))
    return whole.unionByName(rest)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write ``pages``, read the archive back: id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest are of the stored payload, computed anew from its bytes; type and reference are the header's. A
    payload that fails its check, or is missing, ends the job.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write(pages, path, id_col, url_col, html_col, min_bytes)
    found = payloads(spark, path).select("address", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), "verified")
    head = F.decode("header", "UTF-8")
    read = records(spark, path).select("id", "address", field(head, "WARC-Type").alias("record_type"), F.when(field(head, "WARC-Type") == "revisit", F.url_decode(F.regexp_extract(field(head, "WARC-Refers-To"), r"^<urn:page:(.*)>$", 1))).alias("refers"))
    kind = dict(pages.dtypes)[id_col]
    back = read.join(found, "address", "left")
    checked = F.when(F.coalesce("verified", F.lit(False)), F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("payload missing or damaged: "), "address")))
    return back.select(F.col("id").alias(id_col), checked.cast("long").alias("payload_bytes"), "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to"))
