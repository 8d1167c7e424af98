"""Content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256; the exact header of every record is stored apart.
Of records with equal payloads that with the largest page_id is the response, the others revisit it.
Records come back through a join of headers with payloads, and each payload read is held against its
digest again.

Defined cases: a null html is an empty payload; a null url is an empty one, line ends in it are
percent-encoded; a null page_id counts as smallest; rows repeated with the response's page_id are all
responses; an empty table gives an empty archive; other columns are not read. A very long
payload is one record; of equal payloads with the same page_id none comes before the other.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, text_or_empty

END = "\r\n"
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: 40 bits at a time through base-32 digits."""
    digits, letters = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    hexed = F.sha1(payload)
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]), digits, letters)


def record_uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


@dataclass
class Archive:
    """Two tables in one folder: payloads (digest, payload) and headers (page_id, digest, header)."""

    spark: SparkSession
    path: str

    def payloads(self) -> DataFrame:
        return self.spark.read.schema("digest string, payload binary").parquet(f"{self.path}/payloads")

    def headers(self) -> DataFrame:
        return self.spark.read.schema("page_id long, digest string, header string").parquet(f"{self.path}/headers")

    def records(self) -> DataFrame:
        """page_id, header, payload (the full one, for revisits too), record (the bytes of the WARC record)."""
        rows = self.headers().join(self.payloads(), "digest")
        sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "digest")).cast("binary"))
        rows = rows.select("page_id", "header", sound.alias("payload"))
        body = F.when(header_field(F.col("header"), "WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
        return rows.withColumn("record", F.concat(F.encode("header", "UTF-8"), body, F.lit(b"\r\n\r\n")))


def header_field(header: Column, name: str) -> Column:
    """The value of a WARC header field, null where it is absent; looked for before the block alone."""
    found = F.regexp_extract(F.substring_index(header, END + END, 1), rf"\r\n{name}: ([^\r]*)", 1)
    return F.nullif(found, F.lit(""))


def write(pages: DataFrame, path: str | None = None, date: str = DATE) -> Archive:
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    payload = F.encode(text_or_empty("html"), "UTF-8")
    url = F.replace(F.replace(text_or_empty("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = rows.groupBy("digest").agg(F.max("page_id").alias("last"))
    # the stored payload is the response's: joined on digest and id, copies of a payload spread out
    kept = F.coalesce("last", F.lit(-1).cast("long"))
    own = rows.select("digest", "payload", F.coalesce("page_id", F.lit(-1).cast("long")).alias("id"))
    stored = own.join(groups.select("digest", kept.alias("id")), ["digest", "id"]).dropDuplicates(["digest", "id"]).select("digest", "payload")
    stored.write.parquet(f"{path}/payloads")
    named = rows.select("page_id", "url", "digest", F.octet_length("payload").alias("n"), base32_sha1(F.col("payload")).alias("sha1")).join(groups, "digest")
    revisit = ~F.col("page_id").eqNullSafe(F.col("last"))
    block = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n"), F.lit(END + END))
    fields = F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(f"{END}WARC-Record-ID: "), record_uri(F.col("page_id")),
        F.lit(f"{END}WARC-Date: {date}{END}WARC-Target-URI: "), F.col("url"), F.lit(f"{END}WARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(revisit, F.concat(F.lit(f"{END}WARC-Refers-To: "), record_uri(F.col("last")), F.lit(f"{END}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.lit(f"{END}Content-Type: application/http; msgtype=response{END}Content-Length: "), F.length(block) + F.when(revisit, 0).otherwise(F.col("n")), F.lit(END + END),
    )
    named.select("page_id", "digest", F.concat(fields, block).alias("header")).write.parquet(f"{path}/headers")
    return Archive(spark, path)
