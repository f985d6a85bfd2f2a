"""Content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256. The exact header bytes of
every record (WARC header and HTTP header) are kept apart from them, with the
digest as the reference. Records are rebuilt byte for byte by a join, and the
digest of every payload is computed again when it is read.

Of records with equal payloads of at least ``least`` bytes, the one with the
largest key is a response and the others are revisits that name it; smaller
payloads make responses only.

Rows: a null payload is an empty one; a null URL leaves its header out; a row
with a null key is a revisit when its payload has a response under another key;
repeated rows of one key are records each, of the same type.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinline.session import new_path, settle

LEAST = 1000
BREAK = "\r\n"
GAP = BREAK * 2
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"


@dataclass(frozen=True)
class Archive:
    """``heads (head, digest, stored)``, one row per record, and ``contents (digest, payload)``."""

    heads: DataFrame
    contents: DataFrame


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))


def _heads(rows: DataFrame, date: str) -> DataFrame:
    http = F.concat(
        F.lit("HTTP/1.1 200 OK" + BREAK + "Content-Type: text/html; charset=utf-8" + BREAK),
        _line("Content-Length", F.col("size").cast("string")),
        F.lit(BREAK),
    )
    revisit = F.col("refers").isNotNull()
    length = F.octet_length("http") + F.when(revisit, 0).otherwise(F.col("size"))
    head = F.concat(
        F.lit("WARC/1.1" + BREAK),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        F.coalesce(_line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("key"), F.lit(">"))), F.lit("")),
        F.coalesce(_line("WARC-Target-URI", F.translate("url", BREAK, "")), F.lit("")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.coalesce(_line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers"), F.lit(">"))), F.lit("")),
        F.when(revisit, BREAK.join([f"WARC-Profile: {PROFILE}", ""])).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response" + BREAK),
        _line("Content-Length", length.cast("string")),
        F.lit(BREAK),
        F.col("http"),
    )
    return rows.withColumn("http", http).select(F.encode(head, "UTF-8").alias("head"), "digest", (~revisit).alias("stored"))


def archive(
    pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, date: str = NO_DATE
) -> Archive:
    """Write an archive of ``pages`` to the shared folder.

    Only digests are grouped; the payloads move once, to be stored once. A
    digest under which payloads of different length or SHA-1 meet stops the job.
    """
    spark = pages.sparkSession
    body = pages.select(
        F.col(key).cast("long").alias("key"),
        F.col(url).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    rows = settle(
        body.select("key", "url", F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size")),
        "digests",
    )
    shared = rows.groupBy("digest").agg(
        F.max("key").alias("owner"),
        F.count("*").alias("n"),
        (F.min("size") == F.max("size")).alias("same_size"),
        (F.min("sha1") == F.max("sha1")).alias("same_sha1"),
        F.max("size").alias("bytes"),
    )
    sure = F.when(F.col("same_size") & F.col("same_sha1"), F.col("owner")).otherwise(
        F.raise_error(F.lit("one digest stands for different payloads")).cast("long")
    )
    owners = shared.filter((F.col("n") > 1) & (F.col("bytes") >= least)).select("digest", sure.alias("owner"))
    typed = rows.join(owners, "digest", "left").withColumn(
        "refers", F.when(F.col("owner").isNotNull() & ~F.col("key").eqNullSafe(F.col("owner")), F.col("owner"))
    )
    contents = body.select(F.sha2("payload", 256).alias("digest"), "payload").dropDuplicates(["digest"])
    target = new_path(spark, "contents")
    contents.write.option("compression", "zstd").parquet(target)
    return Archive(settle(_heads(typed, date), "heads"), spark.read.schema(contents.schema).parquet(target))


def restore(store: Archive) -> DataFrame:
    """All records as the bytes they had: ``(record)``. A payload that its digest does not fit stops the job."""
    sure = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary")
    )
    contents = store.contents.select("digest", sure.alias("payload"))
    end = F.encode(F.lit(GAP), "UTF-8")
    responses = store.heads.filter("stored").join(contents, "digest", "left")
    lost = F.raise_error(F.concat(F.lit("no payload for "), F.col("digest"))).cast("binary")
    responses = responses.select(F.concat("head", F.coalesce("payload", lost), end).alias("record"))
    return responses.union(store.heads.filter("not stored").select(F.concat("head", end).alias("record")))


def _field(head: str, name: str, pattern: str = "[^\\r\\n]*") -> Column:
    # Lines end at line feeds only: no other separator, which a URL may hold, begins a header.
    found = F.regexp_extract(head, f"(?dm)^{name}: ({pattern})\\r?$", 1)
    return F.when(found != "", found)


def parse(records: DataFrame) -> DataFrame:
    """Records taken apart: ``(key, url, record_type, payload, payload_bytes, payload_digest, refers)``.

    Size and digest are those of the full payload: computed from the bytes of a
    response, which must agree with its headers, and as a revisit's headers state them.
    """
    text = records.select(F.decode("record", "UTF-8").alias("text")).withColumn("head", F.substring_index("text", GAP, 1))
    text = text.withColumn("block", F.expr(f"substring(text, length(head) + {len(GAP) + 1})"))
    text = text.withColumn("http", F.substring_index("block", GAP, 1))
    text = text.withColumn("kind", _field("head", "WARC-Type"))
    body = F.expr(f"substring(block, length(http) + {len(GAP) + 1}, length(block) - length(http) - {2 * len(GAP)})")
    text = text.withColumn("payload", F.when(F.col("kind") == "response", F.encode(body, "UTF-8")))
    size, digest = _field("http", "Content-Length", "\\d+").cast("long"), _field("head", "WARC-Payload-Digest").substr(6, 40)
    named = lambda name: _field("head", name, "<urn:page:-?\\d+>")
    page = lambda c: F.regexp_extract(c, "-?\\d+", 0).cast("long")
    right = (F.octet_length("payload") == size) & (F.sha1("payload") == digest)
    return text.select(
        page(named("WARC-Record-ID")).alias("key"),
        _field("head", "WARC-Target-URI").alias("url"),
        F.col("kind").alias("record_type"),
        "payload",
        F.when(F.col("payload").isNull() | right, size)
        .otherwise(F.raise_error(F.lit("a record's payload does not fit its headers")).cast("long"))
        .alias("payload_bytes"),
        digest.alias("payload_digest"),
        page(named("WARC-Refers-To")).alias("refers"),
    )
