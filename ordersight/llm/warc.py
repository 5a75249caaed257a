"""WARC archives with revisit resolution (operator 6).

``write_archives`` puts one WARC/1.1 record per page into gzip files written by
Spark's own text writer (task commit protocol, any file system; the writer's
line separator is the CRLF CRLF that ends a WARC record).  Payload digests are
shuffled first: of records with equal payloads of at least ``min_bytes`` bytes
the one with the smallest page id becomes the response, the others become
revisit records without payload.  Files are bounded in bytes: payloads are written by
size class, so many records to a file that it holds ``FILE_BYTES`` at most (a
larger record has a file of its own).  ``read_archives`` streams records out of a
file, one at a time, by Content-Length.  ``resolve`` joins the revisit headers
to the original responses by payload digest.

Defined cases: a null payload is empty; payloads under ``min_bytes`` are always
responses; rows that repeat the response's own page id are responses too; a row
with null page id is a revisit if an equal payload has an id, else a response;
a null URL leaves the header out, CR and LF in one are dropped; an empty table
writes no record; other columns play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordersight.llm.common import col, scratch_path, table, written

CRLF = "\r\n"
MIN_BYTES = 100
#: Uncompressed bytes of a file, about; Spark hands a file to Python as one value.
FILE_BYTES = 256 << 20
#: Upper bounds of the payload size classes; the last class has none.
CLASSES = (1 << 16, 1 << 22, 1 << 26)
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ("page_id bigint, record_id string, record_type string, target_uri string, payload_digest string, "
          "payload_bytes bigint, refers_to_record string, intact boolean")


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("-")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
                    F.lit(">"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_bytes: int = MIN_BYTES, date: str = DATE,
                   file_bytes: int = FILE_BYTES, classes: tuple[int, ...] = CLASSES) -> None:
    """Write ``pages`` as deduplicated archives under ``path`` (a new folder)."""
    rows = pages.select(col(id_col).cast("bigint").alias("page_id"), col(url_col).alias("url"),
                        F.coalesce(col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload"), 256))
    rows = rows.withColumn("n", F.octet_length("payload").cast("bigint"))
    heads = rows.where(F.col("n") >= min_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.count("*").alias("times"))
    # Only payloads that occur more than once; its file size tells Spark whether a broadcast fits.
    originals = written(heads.where((F.col("times") > 1) & F.col("first_id").isNotNull())
                        .select("digest", "first_id"), "warc-originals")
    rows = rows.join(originals, "digest", "left")
    is_revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF
                          + "Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))

    def header(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit(""))

    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        F.when(is_revisit, "WARC-Type: revisit" + CRLF).otherwise("WARC-Type: response" + CRLF),
        header("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        F.lit(f"WARC-Date: {date}" + CRLF),
        header("WARC-Target-URI", F.regexp_replace("url", "[\r\n]+", "")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        header("X-Page-Id", F.col("page_id").cast("string")),
        F.when(is_revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}" + CRLF),
                                    header("WARC-Refers-To", _record_id(F.col("first_id"), F.col("digest")))))
        .otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: "),
        F.octet_length(F.when(is_revisit, http).otherwise(F.concat(http, F.col("payload")))).cast("string"),
        F.lit(CRLF + CRLF))
    value = F.concat(head, http, F.when(is_revisit, "").otherwise(F.col("payload")))
    at = sum(((F.col("n") > c).cast("int") for c in classes), F.lit(0))
    held = pages.agg(*[F.count_if(size > low).alias(f"c{k}") for size in [F.octet_length(col(payload_col))]
                       for k, low in enumerate((-1, *classes))]).first()
    above = [*list(held)[1:], 0]
    for k, bound in enumerate((*classes, None)):
        if k and held[k] == above[k]:
            continue  # no payload of this class; the first one is written in any case, nulls and empty tables too
        part = rows if above[0] == 0 else rows.where(at == k)
        (part.select(value.alias("value")).write.mode("append").option("lineSep", CRLF + CRLF)
         .option("compression", "gzip").option("maxRecordsPerFile", max(1, file_bytes // bound) if bound else 1).text(path))


def parse_records(stream):
    """Records of one decompressed archive as dicts, payload included; one record in memory."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        http, _, payload = block.partition(b"\r\n\r\n")
        yield {"fields": fields, "http": http, "payload": payload}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``; ``intact``: a response's payload has the stated digest."""

    def read(batches):
        import gzip
        import hashlib
        import io

        import pandas as pd

        names = [c.split()[0] for c in RECORD.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                rows = []
                with gzip.GzipFile(fileobj=io.BytesIO(content)) as raw:
                    for r in parse_records(io.BufferedReader(raw, 1 << 20)):
                        f, kind = r["fields"], r["fields"]["warc-type"]
                        digest = f["warc-payload-digest"].removeprefix("sha256:")
                        whole = kind == "response"
                        found = hashlib.sha256(r["payload"]).hexdigest() if whole else digest
                        page = f.get("x-page-id")
                        rows.append((int(page) if page is not None else None, f["warc-record-id"], kind,
                                     f.get("warc-target-uri"), digest, len(r["payload"]) if whole else None,
                                     f.get("warc-refers-to"), found == digest))
                        if len(rows) == 4096:
                            yield pd.DataFrame(rows, columns=names, dtype=object)
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names, dtype=object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(read, RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """Join revisit records to their original responses by payload digest."""
    responses = records.where("record_type = 'response'")
    originals = responses.where("page_id IS NOT NULL").groupBy("payload_digest").agg(
        F.min("page_id").alias("o_page"), F.first("payload_bytes").alias("o_bytes"))
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes")
    joined = revisits.join(originals, "payload_digest", "left")
    keep = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "intact"]
    return (responses.withColumn("refers_to", F.lit(None).cast("bigint")).select(*keep).unionByName(
        joined.withColumn("payload_bytes", F.col("o_bytes"))
        .withColumn("refers_to", F.col("o_page"))
        .withColumn("intact", F.col("intact") & F.col("o_page").isNotNull()).select(*keep)))


def op6_warc(spark, sf_dir):
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    records = written(read_archives(spark, path), "warc-headers")
    return resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest)
                     ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""
