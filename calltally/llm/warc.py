"""A content-addressed web archive.

`store` keeps each payload once, under its SHA-256, and apart from it the exact header block of every
record. `export` joins the two into WARC files: the first page (smallest id) with a payload is its
response record, further pages are revisit records that refer to it; payloads under `smallest` bytes
are always responses and stay with their header, so that no payload is wanted by many records. `read`
takes such files apart again and joins revisits to what they refer to.

Payloads are moved once, to the record that owns them: what is stored is laid out by that record's key
(a bucketed table of this session over plain Parquet files), and the join of `export` takes it as it
lies.

Records are written and split by Spark's text source, so files may be of any size. A record ends with
two line ends and the next begins with the version line; a payload that holds this very sequence is
stored as base64 and marked so, which makes the split exact for every payload. Compressed files can't be split: `records_per_file` bounds them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calltally.session import cut_lineage, scratch_path

VERSION = "WARC/1.1\r\n"
EOL = "\r\n"
GAP = EOL + EOL
MARK = GAP + VERSION
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PLAIN, CODED = HTTP + EOL, HTTP + "Content-Encoding: base64\r\n\r\n"


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(EOL))


def _needs_code(payload: Column) -> Column:
    """Whether a split would cut the payload, or lose the end of it."""
    return F.contains(F.concat(payload, F.lit(GAP)), F.lit(MARK)) | F.contains(F.concat(F.lit(GAP), payload), F.lit(MARK))


def store(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html",
          smallest: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write `folder`/payloads (key, digest, payload) and `folder`/headers (key, kind, digest, header, inline).

    Null payloads are empty, null urls too; line ends in a url are percent-coded. Rows with a null key
    are left out; repeated rows are repeated records. A digest that stands for payloads of different
    length or checksum stops the job.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.where(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    small = rows.select(
        "key", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"),
        F.xxhash64("payload").alias("check"), _needs_code(F.col("payload")).alias("coded"),
        F.when(F.octet_length("payload") < smallest, F.col("payload")).alias("inline"),
    )
    path = f"{folder}/rows"
    small.write.parquet(path)
    small = spark.read.parquet(path)
    owners = small.groupBy("digest").agg(
        F.min("key").alias("first"), F.min("check").alias("c0"), F.max("check").alias("c1"),
        F.min("bytes").alias("b0"), F.max("bytes").alias("b1"),
    ).select(
        "digest", F.when((F.col("c0") == F.col("c1")) & (F.col("b0") == F.col("b1")), F.col("first"))
        .otherwise(F.raise_error(F.concat(F.lit("one digest, different payloads: "), F.col("digest")))).alias("first"),
    )
    owners = cut_lineage(owners)  # so that the join can split a digest with very many records
    described = small.join(owners, "digest").withColumn(
        "kind", F.when((F.col("bytes") < smallest) | (F.col("key") == F.col("first")), "response").otherwise("revisit")
    )
    size = (
        F.when(F.col("kind") == "revisit", F.lit(len(PLAIN)))
        .when(F.col("coded"), F.lit(len(CODED)) + F.ceil(F.col("bytes") / 3) * 4)
        .otherwise(F.lit(len(PLAIN)) + F.col("bytes"))
    )
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit(VERSION), _line("WARC-Type", F.col("kind")), _line("WARC-Record-ID", _record_id(F.col("key"))),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", target),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("kind") == "revisit", F.concat(
            _line("WARC-Refers-To", _record_id(F.col("first"))),
            _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        )).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", size), F.lit(EOL),
    )
    described.select("key", "kind", "digest", "coded", "inline", header.alias("header")).write.parquet(f"{folder}/headers")
    large = rows.where(F.octet_length("payload") >= smallest).select("key", "digest", "payload")
    kept = _owned(large, owners.select(F.col("first").alias("owner"), F.col("digest").alias("d")))
    kept = kept.select("key", "digest", "payload").dropDuplicates(["key", "digest"])
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept.write.option("compression", "zstd").option("path", f"{folder}/payloads").bucketBy(buckets, "key").sortBy(
        "key"
    ).saveAsTable(_table_name(folder))


def _owned(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Rows (key, digest, ..) met with (owner, d, ..), dealt by key alone: no key has many rows, a digest may."""
    same = F.coalesce(F.col("digest") == F.col("d"), F.lit(False))
    return rows.join(owners, (F.col("key") == F.col("owner")) & same)


def _table_name(folder: str) -> str:
    return "payloads_" + hashlib.sha256(folder.encode()).hexdigest()[:16]


def reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """(key, record): each record as it was, its header joined to its payload."""
    headers = spark.read.parquet(f"{folder}/headers")
    laid_out = spark.catalog.tableExists(_table_name(folder))
    payloads = spark.table(_table_name(folder)) if laid_out else spark.read.parquet(f"{folder}/payloads")

    def record(payload: str) -> Column:
        return F.concat(
            "header",
            F.when(F.col("coded"), F.concat(F.lit(CODED), _base64(payload))).otherwise(F.concat(F.lit(PLAIN), payload)),
        ).alias("record")

    response = F.col("kind") == "response"
    large = _owned(
        headers.where(response & F.col("inline").isNull()),
        payloads.select(F.col("key").alias("owner"), F.col("digest").alias("d"), "payload"),
    )
    return (
        large.select("key", record("payload"))
        .unionAll(headers.where(response & F.col("inline").isNotNull()).select("key", record("inline")))
        .unionAll(headers.where(~response).select("key", F.concat("header", F.lit(PLAIN)).alias("record")))
    )


def _base64(name: str) -> Column:
    """Base64 in one line."""
    return F.regexp_replace(F.base64(F.col(name).cast("binary")), "[\r\n]", "")


def export(spark: SparkSession, folder: str, records_per_file: int = 20_000) -> None:
    """Write `folder`/warc from what `store` wrote."""
    (
        reconstruct(spark, folder).select("record").write.option("lineSep", GAP).option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file).text(f"{folder}/warc")
    )


def _field(header: Column, name: str) -> Column:
    return F.regexp_extract(header, rf"(?:^|\r\n){name}: ([^\r]*)\r\n", 1)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page, kind, refers, url, digest, payload) of every record of the WARC files at `path`.

    A record whose content is shorter than its header says, or whose payload hasn't the digest it
    claims, stops the job. Revisits have a null payload.
    """
    raw = spark.read.option("lineSep", MARK).text(path).where("value <> ''")
    whole = F.when(F.startswith("value", F.lit(VERSION)), F.substr("value", F.lit(len(VERSION) + 1))).otherwise(F.col("value"))
    parts = raw.select(whole.alias("value")).withColumn("at", F.locate(GAP, F.col("value")))
    named = parts.select(
        F.substr("value", F.lit(1), F.col("at") + 1).alias("header"),
        F.substr("value", F.col("at") + 4).cast("binary").alias("rest"),
    )
    length = _field(F.col("header"), "Content-Length").cast("int")
    content = F.when(F.octet_length("rest") >= length, F.substr("rest", F.lit(1), length)).otherwise(
        F.raise_error(F.concat(F.lit("cut record: "), F.col("header"))).cast("binary")
    )
    known = named.select("header", content.cast("string").alias("content")).select(
        F.regexp_extract("header", r"WARC-Record-ID: <urn:page:([^>]*)>", 1).alias("page"),
        _field(F.col("header"), "WARC-Type").alias("kind"),
        F.regexp_extract("header", r"WARC-Refers-To: <urn:page:([^>]*)>", 1).alias("refers"),
        _field(F.col("header"), "WARC-Target-URI").alias("url"),
        F.regexp_extract("header", r"WARC-Payload-Digest: sha256:([0-9a-f]{64})", 1).alias("digest"),
        F.when(F.startswith("content", F.lit(CODED)), F.unbase64(F.substr("content", F.lit(len(CODED) + 1))).cast("string"))
        .otherwise(F.substr("content", F.lit(len(PLAIN) + 1))).alias("body"),
    )
    true = F.sha2(F.col("body").cast("binary"), 256) == F.col("digest")
    payload = F.when(F.col("kind") == "response", F.when(true, F.col("body")).otherwise(
        F.raise_error(F.concat(F.lit("digest doesn't fit: "), F.col("page")))
    ))
    return known.select("page", "kind", F.nullif("refers", F.lit("")).alias("refers"), "url", "digest", payload.alias("payload"))


def resolved(records: DataFrame) -> DataFrame:
    """(page, kind, refers, url, bytes, digest): revisits with the measures of the payload they refer to."""
    measured = records.select(
        "page", "kind", "refers", "url", F.octet_length("payload").cast("long").alias("bytes"),
        F.sha2(F.col("payload").cast("binary"), 256).alias("digest"),
    )
    own = measured.where("kind = 'response'")
    target = cut_lineage(own.groupBy(F.col("page").alias("refers")).agg(F.min(F.struct("bytes", "digest")).alias("t")))
    revisits = measured.where("kind = 'revisit'").select("page", "kind", "refers", "url").join(target, "refers")
    return own.select("page", "kind", "refers", "url", "bytes", "digest").unionAll(
        revisits.select("page", "kind", "refers", "url", "t.bytes", "t.digest")
    )


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", smallest: int = 100) -> DataFrame:
    """Store, export and read back; what `resolved` gives."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    store(pages, folder, key, url, html, smallest)
    export(spark, folder)
    return resolved(read(spark, f"{folder}/warc"))
