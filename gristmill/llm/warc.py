"""A content-addressed WARC archive.

Payload bytes are stored once under their SHA-256; the exact header of every
record is kept in a second table, and where a record only refers to an equal
payload also the header of that short record. Payloads are checked against the
digest they are filed under, and measured, once each as they are read; records
get digests and lengths through a narrow join, and the bytes, where asked for, by
the same join (`record_bytes`).

Defined results: a null payload is empty; a null page_id counts as smaller than
any other; rows that repeat the largest page_id of a payload are all responses;
an empty table gives an empty archive; other columns of the pages aren't archived.
Characters that an address can't hold (controls, white space, quotes, anything
but ASCII) stand percent-encoded in the header. There is no HTTP head and no time
of capture in the pages: records hold the payload alone, and `date` for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, new_path

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Runs of characters that stand in an address as they are, and of others.
SAFE = r"[!#-;=?-\[\]_a-z~]+"
RUNS = rf"{SAFE}|[^!#-;=?-\[\]_a-z~]+"


def base32(hex_digest: Column) -> Column:
    """Base32 of a hex text whose length is a multiple of 5: five digits make four letters."""
    fives = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substr(hex_digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    letter = lambda v, by: F.substr(F.lit(ALPHABET), F.shiftright(v, by).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.array_join(F.transform(fives, lambda v: F.concat(*(letter(v, by) for by in (15, 10, 5, 0)))), "")


def encoded(url: Column) -> Column:
    """An address without characters that could end a header line."""
    runs = F.regexp_extract_all(url, F.lit(f"({RUNS})"), F.lit(1))
    quoted = F.transform(runs, lambda r: F.when(r.rlike(f"^{SAFE}$"), r).otherwise(F.replace(F.url_encode(r), F.lit("+"), F.lit("%20"))))
    return F.when(url.rlike(f"^{SAFE}$"), url).otherwise(F.array_join(quoted, ""))


def _record_id(page_id: Column, mark: Column) -> Column:
    """Names the page, and by a hash the address and payload, so that rows that repeat a page_id differ."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), F.lower(F.hex(mark)), F.lit(">"))


def write_archive(pages: DataFrame, path: str | None = None, min_revisit_bytes: int = 0, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z") -> str:
    """Writes headers and payloads below `path` (default: a new folder in the shared one); returns it."""
    spark = pages.sparkSession
    scratch = Scratch(spark)
    path = path or new_path(spark, "warc")
    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"),
        F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit("").cast("binary")).alias("payload"),
    )
    rows = rows.withColumns({"sha256": F.sha2("payload", 256), "sha1": base32(F.sha1("payload")), "length": F.octet_length("payload").cast("long")})
    rows = rows.withColumn("mark", F.xxhash64("url", "sha256"))
    payloads = rows.select("sha256", "payload")
    shared = rows.filter(F.col("length") >= min_revisit_bytes).groupBy("sha256").agg(F.max(F.struct("page_id", "mark")).alias("owner"), F.count("*").alias("n")).filter("n > 1")
    rows = rows.drop("payload").join(scratch.written(shared.select("sha256", "owner"), "payload-owners"), "sha256", "left")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner.page_id"))

    def header(kind: str, length: Column, *more: Column) -> Column:
        lines = [
            F.lit("WARC/1.1"),
            F.lit(f"WARC-Type: {kind}"),
            F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("mark"))),
            F.concat(F.lit("WARC-Target-URI: "), encoded(F.col("url"))),
            F.lit(f"WARC-Date: {date}"),
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
            *more,
            F.lit("Content-Type: text/html; charset=utf-8"),
            F.concat(F.lit("Content-Length: "), length.cast("string")),
        ]
        return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2))

    refers = F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("owner.page_id"), F.col("owner.mark")))
    profile = F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    short = F.when(revisit, header("revisit", F.lit(0), profile, refers))
    rows.select("page_id", "sha256", header("response", F.col("length")).alias("header"), short.alias("revisit")).write.option("compression", "zstd").parquet(f"{path}/headers")
    # any row with a digest has its payload: no join, and the bytes are shuffled once
    payloads.dropDuplicates(["sha256"]).write.option("compression", "zstd").parquet(f"{path}/payloads")
    scratch.drop()
    return path


def _field(header: Column, name: str) -> Column:
    """The value of a header line; lines end with CR LF and with nothing else."""
    return F.nullif(F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record with its header fields, its payload, and the payload's length and digest as measured on reading."""
    headers = spark.read.schema("page_id long, sha256 string, header string, revisit string").parquet(f"{path}/headers")
    payloads = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    damaged = F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256")))
    sound = F.when(F.sha2("payload", 256) == F.col("sha256"), F.octet_length("payload").cast("long")).otherwise(damaged.cast("long"))
    payloads = payloads.select("sha256", "payload", sound.alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))
    archived = F.coalesce("revisit", "header")
    return headers.join(payloads, "sha256").select(
        "page_id", "header", "revisit", "payload", "payload_bytes", "payload_digest", _field(archived, "WARC-Type").alias("record_type"),
        _field(archived, "WARC-Target-URI").alias("url"), _field(archived, "WARC-Payload-Digest").alias("stated_digest"), _field(archived, "WARC-Refers-To").alias("refers_to_record"),
    )


def referred_page(refers_to_record: Column | str) -> Column:
    """The page_id that a record's name holds."""
    return F.regexp_extract(refers_to_record, r"^<urn:page:(-?\d+):[0-9a-f]+>$", 1).try_cast("long")


def record_bytes(records: DataFrame) -> DataFrame:
    """Adds the original record: its header, the payload, and two line ends, as it stood before payloads were shared."""
    return records.withColumn("record", F.concat(F.col("header").cast("binary"), F.col("payload"), F.lit(CRLF * 2).cast("binary")))
