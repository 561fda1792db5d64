"""A content-addressed web archive on plain tables.

``write_archive`` keeps each payload's bytes once, under their SHA-256, and a table
of exact record headers (WARC and HTTP) beside them.  ``read_records`` joins the two
and gives back whole records, whose digests and lengths are checked on the way.
``export_warc`` writes them as ordinary WARC files, one gzip member for each record.

Only digests, lengths and ids are shuffled to find equal payloads.  Payloads that
no other row has are written where they are read; the bytes of others meet once.  A
payload of many records is salted: it goes to one more task for every ``SALT_ROWS`` of them.

Of the records with equal payloads of at least ``least_bytes`` bytes, that with the
largest page_id is a response and the others are revisits of it.

Defined cases: a null html is an empty payload; null ids sort below all others; of
repeated rows with one id and payload one is the response and the others refer to
it; a null url has no target header; line breaks in urls are escaped; ids of any
type come back as they were; very long payloads are kept whole; other columns are not read;
an empty table makes an empty archive.
"""

from __future__ import annotations

import gzip
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .common import shared_dir, small_or_join, stored

LEAST_BYTES = 1000
#: Records of one payload that are joined with it in one task, about.
SALT_ROWS = 2_000
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def _payloads(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("sha256", F.sha2("payload", 256))


def _line(name: str, value) -> F.Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def write_archive(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = DATE) -> None:
    """Write ``path``/payloads (sha256, payload) and ``path``/records (one row per page)."""
    rows = stored(_payloads(pages).select("page_id", "url", "sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n"), F.monotonically_increasing_id().alias("row")), "warc-rows")
    shared = stored(rows.groupBy("sha256").agg(F.count("*").alias("copies"), F.max(F.struct("page_id", "row")).alias("last")).where("copies > 1").withColumn("salts", F.ceil(F.col("copies") / SALT_ROWS)), "warc-shared")
    slim = shared.select("sha256", "salts", F.col("last.page_id").alias("last_id"), F.col("last.row").alias("last_row"))

    alone = small_or_join(_payloads(pages), shared.select("sha256"), "sha256", "left_anti").select("sha256", "payload", F.lit(1).cast("long").alias("salts"))
    copies = small_or_join(_payloads(pages), shared.select("sha256"), "sha256", "left_semi").groupBy("sha256").agg(F.first("payload").alias("payload"))
    copies = small_or_join(copies, shared.select("sha256", "salts"), "sha256", "inner")
    alone.unionByName(copies).write.option("compression", "zstd").parquet(f"{path}/payloads")

    at = small_or_join(rows, slim, "sha256", "left")
    revisit = F.coalesce((F.col("n") >= least_bytes) & (F.col("last_row") != F.col("row")), F.lit(False))
    urn = lambda page, row: F.concat(F.lit("<urn:page:"), F.coalesce(F.concat(F.lit("id="), F.url_encode(page.cast("string"))), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(CRLF),
        _line("WARC-Record-ID", urn(F.col("page_id"), F.col("row"))),
        _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", uri), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _line("WARC-Refers-To", urn(F.col("last_id"), F.col("last_row"))))).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", (F.octet_length("http") + F.when(revisit, 0).otherwise(F.col("n"))).cast("string")),
        F.lit(CRLF),
    )
    salt = F.pmod(F.xxhash64("row"), F.coalesce("salts", F.lit(1))).alias("salt")
    at.withColumn("http", http).select("page_id", "sha256", salt, head.alias("header"), "http").write.option("compression", "zstd").parquet(f"{path}/records")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, header, http, payload, sha256, verified (the stored bytes have their digest)."""
    payloads = spark.read.parquet(f"{path}/payloads").withColumn("verified", F.sha2("payload", 256) == F.col("sha256"))
    salted = payloads.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    return spark.read.parquet(f"{path}/records").join(salted, ["sha256", "salt"]).drop("salt")


def field(header, name: str):
    """The value of a header line, or null."""
    return F.nullif(F.regexp_extract(header, rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


class _Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class _WarcWriter(DataSourceArrowWriter):
    """One file a task under a name of its own, given its final name when the whole write commits."""

    def __init__(self, path: str):
        self.path = path

    def _folder(self):
        from pyarrow import fs

        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def write(self, iterator) -> WriterCommitMessage:
        store, folder = self._folder()
        name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(name + ".part", compression=None) as out:
            for batch in iterator:
                for record in batch.column(0):
                    out.write(gzip.compress(record.as_py(), mtime=0))
        return _Written([name])

    def commit(self, messages: list) -> None:
        store, _ = self._folder()
        for name in (n for m in messages if m for n in m.names):
            store.move(name + ".part", name)

    def abort(self, messages: list) -> None:
        store, _ = self._folder()
        for name in (n for m in messages if m for n in m.names):
            store.delete_file(name + ".part")


class WarcSource(DataSource):
    """``df.write.format("warc")``: rows of one binary column, a record each, as gzip members."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _WarcWriter(self.options["path"])


def export_warc(spark: SparkSession, path: str, out: str) -> None:
    """The archive as WARC files in the folder or URI ``out``, one gzip member for each record; revisit records have no payload."""
    block = F.when(field(F.col("header"), "WARC-Profile").isNull(), F.col("payload")).otherwise(F.lit(b""))
    record = F.concat(F.col("header").cast("binary"), F.col("http").cast("binary"), block, F.lit((CRLF * 2).encode()))
    spark.dataSource.register(WarcSource)
    read_records(spark, path).select(record.alias("record")).write.format("warc").mode("append").save(out)


def archive_pages(pages: DataFrame, path: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write the archive, read it back: page_id, payload_bytes, payload_digest, record_type, refers_to, verified.

    All but page_id come from what is read: the bytes of the joined record and its header.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path, least_bytes)
    got = read_records(spark, path)
    whole = got.select("page_id", "header", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "verified")
    digest = F.substring(field(F.col("header"), "WARC-Payload-Digest"), 6, 40)
    return whole.select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        F.regexp_extract("header", r"\r\nWARC-Type: (\w+)\r\n", 1).alias("record_type"),
        F.url_decode(F.nullif(F.regexp_extract("header", r"\r\nWARC-Refers-To: <urn:page:id=([^:>]*):", 1), F.lit(""))).cast(pages.schema["page_id"].dataType).alias("refers_to"),
        (F.col("verified") & (digest == F.col("payload_digest"))).alias("verified"),
    )


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), q AS (
  SELECT page_id, cast(strlen(h) AS BIGINT) AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS last FROM p
)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to, true AS verified
FROM q
"""
