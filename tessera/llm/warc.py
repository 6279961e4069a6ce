"""WARC archives with resolved revisits.

``resolve_revisits`` shuffles record headers by payload digest, pre-aggregated, and
keeps the digests that more than one record has; records whose digest is kept and
that are not its original become revisits. The kept digests are counted: up to
``BROADCAST_ROWS`` go to the records, whose payloads stay where they are; more are
joined by a shuffle on the digest, in which payloads travel once and which adaptive
execution splits where a third of all records share a digest.

``write_archives`` writes WARC 1.1, a gzip member for every record, so a record can
be read alone from its offset. A task gathers members up to ``FILE_BYTES`` (or one
longer record) and each such run is a file of Spark's text writer, on any file
system that Spark writes, committed by Spark's own protocol. Files end with the
writer's line separator, which is an empty gzip member. ``read_archives`` parses them back in
a stream, by Content-Length, and ``join_revisits`` joins revisit records to the
responses they name by record id and declared digest.

Defined results: null html is the empty payload; a null url or page_id leaves its
header out; equal payloads under one page_id are responses each if that is the
largest page_id, unequal ones are records of their own with their own ids, and rows
are never dropped; records without page_id revisit the largest one there is, and are
responses where none has an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.rows import schema_of, slices
from tessera.session import Scratch, table

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Payloads of fewer bytes are stored whole even if others equal them.
MIN_BYTES = 0
#: Compressed bytes of an archive at most, unless a single record is longer.
FILE_BYTES = 64 << 20
#: Shared digests (some 60 bytes each) that are broadcast at most.
BROADCAST_ROWS = 1 << 18
#: An empty gzip member, as Latin-1.
EMPTY_MEMBER = "\x1f\x8b\x08" + "\0" * 6 + "\x03\x03" + "\0" * 9
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"

HEADERS = "page_id string, record_id string, record_type string, url string, payload_bytes long, declared_digest string, payload_digest string, refers_to_id string"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four base32 letters."""
    digest = F.sha1(payload.cast("binary"))
    letters = []
    for at in range(0, 40, 5):
        bits = F.conv(F.substring(digest, at + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def record_id(page_id: Column, digest: Column) -> Column:
    """A stable urn:uuid for a payload of a page."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("-none")), F.lit(" "), digest))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def with_payload(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest of every page."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")).select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))


def resolve_revisits(records: DataFrame, scratch: Scratch, min_bytes: int = MIN_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``records`` with record_type and refers_to (page_id of the response, else null)."""
    shared = (
        records.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1 AND original IS NOT NULL")
        .select("payload_digest", "original")
    )
    shared = scratch.save(shared, "shared")
    if shared.count() <= broadcast_rows:
        shared = F.broadcast(shared)
    revisit = F.col("original").isNotNull() & (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("original"))
    return records.join(shared, "payload_digest", "left").select(*records.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("original")).alias("refers_to"))


def header(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; line ends inside a value are percent-encoded."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def write_archives(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Write resolved records as gzipped WARC files under ``path``."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    payload = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        header("WARC-Type", F.col("record_type")),
        header("WARC-Record-ID", record_id(F.col("page_id"), F.col("payload_digest"))),
        header("WARC-Date", F.lit(date)),
        header("WARC-Target-URI", F.col("url")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        header("WARC-Refers-To", F.when(F.col("refers_to").isNotNull(), record_id(F.col("refers_to"), F.col("payload_digest")))),
        header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        header("WARC-Page-ID", F.col("page_id")),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", F.octet_length("http") + F.octet_length("body")),
        F.lit(CRLF),
        F.col("http"),
    )
    out = records.withColumn("http", http).withColumn("body", payload).select(head.cast("binary").alias("head"), F.col("body").cast("binary").alias("body"))

    def run(batches):
        import gzip

        import pyarrow as pa

        held, size = [], 0
        for batch in slices(batches):
            for head, body in zip(batch.column(0), batch.column(1)):
                member = gzip.compress(head.as_py() + body.as_py() + b"\r\n\r\n", 6, mtime=0)
                if held and size + len(member) > file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                    held, size = [], 0
                held.append(member)
                size += len(member)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    runs = out.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    writer = runs.write.mode("overwrite").option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER)
    writer.option("maxRecordsPerFile", 1).text(path)


def parse_archive(content: bytes):
    """Records of one gzipped archive, one at a time, as rows of HEADERS."""
    import base64
    import gzip
    import hashlib
    import io

    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not at the start of a record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "surrogatepass").partition(": ")
            fields[name.lower()] = value
        block = stream.read(int(fields["content-length"]))
        http, _, payload = block.partition(b"\r\n\r\n")
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("record does not end with two line ends")
        whole = fields["warc-type"] == "response"
        yield (
            fields.get("warc-page-id"),
            fields["warc-record-id"],
            fields["warc-type"],
            fields.get("warc-target-uri"),
            len(payload) if whole else None,
            fields["warc-payload-digest"].removeprefix("sha1:"),
            base64.b32encode(hashlib.sha1(payload).digest()).decode() if whole else None,
            fields.get("warc-refers-to"),
        )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row of HEADERS for every record under ``path``; payload columns are null for revisits."""
    schema = schema_of(HEADERS)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for n in range(batch.num_rows):
                rows = []
                for row in parse_archive(batch.column(0)[n].as_buffer().to_pybytes()):
                    rows.append(row)
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), arrow)], schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), arrow)], schema=arrow)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, schema)


def join_revisits(headers: DataFrame, scratch: Scratch) -> DataFrame:
    """Headers with the payload size and digest of the response behind every revisit, and refers_to."""
    headers = scratch.save(headers, "headers")
    named = headers.filter("refers_to_id IS NOT NULL").select(F.col("refers_to_id").alias("target"), F.col("declared_digest").alias("target_digest")).distinct()
    responses = headers.filter("record_type = 'response'").select(F.col("record_id").alias("target"), F.col("declared_digest").alias("target_digest"), F.struct(F.col("page_id").alias("page"), "payload_bytes", "payload_digest").alias("found"))
    target = scratch.save(responses.join(named, ["target", "target_digest"], "left_semi").groupBy("target", "target_digest").agg(F.min("found").alias("found")), "targets")
    joined = headers.join(target, (F.col("refers_to_id") == F.col("target")) & (F.col("declared_digest") == F.col("target_digest")), "left")
    return joined.select(
        "page_id",
        "url",
        "record_type",
        F.coalesce("payload_bytes", "found.payload_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "found.payload_digest").alias("payload_digest"),
        "declared_digest",
        F.col("found.page").alias("refers_to"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    write_archives(resolve_revisits(with_payload(pages), scratch), scratch.at("archives"))
    found = join_revisits(read_archives(spark, scratch.at("archives")), scratch)
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


_DIGITS = " || ".join(f"substr('{ALPHABET}', ((CAST('0x' || substr(h, {at + 1}, 5) AS INTEGER) >> {s}) & 31) + 1, 1)" for at in range(0, 40, 5) for s in (15, 10, 5, 0))
SQL = {
    "op9_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_DIGITS} AS payload_digest, max(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = m THEN NULL ELSE m END AS refers_to FROM q"""
}
QUERIES = {"op9_warc": op9_warc}
