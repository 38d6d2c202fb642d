"""WARC archives: writing, reading, and resolving revisits of equal payloads."""

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from blocklens.functions.scale import checkpointed, fits_broadcast
from blocklens.llm.words import spread_join

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"
DATE = "1970-01-01T00:00:00Z"
ARCHIVE_BYTES = 16 << 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a payload."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", ALPHABET)


def record(page_id: Column, url: Column, payload: Column, digest: Column, length: Column, refers_to: Column) -> Column:
    """One record without its closing blank lines: response with payload, or revisit (refers_to not null) without."""
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"))
    body = F.when(refers_to.isNull(), payload).otherwise("")
    fields = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(refers_to.isNull(), "response").otherwise("revisit")),
        F.concat(F.lit(f"WARC-Record-ID: <{ID_PREFIX}"), page_id.cast("string"), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(refers_to.isNotNull(), F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <{ID_PREFIX}"), refers_to.cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.octet_length(body)).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *fields), F.lit("\r\n\r\n"), http, body)


def write_archives(records: DataFrame, path: str, sizes: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write records (one column) as gzipped archives of about ``archive_bytes`` each.

    ``sizes`` has the bytes of each payload; their mean and the bound tell the records per file.

    Spark's text writer ends each row with the two line ends that close a record and commits
    whole files only, so any file system works and a lost executor leaves nothing behind.
    """
    per_file = max(1, int(archive_bytes // (512 + (sizes.agg(F.avg(sizes.columns[0])).first()[0] or 0))))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(chunks, file: str = ""):
    """Records (headers with lower-case names, block) of an archive, from its bytes; fails on a damaged one."""
    data = memoryview(chunks)
    at = 0
    while at < len(data):
        end = chunks.find(b"\r\n\r\n", at)
        if end < 0 or not bytes(data[at : at + 5]) == b"WARC/":
            raise ValueError(f"no WARC record at byte {at} of {file}")
        lines = bytes(data[at:end]).decode().split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:])}
        start = end + 4
        stop = start + int(headers["content-length"])
        if bytes(data[stop : stop + 4]) != b"\r\n\r\n":
            raise ValueError(f"a record at byte {at} of {file} does not end where its length says")
        yield headers, bytes(data[start:stop])
        at = stop + 4


def unpacked(content: bytes) -> bytes:
    """Bytes of a gzipped archive (one member or many), or of a plain one."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        tool = zlib.decompressobj(31)
        out.append(tool.decompress(content))
        out.append(tool.flush())
        content = tool.unused_data
    return b"".join(out)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every archive in a folder; they are read whole and should have about ``ARCHIVE_BYTES``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def read_records(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row per record: page_id, record_type, url, refers_to, payload_bytes, payload_digest, and the payload if asked for.

    Bytes and digest are those of the full payload: worked out anew for a response (another
    stated digest is an error), as its headers state them for a revisit, whose payload is
    null.
    """
    return records_of(archives(spark, path), payload).drop("archive", "place", "to", "bytes")


def records_of(files: DataFrame, payload: bool = False) -> DataFrame:
    """The records of ``files`` (path, content) as in ``read_records``, each with its archive and its place there.

    Where ``files`` have ``flags``, an array of (place, to, bytes), a record's own are returned
    as to and bytes, else null.
    """
    schema = _parse_datatype_string(
        "page_id long, record_type string, url string, refers_to long, payload_bytes long, payload_digest string, archive string, place long, to long, bytes long"
        + ", payload binary" * payload
    )
    types = to_arrow_schema(schema)
    flagged = "flags" in files.columns

    def number(value):
        return int(value[len(ID_PREFIX) + 1 : -1]) if value else None

    def row(headers, block, file, place, flag):
        http, body = block.split(b"\r\n\r\n", 1)
        digest, size = headers["warc-payload-digest"].removeprefix("sha1:"), len(body)
        if headers["warc-type"] == "revisit":
            size, body = int(http.lower().split(b"content-length:", 1)[1].split(b"\r\n", 1)[0]), None
        elif base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
            raise ValueError(f"payload of {headers['warc-record-id']} differs from its digest")
        found = number(headers["warc-record-id"]), headers["warc-type"], headers["warc-target-uri"], number(headers.get("warc-refers-to")), size, digest
        return found + (file, place, *flag) + (body,) * payload

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), types)], schema=types)

    def run(batches):
        for batch in batches:
            told = batch.column("flags") if flagged else [None] * batch.num_rows
            for content, file, flags in zip(batch.column("content"), batch.column("path").to_pylist(), told):
                own = {f["place"]: (f["to"], f["bytes"]) for f in (flags.as_py() if flagged else None) or []}
                rows, held = [], 0
                for place, (headers, block) in enumerate(parse(unpacked(content.as_py()), file)):
                    rows.append(row(headers, block, file, place, own.get(place, (None, None))))
                    held += len(block)
                    if held > 4 << 20:
                        yield table(rows)
                        rows, held = [], 0
                if rows:
                    yield table(rows)

    return files.mapInArrow(run, schema)


def archive(pages: DataFrame, path: str, id_col="page_id", url="url", html="html") -> None:
    """Write every page as a response record; the payload is the html in UTF-8, null is empty. Null ids are an error."""
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("id", F.when(F.col("id").isNotNull(), F.col("id")).otherwise(F.raise_error(F.lit("a page has no id"))))
    made = record(F.col("id"), F.col("url"), F.col("payload"), payload_digest(F.col("payload")), F.octet_length("payload"), F.lit(None).cast("long"))
    write_archives(rows.select(made.alias("record")), path, rows.select(F.octet_length("payload").alias("n")))


def resolve(spark: SparkSession, source: str, target: str, min_bytes: int = 0) -> None:
    """Read archives and write them anew with revisits: ``source`` to ``target``.

    Headers are shuffled by payload digest. Of records with equal payloads of at least
    ``min_bytes`` bytes the one with the smallest page id stays a response, every other one
    becomes a revisit that refers to it, with fresh headers and no payload. Revisit records in
    the source are joined to the original response with their digest and get that one's place;
    one without an original is an error.

    A record is known by its archive and its place there, so page ids may repeat: every record
    is written once, ids with other payloads stay responses, and of equal records of one id
    the first by archive and place is the original. What becomes of a record is sent to its
    archive as a flag; payloads stay where they are read (flags of more than the broadcast
    bound are joined by shuffling the packed archives instead).
    """
    headers = checkpointed(records_of(archives(spark, source)).select("archive", "place", "page_id", "record_type", F.col("payload_digest").alias("stated"), "payload_bytes"))
    kept = F.when(F.col("record_type") == "response", F.struct("page_id", "archive", "place", "payload_bytes"))
    groups = headers.groupBy("stated").agg(F.min(kept).alias("original"), F.count(F.lit(1)).alias("_n"))
    repeated = checkpointed(groups.filter("_n > 1 OR original IS NULL"))
    found = spread_join(headers, repeated, "stated")
    again = found.filter("original IS NULL OR original.archive <> archive OR original.place <> place")
    again = again.filter(F.col("original").isNull() | (F.col("record_type") == "revisit") | (F.col("payload_bytes") >= min_bytes))
    original = F.when(F.col("original").isNotNull(), F.col("original.page_id")).otherwise(F.raise_error(F.lit("a revisit has no original response")))
    flag = F.struct("place", original.alias("to"), F.col("original.payload_bytes").alias("bytes"))
    # As many flags as an archive has records.
    flags = checkpointed(again.groupBy(F.col("archive").alias("path")).agg(F.collect_list(flag).alias("flags")))
    files = archives(spark, source).join(F.broadcast(flags) if fits_broadcast(flags) else flags, "path", "left")
    rows = records_of(files, payload=True)
    made = record(F.col("page_id"), F.col("url"), F.col("payload").cast("string"), F.col("payload_digest"), F.coalesce("bytes", "payload_bytes"), F.col("to"))
    write_archives(rows.select(made.alias("record")), target, headers.select("payload_bytes"))
