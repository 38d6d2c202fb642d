import base64
import gzip
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from blocklens.llm import warc


def folder(spark, tmp_path_factory):
    return str(tmp_path_factory.mktemp("warc") / uuid.uuid4().hex)


def round_trip(spark, pages, tmp_path_factory, min_bytes=0):
    raw, clean = folder(spark, tmp_path_factory), folder(spark, tmp_path_factory)
    warc.archive(pages, raw)
    warc.resolve(spark, raw, clean, min_bytes)
    return raw, clean


def expected(rows, min_bytes=0):
    first, out = {}, {}
    for page, html in sorted(rows):
        payload = (html or "").encode()
        origin = first.setdefault(payload, page)
        again = origin != page and len(payload) >= min_bytes
        out[page] = (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", origin if again else None)
    return out


def found(spark, path):
    rows = warc.read_records(spark, path).collect()
    out = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows}
    assert len(out) == len(rows)
    return out


PAGES = [(1, "u", ""), (2, "u", None), (3, "http://a\r\nX: y", "<p>é 🙂</p>"), (4, None, "<p>é 🙂</p>"), (5, "u", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb"),
         (6, "u", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb"), (7, "u", "x" * 3_000_000), (8, "u", "\x00\r\n\r\n"), (9, "u", "x" * 3_000_000)]


@pytest.mark.parametrize("min_bytes", [0, 1, 50])
def test_odd_payloads(spark, tmp_path_factory, min_bytes):
    pages = spark.createDataFrame([(*p, "more") for p in PAGES], "page_id long, url string, html string, record string").repartition(3)
    raw, clean = round_trip(spark, pages, tmp_path_factory, min_bytes)
    rows = [(p, h) for p, _, h in PAGES]
    assert found(spark, clean) == expected(rows, min_bytes)
    assert {k: v[:2] for k, v in found(spark, raw).items()} == {k: v[:2] for k, v in expected(rows).items()}
    payloads = {r["page_id"]: r["payload"] for r in warc.read_records(spark, clean, payload=True).filter("record_type = 'response'").collect()}
    assert all(bytes(v).decode() == (dict(rows)[k] or "") for k, v in payloads.items())


def test_pages_and_small_archives(spark, data, tmp_path_factory, monkeypatch):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    rows = [(r["page_id"], r["html"]) for r in pages.collect()]
    raw = folder(spark, tmp_path_factory)
    payload = F.octet_length(F.coalesce("html", F.lit("")))
    made = warc.record(F.col("page_id"), F.col("url"), F.col("html"), warc.payload_digest(F.col("html")), payload, F.lit(None).cast("long"))
    warc.write_archives(pages.select(made.alias("record")), raw, pages.select(payload.alias("n")), archive_bytes=20_000)
    assert spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(raw).count() > 3
    clean = folder(spark, tmp_path_factory)
    warc.resolve(spark, raw, clean)
    assert found(spark, clean) == expected(rows)
    # Resolving again keeps every place: revisits join the original with their digest.
    third = folder(spark, tmp_path_factory)
    warc.resolve(spark, clean, third)
    assert found(spark, third) == expected(rows)


def test_hot_payload_and_no_rows(spark, tmp_path_factory):
    pages = spark.range(600).selectExpr("id AS page_id", "'u' AS url", "if(id % 3 = 0, 'same', concat('own ', id)) AS html")
    _, clean = round_trip(spark, pages, tmp_path_factory)
    assert found(spark, clean) == expected([(r["page_id"], r["html"]) for r in pages.collect()])
    _, clean = round_trip(spark, pages.limit(0), tmp_path_factory)
    assert warc.read_records(spark, clean).count() == 0


def records(spark, path):
    return sorted(((r["page_id"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"]).decode()) for r in warc.read_records(spark, path, payload=True).collect()), key=str)


@pytest.mark.parametrize("broadcast", [True, False])
def test_repeated_page_ids_lose_no_payload(spark, tmp_path_factory, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(warc, "fits_broadcast", lambda df: False)
    schema = "page_id long, url string, html string"
    _, clean = round_trip(spark, spark.createDataFrame([(1, "u", "A"), (5, "u", "A"), (5, "u", "BBBB")], schema), tmp_path_factory)
    assert records(spark, clean) == [(1, "response", None, "A"), (5, "response", None, "BBBB"), (5, "revisit", 1, None)]
    _, clean = round_trip(spark, spark.createDataFrame([(1, "u", "A"), (5, "u", "A"), (5, "u", "A")], schema), tmp_path_factory)
    assert records(spark, clean) == [(1, "response", None, "A"), (5, "revisit", 1, None), (5, "revisit", 1, None)]
    _, clean = round_trip(spark, spark.createDataFrame([(7, "u", "C"), (7, "u", "C"), (7, "v", "C")], schema).repartition(3), tmp_path_factory)
    assert [r[1:] for r in records(spark, clean)] == [("response", None, "C"), ("revisit", 7, None), ("revisit", 7, None)]


def test_damage_is_an_error():
    good = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [b for _, b in warc.parse(good * 2)] == [b"ab"] * 2
    for bad in (good[:-1], good.replace(b": 2", b": 1"), b"x" + good):
        with pytest.raises(ValueError):
            list(warc.parse(bad))
    assert warc.unpacked(gzip.compress(good) + gzip.compress(good)) == good * 2


def test_page_without_id_and_revisit_without_original(spark, tmp_path_factory):
    pages = spark.createDataFrame([(None, "u", "x")], "page_id long, url string, html string")
    with pytest.raises(Exception, match="no id"):
        warc.archive(pages, folder(spark, tmp_path_factory))
    alone = warc.record(F.lit(2), F.lit("u"), F.lit("x"), warc.payload_digest(F.lit("x")), F.lit(1), F.lit(1))
    raw = folder(spark, tmp_path_factory)
    warc.write_archives(spark.range(1).select(alone.alias("record")), raw, spark.range(1).select("id"))
    with pytest.raises(Exception, match="no original"):
        warc.resolve(spark, raw, folder(spark, tmp_path_factory))


