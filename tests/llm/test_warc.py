"""Archives: round trips, ranges of any size, members within members, damage."""

import gzip
import io
import zlib

import pytest
from pyspark.sql import functions as F

from thoughtloom.llm import warc
from thoughtloom.llm.common import scratch_path


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, path string, bytes int")


ROWS = [(i, f"http://h/{i}", f"<p>page {i % 11} " + "é" * (i % 7) + "x y" * (i * 40 % 900) + "</p>") for i in range(300)] + [(400 + i, "http://h/hot", "<p>hot</p>") for i in range(150)]


@pytest.mark.parametrize("split, archive", [(1 << 24, 1 << 28), (700, 9000), (61, 1 << 28)])
def test_every_payload_comes_back_whatever_the_ranges(spark, split, archive):
    folder = scratch_path(spark, "t")
    files = warc.write_archives(pages(spark, ROWS).repartition(3), folder, archive_bytes=archive)
    got = warc.resolved(warc.read_archives(files, folder, split_bytes=split)).collect()
    first = {}
    for i, _, html in sorted(ROWS):
        first.setdefault(html, i)
    want = {i: (html.encode(), None if first[html] == i else first[html]) for i, _, html in ROWS}
    assert len(got) == len(want) and files.count() >= (1 if archive > 9000 else 3)
    for r in got:
        body, refers = want[r["page_id"]]
        assert (r["record_type"], r["refers_to"]) == ("response" if refers is None else "revisit", refers)
        assert r["payload_digest"] == warc.sha1_base32(body) and r["payload_bytes"] == len(body)
        assert r["target_uri"].startswith("http://h/") and (r["payload"] == body if refers is None else r["payload"] is None)
    assert all(r["intact"] for r in got if r["record_type"] == "response")


def test_nulls_repeats_least_size_and_empty_tables(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "ab"), (None, "u", "ab"), (4, "u", "abc"), (4, "u", "abc"), (5, "u", "abc"), (None, "u", "alone")]
    out = {}
    for least in (0, 3):
        folder = scratch_path(spark, "t")
        found = warc.resolved(warc.read_archives(warc.write_archives(pages(spark, rows), folder, min_bytes=least), folder, payloads=False))
        out[least] = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in found.collect()), key=str)
        assert found.where("payload is not null").count() == 0
    late = [(4, 3, "response", None)] * 2 + [(5, 3, "revisit", 4), (None, 5, "response", None)]
    assert out[0] == sorted([(1, 0, "response", None), (2, 0, "revisit", 1), (3, 2, "response", None), (None, 2, "revisit", 3), *late], key=str)
    assert out[3] == sorted([(1, 0, "response", None), (2, 0, "response", None), (3, 2, "response", None), (None, 2, "response", None), *late], key=str)
    folder = scratch_path(spark, "t")
    assert warc.read_archives(warc.write_archives(pages(spark, []), folder), folder).count() == 0


def _files(spark, tmp_path, **contents):
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    return spark.createDataFrame([(f"file://{tmp_path / n}", len(c)) for n, c in contents.items()], "path string, bytes long")


def _stored(record: bytes) -> bytes:
    """A gzip member that holds its content as it is, so that a member within it can be seen from outside."""
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def test_an_archive_within_a_record_is_not_read_as_records(spark, tmp_path):
    inner = b"".join(warc._member(warc.page_record(i, "in", b"inner %d " % i + bytes(range(256)) * 40, None, "d"), 0) for i in range(6))
    outer = [_stored(warc.page_record(100 + i, "out", inner, None, "d")) for i in range(2)]
    files = _files(spark, tmp_path, a=b"".join(outer), b=warc._member(warc.page_record(7, "u", b"plain", None, "d"), 6))
    for split in (1 << 24, 5000):
        got = warc.resolved(warc.read_archives(files, scratch_path(spark, "t"), split_bytes=split)).collect()
        assert sorted(r["page_id"] for r in got) == [7, 100, 101]
        assert {r["payload"] for r in got} == {inner, b"plain"}


def test_damaged_bytes_are_skipped_and_several_records_share_a_member(spark, tmp_path):
    records = [warc.page_record(i, f"u{i}", b"text %d" % i * 50, None, "d") for i in range(5)]
    packed = [warc._member(r, 6) for r in records]
    hurt = bytearray(packed[2])
    hurt[len(hurt) // 2] ^= 255
    whole = io.BytesIO()
    with gzip.GzipFile(fileobj=whole, mode="wb") as f:
        f.write(b"".join(records))
    files = _files(spark, tmp_path, hurt=packed[0] + b"\x1f\x8b\x08junk" + packed[1] + bytes(hurt) + packed[3] + packed[4][:-9], one=whole.getvalue(), none=b"no archive")
    for split in (1 << 24, 40):
        got = warc.read_archives(files, scratch_path(spark, "t"), split_bytes=split)
        ids = got.select(F.regexp_extract("path", "[a-z]+$", 0).alias("f"), F.col("fields")["page-id"].cast("int").alias("i")).collect()
        assert sorted((r["f"], r["i"]) for r in ids) == [("hurt", 0), ("hurt", 1), ("hurt", 3), *(("one", i) for i in range(5))]
