"""Archives that end at a byte bound, hot payloads and refused records."""

import base64
import collections
import glob
import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from clausewise.llm import warc


def written(path):
    return [open(f, "rb").read() for f in sorted(glob.glob(f"{path}/part-*"))]


def test_archives_roll_and_a_hot_payload_is_spread(spark, tmp_path):
    hot = "<html>" + "the same page " * 40 + "</html>"
    pages = (spark.range(3_000).select((F.col("id") * 7 % 3_000).alias("page_id"), F.concat(F.lit("http://a/"), "id").alias("url"),
                                       F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.concat(F.sha2(F.col("id").cast("string"), 512), F.sha1(F.col("id").cast("string")))).alias("html"))
                  .repartition(211))
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, archive_bytes=40_000, archive_lines=300)
    files = written(path)
    assert len(files) > 8
    magic = struct.pack("<I", warc.DICTIONARY_MAGIC)
    ends = struct.pack("<II", warc.SKIPPABLE_FIRST, 0)
    for f in files:
        assert f.startswith(magic)
        frames = [(m, e - s) for m, s, e in warc.frames(memoryview(f))]
        assert sum(m == warc.DICTIONARY_MAGIC for m, _ in frames) == 1 and f.endswith(ends)
        assert sum(n for m, n in frames if m == warc.FRAME_MAGIC) <= 40_000 + max(n for m, n in frames if m == warc.FRAME_MAGIC)
    got = warc.read_archives(spark, path).collect()
    want = {r.page_id: r.html for r in pages.collect()}
    least = min(p for p, h in want.items() if h == hot)
    assert collections.Counter(int(r.record_id) for r in got) == dict.fromkeys(want, 1)
    for r in got:
        body = want[int(r.record_id)].encode()
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode() and r.payload_bytes == len(body)
        again = body.decode() == hot and int(r.record_id) != least
        assert (r.record_type, r.refers_to) == (("revisit", str(least)) if again else ("response", None))


def test_html_is_not_dealt_by_its_hash(spark):
    pages = spark.range(50).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("same").alias("html"))
    plan = warc.with_record_type(pages.hint("merge"))._jdf.queryExecution().executedPlan().toString()
    carrying = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    # the id is a part of every key by which pages and their decisions are dealt; only ids are dealt by the hash alone
    assert any("page_id" in line.split("hashpartitioning(")[1].split("),")[0] for line in carrying)


def test_a_record_beyond_the_bound_is_refused(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(1, "u", "x" * 5_000)], "page_id bigint, url string, html string")
    monkeypatch.setattr(warc, "MAX_RECORD", 4_000)
    make = warc.make_record("1", "u", b"x" * 5_000, None, False, "2020-01-01T00:00:00Z")
    encoder = warc.zstandard.ZstdCompressor()
    with pytest.raises(warc.zstandard.ZstdError):  # frames that do not say their size are held to the bound
        data = warc.zstandard.ZstdCompressor(write_content_size=False).compress(make)
        list(warc.read_archive(struct.pack("<II", warc.DICTIONARY_MAGIC, 0) + data))
    assert list(warc.read_archive(struct.pack("<II", warc.DICTIONARY_MAGIC, 0) + encoder.compress(make)))
    monkeypatch.undo()
    warc.write_archives(pages, str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 1
