from __future__ import annotations

import gzip
import hashlib
from collections import Counter
from pathlib import Path

import pytest

from diffmill.llm import warc as w

BIG = "é" * 600
ROWS = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (5, "http://a/5", BIG), (5, "http://a/5", BIG), (3, "http://a/3", "small"), (4, "http://a/4", "small"), (6, None, None), (7, "", ""),
    (None, "http://null", BIG), (8, "http://x/\r\nWARC-Type: evil", "\r\n\r\nWARC/1.1\r\n"), (9, "http://long", "z" * 3_000_000), (-(2**60), "http://far", "far away"), (2**60, "http://end", BIG + "!"),
]


def brute(rows):
    last = {}
    for i, _, t in rows:
        last[t or ""] = max((x for x in (i, last.get(t or "")) if x is not None), default=None)
    out = Counter()
    for i, _, t in rows:
        data = (t or "").encode()
        again = len(data) >= 1000 and i != last[t or ""]
        out[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last[t or ""] if again else None] += 1
    return out


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, shard int, payload string")


def files(folder):
    return {p.name: p.read_bytes() for p in Path(folder.removeprefix("file://")).glob("*.warc.gz")}


def test_round_trip(spark, tmp_path):
    rows = ROWS + [(100 + i, f"http://b/{i}", f"page {i} " * (i % 300)) for i in range(300)]
    folder = w.write_warc(pages_of(spark, rows), str(tmp_path / "a"), roll=2_000, shard_bytes=100_000)
    got = w.read_warc(spark, folder).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == brute(rows)
    texts = Counter((i, t or "") for i, _, t in rows)
    assert all(texts[r.page_id, r.payload.decode()] for r in got if r.record_type == "response") and all(r.payload == b"" for r in got if r.record_type == "revisit")
    held = files(folder)
    assert len(held) > 5 and not any(name.startswith("_temporary") for name in held)
    assert sum(len(x) for x in held.values()) == sum(r.bytes for r in spark.read.parquet(f"{folder}/manifest.parquet").collect())
    again = w.write_warc(pages_of(spark, rows[::-1]).repartition(7), str(tmp_path / "b"), roll=2_000, shard_bytes=100_000)
    assert files(again) == held


def test_records_are_sorted_and_plain_gzip(spark, tmp_path):
    rows = [(i, f"http://c/{i}", "x" * i) for i in range(1, 200)]
    folder = w.write_warc(pages_of(spark, rows), str(tmp_path / "c"), shard_bytes=20_000)
    held = files(folder)
    ids = [int(line.split(b": ")[1]) for name in sorted(held) for line in gzip.decompress(held[name]).split(b"\r\n") if line.startswith(b"X-Page-ID")]
    assert ids == list(range(1, 200)) and len(held) > 2


def test_only_committed_files_are_read_and_breaks_are_seen(spark, tmp_path):
    folder = w.write_warc(pages_of(spark, ROWS[:4]), str(tmp_path / "d"))
    (tmp_path / "d" / "shard-999999-00000.warc.gz").write_bytes(b"not in the manifest")
    assert w.read_warc(spark, folder).count() == 4
    name = next(n for n in files(folder) if "999999" not in n)
    data = bytearray((tmp_path / "d" / name).read_bytes())
    (tmp_path / "d" / name).write_bytes(bytes(data[:-30]))
    with pytest.raises(Exception, match="ends within|incomplete|broken"):
        w.read_warc(spark, folder).collect()


def test_split_points_are_exact_sums(spark):
    rows = spark.createDataFrame([(i if i < 50 else 2**50 + i, 10) for i in range(100)] + [(None, 5)], "id long, bytes long")
    points = w.split_points(rows, 100)
    assert points == sorted(set(points)) and len(points) == 9 and w.split_points(rows.where("id < 0"), 10) == []


def test_no_rows_and_one_hot_id(spark, tmp_path):
    folder = w.write_warc(pages_of(spark, []), str(tmp_path / "e"))
    assert w.read_warc(spark, folder).collect() == [] and files(folder) == {}
    rows = [(1, "u", BIG)] * 40
    got = w.read_warc(spark, w.write_warc(pages_of(spark, rows), str(tmp_path / "f"), shard_bytes=1000)).collect()
    assert len(got) == 40 and {r.record_type for r in got} == {"response"}


def test_split_points_take_a_fixed_number_of_jobs(spark):
    def jobs(rows, size):
        tracker, group = spark.sparkContext.statusTracker(), f"points-{rows.count()}"
        spark.sparkContext.setJobGroup(group, "")
        points = w.split_points(rows, size)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group)), points

    few, _ = jobs(spark.range(100).selectExpr("id * 1000 AS id", "100L AS bytes"), 50)
    many, points = jobs(spark.range(10_000).selectExpr("id * 1000 AS id", "100L AS bytes"), 50)
    assert many == few < 12 and points == [i * 1000 for i in range(1, 10_000)]


def test_shards_are_tasks_of_their_own(spark, tmp_path):
    rows = [(i, f"http://c/{i}", "x" * 500) for i in range(200)]
    folder = w.write_warc(pages_of(spark, rows), str(tmp_path / "g"), shard_bytes=10_000)
    manifest = spark.read.parquet(f"{folder}/manifest.parquet")
    assert manifest.count() == manifest.select("shard").distinct().count() > 15
    assert max(r.records for r in manifest.collect()) <= 11
    assert w.read_warc(spark, folder).rdd.glom().map(len).collect().count(0) == 0
