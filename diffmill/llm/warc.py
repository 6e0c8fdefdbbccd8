"""A deterministic sharded WARC writer, and its reader.

Records are sorted by range: split points come from running sums of bytes in the order of ids, so they depend on the data
alone; the sums take one pass over (id, bytes) rows, whatever their number. Each task writes the records of its shard in order, one gzip member a record, and
rolls to a new file once the compressed size is reached. Headers and digests are made anew from the payload. A file gets
its final name when it is whole, from a temporary one that names the attempt; a manifest lists the committed files, and
only those are read. A task that runs twice writes the same bytes under the same name. Payloads of revisits are not carried.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from decimal import Decimal
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diffmill.llm.common import new_folder, partitions, table, written

#: Compressed bytes after which a file is rolled; payload bytes of a shard, which are more where there would be more than
#: SHARDS shards; the least payload that is revisited.
ROLL, SHARD, SHARDS, REVISIT = 64 << 20, 32 << 20, 16_384, 1000
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "file string, shard long, part long, records long, bytes long, sha256 string"


def split_points(rows: DataFrame, size: int) -> list[int]:
    """Ids at which shards of about size payload bytes start: (id, bytes) rows, null ids aside.

    A row's shard is the running sum of bytes before its id, divided by size. Running sums are those of parts, which a sort by
    range makes, and within a part; they don't depend on where parts begin. The driver sees a sum for each part and the first
    id of each shard; the total also says whether shards have to be larger, for there to be no more than about SHARDS of them.
    """
    spark = rows.sparkSession
    sums = rows.where("id IS NOT NULL").groupBy("id").agg(F.sum(F.col("bytes").cast("decimal(38,0)")).alias("bytes"))
    sums = written(sums.repartitionByRange(partitions(spark), "id").withColumn("part", F.spark_partition_id()), "warc-sizes")
    total, before = 0, []
    for r in sorted(sums.groupBy("part").agg(F.min("id").alias("first"), F.sum("bytes").alias("n")).collect(), key=lambda r: r.first):
        before.append((r.part, Decimal(total)))
        total += int(r.n)
    if not before:
        return []
    size = max(size, total // SHARDS)
    parts = spark.createDataFrame(before, "part int, before decimal(38,0)")
    placed = sums.join(F.broadcast(parts), "part").withColumn("at", F.expr("sum(bytes) OVER (PARTITION BY part ORDER BY id ROWS UNBOUNDED PRECEDING) - bytes + before"))
    firsts = placed.groupBy(F.expr(f"at DIV {size}BD").alias("shard")).agg(F.min("id").alias("id"))
    return sorted(r.id for r in firsts.collect())[1:]


def _record(kind: str, page_id: int | None, url: str | None, payload: bytes, sha1: str, size: int, refers_to: int | None) -> bytes:
    """A whole record, with the headers that its payload gives."""
    name = f"{kind}|{page_id}|{url}|{sha1}|{size}"
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha1:{hashlib.sha1(payload).hexdigest()}", f"X-Payload-Length: {size}",
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []), *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        *([f"X-Refers-To-Page-ID: {refers_to}"] if refers_to is not None else []), "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    """A gzip member without a time or a name: the same bytes whenever it is written."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + pack.compress(record) + pack.flush() + zlib.crc32(record).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")


def _store(folder: str):
    """The file system of a folder and its path there, on driver or executor, for any address that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


class _Roller:
    """Writes a shard's members; each file goes to its final name once it is whole."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.fs, self.base = _store(folder)
        self.shard, self.roll, self.part, self.out = shard, roll, 0, None
        self.attempt = uuid.uuid4().hex

    def add(self, member: bytes) -> tuple | None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.temporary = f"{self.base}/_temporary-{self.attempt}-{self.name}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        return self.commit() if self.size >= self.roll else None

    def commit(self) -> tuple | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        self.fs.move(self.temporary, f"{self.base}/{self.name}")
        row = (self.name, self.shard, self.part, self.records, self.size, self.sha.hexdigest())
        self.part += 1
        return row


def _write(batches: Iterator[pa.RecordBatch], folder: str, roll: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, kind, page_id, url, payload, sha1, size, refers_to) in order to rows of the manifest."""
    writer: _Roller | None = None
    rows: list[tuple] = []
    for batch in batches:
        for i in range(batch.num_rows):
            shard, *row = (batch.column(c)[i].as_py() for c in range(8))
            if writer is None or writer.shard != shard:
                rows += [writer.commit()] if writer else []
                writer = _Roller(folder, shard, roll)
            rows.append(writer.add(_member(_record(row[0], row[1], row[2], row[3] or b"", row[4], row[5], row[6]))))
    if writer:
        rows.append(writer.commit())
    rows = [r for r in rows if r]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], ["file", "shard", "part", "records", "bytes", "sha256"])


def write_warc(pages: DataFrame, folder: str | None = None, roll: int = ROLL, shard_bytes: int = SHARD, least: int = REVISIT, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> str:
    """Writes a record for each row of pages and returns the folder, which holds the files and manifest.parquet.

    The payload is the UTF-8 text; null is empty. Of records with equal payloads of least bytes or more, that with the
    largest id is a response and the others revisit it; rows that share that id are all responses, and so are all smaller
    payloads. Rows are in the order of id, then url and digest, null ids first in the first shard; repeated rows are written
    as often as they come. Without rows there are no files and an empty manifest. Other columns are not read. The folder is
    new for each run unless given; it has to be one that driver and executors share.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("id", "url", "payload", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    # payloads that come again: a row each, summed before the shuffle
    again = rows.where(f"bytes >= {least}").groupBy("sha1", "bytes").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("sha1").alias("s"), F.col("bytes").alias("b"), "last")
    again = written(again, "warc-again")
    rows = rows.join(again, (F.col("sha1") == F.col("s")) & (F.col("bytes") == F.col("b")), "left")
    revisit = F.coalesce(F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last")), F.lit(False))
    points = split_points(rows.select("id", F.when(revisit, 0).otherwise(F.col("bytes")).alias("bytes")).withColumn("bytes", F.col("bytes") + 512), shard_bytes)
    rows = rows.select(
        _shard_of(spark, points)(F.coalesce("id", F.lit(-(2**63)))).alias("shard"), F.when(revisit, "revisit").otherwise("response").alias("kind"), F.col("id").alias("page_id"), "url",
        F.when(~revisit, F.col("payload")).alias("payload"), "sha1", F.col("bytes").alias("size"), F.when(revisit, F.col("last")).alias("refers_to"),
    )
    n = len(points) + 1
    rows = rows.repartitionById(n, F.col("shard").cast("int")).sortWithinPartitions("shard", "page_id", "url", "sha1", "kind")
    found = rows.mapInArrow(partial(_write, folder=folder, roll=roll), MANIFEST)
    found.write.mode("overwrite").parquet(f"{folder}/manifest.parquet")  # committed by Spark's own protocol, when all files are
    return folder


def _shard_of(spark: SparkSession, points: list[int]):
    """Numbers of shards: how many of the sorted points are not above the id. There is a point for each shard's bytes."""
    kept = spark.sparkContext.broadcast(np.array(points, np.int64))

    @F.pandas_udf("long")
    def search(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(kept.value, ids.to_numpy(np.int64), side="right"))

    return search


def _records(store, path: str, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file, member by member."""
    with store.open_input_stream(path, compression=None) as source:
        rest, data, unpack = b"", [], zlib.decompressobj(31)
        while True:
            rest = rest or source.read(chunk)
            if not rest:
                if data:
                    raise ValueError(f"{path} ends within a record")
                return
            data.append(unpack.decompress(rest))
            rest = unpack.unused_data if unpack.eof else b""
            if unpack.eof:
                record, data, unpack = b"".join(data), [], zlib.decompressobj(31)
                head, _, body = record.partition(b"\r\n\r\n")
                first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
                headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
                block, end = body[: (size := int(headers["Content-Length"]))], body[size:]
                if not first.startswith("WARC/") or end != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
                    raise ValueError(f"{path} has a broken record")
                yield headers, block


READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(batches: Iterator[pa.RecordBatch], folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    store, base = _store(folder)
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names)

    whole = lambda x: int(x) if x is not None else None
    rows, held = [], 0
    for batch in batches:
        for file in batch.column(0).to_pylist():
            for headers, block in _records(store, f"{base}/{file}"):
                kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and digest != hashlib.sha1(block).hexdigest():
                    raise ValueError(f"{file} has a payload that its digest does not fit")
                rows.append((whole(headers.get("X-Page-ID")), headers["WARC-Target-URI"], block if payloads else None, int(headers["X-Payload-Length"]), digest, kind, whole(headers.get("X-Refers-To-Page-ID"))))
                held += len(block)
                if len(rows) >= 5_000 or payloads and held > 16 << 20:
                    yield packed(rows)
                    rows, held = [], 0
    yield packed(rows)


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the files that the manifest names: page_id, url, payload (empty for a revisit; null unless
    payloads), payload_bytes and payload_digest of the full payload, record_type, refers_to. Digests are checked."""
    files = spark.read.parquet(f"{folder}/manifest.parquet").select("file", "shard")
    n = (files.agg(F.max("shard")).first()[0] or 0) + 1  # a task for each shard's files
    return files.repartitionById(n, F.col("shard").cast("int")).mapInArrow(partial(_read, folder=folder, payloads=payloads), READ)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the whole pages table, written and read back."""
    return read_warc(spark, write_warc(table(spark, sf_dir, "pages")), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS last FROM p GROUP BY html),
t AS (SELECT p.page_id, octet_length(encode(p.html)) AS payload_bytes, sha1(p.html) AS payload_digest, last FROM p JOIN g ON p.html = g.html)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM t
"""
