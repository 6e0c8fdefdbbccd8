"""Sharding by longest-processing-time scheduling.

Rows of equal texts stay together. Groups go to shards by falling size, each to the shard that has least so far, which a
heap gives. The driver schedules a number of units that is bounded whatever the corpus holds: a group is a unit if it is
larger than a fixed part of a shard, of which there can be only so many; smaller groups are units in bins by their hash.
Rows are dealt by their group's unit; slots are numbers in (shard, part) after the counts of the parts before.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffmill.llm.common import partitions, table, written

SHARDS, HEADER = 24, 8
#: Groups larger than this part of a shard are units, so at most SHARDS * PARTS; the bins of the others.
PARTS, BINS = 1_000, 16_384


def schedule(sizes: list[tuple], shards: int) -> dict:
    """Unit to shard: (size, unit) by falling size, ties by unit, each to the shard with least; ties to the lower shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, unit in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        out[unit] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def shard(docs: DataFrame, shards: int = SHARDS, header: int = HEADER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, size (UTF-8 bytes and header), text_crc32, law ('bytes'), shard, slot, grown_shard.

    The law is bytes: sizes of shards are near equal, as far as groups of equal texts allow; grown_shard is null. Null texts
    are a group with empty ones. slot numbers a shard's rows from 0 without gaps; runs agree. Repeated rows and null ids are
    dealt like others. No rows give none. Other columns are not read.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + header).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group"))
    rows = written(rows.withColumn("bin", F.pmod(F.xxhash64("group"), F.lit(BINS)).cast("int")), "shard-rows")
    groups = rows.groupBy("group", "bin").agg(F.sum("size").alias("bytes"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    least = total // (shards * PARTS) + 1  # no more than shards * PARTS groups are of this size
    groups = written(groups, "shard-groups")
    large = [(r.bytes, (0, bytes(r.group))) for r in groups.where(F.col("bytes") >= least).select("group", "bytes").collect()]
    small = [(r.bytes, (1, r.bin)) for r in groups.where(F.col("bytes") < least).groupBy("bin").agg(F.sum("bytes").alias("bytes")).collect()]
    found = schedule(large + small, shards)
    of_bin = [found.get((1, b), 0) for b in range(BINS)]
    own = written(spark.createDataFrame([(bytearray(g), s) for (k, g), s in found.items() if not k], "group binary, own int"), "shard-large")
    bins = written(spark.createDataFrame(list(enumerate(of_bin)), "bin int, binned int"), "shard-bins")
    # both tables have a proven bound: shards * PARTS rows of 36 bytes, and BINS rows of 8
    dealt = rows.join(F.broadcast(own), "group", "left").join(F.broadcast(bins), "bin").select("doc_id", "size", "text_crc32", F.coalesce("own", "binned").alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n)).cast("int").alias("part"))
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.expr("sum(n) OVER (PARTITION BY shard ORDER BY part) - n"))
    counts = written(counts.select(F.col("shard").alias("s"), F.col("part").alias("p"), "before"), "shard-counts")
    dealt = dealt.withColumn("own", F.expr("row_number() OVER (PARTITION BY shard, part ORDER BY doc_id, text_crc32, size) - 1"))
    out = dealt.join(counts, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p")))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the whole documents table in 24 shards."""
    return shard(table(spark, sf_dir, "documents"))
