"""Exact dedup by progressive refinement: length, then a hash of a prefix, then a hash of the full text.

Each tier is a count over narrow keys that Spark combines before it shuffles, so a hot key costs one row a task.
The keys of (length, prefix hash) that two or more rows share are folded into a bitmap of a fixed size, which is
broadcast. The second scan looks each row up there and hashes full content only for rows whose bit is set. A bit that
is set by chance costs a hash and changes no result. No text is shuffled to find copies; only the stage that drops rows moves
whole documents, to meet the table of those that go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffmill.llm.common import free, one_space, written

#: Code points of the prefix that the second tier hashes.
PREFIX_CHARS = 256
#: Bits of the survivors' bitmap: 2 ** 25 bits are 1,024 rows of 4 KB, so at most 4 MB are broadcast at any input size.
BITMAP_BITS = 25


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__id, __norm, __len (of the normalised text), __prefix (hash of its first code points)."""
    rows = docs.select(F.col(id_col).alias("__id"), one_space(F.col(text_col)).alias("__norm"))
    return rows.select(
        "__id", "__norm",
        F.octet_length("__norm").cast("long").alias("__len"),
        F.xxhash64(F.substring("__norm", 1, PREFIX_CHARS)).alias("__prefix"),
    )


def _slot() -> Column:
    return F.pmod(F.xxhash64("__len", "__prefix"), F.lit(1 << BITMAP_BITS))


def _survivors(keyed: DataFrame) -> DataFrame:
    """The bitmap rows (__bucket, __bits) of keys that two or more rows share, by length first."""
    counts = keyed.groupBy("__len", "__prefix").agg(F.count(F.lit(1)).alias("n"))
    # first tier: lengths of two rows or more. Their number is bounded by the longest text, not by the rows.
    by_length = counts.groupBy("__len").agg(F.sum("n").alias("rows")).where("rows > 1").select("__len")
    # second tier: of those, keys of two rows or more
    shared = counts.where("n > 1").join(by_length, "__len", "left_semi").select(_slot().alias("slot"))
    return shared.groupBy(F.bitmap_bucket_number("slot").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("__bits"))


def _is_set() -> Column:
    at = F.bitmap_bit_position(_slot())
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.col("__bits").isNotNull() & (F.expr("0") != F.call_function("getbit", byte, (at % 8).cast("int")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(groups, bitmap): a row (sha, keep_id, group_size) for each text that two or more rows hold; the bitmap table.

    The rows are those of docs; null text counts as empty. keep_id is the smallest id, and null only if all are null.
    """
    keyed = _keyed(docs, id_col, text_col)
    bitmap = written(_survivors(keyed), "dedup-bitmap")
    full = maybe(keyed, bitmap).where("__maybe").select("__id", "__len", "__prefix", F.unhex(F.sha2("__norm", 256)).alias("sha"))
    groups = full.groupBy("__len", "__prefix", "sha").agg(F.min("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return written(groups.select("sha", "keep_id", "group_size"), "dedup-groups"), bitmap


def maybe(keyed: DataFrame, bitmap: DataFrame) -> DataFrame:
    """keyed with __maybe: whether the row's key may be shared."""
    placed = keyed.withColumn("__bucket", F.bitmap_bucket_number(_slot()))
    return placed.join(F.broadcast(bitmap), "__bucket", "left").withColumn("__maybe", _is_set())


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = True) -> DataFrame:
    """A row for each row of docs, dropped ones too: <id_col>, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so after each run of space and of the code points 9 to 13 became one space. Of equal
    texts the row with the smallest id stays. Null text counts as empty; empty texts form a group like any other. A null
    id sorts after all others. Rows that repeat both id and text stay apart: each is returned, and of those with the
    group's keep_id exactly one is kept. An empty table gives no rows. Other columns are not read.
    digest: give text_sha256 for each row; else only the rows that the first two tiers leave are hashed, and it is null
    elsewhere.
    """
    groups, bitmap = exact_groups(docs, id_col, text_col)
    rows = _keyed(docs, id_col, text_col)
    sha = F.unhex(F.sha2("__norm", 256))
    rows = rows.withColumn("sha", sha) if digest else maybe(rows, bitmap).withColumn("sha", F.when(F.col("__maybe"), sha))
    # narrow rows from here on; equal ones are counted, then dealt out again with a number
    rows = rows.groupBy("__id", "__len", "__prefix", "sha").agg(F.count(F.lit(1)).alias("copies")).join(groups, "sha", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("__id")).otherwise(F.col("keep_id"))
    rows = rows.select("__id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "sha", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    return rows.select(
        F.col("__id").alias(id_col), "keep_id", "group_size",
        (F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: bool = True) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns, whatever their names. Rows that repeat a kept id and
    text all stay, as they are no other documents; without repeats, one of them stays, as exact_dedup has it.

    Only narrow rows of shared texts are matched with their groups; the documents meet a table of (id, hash) to drop.
    """
    own, hashed, sha, row = free(docs, "__gone_id", "__gone_sha", "__sha", "__row")
    keyed = _keyed(docs, id_col, text_col)
    bitmap = written(_survivors(keyed), "dedup-bitmap")
    # one scan hashes what the first two tiers leave; from it come groups, what goes, and kept rows that repeat
    members = written(maybe(keyed, bitmap).where("__maybe").select("__id", F.unhex(F.sha2("__norm", 256)).alias("sha")), "dedup-members")
    groups = members.groupBy("sha").agg(F.min("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1").select("sha", "keep_id")
    met = members.groupBy("__id", "sha").agg(F.count(F.lit(1)).alias("n")).join(groups, "sha")
    met = written(met.select(F.col("__id").alias(own), F.col("sha").alias(hashed), "n", F.col("__id").eqNullSafe(F.col("keep_id")).alias("stays")), "dedup-met")
    rows = docs.withColumn(sha, F.unhex(F.sha2(one_space(F.col(text_col)), 256)))

    def matched(df: DataFrame, keys: DataFrame, kind: str) -> DataFrame:
        # merge: both sides grow with the input, so the plan is the same at every size
        return df.join(keys.select(own, hashed).hint("merge"), df[id_col].eqNullSafe(F.col(own)) & (df[sha] == F.col(hashed)), kind)

    kept = matched(rows, met.where("NOT stays"), "left_anti")
    again = met.where("stays AND n > 1")
    if repeats or again.isEmpty():
        return kept.select(*docs.columns)
    # one row of each key by an aggregation, so a row that repeats very often is combined before it is shuffled
    first = matched(kept, again, "left_semi").groupBy(id_col, sha).agg(F.first(F.struct(*docs.columns)).alias(row)).select(f"{row}.*")
    return matched(kept, again, "left_anti").select(*docs.columns).unionByName(first)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the whole documents table."""
    from diffmill.llm.common import table

    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""
