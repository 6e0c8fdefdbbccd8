"""Mixing sources to target weights by blocks of words.

Each source is a stream of its documents' words, cut into blocks of a fixed length. Output shards draw how many of their
slots each source fills; draws are multinomial under the condition that all shards together take each source's quota, by
splitting the shards in halves with seeded draws, so any shard's counts are found without those of the others. A source's
slots are mapped through a pseudorandom permutation of its block numbers, once for each pass over the source, and slots and
blocks are joined by number. So shards differ in what they hold of each source by chance, and the whole mix meets its targets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffmill.llm.common import free, one_space, partitions, table, written

#: Words in a block, the share of all words that the mix has, the passes over a source at most, and slots in a shard.
BLOCK, SHARE, PASSES, SHARD_SLOTS, SEED = 64, 1.5, 2, 16_384, 20_240_601
WEIGHTS = (3.0, 1.0, 2.0)
#: Sources whose sizes the driver plans with; each is one number. More sources are refused, not cut.
MOST_SOURCES = 1_000_000


def targets(sizes: np.ndarray, weights: np.ndarray, share: float = SHARE, passes: float = PASSES) -> np.ndarray:
    """Words for each source: share of all words by weight, no source above passes times its size, the excess dealt by
    weight among the others until none is above. Sources without words get none; all are full if share is above passes."""
    cap, left = passes * sizes.astype(float), share * float(sizes.sum())
    out, open_ = np.zeros(len(sizes)), sizes > 0
    while open_.any():
        part = left * weights / weights[open_].sum()
        above = open_ & (part > cap)
        if not above.any():
            out[open_] = part[open_]
            break
        out[above] = cap[above]
        left -= cap[above].sum()
        open_ &= ~above
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n drawn without return are good; for numbers past the library's range, by the normal law within bounds."""
    if not good or not n:
        return 0
    if not bad:
        return n
    total = good + bad
    if total < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    mean = n * (good / total)
    spread = (mean * (bad / total) * ((total - n) / (total - 1))) ** 0.5
    return min(max(round(rng.normal(mean, spread)), n - bad, 0), good, n)


def shard_counts(quotas: list[int], shards: int, shard: int, slots: int, seed: int) -> tuple[list[int], list[int]]:
    """(first slot of the shard in each source, slots it takes of each source): walks the halves that hold the shard.

    All shards have slots places but the last, which has the rest.
    """
    total = sum(quotas)
    counts, before, low, high = list(quotas), [0] * len(quotas), 0, shards
    while high - low > 1:
        mid = (low + high) // 2
        places = min(mid * slots, total) - low * slots
        rng = np.random.default_rng([seed, low, high])
        rest, n, left = sum(counts), places, []
        for c in counts:
            take = _draw(rng, c, rest - c, n)
            left.append(take)
            rest, n = rest - c, n - take
        if shard < mid:
            counts, high = left, mid
        else:
            before = [a + b for a, b in zip(before, left, strict=True)]
            counts, low = [a - b for a, b in zip(counts, left, strict=True)], mid
    return before, counts


def permuted(x: np.ndarray, n: int, key: list[int]) -> np.ndarray:
    """A pseudorandom permutation of 0 to n - 1 at x: a four-round Feistel network over the next power of four, walked
    until the value falls below n."""
    half = np.uint64(max((max(n - 1, 1).bit_length() + 1) // 2, 1))
    mask = np.uint64((1 << int(half)) - 1)
    rounds = np.random.default_rng(key).integers(1, 2**63, 4, np.uint64)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for k in rounds:
            f = (right + np.uint64(1)) * (k | np.uint64(1))
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return (left << half) | right

    out = once(x.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def _slots(batches: Iterator[pa.RecordBatch], plan: list[tuple[int, int]], shards: int, slots: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, source, block) of each slot of the shards given. plan: (quota, blocks) of each source."""
    for batch in batches:
        for shard in batch.column(0).to_pylist():
            firsts, counts = shard_counts([q for q, _ in plan], shards, shard, slots, seed)
            for source, ((_, blocks), first, n) in enumerate(zip(plan, firsts, counts, strict=True)):
                if n:
                    j = np.arange(first, first + n, dtype=np.int64)
                    at = np.empty(n, np.int64)
                    for turn in np.unique(j // blocks).tolist():  # a permutation of its own for each pass over the source
                        own = j // blocks == turn
                        at[own] = permuted(j[own] % blocks, blocks, [seed, source, turn])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard, np.int64)), pa.array(np.full(n, source, np.int64)), pa.array(at)], ["shard", "source_no", "block"])


def word_count(text: Column) -> Column:
    """The number of words, from two byte lengths: no word is made."""
    flat = F.trim(one_space(text))
    return F.when(flat == "", F.lit(0)).otherwise(F.octet_length(flat) - F.octet_length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, block: int = BLOCK, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents, slots). documents has a row for each row of docs: doc_id, source, size (words), source_size, target (of its
    source), taken (words that the mix takes, repeats counted), first_shard (the first output shard that holds any of them, or
    null). slots has a row for each slot of the mix: shard, source_no,
    block; documents' columns source_no, first (of its words in its source's stream) and size say what a block holds.

    Sources go by code point, null last, and weigh weights in turn. A document's words are taken passes times at most, as
    each pass over a source takes a block once. Null and empty texts have size 0: they take no part and are returned with
    taken 0. Repeated rows and null ids take part like others. Runs agree: the order of a stream depends on ids and sizes
    only, and draws are seeded. No rows give none.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = written(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "size"), F.lit(n)).cast("int")), "mix-docs")
    # sums of each source and part: a source that holds most rows is many parts
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("words")).withColumn("before", F.expr("sum(words) OVER (PARTITION BY source ORDER BY part) - words"))
    parts = written(parts, "mix-parts")
    sums = parts.groupBy("source").agg(F.sum("words").alias("words"))
    if sums.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found = sorted(((r.source, r.words) for r in sums.collect()), key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8", "surrogatepass")))
    sizes = np.array([w for _, w in found], np.int64)
    weigh = np.array([weights[i % len(weights)] for i in range(len(found))], float)
    goal = targets(sizes, weigh, share, passes)
    blocks = -(-sizes // block)
    # a quota is the target in blocks of the source's mean length: never more than passes times its blocks
    quotas = [min(round(g * b / s), passes * b) if s else 0 for g, b, s in zip(goal.tolist(), blocks.tolist(), sizes.tolist(), strict=True)]
    shards = max(1, -(-sum(quotas) // SHARD_SLOTS))
    known = spark.createDataFrame([(s, i, int(w), float(g)) for i, ((s, w), g) in enumerate(zip(found, goal, strict=True))], "source string, source_no long, source_size long, target double")
    known = written(known, "mix-sources")
    # a document's first word in its source's stream
    placed = rows.withColumn("within", F.expr("sum(size) OVER (PARTITION BY source, part ORDER BY doc_id, size ROWS UNBOUNDED PRECEDING) - size"))
    placed = placed.join(parts.select(F.col("source").alias("s"), F.col("part").alias("p"), "before"), F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).drop("s", "p")
    placed = placed.join(known.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    placed = written(placed.selectExpr("doc_id", "source", "source_no", "size", "source_size", "target", "if(size > 0, before + within, NULL) AS first"), "mix-placed")
    slots = spark.range(0, shards, 1, min(shards, 4 * n)).mapInArrow(partial(_slots, plan=list(zip(quotas, blocks.tolist(), strict=True)), shards=shards, slots=SHARD_SLOTS, seed=seed), "shard long, source_no long, block long")
    # joined by number: each slot's block with the pieces of documents that the block holds
    drawn = slots.groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"), F.min("shard").alias("shard"))
    pieces = placed.where("size > 0").select("source_no", "first", "size", F.explode(F.expr(f"sequence(first DIV {block}, (first + size - 1) DIV {block})")).alias("block"))
    # merge joins: Spark guesses the size of an explosion by that of what it explodes, and would broadcast all pieces
    held = pieces.join(drawn.hint("merge"), ["source_no", "block"]).selectExpr("source_no AS n", "first AS f", f"times * (least(first + size, (block + 1) * {block}) - greatest(first, block * {block})) AS words", "shard")
    taken = held.groupBy("n", "f").agg(F.sum("words").alias("taken"), F.min("shard").alias("first_shard"))
    out = placed.join(taken.hint("merge"), (F.col("source_no") == F.col("n")) & (F.col("first") == F.col("f")), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "source_no", "first", "first_shard"), slots


#: Rests of documents are counted in parts of this size: sums of them fit a long for 10 ** 12 documents of a source.
GRAIN = 1_000_000


def whole_copies(found: DataFrame, seed: int = SEED) -> DataFrame:
    """found with copies: whole documents for the words that the mix takes of each, so that each source keeps its words.

    A document has the whole part of taken / size, and one more where the running sum of the rests passes a whole number. Sums
    run by source over documents in classes of near equal size, so what is rounded up in a class is as long as what is rounded
    down: a source is off by about one document of each class, whatever the law of sizes. Where a sum begins is drawn by source
    from the seed. Sums are made of (source, class, part), and within each by a window: no source is one task's.
    """
    n = partitions(found.sparkSession)
    rows = found.where("size > 0").withColumns({"rest": F.expr(f"(taken % size) * {GRAIN}L DIV size"), "class": F.expr("CAST(log2(size) * 8 AS INT)"), "part": F.pmod(F.xxhash64("doc_id", "first"), F.lit(n)).cast("int")})
    rows = written(rows, "mix-rests")
    sums = rows.groupBy("source_no", "class", "part").agg(F.sum("rest").alias("n"))
    start = F.pmod(F.xxhash64("source_no", F.lit(seed)), F.lit(GRAIN))
    sums = sums.withColumn("before", F.expr("sum(n) OVER (PARTITION BY source_no ORDER BY class, part) - n") + start).drop("n")
    upto = F.expr("sum(rest) OVER (PARTITION BY source_no, class, part ORDER BY first ROWS UNBOUNDED PRECEDING) + before")
    rows = rows.join(sums, ["source_no", "class", "part"]).withColumn("upto", upto)
    copies = F.expr(f"CAST(taken DIV size + upto DIV {GRAIN}L - (upto - rest) DIV {GRAIN}L AS INT)")
    return rows.select("doc_id", "source", "size", "first", "taken", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """The rows of docs in whole copies, as whole_copies says: each source's words come near its target, by documents.

    A document without words stays once, as no weight speaks of it. Rows that repeat id, source and size share their copies:
    each is there equally often, and one of them as often more as the division leaves. All columns of docs stay, whatever
    their names.
    """
    found, _ = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    own, source, size, words, each, more, copy = free(docs, "__id", "__source", "__size", "__words", "__each", "__more", "__copy")
    copies = whole_copies(found, seed).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 0")
    copies = copies.select(F.col("doc_id").alias(own), F.col("source").alias(source), F.col("size").alias(size), F.expr("CAST(n DIV rows AS INT)").alias(each), F.expr("CAST(n % rows AS INT)").alias(more))
    copies = written(copies, "mix-copies")
    rows = docs.withColumn(words, word_count(F.col(text_col)))
    same = rows[id_col].eqNullSafe(F.col(own)) & rows[source_col].cast("string").eqNullSafe(F.col(source)) & (F.col(words) == F.col(size))
    # merge: both sides grow with the input, so the plan is the same at every size; no copies row for a text without words
    met = rows.join(copies.hint("merge"), same, "left").withColumn(each, F.when(F.col(words) == 0, 1).otherwise(F.coalesce(each, F.lit(0))))
    out = met.where(F.col(each) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(each)))).select(*docs.columns)
    left = copies.where(F.col(more) > 0)
    rest = rows.join(left.hint("merge"), same).groupBy(own, source, size, more).agg(F.min_by(F.struct(*(rows[c] for c in docs.columns)), F.xxhash64(rows[text_col])).alias(copy))
    return out.unionByName(rest.withColumn(words, F.explode(F.sequence(F.lit(1), F.col(more)))).select(f"{copy}.*"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the whole documents table."""
    found, _ = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "first_shard")
