"""Quality rules: base figures of each text, and the frequency of its lines across documents of a host.

Lines are normalised and hashed; for each host, the documents that hold a line are counted, a text that is there in many
copies counting once, so that copies alone condemn nothing. Lines in more documents than the limits allow are removed, and
documents that this leaves depleted are rejected. Counts cover all documents and are combined before each shuffle, so a
line that a third of all documents hold, or a host that has them, is a row a task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diffmill.llm.common import SPACES, free, table, written

#: A line is boilerplate of a host if at least MIN_DOCS different texts of it hold the line, and over MAX_SHARE of them; or if
#: MOST_DOCS hold it, whatever the size of the host: a share alone lets through more copies of a line the larger a host is.
MIN_DOCS, MAX_SHARE, MOST_DOCS = 20, 0.3, 20
#: A document is depleted if fewer words are left, or a smaller share of its words.
MIN_WORDS, MIN_LEFT = 10, 0.2
SYMBOLS = "#*$%&|<>"
#: Texts of more words find their windows by numbers of words and not by tuples: a bounded number of bytes a word.
LONG = 20_000
SCHEMA = "doc_id long, __text long, __host long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: list[bytes], k: int = 5) -> int:
    """Words in k-word windows that come twice or more, the first included."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    if n <= LONG:
        windows = list(zip(*(words[i:] for i in range(k)), strict=False))
        if len(set(windows)) == n:
            return 0
        counts = Counter(windows)
        again = np.fromiter((counts[w] > 1 for w in windows), bool, n)
    else:
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
        now, size = ids, len(seen)
        for i in range(1, k):  # exact: pairs of a window's number so far and its next word are numbered anew
            found, now = np.unique(now[:-1] * len(seen) + ids[i:], return_inverse=True)
            size = len(found)
        again = np.bincount(now, minlength=size)[now] > 1
    covered = np.zeros(len(words), bool)
    for i in range(k):
        covered[i : i + n] |= again
    return int(covered.sum())


def figures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [figures(x.as_py() or "") for x in batch.column(3)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "__text", "__host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def _line_words(line: Column) -> Column:
    return (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1).cast("long")


def _normal(line: Column) -> Column:
    """A line or a text as its lines are compared: in lower case, runs of white space one space; lines are trimmed after."""
    flat = F.lower(line)
    for c in "\t\v\f\r":
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return flat


def without_lines(text: Column, bad: Column) -> Column:
    """The text without the lines whose normalised hash is in bad; other lines stay as they are."""
    hashed = lambda line: F.xxhash64(F.trim(F.regexp_replace(_normal(line), " +", " ")))
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.array_contains(bad, hashed(line))), "\n")


def _lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, __text, __host, text) as lines that have a word: normalised, hashed, with their words."""
    rows = docs.select("doc_id", "__text", "__host", _normal(F.col("text")).alias("flat"))
    flat = F.when(F.contains("flat", F.lit("  ")), F.regexp_replace("flat", " +", " ")).otherwise(F.col("flat"))
    rows = rows.select("doc_id", "__text", "__host", F.explode(F.split(flat, "\n")).alias("line"))
    rows = rows.select("doc_id", "__text", "__host", F.trim("line").alias("line")).where("line <> ''")
    return rows.select("doc_id", "__text", "__host", F.xxhash64("line").alias("__line"), _line_words(F.col("line")).alias("words"))


def frequent_lines(lines: DataFrame, min_docs: int, max_share: float, most_docs: int = MOST_DOCS) -> DataFrame:
    """(__host, __line) of boilerplate. Different texts are counted: distinct (host, line, text) first, then texts a line."""
    held = lines.select("__host", "__line", "__text").distinct().groupBy("__host", "__line").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {min_docs}")
    texts = lines.select("__host", "__text").distinct().groupBy("__host").agg(F.count(F.lit(1)).alias("texts"))
    return held.join(texts, "__host").where(f"n > {max_share} * texts OR n >= {most_docs}").select("__host", "__line")


def _judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_words: int = MIN_WORDS, min_left: float = MIN_LEFT, most_docs: int = MOST_DOCS) -> DataFrame:
    """The columns of quality, and __bad: the hashes of the lines to remove, null where there are none."""
    text, host = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(host_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("__text"), F.xxhash64(host.isNull(), F.coalesce(host, F.lit(""))).alias("__host"), text.alias("text"))
    lines = _lines(rows)
    frequent = written(frequent_lines(lines, min_docs, max_share, most_docs), "quality-lines")
    # sums by (id, text): rows that repeat both are counted here and dealt out again
    removed = lines.join(frequent, ["__host", "__line"]).groupBy("doc_id", "__text", "__host").agg(F.sum("words").alias("gone"), F.collect_set("__line").alias("__bad"))
    keys = ["doc_id", "__text", "__host"]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    base = rows.select("doc_id", "__text", "__host", "text").mapInArrow(_figures, SCHEMA).groupBy(*keys).agg(*(F.first(n).alias(n) for n in names), F.count(F.lit(1)).alias("copies"))
    removed = removed.select(*(F.col(k).alias(f"r{k}") for k in keys), "gone", "__bad")
    same = base["doc_id"].eqNullSafe(F.col("rdoc_id")) & (F.col("__text") == F.col("r__text")) & (F.col("__host") == F.col("r__host"))
    out = base.join(removed, same, "left").withColumn("n_removed_words", F.coalesce(F.expr("gone DIV copies"), F.lit(0).cast("long")))
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).withColumn("left", F.col("n_words") - F.col("n_removed_words"))
    kept = ~F.col("base_failed") & (F.col("left") >= min_words) & (F.col("left") >= F.lit(min_left) * F.col("n_words"))
    out = out.select("doc_id", *names, "base_failed", kept.alias("kept"), "n_removed_words", "__text", "__host", "__bad", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    return out.drop("copy")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_words: int = MIN_WORDS, min_left: float = MIN_LEFT, most_docs: int = MOST_DOCS) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_removed_words (words in lines that the host's other documents also hold too often).

    base_failed: fewer than 10 words, or over 20 % of the words in windows that repeat. A document that passes is kept unless
    removal leaves fewer than min_words words or less than min_left of them. Null and empty texts have no words and fail.
    Null hosts are one host, empty names another. Repeated rows are returned as often as they come, and count once as texts.
    No rows give none. Other columns are not read.
    """
    return _judged(docs, id_col, text_col, host_col, min_docs, max_share, min_words, min_left, most_docs).drop("__bad")


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", chars_col: str = "n_chars", **limits) -> DataFrame:
    """The rows of docs that quality keeps, with all columns, whatever their names, and their text without the frequent lines of
    their host. Texts without such lines stay as they are; where lines go, chars_col, if there is one, becomes the length of
    what is left."""
    own, own_text, own_host, kept, bad, hashed, placed = free(docs, "__id", "__t", "__h", "__kept", "__bad", "__text", "__host")
    text, host = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(host_col).cast("string")
    # one row for each (id, text, host) that is dropped or loses lines
    fate = _judged(docs, id_col, text_col, host_col, **limits).where("NOT kept OR __bad IS NOT NULL").groupBy(F.col("doc_id").alias(own), F.col("__text").alias(own_text), F.col("__host").alias(own_host))
    fate = written(fate.agg(F.first("kept").alias(kept), F.first("__bad").alias(bad)), "quality-fate")
    rows = docs.withColumns({hashed: F.xxhash64(text), placed: F.xxhash64(host.isNull(), F.coalesce(host, F.lit("")))})
    # merge: both sides grow with the input, so the plan is the same at every size
    rows = rows.join(fate.hint("merge"), rows[id_col].eqNullSafe(F.col(own)) & (F.col(hashed) == F.col(own_text)) & (F.col(placed) == F.col(own_host)), "left").where(F.coalesce(kept, F.lit(True)))
    left = F.when(F.col(bad).isNull(), F.col(text_col)).otherwise(without_lines(text, F.col(bad)))
    rows = rows.withColumn(text_col, left)
    if chars_col in docs.columns:
        rows = rows.withColumn(chars_col, F.when(F.col(bad).isNull(), F.col(chars_col)).otherwise(F.length(text_col)).cast(docs.schema[chars_col].dataType))
    return rows.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the whole documents table."""
    return quality(table(spark, sf_dir, "documents")).drop("__text", "__host")
