"""Clones of functions: equal text, equal up to names, similar shingles."""

from __future__ import annotations

import ast
import functools
import math
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffmill.tables import written

TOKENS = r"[\p{L}_][\p{L}\p{N}_]*|\p{N}+|[^\s\p{L}\p{N}_]"
SHINGLE, LEAST = 5, 0.8
LEAST_LINES, LEAST_TOKENS = 3, 20
#: Common shingles are in OFTEN texts or more of every SAMPLE-th text; COMMON of them at most are told. Shingles of a side of a cell.
SAMPLE, OFTEN, COMMON, CELL = 16, 4, 1 << 20, 1 << 22
#: Shared shingles that a candidate needs: MET, and one more for each MET_EACH of a set. SLACK keeps products of fractions from rounding up.
MET, MET_EACH, SLACK = 4, 32, 1e-9
#: Bytes of text that are hashed at once, or shingles that are compared; rows of a text in a part of the result's last join.
PART, ROWS = 1 << 18, 256


def content_hash(text: Column) -> Column:
    """Hash of a text whose white space is collapsed."""
    return F.sha2(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 256)


def is_eligible(text: Column) -> Column:
    """Long enough to be a clone: by lines or by words."""
    words = F.filter(F.split(F.trim(text), r"(?U)\s+"), lambda x: x != "")
    return (F.size(F.split(text, "\n")) >= LEAST_LINES) | (F.size(words) >= LEAST_TOKENS)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))


@F.pandas_udf(T.StringType())
def renamed_hash(text: pd.Series) -> pd.Series:
    """Hash of a text's tokens with identifiers renamed by first appearance, for languages without a parser here. One pass over
    each text; higher-order functions would look each token up among all names."""
    import hashlib

    import regex

    find = regex.compile(r"[\p{L}_][\p{L}\p{N}_]*|\p{N}+|[^\s\p{L}\p{N}_]").findall

    def one(source: str | None) -> str:
        seen: dict[str, str] = {}
        return hashlib.md5(" ".join(seen.setdefault(t, f"v{len(seen)}") if t[0].isalpha() or t[0] == "_" else t for t in find(source or "")).encode()).hexdigest()

    return text.map(one)


@F.pandas_udf(T.StringType())
def python_alpha_hash(text: pd.Series) -> pd.Series:
    """Hash of Python source with names by first appearance; null where it does not parse."""
    import hashlib

    def one(source: str | None) -> str | None:
        try:
            tree = ast.parse(source or "")
        except (SyntaxError, ValueError):
            return None
        seen: dict[str, str] = {}
        parts = []
        for node in ast.walk(tree):
            for field in ("id", "name", "arg", "attr"):
                if isinstance(value := getattr(node, field, None), str):
                    parts.append(seen.setdefault(value, f"v{len(seen)}"))
            parts.append(type(node).__name__ + (repr(node.value) if isinstance(node, ast.Constant) else ""))
        return hashlib.sha256(" ".join(parts).encode()).hexdigest()

    return text.map(one)


def flagged(chunks: DataFrame, key: str) -> DataFrame:
    """Chunks of a key that lies in two paths or more, but for the first by seq: with the path and seq of that first one.
    Aggregation and join, so a key of very many chunks is combined before it is shuffled."""
    first = chunks.groupBy(key).agg(F.min_by("path", "seq").alias("first_path"), F.min("seq").alias("first_seq"), F.min("path").alias("a"), F.max("path").alias("b")).where("a <> b").drop("a", "b")
    return chunks.join(first, key).where("seq <> first_seq")


@functools.cache
def _kinds() -> np.ndarray:
    """What TOKENS takes a code point for, as the SQL does (Unicode 15.0, no vertical tab in \\s): 0 white space, 1 letter or _, 2 number, 3 other."""
    kinds = np.array([{"L": 1, "N": 2}.get(unicodedata.category(chr(i))[0], 3) for i in range(sys.maxunicode + 1)], "uint8")
    kinds[0x2EBF0:0x2EE5E] = 3
    kinds[ord("_")] = 1
    kinds[[ord(c) for c in "\t\n\f\r "]] = 0
    return kinds


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit words, mixed in place one to one."""
    x += np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def _shingled(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of k tokens. Tokens are those of TOKENS, found and hashed for all texts at once:
    a token is the sum of its mixed (place, code point)."""
    texts = [(x or b"").decode("utf-8", "replace") for x in texts]
    ends = np.cumsum([len(x) + 1 for x in texts])
    points = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le"), "uint32")
    kind = _kinds()[points]
    before = np.r_[np.uint8(0), kind[:-1]]
    word, number = kind == 1, kind == 2
    first = number & (before != 2)
    if first.any():
        # numbers after a letter are of its word, and what follows them too
        inside = number & (before[first] == 1)[np.maximum(np.cumsum(first) - 1, 0)]
        word |= inside
        first &= ~inside
    start = np.flatnonzero((kind == 3) | first | (word & ~np.r_[False, word[:-1]]))
    if len(start) < k:
        return [np.zeros(0, "int64")] * len(texts)
    place = np.arange(start[0], len(points)) - np.repeat(start, np.diff(start, append=len(points)))
    x = _mixed((place.astype("uint64") << np.uint64(21)) | points[start[0] :])
    x[kind[start[0] :] == 0] = 0
    token = np.add.reduceat(x, start - start[0])
    hashes = np.zeros(len(token) - k + 1, "uint64")
    for i in range(k):
        hashes += token[i : i + len(hashes)]
        _mixed(hashes)
    hashes, out = hashes.view("int64"), []
    bounds = np.searchsorted(start, np.r_[0, ends])
    for low, high in zip(bounds[:-1], bounds[1:]):
        own = np.sort(hashes[low : max(low, high - k + 1)])
        kept = np.ones(len(own), bool)
        np.not_equal(own[1:], own[:-1], out=kept[1:])
        out.append(own[kept])
    return out


def _sets(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            part = np.cumsum([len(x or b"") for x in texts]) // PART
            cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(texts)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                found = _shingled(texts[low:high], k)
                n = np.array([len(x) for x in found], "int32")
                kept = pa.array(np.flatnonzero(n) + low)
                hashes = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n[n > 0])], pa.int32()), pa.array(np.concatenate([np.zeros(0, "int64"), *found])))
                yield pa.RecordBatch.from_arrays([batch.column("seq").take(kept), batch.column("path").take(kept), hashes, pa.array(n[n > 0])], ["seq", "path", "hashes", "n"])

    return sets


def shingle_sets(chunks: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(seq, path, hashes, n): the sorted set of 64-bit hashes of a text's shingles of k tokens, and its size; shorter texts have none.
    Texts are hashed by columns of code points, many texts at once: no shuffle, and no token is made on its own."""
    schema = T.StructType([chunks.schema["seq"], chunks.schema["path"], T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("n", T.IntegerType())])
    return chunks.select("seq", "path", "text").mapInArrow(_sets(k), schema)


def shingles(chunks: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Distinct (seq, path, shingle) of k tokens, each shingle as its hash."""
    return shingle_sets(chunks, k).select("seq", "path", F.explode("hashes").alias("shingle"))


def _heads(least: float, common: np.ndarray):
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shingles of each set that come first in the order: those not common before common ones, then by hash. So many that a
        similar set has MET + n // MET_EACH of them among its own."""
        told = np.zeros(1 << 20, bool)
        told[common.view("uint64") >> np.uint64(44)] = True
        for batch in batches:
            flat, ends = batch.column("hashes").flatten().to_numpy(zero_copy_only=False), np.cumsum(batch.column("n").to_numpy(), dtype="int64")
            starts, first = np.r_[0, ends[:-1]], [np.zeros(0, "int64")]
            if not np.isin(np.flatnonzero(flat[1:] < flat[:-1]) + 1, starts).all():
                flat = np.concatenate([np.sort(flat[start:end]) for start, end in zip(starts, ends)])
            # few shingles have the first bits of a common one: only those are looked up
            seen = told[flat.view("uint64") >> np.uint64(44)]
            if len(common):
                at = np.flatnonzero(seen)
                seen[at] = common[np.minimum(np.searchsorted(common, flat[at]), len(common) - 1)] == flat[at]
            some = np.add.reduceat(seen, starts, dtype="int64") if len(ends) else starts
            for start, end, many in zip(starts.tolist(), ends.tolist(), some.tolist()):
                n, own = end - start, flat[start:end]
                alike = math.ceil(least * n - SLACK)
                if many:
                    own = np.concatenate([own[~seen[start:end]], own[seen[start:end]]])
                first.append(own[: n - alike + min(alike, MET + n // MET_EACH)])
            offsets = np.cumsum([len(x) for x in first])
            values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(first)))
            yield pa.RecordBatch.from_arrays([*batch.select(["text_id", "seq", "path", "n"]).columns, values], ["text_id", "seq", "path", "n", "heads"])

    return heads


def _met(least: float):
    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(text_a, text_b, both, need) of a partition that is dealt by shingle, texts of a shingle with each other; counts are summed
        for up to CELL pairs at once. A partition has about CELL rows at most."""
        names = ["shingle", "text_id", "n", "only"]
        held = pa.Table.from_batches([x.select(names) for x in batches] or [pa.RecordBatch.from_pylist([], pa.schema([(x, pa.int64()) for x in names]))])
        shingle = held.column("shingle").to_numpy()
        order = np.argsort(shingle, kind="stable")
        shingle = shingle[order]
        new = np.ones(len(shingle) + 1, bool)
        np.not_equal(shingle[1:], shingle[:-1], out=new[1:-1])
        shared = ~(new[:-1] & new[1:])
        held, new = held.take(pa.array(order[shared])), new[:-1][shared]
        texts, text = np.unique(held.column("text_id").to_numpy(), return_inverse=True)
        n, one = held.column("n").to_numpy().astype("int64"), held.column("only").is_valid().to_numpy()
        only = held.column("only").fill_null(0).to_numpy()
        sizes = np.zeros(len(texts), "int64")
        sizes[text] = n
        ends = np.r_[np.flatnonzero(new)[1:], len(new)]
        end = np.repeat(ends, np.diff(np.r_[0, ends])) if len(new) else np.zeros(0, "int64")

        def counted(found: list[np.ndarray]) -> pa.RecordBatch:
            keys, both = np.unique(np.concatenate(found), return_counts=True)
            low, high = keys >> 32, keys & 0xFFFFFFFF
            smaller = np.minimum(sizes[low], sizes[high])
            need = np.minimum(np.ceil(smaller * least - SLACK).astype("int64"), MET + smaller // MET_EACH)
            return pa.RecordBatch.from_arrays([pa.array(texts[low]), pa.array(texts[high]), pa.array(both), pa.array(need)], ["text_a", "text_b", "both", "need"])

        found, total, step, at = [], 0, 0, np.arange(len(new))
        while len(at := at[at + (step := step + 1) < end[at]]):
            for x in np.array_split(at, -(-len(at) // CELL)):
                y = x + step
                x, y = x[kept := (np.minimum(n[x], n[y]) >= least * np.maximum(n[x], n[y]) - SLACK) & ~(one[x] & one[y] & (only[x] == only[y]))], y[kept]
                found.append(np.minimum(text[x], text[y]) << 32 | np.maximum(text[x], text[y]))
                total += len(x)
                if total > CELL:
                    yield counted(found)
                    found, total = [], 0
        if total:
            yield counted(found)

    return met


def _checked(least: float):
    def checked(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        """Similarities of a cell's pairs, exactly, on the sets that they are of: a set is marked once, and all its partners are counted together."""
        sets = sets.combine_chunks().sort_by("text_id")
        ids, hashes = sets.column("text_id").to_numpy(), sets.column("hashes").combine_chunks()
        sizes = pc.list_value_length(hashes).to_numpy(zero_copy_only=False).astype("int64")
        starts = np.cumsum(sizes) - sizes
        names, code = np.unique(hashes.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        pairs = pairs.select(["text_a", "text_b"]).sort_by("text_a")
        a, b = (np.searchsorted(ids, pairs.column(x).to_numpy()) for x in ("text_a", "text_b"))
        marked, both = np.zeros(len(names), bool), np.zeros(len(a), "int64")
        runs = np.r_[0, np.flatnonzero(np.diff(a)) + 1, len(a)]
        for low, high in zip(runs[:-1], runs[1:]):
            own = code[starts[a[low]] : starts[a[low]] + sizes[a[low]]]
            marked[own] = True
            step = np.cumsum(sizes[b[low:high]]) // PART
            cuts = low + np.r_[0, np.flatnonzero(np.diff(step)) + 1, high - low]
            for x, y in zip(cuts[:-1], cuts[1:]):
                to = b[x:y]
                at = np.cumsum(sizes[to]) - sizes[to]
                both[x:y] = np.add.reduceat(marked[code[np.repeat(starts[to] - at, sizes[to]) + np.arange(sizes[to].sum())]], at, dtype="int64")
            marked[own] = False
        found = both / (sizes[a] + sizes[b] - both)
        parts = sets.column("parts").combine_chunks()
        out = pairs.append_column("jaccard", pa.array(found)).append_column("parts_a", parts.take(pa.array(a))).append_column("parts_b", parts.take(pa.array(b)))
        return out.filter(pa.array(found >= least))

    return checked


def similar_pairs(sets: DataFrame, least: float = LEAST, chunks: DataFrame | None = None) -> DataFrame:
    """Pairs (seq_a < seq_b) of different paths with a Jaccard similarity of least or more, of sets as shingle_sets gives them,
    or of distinct rows as shingles does. Where the chunks of the sets are given, only those needed are made into sets again.

    By prefix filter: in any one order of all shingles, two sets that similar share m of their first n - ceil(least * n) + m. The
    order is by hash, with common shingles last, as their pairs would grow with the square of their documents. Which ones are common
    is told from every SAMPLE-th text: that decides what the order costs, and not what it finds. Equal sets are one text, and are
    expanded into pairs of rows only in the result, in parts of about ROWS rows. So of each set only the first shingles are kept and
    shuffled, and of texts with a candidate the sets, once for each cell of pairs that has them."""
    if "hashes" not in sets.columns:
        sets = written(sets.groupBy("seq", "path").agg(F.array_sort(F.collect_list("shingle")).alias("hashes"), F.count(F.lit(1)).cast("int").alias("n")), "clone-sets")
    named = lambda df: df.withColumn("text_id", F.xxhash64("hashes"))
    sampled = named(sets).where(F.pmod("text_id", F.lit(SAMPLE)) == 0) if chunks is None else shingle_sets(chunks.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0))
    rows = sampled.select(F.explode("hashes").alias("shingle"))
    common = rows.groupBy("shingle").count().where(F.col("count") >= OFTEN).orderBy(F.col("count").desc(), "shingle").limit(COMMON).select("shingle").toPandas()["shingle"]
    common = np.sort(common.to_numpy("int64"))
    schema = T.StructType([T.StructField("text_id", T.LongType()), *(sets.schema[x] for x in ("seq", "path", "n")), T.StructField("heads", T.ArrayType(T.LongType()))])
    rows = written(named(sets).select("text_id", "seq", "path", "n", "hashes").mapInArrow(_heads(least, common), schema), "clone-rows")
    texts = rows.groupBy("text_id", "n").agg(F.min("seq").alias("seq"), F.min("path").alias("low"), F.max("path").alias("high"), F.count(F.lit(1)).alias("copies"))
    texts = texts.withColumn("parts", F.ceil(F.col("copies") / ROWS).cast("int"))
    texts = written(texts, "clone-texts")
    # a text of several rows is found by its first one; a path is known by its hash, if a text has one alone
    copied = texts.where("copies > 1").select("text_id", F.col("seq").alias("first"), (F.col("low") != F.col("high")).alias("several"))
    n_copied, n_heads = copied.count(), rows.agg(F.coalesce(F.sum(F.size("heads")), F.lit(0))).first()[0]
    heads = rows.join(F.broadcast(copied) if n_copied <= COMMON else copied, "text_id", "left").where("first IS NULL OR seq = first")
    heads = heads.select("text_id", F.col("n").cast("long").alias("n"), F.when(~F.coalesce("several", F.lit(False)), F.xxhash64("path")).alias("only"), F.explode("heads").alias("shingle"))
    parts = max(-(-n_heads // CELL), int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = heads.repartition(parts, "shingle").mapInArrow(_met(least), "text_a long, text_b long, both long, need long")
    pairs = written(met.groupBy("text_a", "text_b").agg(F.sum("both").alias("both"), F.min("need").alias("need")).where("both >= need").select("text_a", "text_b"), "clone-pairs")
    # texts that are alike have mostly one least text in common, and so a cell; what is too large for one has many
    ends = pairs.select(F.explode(F.array(F.struct(F.col("text_a").alias("text_id"), F.col("text_a").alias("near")), F.struct(F.col("text_b").alias("text_id"), F.col("text_a").alias("near")))).alias("x")).select("x.*")
    used = written(texts.join(ends.groupBy("text_id").agg(F.min("near").alias("near")), "text_id").select("text_id", "seq", "n", "parts", "near"), "clone-used")
    size, n_used = used.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    side, most = max(1, -(-size // CELL)), max(1, CELL // 4)
    large = used.groupBy("near").agg(F.ceil(F.sum("n") / most).alias("cells")).where("cells > 1")
    own_cell = F.xxhash64("near", F.pmod(F.xxhash64("text_id"), "cells"))
    cells = used.join(F.broadcast(large), "near", "left").select("text_id", F.when(F.col("cells").isNull(), F.pmod(F.xxhash64("near"), F.lit(side))).otherwise(own_cell).alias("cell"))
    known = lambda x: F.broadcast(x) if n_used <= COMMON else x
    for text, place in (("text_a", "i"), ("text_b", "j")):
        pairs = pairs.join(known(cells.select(F.col("text_id").alias(text), F.col("cell").alias(place))), text)
    pairs = pairs.select("text_a", "text_b", "i", "j")
    places = pairs.select(F.explode(F.array("text_a", "text_b")).alias("text_id"), F.col("i").alias("si"), F.col("j").alias("sj")).distinct()
    if chunks is not None:
        sets = shingle_sets(chunks.join(known(used.select("seq")), "seq"))
    own = written(named(sets).join(known(used.select("text_id", "seq", "parts")), ["text_id", "seq"]).select("text_id", "hashes", "parts"), "clone-sets")
    links = pairs.groupBy("i", "j").cogroup(places.join(own, "text_id").groupBy("si", "sj")).applyInArrow(_checked(least), "text_a long, text_b long, jaccard double, parts_a int, parts_b int")
    links = written(links, "clone-links")
    copies = texts.where("low <> high").select(F.col("text_id").alias("text_a"), F.col("text_id").alias("text_b"), F.lit(1.0).alias("jaccard"), F.col("parts").alias("parts_a"), F.col("parts").alias("parts_b"))
    links = links.unionByName(copies)
    # a text's rows in parts, so that the pairs of a text of many rows are made in many tasks
    links = links.withColumn("part_a", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1))).withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)))
    links = links.where("text_a <> text_b OR part_a <= part_b").select("text_a", "text_b", "jaccard", "part_a", "part_b")
    part = F.pmod(F.xxhash64("seq"), F.col("parts")).cast("int")
    members = rows.select("text_id", "seq", "path").join(texts.select("text_id", "parts"), "text_id").groupBy("text_id", part.alias("part")).agg(F.collect_list(F.struct("seq", "path")).alias("rows"))
    x, y = (members.select(F.col("text_id").alias(f"text_{e}"), F.col("part").alias(f"part_{e}"), F.col("rows").alias(f"rows_{e}")) for e in "ab")
    found = links.join(x.hint("merge"), ["text_a", "part_a"]).join(y.hint("merge"), ["text_b", "part_b"])
    found = found.withColumn("a", F.explode("rows_a")).withColumn("b", F.explode("rows_b")).where("a.path <> b.path AND (text_a <> text_b OR part_a < part_b OR a.seq < b.seq)")
    return found.select(F.least("a.seq", "b.seq").alias("seq_a"), F.greatest("a.seq", "b.seq").alias("seq_b"), "jaccard")


def components(edges: DataFrame) -> DataFrame:
    """(g, u, v): the smallest node v that each other node u of a component reaches, of edges (g, u, v) with u > v. By alternating
    stars: each round joins a node's neighbours to the smallest of them, so a group of many links is a star after the first."""
    least = lambda e: e.groupBy("g", "u").agg(F.min("v").alias("m"))
    while True:
        low = least(edges)
        small = edges.join(low, ["g", "u"]).where("v <> m").select("g", F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v")).distinct()
        edges = written(small, "components")
        # stars already: one link of each node, and to a node that has none itself
        if edges.groupBy("g", "u").count().where("count > 1").isEmpty() and edges.join(edges.select("g", F.col("u").alias("v")), ["g", "v"], "left_semi").isEmpty():
            return edges
        both = edges.unionByName(edges.select("g", F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), ["g", "u"]).where("v > u").select("g", F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        edges = written(large, "components")


def _walk(ends: tuple[str, str], keys: tuple[str, str]):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Takes pairs whose ends are both free, in the order they come; of a component, only the ends in use are held."""
        at, used = None, set()
        for batch in batches:
            taken = []
            for key, a, b in zip(zip(*(batch.column(k).to_pylist() for k in keys)), *(batch.column(e).to_pylist() for e in ends)):
                if key != at:
                    at, used = key, set()
                taken.append(a not in used and b not in used)
                if taken[-1]:
                    used.update((a, b))
            yield batch.filter(pa.array(taken, pa.bool_()))

    return walk


def greedy(pairs: DataFrame, group: str) -> DataFrame:
    """Pairs in order of which each chunk is in one at most, by group: what is decided first shuts out what comes later.

    Components of linked chunks are independent of each other, so each is walked in order by one task, which reads its sorted
    pairs as a stream. Rounds over all pairs at once would be half as many as the largest group of copies has members."""
    pairs = written(pairs.where("seq_a <> seq_b"), "greedy-pairs")
    top = F.greatest("seq_a", "seq_b")
    roots = components(pairs.select(F.col(group).alias("g"), top.alias("u"), F.least("seq_a", "seq_b").alias("v")))
    rows = pairs.withColumn("__top", top).join(roots.select(F.col("g").alias(group), F.col("u").alias("__top"), F.col("v").alias("__root")), [group, "__top"])
    rows = rows.select(*pairs.columns, "__root").repartition(group, "__root").sortWithinPartitions(group, "__root", "seq_a", "seq_b")
    return rows.mapInArrow(_walk(("seq_a", "seq_b"), (group, "__root")), rows.schema).select(*pairs.columns)
