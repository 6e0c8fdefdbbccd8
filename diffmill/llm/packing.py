"""Packing documents into sequences by cutting-stock column generation.

Tokenising cuts each document into pieces of the sequence length and one rest, and knows each piece's checksum, so the ids
themselves are never written or shuffled. Rests are counted by length class. The classes are few and fixed, so the plan is
made on the driver from a table of a fixed size: a linear program over patterns (how many rests of each class fill a
sequence), whose columns are priced by a knapsack's dynamic program over the dual values. Whole parts of the solution are
taken as they are; what rounding leaves, at most a few sequences a pattern, is packed first-fit by falling length. Rests
are ranked within their class by counts of (class, part), and a rank says which pattern and which copy of it holds the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffmill.llm import tokens
from diffmill.llm.common import partitions, table, written

#: Tokens in a sequence; tokens in a length class; the id that ends a document.
LENGTH, GRAIN, END_ID = 2048, 16, 1
#: Column generation ends when no pattern is worth more than this over the sequence it takes, or after so many columns.
GAP, COLUMNS = 1e-6, 4_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, length: int, end_id: int) -> Iterator[pa.RecordBatch]:
    words = tokens.once(("words", path), lambda: tokens.WordEncoder(path))
    end = end_id.to_bytes(4, "little")
    for batch in batches:
        rows: list[tuple[int | None, int, int, int, int]] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = words.ids(text.as_py()) + end
            n = len(ids) // 4
            view = memoryview(ids)
            rows += [(doc, a, min(length, n - a), zlib.crc32(view[4 * a : 4 * (a + length)]), n) for a in range(0, n, length)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 5)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens. All pieces but a document's last are full."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_pieces, path=tokenizer, length=length, end_id=end_id), PIECES)


def best_pattern(values: np.ndarray, sizes: np.ndarray, room: int, most: np.ndarray) -> tuple[float, np.ndarray]:
    """The pattern of most value that fits in the room, by dynamic programming over the room; most bounds each count."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(-values / sizes, kind="stable")
    order = order[values[order] > 1e-12]
    sizes_, values_ = sizes[order], values[order]
    for r in range(1, room + 1):
        fit = sizes_ <= r
        if not fit.any():
            continue
        gains = np.where(fit, best[np.maximum(r - sizes_, 0)] + values_, -1.0)
        k = int(gains.argmax())
        if gains[k] > best[r - 1] + 1e-15:
            best[r], choice[r] = gains[k], order[k]
        else:
            best[r], choice[r] = best[r - 1], -2
    pattern, r = np.zeros(len(sizes), np.int64), room
    while r > 0 and choice[r] != -1:
        if choice[r] == -2:
            r -= 1
        else:
            pattern[choice[r]] += 1
            r -= int(sizes[choice[r]])
    return float(best[room]), np.minimum(pattern, most)


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by elimination with row pivots. The matrix has a row for each length class at most, and a linear algebra
    library that starts threads of its own on the driver may wait for cores that Spark's tasks hold."""
    m = len(matrix)
    work = np.hstack([matrix.astype(float), np.eye(m)])
    for i in range(m):
        top = i + int(np.abs(work[i:, i]).argmax())
        if top != i:
            work[[i, top]] = work[[top, i]]
        work[i] /= work[i, i]
        factors = work[:, i].copy()
        factors[i] = 0.0
        work -= factors[:, None] * work[i][None, :]
    return work[:, m:]


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often the linear program uses each: least sequences that hold the demand. Revised simplex: the
    basis starts with patterns of one class each, and the pattern that the knapsack finds best enters."""
    m = len(sizes)
    full = np.minimum(room // sizes, np.maximum(demand, 1))
    basis = np.diag(full.astype(float))
    inverse = np.diag(1 / full)
    x = demand / full
    for turn in range(1, COLUMNS + 1):
        if turn % 256 == 0:  # against the rounding errors of many updates
            inverse = inverted(basis)
            x = np.maximum((inverse * demand).sum(axis=1), 0.0)
        duals = inverse.sum(axis=0)
        worth, pattern = best_pattern(duals, sizes, room, np.full(m, room))
        if worth <= 1 + GAP:
            break
        direction = (inverse * pattern).sum(axis=1)
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = x[up] / direction[up]
        out = int(ratio.argmin())
        step = ratio[out]
        x = x - step * direction
        x[out] = step
        basis[:, out] = pattern
        pivot = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, pivot)
        inverse[out] = pivot
    return [(basis[:, i].astype(np.int64), max(float(x[i]), 0.0)) for i in range(m)]


def first_fit(sizes: np.ndarray, left: np.ndarray, room: int) -> list[np.ndarray]:
    """Patterns for what is left, by falling size; by class, as equal sizes fit alike."""
    bins: list[np.ndarray] = []
    rooms: list[int] = []
    for k in np.argsort(-sizes, kind="stable").tolist():
        n, size = int(left[k]), int(sizes[k])
        for i, r in enumerate(rooms):
            if not n:
                break
            if (fit := min(n, r // size)) > 0:
                bins[i][k] += fit
                rooms[i] -= fit * size
                n -= fit
        while n > 0:
            fit = min(n, room // size)
            bins.append(np.zeros(len(sizes), np.int64))
            bins[-1][k] = fit
            rooms.append(room - fit * size)
            n -= fit
    return bins


def plan(demand: dict[int, int], length: int = LENGTH, grain: int = GRAIN) -> list[tuple[int, dict[int, int]]]:
    """(copies, pattern) that hold the demand exactly: numbers of rests by class (class c has rests of at most c * grain
    tokens). Patterns hold what is asked and no more."""
    classes = sorted(c for c, n in demand.items() if n)
    if not classes:
        return []
    sizes, left = np.array(classes, np.int64), np.array([demand[c] for c in classes], np.int64)
    room = length // grain
    out: list[tuple[int, np.ndarray]] = []
    for pattern, times in sorted(column_generation(sizes, left, room), key=lambda x: -x[1]):
        held = pattern > 0
        copies = min(int(times + 1e-9), *(left[held] // pattern[held]).tolist()) if held.any() else 0
        if copies > 0:
            out.append((copies, pattern))
            left = left - copies * pattern
    out += [(1, p) for p in first_fit(sizes, left, room)]
    return [(n, {classes[k]: int(p[k]) for k in np.flatnonzero(p)}) for n, p in out]


def _assign(batches: Iterator[pa.RecordBatch], rules: dict) -> Iterator[pa.RecordBatch]:
    """sequence_id and place of ranked rests. rules: class -> (first ranks, first sequences, copies, place in the pattern)."""
    for batch in batches:
        kind, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
        sequence, place = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
        for c in np.unique(kind).tolist():
            own = kind == c
            ranks, first, copies, places = rules[c]
            at = np.searchsorted(ranks, rank[own], side="right") - 1
            past = rank[own] - ranks[at]
            sequence[own] = first[at] + past % copies[at]
            place[own] = places[at] + past // copies[at]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(place)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "place"])


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, grain: int = GRAIN, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and end_id. Pieces of a full sequence are one by themselves; the rests share sequences, and
    offsets in a sequence have no gaps. sequence_id is gapless from 0. Null and empty texts are end_id alone. Repeated rows
    and null ids are packed like others. No rows give none. grain has to divide length. Other columns are not read.
    """
    if length % grain:
        raise ValueError("grain has to divide length")
    spark = docs.sparkSession
    n = partitions(spark)
    own = f"pmod(xxhash64(doc_id, start, ids_crc32), {n})"
    found = written(pieces(docs, tokenizer, length, end_id, id_col, text_col).selectExpr("*", f"if(length = {length}, 0, CAST(ceil(length / {grain}) AS INT)) AS class", f"CAST({own} AS INT) AS part"), "pieces")
    # ranks: the rows of a (class, part) are numbered in one task, and start where the parts before them end
    counts = written(found.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.expr("sum(n) OVER (PARTITION BY class ORDER BY part) - n")), "piece-counts")
    demand = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # length / grain rows at most
    full = demand.pop(0, 0)
    at, rules = full, {}
    ranks: dict[int, int] = {}
    for copies, pattern in plan(demand, length, grain):
        place = 0
        for c, a in sorted(pattern.items(), reverse=True):
            rules.setdefault(c, []).append((ranks.get(c, 0), at, copies, place))
            ranks[c] = ranks.get(c, 0) + a * copies
            place += a
        at += copies
    rules = {c: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for c, rows in rules.items()}
    ordered = "row_number() OVER (PARTITION BY class, part ORDER BY length DESC, doc_id, start, ids_crc32) - 1"
    ranked = found.selectExpr("*", f"{ordered} AS own").join(counts.select("class", "part", "before"), ["class", "part"]).withColumn("rank", F.col("own") + F.col("before"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = ranked.where("class = 0").select(*columns, F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    shared = ranked.where("class > 0").select(*columns, "class", F.col("rank").cast("long").alias("rank"))
    shared = shared.mapInArrow(partial(_assign, rules=rules), PIECES + ", sequence_id long, place long")
    shared = shared.selectExpr(*columns, "sequence_id", "sum(length) OVER (PARTITION BY sequence_id ORDER BY place ROWS UNBOUNDED PRECEDING) - length AS offset")
    return whole.union(shared)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the whole documents table."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
