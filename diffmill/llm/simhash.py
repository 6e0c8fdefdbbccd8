"""SimHash near-dedup with bit-sliced comparison.

Fingerprints come from one pass over the texts; from there on only distinct fingerprints move. Two of them within the
radius agree in at least one of radius + 1 bit ranges, so each is dealt out once by the value of each range; values that
many share are dealt once more by ranges of their other bits. A worker reads its rows in the order of their keys and
compares the fingerprints of a key with bit planes: plane b holds bit b of all of them, 64 to a machine word. The planes
of differences are added into carry-save counters, and a block is abandoned as soon as all its distances exceed the radius.
Of the links in a key only a spanning forest leaves the worker, so output grows with the rows and not with pairs; it has
the same components as all links. Components are found by alternating star contraction over written tables.

Where links are also checked by the similarity of texts, a forest of unchecked links is not enough: it is one only of links
that nothing removes later. There, nodes are different texts, and band keys of minimum hashes bring together all pairs that
are similar enough, but for one in millions (see BANDS). Each text is first checked against the most central one of its keys; keys whose texts are
then in several components still are read by a worker with the sets of their shingles, which compares all their pairs and
joins only what passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffmill.llm.common import free, partitions, table, written

WORDS, RADIUS, BITS, SEED = 4, 4, 64, 42
#: A key that more distinct fingerprints share is dealt out once more by their other bits.
HOT = 8192
#: Fingerprints compared at once against a block; bounds the memory of a comparison.
QUERIES, BLOCK = 64, 16_384
#: Band keys of a text: BANDS keys of BAND_HASHES minimum hashes. A pair of Jaccard similarity s shares none with a
#: probability of (1 - s ** BAND_HASHES) ** BANDS: 1.3e-7 at 0.8.
BANDS, BAND_HASHES = 40, 5
#: Shingles whose minimum hashes are taken at once.
MIXED = 256
_TABLE = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\v\f\r", bytes(range(97, 123)) + b"     ")


def fingerprint(text: str | None, k: int = WORDS) -> int:
    """64 bits: bit b is set if over half of the hashes of the k-word shingles have it; 0 without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    if not words:
        return 0
    flat, digest = b" ".join(words), xxhash.xxh64_digest
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    last = max(len(words) - k + 1, 1)
    starts, ends = starts[:last], ends[min(k, len(words)) - 1 :]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, last, 65_536):
        hashes = b"".join([digest(flat[a:b], SEED) for a, b in zip(starts[at : at + 65_536].tolist(), ends[at : at + 65_536].tolist(), strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > last).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.fromiter((fingerprint(x.as_py(), k) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the 64 bits as a signed long) of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_fingerprints, k=words), "id long, fp long")


def ranges(bits: list[int], n: int) -> list[list[int]]:
    """The bits in n runs of near equal length."""
    cuts = [round(i * len(bits) / n) for i in range(n + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of words: bit j of word w in row b is bit b of fingerprint 64 w + j."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(queries: np.ndarray, sliced: np.ndarray, radius: int, order: list[int], n: int) -> np.ndarray | None:
    """For each query a row of words whose bits say which of the block's n fingerprints are within the radius; None if none is.

    Carry-save: each plane of differences is added into counters of one bit a plane, low to high, with a sticky word for
    what has passed the radius. Counters start at a value from which radius + 1 differences carry out of the top. Words whose
    64 fingerprints are all too far from all queries are abandoned, and the block with its last word.
    """
    digits = (radius + 1).bit_length() if radius else 1
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    first = (1 << digits) - (radius + 1)
    width = sliced.shape[1]
    shape = (len(queries), width)
    counters = [np.full(shape, full if first >> d & 1 else 0, np.uint64) for d in range(digits)]
    over = np.zeros(shape, np.uint64)
    over[:, -1] = ~np.uint64((1 << (n - 1) % 64 + 1) - 1)  # what pads the last word is out from the start
    open_ = np.arange(width)
    for step, b in enumerate(order):
        carry = sliced[b][None, :] ^ np.where((queries >> np.uint64(b)) & np.uint64(1), full, np.uint64(0))[:, None]
        for d in range(digits):
            both = counters[d] & carry
            counters[d] ^= carry
            carry = both
        over |= carry
        if step >= radius and step % 8 == 7:
            left = (over != full).any(axis=0)
            if not left.any():
                return None
            if 2 * left.sum() <= len(left):
                open_, sliced, over, counters = open_[left], sliced[:, left], over[:, left], [c[:, left] for c in counters]
    out = np.zeros(shape, np.uint64)
    out[:, open_] = ~over
    return out if (over != full).any() else None


class Forest:
    """Union-find over positions, by path halving; joins that link two trees are kept as links."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = a = up[up[a]]
        return a

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))


def _cut_pairs(fps: np.ndarray, runs: list[list[int]]) -> int:
    """The pairs that are left to compare, over all runs, if fingerprints meet only where they agree in a run."""
    counts = (np.unique(fps & np.uint64(sum(1 << b for b in run)), return_counts=True)[1] for run in runs)
    return sum(int((n.astype(np.int64) ** 2).sum()) for n in counts)


def spanning_links(fps: np.ndarray, radius: int, free: list[int]) -> list[tuple[int, int]]:
    """Positions of linked fingerprints, as a spanning forest of all links. fps are distinct and may differ in the bits
    of free only. Large sets are cut by ranges of those bits first, as within() compares each with each, but only where that
    halves the pairs to compare: sets that lie close together agree in most ranges, and cutting would compare them ever again."""
    forest = Forest(len(fps))
    if len(fps) <= 2 * HOT or len(free) <= radius + 1 or 2 * _cut_pairs(fps, ranges(free, radius + 1)) > len(fps) ** 2:
        order = free or [0]
        for at in range(0, len(fps), BLOCK):
            block = fps[at : at + BLOCK]
            sliced = planes(block)
            for q in range(at, len(fps), QUERIES):  # queries before the block met it as blocks
                near = within(fps[q : q + QUERIES], sliced, radius, order, len(block))
                if near is None:
                    continue
                rows, cols = np.nonzero(np.unpackbits(near.astype("<u8").view(np.uint8), axis=1, bitorder="little", count=len(block)))
                keep = rows + q > cols + at
                for a, b in zip((cols[keep] + at).tolist(), (rows[keep] + q).tolist(), strict=True):
                    forest.join(a, b)
        return forest.links
    for run in ranges(free, radius + 1):
        mask = np.uint64(sum(1 << b for b in run))
        rest = [b for b in free if b not in run]
        values = fps & mask
        by = np.argsort(values, kind="stable")
        cuts = np.flatnonzero(np.diff(values[by])) + 1
        for group in np.split(by, cuts):
            if len(group) > 1:
                for a, b in spanning_links(fps[group], radius, rest):
                    forest.join(int(group[a]), int(group[b]))
    return forest.links


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (run, value, sub, subvalue, fp) in the order of their keys to links (a, b). A key is held whole: 8 bytes a row."""
    held: list[np.ndarray] = []
    now = None
    runs = ranges(list(range(BITS)), radius + 1)

    def free(run: int, sub: int) -> list[int]:
        rest = [b for b in range(BITS) if b not in runs[run]]
        return rest if sub < 0 else [b for b in rest if b not in ranges(rest, radius + 1)[sub]]

    def flush():
        fps = np.unique(np.concatenate(held))
        if len(fps) < 2:
            return None
        found = np.array(spanning_links(fps, radius, free(now[0], now[2])), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(fps[found[:, 0]].view(np.int64)), pa.array(fps[found[:, 1]].view(np.int64))], ["a", "b"]) if len(found) else None

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
        fps = batch.column(4).to_numpy().view(np.uint64)
        cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fps)], strict=True):
            key = tuple(keys[a].tolist())
            if key != now:
                if held and (out := flush()) is not None:
                    yield out
                held, now = [], key
            held.append(fps[a:b])
    if held and (out := flush()) is not None:
        yield out


def _part(fp, bits: list[int]):
    """The value of a run of bits, from bits[0] on; runs of the other bits may have a gap, so bits are taken in pieces."""
    value, done = F.lit(0).cast("long"), 0
    pieces: list[list[int]] = []
    for b in bits:
        if pieces and pieces[-1][-1] == b - 1:
            pieces[-1].append(b)
        else:
            pieces.append([b])
    for piece in pieces:
        value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, piece[0]).bitwiseAND(F.lit((1 << len(piece)) - 1)), done))
        done += len(piece)
    return value


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) of the distinct fingerprints in column fp that connect all that are within the radius of each other."""
    spark = distinct.sparkSession
    runs, fp = ranges(list(range(BITS)), radius + 1), F.col("fp")
    dealt = distinct.select("fp", F.posexplode(F.array(*(_part(fp, r) for r in runs))).alias("run", "value"))
    # one row a key; hot keys are those of more than HOT rows, so there are at most rows / HOT of them
    hot = written(dealt.groupBy("run", "value").agg(F.count(F.lit(1)).alias("n")).where(f"n > {HOT}").select("run", "value", F.lit(True).alias("hot")), "simhash-hot")
    dealt = dealt.join(hot, ["run", "value"], "left")
    subs = F.lit(None)
    for run, own in enumerate(runs):
        rest = [b for b in range(BITS) if b not in own]
        parts = F.array(*(F.struct(F.lit(i).alias("sub"), _part(fp, r).alias("subvalue")) for i, r in enumerate(ranges(rest, radius + 1))))
        subs = F.when((F.col("run") == run) & F.col("hot"), parts).otherwise(subs)
    once = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("subvalue")))
    dealt = dealt.select("fp", "run", "value", F.explode(F.coalesce(subs, once)).alias("s")).select("run", "value", "s.sub", "s.subvalue", "fp")
    keys = ["run", "value", "sub", "subvalue"]
    dealt = dealt.repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(partial(_links, radius=radius), "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root, the smallest node it is connected to, for each node of edges (a, b), by alternating large and small
    stars. Each half round keeps what is connected connected and works on sums by node only, so a node of very many edges is
    combined before it is shuffled; each is written, so lineage does not grow. It ends when a round changes nothing."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        """Large: each larger neighbour of a node is linked to its smallest. Small: the node and its smaller neighbours are."""
        if large:
            both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            least = down.groupBy("a").agg(F.min("b").alias("m"))
            out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def sign(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "stars")
    now = sign(edges)
    for _ in range(rounds):
        edges = written(star(written(star(edges, True), "stars"), False), "stars")
        was, now = now, sign(edges)
        if was == now:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """The set of hashes of a text's k-word shingles, sorted; fewer words are one shingle, none is empty."""
    return _set(_words(text), k).view(np.int64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _set(words: list[bytes], k: int) -> np.ndarray:
    import xxhash

    if not words:
        return np.empty(0, np.uint64)
    last = max(len(words) - k + 1, 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), SEED) for i in range(last)), np.uint64, last))


def node_of(words: list[bytes]) -> int:
    """A number for each different sequence of words, as a signed long; 0 for none."""
    import xxhash

    return int(np.array(xxhash.xxh64_intdigest(b" ".join(words), SEED + 1), np.uint64).view(np.int64)) if words else 0


@cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """The masks and odd factors of all minimum hashes; a worker draws them once."""
    masks, factors = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * BAND_HASHES), np.uint64)
    return masks, factors | np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set of hashes: two sets of Jaccard similarity s have the same key of a band with probability s ** BAND_HASHES."""
    import xxhash

    if not len(hashes):
        return np.empty(0, np.int64)
    masks, factors = _permutations()
    least = np.full(BANDS * BAND_HASHES, 2**64 - 1, np.uint64)
    room = np.empty((min(len(hashes), MIXED), len(least)), np.uint64)  # small enough for a core's cache, and used again
    for at in range(0, len(hashes), MIXED):
        part = hashes[at : at + MIXED, None]
        mixed = np.bitwise_xor(part, masks, out=room[: len(part)])
        mixed *= factors
        np.minimum(least, mixed.min(axis=0), out=least)
    rows = least.astype("<u8").reshape(BANDS, BAND_HASHES)
    return np.fromiter((xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)), np.uint64, BANDS).view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *rows])))


def _texts(batches: Iterator[pa.RecordBatch], words: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x.as_py() for x in batch.column(2)]
        split = [_words(t) for t in texts]
        fps = np.fromiter((fingerprint(t, words) for t in texts), np.uint64, len(texts)).view(np.int64)
        nodes = pa.array([node_of(w) for w in split], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps), nodes, _lists([band_keys(_set(w, k)) for w in split])], ["id", "raw", "fp", "node", "keys"])


def _shingled(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingle_hashes(x.as_py(), k) for x in batch.column(1)])], ["node", "hashes"])


def similar_links(sets: list[np.ndarray], roots: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Positions of links that join the components in roots: a spanning forest of all pairs of sets that are similar enough.
    A pair is left out only where links that hold have joined it already."""
    forest, first = Forest(len(sets)), {}
    for i, r in enumerate(roots.tolist()):
        forest.join(first.setdefault(r, i), i)
    forest.links.clear()
    left = len(first)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(len(sets)), sizes)[np.argsort(at, kind="stable")]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(at))])
    ends = np.cumsum(sizes)
    for i in range(len(sets)):
        if left == 1:
            break
        own = at[ends[i] - sizes[i] : ends[i]]
        common = np.bincount(np.concatenate([owners[cuts[x] : cuts[x + 1]] for x in own]), minlength=len(sets))[:i] if len(own) else np.zeros(i, np.int64)
        for j in np.flatnonzero((common > 0) & (common >= least * (sizes[:i] + sizes[i] - common))).tolist():
            before = len(forest.links)
            forest.join(j, i)
            left -= len(forest.links) - before
    return forest.links


def _similar(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, root, hashes) in the order of their keys to links (a, b). A key is held whole, with its sets."""
    now, nodes, roots, sets = None, [], [], []

    def flush():
        found = np.array(similar_links(sets, np.array(roots), least), np.int64).reshape(-1, 2) if len(sets) > 1 else np.empty((0, 2), np.int64)
        own = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(own[found[:, 0]]), pa.array(own[found[:, 1]])], ["a", "b"])

    for batch in batches:
        keys = batch.column(0).to_pylist()
        for i, key in enumerate(keys):
            if key != now:
                if nodes:
                    yield flush()
                now, nodes, roots, sets = key, [], [], []
            nodes.append(batch.column(1)[i].as_py())
            roots.append(batch.column(2)[i].as_py())
            sets.append(batch.column(3)[i].values.to_numpy())
    if nodes:
        yield flush()


def shingle_sets(nodes: DataFrame, docs: DataFrame, k: int, text_col: str) -> DataFrame:
    """(node, hashes) of nodes (node, raw), where raw is the hash of one text of the node. Only their texts are read."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("raw"), text.alias("text")).join(nodes.hint("merge"), "raw")
    return texts.select("node", "text").mapInArrow(partial(_shingled, k=k), "node long, hashes array<long>").groupBy("node").agg(F.min("hashes").alias("hashes"))


def checked(edges: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The links (a, b) whose sets have a Jaccard similarity of least or more."""
    both = edges.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("p")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("q")), "b")
    common = F.size(F.array_intersect("p", "q"))  # of two sets: their sizes are those of the arrays
    return both.select("a", "b", common.alias("n"), (F.size("p") + F.size("q")).alias("sum")).where(F.col("n") >= F.lit(least) * (F.col("sum") - F.col("n"))).select("a", "b")


def similar(nodes: DataFrame, docs: DataFrame, radius: int, least: float, k: int, text_col: str) -> DataFrame:
    """Links (a, b) of nodes (node, raw, fp, keys) that connect all pairs with a Jaccard similarity of least or more."""
    spark = docs.sparkSession
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    # keys of the same texts are one key: their sum of hashes says so
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("same")).where("n > 1")
    groups = written(groups.groupBy("same", "n").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("times")).select("key", "n", "times"), "simhash-keys")
    members = written(keyed.join(groups.hint("merge"), "key"), "simhash-members")
    # the most central text of a key is the one that meets most others over all its keys
    central = members.groupBy("node").agg(F.sum(F.col("n") * F.col("times")).alias("met"))
    reps = members.join(central.hint("merge"), "node").groupBy("key").agg(F.max(F.struct("met", "node"))["node"].alias("rep"))
    pairs = members.join(reps.hint("merge"), "key").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    # fingerprints within the radius, by one text of each; further texts of a fingerprint are candidates with that one
    by_fp = written(nodes.where("node <> 0").groupBy("fp").agg(F.min("node").alias("one"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    ones = by_fp.select("fp", "one")
    near = written(links(ones, radius), "simhash-links")
    near = near.join(ones.toDF("a", "x"), "a").join(ones.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    more = nodes.where("node <> 0").join(by_fp.where("n > 1"), "fp").select(F.col("node").alias("a"), F.col("one").alias("b"))
    pairs = written(pairs.union(near).union(more).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-pairs")
    linked = written(nodes.select("node", "raw").join(pairs.select(F.explode(F.array("a", "b")).alias("node")).union(members.select("node")).distinct(), "node"), "simhash-nodes")
    sets = written(shingle_sets(linked, docs, k, text_col), "simhash-sets")
    edges = written(checked(pairs, sets, least), "simhash-checked")
    # keys of three texts or more that are not one component yet: a key of two was one pair
    root = written(components(edges), "simhash-roots")
    members = members.where("n > 2").join(root.hint("merge"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    open_keys = members.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    rest = written(members.join(open_keys.hint("merge"), "key"), "simhash-rest").join(sets.hint("merge"), "node").select("key", "node", "root", "hashes")
    rest = rest.repartition(partitions(spark), "key").sortWithinPartitions("key", "node")
    return edges.union(written(rest.mapInArrow(partial(_similar, least=least), "a long, b long").distinct(), "simhash-similar"))


def near_components(docs: DataFrame, words: int, radius: int, id_col: str, text_col: str, least: float, k: int) -> DataFrame:
    """id, raw (hash of the text), fp, component_id and stays of each row of docs, by links of texts that are checked. stays: the
    row has the least id of its component, and of rows of that id the least raw."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("raw"), text.alias("text"))
    rows = written(rows.mapInArrow(partial(_texts, words=words, k=k), "id long, raw long, fp long, node long, keys array<long>"), "simhash")
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "raw"))).alias("first")
    nodes = written(rows.groupBy("node").agg(first, F.min("raw").alias("raw"), F.min("fp").alias("fp"), F.min("keys").alias("keys")), "simhash-texts")
    root = written(components(similar(nodes, docs, radius, least, k, text_col)), "simhash-roots")
    named = nodes.select("node", "first").join(root, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    ids = named.groupBy("root").agg(F.min("first").alias("kept"))
    found = rows.select("id", "raw", "fp", "node").join(named.join(ids, "root").select("node", "kept"), "node")
    return found.select("id", "raw", "fp", F.col("kept.id").alias("component_id"), (F.struct("id", "raw") == F.col("kept")).alias("stays"))


def simhash_dedup(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", least: float | None = None, least_words: int = 5) -> DataFrame:
    """A row for each row of docs: doc_id, fingerprint (16 lowercase hex digits), component_id (smallest id reachable over
    links between fingerprints that differ in radius bits at most, itself included).

    Letters A-Z count as a-z, words end at the space and the code points 9 to 13, and a text of fewer words is one shingle.
    Null and empty texts have the fingerprint zero, which links like any other. Rows that repeat are returned as often as
    they come. Null ids are returned; a component whose ids are all null has a null component_id. No rows give none.
    least: components are those of texts with a Jaccard similarity of least or more over least_words-word shingles instead;
    texts without words are one. Fingerprints within the radius and the band keys give the candidates.
    """
    if least is not None:
        found = near_components(docs, words, radius, id_col, text_col, least, least_words)
        return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    rows = written(fingerprints(docs, words, id_col, text_col), "simhash")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    edges = links(distinct, radius)
    root = written(components(edges), "simhash-roots")
    named = distinct.join(root, distinct["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # unlinked fingerprints have their own least id; only linked ones meet their component
    linked = named.join(ids, "root").select("fp", "component_id")
    return rows.join(linked, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", least: float | None = None, least_words: int = 5) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with all columns, whatever their names; rows of a null id
    stay. With least, one text of that id stays, where several rows have it; rows that repeat id and text are dropped or stay
    together."""
    own, raw = free(docs, "__gone", "__gone_raw")
    if least is None:
        found = simhash_dedup(docs, words, radius, id_col, text_col)
        gone = written(found.where("doc_id > component_id").select(F.col("doc_id").alias(own)).distinct(), "simhash-gone")
        # merge: both sides grow with the input, so the plan is the same at every size
        return docs.join(gone.hint("merge"), docs[id_col] == F.col(own), "left_anti")
    found = near_components(docs, words, radius, id_col, text_col, least, least_words)
    gone = written(found.where("id IS NOT NULL AND NOT stays").select(F.col("id").alias(own), F.col("raw").alias(raw)).distinct(), "simhash-gone")
    same = (docs[id_col] == F.col(own)) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == F.col(raw))
    return docs.join(gone.hint("merge"), same, "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the whole documents table."""
    return simhash_dedup(table(spark, sf_dir, "documents"))
