"""Vector search over code chunks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffmill.tables import written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    return F.try_divide(dot(a, b), norm_a * norm_b)


def with_norm(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("norm", F.sqrt(dot(F.col("embedding"), F.col("embedding"))))


#: Numbers of embeddings in a block of chunks or queries, which bounds what a task holds; scores held at once; groups of a block's chunks
#: whose best scores tell how far down the k best can be.
BLOCK, SCORES, GROUPS = 1 << 19, 1 << 20, 256


def _dots(a, b):
    """Dot products of rows, summed in order like the definition, so equal vectors have equal scores wherever they stand."""
    import numpy as np

    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _scorable(rows: pa.Table, name: str, needed: tuple[str, ...]):
    """The rows that can have a score, their embeddings as a matrix of doubles, and the norms. A vector with null or of norm 0 has none,
    nor has a row where a needed column is null."""
    import numpy as np

    flat = rows.column(name).combine_chunks().flatten()
    vectors = flat.to_numpy(zero_copy_only=False).astype("float64").reshape(rows.num_rows, -1)
    norms = np.sqrt(_dots(vectors, vectors))
    kept = norms != 0
    if flat.null_count:
        kept &= ~flat.is_null().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1).any(axis=1)
    for column in needed:
        kept &= rows.column(column).is_valid().to_numpy()
    return (rows, vectors, norms) if kept.all() else (rows.filter(pa.array(kept)), vectors[kept], norms[kept])


def _unit(vectors, norms):
    """Unit vectors in single precision, and which rows are none, as their norm is no plain number."""
    import numpy as np

    odd = ~((norms > 1e-100) & (norms < 1e100))
    unit = vectors / norms[:, None]
    unit[odd] = 0
    return unit.astype("float32"), np.flatnonzero(odd)


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray):
    """Equal values of two columns as equal numbers."""
    both = pa.chunked_array([*a.chunks, *b.chunks]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return both[: len(a)], both[len(a) :]


def _findable(k: int, vectors, norms, paths, hashes):
    """Which rows of a block, in their order, can be among the k best of a query: of equal vectors of a path the first k of each hash, and of
    hashes that stand once the first k + 1, as a query leaves out no hash but its own."""
    import numpy as np

    at = np.arange(len(norms))
    if len(np.unique(norms)) == len(norms):  # equal vectors have equal norms
        return at
    equal = np.unique(vectors.view(np.dtype((np.void, vectors.strides[0]))).ravel(), return_inverse=True)[1].ravel()
    often = np.bincount(hashes)[hashes] > 1
    keys = np.where(often, hashes, -1), paths, equal
    order = np.lexsort(keys)
    first = np.ones(len(at), bool)
    first[1:] = np.any([x[order][1:] != x[order][:-1] for x in keys], axis=0)
    return np.sort(order[at - np.maximum.accumulate(np.where(first, at, 0)) < np.where(often[order], k, k + 1)])


def _best(k: int, others_only: bool):
    def best(queries: pa.Table, chunks: pa.Table) -> pa.Table:
        """The k best chunks of a block for each query of a block. A product of matrices in single precision finds what can be among them,
        ties included; only that is scored as defined, and ranked by score and vec_id."""
        import numpy as np
        import pyarrow.compute as pc

        schema = pa.schema([queries.schema.field("query_id"), *(chunks.schema.field(c) for c in ("repo_id", "vec_id", "path", "content_hash")), pa.field("score", pa.float64())])
        if not queries.num_rows or not chunks.num_rows:
            return schema.empty_table()
        with np.errstate(all="ignore"):
            queries, q, nq = _scorable(queries, "q", ("q_path", "q_hash") if others_only else ())
            chunks, c, nc = _scorable(chunks.take(pc.sort_indices(chunks, sort_keys=[("vec_id", "ascending")], null_placement="at_start")), "embedding", ("path", "content_hash") if others_only else ())
        if not queries.num_rows or not chunks.num_rows:
            return schema.empty_table()
        theirs = hashes = np.zeros(len(c), int)
        if others_only:
            (mine, theirs), (his, hashes) = _codes(queries.column("q_path"), chunks.column("path")), _codes(queries.column("q_hash"), chunks.column("content_hash"))
        found = _findable(k, c, nc, theirs, hashes)
        chunks, c, nc, theirs, hashes = chunks.take(pa.array(found)), c[found], nc[found], theirs[found], hashes[found]
        place = np.argsort(theirs, kind="stable")
        if others_only:  # chunks of a path side by side, and so its queries
            own = np.argsort(mine, kind="stable")
            queries, q, nq, mine, his = queries.take(pa.array(own)), q[own], nq[own], mine[own], his[own]
            path_from, path_to = (np.searchsorted(theirs[place], mine, side) for side in ("left", "right"))
            by_hash = np.argsort(hashes[place], kind="stable")
            hash_from, hash_to = (np.searchsorted(hashes[place][by_hash], his, side) for side in ("left", "right"))

        groups = max(GROUPS, 4 * k)
        deep = -(-len(c) // groups)
        with np.errstate(all="ignore"):
            (cu, odd_c), (qu, odd_q) = _unit(c[place], nc[place]), _unit(q, nq)
        wide = np.zeros((c.shape[1], deep * groups), "float32")
        wide[:, : len(c)] = cu.T
        # twice what single precision can be off by, with room to spare
        margin = np.float32((c.shape[1] + 16) * 2.0**-23)

        def left_out(near, at, odd):
            """The scores of a step, with what is not a plain number as given and what may not be found below all."""
            near[:, odd_c] = odd
            near[odd_q[(odd_q >= at) & (odd_q < at + len(near))] - at] = odd
            near[:, len(c) :] = -np.inf
            if others_only:
                ends = np.flatnonzero(np.diff(mine[at : at + len(near)])) + 1
                for x, y in zip([0, *ends], [*ends, len(near)]):
                    near[x:y, path_from[at + x] : path_to[at + x]] = -np.inf
                for x in np.flatnonzero(hash_to[at : at + len(near)] > hash_from[at : at + len(near)]):
                    near[x, by_hash[hash_from[at + x] : hash_to[at + x]]] = -np.inf
            return near.reshape(len(near), deep, groups)

        found = []
        step = min(len(q), max(1, SCORES // wide.shape[1]))
        scores = np.empty((step, wide.shape[1]), "float32")
        for at in range(0, len(q), step):
            near = np.matmul(qu[at : at + step], wide, out=scores[: len(q) - at])
            cube = left_out(near, at, -np.inf)
            most = cube.max(axis=1)  # the k best of these are k chunks, so none that is worse than all of them is wanted
            least = np.maximum(np.partition(most, groups - k, axis=1)[:, groups - k] - margin, np.float32(-2))
            if len(odd_c) or len(odd_q):  # what is no plain number is scored as defined
                cube = left_out(near, at, np.inf)
                most = cube.max(axis=1)
            row, group = np.nonzero(most >= least[:, None])
            hit, depth = np.nonzero(cube[row, :, group] >= least[row, None])
            i, j = row[hit] + at, place[depth * groups + group[hit]]
            with np.errstate(all="ignore"):
                norms, cut = nq[i] * nc[j], 1 + SCORES // c.shape[1]
                score = np.concatenate([np.zeros(0), *(_dots(q[i[x : x + cut]], c[j[x : x + cut]]) for x in range(0, len(i), cut))]) / norms
            i, j, score = i[norms != 0], j[norms != 0], score[norms != 0]
            order = np.lexsort((j, -score, ~np.isnan(score), i))
            i, j, score = i[order], j[order], score[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
            found.append((i[kept], j[kept], score[kept]))
        i, j, score = (np.concatenate(x) for x in zip(*found))
        best_chunks = chunks.take(pa.array(j))
        return pa.table([queries.column("query_id").take(pa.array(i)), *(best_chunks.column(n) for n in ("repo_id", "vec_id", "path", "content_hash")), pa.array(score)], schema=schema)

    return best


def nearest(queries: DataFrame, chunks: DataFrame, k: int = 5, others_only: bool = True) -> DataFrame:
    """The k most similar chunks of each query's repository: query_id, vec_id, score, rank; ties by vec_id. Chunks of the query's
    own hash, and of its own path, are left out unless asked for.

    Queries and chunks of a repository are dealt into blocks of a bounded size, and each block of queries meets each block of
    chunks in one task, which keeps the k best of it. So the work is spread however few repositories there are, and chunks are shuffled
    once for each block of queries, and not by repository: numbers of blocks are written first, so that they are known to be few."""
    # null vectors have no score; vectors only meet those of their length
    whole = lambda rows: rows.where("repo_id IS NOT NULL AND size(embedding) > 0").withColumn("dim", F.size("embedding"))
    # counted without a look at the vectors, so blocks of each length are as many as if the whole repository had it
    counted = lambda rows, new: rows.where("repo_id IS NOT NULL").groupBy("repo_id").agg(F.count(F.lit(1)).alias(new))
    many = written(counted(chunks, "c_rows").join(counted(queries, "q_rows"), "repo_id"), "blocks")
    blocks = lambda rows: F.ceil(F.col(rows) * F.col("dim") / BLOCK).cast("int")
    q, c = (whole(rows).join(many, "repo_id").withColumns({"c_blocks": blocks("c_rows"), "q_blocks": blocks("q_rows")}) for rows in (queries, chunks))
    keys = ["repo_id", "dim"]
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    q = q.select(F.col("vec_id").alias("query_id"), F.col("repo_id").alias("q_repo"), F.col("dim").alias("q_dim"), F.col("path").alias("q_path"), F.col("content_hash").alias("q_hash"), F.col("embedding").alias("q"), dealt("q_blocks").alias("qb"), all_of("c_blocks").alias("cb"))
    c = c.select("vec_id", *keys, "path", "content_hash", "embedding", dealt("c_blocks").alias("cb"), all_of("q_blocks").alias("qb"))
    schema = T.StructType([T.StructField("query_id", q.schema["query_id"].dataType), *(c.schema[x] for x in ("repo_id", "vec_id", "path", "content_hash")), T.StructField("score", T.DoubleType())])
    rows = q.groupBy("q_repo", "q_dim", "qb", "cb").cogroup(c.groupBy(*keys, "qb", "cb")).applyInArrow(_best(k, others_only), schema)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_matches(found: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Of the matches of a group's queries, each hash once with its best score, and the k best of those."""
    best = found.groupBy(group, "content_hash").agg(F.max_by(F.struct("vec_id", "path"), F.struct("score", -F.col("query_id"))).alias("m"), F.max("score").alias("score"))
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), "content_hash")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(group, "content_hash", "m.vec_id", "m.path", "score", "rank")


def without_own(found: DataFrame, own: DataFrame) -> DataFrame:
    return found.join(own.select("content_hash").distinct(), "content_hash", "left_anti")
