"""Exact nearest neighbours by cosine as blocked matrix products.

Both sides are hashed into blocks of bounded size.  Every (query block, pool
block) pair is one group whose vectors are multiplied with NumPy; a group emits
only its own top k per query, and the per-block winners are merged by a limited
window.  No pair of rows is ever materialised, no side is broadcast or collected,
and hot labels do not matter because blocks are cut by id.  Large inputs are first
cut into cells around pivot rows, most of which the triangle inequality rules out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import collect_small, durable, small_table
from ..plans.order import md5_head

BLOCK_ROWS = 20_000
SLICE_ROWS = 256
#: rows of the pool that a slice of queries is multiplied with at once: both stay in the cache
TILE_ROWS = 2048
#: cosines that a task holds at once, and visits that it hands on at once
SLICE_CELLS = 1 << 20
VISITS = 4096
MAX_PIVOTS = 1024
#: cells of large inputs meet in groups of up to so many blocks, whose vectors take so many bytes in single precision at most
WIDE, BLOCK_BYTES = 4, 24 << 20
PRUNE_PAIRS = 10**11
SLACK = 1e-6
DIGITS = 12
ID_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    col = table.column(name).combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    # rows without a vector are left out before; a wrong width would move every later row
    if len(col) and (col.null_count or len(pc.unique(pc.list_value_length(col))) != 1):
        raise ValueError("vectors are missing or differ in length")
    vecs = flat.reshape(len(col), -1).astype(np.float64) if len(col) else np.zeros((0, 1))
    norm = np.sqrt((vecs * vecs).sum(axis=1, keepdims=True))
    norm[norm == 0] = 1.0
    return np.divide(vecs, norm, out=vecs)


def _slice_rows(width: int) -> int:
    """Rows that are compared with `width` others at once."""
    return max(1, min(SLICE_ROWS, SLICE_CELLS // max(1, width)))


def _kernel(k: int, mode: str, id_type: pa.DataType):
    schema = pa.schema([("q_id", id_type), ("p_id", id_type), ("score", pa.float64())])

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        p_id = right.column("p_id").to_numpy()
        by_id = np.argsort(p_id, kind="stable")  # ties go to the smaller id
        p_id = p_id[by_id]
        pool = _matrix(right, "p_vec")[by_id].T
        q_id = left.column("q_id").to_numpy()
        # labels as numbers (NULL: -1): comparing strings takes longer than the product
        labels = pa.concat_arrays([*left.column("q_label").chunks, *right.column("p_label").chunks]).dictionary_encode()
        number = pc.fill_null(labels.indices, -1).to_numpy()
        q_label, p_label = number[: len(q_id)], number[len(q_id) :][by_id]
        queries = _matrix(left, "q_vec")
        found = []
        for at in range(0, len(q_id), SLICE_ROWS):
            part = slice(at, at + SLICE_ROWS)
            best = []
            for first in range(0, len(p_id), TILE_ROWS):
                tile = slice(first, first + TILE_ROWS)
                sims = queries[part] @ pool[:, tile]
                if mode == "other_label":
                    np.copyto(sims, -np.inf, where=q_label[part, None] == p_label[None, tile])
                elif mode == "same_label":
                    np.copyto(sims, -np.inf, where=q_label[part, None] != p_label[None, tile])
                elif mode == "other_row":
                    np.copyto(sims, -np.inf, where=q_id[part, None] == p_id[None, tile])
                # everything that can be rounded to the k-th value of the tile or more
                width = sims.shape[1]
                kk = min(k, width)
                kth = sims.max(axis=1, keepdims=True) if kk == 1 else np.partition(sims, width - kk, axis=1)[:, width - kk, None]
                rows, cols = np.nonzero(sims >= np.maximum(kth, -2.0) - 10.0 ** (1 - DIGITS))  # -inf: less than k rows
                best.append((rows, cols + first, np.round(sims[rows, cols], DIGITS)))
            # cut at k in (rounded score, id) order
            rows, cols, score = (np.concatenate(x) for x in zip(*best))
            order = np.lexsort((cols, -score, rows))
            rows, cols, score = rows[order], cols[order], score[order]
            keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
            found.append((q_id[part][rows[keep]], p_id[cols[keep]], score[keep]))
        q, p, s = (np.concatenate(x) for x in zip(*found))
        return pa.table({"q_id": q, "p_id": p, "score": s}).cast(schema)

    return block


def _forest(threshold: float, id_type: pa.DataType):
    schema = pa.schema([("a", id_type), ("b", id_type)])

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        q_id, p_id = left.column("q_id").to_numpy(), right.column("p_id").to_numpy()
        queries, pool = _matrix(left, "q_vec"), _matrix(right, "p_vec").T
        sets = np.arange(len(p_id))  # the set of each pool row so far
        rows, cols = [], []
        step = _slice_rows(len(p_id))
        for at in range(0, len(q_id), step):
            near = np.round(queries[at : at + step] @ pool, DIGITS) >= threshold
            for i in np.flatnonzero(near.any(axis=1)):
                hits = np.flatnonzero(near[i])
                met = sets[hits]
                if (met == met[0]).all():
                    hits = hits[:1]
                else:  # one link to each set, which are one from now on
                    met, first = np.unique(met, return_index=True)
                    hits = hits[first]
                    sets[np.isin(sets, met)] = met[0]
                rows.append(np.full(len(hits), at + i))
                cols.append(hits)
        if not rows:
            return schema.empty_table()
        return pa.table({"a": q_id[np.concatenate(rows)], "b": p_id[np.concatenate(cols)]}).cast(schema)

    return block


def _blocked(
    visits: DataFrame, pool: DataFrame, k: int, mode: str, id_kind: str, block_rows: int, threshold: float | None = None
) -> DataFrame:
    """Top k of every block for the queries that visit a cell of the pool; links at a threshold, if one is given.

    ``visits(q_id, q_vec, q_label, cell)``, ``pool(p_id, p_vec, p_label, cell)``.  Both sides
    of a cell are hashed into blocks, so a cell may hold any share of the rows.
    """
    spark = visits.sparkSession
    nq = {r["cell"]: r["n"] for r in collect_small(visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))}
    np_ = {r["cell"]: r["n"] for r in collect_small(pool.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))}
    # at small sizes one block would mean one task; keep the cluster busy
    busy = max(1, spark.sparkContext.defaultParallelism // max(1, len(np_)))
    cuts = small_table(
        spark,
        [
            (c, math.ceil(nq[c] / block_rows), max(math.ceil(np_[c] / block_rows), min(busy, math.ceil(np_[c] / 500))))
            for c in nq.keys() & np_.keys()
        ],
        "cell int, nbq bigint, nbp bigint",
    )

    def spread(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    q = visits.join(cuts, "cell").select(
        "q_id", "q_vec", "q_label", "cell", F.pmod(F.xxhash64("q_id"), F.col("nbq")).alias("bq"), spread("nbp").alias("bp")
    )
    p = pool.join(cuts, "cell").select(
        "p_id", "p_vec", "p_label", "cell", spread("nbq").alias("bq"), F.pmod(F.xxhash64("p_id"), F.col("nbp")).alias("bp")
    )
    key = ["cell", "bq", "bp"]
    arrow = ID_KINDS[id_kind]
    if threshold is not None:
        return q.groupBy(*key).cogroup(p.groupBy(*key)).applyInArrow(_forest(threshold, arrow), f"a {id_kind}, b {id_kind}")
    return q.groupBy(*key).cogroup(p.groupBy(*key)).applyInArrow(
        _kernel(k, mode, arrow), f"q_id {id_kind}, p_id {id_kind}, score double"
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("score"), "p_id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def _sliced(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    step = _slice_rows(width)
    for b in batches:
        yield from (b.slice(at, step) for at in range(0, b.num_rows, step))


def _with_cell(df: DataFrame, vec: str, pivots: np.ndarray) -> DataFrame:
    """Nearest pivot of every row and the distance of the unit vectors."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches, len(pivots)):
            unit = _matrix(pa.Table.from_batches([b]), vec)
            sims = unit @ pivots.T if len(unit) else np.zeros((0, len(pivots)))
            cell = sims.argmax(axis=1).astype(np.int32) if len(unit) else np.zeros(0, np.int32)
            dist = np.sqrt(np.maximum(0.0, 2 - 2 * sims[np.arange(len(unit)), cell]))
            dist[~unit.any(axis=1)] = 2.0  # a zero vector is never ruled out by distance
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(dist)], names=[*b.schema.names, "cell", "dist"])

    kinds = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    return df.mapInArrow(assign, f"{kinds}, cell int, dist double")


def _grouped(sizes: dict[int, int], pivots: np.ndarray, rows: int) -> dict[int, int]:
    """Cells to groups of about ``rows`` rows of the pool: each cell is followed by the nearest one that is left, and the row of cells is cut."""
    left, groups, held = dict(sizes), {}, 0
    cell, group = next(iter(sorted(left))), 0
    while True:
        if held and held + left[cell] > rows:
            group, held = group + 1, 0
        groups[cell] = group
        held += left.pop(cell)
        if not left:
            return groups
        others = np.array(sorted(left))
        cell = int(others[(pivots[others] @ pivots[cell]).argmax()])


def _open_cells(df: DataFrame, pivots: np.ndarray, radius: dict[int, float], later: bool = False, groups: dict[int, int] | None = None) -> DataFrame:
    """Other cells (``later``: of a higher number) that can hold a row within the query's limit.

    By the triangle inequality no row of a cell is nearer than the distance to its
    pivot minus the cell's radius. With ``groups`` a query visits its own group and those (``later``: of a higher number)
    that hold such a cell: one copy of its vector for each group, however many cells that has.
    """
    cells = np.array(sorted(radius, key=lambda c: (groups[c] if groups else 0, c)), dtype=np.int32)
    reach = np.array([radius[c] for c in cells])
    group = np.array([groups[c] for c in cells], dtype=np.int32) if groups else None
    group_of = np.full(len(pivots), -1, np.int32)  # a cell without rows of the pool has none
    if groups:
        group_of[cells] = group
        numbers, starts = np.unique(group, return_index=True)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches, len(cells)):  # a row may visit every cell
            t = pa.Table.from_batches([b])
            if not t.num_rows:
                continue
            away = np.sqrt(np.maximum(0.0, 2 - 2 * (_matrix(t, "q_vec") @ pivots[cells].T)))
            open_ = away - reach[None, :] <= t.column("limit").to_numpy()[:, None] + SLACK
            own, names = t.column("cell").to_numpy()[:, None], cells
            if groups:
                own, names = group_of[own], numbers
                open_ = np.logical_or.reduceat(open_, starts, axis=1)
                open_ |= own == names[None, :]
                open_ &= own <= names[None, :] if later else True
            else:
                open_ &= own < cells[None, :] if later else own != cells[None, :]
            rows, cols = np.nonzero(open_)
            asked = t.select(["q_id", "q_vec", "q_label"])
            for at in range(0, len(rows), VISITS):
                out = asked.take(pa.array(rows[at : at + VISITS]))
                yield from out.append_column("cell", pa.array(names[cols[at : at + VISITS]])).combine_chunks().to_batches()

    kinds = ", ".join(f"{c} {t}" for c, t in df.dtypes if c in ("q_id", "q_vec", "q_label"))
    return df.select("q_id", "q_vec", "q_label", "cell", "limit").mapInArrow(keep, f"{kinds}, cell int")


def _cells_of(placed: DataFrame) -> tuple[dict[int, float], dict[int, int]]:
    """Radius and number of rows of every cell."""
    found = placed.groupBy("cell").agg(F.max("dist").alias("r"), F.count(F.lit(1)).alias("n")).collect()
    return {r["cell"]: r["r"] for r in found}, {r["cell"]: r["n"] for r in found}


def _with_group(pool: DataFrame, groups: dict[int, int]) -> DataFrame:
    """The pool with its rows' groups for cells."""
    named = small_table(pool.sparkSession, groups.items(), "cell int, _group int")
    return pool.join(named, "cell").drop("cell").withColumnRenamed("_group", "cell")


def _wide(block_rows: int, dims: int) -> int:
    return max(block_rows, min(WIDE * block_rows, BLOCK_BYTES // (4 * dims)))


def _whole(df: DataFrame, vec: str) -> DataFrame:
    return df.filter(F.col(vec).isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull()))


def _id_kind(df: DataFrame, name: str) -> str:
    kind = dict(df.dtypes)[name]
    if kind not in ID_KINDS:
        raise TypeError(f"ids of type {kind}; use one of {', '.join(ID_KINDS)}")
    return kind


def topk_cosine(
    queries: DataFrame,
    pool: DataFrame,
    *,
    k: int,
    query_id: str,
    pool_id: str,
    query_vec: str,
    pool_vec: str,
    query_label: str | None = None,
    pool_label: str | None = None,
    mode: str = "any",
    block_rows: int = BLOCK_ROWS,
    prune: bool | None = None,
) -> DataFrame:
    """``(q_id, p_id, score, place)``: the k most similar pool rows of every query.

    ``mode``: any, other_row (not itself), other_label, same_label.  Small inputs are
    compared block by block.  Large ones (``prune``) are cut into cells around pivot
    rows: a query first searches its own cell, and its k-th hit then rules out every
    cell that lies too far away.  Both ways give the same rows.  Rows without a vector, or with a
    NULL in it, take no part; vectors of different lengths are an error.
    """
    label = lambda name: (F.col(name) if name else F.lit("")).cast("string")
    q = queries.select(F.col(query_id).alias("q_id"), F.col(query_vec).alias("q_vec"), label(query_label).alias("q_label"))
    p = pool.select(F.col(pool_id).alias("p_id"), F.col(pool_vec).alias("p_vec"), label(pool_label).alias("p_label"))
    q, p = _whole(q, "q_vec"), _whole(p, "p_vec")
    kind = _id_kind(p, "p_id")
    n_pool = p.count() if prune is None or prune else 0
    if prune is None:
        prune = n_pool * q.count() > PRUNE_PAIRS
    if mode == "same_label":  # a label is a cell; the kernel tells apart labels whose hashes meet
        cell = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 30)).cast("int").alias("cell")
        return _best(_blocked(q.select("*", cell("q_label")), p.select("*", cell("p_label")), k, mode, kind, block_rows), k)
    if not prune or not n_pool:
        one = F.lit(0).alias("cell")
        return _best(_blocked(q.select("*", one), p.select("*", one), k, mode, kind, block_rows), k)
    some = md5_head(p.select("p_id", "p_vec"), min(MAX_PIVOTS, max(2, math.isqrt(n_pool))), seed="pivots", id_col="p_id")
    pivots = _matrix(some.select("p_vec").toArrow(), "p_vec")  # at most MAX_PIVOTS vectors
    q, p = durable(_with_cell(q, "q_vec", pivots)), durable(_with_cell(p, "p_vec", pivots))
    radius, sizes = _cells_of(p)
    near = _best(_blocked(q.drop("dist"), p, k, mode, kind, block_rows), k)
    kth = near.groupBy("q_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
    limit = F.when(F.col("n") == k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("s")))).otherwise(2.0)
    bounded = durable(q.join(kth, "q_id", "left").withColumn("limit", limit).drop("dist", "n", "s"))
    rows = _wide(block_rows, pivots.shape[1])
    groups = _grouped(sizes, pivots, rows)
    return _best(_blocked(_open_cells(bounded, pivots, radius, groups=groups), _with_group(p, groups), k, mode, kind, rows), k)


def threshold_links(
    df: DataFrame, *, threshold: float, vec: str = "embedding", id_col: str = "sample_id",
    block_rows: int = BLOCK_ROWS, prune: bool | None = None,
) -> DataFrame:
    """``(a, b)``: links whose components are those of all pairs of rows with a cosine >= ``threshold``.

    A pair of blocks joins its rows to sets as it meets them and returns one link for every set that a row touches: at most
    as many links as it has rows, however many pairs there are, and no pair is left out of account. Large inputs
    (``prune``) are cut into cells around pivot rows; a row visits its own cell and those of a higher number that the
    triangle inequality leaves open. Rows without a vector, or with a NULL in it, take no part.
    """
    rows = _whole(df.select(F.col(id_col).alias("q_id"), F.col(vec).alias("q_vec"), F.lit("").alias("q_label")), "q_vec")
    kind = _id_kind(rows, "q_id")
    n = rows.count() if prune is None or prune else 0
    if prune is None:
        prune = n * n > PRUNE_PAIRS
    if prune and n:
        some = md5_head(rows.select("q_id", "q_vec"), min(MAX_PIVOTS, max(2, math.isqrt(n))), seed="pivots", id_col="q_id")
        pivots = _matrix(some.select("q_vec").toArrow(), "q_vec")  # at most MAX_PIVOTS vectors
        placed = durable(_with_cell(rows, "q_vec", pivots))
        radius, sizes = _cells_of(placed)
        block_rows = _wide(block_rows, pivots.shape[1])
        groups = _grouped(sizes, pivots, block_rows)
        reach = F.lit(math.sqrt(max(0.0, 2 - 2 * threshold)))
        visits = _open_cells(placed.withColumn("limit", reach), pivots, radius, later=True, groups=groups)
        rows = _with_group(placed.drop("dist"), groups)
    else:
        rows = visits = rows.withColumn("cell", F.lit(0))
    pool = rows.select(*[F.col(c).alias(c.replace("q_", "p_")) for c in ("q_id", "q_vec", "q_label", "cell")])
    return _blocked(visits, pool, 0, "any", kind, block_rows, threshold).filter("a <> b")


def nearest_other_class(
    anchors: DataFrame, pool: DataFrame, *, vec: str = "embedding", label: str = "true_label",
    id_col: str = "sample_id", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """For every anchor the most similar pool row of a different label, as contrastive edges."""
    near = topk_cosine(
        anchors, pool, k=1, query_id=id_col, pool_id=id_col, query_vec=vec, pool_vec=vec,
        query_label=label, pool_label=label, mode="other_label", block_rows=block_rows,
    )
    text = lambda df, name: F.col("text") if "text" in df.columns else F.lit(None).cast("string")
    a = anchors.select(
        F.col(id_col).alias("anchor_sample_id"), F.col(label).alias("anchor_true_label"),
        text(anchors, "a").alias("anchor_text"),
    )
    c = pool.select(
        F.col(id_col).alias("contrast_sample_id"), F.col(label).alias("contrast_true_label"),
        text(pool, "c").alias("contrast_text"),
    )
    edges = near.select(
        F.col("q_id").alias("anchor_sample_id"), F.col("p_id").alias("contrast_sample_id"),
        F.col("score").alias("cosine_similarity"),
    )
    return edges.join(a, "anchor_sample_id").join(c, "contrast_sample_id")


def topk_similar(
    queries: DataFrame, pool: DataFrame, *, k: int = 3, vec: str = "embedding", id_col: str = "sample_id",
    exclude_self: bool = False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k most similar pool rows of every query."""
    return topk_cosine(
        queries, pool, k=k, query_id=id_col, pool_id=id_col, query_vec=vec, pool_vec=vec,
        mode="other_row" if exclude_self else "any", block_rows=block_rows,
    )


def topk_similar_per_label(
    queries: DataFrame, pool: DataFrame, *, k: int, m: int, rerank: str, candidates: str = "candidate_labels",
    vec: str = "embedding", label: str = "true_label", id_col: str = "sample_id", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Top k by cosine inside each candidate label, then the best m by the pool's second score."""
    asked = queries.select(
        F.col(id_col).cast("string").alias("q"), F.col(vec), F.explode(candidates).alias("want")
    ).withColumn("q_key", F.concat_ws("\u0001", "q", "want"))
    named = pool.withColumn("p_key", F.col(id_col).cast("string"))
    near = topk_cosine(
        asked, named, k=k, query_id="q_key", pool_id="p_key", query_vec=vec, pool_vec=vec,
        query_label="want", pool_label=label, mode="same_label", block_rows=block_rows,
    )
    parts = F.split("q_key", "\u0001")
    scored = (
        near.withColumnsRenamed({"q_id": "q_key", "p_id": "p_key", "place": "cosine_place"})
        .join(named.select("p_key", F.col(rerank).alias("rerank_score")), "p_key")
        .withColumn("query_id", parts[0])
        .withColumn("candidate_label", parts[1])
    )
    best = F.row_number().over(
        W.partitionBy("query_id", "candidate_label").orderBy(F.desc("rerank_score"), "p_key")
    )
    return (
        scored.withColumn("place", best)
        .filter(F.col("place") <= m)
        .select("query_id", "candidate_label", F.col("p_key").alias("pool_id"), "score", "rerank_score", "place")
    )


def knn_classify(
    queries: DataFrame, train: DataFrame, *, k: int = 5, vec: str = "embedding", label: str = "true_label",
    id_col: str = "sample_id", exclude_self: bool = False,
) -> DataFrame:
    """Majority label of the k nearest training rows (ties by name)."""
    from .votes import majority_vote

    near = topk_similar(queries, train, k=k, vec=vec, id_col=id_col, exclude_self=exclude_self)
    votes = near.join(train.select(F.col(id_col).alias("p_id"), F.col(label).alias("label")), "p_id")
    return majority_vote(votes, ["q_id"]).select(
        F.col("q_id").alias(id_col), F.col("vote").alias("pred_label"), F.col("vote_share").alias("confidence")
    )
