"""Exact top-k search by a Voronoi kNN join.

Inner product is turned into distance by one more component: data vectors s become (s, sqrt(M^2 - |s|^2)) with M the
largest norm, queries become (q, 0), so that |q' - s'|^2 = |q|^2 + M^2 - 2 q.s and the nearest are the highest scores.
Pivots part both sides into cells; summaries of the cells give each group of queries a bound on the distance of its
k-th neighbour, and so for each cell of the data the least distance to the pivot from which a row can matter. Only such
rows are sent to a group, in blocks, and each block is solved with one matrix product. A group has as many blocks as
the rows that the bounds left it need, and its queries go to those blocks and no others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import arrow_map, cut

#: Up to this product of norms float64 holds every sum of products of whole numbers exactly.
EXACT = float(1 << 53)
SLACK = 1e-9


def quantized(embedding: Column) -> Column:
    """floor(256 * x) of each component as double; null where the vector or a component is null, not finite, or too large for a long."""
    usable = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(3.0e16)))
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * 256).cast("bigint"))
    return F.when(embedding.isNotNull() & usable, whole)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of whole numbers, the shorter ones padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lens = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lens) and (lens == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lens), dim), np.int64)
    row = np.repeat(np.arange(len(lens)), lens)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def _cells(df: DataFrame, pivots: np.ndarray, dim: int, most: float | None) -> DataFrame:
    """id, v, cell, d: the nearest pivot and the distance to it; most: the largest squared norm, None for queries."""
    norms = (pivots**2).sum(1)

    def assign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = _matrix(batch.column(1), dim).astype(np.float64)
        extra = np.sqrt(np.maximum(0, most - (x**2).sum(1))) if most is not None else np.zeros(len(x))
        x = np.column_stack([x, extra])
        cell = np.empty(len(x), np.int32)
        for i in range(0, len(x), 4096):
            cell[i : i + 4096] = np.argmin(norms - 2 * x[i : i + 4096] @ pivots.T, axis=1)
        d = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), pa.array(d)], ["id", "v", "cell", "d"])

    return arrow_map(df.select("id", "v"), assign, "id long, v array<long>, cell int, d double")


def _top(left: pa.Table, right: pa.Table, dim: int, k: int) -> pa.Table:
    """The k best of a block of data for each query of a block."""
    right = right.sort_by("id")
    qid, sid = left["id"].to_numpy(), right["id"].to_numpy()
    q, s = _matrix(left["v"], dim), _matrix(right["v"], dim)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    top = lambda m: math.sqrt(max(1.0, float((m.astype(np.float64) ** 2).sum(1).max(initial=0))))
    exact = top(q) * top(s) < EXACT
    s = s.astype(np.float64).T if exact else s.astype(object).T
    for i in range(0, len(qid) if len(sid) else 0, 64):  # a block may have lost all its data to the bounds
        score = q[i : i + 64].astype(np.float64) @ s if exact else (q[i : i + 64].astype(object) @ s)
        if exact:
            lo, hi = np.searchsorted(sid, qid[i : i + 64], "left"), np.searchsorted(sid, qid[i : i + 64], "right")
            for r, (a, b) in enumerate(zip(lo, hi, strict=True)):
                score[r, a:b] = -np.inf
            kth = np.partition(score, max(0, len(sid) - k), axis=1)[:, max(0, len(sid) - k)]
            row, col = np.nonzero((score >= kth[:, None]) & (score > -np.inf))
            order = np.lexsort((col, -score[row, col], row))
            row, col = row[order], col[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, col = row[keep], col[keep]
            out.append((qid[i + row], sid[col], score[row, col].astype(np.int64)))
        else:
            for r in range(len(score)):
                own = [(-int(x), j) for j, x in enumerate(score[r]) if sid[j] != qid[i + r]]
                best = sorted(own)[:k]
                clip = [max(-(2**63), min(2**63 - 1, -x)) for x, _ in best]
                out.append((np.full(len(best), qid[i + r]), sid[[j for _, j in best]] if best else sid[:0], np.array(clip, np.int64)))
    cols = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(3)]
    return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})


#: Pivots by default: a quarter of the square root of the rows, within these ends; all that the driver holds is at most MOST_PIVOTS squared.
LEAST_PIVOTS, MOST_PIVOTS = 32, 512


def voronoi_knn(vectors: DataFrame, queries: DataFrame, k: int, pivots: int | None = None, query_block: int = 2048, data_block: int = 16384) -> DataFrame:
    """The k rows of `vectors` (id, v) with the highest inner product for each row of `queries` (id, v), itself left out.

    Returns query_id, rank, vec_id, score; ties go to the smaller vec_id, and a query with fewer than k others gets all.
    v holds whole numbers; null v or null id takes no part, shorter vectors count as padded with zeros. Rows that share
    an id are candidates each; of queries that share an id the smallest vector stands. Scores beyond a long are cut to
    its range. An empty side gives no rows; other columns of either table are left out. At most `pivots` rows, dealt by a
    hash of the id, serve as pivots (their number grows with the rows where none is given): they decide what is sent
    where, never the result.
    """
    spark = vectors.sparkSession
    data = vectors.filter("id is not null and v is not null").select("id", "v")
    queries = queries.filter("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    dim, most, rows = data.agg(F.max(F.size("v")), F.max(square), F.count(F.lit(1))).first()
    out_schema = "query_id long, rank int, vec_id long, score long"
    dim = max(dim or 0, queries.agg(F.max(F.size("v"))).first()[0] or 0)
    if most is None:
        return spark.createDataFrame([], out_schema)
    dim = max(dim, 1)
    pivots = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(rows) // 4))
    chosen = data.orderBy(F.xxhash64("id"), "id", "v").limit(pivots).collect()
    p = np.zeros((len(chosen), dim + 1))
    for i, row in enumerate(chosen):
        p[i, : len(row.v)] = row.v
        p[i, dim] = math.sqrt(max(0.0, most - float((p[i, :dim] ** 2).sum())))
    p = np.unique(p, axis=0)
    m = len(p)

    s, r = cut(_cells(data, p, dim, most)), cut(_cells(queries, p, dim, None))
    near = s.withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy("d"))).filter(F.col("n") <= k + 1).select("cell", "d", "id").collect()
    far = {x.cell: (x.n, x.d) for x in r.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).collect()}
    if not far:
        return spark.createDataFrame([], out_schema)
    between = np.sqrt(np.maximum(0, (p**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * p @ p.T))
    cells = sorted(far)
    least = np.full((m, m), np.inf)  # of a query's cell and a data cell: the distance to the pivot from which a row is sent
    near_cell, near_d, near_id = (np.array([x[c] for x in near], t) for c, t in enumerate((np.int64, np.float64, np.int64)))
    for i in cells:
        bound = far[i][1] + between[i, near_cell] + near_d
        nearest = np.argsort(bound, kind="stable")
        # A query's own id doesn't count, however many rows have it: the bound is that of the k-th other id.
        bounds = np.sort(bound[nearest[np.unique(near_id[nearest], return_index=True)[1]]])
        theta = bounds[k] if len(bounds) > k else np.inf
        least[i] = (between[i] - far[i][1] - theta) - SLACK * (1 + abs(theta) if theta < np.inf else 1)

    # Neighbouring cells form groups of about query_block queries, so that the data are sent to few groups.
    groups, at, free = {}, 0, list(cells)
    while free:
        seed = free.pop(0)
        held, groups[seed] = far[seed][0], at
        for c in sorted(free, key=lambda c: (between[seed, c], c)):
            if held + far[c][0] <= query_block:
                held, groups[c] = held + far[c][0], at
                free.remove(c)
        at += 1
    lows = [least[[c for c in cells if groups[c] == g]].min(0) for g in range(at)]
    plan = [(g, c, float(low[c])) for g, low in enumerate(lows) for c in np.flatnonzero(low < np.inf).tolist()]
    # At most m rows for each of at most m groups: bounded whatever the input.
    plan = F.broadcast(spark.createDataFrame(plan, "g int, cell int, least double"))
    sent = s.join(plan, "cell").filter("d >= least")
    asks = {g: sum(far[c][0] for c in cells if groups[c] == g) for g in range(at)}
    blocks = [(x.g, -(-asks[x.g] // query_block), -(-x["count"] // data_block)) for x in sent.groupBy("g").count().collect()]
    blocks = F.broadcast(spark.createDataFrame(blocks, "g int, blocks int, parts int"))
    where = F.broadcast(spark.createDataFrame([(c, g) for c, g in groups.items()], "cell int, g int"))

    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    sent = sent.join(blocks, "g").select("g", spread("blocks").alias("qb"), dealt("parts").alias("sb"), "id", "v")
    asked = r.join(where, "cell").join(blocks, "g").select("g", dealt("blocks").alias("qb"), spread("parts").alias("sb"), "id", "v")

    found = asked.groupBy("g", "qb", "sb").cogroup(sent.groupBy("g", "qb", "sb")).applyInArrow(lambda a, b: _top(a, b, dim, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_voronoi_topk(spark, sf_dir: str) -> DataFrame:
    """Queries: vec_id divisible by 50; the five highest inner products of floor(256 * x) among all other rows."""
    from .shared import table

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), quantized(F.col("embedding")).alias("v")).filter("v is not null")
    return voronoi_knn(rows, rows.filter("id % 50 = 0"), k=5)


OP1_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, d.vec_id as vec_id, cast(list_inner_product(q.v, d.v) as bigint) as score
  from v q join v d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
