"""Exact top-k by inner product: distributed histogram selection.

Everything is scored in each round; scores are never stored or shuffled. A round
sums, over all tasks, a histogram of each query's scores within the interval that
holds its k-th score, and the interval shrinks to the bin with that score. With the
exact k-th score known, one last pass returns what lies above it and, of what ties
with it, the smallest ids that are still needed.

A task leaves out the bins below its own k-th score, which the global one can't lie
below, so it sends at most k rows a query and round.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.common import cut, read
from codequarry.ship import map_arrow

K = 5
BINS = 512
#: Queries scored in one pass; bounds the broadcast to QUERY_BLOCK vectors.
QUERY_BLOCK = 4096
_ROWS = 1024
#: Scores are longs; the few that no long holds are held at its ends.
LEAST, MOST = -(2**63), 2**63 - 1


def quantised(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of floor(256 x)) for each length of vector."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return []
    ends = np.asarray(column.offsets).astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(ends)
    out = []
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        out.append((rows, _floors(flat[ends[rows][:, None] + np.arange(d)])))
    return out


def _floors(x: np.ndarray) -> np.ndarray:
    """floor(256 x), finite: a product beyond the doubles is held at the largest one."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(256.0 * x))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as int64, exact to the ends of a long and held there beyond."""
    most = (np.abs(a).max(initial=0.0)) * (np.abs(b).max(initial=0.0)) * max(a.shape[1], 1)
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in a], object), np.array([[int(x) for x in r] for r in b], object)
    return np.clip(whole[0] @ whole[1].T, LEAST, MOST).astype(np.int64)


class _Scorer:
    """Blocks of candidates' scores against one block of queries; own rows are marked."""

    def __init__(self, queries: list[tuple[int, list[float]]]):
        self.ids = np.array([q for q, _ in queries], np.int64)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.array([len(v) for _, v in queries])
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            self.by_size[int(d)] = at, _floors(np.array([queries[i][1] for i in at], np.float64).reshape(len(at), d))

    def __call__(self, batches):
        """Query numbers, candidate ids, scores and whether a pair counts."""
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            for rows, matrix in quantised(batch.column("embedding")):
                if (own := self.by_size.get(matrix.shape[1])) is None:
                    continue
                at, q = own
                for i in range(0, len(rows), _ROWS):
                    cand = ids[rows[i : i + _ROWS]]
                    yield at, cand, scores(matrix[i : i + _ROWS], q), cand[:, None] != self.ids[at][None, :]


def _valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(f"`{vec_col}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & ~bad).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding"))


def _select_block(valid: DataFrame, queries: list[tuple[int, list[float]]], k: int, reach: float) -> tuple[DataFrame, list]:
    """Results of one block of queries, and the broadcasts that they need. reach: no vector is longer."""
    spark = valid.sparkSession
    shared = spark.sparkContext.broadcast(queries)
    n = len(queries)
    # the interval from lo to hi, both included, holds the k-th score of each query; above: how many scores are higher than hi
    lo, hi, above = [0] * n, [0] * n, [0] * n
    for i, (_, v) in enumerate(queries):
        bound = math.ceil(min(1e19, math.sqrt(sum(min(1e300, (abs(x) * 256 + 1) ** 2 if abs(x) < 1e140 else 1e300) for x in v)) * reach * 1.0001)) + 1
        lo[i], hi[i] = max(LEAST, -bound), min(MOST, bound)
    done = [False] * n
    while any(hi[i] > lo[i] and not done[i] for i in range(n)):
        state = spark.sparkContext.broadcast((list(lo), list(hi), list(above), [-(-(h - x + 1) // BINS) for x, h in zip(lo, hi)]))

        def tally(batches, state=state):
            low, high, over = (np.array(x, np.int64) for x in state.value[:3])
            width = np.array(state.value[3], np.uint64)
            seen = np.zeros((n, BINS), np.int64)
            for at, _, s, counts in _Scorer(shared.value)(batches):
                here = counts & (s >= low[at]) & (s <= high[at])
                r, c = np.nonzero(here)
                q = at[c]
                # unsigned, so that the way from the least to the most long fits
                away = s[r, c].view(np.uint64) - low[q].view(np.uint64)
                seen += np.bincount(q * BINS + (away // width[q]).astype(np.int64), minlength=n * BINS).reshape(n, BINS)
            upper = np.cumsum(seen[:, ::-1], axis=1)[:, ::-1] - seen  # of this task, in higher bins
            q, b = np.nonzero((seen > 0) & (upper < (k - over)[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(seen[q, b], pa.int64())], ["q", "bin", "n"])

        summed = map_arrow(valid, tally, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = summed.withColumn("cum", F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin"))))
        need = F.get(F.split(F.lit(",".join(str(k - a) for a in above)), ",").cast("array<long>"), F.col("q"))
        # one row a query of the block: the highest bin with which there are enough
        found = {r["q"]: (r["f"]["bin"], r["f"]["over"]) for r in down.where(F.col("cum") >= need).groupBy("q").agg(F.max(F.struct("bin", (F.col("cum") - F.col("n")).alias("over"))).alias("f")).collect()}
        for i in range(n):
            if hi[i] == lo[i] or done[i]:
                continue
            if i not in found:  # fewer than k candidates in all: every one is a result
                done[i], above[i] = True, 0
                hi[i] = lo[i]
                continue
            width = state.value[3][i]
            b, over = found[i]
            lo[i] += b * width
            hi[i] = min(hi[i], lo[i] + width - 1)
            above[i] += over
        state.destroy()
    last = spark.sparkContext.broadcast((lo, above))

    def pick(batches):
        kth, over = (np.array(x, np.int64) for x in last.value)
        ids = np.array([q for q, _ in shared.value], np.int64)
        tied_q, tied_v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at, cand, s, counts in _Scorer(shared.value)(batches):
            r, c = np.nonzero(counts & (s > kth[at]))
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[c]]), pa.array(cand[r]), pa.array(s[r, c])], ["query_id", "vec_id", "score"])
            r, c = np.nonzero(counts & (s == kth[at]))
            q, v = np.concatenate([tied_q, at[c]]), np.concatenate([tied_v, cand[r]])
            order = np.lexsort((v, q))
            q, v = q[order], v[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            keep = rank < (k - over)[q]
            tied_q, tied_v = q[keep], v[keep]
        yield pa.RecordBatch.from_arrays([pa.array(ids[tied_q]), pa.array(tied_v), pa.array(kth[tied_q])], ["query_id", "vec_id", "score"])

    return map_arrow(valid, pick, "query_id long, vec_id long, score long"), [shared, last]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k highest inner products of each query with all other rows: query_id, rank, vec_id, score.

    Vectors that are null or hold null, NaN or infinite components take no part, nor do
    rows with a null id. A row with the query's id is the query's own. Vectors
    of another length than the query's are no candidates; two empty ones score 0. Ties go to the smaller id. Repeated
    rows are candidates each. A repeated query id counts once, by its first vector in
    component order. Scores are exact wherever a long can hold them; those beyond its ends are held there. Fewer than k candidates: all of
    them. An empty table gives an empty result.

    Queries are taken QUERY_BLOCK at a time, each block against all rows; of several blocks each is
    written to the shared folder, and its queries freed, before the next is brought.
    """
    valid = _valid(vectors, id_col, vec_col)
    own = _valid(queries, id_col, vec_col).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, math.ceil(own.count() / QUERY_BLOCK * 1.1))
    tagged = own.withColumn("__cq_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    reach = min(1e300, valid.agg(F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.pow(F.abs(x) * 256 + 1, F.lit(2)))))).first()[0] or 1.0)
    out, held = None, []
    for b in range(blocks):
        rows = [(r["vec_id"], list(r["embedding"])) for r in tagged.where(F.col("__cq_block") == b).orderBy("vec_id").collect()]
        if rows:
            part, held = _select_block(valid, rows, k, reach)
            if blocks > 1:
                part = cut(part)
                for x in held:
                    x.destroy()
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""
