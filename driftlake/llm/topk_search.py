"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Vectors become integers, floor(scale * x). A block of candidates is indexed by postings: for each dimension its
components by quantised impact (the values themselves if there are no more than LEVELS of them), each segment of one
impact listing the candidates that have it. A block of queries processes the segments by descending impact - what a
posting can add to or take from a score at most - into accumulators. Of what is not processed yet each dimension can add
or take its largest remaining impact at most, and quantisation half a step; so every candidate's score lies between two
bounds. A candidate is dropped only when its upper bound lies below the k-th best lower bound - that is the proof - and
processing stops when few are left or all is processed; whoever may still be a member is rescored exactly in 64-bit
integers.

Queries are a stated set of rows; they and the candidates meet block by block, so no task sees more than one block of
each. Ties go to the smaller id. Vectors that are null, or hold a null or a component that is not finite, take no part
(an empty vector has score 0 with everything), nor do rows without id; repeated ids are separate rows; an empty table
gives no rows; further columns of the input are not read. Vectors of different lengths are compared as if the shorter
ended in zeros. Components or scores that 64 bits do not hold raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftlake.llm.common import table, written

CANDIDATES = 16384
QUERIES = 2048
BLOCK_ROWS = 1024
#: Queries that share a pass over the segments, impacts of a dimension at most, and the parts of the largest impact down
#: to which segments are processed before bounds are looked at.
STEP, LEVELS, STOPS = 128, 256, (1 / 4, 1 / 16, 0.0)


def packed_blocks(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str, scale: float, rows: int = BLOCK_ROWS) -> DataFrame:
    """(c, ids binary, asked binary, width, data binary): blocks of at most `rows` vectors as 64-bit integers.

    asked: a byte a vector, 1 for queries. c times BLOCK_ROWS and the place in the block is the vector's row number, so `rows`
    is no more than that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, data, width = [], [], [], 0

        def block() -> pa.RecordBatch:
            whole = np.zeros((sum(map(len, data)), width), np.int64)
            at = 0
            for x in data:
                whole[at : at + len(x), : x.shape[1]] = x
                at += len(x)
            own = np.concatenate(ids)
            return pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary()), pa.array([np.concatenate(asked).tobytes()], pa.binary()), pa.array([width], pa.int32()), pa.array([whole.tobytes()], pa.binary())], ["ids", "asked", "width", "data"])

        for batch in batches:
            held, vector = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1)
            query = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            lengths = np.asarray(vector.value_lengths())
            flat = np.asarray(vector.flatten().to_numpy(zero_copy_only=False), np.float64)
            begins = np.concatenate([[0], np.cumsum(lengths)])
            for n in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == n)
                x = np.floor(scale * flat[(begins[own, None] + np.arange(n)).ravel()]).reshape(len(own), n)
                if np.abs(x).max(initial=0) >= 2.0**63:
                    raise OverflowError(f"components times {scale} do not fit 64 bits")
                x = x.astype(np.int64)
                a = 0
                while a < len(own):
                    room = rows - sum(map(len, data))
                    part = slice(a, a + room)
                    ids.append(held[own[part]])
                    asked.append(query[own[part]])
                    data.append(x[part])
                    width = max(width, n)
                    a += room
                    if len(data[-1]) == room:
                        yield block()
                        ids, asked, data, width = [], [], [], 0
        if data:
            yield block()

    clean = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    clean = clean.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return clean.mapInArrow(run, "ids binary, asked binary, width int, data binary").withColumn("c", F.monotonically_increasing_id())


def query_blocks(blocks: DataFrame) -> DataFrame:
    """(q, rows binary, ids binary, width, data binary): the queries of packed blocks with their row numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                own = np.flatnonzero(np.frombuffer(block["asked"], np.uint8))
                if len(own):
                    data = np.frombuffer(block["data"], np.int64).reshape(-1, block["width"])[own] if block["width"] else np.zeros((0, 0), np.int64)
                    columns = ((block["c"] * BLOCK_ROWS + own).tobytes(), np.frombuffer(block["ids"], np.int64)[own].tobytes(), data.tobytes())
                    yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in columns), pa.array([block["width"]], pa.int32())], ["rows", "ids", "data", "width"])

    return blocks.select("c", "ids", "asked", "width", "data").mapInArrow(run, "rows binary, ids binary, data binary, width int").withColumn("q", F.monotonically_increasing_id())


def _widest(blocks: pa.Table) -> int:
    return max(blocks.column("width").to_pylist())


def _matrix(blocks: pa.Table, to: int) -> tuple[np.ndarray, np.ndarray]:
    ids, rows = [], []
    for own, width, data in zip(*(blocks.column(x).to_pylist() for x in ("ids", "width", "data"))):
        ids.append(np.frombuffer(own, np.int64))
        rows.append(np.zeros((len(ids[-1]), to), np.int64))
        rows[-1][:, :width] = np.frombuffer(data, np.int64).reshape(len(ids[-1]), width)
    return np.concatenate(ids), np.concatenate(rows)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner product of each row of a with its row of b."""
    return np.einsum("ij,ij->i", a, b)


def sure_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same of integers whose products may not fit 64 bits: sums that fit are right even if their parts do not."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    near, size = products(x, y), products(np.abs(x), np.abs(y))
    for i in np.flatnonzero(np.abs(near) + 2.0**-40 * size >= 2.0**63).tolist():  # too large, or too near to tell
        if abs(sum(p * q for p, q in zip(a[i].tolist(), b[i].tolist()))) >= 1 << 63:
            raise OverflowError("scores do not fit 64 bits")
    return products(a, b)


class ImpactIndex:
    """Postings of a block of integer vectors, by dimension and quantised impact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.rows = ids[order], vectors[order], rows[order]
        self.largest = np.abs(self.vectors).max(0, initial=0)
        step = np.maximum(1, -(-(2 * self.largest + 1) // LEVELS))
        self.error = np.where(step > 1, step / 2, 0.0)  # by which a component may differ from its impact
        level = np.rint(self.vectors / step).astype(np.int64)
        dimension, place = np.nonzero(level.T)
        level = level[place, dimension]
        by_impact = np.lexsort((place, level, dimension))
        dimension, level, self.place = dimension[by_impact], level[by_impact], place[by_impact]
        cuts = np.flatnonzero((np.diff(dimension) != 0) | (np.diff(level) != 0)) + 1
        self.begin = np.concatenate([[0], cuts, [len(level)]]) if len(level) else np.zeros(1, np.int64)
        first = self.begin[:-1]
        self.dimension, self.impact = dimension[first], (level[first] * step[dimension[first]]).astype(np.float64)

    def candidates(self, queries: np.ndarray, own: np.ndarray, k: int, kind: type) -> tuple[np.ndarray, int]:
        """(candidate, query) flags of those that may be among the k best, and the postings processed to prove it."""
        others = self.rows[:, None] != own
        n = len(self.ids)
        if n <= k + 1:
            return others, 0
        size = np.abs(queries).astype(np.float64)
        top = size.max(0, initial=0)
        weight = top[self.dimension] * np.abs(self.impact)
        order = np.argsort(-weight, kind="stable")
        score = np.zeros((n, len(queries)), kind)
        add = np.ascontiguousarray(queries.T).astype(kind)
        at, done, possible = 0, 0, others
        for stop in STOPS:
            above = stop * float(weight.max(initial=0))
            to = int(np.searchsorted(-weight[order], -above, "left"))
            for segment in order[at:to].tolist():
                held = self.place[self.begin[segment] : self.begin[segment + 1]]
                score[held] += add[self.dimension[segment]] * kind(self.impact[segment])
                done += len(held)
            at = to
            rest = np.minimum(self.largest, above / np.maximum(top, 1e-300))
            open_ = size @ (rest + self.error)
            if stop and not (2 * open_ < score.max(0) - score.min(0)).any():
                continue  # no candidate can be told from another yet
            known = np.where(others, score, -np.inf)
            bar = np.partition(known, n - k, axis=0)[n - k]
            possible = known >= bar - 2 * open_
            possible &= others
            if possible.sum() <= 4 * k * len(queries):
                break
        return possible, done

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(query's place, candidate id, score, postings processed, candidates rescored) of the k best of this block for
        each query, its own row left out."""
        most = int(self.largest.max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, queries.shape[1])
        score_of = products if most < 1 << 63 else sure_products
        out = []
        for a in range(0, len(queries), STEP):
            q, mine = queries[a : a + STEP], own[a : a + STEP]
            if most < 1 << 51:  # accumulators hold the sums exactly
                possible, done = self.candidates(q, mine, k, np.float32 if most < 1 << 23 else np.float64)
            else:
                possible, done = self.rows[:, None] != mine, 0
            row, column = np.nonzero(possible.T)
            score = np.empty(len(row), np.int64)
            for b in range(0, len(row), 1 << 16):
                part = slice(b, b + (1 << 16))
                score[part] = score_of(q[row[part]], self.vectors[column[part]])
            rescored = np.bincount(row, minlength=len(q))
            order = np.lexsort((self.ids[column], -score, row))
            row, column, score = row[order], column[order], score[order]
            first = np.searchsorted(row, np.arange(len(q)))
            keep = np.arange(len(row)) - first[row] < k
            row, column, score = row[keep], column[keep], score[keep]
            out.append((row + a, self.ids[column], score, np.full(len(row), done), rescored[row]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 5


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", proof: bool = False) -> DataFrame:
    """(query_id, rank, <id_col>, score): the k rows of highest inner product with each query row, itself left out.

    Rows of equal id are rows of their own: each query row has its list, and other rows of its id may stand in it. With
    proof, also how many postings of a block were processed before it stopped, and how many candidates were rescored."""
    candidates = written(packed_blocks(vectors, is_query, id_col, vector_col, scale), "candidates")
    asked = written(query_blocks(candidates), "queries")
    # every tile of candidates meets every tile of queries once; the tiles' sizes are fixed, their numbers grow
    across = _tiles(candidates, CANDIDATES)
    down = _tiles(asked, QUERIES)
    left = candidates.withColumn("s", F.pmod(F.xxhash64("c"), F.lit(across))).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))))
    right = asked.withColumn("t", F.pmod(F.xxhash64("q"), F.lit(down))).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))

    def meet(held: pa.Table, queries: pa.Table) -> pa.Table:
        names = ("query_row", "query_id", "id", "score", "processed", "rescored")
        if not held.num_rows or not queries.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        to = max(_widest(held), _widest(queries))
        own, asked_vectors = _matrix(queries, to)
        own_rows = np.concatenate([np.frombuffer(x, np.int64) for x in queries.column("rows").to_pylist()])
        ids, vectors_ = _matrix(held, to)
        rows = np.concatenate([c * BLOCK_ROWS + np.arange(len(x) // 8) for c, x in zip(held.column("c").to_pylist(), held.column("ids").to_pylist())])
        place, *found = ImpactIndex(ids, vectors_, rows).search(asked_vectors, own_rows, k)
        return pa.table(dict(zip(names, (own_rows[place], own[place], *found))))

    met = left.groupBy("t", "s").cogroup(right.groupBy("t", "s"))
    found = met.applyInArrow(meet, "query_row long, query_id long, id long, score long, processed long, rescored long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score", *(("processed", "rescored") if proof else ()))


def _tiles(blocks: DataFrame, rows: int) -> int:
    n = blocks.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    return max(1, -(-n // (8 * rows)))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, F.col("vec_id") % 20 == 0)


#: Integer inner products of all pairs of a query and another row, in plain SQL.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
