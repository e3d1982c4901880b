"""Hard negatives by bounds along a spanning tree of anchors.

Vectors become integers, floor(scale * x); scores are integer inner products. An anchor's positives are the rows of its
label with the highest scores, and its hard negatives the highest scored rows of other labels inside a window that each
positive's score opens. Anchors and candidates meet tile by tile. In a tile the anchors form a minimum spanning tree by
their distances. The root is scored with every candidate; of any other anchor a candidate's score lies within the tree
edge's length times the candidate's norm of the score (or of the bounds) at the parent anchor - norms are taken from the
mean of the candidate's label, whose own product is exact, so that they are small where labels are clusters. Candidates
whose bounds overlap a window are rescored exactly; all others are settled by the bounds. Where anchors lie far apart, as
random directions do, nearly all candidates overlap and are rescored; the result is the same (`proof` shows the counts).

First pass: the window of an anchor is open above, from its k-th best lower bound among rows of its label. Second pass:
the windows are [ceil(low * p / 100), floor(high * p / 100)] for each positive score p, and begin at the third best
lower bound among candidates that are surely inside. Each tile gives its best few rows an anchor; ranks are taken of
those, so no task holds more than a tile, whatever label or vector is frequent.

Ties go to the smaller id. A null id, label or vector, or a component that is null or not finite, keeps a row out. Rows
are told apart by their place, not by id: repeated ids are rows of their own, each anchor row has its results, and a copy
of an anchor may be its positive. Vectors of different lengths are compared as if the shorter ended in zeros. An anchor
without another row of its label, or a positive without a row in its window (every negative score opens an empty one),
gives no rows; an empty table gives an empty result; further columns of the input are not read. Components or scores
that 64 bits do not hold raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftlake.llm.common import table, written

CANDIDATES, ANCHORS = 16384, 512
BLOCK_ROWS = 1024
#: Above this share of a tile all its candidates are rescored in one product.
DENSE = 0.1


def blocks_of(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(c, n, ids, labels, asked, width, data): blocks of vectors as 64-bit integers, binary; asked marks anchors. c times
    BLOCK_ROWS and the place in the block is the vector's row number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                lengths = np.asarray(batch.column(3).value_lengths()).astype(np.int64)
                width = int(lengths.max(initial=0))
                flat = np.floor(scale * np.asarray(batch.column(3).flatten().to_numpy(zero_copy_only=False), np.float64))
                if np.abs(flat).max(initial=0) >= 2.0**63:
                    raise OverflowError(f"components times {scale} do not fit 64 bits")
                data = np.zeros((batch.num_rows, width), np.int64)
                data[np.arange(width) < lengths[:, None]] = flat.astype(np.int64)
                ids, labels = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for k in (0, 1))
                asked = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
                cells = [pa.array([batch.num_rows], pa.int32()), *(pa.array([x], pa.binary()) for x in (ids, labels, asked)), pa.array([width], pa.int32()), pa.array([data.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, ["n", "ids", "labels", "asked", "width", "data"])

    v = F.col(vector_col).cast("array<double>")
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asked"), v.alias("v"))
    clean = clean.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    clean = clean.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return clean.mapInArrow(run, "n int, ids binary, labels binary, asked binary, width int, data binary").withColumn("c", F.monotonically_increasing_id())


def anchors_of(blocks: DataFrame) -> DataFrame:
    """(row, id, label, width, v binary): the anchors of blocks with their row numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                own = np.flatnonzero(np.frombuffer(b["asked"], np.uint8))
                data = np.frombuffer(b["data"], np.int64).reshape(b["n"], b["width"])[own]
                ids, labels = (np.frombuffer(b[k], np.int64)[own] for k in ("ids", "labels"))
                cells = [pa.array(b["c"] * BLOCK_ROWS + own), pa.array(ids), pa.array(labels), pa.array([b["width"]] * len(own), pa.int32()), pa.array([x.tobytes() for x in data], pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, ["row", "id", "label", "width", "v"])

    return blocks.select("c", "n", "ids", "labels", "asked", "width", "data").mapInArrow(run, "row long, id long, label long, width int, v binary")


def spanning_tree(anchors: np.ndarray) -> list[tuple[int, int, float]]:
    """(anchor, parent, distance) of the minimum spanning tree, parents first; the root's parent is -1."""
    x = anchors.astype(np.float64)
    size = (x * x).sum(1)
    out, near, parent = [(0, -1, 0.0)], np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    left = np.ones(len(x), bool)
    left[0] = False
    last = 0
    for _ in range(len(x) - 1):
        d = size + size[last] - 2 * (x @ x[last])
        closer = left & (d < near)
        near[closer], parent[closer] = d[closer], last
        last = int(np.where(left, near, np.inf).argmin())
        left[last] = False
        out.append((last, int(parent[last]), float(np.sqrt(((x[last] - x[parent[last]]) ** 2).sum()))))
    return out


class Tile:
    """Candidates of a tile in the order of label and id, with their labels' means and the norms from these."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, vectors: np.ndarray, largest: int):
        order = np.lexsort((rows, ids, labels))
        self.ids, self.labels, self.rows, self.vectors = ids[order], labels[order], rows[order], vectors[order]
        most = largest * int(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
        if most >= 1 << 63:
            raise OverflowError("scores do not fit 64 bits")
        self.kind = np.float32 if most < 1 << 23 else np.float64 if most < 1 << 51 else None  # that holds the sums exactly
        self.plain = self.vectors.astype(self.kind) if self.kind else self.vectors
        self.names, self.begin = np.unique(self.labels, return_index=True)
        self.end = np.append(self.begin[1:], len(self.labels))
        self.mean = np.stack([np.rint(self.vectors[a:b].mean(0)) for a, b in zip(self.begin, self.end)]) if len(self.names) else np.zeros((0, vectors.shape[1]))
        self.of = np.repeat(np.arange(len(self.names)), self.end - self.begin)
        self.norm = np.sqrt(((self.vectors - self.mean[self.of]) ** 2).sum(1)) if len(self.names) else np.zeros(0)
        self.slack = 4 + 1e-12 * float(most)  # of sums in floating point

    def score(self, anchor: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        own = self.plain[at]
        return (own @ anchor.astype(self.kind) if self.kind else np.einsum("ij,j->i", own, anchor)).astype(np.int64)

    def walk(self, anchors: np.ndarray, part: slice, wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(anchor, lower bounds, whether they are scores, how many were rescored) for candidates of `part`, by the tree;
        wanted(anchor, low, high) marks those that must be scored."""
        n = part.stop - part.start
        steps = spanning_tree(anchors)
        children = np.bincount([p for _, p, _ in steps if p >= 0], minlength=len(anchors))
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        norm, of = self.norm[part], self.of[part]
        for a, parent, length in steps:
            if parent < 0:
                low = self.score(anchors[a], part).astype(np.float64)
                high, exact, done = low, np.ones(n, bool), n
            else:
                low, high, exact = held[parent]
                if length > 0:
                    shift = (self.mean @ (anchors[a] - anchors[parent]).astype(np.float64))[of]
                    reach = length * norm * (1 + 1e-9) + self.slack
                    low, high, exact = low + shift - reach, high + shift + reach, np.zeros(n, bool)
                need = np.flatnonzero(wanted(a, low, high) & ~exact)
                done = len(need)
                if done > DENSE * n:
                    low = self.score(anchors[a], part).astype(np.float64)
                    high, exact, done = low, np.ones(n, bool), n
                elif done:
                    low, high, exact = low.copy(), high.copy(), exact.copy()
                    low[need] = high[need] = self.score(anchors[a], part.start + need)
                    exact[need] = True
                children[parent] -= 1
                if not children[parent]:
                    del held[parent]
            if children[a]:
                held[a] = low, high, exact
            yield a, low, exact, done

    def best(self, at: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        """The places of `at` with the k highest scores, ties by id."""
        if len(at) > k:
            held = score >= np.partition(score, len(at) - k)[len(at) - k]
            at, score = at[held], score[held]
        return at[np.lexsort((self.ids[at], -score))[:k]]

    def positives(self, rows: np.ndarray, labels: np.ndarray, anchors: np.ndarray, k: int) -> Iterator[tuple[int, int, int, int]]:
        """(anchor, candidate's id, its score, candidates rescored) of the k best candidates of each anchor's label."""
        for label in np.unique(labels).tolist():
            at = int(np.searchsorted(self.names, label))
            if at == len(self.names) or self.names[at] != label:
                continue
            part = slice(int(self.begin[at]), int(self.end[at]))
            mine = np.flatnonzero(labels == label)
            others = self.rows[part] != rows[mine][:, None]

            def wanted(a: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
                known = low[others[a]]
                return others[a] & (high >= (np.partition(known, len(known) - k)[len(known) - k] if len(known) > k else -np.inf))

            for a, low, exact, done in self.walk(anchors[mine], part, wanted):
                at = np.flatnonzero(exact & others[a])
                for c in self.best(part.start + at, low[at], k).tolist():
                    yield int(mine[a]), int(self.ids[c]), int(self.score(anchors[mine[a]], np.array([c]))[0]), done

    def negatives(self, labels: np.ndarray, anchors: np.ndarray, windows: list[list[tuple[int, int]]], k: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(anchor, its window, candidate's id, its score, candidates rescored) of the k best candidates of other labels in
        each window (from, to)."""
        whole = slice(0, len(self.ids))

        def bar(low: np.ndarray, high: np.ndarray, other: np.ndarray, window: tuple[int, int]) -> float:
            inside = low[other & (low >= window[0]) & (high <= window[1])]
            return float(np.partition(inside, len(inside) - k)[len(inside) - k]) if len(inside) >= k else float(window[0])

        def wanted(a: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            other, need = self.labels != labels[a], np.zeros(len(low), bool)
            for window in windows[a]:
                need |= (high >= bar(low, high, other, window)) & (low <= window[1])
            return need & other

        for a, low, exact, done in self.walk(anchors, whole, wanted):
            other = exact & (self.labels != labels[a])
            for w, (least, most) in enumerate(windows[a]):
                at = np.flatnonzero(other & (low >= least) & (low <= most))
                for c in self.best(at, low[at], k).tolist():
                    yield a, w, int(self.ids[c]), int(self.score(anchors[a], np.array([c]))[0]), done


def _tile(held: pa.Table, anchors: pa.Table) -> tuple[Tile, np.ndarray]:
    width = max(max(t.column("width").to_pylist()) for t in (held, anchors))
    vectors = np.zeros((sum(held.column("n").to_pylist()), width), np.int64)
    ids, labels, rows, at = [], [], [], 0
    for b in held.select(["c", "n", "ids", "labels", "width", "data"]).to_pylist():
        vectors[at : at + b["n"], : b["width"]] = np.frombuffer(b["data"], np.int64).reshape(b["n"], b["width"])
        ids.append(np.frombuffer(b["ids"], np.int64))
        labels.append(np.frombuffer(b["labels"], np.int64))
        rows.append(b["c"] * BLOCK_ROWS + np.arange(b["n"]))
        at += b["n"]
    asked = np.zeros((anchors.num_rows, width), np.int64)
    for k, (w, v) in enumerate(zip(anchors.column("width").to_pylist(), anchors.column("v").to_pylist())):
        asked[k, :w] = np.frombuffer(v, np.int64)
    return Tile(np.concatenate(ids), np.concatenate(labels), np.concatenate(rows), vectors, int(np.abs(asked).max(initial=0))), asked


def _met(blocks: DataFrame, anchors: DataFrame, across: int, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Every tile of candidates meets every tile of anchors once; tiles have a fixed size, their numbers grow."""
    down = max(1, -(-anchors.count() // ANCHORS))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = blocks.drop("asked").withColumn("s", F.pmod(F.xxhash64("c"), F.lit(across))).withColumn("t", every(down))
    right = anchors.withColumn("t", F.pmod(F.xxhash64("row"), F.lit(down))).withColumn("s", every(across))
    names = [x.split()[0] for x in schema.split(", ")]

    def meet(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not held.num_rows or not asked.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        return work(held, asked)

    return left.groupBy("t", "s").cogroup(right.groupBy("t", "s")).applyInArrow(meet, schema)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", proof: bool = False
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor row and each of its
    `positives` best rows of its label, the first `negatives` rows of other labels whose score lies between `low` and
    `high` hundredths of the positive's. With proof, also how many candidates of its tile were rescored for the anchor."""
    blocks = written(blocks_of(vectors, is_anchor, label, id_col, vector_col, scale), "candidates")
    anchors = written(anchors_of(blocks), "anchors")
    across = max(1, -(-(blocks.agg(F.sum("n")).first()[0] or 0) // CANDIDATES))

    def table_of(rows: Iterator[tuple], names: list[str]) -> pa.Table:
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(names, columns)})

    def near(held: pa.Table, asked: pa.Table) -> pa.Table:
        tile, x = _tile(held, asked)
        rows, labels = asked.column("row").to_numpy(), asked.column("label").to_numpy()
        return table_of(((int(rows[a]), i, s) for a, i, s, _ in tile.positives(rows, labels, x, positives)), ["row", "positive_id", "p"])

    found = _met(blocks, anchors, across, near, "row long, positive_id long, p long")
    best = Window.partitionBy("row").orderBy(F.desc("p"), "positive_id")
    found = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= positives)
    # a negative score opens no window
    opened = found.where(F.col("p") >= 0).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_id", "p"))).alias("positives"))
    opened = written(anchors.join(opened, "row"), "windows")

    def mine(held: pa.Table, asked: pa.Table) -> pa.Table:
        tile, x = _tile(held, asked)
        rows, ids, own = asked.column("row").to_pylist(), asked.column("id").to_pylist(), asked.column("positives").to_pylist()
        different = [sorted({p["p"] for p in o}) for o in own]
        windows = [[(-(-low * p // 100), high * p // 100) for p in d] for d in different]
        hits = tile.negatives(asked.column("label").to_numpy(), x, windows, negatives)
        out = ((rows[a], ids[a], p["nth"], p["positive_id"], p["p"], i, s, done) for a, w, i, s, done in hits for p in own[a] if p["p"] == different[a][w])
        return table_of(out, ["row", "anchor_id", "nth", "positive_id", "positive_score", "negative_id", "negative_score", "rescored"])

    mined = _met(blocks, opened, across, mine, "row long, anchor_id long, nth long, positive_id long, positive_score long, negative_id long, negative_score long, rescored long")
    best = Window.partitionBy("row", "nth").orderBy(F.desc("negative_score"), "negative_id")
    mined = mined.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", *(("rescored",) if proof else ()))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0, F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


#: All scores of anchors with all other rows, in plain SQL; rows are told apart by r.
ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    COALESCE(CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2])) AS BIGINT), 0) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.r <> c.r
), p AS (
  SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS nth
  FROM s WHERE same QUALIFY nth <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.r, nth ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.r = p.r AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.r, nth ORDER BY s.score DESC, s.vec_id) <= 3
"""
