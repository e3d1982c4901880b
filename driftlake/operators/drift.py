"""Drift of several kinds; each detector gives one row a series:
(series, kind, detected, probability, magnitude, direction, start_index). Rows without a finite value or without a time
take no part, and places count the others (with by_index, times are not needed). Series of fewer than 8 values are not
detected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftlake.functions.columns import direction, normal_sf
from driftlake.operators import change_points as cp
from driftlake.operators import two_sample as ts
from driftlake.operators.series import kept, percentiles, running, timed, valid, with_stats
from driftlake.operators.slopes import theil_sen

EPS = 2.0**-52


def _result(df: DataFrame, kind: str, detected: Column, probability: Column, magnitude: Column, way: Column, start: Column, n: Column) -> DataFrame:
    ok = (n >= 8) & F.coalesce(detected, F.lit(False))
    return df.select(
        "series", F.lit(kind).alias("kind"), ok.alias("detected"), F.when(n >= 8, probability).otherwise(0.0).alias("probability"), magnitude.cast("double").alias("magnitude"),
        way.alias("direction"), start.cast("bigint").alias("start_index"), n.cast("bigint").alias("n"),
    )


def in_place(df: DataFrame, by_index: bool = False) -> DataFrame:
    """Rows with i and n, _m (the series' mean) and running sums s1 and s2 of differences from it and their squares: what
    all kinds of drift are found from."""
    own = with_stats(valid(df) if by_index else timed(df), _m=F.avg("value"))
    d = F.col("value") - F.col("_m")
    return running(own, {"s1": d, "s2": d * d})


def _timed(own: DataFrame, by_index: bool) -> DataFrame:
    """Rows of in_place with k (their place), x (hours since the series began, or the place) and y."""
    if by_index:
        x = F.col("i").cast("double")
    else:
        first = own.groupBy("series").agg(F.min("ts").alias("_t0"))
        own = own.join(first, "series")
        x = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_t0").cast("timestamp"))) / 3.6e9
    return own.select("series", F.col("i").alias("k"), "n", x.alias("x"), F.col("value").alias("y"))


def _residuals(points: DataFrame) -> DataFrame:
    return points.join(theil_sen(points), "series").withColumn("e", F.col("y") - F.col("intercept") - F.col("slope") * F.col("x"))


def linear(df: DataFrame, by_index: bool = False, lines: DataFrame | None = None) -> DataFrame:
    """Theil-Sen slope against its approximate standard error."""
    own = (lines if lines is not None else _residuals(_timed(in_place(df, by_index), by_index))).groupBy("series").agg(
        F.first("slope").alias("slope"), F.stddev_samp("e").alias("se"), F.stddev_samp("x").alias("sx"), F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("span"), F.avg("y").alias("mean")
    )
    sigma = F.when(F.coalesce("se", F.lit(0.0)) == 0, 1.0).otherwise(F.col("se"))
    z = F.when(F.coalesce("sx", F.lit(0.0)) == 0, 0.0).otherwise(F.col("slope") * F.nullif("sx", F.lit(0.0)) * F.sqrt(F.col("n").cast("double")) / sigma)
    own = own.withColumn("z", z).withColumn("p", 2 * normal_sf(F.abs("z")))
    detected = (F.col("p") < 0.01) & (F.abs("z") > 2.5)
    probability = F.when(detected, F.least(F.lit(0.99), 1 - F.col("p"))).otherwise(F.greatest(F.lit(0.05), 1 - F.col("p")) * 0.4)
    magnitude = F.col("slope") * F.col("span") / F.when(F.col("mean") == 0, 1.0).otherwise(F.abs("mean"))
    return _result(own, "linear", detected, probability, magnitude, direction(F.col("slope")), F.lit(1), F.col("n"))


def nonlinear(df: DataFrame, by_index: bool = False, lines: DataFrame | None = None) -> DataFrame:
    """Whether a least-squares parabola leaves much less than the Theil-Sen line does. From moments of centred times."""
    own = with_stats(lines if lines is not None else _residuals(_timed(in_place(df, by_index), by_index)), mx=F.avg("x"), my=F.avg("y"))
    u, v = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    m = own.groupBy("series").agg(
        F.sum(F.col("e") ** 2).alias("r1"), F.sum(u * u).alias("s2"), F.sum(u * u * u).alias("s3"), F.sum(u * u * u * u).alias("s4"), F.sum(u * v).alias("uy"), F.sum(u * u * v).alias("uuy"),
        F.sum(v * v).alias("yy"), F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("span"), F.first("my").alias("mean"),
    )
    q = F.col("s4") - F.col("s2") ** 2 / F.col("n") - F.col("s3") ** 2 / F.nullif("s2", F.lit(0.0))
    qy = F.col("uuy") - F.col("s3") / F.nullif("s2", F.lit(0.0)) * F.col("uy")
    m = m.withColumn("curve", qy / F.nullif(q, F.lit(0.0))).withColumn("r2", F.col("yy") - F.col("uy") ** 2 / F.nullif("s2", F.lit(0.0)) - qy * qy / F.nullif(q, F.lit(0.0)))
    f = (F.col("r1") - F.col("r2")) / F.nullif(F.col("r2") / F.greatest(F.col("n") - 3, F.lit(1)), F.lit(0.0))
    m = m.withColumn("f", f)
    detected = F.coalesce((F.col("f") > 6) & (F.col("r2") < 0.92 * F.col("r1")), F.lit(False))
    return _result(m, "nonlinear", detected, F.when(detected, F.least(F.lit(0.95), 0.5 + F.col("f") / 40)).otherwise(0.15), F.col("curve") * F.col("span") ** 2 / (F.abs("mean") + EPS), direction(F.col("curve")), F.lit(1), F.col("n"))


def sudden(df: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """One change of mean by the likelihood-ratio scan. own: in_place of df, as for the kinds below."""
    own = in_place(df) if own is None else own
    found = cp.likelihood(df, own.withColumn("place", F.col("i"))).select("series", "detected", "confidence", F.get("indices", F.lit(0)).alias("tau"))
    own = own.join(found, "series")
    left = F.col("i") <= F.col("tau")
    m = own.groupBy("series").agg(F.avg(F.when(left, F.col("value"))).alias("m1"), F.avg(F.when(~left, F.col("value"))).alias("m2"), F.first("detected").alias("found"), F.first("confidence").alias("confidence"), F.first("tau").alias("tau"), F.count("*").alias("n"))
    step = F.col("m2") - F.col("m1")
    return _result(m, "sudden", F.col("found"), F.when(F.col("found"), F.col("confidence")).otherwise(0.0), F.when(F.col("found"), step / (F.abs("m1") + EPS)), F.when(F.col("found"), direction(step)).otherwise("none"), F.when(F.col("found"), F.col("tau")), F.col("n"))


def variance(df: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Cumulative sums of squares against the supremum of a Brownian bridge (5 per cent: 1.358)."""
    sums = (in_place(df) if own is None else own).withColumnRenamed("s2", "c")
    total = sums.groupBy("series").agg(F.max("c").alias("total"))
    sums = sums.join(total, "series").withColumn("dk", F.abs(F.col("c") / F.nullif("total", F.lit(0.0)) - F.col("i") / F.col("n")))
    best = cp.first_largest(sums, F.round("dk", 12), "n").withColumnsRenamed({"i": "tau", "statistic": "dk"})
    sides = sums.select("series", "i", "value").join(best, "series")
    left = F.col("i") <= F.col("tau")
    m = sides.groupBy("series").agg(F.stddev_samp(F.when(left, F.col("value"))).alias("a"), F.stddev_samp(F.when(~left, F.col("value"))).alias("b"), F.first("tau").alias("tau"), F.first("dk").alias("dk"), F.first("n").alias("n"))
    m = m.withColumn("stat", F.sqrt(F.col("n") / 2.0) * F.col("dk"))
    detected = F.coalesce(F.col("stat") > 1.358, F.lit(False))
    return _result(m, "variance", detected, F.when(detected, F.least(F.lit(0.98), 0.5 + (F.col("stat") - 1.358) / 4)).otherwise(0.15), (F.col("b") - F.col("a")) / (F.col("a") + EPS), direction(F.col("b") - F.col("a")), F.col("tau"), F.col("n"))


def cyclic(df: DataFrame, own: DataFrame | None = None, most: int = 40) -> DataFrame:
    """The share of the largest of the first harmonics in the power of all of them."""
    own = (in_place(df) if own is None else own).withColumn("z", F.col("value") - F.col("_m"))
    # one aggregate with a sum of cosines and one of sines for each harmonic; rows are not multiplied
    turn = 2 * math.pi / F.col("n") * F.col("i")
    sums = own.where("n >= 4").groupBy("series").agg(F.first("n").alias("n"), *(F.sum(F.col("z") * f(turn * k)).alias(f"{x}{k}") for k in range(1, most + 1) for x, f in (("c", F.cos), ("s", F.sin))))
    powers = F.array(*[F.when(F.col("n") >= 4 * k, (F.col(f"c{k}") ** 2 + F.col(f"s{k}") ** 2) / F.col("n")).otherwise(0.0) for k in range(1, most + 1)])
    m = sums.select("series", "n", powers.alias("p"))
    m = m.withColumn("g", F.coalesce(F.array_max("p") / F.nullif(F.aggregate("p", F.lit(0.0), lambda s, x: s + x), F.lit(0.0)), F.lit(0.0)))
    detected = (F.col("g") > 0.35) & (F.col("n") >= 16)
    return _result(m, "cyclic", detected, F.when(detected, F.least(F.lit(0.9), F.col("g"))).otherwise(0.1), F.col("g"), F.lit("cyclic"), F.lit(1), F.col("n"))


def distribution(df: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """The first third of each series against the rest, by Kolmogorov and Smirnov; eight values on each side."""
    own = in_place(df) if own is None else own
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    pooled = own.select("series", "value", "n", F.when(F.col("i") <= third, "a").otherwise("b").alias("side"))
    k = ts.ks(pooled).withColumnsRenamed({"n": "na", "m": "nb"})
    means = pooled.groupBy("series").agg((F.avg(F.when(F.col("side") == "b", F.col("value"))) - F.avg(F.when(F.col("side") == "a", F.col("value")))).alias("delta"), F.first("n").alias("n"))
    m = means.join(k, "series", "left")
    ok = F.coalesce((F.col("na") >= 8) & (F.col("nb") >= 8), F.lit(False))
    detected = ok & (F.col("p") < 0.01)
    probability = F.when(~ok, 0.0).when(detected, 1 - F.col("p")).when(F.col("p") < 0.1, 0.4).otherwise(0.15)
    return _result(m, "distribution", detected, probability, F.when(ok, F.col("d")), F.when(ok, direction(F.col("delta"))).otherwise("none"), F.when(ok, F.col("na") + 1), F.col("n"))


KINDS = {"linear": linear, "sudden": sudden, "variance": variance, "distribution": distribution, "cyclic": cyclic, "nonlinear": nonlinear}


def detect_drift(df: DataFrame, kind: str = "auto") -> DataFrame:
    """One kind, or the kind of the highest probability (the first of equals in the order of KINDS)."""
    if kind == "calibration":
        return df.select("series").distinct().select("series", F.lit(kind).alias("kind"), F.lit(False).alias("detected"), F.lit(0.0).alias("probability"), F.lit(None).cast("double").alias("magnitude"), F.lit("none").alias("direction"), F.lit(None).cast("bigint").alias("start_index"), F.lit(None).cast("bigint").alias("n"))
    if kind != "auto":
        if kind not in KINDS:
            raise ValueError(f"no drift kind {kind!r}")
        return KINDS[kind](df)
    return best_of(results_of_all(df))


def results_of_all(df: DataFrame, placed: DataFrame | None = None) -> dict[str, DataFrame]:
    """Each kind's results, one row a series; all are written in one table, which what builds on them reads. Places and sums
    are made once for all kinds. placed: in_place of df, written."""
    placed = kept(in_place(df), "drift-places") if placed is None else placed
    lines = kept(_residuals(_timed(placed, False)), "drift-lines")
    all_ = None
    for k, f in KINDS.items():
        own = f(df, lines=lines) if k in ("linear", "nonlinear") else f(df, placed)
        all_ = own if all_ is None else all_.unionByName(own)
    found = kept(all_, "drifts")
    return {k: found.where(F.col("kind") == k) for k in KINDS}


def best_of(results: dict[str, DataFrame]) -> DataFrame:
    out = None
    for order, (name, found) in enumerate(results.items()):
        own = found.withColumn("_order", F.lit(order))
        own = own.where(F.col("n") >= {"cyclic": 16, "nonlinear": 20}.get(name, 0))
        out = own if out is None else out.unionByName(own)
    # a probability that is not a number never wins
    best = Window.partitionBy("series").orderBy(F.desc_nulls_last(F.round(F.nanvl("probability", F.lit(None).cast("double")), 9)), "_order")
    return out.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "_order")


def mean_vector(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, covariances and number of (features array<double>) rows: as many figures as features squared."""
    p = len(rows.select("features").first()[0])

    def run(batches):
        n, total, square, center = 0, np.zeros(p), np.zeros((p, p)), None
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, p)
                center = x[0] if center is None else center  # sums about a row of the part lose fewer digits
                n, total, square = n + len(x), total + (x - center).sum(0), square + (x - center).T @ (x - center)
        if n:
            mean = total / n
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(center + mean).tobytes()]), pa.array([(square - n * np.outer(mean, mean)).tobytes()])], ["n", "mean", "scatter"])

    def merged(parts) -> tuple[int, np.ndarray, np.ndarray]:
        n, mean, scatter = 0, np.zeros(p), np.zeros((p, p))
        for r in parts:
            own, more = np.frombuffer(r["mean"]), np.frombuffer(r["scatter"]).reshape(p, p)
            away, whole = own - mean, n + r["n"]
            mean, scatter, n = mean + away * r["n"] / whole, scatter + more + np.outer(away, away) * n * r["n"] / whole, whole
        return n, mean, scatter

    def merge(t: pa.Table) -> pa.Table:
        n, mean, scatter = merged(r for batch in t.to_batches(1) for r in batch.to_pylist())
        return pa.table({"n": [n], "mean": [mean.tobytes()], "scatter": [scatter.tobytes()]})

    # features squared numbers a partition, merged in groups of partitions first and those in the driver
    schema = "n bigint, mean binary, scatter binary"
    parts = rows.select(F.col("features").cast("array<double>")).mapInArrow(run, schema)
    parts = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(32)).alias("g")).applyInArrow(lambda t: merge(t.select(["n", "mean", "scatter"])), schema)
    n, mean, scatter = merged(parts.collect())
    return mean, scatter / max(1, n - 1), n


def _halves(df: DataFrame, fraction: float) -> tuple[DataFrame, DataFrame, int]:
    """Rows (seq, features) with all features finite: the first part and the rest, in the order of seq."""
    own = df.where(F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    n = own.count()
    n0 = max(8, round(fraction * n))
    # halfway behind the place where the first part ends: an exact percentile, so no task takes the first part in order
    at = percentiles(own.select(F.lit(1).alias("all"), "seq"), ("all",), "seq", edge=min(1.0, (n0 - 0.5) / max(1, n - 1))).first() if n else None
    edge = at["edge"] if at else None
    return own.where(F.col("seq") <= edge), own.where(F.col("seq") > edge), n0 if n >= 12 else 0


def multivariate(df: DataFrame, method: str = "mahalanobis", baseline: float = 0.4) -> DataFrame:
    """One row: whether the later rows of (seq, features) leave the earlier ones' cloud."""
    first, rest, n0 = _halves(df, baseline)
    spark = df.sparkSession
    schema = "method string, detected boolean, probability double, magnitude double, start_index bigint"
    if not n0:
        return spark.createDataFrame([(method, False, 0.0, None, None)], schema)
    if method == "energy":
        sums = {(r["a"], r["b"]): (r["total"], r["pairs"]) for r in distance_sums(first, rest).collect()}  # three rows
        mean_distance = lambda a, b: sums[a, b][0] / sums[a, b][1]
        d = 2 * mean_distance(0, 1) - mean_distance(0, 0) - mean_distance(1, 1)
        level = first.select(F.avg(F.aggregate("features", F.lit(0.0), lambda s, x: s + F.abs(x)) / F.size("features"))).first()[0]
        hit = d > 0.15 * (level + 1)
        return spark.createDataFrame([(method, bool(hit), 0.75 if hit else 0.2, float(d), n0 + 1)], schema)
    mean, cov, _ = mean_vector(first)
    p = len(mean)
    if method == "covariance":
        _, other, _ = mean_vector(rest)
        corr = lambda c: c / np.sqrt(np.outer(np.diag(c), np.diag(c)))
        d = float(np.linalg.norm(corr(cov) - corr(other)) / p)
        return spark.createDataFrame([(method, d > 0.25, min(0.9, d) if d > 0.25 else 0.15, d, n0 + 1)], schema)
    if method == "mahalanobis":
        matrix, center = np.linalg.inv(cov + 1e-6 * np.eye(p)), mean
        figure = F.sqrt(F.greatest(_quadratic(matrix, center), F.lit(0.0)))
        value = rest.agg(F.avg(figure)).first()[0]
        ratio = value / math.sqrt(p)
        return spark.createDataFrame([(method, ratio > 1.6, min(0.95, 0.5 + (ratio - 1) / 3) if ratio > 1.6 else 0.2, float(ratio), n0 + 1)], schema)
    if method == "pca":
        values, vectors = np.linalg.eigh(cov)
        k = min(3, p)
        top = np.argsort(values)[::-1][:k]
        axes = vectors[:, top]
        matrix = axes @ np.linalg.inv(np.diag(values[top]) + 1e-6 * np.eye(k)) @ axes.T
        value = float(rest.agg(F.avg(_quadratic(matrix, mean))).first()[0])
        return spark.createDataFrame([(method, value > 2 * k, min(0.95, value / (value + k)) if value > 2 * k else 0.2, value, n0 + 1)], schema)
    raise ValueError(f"no multivariate method {method!r}")


def distance_sums(first: DataFrame, rest: DataFrame, tile: int = 4096) -> DataFrame:
    """(a, b, total, pairs): sums of the distances between all rows (features) of two tables (0 and 1), by tables, rows
    with themselves included. Equal rows are counted first, so a frequent one is one row. The different ones are dealt out
    in tiles; each two tiles meet once, as matrices, and give sums only."""
    both = first.select("features", F.lit(0).alias("side")).unionByName(rest.select("features", F.lit(1).alias("side")))
    both = kept(both.groupBy("features", "side").agg(F.count("*").alias("w")), "different-vectors")
    n = both.count()
    tiles = max(1, -(-n // tile))
    own = both.withColumn("tile", F.pmod(F.xxhash64("features", "side"), F.lit(tiles)).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).select("features", "side", "w", "tile", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"))

    def run(t: pa.Table) -> pa.Table:
        x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
        side, of, weight = t.column("side").to_numpy(), t.column("tile").to_numpy(), t.column("w").to_numpy().astype(float)
        values = np.array(t.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(t.num_rows, -1)
        rows, total, pairs = [], {}, {}
        left, right = np.flatnonzero(of == x), np.flatnonzero(of == y)
        size = (values**2).sum(1)
        for a in range(0, len(left), 512):
            part = left[a : a + 512]
            square = size[part][:, None] + size[right][None, :] - 2 * values[part] @ values[right].T
            far = np.sqrt(np.maximum(square, 0.0))
            if x == y:
                far[part[:, None] == right[None, :]] = 0.0
            for p in (0, 1):
                for q in (0, 1):
                    block = far[side[part] == p][:, side[right] == q]
                    # two different tiles meet once for both orders of each pair; 0 with 1 is counted once in any case
                    key, times = (min(p, q), max(p, q)), 2 if x != y and p == q else 1
                    if x == y and p > q:
                        continue
                    u, v = weight[part][side[part] == p], weight[right][side[right] == q]
                    total[key] = total.get(key, 0.0) + times * float(u @ block @ v)
                    pairs[key] = pairs.get(key, 0) + times * round(u.sum() * v.sum())
        rows = [(*k, v, pairs[k]) for k, v in total.items()]
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["a", "b", "total", "pairs"])

    found = met.groupBy("x", "y").applyInArrow(run, "a int, b int, total double, pairs bigint")
    return found.groupBy("a", "b").agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))


def _quadratic(matrix: np.ndarray, center: np.ndarray) -> Column:
    """(x - center)' matrix (x - center) of the features, inside the JVM: sums of squares along its axes."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    out = F.lit(0.0)
    centered = F.zip_with("features", F.array(*[F.lit(float(c)) for c in center]), lambda x, c: x - c)
    for value, axis in zip(values, vectors.T):
        if abs(value) > 1e-15:
            along = F.aggregate(F.zip_with(centered, F.array(*[F.lit(float(a)) for a in axis]), lambda x, a: x * a), F.lit(0.0), lambda s, x: s + x)
            out = out + float(value) * along * along
    return out
