"""How well detectors find planted changes: sensitivity, false alarms, precision and delay, over many series at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.operators import change_points as cp
from driftlake.operators.series import by_series, kept, valid, with_stats
from driftlake.sources import tables


def planted(df: DataFrame, size: float = 3.0, seed: int = 7) -> DataFrame:
    """Two series of each one: its values in an order of hashes, which has no change, and the same with a step of so many
    standard deviations from the middle on (series: (series, planted)); with start, the last place before the step."""
    own = with_stats(valid(df), _sd=F.coalesce(F.stddev_samp("value"), F.lit(0.0)), _n=F.count("*"))
    shuffled = own.select("series", "_sd", "_n", "value", F.row_number().over(by_series(F.xxhash64(F.lit(seed), "seq"), "seq")).alias("seq"))
    start = F.floor(F.col("_n") / 2)
    hours = F.make_dt_interval(F.lit(0), F.col("seq").cast("int"))
    ts = (F.lit("2020-01-01").cast("timestamp_ntz") + hours).cast("timestamp_ntz")
    both = shuffled.withColumn("planted", F.explode(F.array(F.lit(False), F.lit(True))))
    value = F.col("value") + F.when(F.col("planted") & (F.col("seq") > start), size * F.col("_sd")).otherwise(0.0)
    return both.select(F.struct("series", "planted").alias("series"), F.col("seq").cast("bigint").alias("seq"), ts.alias("ts"), value.alias("value"), start.alias("start"))


def scored(found: DataFrame, starts: DataFrame) -> DataFrame:
    """(method, series, sensitivity, false_positive_rate, precision, mean_delay, median_delay) from results (series:
    (series, planted), method, detected, first: the first place found) and starts (series, start)."""
    own = found.join(starts, "series").withColumn("planted", F.col("series.planted"))
    hit, alarm = F.col("planted") & F.col("detected"), ~F.col("planted") & F.col("detected")
    delay = F.when(hit, F.greatest(F.lit(0), F.col("first") - F.col("start"))).cast("double")
    count = lambda c: F.count(F.when(c, 1))
    return own.groupBy("method").agg(
        count(F.col("planted")).alias("series"), (count(hit) / F.greatest(count(F.col("planted")), F.lit(1))).alias("sensitivity"), (count(alarm) / F.greatest(count(~F.col("planted")), F.lit(1))).alias("false_positive_rate"),
        (count(hit) / F.greatest(count(F.col("detected")), F.lit(1))).alias("precision"), F.avg(delay).alias("mean_delay"), F.percentile(delay, F.lit(0.5)).alias("median_delay"),
    )


def evaluate(df: DataFrame, methods: tuple[str, ...] = ("likelihood",), size: float = 3.0, seed: int = 7) -> DataFrame:
    """Scores of change-point methods on planted steps in the series of df."""
    return scored_methods(planted(df, size, seed), methods)


def scored_methods(rows: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    rows = kept(rows, "planted")
    starts = rows.groupBy("series").agg(F.first("start").alias("start"))
    out = None
    for method in methods:
        found = cp.detect_changes(rows.drop("start"), method).select("series", F.lit(method).alias("method"), "detected", F.array_min("indices").alias("first"))
        out = found if out is None else out.unionByName(found)
    return scored(out, starts)


def simulated(spark: SparkSession, drift: str = "step", n: int = 800, drift_start: int = 500, copies: int = 20, seed: int = 7) -> DataFrame:
    """Simulated assays with a drift, and as many without, of known truth: (series: (series, planted), seq, ts, value, start)."""
    rows = tables.simulated_assays(spark, n, (drift, "none"), copies, drift_start, seed=seed)
    planted_ = ~F.col("series").startswith("none-")
    return rows.select(F.struct(F.substring_index("series", "-", -1).alias("series"), planted_.alias("planted")).alias("series"), "seq", "ts", "value", F.col("drift_start").cast("bigint").alias("start"))


def evaluate_simulated(spark: SparkSession, methods: tuple[str, ...] = ("cusum",), drift: str = "step", n: int = 800, drift_start: int = 500, copies: int = 20, seed: int = 7) -> DataFrame:
    """Scores of change-point methods on simulated assays; the delay counts from the drift's true start."""
    return scored_methods(simulated(spark, drift, n, drift_start, copies, seed), methods)


def evaluate_detector(df: DataFrame, detector, size: float = 3.0, seed: int = 7, fit: bool = True) -> DataFrame:
    """Scores of an incremental detector (`streaming.detectors.Detector`), built in or of one's own, on planted steps: a step
    counts as found by an alarm from it on, a series without one as a false alarm by any. With fit, the detector starts
    from the moments of the first values: a third of those before the step, 20 at least, or 40 where there is none."""
    return scored_detector(kept(planted(df, size, seed), "planted"), detector, fit)


def evaluate_simulated_detector(spark: SparkSession, detector, drift: str = "step", n: int = 400, drift_start: int = 250, copies: int = 20, seed: int = 7, fit: bool = True) -> DataFrame:
    """The same on simulated assays."""
    return scored_detector(simulated(spark, drift, n, drift_start, copies, seed), detector, fit)


def scored_detector(rows: DataFrame, detector, fit: bool = True) -> DataFrame:
    from driftlake.streaming import detectors

    rows = kept(rows, "evaluated")
    key = F.to_json("series")
    starts = rows.groupBy("series").agg(F.first("start").alias("start"))
    first = F.when(F.col("series.planted"), F.greatest(F.lit(20), F.floor(F.col("start") / 3))).otherwise(40)
    seeds = detectors.moments(rows.where(F.col("seq") <= first).withColumn("series", key)) if fit else None
    alarms = detectors.replayed(rows.drop("start").withColumn("series", key), detector, seeds).where("detected").select("series", "seq")
    after = starts.withColumn("name", key).join(alarms.withColumnRenamed("series", "name"), "name", "left")
    counts = F.when(F.col("series.planted"), F.col("seq") >= F.col("start")).otherwise(F.col("seq").isNotNull())
    found = after.groupBy("series").agg(F.lit(type(detector).__name__).alias("method"), F.coalesce(F.max(counts), F.lit(False)).alias("detected"), F.min(F.when(counts, F.col("seq"))).alias("first"))
    return scored(found, starts)
