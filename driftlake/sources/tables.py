"""CSV tables with discovered columns, simulated series, and report files.

Reports are small: one row a series. Parquet holds all of them; JSON and Markdown are for one report table at a time and
are written through the driver, with non-finite numbers as null.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlake.functions.columns import truthy
from driftlake.operators.series import from_table

VALUE_NAMES, TIME_NAMES = ("value", "result", "measurement", "y"), ("timestamp", "time", "datetime", "date", "ts")
KINDS = ("none", "linear", "step", "variance", "periodic", "failure")


def discovered(df: DataFrame, names: tuple[str, ...], numeric: bool = False) -> str | None:
    """The first column of one of the names (in any case), else, if numeric, the first numeric one."""
    by = {c.lower(): c for c in df.columns}
    found = next((by[n] for n in names if n in by), None)
    return found or (next((f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)), None) if numeric else None)


_NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[nN][aA][nN]|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"
_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d+)?)?$"


def cell(c: str | Column) -> Column:
    """A cell's text without white space around it; null for an empty one."""
    return F.nullif(F.trim(F.col(c) if isinstance(c, str) else c, F.lit(" \t\r\n")), F.lit(""))


def cell_number(c: str | Column) -> Column:
    """The number that a cell is, else null: digits, perhaps with a point and an exponent, NaN and Inf; no other text."""
    return F.when(cell(c).rlike(_NUMBER), F.regexp_replace(cell(c), "(?i)inf$", "Infinity").try_cast("double"))


def cell_time(c: str | Column) -> Column:
    """The time that a cell is, else null: a date, or date and time with T or a space between them."""
    return F.when(cell(c).rlike(_TIME), cell(c).try_cast("timestamp_ntz"))


def cell_truth(c: str | Column) -> Column:
    return F.when(F.lower(cell(c)) == "true", True).when(F.lower(cell(c)) == "false", False)


def cell_kind(c: str | Column) -> Column:
    """none, number, time, truth or text: the first that a cell can be."""
    return F.when(cell(c).isNull(), "none").when(cell_number(c).isNotNull(), "number").when(cell_time(c).isNotNull(), "time").when(cell_truth(c).isNotNull(), "truth").otherwise("text")


def typed(df: DataFrame) -> DataFrame:
    """df with each column of text as numbers, times or truths, if all of its cells that hold something are; kinds are counted
    in one aggregate over all columns."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    kinds = ("number", "time", "truth")
    counts = df.agg(*(F.count(F.when(cell_kind(c) == k, 1)).alias(f"{i}_{k}") for i, c in enumerate(texts) for k in (*kinds, "text"))).first()
    as_ = {"number": cell_number, "time": cell_time, "truth": cell_truth}
    found = {c: [k for k in (*kinds, "text") if counts[f"{i}_{k}"]] for i, c in enumerate(texts)}
    return df.withColumns({c: as_[k[0]](c) if len(k) == 1 and k[0] in as_ else cell(c) for c, k in found.items()})


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV files with a header, by the rules for cells; rows with too few cells are filled with nulls."""
    return typed(spark.read.csv(path, header=True))


def read_measurements(spark: SparkSession, path: str, value: str | None = None, time: str | None = None, series: str | None = None, keep: bool = False) -> DataFrame:
    """A measurements table from CSV files with a header. Columns are found by name, the value column else as the first one
    whose first cell is a number. Cells of text in the value column (NA, <5) are missing values, and in the time column
    missing times; no pass over the files is made to find types. With keep, the other columns come along, typed by all
    their cells, control as a boolean."""
    df = spark.read.csv(path, header=True)
    df = typed(df) if keep else df
    value, time = value or discovered(df, VALUE_NAMES), time or discovered(df, TIME_NAMES)
    if value is None:
        first = df.select(*(cell_number(F.col(c).cast("string")).isNotNull().alias(c) for c in df.columns)).first()
        value = next((c for c in df.columns if first is not None and first[c] and c != time), None)
    if value is None or time is None:
        raise ValueError(f"no {'value' if value is None else 'time'} column among {df.columns}")
    kinds = dict(df.dtypes)
    df = df.withColumns({c: as_(c) for c, as_ in ((value, cell_number), (time, cell_time)) if kinds[c] == "string"})
    series = series or discovered(df, ("analyte", "series"))
    more = {c.lower(): c for c in df.columns if keep and c not in (value, time, series) and c.lower() not in ("series", "seq", "ts", "value")}
    if "control" in more:
        more["control"] = truthy(F.col(more["control"]))
    return from_table(df, value=value, time=time, series=series, **more)


def simulated(spark: SparkSession, n: int, kind: str = "none", start: int | None = None, mean: float = 100.0, sd: float = 1.0, seed: int = 7, noise: bool = True) -> DataFrame:
    """Hourly measurements with a drift of a kind from a place on; without noise its shape alone."""
    if kind not in KINDS:
        raise ValueError(f"no kind {kind!r}")
    i, since = F.col("id") + 1, F.greatest(F.col("id") + 1 - (n // 2 if start is None else start), F.lit(0))
    on = since > 0
    e = F.randn(seed) * sd if noise else F.lit(0.0)
    shape = {
        "none": F.lit(0.0) + e, "linear": 0.004 * since + e, "step": F.when(on, 0.08 * mean).otherwise(0.0) + e, "variance": F.when(on, 1.8 * e).otherwise(e),
        "periodic": F.when(on, 0.015 * mean * F.sin(2 * math.pi * i / 48)).otherwise(0.0) + e, "failure": F.when(on, 0.2 * mean + 2.2 * e).otherwise(e),
    }[kind]
    ts = (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).cast("timestamp_ntz")
    return spark.range(n).select(F.lit(kind).alias("series"), i.alias("seq"), ts.alias("ts"), (mean + shape).alias("value"))


ASSAY_KINDS = ("none", "linear", "step", "variance", "lot", "batch", "periodic", "failure", "outliers")


def simulated_assays(spark: SparkSession, n: int, kinds: tuple[str, ...] = ("none",), copies: int = 1, start: int | None = None, mean: float = 100.0, sd: float = 2.0, lots: int = 1, instruments: int = 1, control_every: int = 10, outlier_rate: float = 0.0, seed: int = 7) -> DataFrame:
    """Copies of six-hourly measurements for each kind of drift (series: kind-copy), with lot, instrument, batch, control, and
    the truth: true_mean, true_sd, is_outlier and drift_start. Values depend on the seed, the series and the place alone."""
    if any(k not in ASSAY_KINDS for k in kinds) or n < 2:
        raise ValueError(f"kinds are {ASSAY_KINDS}, and n is 2 at least")
    begin = max(1, n // 2) if start is None else start
    kind, i = F.col("kind"), F.col("seq")
    rows = spark.range(n).select((F.col("id") + 1).alias("seq")).withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds]))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    on, is_ = i >= begin, lambda k: kind == k
    level = (
        F.when(is_("linear") & on, 0.004 * (i - begin)).when(is_("step") & on, 0.08 * mean).when(is_("periodic"), 0.015 * mean * F.sin(2 * math.pi * i / 48)).when(is_("failure") & on, 0.2 * mean)
        .when(is_("lot") & on, 0.04 * mean).when(is_("batch") & (i % 96 < 8), 0.03 * mean).otherwise(0.0)
    )
    spread = F.when(is_("variance") & on, 1.8 * sd).when(is_("failure") & on, 2.2 * sd).otherwise(sd)
    part = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "kind", "copy", "seq"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = F.sqrt(-2 * F.ln(part(1))) * F.cos(2 * math.pi * part(2))
    rate = F.when(is_("outliers"), max(outlier_rate, 0.02)).otherwise(outlier_rate)
    ts = (F.lit("2025-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (6 * (i - 1)).cast("int"))).cast("timestamp_ntz")
    out = rows.select(
        F.concat_ws("-", "kind", F.col("copy").cast("string")).alias("series"), "seq", ts.alias("ts"), normal.alias("_z"), (part(3) < rate).alias("is_outlier"), F.when(part(4) < 0.5, -1).otherwise(1).alias("_sign"),
        (mean + level).alias("true_mean"), spread.alias("true_sd"), F.lit(begin).alias("drift_start"), F.concat(F.lit("R"), (F.ceil(i * max(lots, 1) / F.lit(n)) + 20).cast("string")).alias("lot"),
        F.concat(F.lit("Analyzer-"), ((i - 1) % max(instruments, 1) + 1).cast("string")).alias("instrument"), F.concat(F.lit("B"), (F.floor((i - 1) / 48) + 1).cast("string")).alias("batch"), (F.lit(control_every > 0) & (i % max(control_every, 1) == 0)).alias("control"),
    )
    value = F.col("true_mean") + F.col("true_sd") * (F.col("_z") + F.when(F.col("is_outlier"), 6 * F.col("_sign")).otherwise(0))
    return out.withColumn("value", value).drop("_z", "_sign")


def showcase(spark: SparkSession, seed: int = 7) -> DataFrame:
    """A year of one analyte: three lots of different level, two instruments, a calibration at value 720, a slow drift from 980
    on, more spread from 1200 on, and control failures at 1100, 1101 and 1300 to 1302."""
    own = simulated_assays(spark, 1460, instruments=2, seed=seed).withColumn("series", F.lit("glucose"))
    i, z = F.col("seq"), (F.col("value") - F.col("true_mean")) / F.col("true_sd")
    lot = F.when(i < 480, "R21").when(i < 980, "R22").otherwise("R23")
    level = 100 + F.when(lot == "R22", 1.2).when(lot == "R23", 2.0).otherwise(0.0) - F.when((i >= 720) & (i < 740), 0.8).otherwise(0.0) + F.when(i >= 980, 0.006 * (i - 980)).otherwise(0.0)
    spread, failed = F.when(i >= 1200, 3.4).otherwise(2.0), i.isin(1100, 1101, 1300, 1301, 1302)
    own = own.withColumn("value", level + F.when(failed, 3.6).otherwise(z) * spread).withColumns({"true_mean": level, "true_sd": spread})
    return own.withColumns({"lot": lot, "control": (i % 8 == 0) | failed, "failed": failed, "calibration_id": F.when(i >= 720, "CAL-08").otherwise("CAL-07"), "uncertainty": F.lit(0.4)})


def plain(x):
    if isinstance(x, float) and not math.isfinite(x):
        return None
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x


def nested(rows: list[dict], panel: str | None = None, study: list[dict] | None = None) -> dict:
    """What a report file holds: reports, those of panels under the panel's name, or those of sites beside their study."""
    if study is not None:
        return {"schema_version": 1, "kind": "study", "studies": study, "site_reports": rows}
    if panel is not None:
        panels: dict[str, list[dict]] = {}
        for r in rows:
            panels.setdefault(str(r.get(panel)), []).append(r)
        return {"schema_version": 1, "kind": "panel", "panels": [{"name": k, "reports": v} for k, v in sorted(panels.items())]}
    return {"schema_version": 1, "reports": rows}


def save_reports(reports: DataFrame, path: str, panel: str | None = None, study: DataFrame | None = None) -> None:
    """By the path's ending: .json, .md and .html through the driver, anything else as Parquet. In JSON, panel names the
    column that reports are put together by; study are the rows of `sites.study` that the reports' sites belong to."""
    if path.endswith(".html"):
        from driftlake.sources.pages import html

        with open(path, "w") as f:
            f.write(html(reports))
        return
    if not path.endswith((".json", ".md")):
        reports.write.mode("overwrite").parquet(path)
        return
    rows = [plain(r.asDict(recursive=True)) for r in reports.toLocalIterator()]
    with open(path, "w") as f:
        if path.endswith(".json"):
            json.dump(nested(rows, panel, None if study is None else [plain(r.asDict(recursive=True)) for r in study.toLocalIterator()]), f, default=str)
        else:
            names = reports.columns
            f.write("\n".join([f"| {' | '.join(names)} |", f"|{'-|' * len(names)}", *(f"| {' | '.join('' if r[c] is None else str(r[c]) for c in names)} |" for r in rows)]) + "\n")


def load_reports(spark: SparkSession, path: str) -> DataFrame | list[dict]:
    if path.endswith(".json"):
        with open(path) as f:
            held = json.load(f)
        return held.get("reports") or held.get("site_reports") or [r for p in held.get("panels", ()) for r in p["reports"]]
    return spark.read.parquet(path)
