"""Events, attribution and the composite report of a series. Association in time is not evidence of causation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftlake.functions.columns import sentinel_score, status_from_score
from driftlake.operators import change_points as cp
from driftlake.operators import drift, qc, story
from driftlake.operators import two_sample as ts
from driftlake.operators.basics import fingerprint, lot_transitions, missing_fraction, uncertainty_budget
from driftlake.operators.series import along, kept, running, timed, valid

DAY = 86_400.0
STATUS_RANKS = {"stable": 1, "info": 1, "watch": 2, "warning": 3, "drift_suspected": 4, "critical": 5}


def _seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 1e6


def near(changes: DataFrame, events: DataFrame, days: float) -> DataFrame:
    """changes (series, change_ts) with the events (series, kind, ts, label) within so many days, both ends included.

    Both sides are dealt out by windows of twice that width, an event to the two or three that it can be near, so that
    the join is one of equal keys."""
    width = days * DAY
    slot = lambda c: F.floor(_seconds(c) / width).cast("long")
    left = changes.withColumn("_slot", slot(F.col("change_ts")))
    right = events.select("series", "kind", "ts", "label", F.explode(F.array(slot(F.col("ts")) - 1, slot(F.col("ts")), slot(F.col("ts")) + 1)).alias("_slot"))
    both = left.join(right, ["series", "_slot"])
    return both.where(F.abs(_seconds(F.col("ts")) - _seconds(F.col("change_ts"))) <= width).drop("_slot")


def attributed(changes: DataFrame, events: DataFrame, days: float = 14.0) -> DataFrame:
    """changes with the event of the highest temporal score, null and 0 without one."""
    found = near(changes, events, days)
    away = F.abs(_seconds(F.col("ts")) - _seconds(F.col("change_ts"))) / DAY
    raw = F.exp(-0.5 * (away / (0.4 * max(days, 0.5))) ** 2) * F.when(F.col("kind").isin("lot_change", "calibration", "maintenance"), 1.15).otherwise(1.0)
    found = found.withColumn("raw", raw).withColumn("score", F.least(F.lit(0.99), raw))
    # of events that reach the cap the last one counts, of others the first of the best
    best = Window.partitionBy("series", "change_ts").orderBy(F.desc(F.round("score", 12)), F.when(F.col("raw") > 0.99, -_seconds(F.col("ts"))).otherwise(_seconds(F.col("ts"))), "kind", "label")
    top = found.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("series", "change_ts", "kind", "label", F.col("ts").alias("event_ts"), "score")
    return changes.join(top, ["series", "change_ts"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def nearest(events: DataFrame, df: DataFrame) -> DataFrame:
    """events with the place i of the nearest measurement of their series, the earlier of two as near and the first of one
    time: the last one before and the first one after, found in one ordered pass over ranges of time."""
    rows = running(timed(df), {"_z": F.lit(0.0)}).groupBy("series", "ts").agg(F.min("i").alias("i")).select("series", "ts", F.lit(0).alias("_e"), F.col("i"), F.lit(None).cast("string").alias("label"))
    all_ = rows.unionByName(events.select("series", "ts", F.lit(1).alias("_e"), F.lit(None).cast("bigint").alias("i"), "label"))
    mark = F.when(F.col("_e") == 0, F.struct("ts", "i"))
    both = along(all_, "_e", "i", before={"b": mark}, after={"a": mark}).where("_e = 1")
    db, da = _seconds(F.col("ts")) - _seconds(F.col("b.ts")), _seconds(F.col("a.ts")) - _seconds(F.col("ts"))
    i = F.when(F.col("b").isNull(), F.col("a.i")).when(F.col("a").isNull() | (db <= da), F.col("b.i")).otherwise(F.col("a.i"))
    return both.select("series", "ts", "label", i.alias("i"))


def unique_events(events: DataFrame) -> DataFrame:
    return events.dropDuplicates(["series", "kind", "ts"])


def worst_status(df: DataFrame, key: str) -> DataFrame:
    rank = F.element_at(F.create_map(*[F.lit(x) for p in STATUS_RANKS.items() for x in p]), F.col("status"))
    return df.groupBy(key).agg(F.max_by("status", F.struct(rank.alias("r"), F.col("status").alias("s"))).alias("status"))


def segments(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """(series, segment, from_ts, to_ts, n, mean, sd): figures of each series between its bounds (series, ts); rows at a
    bound belong to both segments."""
    parts = story.marks(df, bounds.select("series", F.lit("bound").alias("kind"), "ts", F.lit(None).cast("string").alias("label")))
    own = story.placed(valid(df).select("series", "seq", "ts", "value"), parts)
    figures = own.groupBy("series", "segment").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return parts.select("series", "segment", "from_ts", "to_ts").join(figures, ["series", "segment"])


SAFETY = "For research and analytical quality only; not a diagnostic device."


def analyze(df: DataFrame, events: DataFrame | None = None, lot: str | None = None, policy: str = "annotate", rules: tuple[str, ...] = tuple(qc.SEVERITY)) -> DataFrame:
    """One report row a series of (series, seq, ts, value[, control, lot, uncertainty]): outliers, change points by the
    detector chosen for the series, drift, variance, distribution, QC of the controls, attribution, score, status, evidence
    and limitations. Every part is keyed by series, so many series run as one; policy: what becomes of outliers."""
    columns = [c for c in ("control",) if c in df.columns]
    base = df.groupBy("series").agg(F.count("*").alias("rows"), missing_fraction(F.col("value")).alias("missing"))
    known = df.where(F.col("ts").isNotNull())
    flagged = qc.outliers(known).groupBy("series").agg(F.count(F.when(F.col("is_outlier"), 1)).alias("n_outliers"))
    own = qc.without_outliers(known, policy)
    work = kept(own.select("series", "seq", "ts", "value", *columns, *([lot] if lot else [])), "report-values")
    out = base.join(work.groupBy("series").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")), "series", "left").join(flagged, "series", "left")
    # the detector is chosen by what is left to look at: finite values, after the policy for outliers
    features = kept(cp.features(work.select("series", "seq", "ts", "value", *columns)), "report-features")
    chosen = features.select("series", F.col("method").alias("change_method"), F.col("reason").alias("change_reason"))
    found = cp.detect_changes(work.select("series", "seq", "ts", "value"), chosen=features)
    changes = found.select("series", F.col("detected").alias("change"), F.col("indices").alias("change_indices"), F.col("confidence").alias("change_confidence"))
    places = kept(drift.in_place(work), "report-places")
    kinds = drift.results_of_all(work, places)
    drifts = drift.best_of(kinds).select("series", F.col("kind").alias("drift_kind"), F.col("detected").alias("drift"), F.col("probability").alias("drift_probability"), F.col("magnitude").alias("drift_magnitude"), F.col("direction").alias("drift_direction"), F.col("start_index").alias("drift_index"))
    variances = kinds["variance"].select("series", F.when(F.col("detected"), F.least(F.lit(1.0), F.abs(F.col("magnitude")))).otherwise(0.0).alias("variance_penalty"), F.when(F.col("detected"), F.col("start_index")).alias("variance_index"))
    placed = places.where("n >= 16")
    side = F.when(F.col("i") <= F.greatest(F.lit(8), F.floor(F.col("n") / 3)), "a").otherwise("b")
    distance = ts.compare_distribution(placed.select("series", side.alias("side"), "value")).select("series", F.col("method").alias("distribution_method"), F.col("distance"), F.least(F.lit(1.0), F.col("distance")).alias("distribution_penalty"))
    for name, part in (("changes", changes), ("drifts", drifts), ("distances", distance)):
        out = out.join(kept(part, f"report-{name}"), "series", "left")  # one row a series, and an end to this part's plan
    out = out.join(chosen, "series", "left").join(variances, "series", "left")
    if columns:
        spec = qc.spec_of(work.where("control")).join(work.where("control").groupBy("series").agg(F.count("*").alias("_c")).where("_c >= 5").select("series"), "series", "left_semi")
        spec = spec.withColumn("sd", F.when(F.coalesce("sd", F.lit(0.0)) == 0, 1.0).otherwise(F.col("sd")))
        hits = kept(qc.monitor(work.where("control"), spec, rules), "report-rules")
        bad = F.count(F.when(F.col("severity").isin("warning", "critical"), 1)) / float(len(rules))
        out = out.join(hits.groupBy("series").agg(bad.alias("qc_penalty"), F.array_sort(F.collect_list("rule")).alias("qc_rules")), "series", "left")
    else:
        out = out.withColumn("qc_penalty", F.lit(0.0)).withColumn("qc_rules", F.lit(None).cast("array<string>"))
    out = out.fillna({"qc_penalty": 0.0, "variance_penalty": 0.0, "distribution_penalty": 0.0, "drift": False, "change": False, "n": 0})
    p = F.coalesce("drift_probability", F.lit(0.0))
    score = sentinel_score({"drift": F.when(F.col("drift"), p).otherwise(0.3 * p), "variance": F.col("variance_penalty"), "qc": F.col("qc_penalty"), "distribution": F.col("distribution_penalty"), "missing": F.col("missing")})
    out = out.withColumn("score", score).withColumn("status", status_from_score(F.col("score"), F.col("drift")))
    lots = lot_transitions(work, lot).select("series", F.lit("lot_change").alias("kind"), "ts", F.concat_ws(" to ", "from_value", "to_value").alias("label")) if lot else None
    if lots is not None or events is not None:
        known = lots if events is None else events if lots is None else events.unionByName(lots)
        at = out.select("series", F.coalesce("drift_index", F.get("change_indices", F.lit(0))).alias("at"))
        when = story.indexed(work).join(at, ["series", "at"]).select("series", F.col("ts").alias("change_ts"))
        cause = attributed(when, unique_events(known)).select("series", "change_ts", F.col("label").alias("associated_event"), F.col("score").alias("association"))
        out = out.join(cause, "series", "left")
    return described(kept(out, "reports"))


def described(reports: DataFrame) -> DataFrame:
    """Reports with evidence and limitations, as lists of sentences."""
    has = lambda c: F.col(c) if c in reports.columns else F.lit(None)
    evidence = F.array_compact(F.array(
        F.when(F.col("drift"), F.format_string("%s drift, probability %.2f, %s.", F.col("drift_kind"), F.col("drift_probability"), F.col("drift_direction"))),
        F.when(F.col("change"), F.format_string("Change points at %s by %s.", F.array_join(F.col("change_indices").cast("array<string>"), ", "), F.col("change_method"))),
        F.when(F.col("distance").isNotNull(), F.format_string("The first third differs from the rest by %.3f (%s).", F.col("distance"), F.col("distribution_method"))),
        F.when(F.size(F.coalesce("qc_rules", F.array().cast("array<string>"))) > 0, F.concat(F.lit("Rules that fired: "), F.array_join("qc_rules", ", "), F.lit("."))),
        F.when(has("associated_event").isNotNull(), F.concat(F.lit("Close in time: "), has("associated_event").cast("string"), F.lit("."))),
    ))
    limits = F.array_compact(F.array(
        F.lit(SAFETY), F.lit("Statistical signals are not diagnoses."), F.lit("Closeness in time to an event is not causation."),
        F.format_string("The change-point detector is %s: %s.", F.col("change_method"), F.col("change_reason")),
        F.when(F.col("missing") > 0, F.format_string("A part of %.3f of the values is missing and was left out.", F.col("missing"))),
    ))
    return reports.withColumn("evidence", evidence).withColumn("limitations", limits)


def budget(df: DataFrame) -> DataFrame:
    return uncertainty_budget(df)


def provenance(df: DataFrame, reports: DataFrame) -> DataFrame:
    """(series, step, id, parent, input_fingerprint, kind, notes): what was done for each report row, in order, with what
    came of it. Every step but the first works on what was read; ids are hashes of a step, its input and its outcome."""
    prints = fingerprint(df).withColumnRenamed("n", "_rows")
    own = reports.join(prints, "series")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    said = {
        "ingest": ("observed", F.format_string("%d rows read, missing ones left out", F.col("rows"))), "outliers": ("statistical", F.concat(text("n_outliers"), F.lit(" outliers"))),
        "changes": ("algorithmic", F.concat_ws(" ", text("change_method"), F.lit("chosen for"), text("change_reason"))), "drift": ("algorithmic", F.concat_ws(" ", text("drift_kind"), text("drift_direction"))),
        "distribution": ("statistical", F.concat_ws(" ", text("distribution_method"), F.round("distance", 6).cast("string"))), "qc": ("observed", F.concat(F.lit("rules: "), F.coalesce(F.array_join("qc_rules", ","), F.lit("none")))),
        "report": ("algorithmic", F.concat_ws(" ", text("status"), F.round("score", 4).cast("string"))),
    }
    ident = lambda step, notes: F.substring(F.sha2(F.concat_ws("|", F.lit(step), F.col("series").cast("string"), F.col("fingerprint"), notes), 256), 1, 16)
    root = ident("ingest", said["ingest"][1])
    steps = [F.struct(F.lit(k).alias("step"), ident(k, notes).alias("id"), (F.lit(None).cast("string") if k == "ingest" else root).alias("parent"), F.lit(kind).alias("kind"), notes.alias("notes")) for k, (kind, notes) in said.items()]
    return own.select("series", F.col("fingerprint").alias("input_fingerprint"), F.explode(F.array(*steps)).alias("s")).select("series", "s.step", "s.id", "s.parent", "input_fingerprint", "s.kind", "s.notes")
