"""Charts as SVG and report pages as HTML. Charts show at most MOST_POINTS rows, thinned out by Spark before anything
reaches the driver, and say how many they leave out; report tables have one row a series."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.operators.series import running, valid
from driftlake.sources.tables import plain

MOST_POINTS, WIDTH, HEIGHT, EDGE = 640, 800, 260, 40
NOTICE = "For research and analytical-quality work only. Association in time is not causation. Not a diagnostic device."


def thinned(df: DataFrame, series) -> list[tuple]:
    """(i, ts, value) of every k-th finite value of a series, k the least that leaves at most MOST_POINTS."""
    own = running(valid(df.where(F.col("series") == series)), {"_z": F.lit(0.0)})
    every = F.ceil(F.col("n") / MOST_POINTS)
    return [tuple(r) for r in own.where((F.col("i") - 1) % every == 0).select("i", "ts", "value").orderBy("i").collect()]


def _first(rows: DataFrame, *order: str) -> tuple[list, str]:
    """The first MOST_POINTS rows in an order, and what a title says of the others."""
    n = rows.count()
    return (rows.orderBy(*order) if order else rows).limit(MOST_POINTS).collect(), "" if n <= MOST_POINTS else f" (the first {MOST_POINTS} of {n}; {n - MOST_POINTS} are not shown)"


def _scale(low: float, high: float, start: float, end: float):
    width = (high - low) or 1.0
    return lambda v: round(start + (v - low) / width * (end - start), 1)


def _svg(title: str, body: list[str], height: int = HEIGHT) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {height}" font-family="sans-serif" font-size="11"><text x="{EDGE}" y="16">{escape(title)}</text>{"".join(body)}</svg>'


def _points(points: list[tuple[float, float]], low: float, high: float) -> tuple:
    xs = [p[0] for p in points]
    return _scale(min(xs), max(xs), EDGE, WIDTH - EDGE), _scale(low, high, HEIGHT - EDGE, EDGE)


def control_chart(df: DataFrame, series) -> str:
    """A series against its mean and the limits of two and three standard deviations."""
    points = thinned(df, series)
    n, mean, sd = valid(df.where(F.col("series") == series)).agg(F.count("*"), F.avg("value"), F.coalesce(F.stddev_samp("value"), F.lit(0.0))).first()
    if not n:
        return _svg(f"{series}: no values", [])
    low, high = min(mean - 3.5 * sd, *(p[2] for p in points), mean), max(mean + 3.5 * sd, *(p[2] for p in points), mean)
    x, y = _points([(p[0], p[2]) for p in points], low, high)
    body = [f'<line x1="{EDGE}" x2="{WIDTH - EDGE}" y1="{y(mean + k * sd)}" y2="{y(mean + k * sd)}" stroke="{c}"/>' for k, c in ((0, "#333"), (2, "#c90"), (-2, "#c90"), (3, "#c33"), (-3, "#c33"))]
    body += [f'<circle cx="{x(i)}" cy="{y(v)}" r="2" fill="#26c"/>' for i, _, v in points]
    return _svg(f"{series}: n={n}, mean={mean:.4g}, sd={sd:.4g}", body)


def timeline(beats: DataFrame, series) -> str:
    """The beats of a series' story on a line."""
    rows, rest = _first(beats.where(F.col("series") == series).select("beat", "ts", "label"), "beat")
    if not rows:
        return _svg(f"{series}: nothing to tell", [])
    at = [r.ts.timestamp() for r in rows]
    x = _scale(min(at), max(at), EDGE, WIDTH - 4 * EDGE)
    body = [f'<line x1="{EDGE}" x2="{WIDTH - EDGE}" y1="40" y2="40" stroke="#333"/>']
    for k, r in enumerate(rows):
        body.append(f'<circle cx="{x(at[k])}" cy="40" r="4" fill="#26c"/><text x="{x(at[k])}" y="{60 + 14 * k}">{escape(r.label)}</text>')
    return _svg(f"{series}{rest}", body, 80 + 14 * len(rows))


def forest_chart(rows: DataFrame, title: str = "Estimates") -> str:
    """(name, mid, low, high): an estimate and its interval each; sites, groups or panels."""
    own, rest = _first(rows, "name")
    if not own:
        return _svg(title, [])
    x = _scale(min(r.low for r in own), max(r.high for r in own), 4 * EDGE, WIDTH - EDGE)
    body = []
    for k, r in enumerate(own):
        y = 40 + 18 * k
        body.append(f'<text x="{EDGE}" y="{y + 4}">{escape(str(r["name"]))}</text><line x1="{x(r.low)}" x2="{x(r.high)}" y1="{y}" y2="{y}" stroke="#333"/><circle cx="{x(r.mid)}" cy="{y}" r="4" fill="#26c"/>')
    return _svg(f"{title}{rest}", body, 60 + 18 * len(own))


#: Colours of a status.
STATUS_COLORS = {"critical": "#8B2E2E", "drift_suspected": "#8B2E2E", "warning": "#8B2E2E", "watch": "#c90"}


def panel_chart(reports: DataFrame, title: str = "Panel") -> str:
    """A bar for the score (0 to 100) of each report (series, status, score), coloured by its status."""
    own, rest = _first(reports.select(F.col("series").cast("string").alias("series"), "status", F.coalesce("score", F.lit(0.0)).alias("score")), "series")
    x, body = _scale(0.0, 100.0, 4 * EDGE, WIDTH - 3 * EDGE), []
    for k, r in enumerate(own):
        y, end = 40 + 24 * k, max(4 * EDGE + 2, x(min(100.0, max(0.0, r.score))))
        label = f"{r.score:.0f} {str(r.status).replace('_', ' ')}"
        body.append(f'<text x="{EDGE}" y="{y + 4}">{escape(r.series)}</text><rect x="{4 * EDGE}" y="{y - 8}" width="{end - 4 * EDGE}" height="16" fill="{STATUS_COLORS.get(r.status, "#277")}"/><text x="{end + 6}" y="{y + 4}">{escape(label)}</text>')
    body.append(f'<text x="{EDGE}" y="{56 + 24 * len(own)}" fill="#777">Scores tell of the analytical process, not of a patient. {escape(NOTICE)}</text>')
    return _svg(f"{title}{rest}", body, 70 + 24 * len(own))


def group_chart(df: DataFrame, group: str) -> str:
    """Mean and two standard errors of each lot, instrument or batch."""
    mean, error = F.avg("value"), F.coalesce(F.stddev_samp("value") / F.sqrt(F.count("value")), F.lit(0.0))
    return forest_chart(valid(df).groupBy(F.col(group).cast("string").alias("name")).agg(mean.alias("mid"), (mean - 2 * error).alias("low"), (mean + 2 * error).alias("high")), group)


def provenance_chart(edges: DataFrame, series) -> str:
    """The steps that led to a report, from left to right."""
    rows, rest = _first(edges.where(F.col("series") == series).select("step"))
    steps = [r.step for r in rows]
    body = [f'<text x="{EDGE + 90 * k}" y="50">{escape(s)}</text><line x1="{EDGE + 90 * k}" x2="{EDGE + 90 * k + 80}" y1="58" y2="58" stroke="#333"/>' for k, s in enumerate(steps)]
    return _svg(f"{series}{rest}", body, 80)


def html(reports: DataFrame, charts: dict[str, str] | None = None, title: str = "Report") -> str:
    """A page with a table of reports, one row a series, and charts under their names."""
    names = reports.columns
    rows = [plain(r.asDict(recursive=True)) for r in reports.toLocalIterator()]
    cells = lambda tag, xs: "".join(f"<{tag}>{escape('' if x is None else str(x))}</{tag}>" for x in xs)
    table = "".join(f"<tr>{cells('td', (r[c] for c in names))}</tr>" for r in rows)
    pictures = "".join(f"<h2>{escape(k)}</h2>{v}" for k, v in (charts or {}).items())
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><table border="1"><tr>{cells("th", names)}</tr>{table}</table>{pictures}<p>{escape(NOTICE)}</p></body></html>'
