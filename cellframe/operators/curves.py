"""Analytics of curves (path, point_no, col_no, label, x, y) and convergence logs (run_id, file_no, line_no, chi_q, chi_r)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import finite
from ..functions.storage import ranked, staged
from ..sources.catalog import COMPARED, KIND_ORDER


def _pairs(points: DataFrame, obs_col: int, fit_col: int) -> DataFrame:
    """One row per point with x, obs and fit: a pivot by aggregation, one shuffle and no join."""
    y = lambda c: F.max(F.when(F.col("col_no") == c, F.col("y")))
    two = points.where(F.col("col_no").isin(obs_col, fit_col))
    return two.groupBy("path", "point_no").agg(F.max("x").alias("x"), y(obs_col).alias("obs"), y(fit_col).alias("fit")).where("obs is not null and fit is not null")


def _rwp(inside: Column | None = None) -> Column:
    """sqrt(sum((fit - obs)^2) / sum(obs^2)); 0 if the denominator is 0 or nothing is inside."""
    keep = (lambda c: F.when(inside, c)) if inside is not None else (lambda c: c)
    top = F.sum(keep((F.col("fit") - F.col("obs")) * (F.col("fit") - F.col("obs"))))
    low = F.coalesce(F.sum(keep(F.col("obs") * F.col("obs"))), F.lit(0.0))
    return F.when(low == 0, 0.0).otherwise(F.sqrt(top / F.when(low != 0, low)))


def rwp(points: DataFrame, obs_col: int = 1, fit_col: int = 2) -> DataFrame:
    """(path, rwp) of files that have both columns."""
    return _pairs(points, obs_col, fit_col).groupBy("path").agg(_rwp().alias("rwp"))


def rwp_range(points: DataFrame, obs_col: int = 1, fit_col: int = 2, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Rwp over lo <= x <= hi; without bounds from the first to the last point's x, which is empty for falling x."""
    pairs = _pairs(points, obs_col, fit_col)
    ends = pairs.groupBy("path").agg(F.min_by("x", "point_no").alias("lo"), F.max_by("x", "point_no").alias("hi"))
    low, high = F.col("lo") if lo is None else F.lit(lo), F.col("hi") if hi is None else F.lit(hi)
    return pairs.join(ends, "path").groupBy("path").agg(_rwp(F.col("x").between(low, high)).alias("rwp"))


def residuals(points: DataFrame, obs_col: int = 1, fit_col: int = 2) -> DataFrame:
    return _pairs(points, obs_col, fit_col).select("path", "point_no", "x", (F.col("fit") - F.col("obs")).alias("residual"))


def q_weighted(points: DataFrame) -> DataFrame:
    return points.select("path", "point_no", "col_no", "x", (F.col("x") * F.col("y")).alias("qy"))


def chi_steps(chi: DataFrame) -> DataFrame:
    """Adds step: the row's number over a run's files, which follow one another; a run of any length, without a window over it."""
    return ranked(chi, ["run_id"], ["file_no", "line_no"], step=["run_id"]).withColumn("step", F.col("step").cast("int"))


def chi_log(steps: DataFrame, clamped: bool = True) -> DataFrame:
    """Natural logarithm of chi_r: of at least 1e-12, or unclamped with -inf at 0 and NaN below."""
    c = F.col("chi_r")
    log = F.ln(F.greatest(c, F.lit(1e-12))) if clamped else F.when(c > 0, F.ln(F.when(c > 0, c))).when(c == 0, float("-inf")).otherwise(float("nan"))
    return steps.select("run_id", "step", "chi_r", log.alias("log_chi"))


def final_chi(steps: DataFrame) -> DataFrame:
    """Last and best chi_r and the number of steps of each run; the same for batch and stream."""
    return steps.groupBy("run_id").agg(F.max_by("chi_r", "step").alias("final_chi"), F.min("chi_r").alias("best_chi"), F.count(F.lit(1)).alias("n_steps"))


def visible_series(points: DataFrame, hidden: DataFrame) -> DataFrame:
    """points without the series whose (path, label) is hidden."""
    return points.join(hidden, ["path", "label"], "left_anti")


def y_domain(points: DataFrame, x_lo: float, x_hi: float, pad: float = 0.05) -> DataFrame:
    """Padded range of y over finite points inside the x range, or over all if none is inside; one wide if flat."""
    ok = finite(F.col("x")) & finite(F.col("y"))
    inside = ok & F.col("x").between(x_lo, x_hi)
    got = points.groupBy("path").agg(
        F.min(F.when(inside, F.col("y"))).alias("a"), F.max(F.when(inside, F.col("y"))).alias("b"), F.min(F.when(ok, F.col("y"))).alias("c"), F.max(F.when(ok, F.col("y"))).alias("d")
    )
    lo, hi = F.coalesce("a", "c", F.lit(0.0)), F.coalesce("b", "d", F.lit(1.0))
    wide = F.when(lo == hi, F.lit(1.0)).otherwise((hi - lo) * pad)
    return got.select("path", (lo - wide).alias("y_lo"), (hi + wide).alias("y_hi"))


def nearest_point(points: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe (path, probe), the nearest point of each series of that path, the first of equals: an as-of join.

    Points and probes of a series go into one stream, ordered by x and dealt by ranges of (path, label, x), so that a
    series of any length lies in many tasks.  A probe takes the last point before it and the next one after it in its own
    part, or, where its part has none, from the nearest part before or after, whose outermost points are a row a part.
    Points whose x is null or NaN are near nothing.  Work grows with the points and with probes times series of their paths.
    """
    keys = ["path", "label"]
    seen = points.where(F.col("x").isNotNull() & ~F.isnan("x"))
    # the first of points at one place answers for all of them
    ends = seen.groupBy(*keys, "x").agg(F.min(F.struct("point_no", "y")).alias("p"))
    own = ends.select(*keys, F.col("x").alias("at"), F.lit(False).alias("asks"), F.struct(F.col("p.point_no").alias("point_no"), "x", F.col("p.y").alias("y")).alias("p"))
    asked = seen.select(*keys).distinct().join(probes.select("path", "probe").where("probe is not null").distinct(), "path")
    stream = own.unionAll(asked.select(*keys, F.col("probe").alias("at"), F.lit(True).alias("asks"), F.lit(None).cast(own.schema["p"].dataType).alias("p")))
    held = staged(stream.repartitionByRange(*keys, "at", "asks").withColumn("_part", F.spark_partition_id()))
    # either way a frame that ends at the row: one that starts there is read anew for each row
    near, back = (Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0) for order in (("at", "asks"), (F.desc("at"), F.desc("asks"))))
    last, following = (F.last("p", ignorenulls=True).over(w) for w in (near, back))
    parts = held.groupBy(*keys, "_part").agg(F.max_by("p", F.when(F.col("p").isNotNull(), F.col("at"))).alias("_last"), F.min_by("p", F.when(F.col("p").isNotNull(), F.col("at"))).alias("_first"))
    over = Window.partitionBy(*keys).orderBy("_part")  # a row a part
    parts = parts.select(*keys, "_part", F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_behind"))
    asks = held.withColumns({"a": last, "b": following}).where("asks").join(parts, [*keys, "_part"])
    a, b = F.coalesce("a", "_before"), F.coalesce("b", "_behind")
    far = lambda p: F.abs(p["x"] - F.col("at"))
    takes_b = a.isNull() | (b.isNotNull() & ((far(b) < far(a)) | ((far(b) == far(a)) & (b["point_no"] < a["point_no"]))))
    return asks.select(*keys, F.col("at").alias("probe"), F.when(takes_b, b).otherwise(a).alias("p")).select(*keys, "probe", "p.point_no", "p.x", "p.y")


def series_payload(points: DataFrame) -> DataFrame:
    """(path, label, xs, ys): a series as arrays in point order."""
    got = points.groupBy("path", "label").agg(F.sort_array(F.collect_list(F.struct("point_no", "x", "y"))).alias("p"))
    return got.select("path", "label", F.transform("p", lambda p: p["x"]).alias("xs"), F.transform("p", lambda p: p["y"]).alias("ys"))


#: Schema of a plot's record, as JSON carries it.
PAYLOAD = "kind string, title string, metrics map<string,double>, xLabel string, yLabel string, series array<struct<label:string,x:array<double>,y:array<double>>>"


def chi_series(steps: DataFrame) -> DataFrame:
    """Points (path, point_no, col_no, label, x, y) of convergence logs: x the step, y the clamped logarithm of chi_r."""
    got = chi_log(steps)
    return got.select(F.col("run_id").alias("path"), F.col("step").alias("point_no"), F.lit(1).alias("col_no"), F.lit("R").alias("label"), F.col("step").cast("double").alias("x"), F.col("log_chi").alias("y"))


def plot_payload(described: DataFrame, points: DataFrame) -> DataFrame:
    """(path, payload): the record of each plot as JSON: kind, title, metrics, labels of the axes and series as arrays.

    described: (path, plot_kind, title, x_label, y_label, metrics map).  A series is gathered by one aggregate; the
    arrays of one file stand in one row, as its reader wants them.
    """
    one = points.groupBy("path", "col_no", "label").agg(F.sort_array(F.collect_list(F.struct("point_no", "x", "y"))).alias("p"))
    one = one.select("path", F.struct("col_no", "label", F.transform("p", lambda p: p["x"]).alias("x"), F.transform("p", lambda p: p["y"]).alias("y")).alias("s"))
    series = one.groupBy("path").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: F.struct(s["label"].alias("label"), s["x"].alias("x"), s["y"].alias("y"))).alias("series"))
    record = F.struct(F.col("plot_kind").alias("kind"), "title", "metrics", F.col("x_label").alias("xLabel"), F.col("y_label").alias("yLabel"), "series")
    return described.join(series, "path").select("path", F.to_json(record).alias("payload"))


def read_payload(payloads: DataFrame) -> DataFrame:
    """(path, r): the records back from their JSON."""
    return payloads.select("path", F.from_json("payload", PAYLOAD).alias("r"))


def run_metrics(files: DataFrame, points: DataFrame, finals: DataFrame) -> DataFrame:
    """files with metrics map: rwp for compared kinds, pdf_index for neutron PDFs, final_chi_r for logs.

    files: (path, plot_kind, pdf_index); finals: (path, final_chi).
    """
    got = files.join(rwp(points), "path", "left").join(finals, "path", "left")
    entry = lambda name, when, value: F.struct(F.lit(name).alias("k"), F.when(when, value).alias("v"))
    kind = F.col("plot_kind")
    entries = F.array(entry("rwp", kind.isin(*COMPARED), F.col("rwp")), entry("pdf_index", kind == "npdf", F.col("pdf_index").cast("double")), entry("final_chi_r", kind == "r_value", F.col("final_chi")))
    return got.select(*files.columns, F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())).alias("metrics"))


def dashboard(files: DataFrame, metrics: DataFrame) -> DataFrame:
    """Plottable files with their metrics (null where reading failed) and their position in the run's dashboard."""
    kinds = F.array(*[F.lit(k) for k in KIND_ORDER])
    got = files.where(F.col("plot_kind").isNotNull()).join(metrics, "path", "left")
    order = Window.partitionBy("run_id").orderBy(F.array_position(kinds, F.col("plot_kind")), F.lower("name"), "path")
    return got.withColumn("position", F.row_number().over(order))


def run_comparison(metrics: DataFrame) -> DataFrame:
    """Adds place: the rank of each file's rwp among its kind, equals sharing the first. metrics: (path, plot_kind, rwp)."""
    held = staged(ranked(metrics.where("rwp is not null"), ["plot_kind"], ["rwp"], k=["plot_kind"]))
    first = held.groupBy(F.col("plot_kind").alias("_kind"), F.col("rwp").alias("_rwp")).agg((F.min("k") + 1).cast("int").alias("place"))
    return held.join(first, F.col("plot_kind").eqNullSafe(F.col("_kind")) & (F.col("rwp") == F.col("_rwp"))).drop("k", "_kind", "_rwp")


def run_summary(files: DataFrame, metrics: DataFrame, errors: DataFrame, structures: DataFrame | None = None) -> DataFrame:
    """One row per run: files, plottable files, kinds present, best rwp, last final chi, unreadable files and warnings.

    files: (run_id, path, plot_kind); metrics: (path, rwp, final_chi); errors: (path, reason); structures, if given:
    (run_id, lattice, elements), of which those two columns are added.
    """
    bad = errors.groupBy("path").agg(F.min("reason").alias("reason"))
    got = files.join(metrics, "path", "left").join(bad, "path", "left")
    got = got.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.count("plot_kind").alias("n_plottable"), F.array_sort(F.collect_set("plot_kind")).alias("kinds"),
        F.min("rwp").alias("best_rwp"), F.max_by("final_chi", F.when(F.col("final_chi").isNotNull(), F.col("path"))).alias("final_chi"), F.count("reason").alias("n_errors"),
        F.array_sort(F.collect_set("reason")).alias("warnings"),
    )
    return got if structures is None else got.join(structures.select("run_id", "lattice", "elements"), "run_id", "left")
