"""Slabs, histograms and Gaussian kernel densities of folded atoms.

points: structure_id, element, px, py, pz (and seq for the seeded cap).  slabs: slab_id, z_center, dz.
"""

from __future__ import annotations

import math
from itertools import product
from math import prod

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import finite, interior_levels
from ..functions.storage import small_side, staged
from .gridsums import kernel_sums

KEYS = ("structure_id", "element", "slab_id")
#: Fewer atoms than this in a slab give the density 0 everywhere.
LEAST = 5
#: Kernels are cut at this many standard deviations: nothing is left beyond double precision.
REACH = 8.0
#: Powers of two that bins of slabs are wide.  Thinner slabs share bins of the least.
LEVELS = (-30, 1000)


def clamp_grid(grid: int) -> int:
    return min(400, max(16, grid))


def slab_filter(points: DataFrame, slabs: DataFrame) -> DataFrame:
    """Atoms with each slab they lie in, both faces included.

    A range join by dyadic bins: a slab is entered at the level whose bins, 2 ** level wide, are as thick as it at least,
    so it touches two of them at most, whatever its thickness.  An atom meets, at each level that some slab uses, the
    slabs of its own bin, and the exact bounds decide; overlapping slabs each get their atoms.  Slabs with a
    structure_id (those of `structure.slabs_in_length`) hold atoms of that structure only.
    """
    half = F.greatest(F.col("dz"), F.lit(1e-12)) * 0.5
    own = ["structure_id"] if "structure_id" in slabs.columns else []
    low, high = LEVELS
    # a step more than the logarithm asks for costs nothing, one less would need a third bin
    level = F.least(F.greatest(F.ceil(F.log2(half * 2) + 1e-9), F.lit(low)), F.lit(high)).cast("int")
    bounds = slabs.withColumns({"z_lo": F.col("z_center") - half, "z_hi": F.col("z_center") + half, "z_level": level}).where(finite(F.col("z_lo")) & finite(F.col("z_hi")))
    bin_of = lambda z: F.floor(z / F.pow(F.lit(2.0), F.col("z_level"))).cast("long")
    binned = bounds.select(*own, "slab_id", "z_lo", "z_hi", "z_level", F.explode(F.array_distinct(F.sequence(bin_of(F.col("z_lo")), bin_of(F.col("z_hi"))))).alias("z_bin"))
    used = sorted(r.z_level for r in bounds.select("z_level").distinct().collect())  # as many as LEVELS spans at most
    if not used:
        used = [high]
    at = points.where(finite(F.col("pz"))).withColumn("z_level", F.explode(F.array(*[F.lit(k) for k in used]))).withColumn("z_bin", bin_of(F.col("pz")))
    return at.join(binned, [*own, "z_level", "z_bin"]).where(F.col("pz").between(F.col("z_lo"), F.col("z_hi"))).select(*points.columns, "slab_id")


def slab_flag(points: DataFrame, z_center: float, dz: float) -> DataFrame:
    """Adds in_slab for fractional z, and the band clamped to the cell."""
    return points.withColumns(
        {"in_slab": F.abs(F.col("uz") - z_center) <= dz / 2, "band_lo": F.greatest(F.lit(0.0), F.lit(z_center - dz / 2)), "band_hi": F.least(F.lit(1.0), F.lit(z_center + dz / 2))}
    )


def slab_defaults(points: DataFrame) -> DataFrame:
    """Default centre (middle of the z range) and thickness (a twentieth of it, 1 if flat) per structure."""
    got = points.groupBy("structure_id").agg(F.min("pz").alias("lo"), F.max("pz").alias("hi"))
    return got.select("structure_id", ((F.col("lo") + F.col("hi")) / 2).alias("z_center"), F.when(F.col("hi") > F.col("lo"), 0.05 * (F.col("hi") - F.col("lo"))).otherwise(1.0).alias("dz"))


def slab_cov(in_slab: DataFrame, bw: float = 0.03) -> DataFrame:
    """Moments of each slab, with the kernel's covariance bw^2 times the sample's; status of each."""
    got = in_slab.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.var_samp("px").alias("vx"), F.var_samp("py").alias("vy"), F.covar_samp("px", "py").alias("vxy")
    )
    got = got.select(*KEYS, "n", *[(F.col(a) * bw * bw).alias(b) for a, b in (("vx", "sxx"), ("vy", "syy"), ("vxy", "sxy"))])
    got = got.withColumn("det", F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy"))
    status = F.when(F.col("n") < LEAST, "few").when(F.coalesce(F.col("det"), F.lit(0.0)) <= 0, "singular").otherwise("ok")
    return got.withColumn("status", status)


def fit_sample(in_slab: DataFrame, cap: int = 6000, seed: int = 0) -> DataFrame:
    """At most cap atoms of each slab, those with the smallest MD5 of seed and seq_key.

    Counts by the digest's first three digits tell which bins hold a slab's first cap atoms; only these bins are sorted,
    cap atoms and one part in 4,096 of the slab.  Atoms with a null seq_key come first.
    """
    drawn = in_slab.withColumn("_digest", F.md5(F.concat(F.lit(f"{seed}:"), F.col("seq_key")))).withColumn("_bin", F.coalesce(F.substring("_digest", 1, 3), F.lit("")))
    own = [F.col(k).alias(f"_{k}") for k in KEYS]
    counts = drawn.groupBy(*own, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*[f"_{k}" for k in KEYS]).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    last = counts.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < cap).groupBy(*[f"_{k}" for k in KEYS]).agg(F.max("_bin").alias("_last"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS]
    last = small_side(staged(last))  # a row a slab: no atom is shuffled that is not near
    near = drawn.join(last, [*same, F.col("_bin") <= F.col("_last")]).drop("_bin", "_last", *[f"_{k}" for k in KEYS])
    order = Window.partitionBy(*KEYS).orderBy("_digest", "seq_key")
    return near.withColumn("fit_no", F.row_number().over(order)).where(F.col("fit_no") <= cap).drop("_digest")


def grid_nodes(spark, grid: int, xlim=(0.0, 1.0), ylim=(0.0, 1.0)) -> DataFrame:
    """(ix, iy, gx, gy): the nodes of a square grid, edges included."""
    n = clamp_grid(grid)
    step = lambda c, lim: F.lit(lim[0]) + F.col(c) * ((lim[1] - lim[0]) / (n - 1))
    got = spark.range(n * n).select((F.col("id") % n).cast("int").alias("ix"), F.floor(F.col("id") / n).cast("int").alias("iy"))
    return got.select("ix", "iy", step("ix", xlim).alias("gx"), step("iy", ylim).alias("gy"))


def kde_slice(in_slab: DataFrame, bw: float = 0.03, grid: int = 120, xlim=(0.0, 1.0), ylim=(0.0, 1.0), log: bool = False, reach: float = REACH, fit_cap: int | None = None, seed: int = 0) -> DataFrame:
    """Gaussian density of each slab on a grid: KEYS, ix, iy, density, status.

    fit_cap: of slabs with more atoms only that many, drawn by `fit_sample`, are fitted: moments, kernels and the divisor are theirs.

    The moments are one aggregate.  With the factor L of a kernel's covariance, L L', kernels are round and are summed by
    `gridsums.kernel_sums`: atoms by cells in the task that reads them, cells over the nodes within `reach` deviations.  Atoms of one
    structure may be most of the table: no atom is shuffled.  Every node is in the sum with a zero, so that no join is needed for empty ones.
    """
    n, c = clamp_grid(grid), F.col
    (x0, x1), (y0, y1) = xlim, ylim
    sx, sy = (x1 - x0) / (n - 1), (y1 - y0) / (n - 1)
    if fit_cap:
        in_slab = staged(fit_sample(in_slab, fit_cap, seed).select(*KEYS, "px", "py"))
    # a row a slab, read for the atoms, the nodes and the densities
    cov = staged(slab_cov(in_slab, bw).withColumn("slab_no", F.monotonically_increasing_id()))
    root = cov.where("status = 'ok'").select(*KEYS, "slab_no", F.sqrt("sxx").alias("l1"), (c("sxy") / F.sqrt("sxx")).alias("l2"), F.sqrt(c("det") / c("sxx")).alias("l3"))
    u = (c("px") - x0) / c("l1")
    pts = in_slab.select(*KEYS, "px", "py").join(small_side(root), list(KEYS)).select("slab_no", u.alias("u"), ((c("py") - y0 - c("l2") * u) / c("l3")).alias("v")).where(finite(c("u")) & finite(c("v")))
    kernels = kernel_sums(pts, small_side(root.select("slab_no", "l1", "l2", "l3")), n, (sx, sy), reach)
    nodes = cov.select("slab_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n * n - 1).cast("long"))).alias("node"), F.lit(0.0).alias("k"))
    # no sum of kernels is below 0
    sums = kernels.unionAll(nodes).groupBy("slab_no", "node").agg(F.greatest(F.sum("k"), F.lit(0.0)).alias("k"))
    density = F.when(c("status") == "singular", F.lit(None)).otherwise(F.when(c("status") == "few", 0.0).otherwise(c("k") / (c("n") * 2 * math.pi * F.sqrt("det"))))
    got = sums.join(small_side(cov), "slab_no").select(*KEYS, (c("node") % n).cast("int").alias("ix"), F.floor(c("node") / n).cast("int").alias("iy"), density.cast("double").alias("density"), "status")
    return log_density(got) if log else got


def log_density(density: DataFrame) -> DataFrame:
    return density.withColumn("density", F.log10(F.col("density") + 1e-12))


def kde_slice_stats(density: DataFrame, cov: DataFrame, fit_cap: int | None = None) -> DataFrame:
    """slab_count, fit_count (0 under LEAST), vmin and vmax of each slab; NaN is left out."""
    d = F.when(~F.isnan("density"), F.col("density"))
    got = density.groupBy(*KEYS).agg(F.min(d).alias("vmin"), F.max(d).alias("vmax"))
    fit = F.when(F.col("n") < LEAST, 0).otherwise(F.least(F.col("n"), F.lit(fit_cap)) if fit_cap else F.col("n")).cast("long")
    return got.join(cov.select(*KEYS, "n"), list(KEYS)).select(*KEYS, F.col("n").alias("slab_count"), fit.alias("fit_count"), "vmin", "vmax")


def normalised(density: DataFrame) -> DataFrame:
    """Adds level (0 to 1 between a slab's least and greatest density) and index (0 to 255)."""
    density = staged(density)  # read for the ends and for the levels
    ends = density.groupBy(*KEYS).agg(F.min("density").alias("lo"), F.max("density").alias("hi"))
    got = density.join(small_side(staged(ends)), list(KEYS))
    level = (F.col("density") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    got = got.withColumn("level", level)
    return got.withColumn("index", F.least(F.greatest(F.floor(F.col("level") * 255 + 0.5), F.lit(0)), F.lit(255)).cast("int")).drop("lo", "hi")


def kde_self_3d(points: DataFrame, reach: float = REACH) -> DataFrame:
    """Gaussian density of each (structure, element) group at its own points, by Scott's rule; points: plus point_id.

    Cells of `reach` deviations hold the group's points; a point meets those of its 27 neighbouring cells.
    """
    keys = ["structure_id", "element"]
    v = [("xx", "px", "px"), ("xy", "px", "py"), ("xz", "px", "pz"), ("yy", "py", "py"), ("yz", "py", "pz"), ("zz", "pz", "pz")]
    m = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.covar_samp(a, b).alias(f"m{k}") for k, a, b in v])
    factor = F.pow(F.col("n").cast("double"), F.lit(-2.0 / 7.0))
    m = m.where("n >= 5").select(*keys, "n", *[(F.col(f"m{k}") * factor).alias(k) for k, _, _ in v])
    c = F.col
    adj = {
        "ia": c("yy") * c("zz") - c("yz") * c("yz"), "ib": c("xx") * c("zz") - c("xz") * c("xz"), "ic": c("xx") * c("yy") - c("xy") * c("xy"),
        "id": c("xz") * c("yz") - c("xy") * c("zz"), "ie": c("xy") * c("yz") - c("xz") * c("yy"), "ig": c("xy") * c("xz") - c("xx") * c("yz"),
    }
    m = m.withColumns(adj).withColumn("det", c("xx") * c("ia") + c("xy") * c("id") + c("xz") * c("ie")).where("det > 0")
    m = m.withColumns({f"w{a}": F.lit(reach) * F.sqrt(s) for a, s in (("x", "xx"), ("y", "yy"), ("z", "zz"))})
    pts = points.join(m.select(*keys, "wx", "wy", "wz"), keys)
    pts = pts.select(*keys, "point_id", "px", "py", "pz", *[F.floor(c(f"p{a}") / c(f"w{a}")).alias(f"b{a}") for a in "xyz"])
    near = pts
    for a in "xyz":
        near = near.withColumn(f"b{a}", F.explode(F.array(*[c(f"b{a}") + i for i in (-1, 0, 1)])))
    near = near.select(*keys, "bx", "by", "bz", *[c(f"p{a}").alias(f"q{a}") for a in "xyz"])
    # points at one place count together, which bounds what copies cost
    near = near.groupBy(*keys, "bx", "by", "bz", "qx", "qy", "qz").agg(F.count(F.lit(1)).alias("w"))
    got = pts.join(near, [*keys, "bx", "by", "bz"]).join(m, keys)
    dx, dy, dz = (c(f"p{a}") - c(f"q{a}") for a in "xyz")
    form = (c("ia") * dx * dx + c("ib") * dy * dy + c("ic") * dz * dz + 2 * c("id") * dx * dy + 2 * c("ie") * dx * dz + 2 * c("ig") * dy * dz) / c("det")
    total = got.groupBy(*keys, "point_id").agg(F.sum(c("w") * F.exp(-0.5 * form)).alias("k"), F.first("n").alias("n"), F.first("det").alias("det"))
    return total.select(*keys, "point_id", (c("k") / (c("n") * F.sqrt(c("det") * (2 * math.pi) ** 3))).alias("density"))


def whitened(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """points with wx, wy, wz, in which the kernel of their (structure, element) group is the same along each axis, and the groups.

    The kernel's covariance is the sample's by Scott's rule, L L' with L lower triangular; l1, l3, l6 are its diagonal.
    Groups of fewer than five points, or flat ones, have no kernel and are left out.
    """
    keys, c = ["structure_id", "element"], F.col
    v = [("xx", "px", "px"), ("xy", "px", "py"), ("xz", "px", "pz"), ("yy", "py", "py"), ("yz", "py", "pz"), ("zz", "pz", "pz")]
    m = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.covar_samp(a, b).alias(f"m{k}") for k, a, b in v], *[F.avg(f"p{a}").alias(f"a{a}") for a in "xyz"])
    factor = F.pow(c("n").cast("double"), F.lit(-2.0 / 7.0))
    m = m.where("n >= 5").select(*keys, "n", "ax", "ay", "az", *[(c(f"m{k}") * factor).alias(k) for k, _, _ in v]).where("xx > 0")
    m = m.withColumn("l1", F.sqrt("xx")).withColumns({"l2": c("xy") / c("l1"), "l4": c("xz") / c("l1")}).withColumn("s3", c("yy") - c("l2") * c("l2")).where("s3 > 0")
    m = m.withColumn("l3", F.sqrt("s3")).withColumn("l5", (c("yz") - c("l4") * c("l2")) / c("l3")).withColumn("s6", c("zz") - c("l4") * c("l4") - c("l5") * c("l5")).where("s6 > 0")
    m = staged(m.withColumn("l6", F.sqrt("s6")).select(*keys, "n", "ax", "ay", "az", "l1", "l2", "l3", "l4", "l5", "l6"))  # a row a group
    pts = points.join(small_side(m), keys).withColumn("wx", (c("px") - c("ax")) / c("l1")).withColumn("wy", (c("py") - c("ay") - c("l2") * c("wx")) / c("l3"))
    pts = pts.withColumn("wz", (c("pz") - c("az") - c("l4") * c("wx") - c("l5") * c("wy")) / c("l6"))
    return pts, m


def kde_self_grid(points: DataFrame, step: float = 0.25, reach: float = 4.0) -> DataFrame:
    """As kde_self_3d, by way of a grid: work and shuffles grow with the points and the occupied nodes, not with pairs.

    Whitened by the Cholesky factor of its covariance, a group's kernel is the same along each axis, so it is summed
    axis by axis.  Points are shared out linearly over the eight nodes around them (`step` bandwidths apart), the
    nodes are smoothed along one axis after the other up to `reach` bandwidths, and a point reads its density from the
    eight nodes around it, linearly too.  Either linear step errs by at most step^2 / 8 times a second derivative of
    the kernel along each axis: 3 * step^2 / 4 of the kernel's peak in all, 4.7 % at the default; cutting off at
    `reach` loses under 4e-4 of the peak.  The nodes of a group number about (extent / (step * bandwidth))^3 at most.  `reach` and `step` are parameters; nothing switches by size.
    """
    keys, c = ["structure_id", "element"], F.col
    pts, m = whitened(points)
    pts = pts.select(*keys, "point_id", *[F.floor(c(f"w{a}") / step).cast("int").alias(f"b{a}") for a in "xyz"], *[(c(f"w{a}") / step - F.floor(c(f"w{a}") / step)).alias(f"f{a}") for a in "xyz"])
    pts = staged(pts)  # read for the nodes and for the densities
    share = lambda at: prod([c(f"f{a}") if o else 1 - c(f"f{a}") for a, o in zip("xyz", at)])
    corners = list(product((0, 1), repeat=3))
    # points of one cell are summed first: a row a cell, not eight a point
    cells = staged(pts.groupBy(*keys, "bx", "by", "bz").agg(*[F.sum(share(at)).alias(f"s{i}") for i, at in enumerate(corners)]))
    corner = F.explode(F.array(*[F.struct(*[(c(f"b{a}") + o).alias(f"g{a}") for a, o in zip("xyz", at)], c(f"s{i}").alias("s")) for i, at in enumerate(corners)]))
    near = staged(cells.select(*keys, corner.alias("q")).select(*keys, "q.*").groupBy(*keys, "gx", "gy", "gz").agg(F.sum("s").alias("w")))
    grid = near
    far = int(math.ceil(reach / step))
    kernel = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(math.exp(-0.5 * (i * step) ** 2)).alias("e")) for i in range(-far, far + 1)])
    for a in "xyz":
        spread = grid.select(*keys, *[f"g{b}" for b in "xyz" if b != a], c(f"g{a}").alias("g"), "w", F.explode(kernel).alias("k"))
        spread = spread.select(*keys, *[f"g{b}" for b in "xyz" if b != a], (c("g") + c("k.i")).alias(f"g{a}"), (c("w") * c("k.e")).alias("w"))
        # only nodes that a point lies next to along this axis are read in the end
        grid = spread.join(near.select(*keys, f"g{a}").distinct(), [*keys, f"g{a}"], "left_semi").groupBy(*keys, "gx", "gy", "gz").agg(F.sum("w").alias("w"))
    # a cell's eight nodes in one row, so that points meet one row each and are not grouped again
    back = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *[(c(f"g{a}") - o).alias(f"b{a}") for a, o in zip("xyz", at)]) for i, at in enumerate(corners)]))
    held = grid.select(*keys, "w", back.alias("q")).select(*keys, "w", "q.*").join(cells.select(*keys, "bx", "by", "bz"), [*keys, "bx", "by", "bz"], "left_semi")
    held = small_side(staged(held.groupBy(*keys, "bx", "by", "bz").agg(*[F.sum(F.when(c("i") == i, c("w"))).alias(f"w{i}") for i in range(8)])))
    got = pts.join(held, [*keys, "bx", "by", "bz"]).join(small_side(m), keys).withColumn("k", sum((share(at) * c(f"w{i}") for i, at in enumerate(corners)), F.lit(0.0)))
    return got.select(*keys, "point_id", (c("k") / (c("n") * c("l1") * c("l3") * c("l6") * (2 * math.pi) ** 1.5)).alias("density"))


def _bin(x, lo, hi, n):
    """Bin of x among n from lo to hi; the last one holds its upper edge."""
    return F.least(F.floor((x - lo) * n / F.when(hi > lo, hi - lo).otherwise(1.0)).cast("int"), F.lit(n - 1))


def z_histogram(points: DataFrame, bins: int = 150) -> DataFrame:
    """Count and density of z in equal bins between a structure's least and greatest; empty bins are there too.

    Only finite z count; n_odd says how many others there are.
    """
    ok, z = finite(F.col("pz")), F.when(finite(F.col("pz")), F.col("pz"))
    ends = points.groupBy("structure_id").agg(F.min(z).alias("lo"), F.max(z).alias("hi"), F.count(z).alias("total"), F.count_if(~ok).alias("n_odd"))
    ends = small_side(staged(ends.where("total > 0 and structure_id is not null")))  # a row a structure
    counts = points.where(ok).join(ends, "structure_id").groupBy("structure_id", _bin(F.col("pz"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    full = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(counts, ["structure_id", "bin"], "left")
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0) / bins
    return full.select("structure_id", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.coalesce("n", F.lit(0)) / (F.col("total") * width)).alias("density"), "n_odd")


def xz_histogram(points: DataFrame, bins: int = 150, xlim=(0.0, 1.0), zlim=(0.0, 1.0)) -> DataFrame:
    """Counts over x and z in a given range; what is outside is left out, empty bins are there."""
    inside = points.where(F.col("px").between(*xlim) & F.col("pz").between(*zlim))
    bx, bz = (_bin(F.col(c), F.lit(lim[0]), F.lit(lim[1]), bins) for c, lim in (("px", xlim), ("pz", zlim)))
    counts = inside.groupBy("structure_id", bx.alias("bx"), bz.alias("bz")).agg(F.count(F.lit(1)).alias("n"))
    whole = points.select("structure_id").distinct().withColumn("bx", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("bz", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return whole.join(counts, ["structure_id", "bx", "bz"], "left").select("structure_id", "bx", "bz", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def densest_band(folded: DataFrame, bins: int = 50) -> DataFrame:
    """Centre of the z band (of fractions of the cell) with most atoms; the first of equals."""
    b = F.least(F.greatest(F.floor(F.col("uz") * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = folded.groupBy("structure_id", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("structure_id").agg(F.max(F.struct("n", (-F.col("bin")).alias("m"))).alias("best"))
    return best.select("structure_id", (-F.col("best.m")).alias("bin"), F.col("best.n").alias("n"), ((-F.col("best.m") + 0.5) / bins).alias("z_center"))


def quantile_limits(points: DataFrame, lo: float = 0.01, hi: float = 0.99, bins: int = 4096, small: int = 10_000) -> DataFrame:
    """Exact quantiles of each coordinate over its finite values, interpolated between neighbours; n_odd: values that are not finite.

    The bin that holds a rank is refined until it has `small` values at most, or equal ones only: values are counted in
    `bins` bins between the least and the greatest value of the bin before, with partial sums.  The first round bins the
    logarithms of the magnitudes, so later bins hold values of one sign and size, and a dozen bits of a double go with
    each round: outliers cost a round, not the bins.  No task holds more than `bins` counts or `small` values of a structure and axis.
    """
    keys, v = ["structure_id", "axis"], F.col("v")
    long = points.select("structure_id", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"p{a}").alias("v")) for a in "xyz"])).alias("p")).select("structure_id", "p.*")
    long = staged(long.where("v is not null"))
    odd = long.groupBy("structure_id").agg(F.count_if(~finite(v)).alias("n_odd"))
    long = long.where(finite(v))
    total = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    at = lambda q: F.lit(q) * (F.col("n") - 1)
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(end).alias("end"), up(at(q)).alias("rank"), (at(q) - F.floor(at(q))).alias("share")) for name, q in (("lo", lo), ("hi", hi)) for end, up in ((0, F.floor), (1, F.ceil))])
    wanted = staged(total.withColumn("r", F.explode(ranks)).select(*keys, "least", "most", "n", "r.*"))
    first = True
    while wanted.where((F.col("n") > small) & (F.col("least") < F.col("most"))).head(1):
        scale = (lambda x: F.when(F.abs(x) > 1e-300, F.signum(x) * (F.ln(F.abs(x)) + 691.0)).otherwise(0.0)) if first else (lambda x: x)
        open_ = wanted.where((F.col("n") > small) & (F.col("least") < F.col("most"))).select(*keys, "least", "most").distinct()
        share = (scale(v) - scale(F.col("least"))) / F.nullif(scale(F.col("most")) - scale(F.col("least")), F.lit(0.0))
        bin_ = F.coalesce(F.least(F.floor(share * bins), F.lit(bins - 1)), F.lit(0)).alias("bin")
        counts = long.join(open_, keys).where(v.between(F.col("least"), F.col("most"))).groupBy(*keys, "least", "most", bin_).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        # windows over at most `bins` rows
        before = F.coalesce(F.sum("c").over(Window.partitionBy(*keys, "least", "most").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = wanted.join(counts.withColumn("before", before), [*keys, "least", "most"], "left").where("c is null or (rank >= before and rank < before + c)")
        wanted = staged(found.select(*keys, F.coalesce("low", "least").alias("least"), F.coalesce("high", "most").alias("most"), F.coalesce("c", "n").alias("n"), "name", "end", (F.col("rank") - F.coalesce("before", F.lit(0))).alias("rank"), "share"))
        first = False
    near = long.join(wanted.select(*keys, "least", "most").distinct(), keys).where(v.between(F.col("least"), F.col("most")))
    values = near.groupBy(*keys, "least", "most", "v").agg(F.count(F.lit(1)).alias("c"))
    up_to = F.sum("c").over(Window.partitionBy(*keys, "least", "most").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    values = values.select(*keys, "least", "most", "v", (up_to - F.col("c")).alias("from"), up_to.alias("to"))
    got = wanted.join(values, [*keys, "least", "most"]).where((F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to")))
    pick = lambda k: F.max(F.when(F.col("end") == k, v))
    limits = got.groupBy(*keys, "name").agg((pick(0) + (pick(1) - pick(0)) * F.max("share")).alias("limit"))
    at = lambda a, name: F.max(F.when((F.col("axis") == a) & (F.col("name") == name), F.col("limit"))).alias(f"{a}_{name}")
    return odd.join(limits.groupBy("structure_id").agg(*[at(a, name) for a in "xyz" for name in ("lo", "hi")]), "structure_id", "left")


def contour_levels(density: DataFrame, n_levels: int = 8) -> DataFrame:
    """Levels strictly inside each slab's range of densities; none if it is flat, has no value, or is nowhere above 0."""
    d = F.when(~F.isnan("density"), F.col("density"))
    ends = density.groupBy(*KEYS).agg(F.min(d).alias("lo"), F.max(d).alias("hi")).where("hi > 0 and hi > lo")
    return ends.select(*KEYS, F.posexplode(interior_levels(F.col("lo"), F.col("hi"), n_levels)).alias("level_no", "level")) if n_levels > 0 else ends.select(*KEYS, F.lit(0).alias("level_no"), F.lit(0.0).alias("level")).limit(0)
