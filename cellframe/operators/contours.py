"""Iso-contours of density grids by marching squares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import staged
from .density import KEYS, contour_levels

#: Edges that a contour joins, by the case number: bit i is set if corner i is above the level.
#: Corners: 0 (ix, iy), 1 (ix+1, iy), 2 (ix+1, iy+1), 3 (ix, iy+1).  Edges: bottom, right, top, left.
#: Cases 5 and 10 depend on the cell's centre.
CASES = {1: "BL", 14: "BL", 2: "BR", 13: "BR", 4: "RT", 11: "RT", 7: "LT", 8: "LT", 3: "LR", 12: "LR", 6: "BT", 9: "BT"}


def grid_squares(density: DataFrame) -> DataFrame:
    """Each square of neighbouring nodes with its corner values v0 to v3.

    A node is sent to the up to four squares it is a corner of, and one aggregate gathers them: no window over a slab.
    """
    corner = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("ix") - dx).alias("sx"), (F.col("iy") - dy).alias("sy")) for k, dx, dy in ((0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1))]))
    sent = density.select(*KEYS, "density", corner.alias("c")).select(*KEYS, F.col("c.sx").alias("ix"), F.col("c.sy").alias("iy"), F.col("c.k").alias("k"), "density")
    got = sent.groupBy(*KEYS, "ix", "iy").agg(*[F.max(F.when(F.col("k") == k, F.col("density"))).alias(f"v{k}") for k in range(4)])
    return got.where("v0 is not null and v1 is not null and v2 is not null and v3 is not null")


def contour_segments(density: DataFrame, n_levels: int = 8, grid_step=(1.0, 1.0), origin=(0.0, 0.0)) -> DataFrame:
    """Line segments KEYS, level_no, level, ix, iy, seg_no, x0, y0, x1, y1 of every level; x = origin + ix * step."""
    density = staged(density)  # the grid is read for the levels and for the squares
    got = grid_squares(density).join(contour_levels(density, n_levels), list(KEYS))
    c, level = F.col, F.col("level")
    case = sum((F.when(c(f"v{i}") > level, 1 << i).otherwise(0) for i in range(4)), F.lit(0))
    got = got.withColumn("case", case).where("case > 0 and case < 15")
    share = lambda a, b: (level - c(a)) / F.nullif(c(b) - c(a), F.lit(0.0))
    at = {"B": (share("v0", "v1"), F.lit(0.0)), "R": (F.lit(1.0), share("v1", "v2")), "T": (share("v3", "v2"), F.lit(1.0)), "L": (F.lit(0.0), share("v0", "v3"))}
    x = lambda e: F.lit(origin[0]) + (c("ix") + at[e][0]) * grid_step[0]
    y = lambda e: F.lit(origin[1]) + (c("iy") + at[e][1]) * grid_step[1]
    line = lambda ends: F.struct(x(ends[0]).alias("x0"), y(ends[0]).alias("y0"), x(ends[1]).alias("x1"), y(ends[1]).alias("y1"))
    above = (c("v0") + c("v1") + c("v2") + c("v3")) / 4 > level
    joined, apart = F.array(line("BR"), line("LT")), F.array(line("BL"), line("RT"))
    lines = F.when(c("case") == 5, F.when(above, joined).otherwise(apart)).when(c("case") == 10, F.when(above, apart).otherwise(joined))
    for ends in sorted(set(CASES.values())):
        lines = lines.when(c("case").isin(*[k for k, v in CASES.items() if v == ends]), F.array(line(ends)))
    got = got.select(*KEYS, "level_no", "level", "ix", "iy", F.posexplode(lines).alias("seg_no", "s"))
    return got.select(*KEYS, "level_no", "level", "ix", "iy", "seg_no", "s.x0", "s.y0", "s.x1", "s.y1")


def contour_counts(segments: DataFrame) -> DataFrame:
    """Segments of each level; levels without one are left out."""
    return segments.groupBy(*KEYS, "level_no").agg(F.count(F.lit(1)).alias("n_segments"))


def contour_lines(segments: DataFrame) -> DataFrame:
    """(KEYS, level_no, level, lines) of the levels that have lines: all segments of a level in order, as a drawing takes them."""
    line = F.struct("iy", "ix", "seg_no", "x0", "y0", "x1", "y1")
    got = segments.groupBy(*KEYS, "level_no", "level").agg(F.sort_array(F.collect_list(line)).alias("s"))
    return got.select(*KEYS, "level_no", "level", F.transform("s", lambda s: F.struct(s["x0"].alias("x0"), s["y0"].alias("y0"), s["x1"].alias("x1"), s["y1"].alias("y1"))).alias("lines"))
