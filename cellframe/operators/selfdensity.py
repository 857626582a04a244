"""Gaussian densities of groups of points at their own points, for groups of any size: a fast Gauss transform.

Whitened, a group's kernel is exp(-|u - v|^2 / 2).  Points are summed up in cells WIDTH bandwidths wide, as moments of their
places about the cell's centre up to ORDER along each axis; the kernel's Taylor series takes the moments of one cell to a
series about the centre of another, axis by axis; a point's density is its own cell's series at its place.  Cells
farther than REACH bandwidths apart do not meet.  With the values below a pair of points contributes its kernel to
within 3e-10 of the kernel's peak (1e-10 along each axis), wherever the two lie in their cells, so a density is as exact as that times the
peak of one kernel (tests hold it against sums over all pairs).

Work grows with the points and with the occupied cells times the neighbours of a cell along one axis.  Cells with many
points are summed and read in parts.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import small_side, staged
from .density import whitened

WIDTH, ORDER, REACH = 1.0, 14, 8.0
#: Cells whose moments a task holds before it hands them on; points of a cell that one task sums or reads; places of a line at once.
HELD, PART, LINE = 500, 100_000, 64
CELL = ["grp", "gx", "gy", "gz"]


def powers(x: np.ndarray) -> np.ndarray:
    """x^k / k! for k below ORDER, a row per value."""
    out = np.ones((ORDER, len(x)))
    for k in range(1, ORDER):
        np.multiply(out[k - 1], x / k, out=out[k])
    return np.ascontiguousarray(out.T)


def shift(d: int) -> np.ndarray:
    """What moment a of a cell adds to term b of the series of the cell d cells on."""
    k = [math.exp(-0.5 * (WIDTH * d) ** 2)]
    for n in range(2 * ORDER - 2):
        k.append(-WIDTH * WIDTH * (d * k[n] + (n * k[n - 1] if n else 0.0)))
    at = np.arange(ORDER)
    return np.array(k)[at[:, None] + at[None, :]] * (-1.0) ** at[:, None]


def moments(batches):
    """Sums of the products of powers of the places in each cell, from Arrow batches (grp, gx, gy, gz, sx, sy, sz)."""
    import pyarrow as pa

    held: dict[tuple, np.ndarray] = {}

    def rows():
        keys = np.array(list(held), dtype=np.int64).reshape(-1, 4)
        out = pa.RecordBatch.from_arrays([*(pa.array(keys[:, i]) for i in range(4)), pa.array([t.tobytes() for t in held.values()], pa.binary())], names=[*CELL, "tensor"])
        held.clear()
        return out

    for batch in batches:
        cols = [np.asarray(c) for c in batch.columns]
        cells, which = np.unique(np.stack(cols[:4], axis=1), axis=0, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        ends = np.searchsorted(which.ravel()[order], np.arange(len(cells) + 1))
        x, y, z = (powers(c) for c in cols[4:])
        for cell, a, b in zip(map(tuple, cells.tolist()), ends[:-1], ends[1:]):
            own = order[a:b]
            xy = (x[own][:, :, None] * y[own][:, None, :]).reshape(b - a, -1)
            t = (xy.T @ z[own]).reshape(ORDER, ORDER, ORDER)
            held[cell] = held[cell] + t if cell in held else t
            if len(held) >= HELD:
                yield rows()
    if held:
        yield rows()


def tensors(tab) -> np.ndarray:
    return np.frombuffer(b"".join(tab.column("tensor").to_pylist())).reshape(-1, ORDER, ORDER, ORDER)


SCHEMA = "grp long, gx long, gy long, gz long, tensor binary"


def added(cells: DataFrame) -> DataFrame:
    def add(key, tab):
        import pyarrow as pa

        return pa.table({**{c: pa.array([k.as_py()], pa.int64()) for c, k in zip(CELL, key)}, "tensor": pa.array([tensors(tab).sum(axis=0).tobytes()], pa.binary())})

    return cells.groupBy(*CELL).applyInArrow(lambda key, tab: add(key, tab), SCHEMA)


def passed(cells: DataFrame, axis: int, wanted: DataFrame) -> DataFrame:
    """Series along one axis at the places where they are asked for; wanted: (grp, axes done, places array)."""
    along, lines = CELL[1 + axis], ["grp", *[CELL[1 + i] for i in range(3) if i != axis]]
    far = int(REACH / WIDTH) + 1
    shifts = np.stack([shift(d) for d in range(-far, far + 1)] + [np.zeros((ORDER, ORDER))])

    def line(key, tab):
        import pyarrow as pa

        at = np.asarray(tab.column(along))
        order = np.argsort(at)
        at, held = at[order], np.moveaxis(tensors(tab)[order], 1 + axis, -1)  # the axis in hand last
        to = np.sort(np.array(tab.column("places")[0].as_py(), dtype=np.int64))
        met, found = [], []
        for i in range(0, len(to), LINE):
            t = to[i : i + LINE]
            a, b = np.searchsorted(at, (t[0] - far, t[-1] + far + 1))
            if a == b:
                continue
            d = t[None, :] - at[a:b, None]
            near = np.abs(d) <= far
            rule = shifts[np.where(near, d + far, 2 * far + 1)].transpose(0, 2, 1, 3).reshape((b - a) * ORDER, len(t) * ORDER)
            own = held[a:b].transpose(1, 2, 0, 3).reshape(ORDER * ORDER, (b - a) * ORDER) @ rule
            own = np.moveaxis(own.reshape(ORDER, ORDER, len(t), ORDER), 2, 0)[near.any(axis=0)]
            found += [x.tobytes() for x in np.ascontiguousarray(np.moveaxis(own, -1, 1 + axis))]
            met.append(t[near.any(axis=0)])
        met = np.concatenate(met) if met else to[:0]
        own = {c: pa.array(np.full(len(met), k.as_py()), pa.int64()) for c, k in zip(lines, key)} | {along: pa.array(met), "tensor": pa.array(found, pa.binary())}
        return pa.table({c: own[c] for c in [*CELL, "tensor"]})

    keys = [c for c in wanted.columns if c != "places"]
    return cells.join(wanted, keys).groupBy(*lines).applyInArrow(lambda key, tab: line(key, tab), SCHEMA)


def kde_self(points: DataFrame) -> DataFrame:
    """structure_id, element, point_id, density at every point (structure_id, element, point_id, px, py, pz), by Scott's rule.

    Points of groups without a kernel (fewer than five points, or a flat group) are left out.
    """
    c = F.col
    pts, groups = whitened(points)
    groups = staged(groups.select("structure_id", "element", "n", (c("l1") * c("l3") * c("l6")).alias("root"), F.monotonically_increasing_id().alias("grp")))
    pts = pts.select("structure_id", "element", "point_id", "wx", "wy", "wz").join(small_side(groups.select("structure_id", "element", "grp")), ["structure_id", "element"])
    cell = lambda a: F.floor(c(f"w{a}") / WIDTH).cast("long")
    pts = staged(pts.select("grp", *[cell(a).alias(f"g{a}") for a in "xyz"], *[(c(f"w{a}") / WIDTH - cell(a) - 0.5).alias(f"s{a}") for a in "xyz"], "point_id"))
    occupied = staged(pts.groupBy(*CELL).agg(F.count(F.lit(1)).alias("points")))
    parts = F.ceil(c("points") / PART).cast("int")
    asked = pts.join(small_side(occupied), CELL).withColumn("salt", F.pmod(F.xxhash64("sx", "sy", "sz", F.monotonically_increasing_id()), parts).cast("int")).drop("points")
    # a cell's points meet first, so that a task makes few of these large rows
    dealt = asked.select(*CELL, "sx", "sy", "sz", "salt").repartition(*CELL, "salt").sortWithinPartitions(*CELL).drop("salt")
    series = added(dealt.mapInArrow(moments, SCHEMA))
    for axis in range(3):
        # places along an axis that are read: as many as the group is wide, whatever its number of points
        places = occupied.groupBy(*CELL[: 1 + axis]).agg(F.collect_set(CELL[1 + axis]).alias("places"))
        series = passed(series, axis, places)
    salted = series.join(occupied, CELL).withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).select(*CELL, "salt", "tensor")

    def read(left, right):
        import pyarrow as pa

        t = tensors(right)[0]
        x, y, z = (powers(np.asarray(left.column(f"s{a}"))) for a in "xyz")
        out = np.empty(len(x))
        for i in range(0, len(x), 4096):
            part = slice(i, i + 4096)
            xy = (x[part] @ t.reshape(ORDER, -1)).reshape(-1, ORDER, ORDER)
            out[part] = ((xy * y[part][:, :, None]).sum(axis=1) * z[part]).sum(axis=1)
        return pa.table({"grp": left.column("grp"), "point_id": left.column("point_id"), "k": out})

    kind = pts.schema["point_id"].dataType.simpleString()
    sums = asked.groupBy(*CELL, "salt").cogroup(salted.groupBy(*CELL, "salt")).applyInArrow(lambda left, right: read(left, right), f"grp long, point_id {kind}, k double")
    got = sums.join(small_side(groups), "grp")
    return got.select("structure_id", "element", "point_id", (c("k") / (c("n") * c("root") * (2 * math.pi) ** 1.5)).alias("density"))
