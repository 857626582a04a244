"""Sums of Gaussian kernels over the nodes of a grid, for any number of atoms: a fast Gauss transform in two dimensions.

Whitened, a kernel is exp(-((u - a)^2 + (v - b)^2) / 2).  Atoms are summed up in cells WIDTH deviations wide, as moments of their
places about the cell's centre below ORDER along either axis; a cell's moments times the derivatives of the kernel give what
its atoms add to a node.  What is cut off is under 1e-15 of a kernel's peak along either axis, so the sums are as exact as doubles are.

Work grows with atoms times ORDER^2 multiplications, and with occupied cells times the nodes they reach, whatever the atoms in them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, ORDER = 1.0, 20
CELL = ["slab_no", "gu", "gv"]
MOMENTS, SUMS = "slab_no long, gu long, gv long, tensor binary", "slab_no long, node long, k double"


def powers(x: np.ndarray) -> np.ndarray:
    """x^k / k! for k below ORDER, a row per k."""
    out = np.ones((ORDER, len(x)))
    for k in range(1, ORDER):
        np.multiply(out[k - 1], x / k, out=out[k])
    return out


def derivatives(z: np.ndarray) -> np.ndarray:
    """What moment k of a cell adds at the distance z from its centre: (-1)^k times derivative k of exp(-z^2 / 2), k first."""
    out = np.empty((ORDER, *z.shape))
    out[0] = np.exp(-0.5 * z * z)
    out[1] = z * out[0]
    for k in range(1, ORDER - 1):
        out[k + 1] = z * out[k] - k * out[k - 1]
    return out


def moments(batches):
    """Moments of the cells of Arrow batches (slab_no, gu, gv, s, t) that come in the order of their cells."""
    import pyarrow as pa

    def rows(cells):
        keys = np.array([k for k, _ in cells], dtype=np.int64)
        return pa.RecordBatch.from_arrays([*(pa.array(keys[:, i]) for i in range(3)), pa.array([t.tobytes() for _, t in cells], pa.binary())], names=[*CELL, "tensor"])

    held, total = None, None
    for batch in batches:
        keys, (s, t) = np.stack([np.asarray(c) for c in batch.columns[:3]], axis=1), (np.asarray(c) for c in batch.columns[3:])
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else []
        x, y, done = powers(s), powers(t), []
        for a, b in zip(starts, [*starts[1:], len(keys)]):
            key, own = tuple(keys[a].tolist()), x[:, a:b] @ y[:, a:b].T
            if key == held:
                total = total + own
                continue
            if held is not None:
                done.append((held, total))
            held, total = key, own
        if done:
            yield rows(done)
    if held is not None:
        yield rows([(held, total)])


def add_cell(total: np.ndarray, at: tuple, tensor: np.ndarray, root: tuple, steps: tuple, reach: float) -> None:
    """Add what a cell's atoms give to the nodes within reach: columns of the grid, and in each the rows that an upright box holds."""
    (gu, gv), (l1, l2, l3), (sx, sy), n = at, root, steps, len(total)
    u, v, far = (gu + 0.5) * WIDTH, (gv + 0.5) * WIDTH, reach + 0.5 * WIDTH
    first, last = (int(np.clip(x, -1, n)) for x in (np.ceil((u - far) * l1 / sx), np.floor((u + far) * l1 / sx)))
    ix = np.arange(max(0, first), min(n - 1, last) + 1)
    if not len(ix):
        return
    x = ix * (sx / l1)
    low = np.clip(np.ceil(((v - far) * l3 + l2 * x) / sy), 0, n).astype(int)
    iy = low[:, None] + np.arange(int(min(n, 2 * far * l3 / sy + 2)))
    inside = iy < n
    if not inside.any():
        return
    across = derivatives(x - u).T @ tensor
    value = (across.T[:, :, None] * derivatives((iy * sy - l2 * x[:, None]) / l3 - v)).sum(axis=0)
    total[iy[inside], np.broadcast_to(ix[:, None], iy.shape)[inside]] += value[inside]


def node_sums(batches, n: int, steps: tuple, reach: float):
    """Sums over the nodes (iy * n + ix) of each slab from batches (slab_no, gu, gv, tensor, l1, l2, l3) in the order of CELL; a task holds one grid."""
    import pyarrow as pa

    slab, total = None, None

    def rows():
        node = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(node), slab, dtype=np.int64)), pa.array(node.astype(np.int64)), pa.array(total.ravel()[node])], names=["slab_no", "node", "k"])

    def cells():
        held, tensor, root = None, None, None
        for batch in batches:
            cols = batch.to_pydict()
            for key, t, *own in zip(zip(*(cols[c] for c in CELL)), *(cols[c] for c in ("tensor", "l1", "l2", "l3"))):
                t = np.frombuffer(t).reshape(ORDER, ORDER)
                if key == held:
                    tensor = tensor + t
                    continue
                if held is not None:
                    yield held, tensor, root
                held, tensor, root = key, t, own
        if held is not None:
            yield held, tensor, root

    for key, tensor, root in cells():
        if key[0] != slab:
            if slab is not None:
                yield rows()
            slab, total = key[0], np.zeros((n, n))
        add_cell(total, key[1:], tensor, root, steps, reach)
    if slab is not None:
        yield rows()


def kernel_sums(atoms: DataFrame, roots: DataFrame, n: int, steps: tuple, reach: float) -> DataFrame:
    """(slab_no, node, k), several rows a node: sums of kernels at the nodes of an n x n grid that begins at 0.

    atoms: slab_no, u, v, the whitened places; roots: slab_no, l1, l2, l3, the factor of the kernel's covariance.  A task sums its atoms up
    by cells before anything is shuffled, so shuffles carry cells, not atoms and not nodes.
    """
    c = F.col
    g = {a: F.floor(c(a) / WIDTH) for a in "uv"}
    dealt = atoms.select("slab_no", *[g[a].alias(f"g{a}") for a in "uv"], (c("u") - (g["u"] + 0.5) * WIDTH).alias("s"), (c("v") - (g["v"] + 0.5) * WIDTH).alias("t"))
    cells = dealt.sortWithinPartitions(*CELL).mapInArrow(moments, MOMENTS).join(roots, "slab_no")
    met = cells.select(*CELL, "tensor", "l1", "l2", "l3").repartition("slab_no", "gu").sortWithinPartitions(*CELL)
    return met.mapInArrow(lambda batches: node_sums(batches, n, steps, reach), SUMS)
