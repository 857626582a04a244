"""Near duplicates among embeddings of one label: epsilon grid order join.

1. Vectors become classes of equal (label, direction as stored); a class has one copy of its vector and a count.
2. Principal axes from the scatter of all classes, summed by Spark; the leading ones carry a grid whose cells are as
   wide as the largest distance of a link.  Classes are sorted by label and grid cell, coordinate after coordinate
   (the epsilon grid order), and cut into blocks of consecutive ones of one label, equally many in each.
3. A block is joined with itself where it is made.  Block pairs come from a recursion over intervals of the order:
   a pair of intervals whose boxes on the leading axes are farther apart than a link is dropped, others are split in
   FAN parts a side.  Within a pair of blocks the recursion goes on down to LEAF vectors, with balls about the centres
   besides the boxes: far leaves are skipped, leaves near enough as a whole link without a look at their pairs.
4. Cosines are products of unit vectors in double precision; those within 1e-9 of the bound are decided by exactly
   summed products.  Tasks return counts of links and a spanning forest, never the pairs.

Defined cases: a vector links with nothing if it or its label is null, or it is empty, zero, or has null or non-finite
components; vectors of different length do not link.  Repeated rows and equal vectors are rows of their own, linked with each
other; a component's id is its smallest vec_id that is not null, and null if all are.  An empty table gives an empty
result; other columns of the table are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import ranked
from .common import give_back, small_side, staged, table
from .jaccard import connected

LEAST = 0.98
#: Leading principal axes with a grid; classes of a block, by bytes of its vectors; vectors of a leaf; parts of a split.
AXES, BLOCK_BYTES, LEAF, FAN = 8, 1 << 20, 64, 16
#: Lengths of vectors that get principal axes: the most common ones; others take their first coordinates.
LENGTHS = 8
#: Bounds are widened by this, far above rounding; cosines this near the bound are summed exactly.
SLACK = 1e-9


def keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, k1, k2, x) of all rows; x: the vector as bytes, scaled by a power of two; null if it cannot link."""

    def work(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            out = []
            for label, values in zip(batch.column("label").to_pylist(), batch.column("embedding")):
                v = None if label is None or not values.is_valid else values.values
                x = None
                if v is not None and len(v) and not v.null_count:
                    x = v.cast(pa.float64()).to_numpy(zero_copy_only=False)
                    top = np.abs(x).max()
                    x = np.ldexp(x, -int(np.frexp(top)[1])) + 0.0 if np.isfinite(top) and top > 0 else None
                if x is None:
                    out.append((None, None, None))
                    continue
                raw = x.tobytes()
                k = xxhash.xxh3_128_intdigest(label.encode() + b"\0" + raw)
                out.append(((k >> 64) - (1 << 63), (k & ((1 << 64) - 1)) - (1 << 63), raw))
            k1, k2, x = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(x, pa.binary())], names=["vec_id", "label", "k1", "k2", "x"]
            )
        give_back()

    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    return plain.mapInArrow(work, "vec_id long, label string, k1 long, k2 long, x binary")


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """length of vectors -> its leading principal axes (columns), from sums over all classes.

    A task sends the sums of products of its unit vectors, length times length numbers, however many vectors it has.
    """
    lengths = classes.groupBy(F.length("x").alias("bytes")).count().orderBy(F.desc("count"), "bytes").limit(LENGTHS)
    wanted = [r.bytes for r in lengths.collect()]

    def sums(batches):
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            raw = batch.column(0).to_pylist()
            for b in {len(r) for r in raw} & set(wanted):
                u = units(np.frombuffer(b"".join(r for r in raw if len(r) == b)).reshape(-1, b // 8))
                u = np.hstack([u, np.ones((len(u), 1))])  # the last row and column have the plain sums
                held[b] = held.get(b, 0) + u.T @ u
        for b, s in held.items():
            for i, row in enumerate(s):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([i], pa.int64()), pa.array([row.tolist()], pa.list_(pa.float64()))], names=["bytes", "i", "row"])

    parts = classes.select("x").mapInArrow(sums, "bytes long, i long, row array<double>")
    total = parts.select("bytes", "i", F.posexplode("row").alias("j", "v")).groupBy("bytes", "i", "j").agg(F.sum("v").alias("v")).collect()
    out = {}
    for b in wanted:
        s = np.zeros((b // 8 + 1, b // 8 + 1))
        for r in total:
            if r.bytes == b:
                s[r.i, r.j] = r.v
        mean = s[-1, :-1] / max(s[-1, -1], 1)
        _, axes = np.linalg.eigh(s[:-1, :-1] - s[-1, -1] * np.outer(mean, mean))
        out[b // 8] = axes[:, ::-1][:, :AXES]
    return out


def on_axes(u: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Coordinates on the leading axes, zeros where there are fewer."""
    q = axes.get(u.shape[1])
    y = u[:, :AXES] if q is None else u @ q
    return np.hstack([y, np.zeros((len(y), AXES - y.shape[1]))]) if y.shape[1] < AXES else y


class Leaves:
    """Vectors in epsilon grid order, in runs of LEAF: boxes on the leading axes, balls about the centres."""

    def __init__(self, u: np.ndarray, axes: dict[int, np.ndarray]):
        self.first = np.arange(0, len(u), LEAF)
        self.last = np.append(self.first[1:], len(u))
        y = on_axes(u, axes)
        self.lo, self.hi = np.minimum.reduceat(y, self.first), np.maximum.reduceat(y, self.first)
        self.centre = np.add.reduceat(u, self.first) / (self.last - self.first)[:, None]
        far = np.sqrt(((u - np.repeat(self.centre, self.last - self.first, axis=0)) ** 2).sum(axis=1))
        self.radius = np.maximum.reduceat(far, self.first)


def leaf_pairs(a: Leaves, b: Leaves, eps: float) -> np.ndarray:
    """Pairs of leaves whose boxes a link can bridge, by recursive halving of both sequences."""
    levels = []
    for side in (a, b):
        own = [(side.lo, side.hi)]
        while len(own[-1][0]) > 1:
            lo, hi = own[-1]
            half = np.arange(0, len(lo), 2)
            own.append((np.minimum.reduceat(lo, half), np.maximum.reduceat(hi, half)))
        levels.append(own)
    deep = max(map(len, levels))
    pairs = np.zeros((1, 2), dtype=np.int64)
    for level in range(deep - 1, -1, -1):
        boxes = [own[level] if level < len(own) else own[-1] for own in levels]
        if level < deep - 1:
            steps = [np.array([0, 1]) if level + 1 < len(own) else np.array([0]) for own in levels]
            children = [pairs[:, k] * 2 if level + 1 < len(levels[k]) else pairs[:, k] for k in (0, 1)]
            i = np.repeat(children[0][:, None] + steps[0][None, :], len(steps[1]), axis=1)
            j = np.tile(children[1][:, None] + steps[1][None, :], (1, len(steps[0])))
            pairs = np.stack([i.ravel(), j.ravel()], axis=1)
            pairs = pairs[(pairs[:, 0] < len(boxes[0][0])) & (pairs[:, 1] < len(boxes[1][0]))]
        (lo_a, hi_a), (lo_b, hi_b) = boxes
        gap = np.maximum(0, np.maximum(lo_a[pairs[:, 0]] - hi_b[pairs[:, 1]], lo_b[pairs[:, 1]] - hi_a[pairs[:, 0]]))
        pairs = pairs[(gap * gap).sum(axis=1) <= (eps + SLACK) ** 2]
    return pairs


def exact_cosine(x: np.ndarray, y: np.ndarray) -> float:
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def join(x: np.ndarray, other: np.ndarray | None, weight: np.ndarray, axes: dict[int, np.ndarray], least: float, label: np.ndarray) -> np.ndarray:
    """Links of each vector of x followed by other (None: x with itself); weights are the rows of a class.

    label: component of each vector, merged in place to the smallest.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * least))
    same = other is None
    u = units(x)
    v = u if same else units(other)
    both = x if same else np.vstack([x, other])
    shift = 0 if same else len(x)
    a = Leaves(u, axes)
    b = a if same else Leaves(v, axes)
    pairs = leaf_pairs(a, b, eps)
    if same:
        pairs = pairs[pairs[:, 0] <= pairs[:, 1]]
    apart = np.sqrt(((a.centre[pairs[:, 0]] - b.centre[pairs[:, 1]]) ** 2).sum(axis=1))
    reach = a.radius[pairs[:, 0]] + b.radius[pairs[:, 1]]
    links = np.zeros(len(both), dtype=np.int64)

    def merge(i: int, js: np.ndarray) -> None:
        met = np.unique(np.append(label[js], label[i]))
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]

    # as a whole near enough: every pair links
    whole = apart + reach <= eps - SLACK
    for i, j in pairs[whole]:
        p, q = np.arange(a.first[i], a.last[i]), shift + np.arange(b.first[j], b.last[j])
        if same and i == j:
            links[p] += weight[p].sum() - weight[p]
        else:
            links[p] += weight[q].sum()
            links[q] += weight[p].sum()
        merge(p[0], np.append(p, q))
    pairs = pairs[~whole & (apart - reach <= eps + SLACK)]
    for i in np.unique(pairs[:, 0]):
        js = pairs[pairs[:, 0] == i, 1]
        p = np.arange(a.first[i], a.last[i])
        q = np.concatenate([np.arange(b.first[j], b.last[j]) for j in js])
        cosine = u[p] @ v[q].T
        hit = cosine >= least
        for r, c in zip(*np.nonzero(np.abs(cosine - least) < SLACK)):
            hit[r, c] = exact_cosine(both[p[r]], both[shift + q[c]]) >= least
        if same:
            hit &= p[:, None] < q[None, :]
        q = q + shift
        links[p] += hit @ weight[q]
        links[q] += weight[p] @ hit
        for r in np.flatnonzero(hit.any(axis=1)):
            merge(p[r], q[hit[r]])
    return links


BLOCK = "label string, block long, n long, bytes long, ids binary, weights binary, x binary, roots binary, links binary, " + ", ".join(f"lo{k} double, hi{k} double" for k in range(AXES))


def blocks_of(classes: DataFrame, axes: dict[int, np.ndarray], least: float) -> DataFrame:
    """A row per block of the classes (label, class, n, x): packed vectors, links and roots within it, its box."""
    eps = math.sqrt(max(1e-12, 2 - 2 * least))
    cells = [f"c{k}" for k in range(AXES)]

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            raw, cell = batch.column("x").to_pylist(), np.zeros((batch.num_rows, AXES), dtype=np.int64)
            size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
            for b in np.unique(size):
                at = np.flatnonzero(size == b)
                cell[at] = np.floor(on_axes(units(np.frombuffer(b"".join(raw[i] for i in at)).reshape(-1, b // 8)), axes) / eps)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), *(pa.array(cell[:, k]) for k in range(AXES))], names=[*batch.schema.names, "bytes", *cells])

    def cut(key, tab):
        import pyarrow as pa

        label, size, number = (k.as_py() for k in key)
        tab = tab.sort_by([("rank", "ascending")])
        x = np.frombuffer(b"".join(tab.column("x").to_pylist())).reshape(-1, size // 8)
        ids, weight = (np.asarray(tab.column(c)) for c in ("class", "n"))
        root = np.arange(len(x))
        links = join(x, None, weight, axes, least, root)
        y = on_axes(units(x), axes)
        box = [v for k in range(AXES) for v in (y[:, k].min(), y[:, k].max())]
        row = [label, number, len(x), size, ids.tobytes(), weight.tobytes(), x.tobytes(), ids[root].tobytes(), links.tobytes(), *box]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5, *[pa.float64()] * (2 * AXES)]
        give_back()
        return pa.table({c.split()[0]: pa.array([v], k) for c, v, k in zip(BLOCK.split(", "), row, kinds)})

    kinds = ", ".join(f"{c} long" for c in ["bytes", *cells])
    dealt = staged(classes.select("label", "class", "n", "x").mapInArrow(place, f"label string, class long, n long, x binary, {kinds}"), "cells")
    order = ranked(dealt, ["label", "bytes"], [*cells, "class"], rank=["label", "bytes"])
    number = F.floor(F.col("rank") / F.greatest(F.lit(LEAF), F.floor(F.lit(BLOCK_BYTES) / F.col("bytes")))).alias("block")
    return order.select("label", "bytes", number, "rank", "class", "n", "x").groupBy("label", "bytes", "block").applyInArrow(lambda key, tab: cut(key, tab), BLOCK)


def block_pairs(boxes: DataFrame, least: float) -> DataFrame:
    """(label, bytes, i, j) of the blocks (label, bytes, block, lo.., hi..) that a link can bridge, i before j in the order.

    Nodes of level k are FAN ** k consecutive blocks of one label.  From the topmost node of each label down, a pair of
    nodes is split into the pairs of its children, and those too far apart are dropped.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * least)) + SLACK
    bounds = [c for k in range(AXES) for c in (f"lo{k}", f"hi{k}")]
    nodes = [boxes.withColumnRenamed("block", "node")]
    most = nodes[0].agg(F.max("node")).first()[0] or 0
    while most:
        most //= FAN
        up = nodes[-1].withColumn("node", F.expr(f"node div {FAN}")).groupBy("label", "bytes", "node")
        nodes.append(staged(up.agg(*[(F.min if c[:2] == "lo" else F.max)(c).alias(c) for c in bounds]), "nodes"))
    pairs = nodes[-1].select("label", "bytes", F.col("node").alias("i"), F.col("node").alias("j"))
    sides = lambda n, s: n.select("label", "bytes", F.col("node").alias(s), F.expr(f"node div {FAN}").alias(f"{s}_up"), *[F.col(c).alias(f"{c}_{s}") for c in bounds])
    gap = lambda k: F.greatest(F.lit(0.0), F.col(f"lo{k}_i") - F.col(f"hi{k}_j"), F.col(f"lo{k}_j") - F.col(f"hi{k}_i"))
    for level in nodes[-2::-1]:
        up = pairs.select("label", "bytes", F.col("i").alias("i_up"), F.col("j").alias("j_up"))
        both = up.join(sides(level, "i"), ["label", "bytes", "i_up"]).join(sides(level, "j"), ["label", "bytes", "j_up"])
        near = sum((gap(k) * gap(k) for k in range(AXES)), F.lit(0.0)) <= eps * eps
        pairs = staged(both.where((F.col("i") <= F.col("j")) & near).select("label", "bytes", "i", "j"), "node_pairs")
    return pairs.where("i < j")


def links_of(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label)."""
    rows = staged(keyed(vectors), "rows")
    classes = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("x").alias("x"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    classes = staged(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    axes = principal_axes(classes)
    blocks = staged(blocks_of(classes, axes, least), "blocks")
    boxes = staged(blocks.select("label", "bytes", "block", *[c for k in range(AXES) for c in (f"lo{k}", f"hi{k}")]), "boxes")
    pairs = staged(block_pairs(boxes, least), "block_pairs")

    def across(tab):
        import pyarrow as pa

        one, two = sorted(tab.to_pylist(), key=lambda r: r["block"])
        of = lambda name, kind: [np.frombuffer(r[name], dtype=kind) for r in (one, two)]
        ids, weight = (np.concatenate(of(c, np.int64)) for c in ("ids", "weights"))
        names, label = np.unique(np.concatenate(of("roots", np.int64)), return_inverse=True)
        began = label.copy()
        x, y = (v.reshape(-1, one["bytes"] // 8) for v in of("x", np.float64))
        links = join(x, y, weight, axes, least, label)
        new, some = np.flatnonzero(label != began), np.flatnonzero(links)
        merged = np.unique(np.stack([names[began[new]], names[label[new]]]), axis=1)
        return pa.table({"a": np.append(ids[some], merged[0]), "b": np.append(np.full(len(some), -1), merged[1]), "links": np.append(links[some], np.zeros(merged.shape[1], np.int64))})

    def within(batches):
        import pyarrow as pa

        for batch in batches:
            for ids, roots, links in zip(*(batch.column(c).to_pylist() for c in ("ids", "roots", "links"))):
                ids, roots, links = (np.frombuffer(v, dtype=np.int64) for v in (ids, roots, links))
                yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, ids)), pa.array(np.append(np.full(len(ids), -1), roots)), pa.array(np.append(links, np.zeros(len(ids), np.int64)))], names=["a", "b", "links"])

    schema = "a long, b long, links long"
    ends = pairs.withColumn("block", F.explode(F.array("i", "j")))
    sent = blocks.select("label", "bytes", "block", "ids", "weights", "x", "roots").join(ends, ["label", "bytes", "block"])
    found = blocks.select("ids", "roots", "links").mapInArrow(within, schema).where("links > 0 or (b >= 0 and a <> b)")
    found = staged(found.unionAll(sent.groupBy("label", "bytes", "i", "j").applyInArrow(lambda tab: across(tab), schema)), "found")
    counts = found.where("b < 0").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    roots = connected(found.where("b >= 0").select("a", "b"))
    named = classes.select("class", "k1", "k2", "n", "least").join(roots, F.col("class") == F.col("node"), "left").join(counts, "class", "left")
    named = staged(named.select("k1", "k2", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "class").alias("component")), "named")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = small_side(staged(named.join(smallest, "component").select("k1", "k2", "n_links", "component_id"), "linked"))
    own = rows.select("vec_id", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = own.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir):
    return links_of(table(spark, sf_dir, "embeddings"))


SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), u as (select * from v where list_dot_product(e, e) > 0),
near as (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98
), reach as (select vec_id as a, vec_id as b from embeddings union select r.a, n.b from reach r join near n on r.b = n.a),
least as (select a, min(b) as component_id from reach group by a),
counts as (select a, count(*) as n from near group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings join least on vec_id = least.a left join counts on vec_id = counts.a
"""
