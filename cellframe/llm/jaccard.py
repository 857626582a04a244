"""N-gram Jaccard join: components of documents whose shingle sets have a Jaccard similarity of at least percent / 100.

1. Every text becomes a set of 64-bit shingle hashes.  Documents with equal sets form a class; one text a class goes on.
2. Blocks by prefix filter.  Shingles are ordered by how many classes hold them.  Two sets that link share one of the
   first n - ceil(n * percent / 100) + 1 of either, so a class whose prefix is its own alone has no partner and leaves;
   the others get rows (prefix shingle, class), whose connected components are the blocks.  No link crosses blocks.
   Shingles that a large part of the documents hold are told apart in the first pass; they come last in the order
   and are not shuffled, but for the few classes whose prefix reaches them.
3. A signature tree per block.  A set is a bitmap over the block's shingles; nodes hold the OR of their sets'
   bitmaps and their range of sizes.  A dual traversal drops pairs of nodes whose sizes are too far apart or whose
   bitmaps have too few places in common for any link, and pairs that are one component already; at the leaves
   the overlap is the exact number of common places.

4. A block of more than CHUNK shingles is split over tasks (see `link_large`): links within two random dealings of
   its classes first, then every pair of chunks that may hold a link between two components.  Such tasks, and blocks
   whose bitmaps would be large, count overlaps tile by tile from the sparse sets.

Only counts and packed arrays are shuffled; pairs are never emitted.  A task holds two chunks at most (8 bytes a
shingle), however large a group of near copies is.

Defined cases: null texts and texts without words have an empty set and link with nothing; with fewer words than the
shingle's size the whole sequence is the one shingle; rows that repeat a doc_id are rows of their own, whether their
texts are equal or not, as classes are numbered by their sets and not by ids; a component's id is the smallest doc_id
in it; a null doc_id is never a component's id unless all are null.  Ties need no rule: links are by exact counts.  Texts of
any length count whole; an empty table gives an empty result; columns other than doc_id and text are not read, but
one_of_each keeps all, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnum
from .common import fresh, give_back, small_side, staged, table

SIZE = 4
PERCENT = 85
#: A shingle is common if the slices in which it is frequent hold it in at least this share of all documents.
COMMON = 0.002
SLICE_SHARE, SLICE_LEAST = 0.004, 16
#: Shingles a shuffled bucket holds about, and bytes of text a pack of blocks.
BUCKET, PACK = 2_000_000, 24_000_000
LEAF = 64
#: Shingles of a block that one task takes; bytes of bitmaps above which a block's overlaps are counted in tiles.
CHUNK, DENSE = 1 << 20, 1 << 26
#: Sets a side of a tile, shingles multiplied and pairs counted at once.
TILE, COLUMNS, PAIRS = 1024, 4096, 1 << 20
#: In packed arrays: the highest rank of a counted shingle, a class's numbers of shingles, a common shingle.
TOP_RANK, SIZES, LATE = 249, 250, 255


def shingle_sets(text, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of an Arrow string column."""
    import pyarrow.compute as pc

    data, offs, _ = textnum.doc_bytes(pc.binary_join_element_wise(pc.fill_null(text, ""), "", "\n"))
    data, offs = textnum.lower_ascii(data[offs[0] : offs[-1]]), offs - offs[0]
    start, end = textnum.word_spans(data)
    words = textnum.span_hashes(data, start, end)
    where = np.searchsorted(start, offs)
    grams = textnum.shingle_hashes(words, size) if len(words) >= size else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(where[:-1], where[1:]):
        out.append(np.unique(grams[a : b - size + 1]) if b - a >= size else textnum.shingle_hashes(words[a:b], size))
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    x = xxhash.xxh3_128_intdigest(s.tobytes())
    return (x >> 64) - (1 << 63), (x & ((1 << 64) - 1)) - (1 << 63)


def _slices(batches):
    from .tokenfiles import slices

    for big in batches:
        yield from slices(big, 1)


def profile(docs: DataFrame, size: int) -> DataFrame:
    """kind 0: (doc_id, h, n, k1, k2) of each document (doc_id, text, h); kind 1: (k1 = shingle, n = count) of a slice's frequent shingles."""

    def work(batches):
        import pyarrow as pa

        for batch in _slices(batches):
            sets = shingle_sets(batch.column(1), size)
            keys = np.array([set_key(s) for s in sets], dtype=np.int64).reshape(-1, 2)
            n = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
            kinds = [pa.array(np.zeros(len(sets), np.int8)), pa.array(n), pa.array(keys[:, 0]), pa.array(keys[:, 1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *kinds], names=["doc_id", "h", "kind", "n", "k1", "k2"])
            value, count = np.unique(np.concatenate(sets), return_counts=True)
            often = count >= max(SLICE_LEAST, SLICE_SHARE * len(sets))
            m = int(often.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(np.ones(m, np.int8)), pa.array(count[often].astype(np.int64)), pa.array(value[often].view(np.int64)), pa.array(np.zeros(m, np.int64))],
                names=["doc_id", "h", "kind", "n", "k1", "k2"],
            )
        give_back()

    return docs.mapInArrow(work, "doc_id long, h long, kind byte, n long, k1 long, k2 long")


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(values)))


def prefix_length(n, percent: int):
    """How many of a set's first shingles any partner must touch."""
    return n - -(-n * percent // 100) + 1


def _packed(bucket: np.ndarray, owner: np.ndarray, value: np.ndarray, extra: np.ndarray):
    """A record batch with a row per bucket: its owners' runs and their values, all as bytes."""
    import pyarrow as pa

    order = np.argsort(bucket, kind="stable")
    bucket, owner, value, extra = bucket[order], owner[order], value[order], extra[order]
    first, count = _runs(bucket)
    rows = [[], [], [], []]
    for a, c in zip(first, count):
        f, k = _runs(owner[a : a + c])
        for column, x in zip(rows, (owner[a + f], k.astype(np.uint32), value[a : a + c], extra[a : a + c])):
            column.append(x.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int64)), *(pa.array(c, pa.binary()) for c in rows)], names=["bucket", "owners", "counts", "shingles", "extra"])


PACKED = "bucket long, owners binary, counts binary, shingles binary, extra binary"


def _unpacked(tab) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, shingle, extra byte) of all rows of an Arrow table."""
    get = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), dtype=kind) for x in tab.column(name)])
    return np.repeat(get("owners", np.int64), get("counts", np.uint32)), get("shingles", np.uint64), get("extra", np.uint8)


def prefix_rows(texts: DataFrame, common: DataFrame, n_buckets: int, n_packs: int, size: int, percent: int) -> DataFrame:
    """(shingle, class) for the shared shingles of the prefix of each class that may have a partner."""
    listed = sorted((r.n, r.k1) for r in common.collect())  # at most the mean size of a set over COMMON: see _components
    handed = texts.sparkSession.sparkContext.broadcast(np.array([k for _, k in listed], dtype=np.int64).view(np.uint64))

    def deal(batches):
        often = handed.value
        order = np.argsort(often)
        ranked = often[order]
        for batch in _slices(batches):
            sets = shingle_sets(batch.column(1), size)
            ids = np.asarray(batch.column(0))
            own, k1, k2 = [], np.asarray(batch.column(2)), np.asarray(batch.column(3))
            for i, s in enumerate(sets):
                own.append(s if set_key(s) == (k1[i], k2[i]) else s[:0])
            n = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
            owner, value = np.repeat(ids, n), np.concatenate(own)
            at = np.minimum(np.searchsorted(ranked, value), max(len(ranked) - 1, 0))
            hot = ranked[at] == value if len(ranked) else np.zeros(len(value), bool)
            row = np.repeat(np.arange(len(n)), n)
            n_hot = np.bincount(row[hot], minlength=len(n))
            # a prefix that reaches the common shingles takes the first of them in their order
            reach = prefix_length(n, percent) - (n - n_hot)
            late_owner, late_value = [], []
            for i in np.flatnonzero((reach > 0) & (n_hot > 0)):
                mine = np.sort(order[at[hot & (row == i)]])[: reach[i]]
                late_owner.append(np.full(len(mine), ids[i]))
                late_value.append(often[mine])
            keep = ~hot
            owner, value = owner[keep], value[keep]
            extra = np.zeros(len(value), np.uint8)
            if len(value):
                yield _packed((value >> np.uint64(33)).astype(np.int64) % n_buckets, owner, value, extra)
            some = np.flatnonzero(n > 0)
            if len(some):  # negative buckets: these need no counting
                o = np.concatenate([ids[some], *late_owner])
                v = np.concatenate([(n_hot[some].astype(np.uint64) << np.uint64(32)) | n[some].astype(np.uint64), *late_value])
                kind = np.repeat(np.array([SIZES, LATE], np.uint8), [len(some), len(o) - len(some)])
                yield _packed(-1 - (textnum.mix(o.astype(np.uint64)) % np.uint64(n_packs)).astype(np.int64), o, v, kind)

    def shared(tab):
        owner, value, _ = _unpacked(tab)
        order = np.argsort(value, kind="stable")
        owner, value = owner[order], value[order]
        _, count = _runs(value)
        df = np.repeat(count, count)
        keep = df > 1
        owner, value = owner[keep], value[keep]
        rank = np.minimum(TOP_RANK, 8 * np.log2(df[keep])).astype(np.uint8)
        order = np.argsort(owner, kind="stable")
        owner, value, rank = owner[order], value[order], rank[order]
        return _packed((textnum.mix(owner.astype(np.uint64)) % np.uint64(n_packs)).astype(np.int64), owner, value, rank)

    def count_shared(bucket, tab):
        import pyarrow as pa

        if bucket < 0:  # needs no counting: on to its pack
            return tab.set_column(tab.column_names.index("bucket"), "bucket", pa.array(np.full(len(tab), -1 - bucket, dtype=np.int64)))
        return pa.Table.from_batches([shared(tab)])

    counted = texts.mapInArrow(deal, PACKED).groupBy("bucket").applyInArrow(lambda key, tab: count_shared(key[0].as_py(), tab), PACKED)
    packs = counted.groupBy("bucket")

    def choose(key, tab):
        import pyarrow as pa

        owner, value, rank = _unpacked(tab)
        order = np.lexsort((value, rank, owner))
        owner, value, rank = owner[order], value[order], rank[order]
        # a repeated row sends its class twice
        one = np.append(True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1]) | (rank[1:] != rank[:-1]))[: len(owner)]
        owner, value, rank = owner[one], value[one], rank[one]
        first, count = _runs(owner)
        if not len(first):
            return pa.table({"class": owner, "shingle": value.view(np.int64)})
        place = np.arange(len(owner)) - np.repeat(first, count)
        # of a class's n shingles, those that nothing shares come first, then the shared ones, then the common ones
        sizes = np.add.reduceat(np.where(rank == SIZES, value, np.uint64(0)), first)
        n, n_hot = (sizes & np.uint64(0xFFFFFFFF)).astype(np.int64), (sizes >> np.uint64(32)).astype(np.int64)
        alone = n - n_hot - np.add.reduceat((rank <= TOP_RANK).astype(np.int64), first)
        keep = (rank == LATE) | ((rank <= TOP_RANK) & (place < np.repeat(prefix_length(n, percent) - alone, count)))
        return pa.table({"class": owner[keep], "shingle": value[keep].view(np.int64)})

    return packs.applyInArrow(lambda key, tab: choose(key, tab), "class long, shingle long")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each set of a has in common with each set of b: frequent values by products, others by pairs."""
    na, nb = len(a), len(b)
    sets = [*a, *b]
    owner = np.repeat(np.arange(na + nb), np.fromiter(map(len, sets), dtype=np.int64, count=na + nb))
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    out = np.zeros(na * nb, dtype=np.int64)
    first, count = _runs(value)
    if not len(first):
        return out.reshape(na, nb)
    left = np.add.reduceat((owner < na).astype(np.int64), first)
    right = count - left
    often = left * right * 256 > na * nb
    run = np.repeat(np.arange(len(first)), count)
    # owners ascend within a value: those of a, then those of b
    mine = np.flatnonzero((owner < na) & (right[run] > 0) & ~often[run])
    many = right[run[mine]]
    ends = np.cumsum(many)
    at = 0
    while at < len(mine):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        m, k = mine[at:to], many[at:to]
        step = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
        other = owner[np.repeat((first + left)[run[m]], k) + step] - na
        out += np.bincount(np.repeat(owner[m], k) * nb + other, minlength=na * nb)
        at = to
    out = out.reshape(na, nb)
    column = np.cumsum(often) - 1
    hot = np.flatnonzero(often[run])
    where, who = column[run[hot]], owner[hot]
    for c in range(0, int(often.sum()), COLUMNS):
        x, y = np.searchsorted(where, (c, c + COLUMNS))
        holds = np.zeros((na + nb, COLUMNS), dtype=np.float32)  # counts stay far below 2^24
        holds[who[x:y], where[x:y] - c] = 1
        out += (holds[:na] @ holds[na:].T).astype(np.int64)
    return out


def merge_links(sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, right: np.ndarray | None, percent: int) -> None:
    """Give the sets `left` and `right` (indices; right None: left with itself) that link one label, the smallest."""
    size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))

    def tiles(x):
        x = x[np.argsort(size[x], kind="stable")]
        return [x[i : i + TILE] for i in range(0, len(x), TILE)]

    one = tiles(left)
    pairs = [(x, y) for i, x in enumerate(one) for y in one[: i + 1]] if right is None else [(x, y) for x in one for y in tiles(right)]
    for x, y in pairs:
        if 100 * size[x[-1]] < percent * size[y[0]] or 100 * size[y[-1]] < percent * size[x[0]]:
            continue
        if (label[x] == label[x[0]]).all() and (label[y] == label[x[0]]).all():
            continue
        common = overlaps([sets[i] for i in x], [sets[i] for i in y])
        link = 100 * common >= percent * (size[x][:, None] + size[y][None, :] - common)
        link &= label[x][:, None] != label[y][None, :]
        for i in np.flatnonzero(link.any(axis=1)):
            met = np.unique(np.append(label[y[link[i]]], label[x[i]]))
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]


def links_of(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component number (its smallest member) of each of a block's sets, by dual traversal of its signature tree."""
    n = len(sets)
    size = np.fromiter(map(len, sets), dtype=np.int64, count=n)
    owner, value = np.repeat(np.arange(n), size), np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    _, count = _runs(value)
    keep = np.repeat(count, count) > 1  # a shingle of one set is in no overlap
    local = np.repeat(np.arange(len(count)), count)[keep]
    owner = owner[keep]
    _, local = np.unique(local, return_inverse=True)
    width = int(local.max()) + 1 if len(local) else 1
    words = -(-width // 64)
    if 8 * n * words > DENSE:
        label = np.arange(n)
        merge_links(sets, label, label.copy(), None, percent)
        return label
    parent = np.arange(n)

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    # leaves: neighbours in size, then in their first shared shingle
    first = np.full(n, width)
    np.minimum.at(first, owner, local)
    line = np.lexsort((first, size))
    rank = np.empty(n, dtype=np.int64)
    rank[line] = np.arange(n)
    bits = np.zeros((n, words), dtype=np.uint64)
    np.bitwise_or.at(bits, (rank[owner], local >> 6), np.uint64(1) << (local & 63).astype(np.uint64))
    size = size[line]
    starts = np.arange(0, n, LEAF)
    # levels[0]: leaves; each node of a higher one covers two of the one below
    levels = [(np.bitwise_or.reduceat(bits, starts, axis=0), np.minimum.reduceat(size, starts), np.maximum.reduceat(size, starts))]
    while len(levels[-1][1]) > 1:
        o, lo, hi = levels[-1]
        half = np.arange(0, len(lo), 2)
        levels.append((np.bitwise_or.reduceat(o, half, axis=0), np.minimum.reduceat(lo, half), np.maximum.reduceat(hi, half)))

    def least(a, b):  # overlap that a link of sets of at least these sizes has
        return -(-percent * (a + b) // (100 + percent))

    todo = [(len(levels) - 1, 0, 0)]
    while todo:
        level, i, j = todo.pop()
        o, lo, hi = levels[level]
        small, large = (i, j) if hi[i] <= hi[j] else (j, i)
        if 100 * hi[small] < percent * lo[large]:
            continue
        if int(np.bitwise_count(o[i] & o[j]).sum()) < least(lo[i], lo[j]):
            continue
        if level:
            m = len(levels[level - 1][1])
            pairs = {(min(a, b), max(a, b)) for a in (2 * i, 2 * i + 1) for b in (2 * j, 2 * j + 1) if a < m and b < m}
            todo += [(level - 1, a, b) for a, b in sorted(pairs, reverse=True)]
            continue
        a, b = np.arange(starts[i], min(n, starts[i] + LEAF)), np.arange(starts[j], min(n, starts[j] + LEAF))
        roots_a, roots_b = [root(x) for x in a], [root(x) for x in b]
        if len({*roots_a, *roots_b}) == 1:
            continue
        overlap = np.stack([np.bitwise_count(bits[x][None, :] & bits[b]).sum(axis=1, dtype=np.int64) for x in a])
        union = size[a][:, None] + size[b][None, :] - overlap
        for x, y in zip(*np.nonzero(100 * overlap >= percent * union)):
            p, q = root(a[x]), root(b[y])
            if p != q:
                parent[max(p, q)] = min(p, q)
    roots = np.array([root(x) for x in range(n)])
    smallest = np.full(n, n, dtype=np.int64)
    np.minimum.at(smallest, roots, line)
    out = np.empty(n, dtype=np.int64)
    out[line] = smallest[roots]
    return out


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of an undirected graph (a, b) by alternating large and small stars; roots are smallest nodes."""
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    # rounds grow with the logarithm of the longest path
    for _ in range(200):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.where("a <> b").distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("x"), "m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b"))
        new = staged(small.where("a <> b").distinct(), "small")
        same = new.count() == edges.count() and not new.join(edges, ["a", "b"], "left_anti").head(1)
        edges = new
        if same:
            break
    else:
        raise RuntimeError("components are not found after 200 rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def in_chunks(rows: DataFrame, salt: int) -> DataFrame:
    """rows (root, class, n, major, ...) with _chunk: neighbours in size, of about CHUNK shingles; major ones apart."""
    bins = rows.groupBy("root", "major", "n").agg(F.sum("n").alias("_w"))
    before = Window.partitionBy("root", "major").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)  # over sizes, not rows
    bins = small_side(staged(bins.withColumn("_before", F.coalesce(F.sum("_w").over(before), F.lit(0))), "bins"))
    share = F.pmod(F.xxhash64("class", F.lit(salt)), F.lit(1 << 20)) / F.lit(1 << 20)
    chunk = F.floor((F.col("_before") + share * F.col("_w")) / F.lit(CHUNK)).cast("long")
    return rows.join(bins, ["root", "major", "n"]).withColumn("_chunk", 2 * chunk + F.col("major")).drop("_w", "_before")


def link_large(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(class, component) of the blocks (root, class, text, k1, k2) that are too large for one task.

    Two random dealings into chunks are linked first, each chunk by itself, which joins most of a group whose members
    link.  Then every pair of chunks is compared, but for those whose sizes are too far apart and those within the
    block's major component (the heaviest one): all their classes are one component already.
    """

    def sets(batches):
        import pyarrow as pa

        for batch in _slices(batches):
            own, k1, k2 = shingle_sets(batch.column(1), size), np.asarray(batch.column(3)), np.asarray(batch.column(4))
            good = np.array([set_key(s) == (k1[i], k2[i]) for i, s in enumerate(own)], dtype=bool)
            at = np.flatnonzero(good)
            n, packed = [len(own[i]) for i in at], [own[i].tobytes() for i in at]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(2).take(pa.array(at)), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], names=["root", "class", "n", "shingles"])
        give_back()

    def link(tab):
        import pyarrow as pa

        ids, first = np.unique(np.asarray(tab.column("class")), return_index=True)  # a repeated row counts once
        own, label = tab.column("shingles").combine_chunks(), np.arange(len(ids))
        merge_links([np.frombuffer(own[int(i)].as_buffer(), dtype=np.uint64) for i in first], label, label.copy(), None, percent)
        return pa.table({"a": ids, "b": ids[label]})

    def link_pair(key, tab):
        import pyarrow as pa

        own, side = tab.column("shingles").combine_chunks(), np.asarray(tab.column("_chunk"))
        names, label = np.unique(np.asarray(tab.column("component")), return_inverse=True)
        began, i, j = label.copy(), key[1].as_py(), key[2].as_py()
        merge_links([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in own], label, np.flatnonzero(side == i), np.flatnonzero(side == j) if i < j else None, percent)
        new = np.flatnonzero(label != began)
        one = np.unique(np.stack([names[began[new]], names[label[new]]]), axis=1)
        return pa.table({"a": one[0], "b": one[1]})

    rows = staged(texts.select("root", "text", "class", "k1", "k2").mapInArrow(sets, "root long, class long, n long, shingles binary"), "sets").withColumn("major", F.lit(0))
    edges = None
    for salt in (1, 2):
        one = in_chunks(rows, salt).select("root", "_chunk", "class", "shingles").groupBy("root", "_chunk").applyInArrow(lambda tab: link(tab), "a long, b long")
        edges = one if edges is None else edges.unionAll(one)
    found = staged(connected(edges), "found")
    named = staged(rows.select("root", "class", "n").distinct().join(found, F.col("class") == F.col("node"), "left").select(rows["root"], "class", "n", F.coalesce(found["root"], F.col("class")).alias("component")), "components")
    heavy = named.groupBy("root", "component").agg(F.sum("n").alias("w")).where(F.col("w") > CHUNK).groupBy("root").agg(F.max(F.struct("w", "component")).alias("h"))
    heavy = small_side(staged(heavy.select(F.col("root").alias("_root"), F.col("h.component").alias("_heavy")), "heavy"))
    named = named.join(heavy, F.col("root") == F.col("_root"), "left").select("class", "component", F.when(F.col("component") == F.col("_heavy"), 1).otherwise(0).alias("major"))
    dealt = in_chunks(rows.drop("major").join(named, "class"), 3)
    chunks = staged(dealt.groupBy("root", "_chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("component").alias("least"), F.max("component").alias("most")), "chunks")
    a, b = chunks.select("root", *[F.col(c).alias(c + "_a") for c in chunks.columns[1:]]), chunks.select("root", *[F.col(c).alias(c + "_b") for c in chunks.columns[1:]])
    near = (100 * F.col("hi_a") >= percent * F.col("lo_b")) & (100 * F.col("hi_b") >= percent * F.col("lo_a"))
    one = (F.col("least_a") == F.col("most_a")) & (F.col("least_b") == F.col("most_b")) & (F.col("least_a") == F.col("least_b"))
    pairs = staged(a.join(b, "root").where((F.col("_chunk_a") <= F.col("_chunk_b")) & near & ~one).select("root", F.col("_chunk_a").alias("i"), F.col("_chunk_b").alias("j")), "pairs")
    ends = pairs.withColumn("_chunk", F.explode(F.array_distinct(F.array("i", "j")))).groupBy("root", "_chunk").agg(F.collect_list(F.struct("i", "j")).alias("p"))
    ends = small_side(staged(ends, "ends"))
    sent = dealt.join(ends, ["root", "_chunk"]).select("root", F.explode("p").alias("p"), "_chunk", "component", "shingles").select("root", "p.i", "p.j", "_chunk", "component", "shingles")
    more = sent.groupBy("root", "i", "j").applyInArrow(lambda key, tab: link_pair(key, tab), "a long, b long")
    joined = staged(connected(more), "joined")
    return named.join(joined, F.col("component") == F.col("node"), "left").select("class", F.coalesce("root", "component").alias("component"))


def _components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, h, n_shingles, best) of every row of docs (doc_id long, text, h = hash of the text).

    best: (no_id, id, h) of the row that stands for the component, the smallest such; null for an empty set.
    """
    seen = staged(profile(docs, size), "profile")
    sets = seen.where("kind = 0")
    total = sets.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles")).first()
    # common shingles: at most mean set size / COMMON of them, however many documents there are
    common = seen.where("kind = 1").groupBy("k1").agg(F.sum("n").alias("n")).where(F.col("n") >= max(4 * SLICE_LEAST, COMMON * total.docs))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "h")
    classes = sets.where("n > 0").groupBy("k1", "k2").agg(F.min(row).alias("best"), F.first("n").alias("n"))
    # numbered as they are written, and fixed from then on
    classes = staged(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    held = docs.join(classes, (docs["h"] == classes["best.h"]) & docs["doc_id"].eqNullSafe(classes["best.id"])).select("class", "text", "k1", "k2", "n")
    n_buckets = max(1, math.ceil((total.shingles or 0) / BUCKET))
    prefix = prefix_rows(held, common, n_buckets, n_buckets, size, percent)
    prefix = staged(prefix, "prefix")
    least = prefix.groupBy("shingle").agg(F.min("class").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1")
    edges = prefix.join(least, "shingle").select(F.col("class").alias("a"), "b")
    blocks = staged(connected(edges), "blocks")
    members = blocks.unionAll(blocks.select(F.col("root").alias("node"), "root").distinct())
    members = staged(members, "members")
    packs = max(1, math.ceil((total.shingles or 0) * 8 / PACK))
    weights = classes.join(members, F.col("class") == F.col("node")).groupBy("root").agg(F.sum("n").alias("w"))
    large = staged(weights.where(F.col("w") > CHUNK).select("root"), "large_blocks")
    inside = held.join(small_side(members), F.col("class") == F.col("node")).select("root", "class", "text", "k1", "k2")
    split = None
    if large.head(1):
        split = link_large(inside.join(small_side(large), "root", "left_semi"), size, percent)
        inside = inside.join(small_side(large), "root", "left_anti")

    def link(key, tab):
        import pyarrow as pa

        roots, ids, text = np.asarray(tab.column("root")), np.asarray(tab.column("class")), tab.column("text").combine_chunks()
        sets, k1, k2 = shingle_sets(text, size), np.asarray(tab.column("k1")), np.asarray(tab.column("k2"))
        good = np.array([set_key(s) == (k1[i], k2[i]) for i, s in enumerate(sets)], dtype=bool)
        at = np.flatnonzero(good)
        at = at[np.lexsort((ids[at], roots[at]))]
        out = ids.copy()
        for a, c in zip(*_runs(roots[at])):
            own = at[a : a + c]
            out[own] = ids[own][links_of([sets[i] for i in own], percent)]
        return pa.table({"class": ids[at], "component": out[at]})

    linked = inside.withColumn("pack", F.pmod(F.xxhash64("root"), F.lit(packs))).groupBy("pack").applyInArrow(lambda key, tab: link(key, tab), "class long, component long").distinct()
    linked = linked if split is None else linked.unionAll(split)
    found = classes.join(linked, "class", "left").select("k1", "k2", "best", F.coalesce("component", "class").alias("component"))
    of_all = found.groupBy("component").agg(F.min("best").alias("best"))
    named = found.drop("best").join(of_all, "component").select("k1", "k2", "best")
    named = small_side(staged(named, "named"))
    own = sets.select("doc_id", "h", F.col("n").alias("n_shingles"), "k1", "k2")
    out = own.join(named, (own["k1"] == named["k1"]) & (own["k2"] == named["k2"]) & (own["n_shingles"] > 0), "left")
    return out.select("doc_id", "h", "n_shingles", "best")


def components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id long, text)."""
    found = _components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")), size, percent)
    return found.select("doc_id", "n_shingles", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id (null ids last), then hash of text.

    Rows without words all stay.  Of rows equal in doc_id and text, which links them, any one stays.  Rows are told
    apart by doc_id and text, so that a repeated or null doc_id never takes another row with it; columns of docs are
    kept whatever their names.
    """
    h, gone_id, gone_h = fresh(docs, "h", "gone_id", "gone_h")
    keyed = docs.withColumn(h, F.xxhash64("text"))
    found = _components(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(h).alias("h")), size, percent)
    found = staged(found.where("n_shingles > 0").select("doc_id", "h", (~(F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("h") == F.col("best.h")))).alias("gone")), "components")
    apart = lambda rows: small_side(staged(rows.select(F.col("doc_id").alias(gone_id), F.col("h").alias(gone_h)), "keys"))
    same = lambda: (F.col(h) == F.col(gone_h)) & F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id))
    left = keyed.join(apart(found.where("gone").distinct()), same(), "left_anti")
    repeated = staged(found.where("not gone").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    if repeated.head(1):
        twice = apart(repeated)
        left = left.join(twice, same(), "left_anti").unionAll(left.join(twice, same(), "left_semi").dropDuplicates(["doc_id", h]))
    return left.drop(h)


def query(spark, sf_dir):
    return components(table(spark, sf_dir, "documents"))
