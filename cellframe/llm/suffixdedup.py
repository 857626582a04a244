"""Suffix-array dedup: cut every byte covered by a string of `length` bytes that starts anywhere else too.

1. Texts that are equal form a class; a class of two texts or more of at least `length` bytes goes whole, and one
   text a class goes on, as its strings count for others.
2. Suspects.  Every window of `length` bytes names its least 32-byte hash, its anchor.  Equal windows have equal
   anchors, so a window whose anchor stands at one place only cannot repeat.  Anchors are counted over all texts.
3. Shards.  The windows left are cut out as segments, dealt to shards by anchor; equal windows meet in one shard.
   A shard sorts its windows' suffixes by Larsson-Sadakane refinement in numpy (ranks at 8, 16 ... 256 and then
   `length` bytes; groups of one are left alone).  Kasai's method then gives the common prefix of neighbours in the
   suffix array; a window repeats if it has `length` bytes in common with either neighbour.  Longer prefixes
   make no difference and are not measured.
4. Anchors that a large part of the texts hold would crowd one shard, and so would any shard that grows beyond its
   size.  Such segments are dealt over many shards, and the shards' sorted window fingerprints are merged by
   binary search.

Defined cases: null texts are empty; texts shorter than `length` keep all their bytes; strings never cross texts; a
text of one repeated byte repeats itself from the second byte on, so all of it goes once it is longer than `length`;
rows that repeat a doc_id are rows of their own, and copies of each other if their texts are equal.  Ties need no rule:
every copy of a repeated string goes.  Anchors of a long text are found PIECE windows at a time, about 50 bytes of memory a
window, with the bytes that the last of them reach over the piece's end; segments end there too.  An empty table gives
an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_side, staged, table
from .jaccard import PACKED, _packed, _runs, _unpacked
from .textnum import doc_bytes, mix

LENGTH = 400
GRAM = 32
#: Bytes of segments a shard holds about; anchors a counting bucket holds about; share of all texts of a common anchor.
SHARD = 3_000_000
#: Bytes of spread segments, and so windows at most, whose fingerprints are merged in one task.
PART = 200_000
#: Windows of a text whose anchors are found at a time.
PIECE = 1 << 20
BUCKET = 1_000_000
COMMON, SLICE_SHARE, SLICE_LEAST = 0.002, 0.004, 16
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63)]
SEGMENTS = "shard long, spread boolean, n_bytes long, owners binary, places binary, sizes binary, bytes binary"
SPANS = "class long, first long, last long"


def eights(data: np.ndarray, reverse: bool = False) -> np.ndarray:
    """The eight bytes from each place as one integer (zeros after the end); reverse: in lexicographic order."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    out = np.empty(n, dtype=np.uint64)
    for o in range(8):
        own = out[o::8]
        if len(own):
            own[:] = padded[o : o + 8 * len(own)].view(">u8" if reverse else "<u8")
    return out


def slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) of each `width` neighbours; as long as x less width - 1."""
    n = len(x)
    rows = -(-n // width)
    fill = np.full(rows * width, x[-1], dtype=x.dtype)
    fill[:n] = x
    fill = fill.reshape(rows, width)
    ahead = f.accumulate(fill, axis=1).ravel()
    back = f.accumulate(fill[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[: n - width + 1], ahead[width - 1 : n])


def window_anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of the window from each place, hash of the gram from each place) of a text of at least `length` bytes."""
    g = eights(data)
    n = len(data) - GRAM + 1
    h = g[:n] * _C[0]
    for k in (1, 2, 3):
        h = (h ^ (h >> np.uint64(31))) * _C[k] + g[8 * k : 8 * k + n]
    h = mix(h)
    return slide(h, length - GRAM + 1, np.minimum), h


def pieces(data: np.ndarray, length: int, piece: int = PIECE):
    """(first place, anchors of the windows from there, hashes of the grams that no later piece has) of a text, by pieces."""
    end = len(data) - length + 1
    for a in range(0, end, piece):
        z = min(end, a + piece)
        m, h = window_anchors(data[a : z + length - 1], length)
        yield a, m, h if z == end else h[: z - a]


def anchors_of(data: np.ndarray, length: int, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted anchors of a text, whether each stands at more than one place of it)."""
    one = len(data) - length < piece
    found = list(pieces(data, length, piece)) if one else pieces(data, length, piece)
    v = np.unique(np.concatenate([np.unique(m[_runs(m)[0]]) for _, m, _ in found]))
    places = np.zeros(len(v), dtype=np.int64)
    # a text of several pieces is hashed again, as an anchor of one piece may stand in any other
    for _, _, h in found if one else pieces(data, length, piece):
        low = h[h <= v[-1]]  # only grams no larger than the largest anchor can be one
        places += np.bincount(np.searchsorted(v, low)[is_in(low, v)], minlength=len(v))
    return v, places > 1


def texts_of(batch, column: int, length: int):
    """(row, bytes) of the texts of at least `length` bytes."""
    data, offs, _ = doc_bytes(batch.column(column))
    for i in np.flatnonzero(np.diff(offs) >= length):
        yield int(i), data[offs[i] : offs[i + 1]]


def common_prefix(words: np.ndarray, i: np.ndarray, p: np.ndarray, cap: int) -> np.ndarray:
    """Bytes, at most cap, that the suffixes at i and p have in common, eight at a time."""
    h, at, k = np.full(len(i), cap, dtype=np.int64), np.arange(len(i)), 0
    while len(at) and k < cap:
        x = words[i[at] + k] ^ words[p[at] + k]
        off = x != 0
        low = x[off] & (~x[off] + np.uint64(1))  # the lowest bit that differs lies in the first byte that differs
        h[at[off]] = np.minimum(cap, k + np.log2(low.astype(np.float64)).astype(np.int64) // 8)
        at, k = at[~off], k + 8
    return h


def kasai(data: np.ndarray, words: np.ndarray, suffixes: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix, at most cap bytes, of each of the ordered suffixes with the one before it; 0 for the first.

    As in Kasai's algorithm, suffixes are taken in text order.  Where suffix and neighbour are both one byte on from
    the pair before, the prefix is the last one less a byte, or if that was cut off at cap, grows by the byte that
    comes into view.  Only where the neighbour changes is a prefix measured.  Each suffix has cap bytes or more.
    """
    before = np.full(len(data), -1, dtype=np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    i = np.sort(suffixes)
    p = before[i]
    on = np.append(False, (i[1:] == i[:-1] + 1) & (p[1:] == p[:-1] + 1) & (p[:-1] >= 0) & (data[i[:-1]] == data[p[:-1]]))
    start = np.flatnonzero(~on)
    first = np.repeat(start, np.diff(np.append(start, len(i))))
    h = np.zeros(len(i), dtype=np.int64)
    known = start[p[start] >= 0]
    h[known] = common_prefix(words, i[known], p[known], cap)
    # where a chain's prefix ends: before the first byte seen to differ
    ends = np.where(h[first] < cap, i[first] + h[first], np.iinfo(np.int64).max)
    odd = np.flatnonzero(on & (data[i + cap - 1] != data[p + cap - 1]))
    np.minimum.at(ends, first[odd], i[odd] + cap - 1)  # gathered at each chain's start
    h = np.where(p >= 0, np.minimum(cap, ends[first] - i), 0)
    out = np.zeros(len(data), dtype=np.int64)
    out[i] = h
    return out[suffixes]


def repeated_windows(data: np.ndarray, begin: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(window starts, group of each, number of grouped ones) for the windows of segments data[begin : begin + size].

    Windows of a group are equal; those that repeat come first.  Larsson-Sadakane refinement: rank is the first place
    of a suffix's group in the suffix order so far.  Only ranks of suffixes with enough bytes left in their segment
    are asked for, so no end marks are needed.  Kasai's common prefixes of the suffix array tell the groups.
    """
    room = np.repeat(begin + size, size) - np.arange(len(data))  # bytes from each place to its segment's end
    active = np.flatnonzero(room >= 8)
    key = eights(data, True)[active]
    order = np.argsort(key, kind="stable")
    active, key = active[order], key[order]
    rank = np.zeros(len(data), dtype=np.int64)
    first, count = _runs(key)
    rank[active] = np.repeat(first, count)
    unique = np.repeat(count, count) == 1
    singles = [active[unique & (room[active] >= length)]]
    active, depth = active[~unique], 8
    while depth < length:
        step = depth if 2 * depth <= length else length - depth
        active = active[room[active] >= depth + step]
        if not len(active):
            break
        old = rank[active]
        key = (old.astype(np.uint64) << np.uint64(32)) | rank[active + step].astype(np.uint64)
        order = np.argsort(key, kind="stable")
        active, key, old = active[order], key[order], old[order]
        depth += step
        if depth == length:
            break
        first, count = _runs(key)
        group, members = _runs(old)
        start = np.repeat(first, count) - np.repeat(group, members)
        rank[active] = old + start
        unique = np.repeat(count, count) == 1
        singles.append(active[unique & (room[active] >= length)])
        active = active[~unique]
    same = kasai(data, eights(data), active, length) >= length if len(active) else np.zeros(0, bool)
    group, twice = np.cumsum(~same), same | np.append(same[1:], False)[: len(same)]
    lone = np.concatenate([*singles, active[~twice]])
    # a number of its own for each lone window, after the groups'
    return np.concatenate([active[twice], lone]), np.concatenate([group[twice], len(data) + np.arange(len(lone))]), int(twice.sum())


def suspects(reps: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """Packed (class, anchor) rows, and in bucket -1 anchors that are frequent in a slice (owner = their count)."""

    def work(batches):
        from .tokenfiles import slices

        for big in batches:
            for batch in slices(big, 1):
                ids = np.asarray(batch.column(0))
                owner, value, many = [], [], []
                for i, data in texts_of(batch, 1, length):
                    v, twice = anchors_of(data, length)
                    owner.append(np.full(len(v), ids[i]))
                    value.append(v)
                    many.append(twice)
                if not owner:
                    continue
                owner, value, many = np.concatenate(owner), np.concatenate(value), np.concatenate(many)
                yield owner, value, many

    def deal(batches):
        for owner, value, many in work(batches):
            bucket = (value >> np.uint64(20)).astype(np.int64) & ((1 << 40) - 1)
            yield _packed(bucket % n_buckets, owner, value, many.astype(np.uint8))
            v, c = np.unique(value, return_counts=True)
            often = c >= max(SLICE_LEAST, SLICE_SHARE * len(np.unique(owner)))
            if often.any():
                yield _packed(np.full(int(often.sum()), -1), c[often].astype(np.int64), v[often], np.zeros(int(often.sum()), np.uint8))

    return reps.select("class", "text").mapInArrow(deal, PACKED)


def common_anchors(dealt: DataFrame, least: float) -> np.ndarray:
    """Sorted anchors that the slices in which they are frequent hold in at least `least` texts: a bounded list."""

    def count(key, tab):
        import pyarrow as pa

        owner, value, _ = _unpacked(tab)
        return pa.table({"anchor": value.view(np.int64), "n": owner})

    rows = dealt.where("bucket = -1").withColumn("part", F.monotonically_increasing_id()).groupBy("part").applyInArrow(lambda key, tab: count(key, tab), "anchor long, n long")
    found = rows.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("anchor").collect()
    return np.sort(np.array([r.anchor for r in found], dtype=np.int64).view(np.uint64))


def is_in(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def repeated_anchors(dealt: DataFrame, common, n_packs: int) -> DataFrame:
    """(class, anchors): those of each class's anchors, common ones apart, that stand at two places or more."""

    def drop(batches):
        import pyarrow as pa

        for batch in batches:
            tab = pa.Table.from_batches([batch])
            for i in range(len(tab)):
                owner, value, many = _unpacked(tab.slice(i, 1))
                keep = ~is_in(value, common.value)
                if keep.any():
                    yield _packed(np.full(int(keep.sum()), tab.column("bucket")[i].as_py()), owner[keep], value[keep], many[keep])

    def count(key, tab):
        import pyarrow as pa

        owner, value, many = _unpacked(tab)
        order = np.argsort(value, kind="stable")
        owner, value, many = owner[order], value[order], many[order]
        first, n = _runs(value)
        keep = np.repeat((n > 1) | (np.maximum.reduceat(many, first) > 0), n) if len(first) else np.zeros(0, bool)
        owner, value = owner[keep], value[keep]
        order = np.argsort(owner, kind="stable")
        owner, value = owner[order], value[order]
        return pa.Table.from_batches([_packed((mix(owner.astype(np.uint64)) % np.uint64(n_packs)).astype(np.int64), owner, value, np.zeros(len(owner), np.uint8))])

    def gather(key, tab):
        import pyarrow as pa

        owner, value, _ = _unpacked(tab)
        order = np.argsort(owner, kind="stable")
        owner, value = owner[order], value[order]
        first, n = _runs(owner)
        return pa.table({"class": owner[first] if len(first) else owner, "anchors": pa.array([np.sort(value[a : a + c]).tobytes() for a, c in zip(first, n)], pa.binary())})

    counted = dealt.where("bucket >= 0").mapInArrow(drop, PACKED).groupBy("bucket").applyInArrow(lambda key, tab: count(key, tab), PACKED)
    return counted.groupBy("bucket").applyInArrow(lambda key, tab: gather(key, tab), "class long, anchors binary")


def segments(texts: DataFrame, common, n_fine: int, length: int) -> DataFrame:
    """The windows with repeated anchors, cut out of (class, text, anchors) as segments and dealt to shards."""

    def cut(batches):
        import pyarrow as pa

        from .tokenfiles import slices

        for big in batches:
            for batch in slices(big, 1):
                ids, anchors, rows = np.asarray(batch.column(0)), batch.column(2), {}
                for i, data in texts_of(batch, 1, length):
                    own = np.frombuffer(anchors[i].as_py() or b"", dtype=np.uint64)
                    for start, m, _ in pieces(data, length):
                        first, n = _runs(m)
                        value = m[first]
                        hot = is_in(value, common.value)
                        take = hot | is_in(value, own)
                        for a, c, v, h in zip((start + first[take]).tolist(), n[take].tolist(), value[take].tolist(), hot[take].tolist()):
                            shard = (int(mix(ids[i : i + 1].astype(np.uint64))[0]) if h else v) % n_fine
                            rows.setdefault((shard, h), {}).setdefault(data[a : a + c - 1 + length].tobytes(), []).append((ids[i], a))
                out = [[] for _ in range(7)]
                for (shard, h), found in rows.items():
                    # equal segments of a slice are sent once, with all their places
                    pairs = np.array([p for at in found.values() for p in at], dtype=np.int64).reshape(-1, 2)
                    sizes = np.array([(len(s), len(at)) for s, at in found.items()], dtype=np.int64)
                    body = b"".join(found)
                    for column, x in zip(out, (shard, h, len(body), pairs[:, 0].tobytes(), pairs[:, 1].tobytes(), sizes.tobytes(), body)):
                        column.append(x)
                if out[0]:
                    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["shard", "spread", "n_bytes", "owners", "places", "sizes", "bytes"])

    return texts.select("class", "text", "anchors").mapInArrow(cut, SEGMENTS)


def _shard(tab) -> tuple:
    """Distinct segments of a shard with the (class, place) pairs of each."""
    seen: dict[bytes, list] = {}
    for own, at, sizes, body in zip(*(tab.column(c) for c in ("owners", "places", "sizes", "bytes"))):
        own, at = np.frombuffer(own.as_buffer(), np.int64), np.frombuffer(at.as_buffer(), np.int64)
        body, a, p = body.as_py(), 0, 0
        for size, n in np.frombuffer(sizes.as_buffer(), np.int64).reshape(-1, 2).tolist():
            seen.setdefault(body[a : a + size], []).append((own[p : p + n], at[p : p + n]))
            a, p = a + size, p + n
    data = np.frombuffer(b"".join(seen), dtype=np.uint8)
    size = np.fromiter(map(len, seen), dtype=np.int64, count=len(seen))
    places = [(np.concatenate([x for x, _ in v]), np.concatenate([y for _, y in v])) for v in seen.values()]
    return data, np.cumsum(size) - size, size, places


def spans_of(tab, length: int, fingerprints: bool):
    """(spans of windows that repeat within the shard, [fingerprints of the shard's distinct windows])."""
    data, begin, size, places = _shard(tab)
    window, group, n_grouped = repeated_windows(data, begin, size, length)
    segment = np.searchsorted(begin, window, side="right") - 1
    copies = np.fromiter((len(o) for o, _ in places), dtype=np.int64, count=len(places))
    twice = (np.arange(len(window)) < n_grouped) | (copies[segment] > 1)
    prints = None
    if fingerprints:
        one = np.unique(group, return_index=True)[1]
        at = window[one]
        g = eights(data)
        a, b = np.zeros(len(at), np.uint64), np.full(len(at), 7, np.uint64)
        for k in range(0, length - 7, 8):
            a = mix(a * _C[0] + g[at + k])
            b = mix((b ^ g[at + k]) * _C[1] + _C[2])
        if length % 8:
            a, b = mix(a * _C[0] + g[at + length - 8]), mix((b ^ g[at + length - 8]) * _C[1] + _C[2])
        seg = segment[one]
        # of each distinct window, all places: those of its segments
        prints = (group, window, segment, one, a, b, seg, twice)
    return data, begin, places, window, segment, twice, prints


def _as_spans(segment, offset, places):
    """Runs of window starts in each segment, at each of the segment's places: (class, first start, last start)."""
    order = np.lexsort((offset, segment))
    segment, offset = segment[order], offset[order]
    new = np.flatnonzero(np.append(True, (segment[1:] != segment[:-1]) | (offset[1:] != offset[:-1] + 1))) if len(segment) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(segment)) - 1
    out = [[], [], []]
    for s, a, b in zip(segment[new], offset[new], offset[last] if len(segment) else []):
        own, at = places[s]
        out[0].append(own)
        out[1].append(at + a)
        out[2].append(at + b)
    return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]


def repeated_spans(cut: DataFrame, wide_bytes: int, length: int) -> DataFrame:
    """(class, first, last): runs of starts of windows that stand elsewhere too; wide_bytes: of the segments that are spread."""
    parts = max(1, math.ceil(wide_bytes / PART))
    plain, spread = cut.where("not spread"), cut.where("spread")

    def within(key, tab):
        import pyarrow as pa

        data, begin, places, window, segment, twice, _ = spans_of(tab, length, False)
        rows = _as_spans(segment[twice], (window - begin[segment])[twice], places)
        return pa.table(dict(zip(("class", "first", "last"), rows)))

    def prints(key, tab):
        """Each place of each distinct window as (a, b) fingerprints, packed by part; part -1 has the spans found."""
        import pyarrow as pa

        data, begin, places, window, segment, twice, p = spans_of(tab, length, True)
        group, _, _, one, a, b, _, _ = p
        at = np.searchsorted(group[one], group)
        offset = window - begin[segment]
        # a window that repeats here goes on once, to tell the other shards; one that does not, with its places
        head = np.zeros(len(window), dtype=bool)
        head[one] = True
        w = np.flatnonzero(head | ~twice)
        own, first = (np.array([places[s][k][0] for s in segment[w]], dtype=np.int64) for k in (0, 1))
        part = (a[at[w]] % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        sent = [x[order] for x in (own, first + offset[w], a[at[w]].view(np.int64), b[at[w]].view(np.int64), twice[w].astype(np.int64))]
        cuts, n = _runs(part[order])
        rows = [(-1, *(x.tobytes() for x in _as_spans(segment[twice], offset[twice], places)), b"", b"")]
        rows += [(int(part[order][i]), *(x[i : i + c].tobytes() for x in sent)) for i, c in zip(cuts, n)]
        kinds = (pa.int64(), *[pa.binary()] * 5)
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "c0", "c1", "c2", "c3", "c4"])

    def columns(tab, n):
        return [np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in tab.column(f"c{k}")]) for k in range(n)]

    def merge(key, tab):
        """Binary search of every fingerprint in the sorted run of all: one that stands twice is in two shards."""
        import pyarrow as pa

        if key[0].as_py() < 0:
            return pa.table(dict(zip(("class", "first", "last"), columns(tab, 3))))
        own, first, a, b, known = columns(tab, 5)
        order = np.lexsort((b, a))
        sa, sb = a[order], b[order]
        low, high = np.searchsorted(sa, sa, side="left"), np.searchsorted(sa, sa, side="right")
        # equal first halves are told apart by the second, in order too
        near = np.append(False, (sa[1:] == sa[:-1]) & (sb[1:] == sb[:-1]))
        near[:-1] |= near[1:].copy()
        at = order[(high - low > 1) & near]
        at = at[known[at] == 0]
        return pa.table({"class": own[at], "first": first[at], "last": first[at]})

    found = plain.groupBy("shard").applyInArrow(lambda key, tab: within(key, tab), SPANS)
    if not wide_bytes:
        return found
    runs = staged(spread.groupBy("shard").applyInArrow(lambda key, tab: prints(key, tab), "part long, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary"), "prints")
    # a fingerprint stands once a shard at most, so a part holds at most as many rows of one as there are shards;
    # the shards' own spans, which have no part, are dealt to as many tasks
    dealt = runs.withColumn("salt", F.when(F.col("part") < 0, F.pmod(F.xxhash64("c0", "c1"), F.lit(parts))).otherwise(F.lit(0)))
    return found.unionAll(dealt.groupBy("part", "salt").applyInArrow(lambda key, tab: merge(key, tab), SPANS))


def dealt_evenly(cut: DataFrame) -> tuple[DataFrame, int]:
    """(segments with their final shards of about SHARD bytes, bytes of those that are spread).

    A fine shard of more than twice that (one anchor that very many texts hold, though not enough to be common) is
    spread like the common anchors: its rows go to any shard, and fingerprints are merged across shards.
    """
    heavy = cut.where("not spread").groupBy("shard").agg(F.sum("n_bytes").alias("b")).where(F.col("b") > 2 * SHARD)
    heavy = small_side(staged(heavy.select(F.col("shard").alias("_heavy")), "heavy"))
    cut = cut.join(heavy, F.col("shard") == F.col("_heavy"), "left").withColumn("spread", F.col("spread") | F.col("_heavy").isNotNull()).drop("_heavy")
    size = {r.spread: r.b for r in cut.groupBy("spread").agg(F.sum("n_bytes").alias("b")).collect()}
    plain, wide = (max(1, math.ceil(size.get(k, 0) / SHARD)) for k in (False, True))
    return cut.withColumn("shard", F.when(F.col("spread"), F.pmod(F.xxhash64("owners", "places"), F.lit(wide))).otherwise(F.col("shard") % plain)), size.get(True, 0)


def cut_texts(reps: DataFrame, length: int) -> DataFrame:
    """(class, spans, kept) of the texts (class, text, n) that lose bytes; kept is the SHA-256 of what is left."""
    size = reps.agg(F.sum("n").alias("bytes"), F.count(F.lit(1)).alias("texts")).first()
    total = size.bytes or 0
    dealt = staged(suspects(reps, length, max(1, math.ceil(total / 150 / BUCKET))), "anchors")
    common = reps.sparkSession.sparkContext.broadcast(common_anchors(dealt, max(4 * SLICE_LEAST, COMMON * size.texts)))
    anchors = staged(repeated_anchors(dealt, common, max(1, math.ceil(total / 150 / BUCKET))), "repeated").withColumnRenamed("class", "class_")
    joined = reps.join(anchors, F.col("class") == F.col("class_"), "left" if len(common.value) else "inner").select("class", "text", "anchors")
    cut = staged(segments(joined, common, max(1, math.ceil(total / 1_000_000)), length), "segments")
    spans = repeated_spans(*dealt_evenly(cut), length)
    merged = spans.groupBy("class").agg(F.collect_list(F.struct("first", "last")).alias("runs"))  # of one text
    merged = staged(merged.withColumnRenamed("class", "class_"), "spans")

    def clean(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))
        for batch in batches:
            spans, kept = [], []
            for i, data in texts_of(batch, 1, length):
                runs = batch.column(2)[i].values
                first, last = np.asarray(runs.field("first")), np.asarray(runs.field("last")) + length
                order = np.argsort(first, kind="stable")
                first, last = first[order], np.maximum.accumulate(last[order])
                new = np.append(True, first[1:] > last[:-1])
                a, z = first[new], last[np.append(np.flatnonzero(new)[1:], len(first)) - 1]
                left = hashlib.sha256()
                for z0, a1 in zip([0, *z.tolist()], [*a.tolist(), len(data)]):
                    left.update(data[z0:a1].tobytes())
                kept.append(left.hexdigest())
                spans.append([{"a": x, "z": y} for x, y in zip(a.tolist(), z.tolist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(kept, pa.string())], names=["class", "spans", "kept"])

    held = reps.join(merged, F.col("class") == F.col("class_")).select("class", "text", "runs")
    return held.mapInArrow(clean, "class long, spans array<struct<a:bigint,z:bigint>>, kept string").dropDuplicates(["class"])


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans (array of first and end byte of each removed run), kept_sha256 and n_removed of every row."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63) + 1)).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("sha", F.sha2("text", 256))
    meta = staged(own.select("id", "doc_id", F.octet_length("text").cast("long").alias("n"), "sha"), "meta")
    classes = meta.where(F.col("n") >= length).groupBy("sha").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"))
    # numbered as they are written, and fixed from then on: no two texts share a number
    classes = staged(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    reps = own.select("id", "text", F.col("sha").alias("sha_")).join(classes.withColumnRenamed("rep", "rep_"), (F.col("sha_") == F.col("sha")) & (F.col("id") == F.col("rep_"))).select("class", "text", "n")
    cleaned = small_side(staged(cut_texts(reps, length).withColumnRenamed("class", "class_"), "cleaned"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("z")))
    result = meta.join(classes.select(F.col("sha").alias("sha_"), "class", "copies"), F.col("sha") == F.col("sha_"), "left")
    result = result.join(cleaned, F.col("class") == F.col("class_"), "left")
    copied = F.coalesce(F.col("copies") > 1, F.lit(False))
    spans = F.when(copied, whole).otherwise(F.coalesce("spans", F.array().cast("array<struct<a:bigint,z:bigint>>")))
    kept = F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha"))
    result = result.select("doc_id", F.col("n").alias("n_bytes"), spans.alias("spans"), kept.alias("kept_sha256"))
    return result.withColumn("n_removed", F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["z"] - s["a"]))


def query(spark, sf_dir):
    out = dedup(table(spark, sf_dir, "documents"))
    share = F.when(F.col("n_bytes") > 0, F.col("n_removed") / F.col("n_bytes")).otherwise(0.0)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", share.alias("removed_share"))
