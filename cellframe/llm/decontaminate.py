"""Benchmark decontamination: documents that hold a passage within a small edit distance of a benchmark item.

Texts are compared as UTF-8 bytes with A-Z lower-cased and every white-space byte read as a blank.  An item of n
bytes may differ in d = min(share * n, (n - q) // q) edits.

1. Places.  A passage within d edits shares at least n - q + 1 - q * d of the item's q-byte strings with it, on close
   diagonals.  Only item-sized windows on the diagonals of such strings are looked at; by that count none is lost.
2. CGK embedding.  A random walk reads a string of m bytes in 3 m steps; at each step a random bit of (step, byte)
   says whether it moves on.  Edits become differing places of the walks: edit distance turns into Hamming distance.
   Window and item are embedded in pieces of at most PIECE bytes, as the walks of long strings drift apart.
3. Bit sampling.  A window is a candidate if some piece agrees with the item's in all SAMPLED places of one of the
   repeated samplings.  Their number follows from `recall` and from the share of places that agree, measured on
   pieces with the edits allowed; an item has several pieces and diagonals, so that recall is a lower bound.
4. Every candidate is verified by its exact edit distance (bit-parallel, over the window and d bytes around it).

Items shorter than 2 * q bytes allow no edits and are searched exactly, as whole words: neither end may split a run of
letters, digits or bytes beyond ASCII.

Items are handed to tasks in blocks of at most `block` items and BLOCK_BYTES bytes, whatever their number; a worker
prepares a block once; documents are read once a block and never leave their task.

Defined cases: null and empty texts hold nothing; items that are null or blank are not found anywhere; equal items are
each reported; a passage that stands twice in a text is reported once, at its best and first place; rows are searched
one by one, whatever their doc_id; without_leaks keeps all columns, whatever their names.  Texts of any length are
searched whole; an empty table or benchmark gives an empty result, and takes nothing away.
"""

from __future__ import annotations

import functools
import math
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, table

Q = 12
SHARE = 0.08
BLOCK, BLOCK_BYTES = 20_000, 16_000_000
RECALL = 0.99
#: Bytes of a piece, random walks, places a sampling compares, window pieces embedded at once.
PIECE, WALKS, SAMPLED, ROWS = 48, 8, 6, 20_000
FOLD = bytes(range(256)).lower().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     "))
SCHEMA = "item_id long, distance int, byte_start long, byte_end long"
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
#: Bytes that stand in words.
_INNER = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def folded(text: str) -> bytes:
    return text.encode().translate(FOLD)


def edits_allowed(n: int, share: float = SHARE, q: int = Q) -> int:
    return max(0, min(int(share * n), (n - q) // q))


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit value of the 12 bytes from each place (zeros after the end): equal values, almost surely equal bytes."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(24, dtype=np.uint8)])
    eight = np.empty(n + 8, dtype=np.uint64)
    for o in range(8):
        own = eight[o::8]
        own[:] = padded[o : o + 8 * len(own)].view(np.uint64) if o + 8 * len(own) <= len(padded) else np.resize(np.append(padded[o : o + (len(padded) - o) // 8 * 8].view(np.uint64), np.uint64(0)), len(own))
    four = eight[8:] & np.uint64(0xFFFFFFFF)
    return (eight[:n] * _A) ^ (four * _B)


def edit_distance(item: bytes, text: bytes, anchored: bool = False) -> tuple[int, int]:
    """(least edit distance of item and a substring of text, end of the first such); anchored: of a prefix of text."""
    m = len(item)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ((ph << 1) | anchored) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


@functools.lru_cache(2)
def walks(length: int = PIECE) -> np.ndarray:
    """Fixed random bits [walk, step, byte] of the walks over strings of at most `length` bytes."""
    return np.random.default_rng(20240229).integers(0, 2, (WALKS, 3 * length, 257), dtype=np.uint8)


def embed(strings: np.ndarray, length: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """[row, step]: the byte that one walk reads at each step; rows of `strings` end with the mark 256."""
    n, steps = len(strings), bits.shape[0]
    row, at, out = np.arange(n), np.zeros(n, dtype=np.int64), np.empty((n, steps), dtype=np.uint16)
    for k in range(steps):
        c = strings[row, at]
        out[:, k] = c
        at = np.minimum(at + bits[k, c], length)
    return out


def _padded(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    length = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    out = np.full((len(parts), PIECE + 1), 256, dtype=np.uint16)
    mask = np.arange(PIECE + 1)[None, :] < length[:, None]
    out[mask] = np.frombuffer(b"".join(parts), dtype=np.uint8)
    return out, length


@functools.lru_cache(8)
def agreement(share: float = SHARE) -> float:
    """Share of places in which the walks of a piece and of its copy with share * PIECE edits agree, as measured.

    The mean over fixed random strings and edits, of its SAMPLED-th power: the chance that one sampling agrees.
    """
    r, pairs = np.random.default_rng(7), ([], [])
    for _ in range(400):
        x = r.integers(97, 123, PIECE).tolist()
        y = list(x)
        for _ in range(math.ceil(share * PIECE)):
            k, p = r.integers(0, 3), int(r.integers(0, len(y)))
            y[p : p + (k != 1)] = [] if k == 2 else [int(r.integers(97, 123))]
        pairs[0].append(bytes(x))
        pairs[1].append(bytes(y[:PIECE]))
    (a, n), (b, m) = map(_padded, pairs)
    same = np.concatenate([embed(a, n, w) == embed(b, m, w) for w in walks()])
    return float((same.mean(axis=1) ** SAMPLED).mean())


def repeats_for(recall: float, share: float = SHARE) -> int:
    """Samplings after which a piece with the edits allowed has agreed in one with probability `recall`."""
    return max(WALKS, math.ceil(math.log(1 - recall) / math.log(1 - agreement(share))))


@functools.lru_cache(8)
def samplings(repeats: int) -> tuple[np.ndarray, ...]:
    """For each walk, the places [sampling, SAMPLED] that its samplings compare."""
    r = np.random.default_rng(99)
    return tuple(r.integers(0, 3 * PIECE, (len(part), SAMPLED)) for part in np.array_split(np.arange(repeats), WALKS))


def collide(left: list[bytes], right: list[bytes], repeats: int) -> np.ndarray:
    """Whether the walks of two pieces agree in one of the samplings, pair by pair."""
    out = np.zeros(len(left), dtype=bool)
    for k in range(0, len(left), ROWS):
        (a, n), (b, m) = _padded(left[k : k + ROWS]), _padded(right[k : k + ROWS])
        own = np.all(a == b, axis=1)
        todo = np.flatnonzero(~own)  # equal pieces agree in every walk
        for bits, places in zip(walks(), samplings(repeats)):
            if not len(todo):
                break
            places = np.minimum(places, 3 * PIECE - 1)
            # short pieces end early: places are dealt over the steps that they take
            steps = 3 * np.maximum(n[todo], 1)
            same = embed(a[todo], n[todo], bits) == embed(b[todo], m[todo], bits)
            hit = np.zeros(len(todo), dtype=bool)
            for s in places:
                hit |= np.all(same[np.arange(len(todo))[:, None], s[None, :] * steps[:, None] // (3 * PIECE)], axis=1)
            own[todo[hit]] = True
            todo = todo[~hit]
        out[k : k + ROWS] = own
    return out


class Items:
    """One block of items, ready for search."""

    def __init__(self, rows: list[tuple[int, bytes]], share: float, q: int, recall: float = RECALL):
        self.repeats = repeats_for(recall, share)
        self.short: dict[int, list] = {}
        for i, b in rows:
            if len(b) < 2 * q and b.strip():
                self.short.setdefault(len(b), []).append((i, b))
        self.short = {n: self._values(found) for n, found in self.short.items()}
        rows = [r for r in rows if len(r[1]) >= 2 * q]
        self.id = [i for i, _ in rows]
        self.bytes = [b for _, b in rows]
        self.n = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.d = np.array([edits_allowed(len(b), share, q) for b in self.bytes], dtype=np.int64)
        self.least = np.maximum(1, self.n - q + 1 - q * self.d)
        values, item, at = [], [], []
        for k, b in enumerate(self.bytes):
            g = grams(np.frombuffer(b, dtype=np.uint8))[: len(b) - q + 1]
            values.append(g)
            item.append(np.full(len(g), k))
            at.append(np.arange(len(g)))
        values, item, at = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (values, item, at))
        order = np.argsort(values, kind="stable")
        values, self.item, self.at = values[order], item[order].astype(np.int64), at[order].astype(np.int64)
        self.keys, self.first, self.count = np.unique(values, return_index=True, return_counts=True)
        self.map = np.zeros(1 << 21, dtype=bool)
        self.map[(self.keys * _B) >> np.uint64(43)] = True

    @staticmethod
    def _values(found):
        by: dict[bytes, list[int]] = {}
        for i, b in found:
            by.setdefault(b, []).append(i)
        return by

    def search(self, data: np.ndarray, offs: np.ndarray, q: int) -> list[tuple]:
        """(document, item_id, distance, start, end) of the folded bytes of several documents."""
        return sorted([*self._short(data, offs), *self._long(data, offs, q)], key=lambda r: (r[0], str(r[1])))

    def _short(self, data, offs):
        if not self.short:
            return []
        inner, whole, out = _INNER[data], data.tobytes(), []
        cut = np.ones(len(data) + 1, dtype=bool)  # may a whole word begin or end before this byte?
        cut[1:-1] = ~(inner[1:] & inner[:-1])
        cut[offs] = True
        for n, by in self.short.items():
            for b, ids in by.items():
                last, at = -1, whole.find(b)
                while at >= 0:
                    doc = int(np.searchsorted(offs, at, side="right")) - 1
                    if doc != last and at + n <= offs[doc + 1] and cut[at] and cut[at + n]:
                        out += [(doc, i, 0, int(at - offs[doc]), int(at - offs[doc]) + n) for i in ids]
                        last = doc
                    at = whole.find(b, at + 1)
        return out

    def _long(self, data, offs, q):
        if not len(self.keys):
            return []
        g = grams(data)
        at = np.flatnonzero(self.map[(g * _B) >> np.uint64(43)])
        found = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        hit = self.keys[found] == g[at]
        at, found = at[hit], found[hit]
        doc = np.searchsorted(offs, at, side="right") - 1
        inside = at + q <= offs[doc + 1]
        at, found, doc = at[inside], found[inside], doc[inside]
        many = self.count[found]
        if not many.sum():
            return []
        step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        row = np.repeat(self.first[found], many) + step
        item, diagonal, doc = self.item[row], np.repeat(at - offs[doc], many) - self.at[row], np.repeat(doc, many)
        # two sets of bins, half a bin apart: any 2 d + 1 neighbouring diagonals share one
        width = 4 * (self.d[item] + 1)
        low = diagonal + self.n[item] + 4 * width
        bins = np.concatenate([low // width * 2, (low + width // 2) // width * 2 + 1])
        both = lambda x: np.concatenate([x, x])
        key = np.stack([both(doc), both(item), bins])
        diagonal = both(diagonal)
        order = np.lexsort((diagonal, key[2], key[1], key[0]))
        key, diagonal = key[:, order], diagonal[order]
        new = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
        size = np.diff(np.append(new, key.shape[1]))
        ok = size >= self.least[key[1, new]]
        if not ok.any():
            return []
        # each distinct diagonal of a group that is dense enough gives one window
        group = np.repeat(np.arange(len(new)), size)
        take = ok[group] & np.append(True, (group[1:] != group[:-1]) | (diagonal[1:] != diagonal[:-1]))
        lowest, highest = np.minimum.reduceat(diagonal, new), np.maximum.reduceat(diagonal, new)
        group, diagonal = group[take], diagonal[take]
        good = self._candidates(data, offs, key[0, new[group]], key[1, new[group]], diagonal)
        chosen = np.unique(group[good])
        # the two sets of bins often propose the same window
        doc, item, lowest, highest = np.unique(np.stack([key[0, new[chosen]], key[1, new[chosen]], lowest[chosen], highest[chosen]]), axis=1)
        begin = offs[doc]
        best = {}
        for k in range(len(doc)):
            d, i = int(self.d[item[k]]), int(item[k])
            a = max(begin[k], begin[k] + lowest[k] - d)
            e = min(offs[doc[k] + 1], begin[k] + highest[k] + self.n[i] + d)
            text = data[a:e].tobytes()
            distance, end = edit_distance(self.bytes[i], text)
            if distance <= d:
                back = edit_distance(self.bytes[i][::-1], text[:end][::-1], True)[1]
                row = (distance, int(a - begin[k]) + end - back, int(a - begin[k]) + end)
                best[doc[k], i] = min(best.get((doc[k], i), row), row)
        return [(int(doc), self.id[i], *row) for (doc, i), row in best.items()]

    def _candidates(self, data, offs, doc, item, diagonal) -> np.ndarray:
        """Whether the item-sized window on a diagonal agrees with its item in a sampling of some piece."""
        # every distinct window once
        own, back = np.unique(np.stack([doc, item, diagonal]), axis=1, return_inverse=True)
        pieces = -(-self.n[own[1]] // PIECE)
        left, right, of = [], [], np.repeat(np.arange(own.shape[1]), pieces)
        for (d, i, g), k in zip(own.T.tolist(), pieces.tolist()):
            whole, n, begin, end = self.bytes[i], int(self.n[i]), int(offs[d]), int(offs[d + 1])
            for p in range(k):
                a, z = p * n // k, (p + 1) * n // k
                left.append(whole[a:z])
                right.append(data[min(max(begin, begin + g + a), end) : min(max(begin, begin + g + z), end)].tobytes())
        out = np.zeros(own.shape[1], dtype=bool)
        out[of[collide(left, right, self.repeats)]] = True
        return out[np.ravel(back)]


_READY: dict[str, Items] = {}


def _blocks(benchmark: DataFrame, block: int):
    """Lists of (item_id, folded text), each within the bounds of a block; at least one item a list."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text")
    part, size = [], 0
    for r in items.toLocalIterator():
        b = folded(r[1])
        if part and (len(part) >= block or size + len(b) > BLOCK_BYTES):
            yield part
            part, size = [], 0
        part.append((r[0], b))
        size += len(b)
    if part:
        yield part


def _found(batches, column: int, name: str, handed, share: float, recall: float):
    """(slice of a batch, what is found in it) of all batches."""
    from .textnum import doc_bytes
    from .tokenfiles import slices

    if name not in _READY:  # once a worker and block
        _READY.clear()
        _READY[name] = Items(handed.value, share, Q, recall)
    ready = _READY[name]
    for big in batches:
        for batch in slices(big, column):
            data, offs, _ = doc_bytes(batch.column(column))
            data = np.frombuffer(data[offs[0] : offs[-1]].tobytes().translate(FOLD), dtype=np.uint8)
            yield batch, ready.search(data, offs - offs[0], Q) if len(data) else []
    give_back()


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, share: float = SHARE, block: int = BLOCK, key: str = "doc_id", text: str = "text", recall: float = RECALL
) -> DataFrame:
    """One row per document and item found in it: key, item_id, distance, byte_start, byte_end (of the UTF-8 text)."""
    kind, spark = dict(docs.dtypes)[key], docs.sparkSession
    schema, out = f"`{key}` {kind}, {SCHEMA}", None
    for part in _blocks(benchmark, block):
        handed, name = spark.sparkContext.broadcast(part), uuid.uuid4().hex

        def search(batches, handed=handed, name=name):
            import pyarrow as pa

            for batch, found in _found(batches, 1, name, handed, share, recall):
                if found:
                    who, item, distance, start, end = zip(*found)
                    columns = [pa.array(item, pa.int64()), pa.array(distance, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), *columns], names=[key, "item_id", "distance", "byte_start", "byte_end"])

        one = docs.select(key, text).mapInArrow(search, schema)
        out = one if out is None else out.unionAll(one)
    return out if out is not None else spark.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, block: int = BLOCK, text: str = "text", recall: float = RECALL) -> DataFrame:
    """The rows of docs in whose own text no item is found: each row is judged by itself, without a join or shuffle."""
    at, schema = docs.columns.index(text), docs.schema
    for part in _blocks(benchmark, block):
        handed, name = docs.sparkSession.sparkContext.broadcast(part), uuid.uuid4().hex

        def keep(batches, handed=handed, name=name):
            import pyarrow as pa

            for batch, found in _found(batches, at, name, handed, share, recall):
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[r[0] for r in found]] = False
                yield batch if clean.all() else batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, schema)
    return docs


def query(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
