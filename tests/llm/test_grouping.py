"""Embedding near duplicates, conversation tries and spelling variants against brute force, SQL and cases of odd rows."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from cellframe.llm import embedjoin, prefixtrie, spelling

VECTORS = "vec_id long, embedding array<double>, label string, n_links long, LABEL2 int"
TURNS = "conv_id long, turn long, role string, text string, depth int"


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# ---- op11 -----------------------------------------------------------------------------------------------------------
def brute_links(rows, least=0.98):
    ok = lambda v, label: label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = [[x / max(map(abs, v)) for x in v] if ok(v, label) else None for _, v, label, *_ in rows]
    links = []
    for i, a in enumerate(unit):
        for j in range(i):
            b = unit[j]
            if a and b and rows[i][2] == rows[j][2] and len(a) == len(b):
                if math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(x * x for x in b)) >= least:
                    links.append((j, i))
    degree = Counter(k for pair in links for k in pair)
    root = components(len(rows), links)
    least_id = {}
    for k, r in enumerate(root):
        if rows[k][0] is not None:
            least_id[r] = min(least_id.get(r, rows[k][0]), rows[k][0])
    return sorted(((rows[k][0], degree[k], least_id.get(root[k]), rows[k][0] == least_id.get(root[k])) for k in range(len(rows))), key=repr)


def clouds(r, size):
    """Groups of near copies, chains of links, exact and scaled copies, lone vectors."""
    out = []
    for _ in range(size):
        centre = r.normal(size=12)
        kind = r.integers(4)
        for k in range(int(r.integers(1, 12))):
            if kind == 0:
                v = centre + r.normal(size=12) * 0.12
            elif kind == 1:  # neighbours link, ends do not
                v = centre + k * 0.15 * np.eye(12)[0] * np.linalg.norm(centre)
            elif kind == 2:
                v = centre * 2.0 ** r.integers(-3, 4)
            else:
                v = r.normal(size=12)
            out.append([float(x) for x in v])
    return out


@pytest.mark.parametrize("block", [1 << 12, 1 << 20])
def test_links_equal_brute_force_over_many_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(embedjoin, "BLOCK_BYTES", block)  # 64 vectors a block, or all of a label
    monkeypatch.setattr(embedjoin, "FAN", 2)
    r = np.random.default_rng(3)
    rows = [(i, v, "ab"[i % 7 == 0], None, 1) for i, v in enumerate(clouds(r, 120))]
    got = embedjoin.links_of(spark.createDataFrame(rows, VECTORS).repartition(5))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_links(rows)


def test_links_of_odd_vectors(spark):
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01]
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 3.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [1.0, 2.0], [1e300, 2e300, 3e300], [1e-300, 2e-300, 3e-300], [-1.0, -2.0, -3.0], [-0.0, 1.0, 0.0], [0.0, 1.0, -0.0]]
    rows = [(k + 10, v, "x", None, None) for k, v in enumerate([a, b, *odd, a])] + [(1, a, None, None, None), (2, a, "y", None, None), (11, b, "x", 4, 4), (None, a, "x", None, None), (None, [5.0, 1.0, 1.0], "x", None, None)]
    got = embedjoin.links_of(spark.createDataFrame(rows, VECTORS))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_links(rows)
    none = embedjoin.links_of(spark.createDataFrame([], VECTORS))
    assert none.columns == ["vec_id", "n_links", "component_id", "kept"] and none.count() == 0


def test_a_cosine_at_the_bound_links(spark):
    rows = [(0, [1.0, 0.0], "x", None, None), (1, [0.6, 0.8], "x", None, None), (2, [3.0, 4.0], "x", None, None), (3, [0.5999999999, 0.8], "x", None, None)]
    got = {x.vec_id: x.n_links for x in embedjoin.links_of(spark.createDataFrame(rows, VECTORS), 0.6).collect()}
    assert got == {0: 2, 1: 3, 2: 3, 3: 2}


def test_leaf_pairs_lose_no_link():
    r = np.random.default_rng(1)
    for n, m in ((500, 300), (64, 1), (130, 700)):
        u, v = (embedjoin.units(r.normal(size=(k, 5)) + 2) for k in (n, m))
        axes = {5: np.eye(5)[:, :3]}
        a, b = embedjoin.Leaves(u, axes), embedjoin.Leaves(v, axes)
        pairs = {tuple(p) for p in embedjoin.leaf_pairs(a, b, 0.05)}
        near = np.argwhere(np.linalg.norm(u[:, None] - v[None], axis=2) <= 0.05)
        assert {(i // embedjoin.LEAF, j // embedjoin.LEAF) for i, j in near} <= pairs


# ---- op12 -----------------------------------------------------------------------------------------------------------
def brute_trie(rows):
    """The nodes by the rules of rebuilding, from the definition."""
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - math.fmod(c, 20)
        rebuilt[c] = own.get(int(base), [])[:h] + turns[h:]
    nodes, ends = {}, {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    words = lambda t: len([w for w in t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w])
    children = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(members) - 1) * words(k[-1][1]) if k else 0
    out = []
    for k, members in nodes.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), children[k], leaves[k], saved[k], digest))
    return sorted(out, key=repr)


def talks(r, n, turns):
    """Conversations over few texts, so that they share openings of any length; ids with gaps."""
    texts = ["hi", "hello there", "a b  c\n", "", None, "é  x", "word " * 50]
    return [(c, t, r.choice(["user", "bot", None]) if r.random() < 0.1 else "user", r.choice(texts[:2]) if r.random() < 0.8 else r.choice(texts), 1) for c in r.sample(range(-40, 3 * n), n) for t in range(r.randrange(0, turns))]


@pytest.mark.parametrize("width,chain", [(2, 2), (8, 4096)])
def test_trie_equals_brute_force(spark, monkeypatch, width, chain):
    monkeypatch.setattr(prefixtrie, "WIDTH", width)  # columns of a block
    monkeypatch.setattr(prefixtrie, "CHAIN", chain)  # blocks of a window
    monkeypatch.setattr(prefixtrie, "PIECE", 3)
    r = random.Random(width)
    rows = talks(r, 60, 14) + [(500, t, "user", "hi", 1) for t in range(45)] + [(520, t, "user", "hi", 1) for t in range(45)]
    rows += [(7, None, "z", "null turn", 1), (7, None, "a", "null turn", 1), (7, 0, "tied", "b", 1), (7, 0, "tied", "a", 1), (7, 0, "tied", "a", 1), (None, 1, "user", "no conversation", 1)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    got = prefixtrie.trie(*prefixtrie.rebuilt(prefixtrie.turns_of(df)))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rows)


def test_trie_of_turnless_and_no_conversations(spark):
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    got = prefixtrie.trie(*prefixtrie.rebuilt(prefixtrie.turns_of(spark.createDataFrame([(lone, 0, "u", "x", 0)], TURNS)))).collect()
    assert [tuple(x) for x in got] == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert prefixtrie.trie(*prefixtrie.rebuilt(prefixtrie.turns_of(spark.createDataFrame([], TURNS)))).count() == 0


# ---- op13 -----------------------------------------------------------------------------------------------------------
def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(count):
    near = {w: [v for v in count if v != w and abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in count}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best and count[best] >= 10 * count[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, form[w], root(w), n, len(near[w]), count[form[w]] if form[w] else None) for w, n in count.items()), key=repr)


def vocabulary(r, n):
    """Words of few letters with their edits, some far more frequent, so that lists are long and forms chain."""
    out = {}
    for _ in range(n):
        w = "".join(r.choice(["ab", "ba", "c", "ñé", "abab"]) for _ in range(r.randrange(4, 12)))
        if len(w) < 7:
            continue
        out[w] = r.choice([2, 3, 30, 400, 5000])
        for _ in range(4):
            i, kind = r.randrange(len(w)), r.randrange(3)
            v = w[:i] + r.choice("abcxé") * (kind != 0) + w[i + (kind != 1) :]
            if len(v) >= 7:
                out.setdefault(v, r.choice([2, 20]))
    return out


@pytest.mark.parametrize("long_list,hot,few", [(512, 20_000, 32), (4, 20_000, 5), (512, 3, 2), (2, 40, 10_000)])
def test_variants_equal_brute_force(spark, monkeypatch, long_list, hot, few):
    for name, value in (("LONG_LIST", long_list), ("HOT", hot), ("FEW", few), ("BUCKET", 500), ("CELLS", 5000)):
        monkeypatch.setattr(spelling, name, value)
    count = vocabulary(random.Random(few), 150)
    count |= {"a" * 3000: 2, "a" * 2999: 40, "a" * 2999 + "b": 2, "abcdefg": 1000, "abcdefgh": 100, "abcdefghi": 10, "abcdefghij": 2, "zebrafinch": 2}
    words = spark.createDataFrame(list(count.items()), "word string, n long").repartition(3)
    assert sorted(map(tuple, spelling.variants(words).collect()), key=repr) == brute_variants(count)


def test_decomposition_bounds_hold_for_every_edit():
    """The grams that an edit leaves in both decompositions are as many as the bound says, at the places it says."""
    r = random.Random(2)
    for _ in range(150):
        w = "".join(r.choice("aab") for _ in range(r.randrange(7, 15)))
        length = len(w)
        levels = {g: spelling.gram_hashes(np.frombuffer(("ab" * 9 + "aabaab").encode("utf-32-le"), np.uint32).reshape(1, -1), g)[g].ravel() for g in range(2, 7)}
        levels = {g: (np.unique(h)[:: r.choice([1, 2])], np.ones(len(np.unique(h)), np.int64)) for g, h in levels.items()}

        def grams(word, q):
            kept, letters, h, _, bound = spelling.decompose(np.frombuffer(word.encode("utf-32-le"), np.uint32).reshape(1, -1), q, levels)
            return {(p, word[p : p + letters[0, p]]) for p in np.flatnonzero(kept[0])}, int(bound[0])

        for kind, at in [(k, i) for k in range(3) for i in range(length + (k == 1))]:
            v = w[:at] + "b" * (kind != 0) + w[at + (kind != 1) :]
            short = min(len(v), length)
            if v == w or short < 7:
                continue
            (one, bound), (two, _) = grams(w, spelling.longest_gram(short)), grams(v, spelling.longest_gram(short))
            move = len(v) - length
            left = [(p, g) for p, g in one if ((p, g) in two and p + len(g) <= at) or ((p + move, g) in two and p >= at)]
            assert len(one) > bound and len(left) >= len(one) - bound


def test_counting_equals_sql_rules(spark):
    import re

    docs = [(k, t, None) for k, t in enumerate(["Abcdefgh abcdefgh ABCDEFGH", "ÀBCDEFGH àbcdefgh", "short xx12345678", None, "", "qqqqqqqq " * 200])] + [(None, "abcdefgh nodocid", "x"), (3, "abcdefgh", "y"), (3, "abcdefgh", "y")]
    want = Counter()
    for i, t, _ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            want[run] += len(run) >= 7
    got = spelling.counted(spark.createDataFrame(docs, "doc_id long, text string, word string"))
    assert {x.word: x.n for x in got.collect()} == {w: n for w, n in want.items() if n >= 2}
    assert spelling.variants(spelling.counted(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


@pytest.mark.parametrize("module", [embedjoin, prefixtrie, spelling], ids=lambda m: m.__name__.rsplit(".", 1)[1])
def test_queries_equal_their_sql(spark, sf_dir, module):
    con = duckdb.connect()
    for n in os.listdir(sf_dir):
        p = f"{sf_dir}/{n}"
        con.execute(f"create view {n.split('.')[0]} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    got = module.query(spark, sf_dir)
    want = con.execute(module.SQL)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)
