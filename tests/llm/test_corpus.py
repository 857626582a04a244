"""The corpus operators against brute force, on small tables and on odd rows."""

import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellframe.llm import common, decontaminate, html, jaccard, langid, mixing, quality, registry, suffixdedup, tokenfiles, tokens, urls

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PER_DOCUMENT = ("op3_quality_rules", "op4_token_files", "op5_suffix_array_dedup", "op6_mixing", "op8_ngram_jaccard", "op9_language_id")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_odd_rows_and_empty_tables(spark, edge_dir, empty_dir, edge_rows, name):
    query = registry.queries()[name]
    got = query(spark, edge_dir).collect()
    assert query(spark, empty_dir).count() == 0
    if name in PER_DOCUMENT:
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in edge_rows[0])
    if name == "op10_decontamination":
        assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in (11, 12) for i in (0, 3)} | {(9, None)}
    if name in ("op1_url_filters", "op7_html_extraction"):
        assert len(got) == 7


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
@pytest.mark.parametrize("which", ["sf", "edge"])
def test_sql(spark, sf_dir, edge_dir, name, which):
    d = sf_dir if which == "sf" else edge_dir
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark", "embeddings", "conversations"):
        p = f"{d}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    got, want = registry.queries()[name](spark, d).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    c = sorted(got.columns)
    assert c == sorted(want.columns) and len(got) == len(want)
    text = lambda df: sorted(repr([None if x != x else float(x) if isinstance(x, (int, float, np.number)) else x for x in r]) for r in df[c].astype(object).where(df[c].notna(), None).values.tolist())
    assert text(got) == text(want)


# ---- op1 ----------------------------------------------------------------------------------------------------------
def test_url_rules_and_templates(spark):
    rows = [(i, f"http://a.com/x/{i}") for i in range(40)] + [(100 + i, f"http://a.com/good/{100 + i}") for i in range(40)]
    rows += [(200, "HTTP://Sub.Example.COM/de/q"), (201, "http://example.net/en/1"), (202, "http://x.net/en/1"), (203, "http://net"), (204, "x://y.org/fr/")]
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)], "url_key long, bad int")
    got = {r.page_id: r for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()}
    assert all(got[i].verdict == "block" and got[i].template == "/x/*" for i in range(40))
    assert all(got[100 + i].verdict == "allow" for i in range(40))
    assert [(got[i].rule, got[i].verdict) for i in range(200, 205)] == [("example.com/de/", "block"), ("example.net/en/", "allow"), ("net/", "block"), (None, "allow"), ("org/fr/", "allow")]
    assert got[200].host == "sub.example.com"


def test_url_tree_goes_as_deep_as_labels_are_mixed(spark):
    rows = [(i, f"http://a.com/2024/05/11/{'casino' if i % 2 else 'news'}/x{i % 7}/{i}") for i in range(400)] + [(1000 + i, f"http://b.com/1/2/3/4/5/6/{1000 + i}") for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "url_key long, bad int")
    got = {r.page_id: r for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()}
    assert all(got[i].verdict == ("block" if i % 2 else "allow") for i in range(400))
    assert got[1].template == "/*/*/*/casino/**" and got[1000].template == "/*/*/*/**"


def test_url_siblings_merge_only_if_labels_and_shapes_agree(spark):
    sections = {"a": "a/1", "b": "b/2", "few": "few/3", "long": "long/x/y/4", "bad": "bad/5"}
    rows = [(1000 * k + i, f"http://h.org/{p[:-1]}{1000 * k + i}") for k, p in enumerate(sections.values()) for i in range(4 if "few" in p else 200)]
    labels = spark.createDataFrame([(i, int(i // 1000 == 4 or i % 10 == 0)) for i, _ in rows], "url_key long, bad int")
    got = {r.page_id // 1000: r for r in urls.url_filter(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()}
    assert [got[k].template.split("/")[1] for k in range(5)] == ["a", "b", "few", "long", "bad"] or [got[k].template.split("/")[1] for k in range(5)] == ["~", "~", "few", "long", "bad"]
    assert [got[k].verdict for k in range(5)] == ["allow"] * 4 + ["block"]


def test_url_query_rejects_a_planted_branch(spark, tmp_path):
    pages = [(i, f"https://www.Site.example.org/{'win' if i % 4 == 0 else 'en'}/{i}.html?x=1", "") for i in range(240)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    # two thirds of the pages have labels; the branch is judged on those and rejected as a whole
    spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(240) if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = urls.query(spark, str(tmp_path)).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == set(range(0, 240, 4))


# ---- op2 ----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("rule", tokens.RULES)
def test_token_counts(spark, rule):
    texts = ["a b\n\n\nc  \n d", "één\nzwei  drei\n", "", None, "\n", "tail\n\n"]
    got = collections.defaultdict(dict)
    for r in tokens.token_counts(docs_of(spark, list(enumerate(texts))), rule).collect():
        got[r.doc_id][r.section] = r
    encoding, size = tokens.encoder(tokens.vocabulary_path())
    for i, t in enumerate(texts):
        data = (t or "").encode()
        ids, at = encoding.encode_ordinary(t or ""), 0
        want = collections.Counter()
        line = lambda p: data[:p].count(b"\n")
        for k in ids:
            a, z = at, at + int(size[k])
            at = z
            spread = collections.Counter(line(p) for p in range(a, z))
            if rule == "start":
                want[line(a)] += 1
            elif rule == "end":
                want[line(z - 1)] += 1
            elif rule == "largest":
                want[min(spread, key=lambda s: (-spread[s], s))] += 1
            else:
                for s, n in spread.items():
                    want[s] += n / (z - a)
        assert {s: r.n_tokens for s, r in got[i].items() if r.n_tokens} == pytest.approx(dict(want))
        assert sum(r.n_tokens for r in got[i].values()) == pytest.approx(len(ids))
        last = got[i][max(got[i])]
        assert last.byte_end == len(data) and last.char_end == len(t or "")


# ---- op3 ----------------------------------------------------------------------------------------------------------
def base_rules(t):
    t = t or ""
    w = WORD.findall(t)
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    n = len(w)
    return n, sum(map(len, w)), sum(t.count(s) for s in quality.SYMBOLS), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality_base_rules(spark, sf_dir, edge_rows):
    r = random.Random(4)
    line = prose(r, 12)
    texts = [x[1] for x in edge_rows[0]] + [f"{line}\n{line}\n#|{prose(r, 20)}\n{line}", "a " * 19, "a b c d e f g h " * 3]
    own = quality.quality_rules(docs_of(spark, list(enumerate(texts))), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    for x in own:
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == base_rules(texts[x.doc_id])
        assert x.llr == 0 and x.kept == (not x.base_failed)


def test_quality_keeps_clean_and_drops_odd(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 6))) for _ in range(300)]
    good = [" ".join(r.choice(words) for _ in range(400)) for _ in range(300)]  # few trusted words would say little
    junk = [" ".join(r.choice(words) + "###" for _ in range(80)) for _ in range(30)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.quality_rules(docs_of(spark, list(enumerate(good + junk))), labels).collect()}
    assert sum(got[i].kept for i in range(300)) >= 297 and not any(got[300 + i].kept for i in range(30))


def test_quality_ratio_by_force(spark):
    import xxhash

    word = lambda w: xxhash.xxh64_intdigest(w.encode(), seed=42)
    number = lambda x, seed: xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed=seed)
    r = random.Random(2)
    texts = [None, "", "one", "a b", "a b a b"] + [prose(r, r.randrange(20, 60), "abc") for _ in range(40)]
    bits, trusted = 8, {7, 9, 11}
    grams = []
    for t in texts:
        h = [word(w) for w in WORD.findall(t or "")]
        grams.append([x % 2**bits for x in h] + [number(b, number(x, 42)) % 2**bits for x, b in zip(h[1:], h)])
    raw, good = (np.bincount([g for i, own in enumerate(grams) if i in ids for g in own], minlength=2**bits) for ids in (range(len(texts)), trusted))
    p = (raw + quality.SMOOTHING) / (raw.sum() + quality.SMOOTHING * 2**bits)
    llr = np.log((good + 2**bits * p) / (good.sum() + 2**bits)) - np.log(p)
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted] + [(8, 1, 1), (10, 0, 0)], "doc_id long, quality int, toxic int")
    for x in quality.quality_rules(docs_of(spark, list(enumerate(texts))), labels, bits=bits).collect():
        own = grams[x.doc_id]
        want = float(np.sum(llr[own]) / len(own)) if own else 0.0
        assert x.llr == pytest.approx(want, abs=2e-9)
        assert x.kept == (not base_rules(texts[x.doc_id])[-1] and round(want, 9) >= quality.THRESHOLD)


# ---- op4 ----------------------------------------------------------------------------------------------------------
def test_token_files_round_trip(spark, edge_rows, tmp_path):
    rows = [(r[0], r[1]) for r in edge_rows[0] if r[0] is not None]
    tok = tokenfiles.tokenizer(tokenfiles.vocabulary_path())
    folder = str(tmp_path / "t")
    got = [tuple(r) for r in tokenfiles.tokenized(docs_of(spark, rows), folder=folder, length=64, file_tokens=3000).orderBy("start").collect()]
    at = 0
    for (doc, start, n, crc), (key, text) in zip(got, sorted(rows, key=lambda r: (r[0], r[1] or ""))):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [tokenfiles.END]
        assert (doc, start, n, crc) == (key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += n
    assert len(got) == len(rows)
    for f in sorted(os.listdir(folder)):
        if f.endswith(".arrow"):
            first = pa.ipc.open_stream(pa.memory_map(f"{folder}/{f}")).read_next_batch()
            assert first.schema.field("ids").type.list_size == 64 and first.schema.field("mask").type.list_size == 64


# ---- op5 ----------------------------------------------------------------------------------------------------------
def cut_by_force(rows, length):
    data = [(d, (t or "").encode()) for d, t in rows]
    c = collections.Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if c[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("trial", range(40))
def test_repeated_windows_and_common_prefixes(trial):
    r = np.random.default_rng(trial)
    base, n = r.integers(0, 3, 60), int(r.choice([16, 18, 20, 24]))
    parts = [np.concatenate([r.integers(0, 3, r.integers(0, 20)), base[r.integers(0, 30) : r.integers(30, 60)], np.zeros(r.integers(0, 30), int)]).astype(np.uint8) for _ in range(6)]
    parts = [x for x in parts if len(x) >= n]
    data, size = np.concatenate(parts), np.array([len(x) for x in parts])
    begin = np.cumsum(size) - size
    window, group, grouped = suffixdedup.repeated_windows(data, begin, size, n)
    text = {int(b) + i: x[i : i + n].tobytes() for b, x in zip(begin, parts) for i in range(len(x) - n + 1)}
    many = collections.Counter(text.values())
    assert sorted(window.tolist()) == sorted(text)
    assert all((many[text[a]] > 1) == (k < grouped) for k, a in enumerate(window.tolist()))
    named = collections.defaultdict(set)
    for a, g in zip(window.tolist(), group.tolist()):
        named[g].add(text[a])
    assert len(named) == len(many) and all(len(x) == 1 for x in named.values())
    suffixes = np.array(sorted(text, key=lambda a: (text[a], a)))
    got = suffixdedup.kasai(data, suffixdedup.eights(data), suffixes, n)
    assert got.tolist() == [0] + [len(os.path.commonprefix([text[a], text[b]])) for a, b in zip(suffixes, suffixes[1:])]


@pytest.mark.parametrize("spread", [False, True, "heavy"])
def test_suffix_dedup(spark, spread, monkeypatch):
    if spread == "heavy":  # small shards, of which some are spread; shuffle joins
        monkeypatch.setattr(suffixdedup, "SHARD", 2_000)
        monkeypatch.setattr(suffixdedup, "BUCKET", 2_000)
        monkeypatch.setattr(suffixdedup, "small_side", lambda df, rows=0: df)
    elif spread:  # treat frequent anchors as common
        monkeypatch.setattr(suffixdedup, "COMMON", 0.02)
        monkeypatch.setattr(suffixdedup, "SLICE_SHARE", 0.02)
        monkeypatch.setattr(suffixdedup, "SLICE_LEAST", 2)
    r = random.Random(5)
    chars = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passages = [chars(r.randrange(380, 900)) for _ in range(4)]
    rows = [(i, chars(r.randrange(0, 600)) + (r.choice(passages) if i % 3 else "") + chars(r.randrange(0, 600))) for i in range(120)]
    rows += [(400, None), (401, ""), (402, "a" * 399), (403, "a" * 400), (404, "b" * 401), (405, "ab" * 900), (406, rows[3][1]), (407, rows[3][1]), (408, "é" * 300), (410, passages[0] * 2)]
    got = suffixdedup.dedup(docs_of(spark, rows)).select("doc_id", "n_bytes", "n_removed", F.size("spans"), "kept_sha256")
    assert sorted(tuple(x) for x in got.collect()) == cut_by_force(rows, 400)


@pytest.mark.parametrize("piece", [1, 7, 100, 699, 700, 701, 5_000])
def test_anchors_by_pieces(piece):
    r = np.random.default_rng(piece)
    base = r.integers(97, 101, 300).astype(np.uint8)
    for data in (np.concatenate([base, r.integers(97, 123, 250).astype(np.uint8), base, base[:90]]), np.full(940, 97, np.uint8), base[:100]):
        m, h = suffixdedup.window_anchors(data, 100)
        v, many = suffixdedup.anchors_of(data, 100, piece)
        assert v.tolist() == sorted(set(m.tolist()))
        assert many.tolist() == [int((h == x).sum()) > 1 for x in v]
        parts = list(suffixdedup.pieces(data, 100, piece))
        assert np.concatenate([x for _, x, _ in parts]).tolist() == m.tolist() and np.concatenate([x for _, _, x in parts]).tolist() == h.tolist()
        assert [a for a, _, _ in parts] == list(range(0, len(m), piece))


def test_suffix_dedup_of_texts_beyond_a_piece(spark):
    r, n, length = np.random.default_rng(3), 2 * suffixdedup.PIECE + 70_000, 400
    text = r.integers(97, 123, n).astype(np.uint8)
    edge = suffixdedup.PIECE - 300
    text[2 * suffixdedup.PIECE - 100 :][:900] = text[edge : edge + 900]  # copies that stand over the edges of pieces
    text[5_000:5_400] = text[n - 400 :]
    other = np.concatenate([r.integers(97, 123, 3_000).astype(np.uint8), text[edge + 200 :][:700]])
    raw = {0: text.tobytes(), 1: other.tobytes(), 2: b"a" * n}
    many = collections.Counter(hash(b[i : i + length]) for k, b in raw.items() if k < 2 for i in range(len(b) - length + 1))
    want = [(2, n, n, 1, hashlib.sha256(b"").hexdigest())]
    for k in (0, 1):
        gone = np.zeros(len(raw[k]), bool)
        for i in (i for i in range(len(raw[k]) - length + 1) if many[hash(raw[k][i : i + length])] > 1):
            gone[i : i + length] = True
        spans = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        want.append((k, len(raw[k]), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw[k], np.uint8)[~gone].tobytes()).hexdigest()))
    got = suffixdedup.dedup(docs_of(spark, [(k, b.decode()) for k, b in raw.items()])).select("doc_id", "n_bytes", "n_removed", F.size("spans"), "kept_sha256")
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


# ---- op6 ----------------------------------------------------------------------------------------------------------
def test_mixing(spark, sf_dir):
    out = mixing.query(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id")
    out["source"] = docs.loc[out.doc_id, "source"].to_numpy()
    per = out.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert per.target.sum() == pytest.approx(per["size"].sum()) and (per.target <= 3 * per["size"] + 1e-6).all()
    assert (out.taken <= 3 * out["size"]).all()
    assert mixing.query(spark, sf_dir).toPandas()[["doc_id", "taken"]].sort_values("doc_id").taken.tolist() == out.sort_values("doc_id").taken.tolist()


def test_mixing_caps_and_reshares(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 30 and got["b"] + got["c"] == pytest.approx(1480) and got["b"] == pytest.approx(2 * got["c"])


def test_mixing_comes_near_its_targets(spark):
    r = random.Random(1)
    rows = [(i, "w " * r.randrange(1, 60), "abcd"[i % 4]) for i in range(4000)]
    mixed = mixing.mix_to_targets(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    per = mixed.groupBy("source").agg(F.first("_mix.target").alias("t"), F.sum(F.col("_mix.size") * F.col("_mix.copies")).alias("n")).collect()
    assert all(abs(x.n - x.t) < 0.1 * x.t for x in per)
    assert mixing.emit_copies(mixed).count() == mixed.agg(F.sum("_mix.copies")).first()[0]
    assert mixing.emit_copies(mixed).columns == mixed.columns


# ---- op7 ----------------------------------------------------------------------------------------------------------
def page(title, paragraphs, k):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<html><head><title>x</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header>Site</header><nav><ul><li>Home<li>News</ul></nav><div id='main'><h1>{title}</h1>{body}<div class=box>Constant text of the host</div></div><aside>side</aside><form>f</form><section class='comments'><p>reader {k}</p></section><footer>&copy; all</footer></body></html>"


def test_html_induces_the_wrapper_without_marks(spark):
    r = random.Random(3)
    want, rows = {}, []
    for k in range(12):
        ps = [prose(r, 12) for _ in range(r.randrange(1, 5))]
        rows.append((k, "http://h.com/a", page(f"Title {k} &amp; more", ps, k)))
        want[k] = "\n".join([f"Title {k} & more", *ps])
    got = {x.page_id: x.text for x in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_html_blocks():
    text = lambda h: "\n".join(b[-1] for b in html.page_blocks(h, None) if b[2] == html.OPEN)
    assert text("<article><p>a  <b>b</b>\n c<br>d<p>e &lt; f</article><footer>x</footer>") == "a b c d\ne < f"
    assert text("<article><h1>T</h1><p><b>x<br><p>y</article>") == "T\nx\ny"
    assert text("<p>1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"
    assert text("<article><p>in</p><div class='ad'>no</div><script>if (a<b) '</article>'</script><p>out") == "in\nout"


@pytest.mark.parametrize("marks", ['style="overflow:hidden"', 'title="a hidden gem"', 'aria-hidden="false"', "data-x='class=ad'", 'class="content has-sidebar"', 'class="article-header"', 'class="with-ads"', 'id="no-comments"', 'class="sidebar"'])
def test_html_marks_spare_the_article(marks):
    text = lambda h: "\n".join(b[-1] for b in html.page_blocks(h, None) if b[2] == html.OPEN)
    assert text(f"<div {marks}><article><p>in</p></article></div>") == "in"
    if marks != 'class="sidebar"':
        assert text(f"<div {marks}><p>in</p></div>") == "in"
    assert text("<article><p>in</p><div class='x ads'>no</div><p hidden>no</p><p aria-hidden=true>no</p></article><div class=comments><article>no</article></div>") == "in"


def test_html_induced_template_decides_without_marks(spark, sf_dir):
    """With names and article marks off, the template alone gives the same text."""
    pages = common.table(spark, sf_dir, "pages")
    marked = {r.page_id: r.text for r in html.extract_text(pages, min_pages=1 << 30).collect()}
    small = {r.page_id for r in pages.withColumn("h", F.regexp_extract("url", "://([^/?#]*)", 1)).collect() if not r.h}
    induced = {r.page_id: r.text for r in html.extract_text(pages, min_pages=3, marks=False).collect()}
    assert sum(induced[k] == marked[k] for k in marked) >= 0.95 * (len(marked) - len(small))


def test_html_constant_paragraphs_inside_the_article_go(spark):
    r = random.Random(5)
    want, rows = {}, []
    for k in range(20):
        ps = [prose(r, 12) for _ in range(3)]
        rows.append((k, "http://h.com/a", f"<body><nav>x</nav><article><h1>T {k}</h1>" + "".join(f"<p>{p}</p>" for p in ps) + "<div>Subscribe to our letter</div></article><div>below</div></body>"))
        want[k] = "\n".join([f"T {k}", *ps])
    rows += [(100 + k, "http://h.com/b", rows[0][2]) for k in range(50)]  # copies of one page turn nothing into template
    got = {x.page_id: x.text for x in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == want[k] for k in want) and all(got[100 + k] == want[0] for k in range(50))


def test_html_layouts_of_a_host_are_apart(spark):
    """A seed of one layout says nothing about pages of another."""
    r = random.Random(6)
    news = [(k, "http://h.com/n", f"<body><div><h1>N {k}</h1><p>{prose(r, 20)}</p></div><section><p>same</p></section></body>") for k in range(8)]
    lists = [(50 + k, "http://h.com/l", f"<body><ul><li>{prose(r, 9)}</li><li>{prose(r, 9)}</li></ul><ol><li>same too</li></ol></body>") for k in range(8)]
    got = {x.page_id: x.text for x in html.extract_text(spark.createDataFrame(news + lists + [(99, "http://h.com/", "")], "page_id long, url string, html string")).collect()}
    assert not any("same" in t for t in got.values()) and all(got[k].startswith(f"N {k}\n") for k in range(8)) and all(got[50 + k].count("\n") == 1 for k in range(8)) and got[99] == ""


def test_region_holds_the_varying_text():
    seed = html.outline(html.parse("<body><ul><li>a</li></ul><div><section><p>x</p><p>y</p></section></div><div><p>z</p></div></body>")[0])
    names = {}

    def walk(node):
        names.setdefault(node[0], node[1])
        for c in node[2]:
            walk(c)

    walk(seed)
    first, last = html.region_of(seed, {names["section"]: 900, names["li"]: 50}, 0.75)
    assert first == names["section"] and last == first + 2
    assert html.region_of(seed, {}, 0.75)[0] == 0


@pytest.mark.parametrize("trial", range(30))
def test_tree_matching_by_force(trial):
    r = random.Random(trial)
    grow = lambda depth: "".join(f"<{t}>{grow(depth - 1)}</{t}>" for t in r.choices(("div", "section", "span2"), k=r.randrange(0, 4))) if depth else ""
    a, b = html.parse(f"<div>{grow(3)}</div>")[0], html.outline(html.parse(f"<div>{grow(3)}</div>")[0])

    def best(x, y):
        """Largest match by trying all order-preserving pairings of children."""
        if x.symbol != y[0]:
            return 0

        def pair(xs, ys):
            return max(best(xs[0], ys[0]) + pair(xs[1:], ys[1:]), pair(xs[1:], ys), pair(xs, ys[1:])) if xs and ys else 0

        return 1 + pair(tuple(x.children), y[2])

    found = {}
    html.match(a, b, found, memo := {})
    assert memo[0, 0][0] == best(a, b) == len(found)


@pytest.mark.parametrize("deep", [150, 5000])
def test_constant_blocks_below_any_depth_are_template(spark, deep):
    page = lambda k: f"<body><h1>T {k}</h1>{'<div>' * deep}<p>the same note</p><section><p>own words {k} {k * 7}</p><p>more {k * k}</p></section>"
    seed = html.packed(html.outline(html.parse(page(0))[0]))
    flat = lambda t: [(n[0], n[1], [c[1] for c in n[2]]) for n in html.in_order(t)]
    assert flat(html.unpacked(seed)) == flat(html.outline(html.parse(page(0))[0]))
    assert all(slot >= 0 for slot, *_ in html.page_blocks(page(3), seed))
    rows = [(k, f"http://d.com/{k}", page(k)) for k in range(8)]
    got = {x.page_id: x.text for x in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), marks=False).collect()}
    assert got == {k: f"T {k}\nown words {k} {k * 7}\nmore {k * k}" for k in range(8)}


def test_tree_matching():
    a = html.parse("<div><ul><li>1</li><li>2</li></ul><p>x</p></div>")[0]
    b = html.outline(html.parse("<div><h1>t</h1><ul><li>1</li></ul><p>y</p><p>z</p></div>")[0])
    found = {}
    html.match(a, b, found, memo := {})
    assert memo[0, 0][0] == 5 and len(found) == 5


# ---- op8 ----------------------------------------------------------------------------------------------------------
def components_by_force(rows, size=4, percent=85):
    def shingles(t):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}

    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d, key=lambda x: (x is None, x or 0))
    return sorted(((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("common_share", [0.002, 0.05])
def test_jaccard(spark, common_share, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON", common_share)
    monkeypatch.setattr(jaccard, "SLICE_SHARE", common_share)
    r = random.Random(3)
    v = [f"w{i}" for i in range(400)]
    base, passage, rows = [r.choice(v) for _ in range(150)], [r.choice(v) for _ in range(40)], []
    for i in range(360):
        if i % 3 == 0:
            w = list(base)
            for _ in range(r.randrange(0, 8)):
                w[r.randrange(len(w))] = r.choice(v)
        elif i % 3 == 1:
            w = passage + [r.choice(v) for _ in range(r.randrange(0, 15))]
        else:
            w = [r.choice(v) for _ in range(r.randrange(0, 60))]
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, ""), (902, " \n "), (903, "a b"), (904, "A B"), (905, "a b c"), (906, "a b c d"), (5000, rows[0][1]), rows[0], rows[3], rows[3], rows[6], rows[1]]
    assert sorted((tuple(x) for x in jaccard.components(docs_of(spark, rows)).collect()), key=str) == components_by_force(rows)


def odd_ids():
    """Rows that share a doc_id or have none, with equal, near and other texts."""
    r = random.Random(12)
    w = [f"w{r.randrange(300)}" for _ in range(120)]
    near = lambda k: " ".join(w[:k] + ["odd"] + w[k + 1 :])
    other = " ".join(f"v{r.randrange(300)}" for _ in range(80))
    return [(5, near(3)), (5, other), (2, near(3)), (9, other), (None, near(119)), (7, prose(r, 50)), (None, prose(r, 60)), (8, "a b c d e"), (8, "a b c d e"), (3, None), (3, ""), (None, other + " x")]


def test_jaccard_with_repeated_and_null_ids(spark):
    rows = odd_ids()
    got = sorted((tuple(x) for x in jaccard.components(docs_of(spark, rows)).collect()), key=str)
    assert got == components_by_force(rows) and len(got) == len(rows)
    assert sorted(jaccard.one_of_each(docs_of(spark, rows), size=4, percent=85).collect(), key=str) == sorted(
        [rows[1], rows[2], rows[5], rows[6], rows[7], rows[9], rows[10]], key=str
    )


def test_signature_tree_equals_all_pairs():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 60, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([r.permutation(base)[: r.integers(180, 300)], r.integers(0, 1 << 60, r.integers(0, 60), dtype=np.uint64)])) for _ in range(300)]
    got = jaccard.links_of(sets, 80)
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                up[max(root(i), root(j))] = min(root(i), root(j))
    assert got.tolist() == [root(i) for i in range(len(sets))]


def test_large_block_is_split_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 2500)
    r = random.Random(8)
    v, rows = [f"w{i}" for i in range(400)], []
    base = [r.choice(v) for _ in range(120)]
    for i in range(400):
        w = list(base[: r.choice((120, 120, 105, 90))])
        for _ in range(r.choice((0, 1, 2, 4, 6))):
            w[r.randrange(len(w))] = r.choice(v)
        rows.append((i, " ".join(w)))
    rows += [rows[0], rows[7], (5000, rows[9][1])]
    want = components_by_force(rows)
    assert len({c for _, _, c in want}) > 20
    assert sorted((tuple(x) for x in jaccard.components(docs_of(spark, rows)).collect()), key=str) == want
    blocks = spark.createDataFrame([(0, i, 120, 0) for i in range(400)], "root long, class long, n long, major int")
    assert max(x["count"] for x in jaccard.in_chunks(blocks, 1).groupBy("_chunk").count().collect()) < 50


def test_near_copies_with_many_variants_fit_in_memory():
    """6,000 sets of 400,000 shared shingles took bitmaps of 300 MB."""
    import tracemalloc

    r = np.random.default_rng(4)
    base, variants = r.integers(0, 1 << 60, 100, dtype=np.uint64), r.integers(0, 1 << 60, 400_000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base, r.choice(variants, 200)])) for _ in range(6000)]
    sets[5000] = np.unique(np.append(sets[17][:-3], np.uint64(1)))
    tracemalloc.start()
    got = jaccard.links_of(sets, 85)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6 and got[5000] == 17 and len(set(got.tolist())) == 5999


# ---- op9 ----------------------------------------------------------------------------------------------------------
def test_language_accuracy_on_held_out_rows(spark, sf_dir):
    out = langid.query(spark, sf_dir).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")
    held = out[out.held_out]
    assert all(held.index.map(lambda i: langid.crc_fold(i) == 1)) and (held.lang_pred == docs.loc[held.index].lang).mean() > 0.97
    assert out.score.between(0, 1).all()


def test_forward_sums_all_segmentations():
    path = langid.vocabulary_path()
    vocab, names = langid.loaded(path), langid.pieces(path)
    r = np.random.default_rng(2)
    probs = r.random((vocab.size, 2))
    probs /= probs.sum(axis=0)
    at = {p: i for i, p in enumerate(names)}

    def brute(text, k):
        if not text:
            return 1.0
        total = 0.0
        for n in range(1, len(text) + 1):
            p = probs[at[text[:n]], k] if text[:n] in at else langid.UNKNOWN if n == 1 else 0.0
            total += p * brute(text[n:], k) if p else 0.0
        return total

    words = ["the", "a", "strasse", "中x"]
    got = langid.word_scores(vocab, probs, words)
    for i, w in enumerate(words):
        for k in range(2):
            assert got[i, k] == pytest.approx(np.log(brute(" " + w, k)))


def test_long_words_are_summed_whole(monkeypatch):
    """Words summed one by one in logarithms score and count as those in the batch."""
    vocab = langid.loaded(langid.vocabulary_path())
    r = np.random.default_rng(3)
    probs = r.random((vocab.size, 2)) ** 4
    probs /= probs.sum(axis=0)
    words, counts = ["international", "Straßenbahnhaltestelle", "x", "中国人", "a" * 60], np.array([1.0, 3, 2, 1, 5])
    batch = langid.word_scores(vocab, probs, words), langid.expected_counts(vocab, probs, words, counts, 1)
    monkeypatch.setattr(langid, "WIDE", 1)
    assert np.allclose(batch[0], langid.word_scores(vocab, probs, words)) and np.allclose(batch[1], langid.expected_counts(vocab, probs, words, counts, 1))
    long = langid.word_scores(vocab, probs, ["ab" * 3000])[0]
    assert np.isfinite(long).all() and (long < -3000).all()


@pytest.mark.parametrize("n", [40, 43, 44, 60, 62, 63, 69])
def test_letters_outside_the_vocabulary_leave_the_rest_to_decide(n):
    """However many of them a word has, its known pieces tell the languages apart, and counts add up."""
    vocab, names = langid.loaded(langid.vocabulary_path()), langid.pieces(langid.vocabulary_path())
    probs = np.full((vocab.size, 2), 1.0 / vocab.size)
    probs[names.index("the"), 0] *= 50
    word = "the" * 3 + "\U0001f0a1" * n
    few = langid.word_scores(vocab, probs, ["the" * 3 + "\U0001f0a1" * 5])[0]
    got = langid.word_scores(vocab, probs, [word])[0]
    assert got[0] - got[1] == pytest.approx(few[0] - few[1]) and got[0] - few[0] == pytest.approx((n - 5) * np.log(langid.UNKNOWN))
    counts = langid.expected_counts(vocab, probs, [word], np.array([2.0]), 0)
    assert counts.sum() == pytest.approx(langid.expected_counts(vocab, probs, ["the" * 3], np.array([2.0]), 0).sum())


def test_a_column_called_score_in_any_case_is_replaced(spark):
    model = (["en"], np.full((langid.loaded(langid.vocabulary_path()).size, 1), 1e-4))
    got = langid.identify(spark.createDataFrame([(1, "some words", 7.0)], "doc_id long, text string, Score double"), model, langid.vocabulary_path())
    assert got.columns == ["doc_id", "text", "lang_pred", "score"] and got.first().score == 1.0


def test_expected_counts_by_force():
    path = langid.vocabulary_path()
    vocab, names = langid.loaded(path), langid.pieces(path)
    r = np.random.default_rng(4)
    probs = r.random((vocab.size, 1))
    probs /= probs.sum(axis=0)
    at = {p: i for i, p in enumerate(names)}

    def segmentations(text):
        if not text:
            yield ()
        for n in range(1, len(text) + 1):
            if text[:n] in at or n == 1:
                for rest in segmentations(text[n:]):
                    yield (text[:n], *rest)

    words, counts = ["strasse", "The", "the", "中x"], np.array([2.0, 1.0, 4.0, 1.0])
    want = np.zeros(vocab.size)
    for w, c in zip(words, counts):
        ways = [(s, np.prod([probs[at[p], 0] if p in at else langid.UNKNOWN for p in s])) for s in segmentations(" " + w)]
        whole = sum(p for _, p in ways)
        for s, p in ways:
            for piece in s:
                if piece in at:
                    want[at[piece]] += c * p / whole
    assert np.allclose(langid.expected_counts(vocab, probs, words, counts, 0), want)


# ---- op10 ---------------------------------------------------------------------------------------------------------
def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        q = [i]
        for j, e in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (c != e)))
        p = q
    return p[-1]


def test_leaks_are_found_within_the_edits_allowed(spark):
    r = random.Random(6)
    items = [(k, prose(r, r.randrange(20, 60))) for k in range(30)]
    rows, truth = [], set()
    for k in range(150):
        i, item = r.choice(items)
        s = list(item)
        for _ in range(decontaminate.edits_allowed(len(item)) * r.randrange(0, 100) // 100):
            p = r.randrange(len(s))
            s[p : p + 1] = r.choice([[r.choice("xyz")], [], [s[p], r.choice("xyz")]])
        rows.append((k, f"{prose(r, r.randrange(0, 80))} {''.join(s)} {prose(r, r.randrange(0, 80))}"))
        truth.add((k, i))
    rows += [(1000 + k, prose(r, 200)) for k in range(50)]
    found = decontaminate.find_leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(x.doc_id, x.item_id) for x in found}
    assert len(truth - got) <= 0.03 * len(truth) and got <= truth
    text = dict(rows)
    for x in found[:30]:
        assert levenshtein(decontaminate.folded(items[x.item_id][1]), decontaminate.folded(text[x.doc_id])[x.byte_start : x.byte_end]) == x.distance


def test_leaks_at_exactly_the_edits_allowed(spark):
    r = random.Random(5)
    items, rows = [], []
    for k in range(40):
        n, indels = (100, 230, 380, 1000, 3000)[k % 5], k % 2
        s = [chr(r.randrange(97, 123)) for _ in range(n)]
        items.append((k, "".join(s)))
        for p in sorted(r.sample(range(5, n - 5), decontaminate.edits_allowed(n)), reverse=True):  # one place an edit
            s[p : p + 1] = r.choice(([], [s[p], "#"])) if indels else ["#"]
        rows.append((k, f"{prose(r, 20)} {''.join(s)} {prose(r, 20)}"))
    found = decontaminate.find_leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in found} == {(k, k) for k in range(40)}


def test_leaks_equal_all_windows(spark):
    """Brute force over every window of every text: nothing else is found, and hardly anything is missed."""
    r = random.Random(14)
    items = [(k, prose(r, r.randrange(5, 25), "abcde")) for k in range(12)]
    items += [(20, "zebra Crossing"), (21, "qq"), (22, " "), (23, "ab"), (24, None)]
    rows = [(90, "a zebra crossing."), (91, "zebra crossings"), (92, "abab ab, qq"), (93, "aqq"), (94, "x\tqq"), (None, items[3][1]), (None, "clean text"), (95, "")]
    for k in range(120):
        s = list(r.choice(items[:12])[1])
        for _ in range(r.randrange(0, 14)):
            p = r.randrange(len(s))
            s[p : p + 1] = r.choice([["x"], [], [s[p], "y"]])
        rows.append((k, f"{prose(r, 10, 'abcde')} {''.join(s)} {prose(r, 10, 'abcde')}"))
    want = set()
    for d, t in rows:
        t = decontaminate.folded(t)
        for i, x in items:
            x = decontaminate.folded(x or " ")
            n = decontaminate.edits_allowed(len(x))
            if not x.strip():
                continue
            if len(x) < 24:
                found = re.search(rb"(?<![0-9a-z\x80-\xff])" + re.escape(x) + rb"(?![0-9a-z\x80-\xff])", t) is not None
            else:
                least = [0] * (len(t) + 1)  # of a prefix of the item against any substring that ends here
                for a in x:
                    row = [least[0] + 1]
                    for j, b in enumerate(t, 1):
                        row.append(min(least[j] + 1, row[-1] + 1, least[j - 1] + (a != b)))
                    least = row
                found = min(least) <= n
            if found:
                want.add((d, i))
    got = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block=5).collect()}
    assert got <= want and len(want - got) <= 0.02 * len(want) and {(90, 20), (92, 21), (92, 23), (94, 21), (None, 3)} <= got and len(want) > 30


def test_leaking_rows_take_no_other_rows_with_them(spark):
    item = "the quick brown fox jumps over the lazy dog again"
    rows = [(3, "clean"), (3, f"x {item} y"), (None, item), (None, "clean too"), (4, "c"), (4, "c"), (5, None)]
    kept = decontaminate.without_leaks(docs_of(spark, rows), spark.createDataFrame([(1, item), (None, None)], "item_id long, text string"))
    assert sorted(kept.collect(), key=str) == sorted([rows[0], rows[3], rows[4], rows[5], rows[6]], key=str)


def test_long_and_many_items_fit_in_memory():
    """2,000 short items and one of 20 KB took over 90 s to set up."""
    import time

    r = random.Random(3)
    began = time.monotonic()
    items = [(k, prose(r, 8).encode()) for k in range(2000)] + [(5000, prose(r, 4500).encode())]
    ready = decontaminate.Items(items, decontaminate.SHARE, decontaminate.Q)
    text = b"before " + items[-1][1] + b" after"
    found = ready.search(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]), decontaminate.Q)
    assert (0, 5000) in {x[:2] for x in found} and time.monotonic() - began < 30


def test_walks_of_pieces_agree_as_measured():
    """A piece with the edits allowed is proposed with the recall that the samplings are laid out for."""
    r, left, right = random.Random(2), [], []
    for _ in range(600):
        x = [r.randrange(97, 123) for _ in range(decontaminate.PIECE)]
        y = list(x)
        for _ in range(4):
            p = r.randrange(len(y))
            y[p : p + 1] = r.choice([[35], [], [y[p], 35]])
        left.append(bytes(x))
        right.append(bytes(y[: decontaminate.PIECE]))
    n = decontaminate.repeats_for(decontaminate.RECALL)
    near, far = decontaminate.collide(left, right, n), decontaminate.collide(left, right[1:] + right[:1], n)
    assert near.mean() > 0.8 and far.mean() < 0.02  # one piece; an item has several, and several diagonals


def test_edit_distance():
    r = random.Random(9)
    for _ in range(60):
        a, b = bytes(r.choice(b"abc") for _ in range(r.randrange(1, 70))), bytes(r.choice(b"abc") for _ in range(r.randrange(0, 80)))
        best, end = decontaminate.edit_distance(a, b)
        assert best == min(levenshtein(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert decontaminate.edit_distance(a, b, True)[0] == min(levenshtein(a, b[:j]) for j in range(len(b) + 1))


# ---- clashing names -----------------------------------------------------------------------------------------------
CLASHES = ("h", "n", "class", "best", "_row", "_mix", "_copy", "_size", "_dropped", "_leak", "gone_id", "gone_h", "lang_pred", "score", "_text", "_llr", "_n", "n_words", "llr", "_host", "_path", "_template", "copies", "target", "source_size", "component_id", "kept")


def clashing(df):
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES if c not in df.columns])


def test_stages_keep_columns_of_any_name(spark, edge_dir):
    import corpus_pipeline as p

    docs = clashing(common.table(spark, edge_dir, "documents"))
    had = {c: docs.where(F.col(c).isNotNull()).count() for c in docs.columns}
    for _, stage in p.STAGES[:4]:
        out = common.staged(stage(spark, docs, edge_dir))
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHES if c not in ("h", "n", "class", "_size") and had[c])
    assert tokenfiles.tokenized(docs).count() == docs.count()


def test_operators_keep_columns_of_any_name(spark, edge_dir):
    docs, pages, labels = (clashing(common.table(spark, edge_dir, t)) for t in ("documents", "pages", "labels"))
    kept = lambda out, lost: all(r[c] == f"own {c}" for r in out.collect() for c in CLASHES if c not in lost and c not in ("h", "n", "class", "_size"))
    assert kept(quality.quality_rules(docs, labels), quality.RESULTS)
    assert kept(mixing.mix_to_targets(docs), ("_mix",))
    assert kept(urls.url_filter(pages, labels.select(F.col("doc_id").alias("url_key"), F.lit(1).alias("bad"))), ())
    assert kept(langid.identify(docs, (["en"], np.full((langid.loaded(langid.vocabulary_path()).size, 1), 1e-4)), langid.vocabulary_path()), ("lang_pred", "score"))
    assert kept(jaccard.one_of_each(docs), ()) and kept(decontaminate.without_leaks(docs, common.table(spark, edge_dir, "benchmark")), ())
    n = docs.count()
    for out in (jaccard.components(docs), suffixdedup.dedup(docs), tokens.token_counts(docs).select("doc_id", "section").where("section = 0"), html.extract_text(pages)):
        assert out.count() == (7 if "n_chars" in out.columns else n)


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


# ---- pipeline -----------------------------------------------------------------------------------------------------
def test_pipeline_by_hand(spark, sf_dir, edge_dir, empty_dir):
    import corpus_pipeline as p

    docs = common.table(spark, sf_dir, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(p.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()] if k < 4 else None
        after = common.staged(stage(spark, docs, sf_dir), f"t{k}")
        if k < 4:
            assert after.columns == docs.columns
            ids = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "n-gram Jaccard join":
            force = components_by_force(before, p.SHINGLE, p.PERCENT)
            assert ids == {d for d, _, c in force if d == c}
        if name == "benchmark decontamination":
            items = [decontaminate.folded(r.text).decode() for r in common.table(spark, sf_dir, "benchmark").collect()]
            assert not any(i in decontaminate.folded(rows[d].text).decode() for d in ids for i in items)
            assert len(ids) > 0.9 * len(before)
        if name == "token files":
            assert after.count() == docs.count()
        docs = after
    assert p.run(spark, edge_dir).count() > 0 and p.run(spark, empty_dir).count() == 0
