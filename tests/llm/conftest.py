import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, kind string, class string, n long, text_len int, host string, _size long"


def prose(r, n, letters="abcdefgh"):
    return " ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    r = random.Random(11)
    base, item = prose(r, 200), prose(r, 40)
    texts = [None, "", " \n\t ", "one", "A B c", base, base, base.replace("a", "b", 1), "word " * 4000, "x" * 50_000, "é è ñ ß 中文 \u00a0 wide", item + " " + prose(r, 30), prose(r, 50) + "\n" + item.upper(), "<|endoftext|> a  b \n c ", "line one\n\nline one\nline two\n"]
    rows = [(i, t, ("en", "de", None)[i % 3], (None, "s1", "s2")[i % 3], len(t or ""), 7, "k", "c", None, 1, "h", 3) for i, t in enumerate(texts)]
    rows += [(None, "a row without an id " + prose(r, 30), None, None, None, None, None, None, None, None, None, None), rows[5], rows[5]]
    return rows, item


@pytest.fixture(scope="session")
def edge_dir(spark, edge_rows, tmp_path_factory):
    rows, item = edge_rows
    d = str(tmp_path_factory.mktemp("edge"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (7, 0, 1), (None, 1, None), (8, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None), (2, "short"), (3, item), (None, "x" * 30)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    pages = [(0, None, None), (1, "", ""), (2, "nohost", "<p>a"), (3, "http://H.Net", "<article><p>x &amp; y<p>z</article>"), (4, "http://h.net/de/1?x#y", "<" * 50), (4, "http://h.net/de/1?x#y", "<div>" * 3000 + "deep"), (None, "x://a.org/fr/2", "<article><h1>t</h1><div class='comments'>no</div></article>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    vectors = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.001], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [1.0, 2.0], None), (6, [1.0, None], 1), (7, [float("nan"), 1.0], 1), (8, [2.0, -1.0], 1), (9, [1.0, 2.0], 2)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    turns = [(20, 0, "user", "a b"), (20, 1, None, None), (21, None, "x", "null turn"), (21, 0, "user", "one"), (21, 1, "user", "two " * 3000), (22, 5, "user", "a b"), (22, 6, "bot", ""), (22, 6, "bot", ""), (None, 0, "user", "none")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.fixture(scope="session")
def empty_dir(spark, edge_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "pages", "embeddings", "conversations"):
        spark.read.parquet(f"{edge_dir}/{name}.parquet").limit(0).write.parquet(f"{d}/{name}.parquet")
    return d
