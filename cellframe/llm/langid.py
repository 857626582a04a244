"""Language ID by segmentation-marginalised unigrams.

Every language has probabilities over the pieces of a fixed public vocabulary.  The probability of a word is the
sum over all its segmentations into pieces, by the forward algorithm; a text's is the product over its words (the
vocabulary's pieces do not cross white space).  The probabilities are learned by expectation maximisation:
expected piece counts by forward and backward sums over the training words, added up by Spark per language and
piece.  The forward sums run in numpy over all distinct words of a batch at once, every character's share of a weight
scaled by TILT, so that no sum of up to WIDE characters leaves the range of a double; longer words are summed one by
one in logarithms.  Both give the same sums, and no probability has a floor.  All pieces of the vocabulary count, as they are; a word
is never cut, so the sum has every segmentation.  Texts are lower-cased, so that capitals do not hide a language.

Training uses at most `max_train_docs` labelled documents (those with the smallest hash of doc_id); prediction
covers every whole text.  The model holds pieces x languages numbers, whatever the corpus.

Defined cases: a text that is null or has no letter is `und` with score 0; without training rows every text is
`und`; characters outside the vocabulary get a fixed small probability; ties go to the language first by code
point; a repeated doc_id is judged row by row; rows without a doc_id are predicted, but do not train; other columns
are kept, but for lang_pred and score, whatever their case, which the results replace.  Texts of any length are judged
whole; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, table

VOCABULARY = "piece_bpe_32k.model"
MAX_TRAIN_DOCS = 4000
ROUNDS = 3
SMOOTHING = 0.1
UNKNOWN = 1e-7
#: Words of more characters, with the blank in front, are summed one by one: TILT ** WIDE is within 1e224 both ways.
WIDE, TILT = 64, UNKNOWN**0.5
#: Distinct words whose scores a task keeps between batches.
CACHE = 250_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(2)
def pieces(path: str) -> tuple[str, ...]:
    """The distinct pieces, sorted; the mark of a word's start is a blank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {sp.id_to_piece(i).replace("▁", " ") for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return tuple(sorted(p for p in found if p))


_MUL = np.uint64(0x9E3779B97F4A7C15)


def _extend(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    h = (h ^ codes) * _MUL
    return h ^ (h >> np.uint64(29))


class Pieces:
    """The vocabulary as a dictionary and as sorted hashes with a bitmap of their first bits."""

    def __init__(self, path: str):
        names = pieces(path)
        self.number, self.size, self.longest = {p: i for i, p in enumerate(names)}, len(names), max(map(len, names))
        hashes = np.full(self.size, 1, dtype=np.uint64)
        length = np.fromiter(map(len, names), dtype=np.int64, count=self.size)
        for k in range(self.longest):
            at = np.flatnonzero(length > k)
            hashes[at] = _extend(hashes[at], np.array([ord(names[i][k]) for i in at], dtype=np.uint64))
        order = np.argsort(hashes)
        self.sorted, self.ids = hashes[order], order.astype(np.int32)
        self.map = np.zeros(1 << 20, dtype=bool)
        self.map[hashes >> np.uint64(44)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where there is none."""
        out = np.full(h.shape, -1, dtype=np.int32)
        hit = self.map[h >> np.uint64(44)]
        some = h[hit]
        at = np.minimum(np.searchsorted(self.sorted, some), self.size - 1)
        out[hit] = np.where(self.sorted[at] == some, self.ids[at], -1)
        return out


_PIECES: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes padded with 0, lengths) of words with a blank in front."""
    length = np.array([len(w) + 1 for w in words], dtype=np.int64)
    codes = np.zeros((len(words), int(length.max())), dtype=np.uint32)
    codes[:, 0] = 32
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    mask = np.arange(codes.shape[1])[None, :] < length[:, None]
    mask[:, 0] = False
    codes[mask] = flat
    return codes.astype(np.uint64), length


def lattice(vocab: Pieces, codes: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(start, end, piece numbers) of the spans in which some word has a piece."""
    out = []
    width = codes.shape[1]
    h = np.full(codes.shape, 1, dtype=np.uint64)
    for n in range(1, min(vocab.longest, width) + 1):
        h = _extend(h[:, : width - n + 1], codes[:, n - 1 :])  # a span's hash is that of the span shorter by one, carried on
        found = vocab.find(h)
        some = (found >= 0).any(axis=0)
        out += [(s, s + n, found[:, s]) for s in range(width - n + 1) if n == 1 or some[s]]
    return sorted(out, key=lambda x: (x[1], x[0]))


def spans_of(vocab: Pieces, word: str) -> list[tuple[int, int, int]]:
    """(start, end, piece number or -1) of one word with a blank in front, by end."""
    text, get, out = " " + word, vocab.number.get, []
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - vocab.longest), e):
            p = get(text[s:e], -1)
            if p >= 0 or s == e - 1:
                out.append((s, e, p))
    return out


def log_forward(spans: list[tuple[int, int, int]], logs: np.ndarray, n: int) -> np.ndarray:
    """[position, language]: logarithm of the summed probability of all segmentations up to there."""
    la, at = np.zeros((n + 1, logs.shape[1])), 0
    unknown = np.full(logs.shape[1], np.log(UNKNOWN))
    for e in range(1, n + 1):
        terms = []
        while at < len(spans) and spans[at][1] == e:
            s, _, p = spans[at]
            terms.append(la[s] + (logs[p] if p >= 0 else unknown))
            at += 1
        la[e] = np.logaddexp.reduce(terms, axis=0)
    return la


def forward(edges, table_: np.ndarray, n: int, width: int) -> np.ndarray:
    """alpha[position, word, language]: summed probability of all segmentations up to there, over TILT ** position."""
    alpha = np.zeros((width + 1, n, table_.shape[1]))
    alpha[0] = 1.0
    for s, e, p in edges:
        weight = table_[p]  # row -1, the last one, is 0
        if e == s + 1:
            weight = np.where((p < 0)[:, None], UNKNOWN, weight)
        alpha[e] += alpha[s] * (weight * TILT ** (s - e))
    return alpha


def word_scores(vocab: Pieces, probs: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.zeros((len(words), probs.shape[1]))
    order = np.argsort([len(w) for w in words], kind="stable")
    padded = np.vstack([probs, np.zeros((1, probs.shape[1]))])
    wide = [i for i in order if len(words[i]) >= WIDE]
    order = order[: len(order) - len(wide)]
    if wide:
        logs = np.log(probs)
        for i in wide:
            out[i] = log_forward(spans_of(vocab, words[i]), logs, len(words[i]) + 1)[-1]
    for part in np.array_split(order, max(1, len(order) // 4000)):
        if not len(part):
            continue
        codes, length = letters_of([words[i] for i in part])
        alpha = forward(lattice(vocab, codes), padded, len(part), codes.shape[1])
        out[part] = np.log(alpha[length, np.arange(len(part))]) + (length * np.log(TILT))[:, None]
    return out


def expected_counts(vocab: Pieces, probs: np.ndarray, words: list[str], counts: np.ndarray, lang: int) -> np.ndarray:
    """Expected uses of each piece in words that stand counts times in one language's texts."""
    out = np.zeros(vocab.size)
    p = np.vstack([probs[:, [lang]], np.zeros((1, 1))])
    order = np.argsort([len(w) for w in words], kind="stable")
    wide = [i for i in order if len(words[i]) >= WIDE]
    order = order[: len(order) - len(wide)]
    if wide:
        logs = np.log(probs[:, [lang]])
        for i in wide:
            spans, n = spans_of(vocab, words[i]), len(words[i]) + 1
            la = log_forward(spans, logs, n)[:, 0]
            # the backward sums are forward sums of the mirrored spans
            lb = log_forward(sorted(((n - e, n - s, q) for s, e, q in spans), key=lambda x: (x[1], x[0])), logs, n)[::-1, 0]
            for s, e, q in spans:
                if q >= 0:
                    out[q] += counts[i] * np.exp(la[s] + logs[q, 0] + lb[e] - la[-1])
    for part in np.array_split(order, max(1, len(order) // 4000)):
        if not len(part):
            continue
        codes, length = letters_of([words[i] for i in part])
        edges, n, width = lattice(vocab, codes), len(part), codes.shape[1]
        alpha = forward(edges, p, n, width)[:, :, 0]
        beta = np.zeros((width + 1, n))
        beta[length, np.arange(n)] = 1.0
        for s, e, q in sorted(edges, key=lambda x: (-x[0], -x[1])):
            weight = p[q, 0]
            if e == s + 1:
                weight = np.where(q < 0, UNKNOWN, weight)
            beta[s] += beta[e] * (weight * TILT ** (s - e))
        whole = alpha[length, np.arange(n)]
        for s, e, q in edges:
            ok = q >= 0
            # a part of a word's whole sum, at most 1, before it is weighted by the count
            np.add.at(out, q[ok], (alpha[s] * (p[q, 0] * TILT ** (s - e)) * beta[e] / whole * counts[part])[ok])
    return out


def lower_words(text):
    """The words of an Arrow column of texts: one rule for training and prediction."""
    import pyarrow.compute as pc

    return pc.utf8_split_whitespace(pc.utf8_lower(text))


def train(docs: DataFrame, path: str, rounds: int = ROUNDS, max_train_docs: int = MAX_TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities by language) from docs (doc_id, text, lang) with non-null text and lang.

    What comes to the driver is one row per language and piece with a count; the sample is bounded by max_train_docs.
    """
    spark = docs.sparkSession
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_docs).distinct()
    sample = docs.join(F.broadcast(chosen.select(F.col("doc_id").alias("_c"))), F.col("doc_id") == F.col("_c"), "left_semi")

    def split(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            lists = lower_words(batch.column(1))
            words, lang = lists.flatten(), batch.column(0).take(pc.list_parent_indices(lists))
            some = pc.not_equal(words, "")
            yield pa.RecordBatch.from_arrays([lang.filter(some), words.filter(some)], names=["lang", "word"])

    counted = sample.select("lang", "text").mapInArrow(split, "lang string, word string").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.repartition(8, "word").persist()
    try:
        langs = sorted(r.lang for r in counted.select("lang").distinct().collect())
        if not langs:
            return [], np.zeros((0, 0))
        size = loaded(path).size
        probs = np.full((size, len(langs)), 1.0 / size)
        for _ in range(rounds):
            handed = spark.sparkContext.broadcast((langs, probs.astype(np.float32)))

            def e_step(batches, handed=handed):
                vocab, (names, given) = loaded(path), handed.value
                sums = np.zeros((vocab.size, len(names)))
                for pdf in batches:
                    for i, name in enumerate(names):
                        own = pdf[pdf["lang"] == name]
                        if len(own):
                            sums[:, i] += expected_counts(vocab, given, own["word"].tolist(), own["n"].to_numpy(dtype=float), i)
                at = np.nonzero(sums)
                yield pd.DataFrame({"lang": at[1].astype("int32"), "piece": at[0].astype("int32"), "n": sums[at]})

            got = counted.mapInPandas(e_step, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
            counts = np.full((size, len(langs)), SMOOTHING)
            counts[got["piece"].to_numpy(), got["lang"].to_numpy()] += got["n"].to_numpy()
            probs = counts / counts.sum(axis=0)
            handed.unpersist()
        return langs, probs
    finally:
        counted.unpersist()


def _judged(batches, column: int, handed, path: str):
    """(slice of a batch, its languages, their scores) of all batches; texts are in the given column."""
    import pyarrow.compute as pc

    from .tokenfiles import slices

    (names, given), known, scores = handed.value, {}, np.zeros((0, 0))
    vocab = loaded(path) if names else None
    scores = np.zeros((0, len(names)))
    for batch in (part for big in batches for part in slices(big, column, 4_000_000)):
        n = batch.num_rows
        text = pc.fill_null(batch.column(column), "")
        judged = np.asarray(pc.match_substring_regex(text, r"\p{L}"), dtype=bool) if names else np.zeros(n, bool)
        lists = lower_words(text)
        words = pc.dictionary_encode(lists.flatten())
        where = np.asarray(lists.offsets)
        vocabulary, at = words.dictionary.to_pylist(), np.asarray(words.indices)
        if len(known) + len(vocabulary) > CACHE:
            known, scores = {}, np.zeros((0, len(names)))
        new = [w for w in vocabulary if w not in known]
        if new and names:
            known.update(zip(new, range(len(scores), len(scores) + len(new))))
            scores = np.concatenate([scores, word_scores(vocab, given, new)])
        label, score = np.full(n, "und", dtype=object), np.zeros(n)
        if names and len(at):
            own = scores[np.fromiter((known[w] for w in vocabulary), dtype=np.int64, count=len(vocabulary))]
            sums = np.vstack([np.zeros((1, len(names))), np.cumsum(own[at], axis=0)])
            total, count = sums[where[1:]] - sums[where[:-1]], np.maximum(np.diff(where), 1)
            best = np.argmax(total, axis=1)
            # tempered by length, so that long texts do not all score exactly 1
            share = np.exp((total - total.max(axis=1, keepdims=True)) / np.sqrt(count)[:, None])
            top = 1.0 / share.sum(axis=1)
            label[judged], score[judged] = np.array(names, dtype=object)[best[judged]], top[judged]
        yield batch, label, score
    known = scores = None
    give_back()


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str) -> DataFrame:
    """docs with lang_pred and score; score is the predicted language's share of the mean word likelihoods."""
    langs, probs = model
    handed = docs.sparkSession.sparkContext.broadcast((list(langs), probs))
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]

    def predict(batches):
        import pyarrow as pa

        for batch, label, score in _judged(batches, kept.index("text"), handed, path):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label, pa.string()), pa.array(score)], names=[*kept, "lang_pred", "score"])

    fields = [f for f in docs.schema.fields if f.name in kept]
    return docs.select(*kept).mapInArrow(predict, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def identified(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str, least_score: float) -> DataFrame:
    """The rows of docs, with all their own columns, whose language is known with at least this score."""
    handed, at = docs.sparkSession.sparkContext.broadcast((list(model[0]), model[1])), docs.columns.index("text")

    def keep(batches):
        import pyarrow as pa

        for batch, label, score in _judged(batches, at, handed, path):
            yield batch.filter(pa.array((label != "und") & (score >= least_score)))

    return docs.mapInArrow(keep, docs.schema)


def fold():
    return F.crc32(F.col("doc_id").cast("string")) % 3


def fit(docs: DataFrame, path: str | None = None, **options):
    path = path or vocabulary_path()
    return train(docs.where(fold() != 1).where("text is not null and lang is not null").select("doc_id", "text", "lang"), path, **options)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = vocabulary_path()
    model = fit(docs, path)
    out = identify(docs.select("doc_id", "text"), model, path)
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def crc_fold(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % 3
