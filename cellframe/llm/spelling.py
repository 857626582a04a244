"""Spelling variants: words one edit apart, found through an index of variable-length grams.

1. Words are counted over all texts.
2. The gram dictionary holds the frequent grams of LEAST_GRAM to MOST_GRAM letters, grown a letter at a time: a gram
   that fewer than a SHARE-th of the bigrams hold is not extended, so a level has at most SHARE entries, however many
   words there are.
3. A word is decomposed into variable-length grams: at each place the shortest gram that is not frequent, of q letters
   at most, without those that lie in an earlier one.  An edit before letter i can change only grams that end in
   (i, i + q]: those over the place, and those that a changed gram to their left may now cover.  The largest number
   of them is the word's bound of affected grams, b.
4. Lists: a word is entered under its b + 1 rarest grams, with their place and the shorter length of a pair.  A gram that
   an edit leaves alone keeps its place, or moves by one if it stands behind an insertion, so words one edit
   apart meet in a list.  With q at most half the shorter length, b is less than the number of grams of a word, so no pair is missed.
   Pairs within a list are verified.
5. Grams that more than HOT words hold have no list: their words are entered under what is left of them without each letter
   in turn, which again brings all pairs together.  Lists that grow beyond LONG_LIST are split in the same way by the task that holds them.

Defined cases: null and empty texts have no words; a null doc_id counts as the empty string before the colon; rows that repeat
a doc_id count each; words of any length count whole; of near words of equal count the first in code-point order is the form.
An empty table gives an empty result; other columns of the table are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import give_back, staged, table

#: Letters of a word at least, its occurrences at least, how much more frequent a form is than its variant.
LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
LEAST_GRAM, MOST_GRAM = 2, 6
#: Frequent: at least FEW occurrences, and one in SHARE of all bigrams.
SHARE, FEW = 50_000, 32
#: Occurrences above which a gram has no list; entries above which a list is split; entries of a task; letters compared at once.
HOT, LONG_LIST, BUCKET, CELLS = 20_000, 512, 60_000, 1 << 22


def counted(docs: DataFrame, spoil: int | None = 31) -> DataFrame:
    """(word, n) of docs (doc_id, text): maximal runs of letters, A-Z lower-cased, of LEAST_LETTERS and more, found LEAST_COUNT times and more.

    spoil: a run loses the letter h % length if it divides h, the crc32 of `<doc_id>:<run>` (None: never).
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-zÀ-ÿ]{%d,}" % LEAST_LETTERS), F.lit(0))).alias("run")
    lower = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run).select("id", lower.alias("word"))
    if spoil:
        words = words.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
        at = (F.col("h") % F.length("word")).cast("int")
        words = words.select(F.when(F.col("h") % spoil == 0, F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))).otherwise(F.col("word")).alias("word"))
    return words.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def by_length(words: list[str]):
    """(length, numbers of the words, matrix of code points) of words of one length, some at a time."""
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for k in np.unique(size):
        own = np.flatnonzero(size == k)
        step = max(1, CELLS // max(int(k), 1))
        for i in range(0, len(own), step):
            at = own[i : i + step]
            yield int(k), at, np.frombuffer("".join(words[j] for j in at).encode("utf-32-le"), dtype=np.uint32).reshape(len(at), k)


def gram_hashes(m: np.ndarray, top: int) -> list[np.ndarray]:
    """At g: hashes of the grams of g letters at each place of each word; none for g = 0."""
    letters = m.astype(np.uint64)
    out = [letters[:, :0], textnum.mix(letters + np.uint64(1))]
    for g in range(2, top + 1):
        out.append(textnum.mix(out[-1][:, :-1] * np.uint64(0x9FB21C651E98DF25) + letters[:, g - 1 :] + np.uint64(g)))
    return out


def occurrences(h: np.ndarray, level: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How often each gram occurs if it is frequent, else 0.  level: sorted hashes of frequent grams, their counts."""
    known, count = level
    if not len(known):
        return np.zeros(h.shape, dtype=np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, count[at], 0)


def dictionary(words: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Frequent grams by length: (sorted hashes, counts)."""
    levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    least = None
    for g in range(LEAST_GRAM, MOST_GRAM + 1):
        shorter = levels.get(g - 1)

        def count(batches, g=g, shorter=shorter):
            import pyarrow as pa

            for batch in batches:
                found = []
                for length, _, m in by_length(batch.column(0).to_pylist()):
                    if length >= g:
                        h = gram_hashes(m, g)
                        found.append(h[g].ravel() if shorter is None else h[g][occurrences(h[g - 1][:, : length - g + 1], shorter) > 0])
                value, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

        grams = words.select("word").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        if least is None:
            grams = staged(grams, "bigrams")
            least = max(FEW, -(-(grams.agg(F.sum("n")).first()[0] or 0) // SHARE))
        rows = grams.where(F.col("n") >= least).collect()  # SHARE rows at most
        hashes = np.array([r.gram for r in rows], dtype=np.int64).view(np.uint64)
        order = np.argsort(hashes)
        levels[g] = hashes[order], np.array([r.n for r in rows], dtype=np.int64)[order]
    return levels


def longest_gram(length):
    """Letters of the longest grams for pairs whose shorter word has this length: half of it, within bounds."""
    return min(MOST_GRAM, max(LEAST_GRAM + 1, length // 2))


def decompose(m: np.ndarray, q: int, levels: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kept, letters, hash, count) of the gram at each place of words of one length, and the words' bounds of affected grams."""
    length = m.shape[1]
    hashes = gram_hashes(m, q)
    letters = np.full((len(m), length - 1), LEAST_GRAM)
    h = hashes[LEAST_GRAM].copy()
    count = occurrences(h, levels[LEAST_GRAM])
    for g in range(LEAST_GRAM, q):
        # of the places whose gram is still g letters long, frequent, and followed by another letter
        width = length - g
        more = (letters[:, :width] == g) & (count[:, :width] > 0)
        letters[:, :width][more] = g + 1
        h[:, :width][more] = hashes[g + 1][more]
        count[:, :width][more] = occurrences(hashes[g + 1][more], levels[g + 1])
    end = np.arange(length - 1) + letters
    kept = np.ones(end.shape, dtype=bool)
    kept[:, 1:] = end[:, 1:] > np.maximum.accumulate(end, axis=1)[:, :-1]
    ends = np.zeros((len(m), length + 1), dtype=np.int64)
    row, place = np.nonzero(kept)
    ends[row, end[row, place]] = 1
    upto = np.cumsum(ends, axis=1)
    i = np.arange(length + 1)
    return kept, letters, h, count, (upto[:, np.minimum(i + q, length)] - upto).max(axis=1)


def rarest(kept, letters, h, count, bound) -> np.ndarray:
    """Which grams are among the bound + 1 rarest of their word, with all that equal the last of them."""
    cost = np.where(kept, count * 16 + (MOST_GRAM - letters), np.iinfo(np.int64).max)
    order = np.lexsort((h, cost), axis=1)
    if (bound >= kept.sum(axis=1)).any():
        raise AssertionError("an edit may affect all grams of a word")
    row = np.arange(len(h))
    last = order[row, bound]
    c, x = cost[row, last][:, None], h[row, last][:, None]
    return kept & ((cost < c) | ((cost == c) & (h <= x)))


def holes(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words of one length: whole, and without each letter in turn."""
    code = textnum.mix(m.astype(np.uint64) + np.uint64(1))
    power = textnum._powers(m.shape[1] + 1)
    whole = np.cumsum(code * power[:-1], axis=1)
    shifted = np.cumsum(code[:, 1:] * power[:-2], axis=1)
    zero = np.zeros((len(m), 1), dtype=np.uint64)
    before, behind = np.hstack([zero, whole[:, :-1]]), np.hstack([zero, shifted])
    return textnum.mix(whole[:, -1]), textnum.mix(before + (behind[:, -1:] - behind))


def tagged(h: np.ndarray, *tags) -> np.ndarray:
    for t in tags:
        h = textnum.mix(h * np.uint64(0xD1342543DE82EF95) + np.asarray(t).astype(np.uint64))
    return h


def hole_entries(m: np.ndarray, longer: bool) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, key) under which words of one length meet their partners of that length and one letter more; longer: of one less."""
    length = m.shape[1]
    whole, without = holes(m)
    row = np.arange(len(m))
    if longer:
        key = np.sort(tagged(without, length - 1, 1), axis=1)
        new = np.hstack([np.ones((len(m), 1), bool), key[:, 1:] != key[:, :-1]])
        return np.nonzero(new)[0], key[new]
    return np.append(np.repeat(row, length), row), np.append(tagged(without, length, 2, np.arange(length)[None, :]).ravel(), tagged(whole, length, 1))


ENTRY = "key long, longer boolean, word string, n long"


def entries(words: DataFrame, levels: dict) -> DataFrame:
    """(key, longer, word, n): the lists in which a word meets those of its own length and longer ones, or shorter ones."""
    handed = words.sparkSession.sparkContext.broadcast(levels)

    def work(batches):
        import pyarrow as pa

        levels = handed.value
        for batch in batches:
            words, n = batch.column(0).to_pylist(), np.asarray(batch.column(1))
            for length, at, m in by_length(words):
                for longer in (False, True):
                    short = length - longer
                    if short < LEAST_LETTERS:
                        continue
                    kept, letters, h, count, bound = decompose(m, longest_gram(short), levels)
                    chosen = rarest(kept, letters, h, count, bound)
                    hot = (chosen & (count > HOT)).any(axis=1)
                    row, place = np.nonzero(chosen & (count <= HOT))
                    key = tagged(h[row, place], short, 0)
                    if longer:
                        moved = place > 0
                        row, key = np.append(row, row[moved]), np.append(tagged(key, place), tagged(key, place - 1)[moved])
                    else:
                        key = tagged(key, place)
                    if hot.any():
                        some = np.flatnonzero(hot)
                        r, k = hole_entries(m[some], longer)
                        row, key = np.append(row, some[r]), np.append(key, k)
                    own = at[row]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(key), longer)), batch.column(0).take(pa.array(own)), pa.array(n[own])], names=["key", "longer", "word", "n"])
        give_back()

    return words.select("word", "n").mapInArrow(work, ENTRY)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return first, np.diff(np.append(first, len(values)))


def listed_pairs(left_first, left_count, right_first, right_count, same: bool, step: int):
    """Pairs (x, y) of each list's left and right members, given as runs; same: x before y; about `step` pairs at a time."""
    x = np.repeat(left_first, left_count) + np.arange(left_count.sum()) - np.repeat(np.cumsum(left_count) - left_count, left_count)
    end = np.repeat(right_first + right_count, left_count)
    begin = x + 1 if same else np.repeat(right_first, left_count)
    many = end - begin
    x, begin, many = x[many > 0], begin[many > 0], many[many > 0]
    total, at = np.cumsum(many), 0
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + step, side="right")))
        k = many[at:to]
        yield np.repeat(x[at:to], k), np.repeat(begin[at:to], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        at = to


def near_pairs(keys: np.ndarray, longer: np.ndarray, words: list[str]) -> np.ndarray:
    """Pairs (row of a word, row of a word of its length or one letter more) that share a key and are one edit apart."""
    short = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) - longer
    out = []
    for length in np.unique(short):
        own = np.flatnonzero(short == length)
        order = own[np.lexsort((longer[own], keys[own]))]
        first, count = runs(keys[order])
        large = np.repeat(count > LONG_LIST, count)
        if large.any():  # such lists are split by what is left of their words without a letter
            rows, parts = order[large], []
            for side in (False, True):
                some = rows[longer[rows] == side]
                for _, at, m in by_length([words[i] for i in some]):
                    r, k = hole_entries(m, side)
                    parts.append((k.view(np.int64), some[at][r]))
            key, row = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            key, row = np.append(key, keys[order[~large]]), np.append(row, order[~large])
            by = np.lexsort((longer[row], key))
            key, order = key[by], row[by]
            first, count = runs(key)
        alone = np.repeat(count < 2, count)
        first, count, order = first[count > 1], count[count > 1], order[~alone]
        if not len(order):
            continue
        first = np.cumsum(count) - count
        n_long = np.add.reduceat(longer[order].astype(np.int64), first)
        a, b = order[~longer[order]], order[longer[order]]
        n_short = count - n_long
        first_a, first_b = np.cumsum(n_short) - n_short, np.cumsum(n_long) - n_long
        matrix = lambda rows, width: np.frombuffer("".join(words[i] for i in rows).encode("utf-32-le"), dtype=np.uint32).reshape(len(rows), width)
        ma, mb, step = matrix(a, length), matrix(b, length + 1), max(1, CELLS // int(length))
        for x, y in listed_pairs(first_a, n_short, first_a, n_short, True, step):
            hit = (ma[x] != ma[y]).sum(axis=1) == 1
            out.append(np.stack([a[x[hit]], a[y[hit]]], axis=1))
        for x, y in listed_pairs(first_a, n_short, first_b, n_long, False, step):
            # the letters that agree from the front and from behind cover the shorter word
            one, two = ma[x], mb[y]
            front, behind = one == two[:, :-1], (one == two[:, 1:])[:, ::-1]
            may = front[:, 0] | behind[:, 0]
            front, behind, x, y = front[may], behind[may], x[may], y[may]
            agree = lambda e: np.where(e.all(axis=1), length, np.argmin(e, axis=1))
            hit = agree(front) + agree(behind) >= length
            out.append(np.stack([a[x[hit]], b[y[hit]]], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each pair of words (word, n) that differ by one inserted, deleted or replaced letter, both ways round."""
    n_words = words.count()
    buckets = max(1, n_words * 14 // BUCKET)

    def verify(tab):
        import pyarrow as pa

        words, n = tab.column("word").combine_chunks(), np.asarray(tab.column("n"))
        found = near_pairs(np.asarray(tab.column("key")), np.asarray(tab.column("longer")).astype(bool), words.to_pylist())
        x, y = np.append(found[:, 0], found[:, 1]), np.append(found[:, 1], found[:, 0])
        return pa.table({"word": words.take(pa.array(x)), "n": n[x], "other": words.take(pa.array(y)), "other_n": n[y]})

    rows = entries(words, dictionary(words)).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    pairs = rows.groupBy("bucket").applyInArrow(lambda tab: verify(tab), "word string, n long, other string, other_n long")
    return pairs.dropDuplicates(["word", "other"])


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of word's forms.  A form is TIMES as frequent, so chains are short; each round halves them."""
    known = forms.select(F.col("word").alias("at"), "form")
    found = forms.select("word", F.col("form").alias("root"))
    while True:
        step = staged(found.join(known, F.col("root") == F.col("at"), "left").select("word", F.coalesce("form", "root").alias("root"), F.col("form").isNotNull().alias("moved")), "roots")
        found = step.select("word", "root")
        if not step.where("moved").head(1):
            return found
        known = found.select(F.col("word").alias("at"), F.col("root").alias("form"))


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of words (word, n)."""
    words = staged(words, "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    taken = -F.col("best.less") >= TIMES * F.col("n")
    own = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"))
    own = staged(own, "near")
    roots = roots_of(own.where("form is not null").select("word", "form"))
    return own.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir):
    return variants(counted(table(spark, sf_dir, "documents")))


SQL = """
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce(list_concat([i::bigint], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end)) as t
), found as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents
), grouped as (select doc_id, run, count(*) as c from found where length(run) >= 7 group by 1, 2),
hashed as (
  select run, c, xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(range(length(hex(encode(s))) // 2), lambda i: ('0x' || substr(hex(encode(s)), 2 * i + 1, 2))::bigint)),
    lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]))) as h
  from (select run, c, coalesce(doc_id::varchar, '') || ':' || run as s from grouped), crc
), words as (
  select w as word, sum(c)::bigint as n from (select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as w, c from hashed)
  where length(w) >= 7 group by 1 having sum(c) >= 2
), cut as (select distinct word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(length(word))) as i from words)),
near as (
  select a.word, a.n, b.word as other, b.n as other_n from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, a.n, b.word, b.n from cut a join words b on a.rest = b.word
  union select b.word, b.n, a.word, a.n from cut a join words b on a.rest = b.word
), best as (
  select word, n, count(*) as n_near, first(other order by other_n desc, other) as other, max(other_n) as other_n from near group by word, n
), forms as (select word, other as form, other_n as form_n from best where other_n >= 10 * n),
chain as (
  select word, form as root, 1 as k from forms union select c.word, f.form, c.k + 1 from chain c join forms f on f.word = c.root
), roots as (select word, arg_max(root, k) as root from chain group by word)
select w.word, f.form, coalesce(r.root, w.word) as root, w.n, coalesce(b.n_near, 0) as n_near, f.form_n
from words w left join best b on w.word = b.word left join forms f on w.word = f.word left join roots r on w.word = r.word
"""
