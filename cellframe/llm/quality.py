"""Quality rules: base rules on words and lines, then a hashed n-gram log-likelihood ratio.

Every document's word unigrams and bigrams fall into 2^16 hash buckets.  Two multinomials are counted: one over
all documents (raw corpus), one over trusted documents.  A document's score is the sum over its n-grams of
log p_trusted - log p_raw, divided by their number; it is kept if no base rule fails and the score reaches a
fixed threshold.  All of it is built-in Spark expressions: counting is one partial aggregate into at most 2^16
groups, scoring looks the ratio up in an array that a scalar subquery carries, without a shuffle of documents.

The trusted documents are at most `max_trusted` labelled rows of quality 1 that are not toxic, those with the
smallest hash of doc_id; corpus counts cover every document.

Defined cases: a null text is empty; a text without words has score 0 and fails the base rules; without labels
both multinomials are the raw one, so every score is 0; a repeated doc_id is judged row by row; other columns
are kept, whatever their names, but for those that the results replace.  Texts of any length are judged whole; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, boxed, table, text_of, unboxed, words_of

BITS = 16
SMOOTHING = 0.5
#: Bound on the trusted sample, and so on what is broadcast: 8 bytes each.
MAX_TRUSTED = 100_000
THRESHOLD = -0.2
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def base_columns(df: DataFrame, text: str = "_text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; needs array _words."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", lines)
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.translate(F.col(text), BLANKS, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(F.col(text), SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_runs": F.col("_hashes"),
        }
    ).drop("_lines")
    # hashes of runs of two words, of four from those, of eight: a column each, as an array that a lambda looks into must stand
    def longer(k: int) -> Column:
        return F.transform("_runs", lambda h, i: F.xxhash64(h, F.get("_runs", i + k)))

    for k in (1, 2, 4):
        df = df.withColumn("_runs", longer(k))
    # the last WINDOW - 1 runs are cut short
    df = df.withColumn("_windows", F.slice("_runs", 1, F.greatest(F.size("_hashes") - (WINDOW - 1), F.lit(0)))).drop("_runs")
    # only texts with a repeated window sort theirs
    df = df.withColumn(
        "_sorted",
        F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        ),
    ).drop("_windows")

    def twice(x: Column, j: Column) -> Column:
        return (F.get("_sorted", j - 1)["h"].eqNullSafe(x["h"])) | (F.get("_sorted", j + 1)["h"].eqNullSafe(x["h"]))

    df = df.withColumn("_at", F.array_sort(F.transform(F.filter("_sorted", twice), lambda x: x["i"]))).drop("_sorted")
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end")),
        lambda a: a["n"].cast("long"),
    )
    df = df.withColumn("n_repeat_words", covered).drop("_at")
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def with_words(docs: DataFrame) -> DataFrame:
    """Adds _text, _words and _hashes (one hash a word)."""
    df = docs.withColumn("_text", text_of())
    df = df.withColumn("_words", words_of(F.col("_text")))
    return df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))


def gram_buckets(bits: int = BITS) -> Column:
    """Buckets of the unigrams and bigrams of _hashes; a bigram's hash mixes its two words' hashes in order."""
    mask = (1 << bits) - 1
    one = F.transform("_hashes", lambda h: h.bitwiseAND(mask).cast("int"))
    two = F.transform(
        F.slice("_hashes", 2, F.greatest(F.size("_hashes") - 1, F.lit(0))),
        lambda h, i: F.xxhash64(h, F.get("_hashes", i)).bitwiseAND(mask).cast("int"),
    )
    return F.concat(one, two)


def ratio_table(docs: DataFrame, trusted: DataFrame, bits: int = BITS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row: array of 2^bits log ratios, from all docs and those whose doc_id is in trusted (distinct, bounded)."""
    b = 1 << bits
    marked = with_words(docs.select("doc_id", "text")).join(F.broadcast(trusted.select(F.col("doc_id").alias("_tid"))), F.col("doc_id") == F.col("_tid"), "left")
    grams = marked.select(F.col("_tid").isNotNull().cast("long").alias("t"), gram_buckets(bits).alias("g")).select("t", F.explode_outer("g").alias("bucket"))
    # explode_outer: for explode, Catalyst infers a filter on the array's size and would compute the array twice, nested
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("trusted"))
    every = docs.sparkSession.range(b).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(counts.where("bucket is not null")), "bucket", "left").na.fill(0)
    # both counts of all buckets stand in one row: 2^bits entries whatever the corpus
    packed = every.agg(F.array_sort(F.collect_list(F.struct("bucket", "raw", "trusted"))).alias("c"), F.sum("raw").alias("r"), F.sum("trusted").alias("t"))
    # the trusted multinomial is shrunk towards the raw one by 2^bits counts: few trusted words say little
    p = lambda x: (x["raw"] + smoothing) / (F.col("r") + smoothing * b)
    ratio = lambda x: F.log((x["trusted"] + b * p(x)) / (F.col("t") + b)) - F.log(p(x))
    return packed.select(F.when(F.col("t") > 0, F.transform("c", ratio)).otherwise(F.array_repeat(F.lit(0.0), b)).alias("llr"))


def trusted_ids(labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bits: int = BITS, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """docs with the base columns, base_failed, llr (null-free double) and kept, which replace columns of these names."""
    llr = ratio_table(docs, trusted_ids(labels, max_trusted), bits)
    df = with_words(docs.select(boxed(docs), "text")).withColumn("_llr", llr.scalar())
    mask = (1 << bits) - 1
    at = lambda h: F.element_at("_llr", h.bitwiseAND(mask).cast("int") + 1)
    # a word's unigram and the bigram that ends with it, in one pass over the hashes
    pair = lambda h, i: F.when(i == 0, 0.0).otherwise(at(F.xxhash64(h, F.get("_hashes", i - 1))))
    total = F.aggregate(F.transform("_hashes", lambda h, i: at(h) + pair(h, i)), F.lit(0.0), lambda a, x: a + x)
    n = F.greatest(2 * F.size("_hashes") - 1, F.lit(1))
    df = base_columns(df.withColumn("llr", F.round(total / n, 9)).drop("_llr"))
    out = df.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    return out.select(*unboxed(docs, RESULTS), *RESULTS)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_rules(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
