"""A training corpus from `documents`: language ID, near copies, benchmark leaks, mixing, token files.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of documents.  run() writes each stage's result to the shared folder and reads it again.

Every stage judges rows, not ids: rows that repeat a doc_id, or have none, are judged by their own texts.  Null and
empty texts have no language and go in the first stage; an empty table stays empty; columns beyond those of documents
pass through unchanged, whatever their names; texts are read whole, however long.  Of rows equal in doc_id and text one
stays after the near copies; the mix may repeat rows, which then stand one after the other in the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellframe.llm import decontaminate, jaccard, langid, mixing, tokenfiles
from cellframe.llm.common import staged, table

#: Least score of a language that counts as identified.
LEAST_SCORE = 0.5
#: Near copies: shingles of five words, similarity of 0.8 and more.
SHINGLE, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; `und` and scores below LEAST_SCORE go."""
    path = langid.vocabulary_path()
    return langid.identified(docs, langid.fit(docs, path), path, LEAST_SCORE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that with the smallest doc_id."""
    return jaccard.one_of_each(docs, size=SHINGLE, percent=PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or dropped so that sources come near their targets."""
    return mixing.emit_copies(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' digest: doc_id, start, n_tokens, ids_crc32 of every document in them."""
    return tokenfiles.tokenized(docs)


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", decontamination), ("mixing sources", mix), ("token files", token_files)]

#: Language ID, decontamination and tokens are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"pipeline{k}")
    return docs
