"""Token counts by offset-mapped attribution.

A whole text is encoded once.  The byte lengths of its tokens give each token's span of characters; the spans are
joined to the text's sections (an interval join by binary search, as both are ordered and stand in one row), and
a token that crosses a boundary is given out by an explicit rule:

* `start`: to the section that holds its first character (the default);
* `end`: to the section that holds its last character;
* `largest`: to the section that holds most of its bytes, the earlier of equals;
* `split`: to each section in proportion to its bytes.

A section here is a line: it ends with its newline or the text's end.  `fields` other than the text's lines can be
given as a function from text to byte boundaries.

Defined cases: a null or empty text has one section, number 0, of no tokens; a line without text still is a section
(its newline's tokens fall to it); a token that begins inside a character (byte-level pieces of it) counts to the
section of that byte; rows that repeat a doc_id are counted row by row.  Texts of any length are encoded whole; an
empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
from pyspark.sql import DataFrame

from .common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
RULES = ("start", "end", "largest", "split")
SCHEMA = "section int, byte_start long, byte_end long, char_start long, char_end long, n_tokens double, n_crossing long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(2)
def encoder(path: str):
    """(encoding, byte length of each id)."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, i in ranks.items():
        size[i] = len(token)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def lines_of(data: np.ndarray) -> np.ndarray:
    """Byte offsets where the sections of a text begin; every one ends where the next begins."""
    cut = np.flatnonzero(data == 10) + 1
    return np.concatenate([[0], cut[cut < len(data)]]).astype(np.int64)


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, total: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens that begin there) of each section, for token spans in order."""
    k = len(sections)
    first = np.searchsorted(sections, starts, side="right") - 1
    last = np.searchsorted(sections, ends - 1, side="right") - 1
    crossing = np.bincount(first[last > first], minlength=k).astype(np.int64)
    if rule == "start":
        return np.bincount(first, minlength=k).astype(float), crossing
    if rule == "end":
        return np.bincount(last, minlength=k).astype(float), crossing
    bounds = np.append(sections, total)
    out = np.bincount(first[last == first], minlength=k).astype(float)
    for i in np.flatnonzero(last > first):  # few: only tokens across a boundary
        own = np.arange(first[i], last[i] + 1)
        part = np.minimum(ends[i], bounds[own + 1]) - np.maximum(starts[i], bounds[own])
        if rule == "split":
            out[own] += part / (ends[i] - starts[i])
        else:
            out[own[np.argmax(part)]] += 1
    return out, crossing


def token_counts(docs: DataFrame, rule: str = "start", path: str | None = None, key: str = "doc_id", text: str = "text", sections=lines_of) -> DataFrame:
    """One row per document and section: key and the columns of SCHEMA."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")
    path = path or vocabulary_path()
    kind = dict(docs.dtypes)[key]

    def count(batches):
        import pyarrow as pa

        encoding, size = encoder(path)
        for batch in batches:
            rows = [[] for _ in range(7)]
            which = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                data = np.frombuffer((t or "").encode(), dtype=np.uint8)
                begin = sections(data) if len(data) else np.zeros(1, dtype=np.int64)
                ids = np.asarray(encoding.encode_ordinary(t), dtype=np.int64) if t else np.zeros(0, dtype=np.int64)
                ends = np.cumsum(size[ids])
                n, crossing = attribute(ends - size[ids], ends, begin, len(data), rule)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                stop = np.append(begin[1:], len(data))
                which.append(np.full(len(begin), i))
                for column, values in zip(rows, (np.arange(len(begin), dtype=np.int32), begin, stop, chars[begin], chars[stop], n, crossing)):
                    column.append(values)
            if which:
                keys = batch.column(0).take(pa.array(np.concatenate(which)))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(np.concatenate(c)) for c in rows)], names=[key, "section", "byte_start", "byte_end", "char_start", "char_end", "n_tokens", "n_crossing"])

    return docs.select(key, text).mapInArrow(count, f"`{key}` {kind}, {SCHEMA}")


def query(spark, sf_dir):
    out = token_counts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "section", "char_start", "char_end", out["n_tokens"].cast("long").alias("n_tokens"), "n_crossing")
