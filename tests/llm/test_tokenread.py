"""Sequences of token files by number."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cellframe.llm import tokenfiles, tokenread


def test_any_sequence_and_document_without_copying(spark, tmp_path):
    r = random.Random(2)
    texts = {i: " ".join(r.choice(["a", "the", "Wörter", "x1", "\n"]) for _ in range(r.randrange(0, 400))) for i in range(40)} | {40: None, 41: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    folder = str(tmp_path / "tokens")
    manifest = tokenfiles.write_tokens(docs, folder, length=16, file_tokens=3000).collect()
    tok, seen = tokenfiles.tokenizer(tokenfiles.vocabulary_path()), []
    for f in manifest:
        path = f"{folder}/{f.file}"
        with open(path, "rb") as own:
            whole = own.read()
        for source in (path, pa.py_buffer(whole)):
            s = tokenread.Sequences(source)
            assert len(s) == -(-f.n_tokens // 16) and s.length == 16
            want = np.concatenate([tok.encode(texts[s.document(k)[0]] or "", add_special_tokens=False).ids + [tokenfiles.END] for k in range(f.n_docs)])
            flat = np.concatenate([s[k] for k in range(len(s))])
            assert (flat[: len(want)] == want).all() and not flat[len(want) :].any()
            assert [m for k in range(len(s)) for m in s.mask(k).to_pylist()] == [i < len(want) for i in range(16 * len(s))]
            ends = np.cumsum([len(s.document(k)[1]) for k in range(f.n_docs)])
            assert ends[-1] == f.n_tokens and all((s.document(k)[1] == want[(ends[k - 1] if k else 0) : ends[k]]).all() for k in range(f.n_docs))
            if source is not path:  # a sequence is a view of the file's bytes
                at = s[len(s) - 1].__array_interface__["data"][0]
                assert source.address <= at < source.address + source.size
            for bad in (-1, len(s)):
                with pytest.raises(IndexError):
                    s[bad]
            with pytest.raises(IndexError):
                s.document(f.n_docs)
        seen += [s.document(k)[0] for k in range(f.n_docs)]
    assert seen == sorted(texts)
