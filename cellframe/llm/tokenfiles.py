"""Token ids in Arrow stream files of fixed-size lists.

Documents are dealt by ranges of doc_id and ordered within; each task encodes its range and writes files in the
shared folder.  A file is an Arrow IPC stream whose batches have two columns: `ids`, a fixed-size list of
`length` ids (16-bit where the vocabulary allows, else 32-bit), and `mask`, a fixed-size list of as many bits,
false on the padding after the last id.  A memory-mapped or whole file gives any sequence without copying.
After that stream's end follows a second one in the same file, with one row per document: doc_id and n_tokens, in order.
A file holds about `file_tokens` ids at most, whatever the range holds, and one document at least.

Encoding: the vocabulary's rule never joins across the place before a blank that is followed by something else, so
texts are cut there, the distinct cuts of a batch are encoded once by the tokenizers library, and their ids are
put together again.  A text with a blank before other white space is encoded whole.

Defined cases: a null text has no ids but the end id; an empty table writes no file; rows that repeat a doc_id
are documents of their own, in an order fixed by the hashes of their texts between tasks and by their texts within one;
null doc_ids come first; columns other than doc_id and text are not read.  `tokenread` gives any sequence by its number.
"""

from __future__ import annotations

import functools
import os
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, shared_dir, small_side, staged, table

VOCABULARY = "byte_bpe_50k.json"
END = 2
LENGTH = 2048
BATCH = 64
FILE_TOKENS = 4_000_000
CACHE = 600_000
MANIFEST = "file string, first_id long, part int, seq int, n_tokens long, n_docs long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Encodes batches of texts; remembers the ids of the cuts it has seen."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = tokenizer(path)
        self.wide = self.tok.get_vocab_size() > 65536
        # ids whose first byte is a blank: within cuts that begin with one and have no other, those that begin a cut
        self.blank = np.zeros(max(self.tok.get_vocab(True).values()) + 1, dtype=bool)
        self.blank[[i for t, i in self.tok.get_vocab(True).items() if t.startswith("Ġ")]] = True
        self._reset()

    def _reset(self):
        import pyarrow as pa

        self.known = pa.array([], pa.string())
        self.flat, self.begin = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def cuts(self, words) -> np.ndarray:
        """Rows of self.flat / self.begin of the distinct words of an Arrow array, each with a blank in front."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.known) + len(words) > CACHE:
            self._reset()
        rows = pc.index_in(words, value_set=self.known)
        new = words.filter(rows.is_null())
        if not len(new):
            return np.asarray(rows).astype(np.int64)
        # encoded as a few texts, as a call costs more than a cut; their ids are told apart by the blank in front
        bounds = np.append(np.arange(0, len(new), 2000), len(new)).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), new), " ").to_pylist()
        ids = np.concatenate([np.array(e, dtype=np.uint32) for e in self._ids([" " + t for t in joined])])
        begin = np.append(np.flatnonzero(self.blank[ids]), len(ids))
        if len(begin) != len(new) + 1:  # a cut that the vocabulary's rule splits oddly: one by one
            each = self._ids([" " + w for w in new.to_pylist()])
            ids = np.array([x for e in each for x in e], dtype=np.uint32)
            begin = np.concatenate([[0], np.cumsum([len(e) for e in each])])
        rows = np.array(rows.fill_null(-1)).astype(np.int64)
        rows[rows < 0] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, new])
        self.begin = np.concatenate([self.begin, len(self.flat) + begin[1:]])
        self.flat = np.concatenate([self.flat, ids])
        return rows

    def encode(self, text) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with the end id after each, number of ids of each) of an Arrow string column without nulls."""
        import pyarrow as pa
        import pyarrow.compute as pc

        n = len(text)
        whole = np.asarray(pc.match_substring_regex(text, r" [\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|^ | $"), dtype=bool)
        plain = pc.if_else(pa.array(whole), pa.scalar("", text.type), text)
        lists = pc.split_pattern(plain, " ")
        where = np.asarray(lists.offsets).astype(np.int64)
        flat = lists.flatten()
        head = where[:-1]
        # a text's first cut has no blank before it
        first = flat.take(pa.array(head)).to_pylist()
        rest = np.ones(len(flat), dtype=bool)
        rest[head] = False
        tail = pc.dictionary_encode(flat.filter(pa.array(rest)))
        rows = self.cuts(tail.dictionary)[np.asarray(tail.indices)] if len(tail) else np.zeros(0, np.int64)
        strings = text.filter(pa.array(whole)).to_pylist()
        special = np.flatnonzero(whole)
        lone = list(dict.fromkeys(first))
        lone_ids = dict(zip(lone, self._ids(lone)))
        single = [lone_ids[x] for x in first]
        for i, ids in zip(special, self._ids(strings)):
            single[i] = ids
        # sources: flat cuts, then each text's own first part, then the end id
        own = np.fromiter((x for e in single for x in e), dtype=np.uint32)
        own_size = np.fromiter(map(len, single), dtype=np.int64, count=n)
        pool = np.concatenate([self.flat, own, np.array([END], dtype=np.uint32)])
        cut_start, cut_size = self.begin[:-1][rows], np.diff(self.begin)[rows]
        per_text = np.diff(where) - 1
        order_pos = np.concatenate([[0], np.cumsum(per_text + 2)])
        starts, sizes = np.empty(order_pos[-1], np.int64), np.empty(order_pos[-1], np.int64)
        starts[order_pos[:-1]], sizes[order_pos[:-1]] = len(self.flat) + np.cumsum(own_size) - own_size, own_size
        starts[order_pos[1:] - 1], sizes[order_pos[1:] - 1] = len(pool) - 1, 1
        inner = np.ones(order_pos[-1], dtype=bool)
        inner[order_pos[:-1]] = inner[order_pos[1:] - 1] = False
        starts[inner], sizes[inner] = cut_start, cut_size
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)
        total = np.concatenate([[0], ends])
        return pool[at], total[order_pos[1:]] - total[order_pos[:-1]]


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each worker process, so that its cuts serve later tasks too."""
    return Encoder(path)


def slices(batch, column: int, most: int = 4_000_000):
    """batch in parts whose texts have about `most` bytes, one row at least."""
    import pyarrow.compute as pc

    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


class Writer:
    """One task's files: <folder>/part-PPPPP-SSSSS.arrow, each put in place by a rename when it is whole."""

    def __init__(self, folder: str, part: int, length: int, wide: bool):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        self.fs.create_dir(self.root, recursive=True)
        self.part, self.length, self.dtype, self.seq, self.made = part, length, np.uint32 if wide else np.uint16, 0, []
        self._clear()

    def _clear(self):
        self.ids, self.docs, self.sizes, self.held = [], [], [], 0

    def add(self, ids: np.ndarray, docs: list, sizes: np.ndarray):
        self.ids.append(ids.astype(self.dtype))
        self.docs += docs
        self.sizes.append(sizes)
        self.held += len(ids)

    def _put(self, name: str, *streams):
        """Write the streams, each (schema, batches), one after the other."""
        import uuid

        import pyarrow as pa

        temporary = f"{self.root}/_{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temporary) as out:
            for schema, batches in streams:
                with pa.ipc.new_stream(out, schema) as writer:
                    for b in batches:
                        writer.write_batch(b)
        # a repeated attempt writes the same file again; not every store lets a rename replace one
        from pyarrow.fs import FileType

        if self.fs.get_file_info(f"{self.root}/{name}").type != FileType.NotFound:
            self.fs.delete_file(f"{self.root}/{name}")
        self.fs.move(temporary, f"{self.root}/{name}")

    def close(self):
        import pyarrow as pa

        if not self.docs:
            return
        ids = np.concatenate(self.ids)
        sizes = np.concatenate(self.sizes)
        n, rows = len(ids), -(-len(ids) // self.length)
        full = np.zeros(rows * self.length, dtype=self.dtype)
        full[:n] = ids
        kind = pa.uint32() if self.dtype is np.uint32 else pa.uint16()
        schema = pa.schema([("ids", pa.list_(kind, self.length)), ("mask", pa.list_(pa.bool_(), self.length))])

        def batches():
            for r in range(0, rows, BATCH):
                values = full[r * self.length : (r + BATCH) * self.length]
                mask = np.arange(r * self.length, r * self.length + len(values)) < n
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(values), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=schema)

        name = f"part-{self.part:05d}-{self.seq:05d}"
        index = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        docs = pa.RecordBatch.from_arrays([pa.array(self.docs, pa.int64()), pa.array(sizes)], schema=index)
        self._put(f"{name}.arrow", (schema, batches()), (index, [docs]))
        self.made.append((f"{name}.arrow", self.docs[0], self.part, self.seq, n, len(self.docs)))
        self.seq += 1
        self._clear()


def write_tokens(docs: DataFrame, folder: str, length: int = LENGTH, file_tokens: int = FILE_TOKENS, path: str | None = None) -> DataFrame:
    """Write all docs (doc_id, text) and return the manifest: one row per file, in MANIFEST's columns."""
    path = path or vocabulary_path()
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        give_back()
        encode = encoder(path)
        writer = Writer(folder, TaskContext.get().partitionId(), length, encode.wide)
        for big in batches:
            for batch in slices(big, 1):
                ids, sizes = encode.encode(batch.column(1))
                keys = batch.column(0).to_pylist()
                ends = np.cumsum(sizes)
                done = 0
                while done < len(keys):  # as many documents as the file still takes, one at least
                    room = file_tokens - writer.held + (ends[done - 1] if done else 0)
                    upto = max(int(np.searchsorted(ends, room, side="right")), done + (not writer.docs))
                    if upto > done:
                        low = ends[done - 1] if done else 0
                        writer.add(ids[low : ends[upto - 1]], keys[done:upto], sizes[done:upto])
                    done = upto
                    if done < len(keys):
                        writer.close()
        writer.close()
        give_back()
        cols = list(zip(*writer.made)) or [[]] * 6
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["file", "first_id", "part", "seq", "n_tokens", "n_docs"])

    return staged(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_documents(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    base = F.sum("n_tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    # the window's rows are files, not documents
    based = small_side(staged(manifest.select("file", F.coalesce(base, F.lit(0)).alias("base")), "bases"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.arrow").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for base_, content in zip(batch.column("base").to_pylist(), batch.column("content")):
                source = pa.BufferReader(content.as_buffer())
                sequences = list(pa.ipc.open_stream(source))
                own = pa.ipc.open_stream(source).read_all()
                sizes = own.column("n_tokens").to_numpy()
                ends = np.cumsum(sizes)
                crc, held, k = np.zeros(len(sizes), dtype=np.int64), 0, 0
                for b in sequences:
                    v = b.column(0).flatten().to_numpy()[b.column(1).flatten().to_numpy(zero_copy_only=False)].astype("<u4")
                    pos = 0
                    while pos < len(v):
                        take = min(len(v) - pos, int(ends[k]) - (held + pos))
                        crc[k] = zlib.crc32(v[pos : pos + take].tobytes(), int(crc[k]))
                        pos += take
                        if held + pos == ends[k]:
                            k += 1
                    held += len(v)
                assert held == (ends[-1] if len(ends) else 0), "the ids and the documents of a file differ"
                yield pa.RecordBatch.from_arrays([own.column("doc_id").combine_chunks(), pa.array(base_ + ends - sizes), pa.array(sizes), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # only files of the manifest are read: a lost task's leftovers are not
    return files.join(based, F.col("name") == F.col("file")).select("base", "content").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenized(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write docs, read the files back, and return what read_documents returns."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens"
    manifest = write_tokens(docs, folder, **options)
    if not manifest.head(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_documents(spark, folder, manifest)


def query(spark, sf_dir):
    return tokenized(table(spark, sf_dir, "documents"))
