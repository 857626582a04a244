"""Random access to token files: any sequence, mask or document of a memory-mapped file, without copying it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Sequences:
    """The equal-length sequences of one file that `tokenfiles` wrote.

    source: the path of a file to map into memory, or its bytes as a buffer.  Opening reads the headers of the batches; ids
    are views of the file's own bytes, so a sequence costs what is read of it.  Negative and too large numbers raise IndexError.
    """

    def __init__(self, source: str | pa.Buffer):
        self.source = pa.memory_map(source) if isinstance(source, str) else pa.BufferReader(source)
        stream = pa.ipc.open_stream(self.source)
        self.length = stream.schema.field("ids").type.list_size
        self.batches = list(stream)
        self.ends = np.cumsum([b.num_rows for b in self.batches])
        self.docs = pa.ipc.open_stream(self.source).read_all()
        self.doc_ends = np.cumsum(self.docs.column("n_tokens").to_numpy())

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def _at(self, k: int) -> tuple[pa.RecordBatch, int]:
        if not 0 <= k < len(self):
            raise IndexError(f"sequence {k} of {len(self)}")
        b = int(np.searchsorted(self.ends, k, side="right"))
        return self.batches[b], k - (int(self.ends[b - 1]) if b else 0)

    def __getitem__(self, k: int) -> np.ndarray:
        """The ids of sequence k, padding included: a view, not a copy."""
        batch, row = self._at(k)
        column = batch.column(0)
        return column.values.to_numpy(zero_copy_only=True)[(column.offset + row) * self.length :][: self.length]

    def mask(self, k: int) -> pa.BooleanArray:
        """Which ids of sequence k are no padding: a view of the bits."""
        batch, row = self._at(k)
        column = batch.column(1)
        return column.values.slice((column.offset + row) * self.length, self.length)

    def document(self, k: int) -> tuple[int | None, np.ndarray]:
        """(doc_id, ids) of document k of the file, its end id included; a document may lie across sequences."""
        if not 0 <= k < len(self.doc_ends):
            raise IndexError(f"document {k} of {len(self.doc_ends)}")
        end = int(self.doc_ends[k])
        start = end - self.docs.column("n_tokens")[k].as_py()
        parts = [self[s][max(0, start - s * self.length) : end - s * self.length] for s in range(start // self.length, -(-end // self.length))]
        return self.docs.column("doc_id")[k].as_py(), np.concatenate(parts)
