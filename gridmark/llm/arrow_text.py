"""Whole batches of texts as bytes: helpers for operators that read texts through Arrow instead of text by text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on together.
BATCH_BYTES = 4 << 20


def parts(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of at most ``BATCH_BYTES`` of text, or of one longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and total + n > BATCH_BYTES:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield batch.slice(at)


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the texts begin and the last ends, and the bytes of all; a null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    return at - at[0], data[at[0] : at[-1]]


def pieces(bounds: np.ndarray, data: np.ndarray, is_space: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The texts cut before each white-space byte, as a dictionary of the different pieces, and where each piece begins and the last ends.

    A piece keeps the white space before it.
    """
    begins = is_space.copy()
    begins[bounds[bounds < len(data)]] = True
    cuts = np.append(np.flatnonzero(begins), len(data))
    if len(cuts) == 1:
        return cuts, pa.array([], pa.string()).dictionary_encode()
    return cuts, pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()


def gathered(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices from each start to its end one after the other, and where each ends."""
    sizes = ends - starts
    stops = np.cumsum(sizes)
    n = int(stops[-1]) if len(stops) else 0
    at = np.ones(n, np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        at[(stops - sizes)[some]] = starts[some]
        at[(stops - sizes)[some[1:]]] -= ends[some[:-1]] - 1
        np.cumsum(at, out=at)
    return flat[at], stops
