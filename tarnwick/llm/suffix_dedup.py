"""Suffix-array dedup of byte strings by bucket-pointer refinement.

Every byte that a string of ``window`` bytes covers which also starts earlier is removed. Full suffix arrays of all texts would
be sorted through the network several times over; anchors (see ``repeats``) give the initial buckets instead: the q-gram that each string is anchored at.
Within such a bucket the contexts' suffixes are refined by pointers: buckets of q-grams are sorted by the identifiers of the buckets at the offset q later,
which makes buckets of 2q, and the new identifiers serve the next round at twice the offset, until they stand for whole
strings; suffixes that are alone in their bucket drop out after each round.

Cases: null and empty texts have no bytes; texts shorter than a window stay as they are. Rows with equal ids are one document. What is left
may not be valid UTF-8, so it is binary. Further columns aren't kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnwick.llm.columns import Rolling, pieces, text_bytes
from tarnwick.llm.repeats import Windows, covered, with_repeats
from tarnwick.llm.substring_dedup import runs

WINDOW = 100
GRAM = 32
#: Bytes of the first buckets within a context.
FIRST = 8


def _items(data: np.ndarray, off: np.ndarray) -> tuple[Rolling, np.ndarray, np.ndarray]:
    return Rolling(data), off, data


def refine(items: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose window (within its context) isn't unique, and the bucket of each.

    Buckets of FIRST bytes are packed integers; a round sorts the pairs (bucket at p, bucket at p + size) of the suffixes that still share a
    bucket and numbers them anew. The last round's offset is shortened so that the size becomes the window.
    """
    n = len(items)
    end = np.repeat(at[1:], np.diff(at))
    live = np.flatnonzero(np.arange(n) + window <= end)
    size = min(FIRST, window)
    bucket = np.zeros(n, np.int64)
    code = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        code = code << np.uint64(8) | items[k : n - size + 1 + k].astype(np.uint64)
    whole = np.flatnonzero(np.arange(n) + size <= end)  # later offsets need buckets too, not only the starts of windows
    bucket[whole] = np.unique(code[whole], return_inverse=True)[1]
    while size < window and len(live):
        step = min(size, window - size)
        reach = np.flatnonzero(np.arange(n) + size + step <= end)
        pair = bucket[reach] * np.int64(n + 1) + bucket[reach + step]
        fresh, number, count = np.unique(pair, return_inverse=True, return_counts=True)
        bucket[reach] = number
        size += step
        alone = np.zeros(n, bool)
        alone[reach] = count[number] == 1
        live = live[~alone[live]]
    return live, bucket[live]


def refinement_matches(gram: np.ndarray, at: np.ndarray, content: bytes, doc: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of contexts that also start earlier among the contexts of their bucket."""
    items = np.frombuffer(content, np.uint8)
    live, bucket = refine(items, at, window)
    context = np.searchsorted(at, live, side="right") - 1
    step = live - at[context]
    place = start[context] + step
    order = np.lexsort((place, doc[context], bucket))
    same = bucket[order][1:] == bucket[order][:-1]
    again = np.zeros(len(order), bool)
    if len(order) > 1:
        moved = np.concatenate([[0], np.cumsum(~((doc[context][order][1:] == doc[context][order][:-1]) & (place[order][1:] == place[order][:-1]) & same))])
        first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(order)), 0))
        again = moved > moved[first]
    chosen = order[again]
    return context[chosen], step[chosen]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """key, n_bytes, n_removed, kept (binary), spans (start and end of each maximal removed run)."""
    rows = with_repeats(docs, key, text, Windows(_items, window, gram, "later", refinement_matches))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "body_"):
            data, off = text_bytes(b.column(1))
            gone = covered(b.column(2).to_pylist(), off, window)
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[off[1:]] - total[off[:-1]]
            n = np.diff(off)
            kept = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(n - removed)]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(removed.astype(np.int64)), kept.cast(pa.binary()), runs(gone, off)], ["id", "n_bytes", "n_removed", "kept", "spans"])

    return rows.mapInArrow(cut, "id long, n_bytes long, n_removed long, kept binary, spans array<struct<start:long,end:long>>").withColumnRenamed("id", key)
