"""Substring dedup of word passages with suffix automata of reference shards.

Every window of ``window`` words that also starts elsewhere is removed, both copies alike. Anchors (see ``repeats``) bring
the passages that may share windows to one shard: the distinct contexts of a group of anchors are the shard's reference, a suffix automaton of
them is built where they meet, its states that occur once are left out, and each context streams through it for its matching statistics: where
those reach ``window`` words, a window is repeated. The corpus is its own reference here and grows with the data, so its automata
are built at the shards and not broadcast.

Cases: null texts have no words; texts shorter than a window keep all of them. Rows with equal ids are one document and don't repeat
each other. Further columns aren't kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnwick.llm.columns import NOT_SPACE, Rolling, pieces, text_bytes, words
from tarnwick.llm.decontamination import SuffixAutomaton
from tarnwick.llm.repeats import Windows, covered, with_repeats

WINDOW = 35
GRAM = 12


def _items(data: np.ndarray, off: np.ndarray) -> tuple[Rolling, np.ndarray, np.ndarray]:
    start, end, at = words(data, off, NOT_SPACE)
    h = Rolling(data).of(start, end)
    return Rolling.over(h), at, h


def automaton_matches(gram: np.ndarray, at: np.ndarray, content: bytes, doc: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of contexts that occur twice or more among the contexts of their gram."""
    items = np.frombuffer(content, np.uint64)
    order = np.argsort(gram, kind="stable")
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(gram[order])) + 1, [len(order)]])
    found, places = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        group = order[a:b].tolist()
        if len(group) < 2:
            continue
        seen = set()
        sequences = []
        for k in group:  # rows with equal ids are one document
            if (int(doc[k]), int(start[k])) not in seen:
                seen.add((int(doc[k]), int(start[k])))
                sequences.append((k, items[at[k] : at[k + 1]].tolist()))
        sam = SuffixAutomaton()
        for _, s in sequences:
            sam.add(s)
        count = [0] * len(sam.len)
        for _, s in sequences:
            v = 0
            for c in s:
                v = sam.next[v][c]
                count[v] += 1
        for v in sam.by_length():
            count[sam.link[v]] += count[v]
        nxt, link, length = sam.next, sam.link, sam.len
        for k, s in sequences:
            v = n = 0
            for i, c in enumerate(s):
                t = nxt[v].get(c)
                while v and (t is None or count[t] < 2):
                    v = link[v]
                    n = length[v]
                    t = nxt[v].get(c)
                if t is not None and count[t] >= 2:
                    v = t
                    n += 1
                else:
                    v = n = 0
                if n >= window:
                    found.append(k)
                    places.append(i + 1 - window)
    return np.array(found, np.int64), np.array(places, np.int64)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """key, n_words, n_removed, kept (the kept words joined by one space), spans (first and end word of each maximal removed run)."""
    rows = with_repeats(docs, key, text, Windows(_items, window, gram, "any", automaton_matches))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "body_"):
            data, off = text_bytes(b.column(1))
            start, end, at = words(data, off, NOT_SPACE)
            gone = covered(b.column(2).to_pylist(), at, window)
            n = np.diff(at)
            owner = np.repeat(np.arange(len(n)), n)
            removed = np.bincount(owner[gone], minlength=len(n))
            kept = ~gone
            ks, size, who = start[kept], end[kept] - start[kept] + 1, owner[kept]
            total = np.cumsum(size)
            take = np.repeat(ks - (total - size), size) + np.arange(total[-1] if len(total) else 0)
            out = np.append(data, np.uint8(32))[take]
            out[total - 1] = 32
            last = np.ones(len(who), bool)
            last[:-1] = who[1:] != who[:-1]
            out = np.delete(out, total[last[: len(total)]] - 1) if len(total) else out
            sizes = np.bincount(who, size, len(n)).astype(np.int64) - (np.bincount(who, minlength=len(n)) > 0)
            text_out = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(removed.astype(np.int64)), text_out.cast(pa.string()), runs(gone, at)], ["id", "n_words", "n_removed", "kept", "spans"])

    return rows.mapInArrow(cut, "id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>").withColumnRenamed("id", key)


def runs(gone: np.ndarray, at: np.ndarray) -> pa.Array:
    """Maximal runs of removed items of each document, relative to it."""
    edge = np.zeros(len(gone) + 1, bool)
    edge[at] = True
    before, after = np.concatenate([[False], gone[:-1]]), np.concatenate([gone[1:], [False]])
    first = np.flatnonzero(gone & (~before | edge[:-1]))
    last = np.flatnonzero(gone & (~after | edge[1:])) + 1
    doc = np.searchsorted(at, first, side="right") - 1
    values = pa.StructArray.from_arrays([pa.array(first - at[doc]), pa.array(last - at[doc])], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, at).astype(np.int32)), values)
