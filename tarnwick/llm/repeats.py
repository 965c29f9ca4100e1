"""Repeated windows of documents, found through anchors: what substring dedup and suffix-array dedup share.

A window is so many consecutive items (words or bytes) of one document. Its anchor is the q-gram in it with the smallest hash, the
leftmost on ties, so equal windows have equal anchors at equal offsets. Windows that follow each other mostly share their anchor: an anchor stands
for its windows, and its context is what those cover. Only anchors are shuffled, about two for each window length of text.

1. Anchors are dealt by their gram. Anchors with the same gram and context have the same windows; whether those are repeated is
   then known without looking at any window. Within a map task such anchors are settled first, so a passage that is in a third of all
   documents sends one anchor per task.
2. Where a gram has several contexts, those may still share some windows. The contexts of such an anchor, one of each kind, are dealt by the gram once
   more with their items, and a ``matcher`` (a suffix automaton, or bucket refinement) finds the windows that several have.
   Grams with more than HOT_CONTEXTS contexts, in one map task or over all, have their windows dealt one by one instead, each by its own hash and settled within the map task first,
   so no task has to hold them all.
3. The repeated windows go back to their documents.

``mode`` "any": a window counts if it starts anywhere else too. "later": if it also starts earlier (smaller id, or same
document and earlier start).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.columns import Rolling, mix, pieces, text_bytes
from tarnwick.llm.graph import checkpoint, text_size

HOT_CONTEXTS = 256
_BUCKET_BYTES = 16 << 20
_FLUSH = 1 << 19
_U = np.uint64
_LOW = _U((1 << 28) - 1)


@dataclass(frozen=True)
class Windows:
    """items: from bytes and document offsets to (hashes of any run, offsets of the documents in items, the items)."""

    items: Callable[[np.ndarray, np.ndarray], tuple[Rolling, np.ndarray, np.ndarray]]
    window: int
    gram: int
    mode: str
    #: From the contexts of grams (gram of each, offsets, items, document and start of each) to repeated windows (context, window in it).
    matcher: Callable


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    whole = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    whole[: len(x)] = x
    rows = whole.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(rolling: Rolling, at: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """gram hash, context hash, document, first window and number of windows of each anchor."""
    none = (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    n = int(at[-1]) - window + 1
    if n <= 0:
        return none
    grams = rolling.windows(gram)
    least = sliding_least((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), window - gram + 1)
    edge = np.zeros(int(at[-1]) + 1, np.int64)  # windows that would leave their document
    np.add.at(edge, np.maximum(at[:-1], at[1:] - window + 1), 1)
    np.add.at(edge, at[1:], -1)
    p = np.flatnonzero(np.cumsum(edge)[:n] == 0)
    if not len(p):
        return none
    x = (least[p] & _LOW).astype(np.int64)
    cut = np.flatnonzero((np.diff(x) != 0) | (np.diff(p) != 1)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(p) - 1]])
    lo, hi, x = p[first], p[last], x[first]
    doc = np.searchsorted(at, lo, side="right") - 1
    context = rolling.of(lo, hi + window) ^ mix((x - lo).astype(np.uint64))
    return grams[x], context, doc, lo - at[doc], hi - lo + 1


def _blobs(bucket: np.ndarray, kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    """One binary value of columns for each bucket."""
    if not len(bucket):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.binary())], ["bucket", "kind", "blob"])
    order = np.argsort(bucket, kind="stable")
    columns = tuple(c[order] for c in columns)
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
    blobs = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[order][bounds[:-1]], pa.int64()), pa.array(np.full(len(blobs), kind, np.int32)), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])


def _read(table: pa.Table, kind: int, width: int) -> list[np.ndarray]:
    chosen = [np.frombuffer(b, np.uint64).reshape(width, -1) for b, k in zip(table["blob"].to_pylist(), table["kind"].to_pylist(), strict=True) if k == kind]
    return [np.concatenate([c[k] for c in chosen]) if chosen else np.empty(0, np.uint64) for k in range(width)]


def _settle(keys: tuple[np.ndarray, ...], doc: np.ndarray, span: np.ndarray, mode: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows that share all keys: the sorted order, the first row of each class, the class of each row, and which rows are repeated."""
    place = span >> _U(16)
    order = np.lexsort((place, doc.view(np.int64), *keys[::-1]))
    n = len(order)
    fresh = np.ones(n, bool)
    other = np.ones(n, bool)
    if n > 1:
        same = np.ones(n - 1, bool)
        for k in keys:
            same &= k[order][1:] == k[order][:-1]
        fresh[1:] = ~same
        other[1:] = ~(same & (doc[order][1:] == doc[order][:-1]) & (place[order][1:] == place[order][:-1]))
    cls = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    number = np.cumsum(other)  # rows of one and the same window count once
    number = number - number[first][cls] if n else number
    if mode == "later":
        repeated = number > 0
    else:
        repeated = (np.maximum.reduceat(number, first) > 0)[cls] if n else np.zeros(0, bool)
    return order, first, cls, repeated


def _sizes(x: np.ndarray) -> np.ndarray:
    """For each of sorted values how often it occurs."""
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)
    return np.repeat(np.diff(bounds), np.diff(bounds))


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc ^ _U(0xD0C)) % _U(buckets)).astype(np.int64)


def repeated_windows(docs: DataFrame, spec: Windows) -> DataFrame:
    """id, spans (binary values of ``first window << 16 | number of windows``), of documents with repeated windows. docs: id long, body_, both not null."""
    buckets = max(256, -(-text_size(docs, "body_") // _BUCKET_BYTES))
    window, mode = spec.window, spec.mode
    rows = docs

    def settled(keys, doc, span, kind: int) -> Iterator[pa.RecordBatch]:
        """Rows of one task: repeated ones go to their documents, one of each class goes on. Of a gram that has many contexts in this task alone only
        the name goes on; its contexts go to their documents as such."""
        order, first, _, repeated = _settle(keys, doc, span, mode)
        yield _blobs(_doc_bucket(doc[order][repeated], buckets), 1, doc[order][repeated], span[order][repeated])
        go = order[first]
        if kind == 0:
            many = _sizes(keys[0][go]) > HOT_CONTEXTS
            hot, go = go[many], go[~many]
            yield _blobs(_doc_bucket(doc[hot], buckets), 3, doc[hot], span[hot], keys[0][hot])
            names = np.unique(keys[0][hot])
            yield _blobs((mix(names) % _U(buckets)).astype(np.int64), 6, names)
        yield _blobs((mix(keys[0][go]) % _U(buckets)).astype(np.int64), kind, *(k[go] for k in keys), doc[go], span[go])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in pieces(batches, "body_"):
            ids = b.column(0).to_numpy().astype(np.int64).view(np.uint64)
            data, off = text_bytes(b.column(1))
            rolling, at, _ = spec.items(data, off)
            gram, context, doc, lo, count = anchors(rolling, at, window, spec.gram)
            held.append((gram, context, ids[doc], (lo << 16 | count).astype(np.uint64)))
            n += len(gram)
            if n >= _FLUSH:
                gram, context, doc, span = (np.concatenate(c) for c in zip(*held, strict=True))
                yield from settled((gram, context), doc, span, 0)
                held, n = [], 0
        if held:
            gram, context, doc, span = (np.concatenate(c) for c in zip(*held, strict=True))
            yield from settled((gram, context), doc, span, 0)

    def meet(table: pa.Table) -> pa.Table:
        """Repeated anchors (kind 1), and those of grams with several contexts, few (2) or many (3)."""
        gram, context, doc, span = _read(table, 0, 4)
        order, first, _, repeated = _settle((gram, context), doc, span, mode)
        out = [_blobs(_doc_bucket(doc[order][repeated], buckets), 1, doc[order][repeated], span[order][repeated])]
        kinds = order[first]
        size, known = _sizes(gram[kinds]), np.isin(gram[kinds], _read(table, 6, 1)[0])
        many = known | (size > HOT_CONTEXTS)
        for kind, chosen in ((2, (size > 1) & ~many), (3, many)):
            k = kinds[chosen]
            out.append(_blobs(_doc_bucket(doc[k], buckets), kind, doc[k], span[k], gram[k]))
        doc, span = _read(table, 1, 2)
        out.append(_blobs(_doc_bucket(doc, buckets), 1, doc, span))
        doc, span, gram = _read(table, 3, 3)
        out.append(_blobs(_doc_bucket(doc, buckets), 3, doc, span, gram))
        return pa.Table.from_batches(out)

    def by_document(table: pa.Table) -> pa.Table:
        """id, spans, few, many: what a document's anchors are."""
        found: dict[int, list] = {}
        for kind, width in ((1, 2), (2, 3), (3, 3)):
            columns = _read(table, kind, width)
            order = np.lexsort((columns[1], columns[0]))
            columns = [c[order] for c in columns]
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(columns[0])) + 1, [len(order)]]).astype(int) if len(order) else np.zeros(1, int)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                value = np.unique(columns[1][a:b]) if width == 2 else np.concatenate([columns[1][a:b], columns[2][a:b]])
                found.setdefault(int(columns[0][a].view(np.int64)), [None, None, None])[kind - 1] = value.tobytes()
        return pa.table([pa.array(list(found), pa.int64()), *(pa.array([v[k] for v in found.values()], pa.binary()) for k in range(3))], names=["id", "spans", "few", "many"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The contexts of anchors of grams with few contexts (kind 4), and the windows of those with many (kind 5)."""
        for b in pieces(batches, "body_"):
            ids = b.column(0).to_numpy().astype(np.int64).view(np.uint64)
            data, off = text_bytes(b.column(1))
            rolling, at, items = spec.items(data, off)
            told = {2: b.column(2).to_pylist(), 3: b.column(3).to_pylist()}
            for kind, values in told.items():
                parts = [np.frombuffer(v, np.uint64).reshape(2, -1) for v in values if v]
                if not parts:
                    continue
                owner = np.repeat([d for d, v in enumerate(values) if v], [p.shape[1] for p in parts])
                span, gram = np.concatenate(parts, axis=1)
                lo, count = at[owner] + (span >> _U(16)).astype(np.int64), (span & _U(0xFFFF)).astype(np.int64)
                fits = lo + count + window - 1 <= at[owner + 1]  # rows with equal ids may differ
                owner, span, gram, lo, count = owner[fits], span[fits], gram[fits], lo[fits], count[fits]
                if kind == 2:
                    bucket = (mix(gram) % _U(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    bounds = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]]) if len(order) else np.zeros(1, int)
                    names, blobs = [], []
                    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                        o = order[a:z]
                        content = b"".join(items[lo[k] : lo[k] + count[k] + window - 1].tobytes() for k in o)
                        head = np.stack([gram[o], ids[owner[o]], span[o]]).tobytes()
                        names.append(int(bucket[o[0]]))
                        blobs.append(np.uint64(len(o)).tobytes() + head + content)
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([4] * len(names), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])
                else:
                    which = np.repeat(np.arange(len(lo)), count)
                    step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                    p = lo[which] + step
                    place = ((span >> _U(16))[which] + step.astype(np.uint64)) << _U(16) | _U(1)
                    yield from settled((rolling.of(p, p + window), gram[which]), ids[owner[which]], place, 5)

    def match(table: pa.Table) -> pa.Table:
        out = []
        heads, contents = [], []
        for blob, kind in zip(table["blob"].to_pylist(), table["kind"].to_pylist(), strict=True):
            if kind == 4:
                n = int(np.frombuffer(blob, np.uint64, 1)[0])
                heads.append(np.frombuffer(blob, np.uint64, 3 * n, 8).reshape(3, n))
                contents.append(blob[8 + 24 * n :])
        if heads:
            gram, doc, span = np.concatenate(heads, axis=1)
            size = ((span & _U(0xFFFF)).astype(np.int64) + window - 1)
            context, k = spec.matcher(gram, np.concatenate([[0], np.cumsum(size)]), b"".join(contents), doc.view(np.int64), (span >> _U(16)).astype(np.int64), window)
            place = ((span[context] >> _U(16)) + k.astype(np.uint64)) << _U(16) | _U(1)
            out.append(_blobs(_doc_bucket(doc[context], buckets), 1, doc[context], place))
        one, gram, doc, span = _read(table, 5, 4)
        order, _, _, repeated = _settle((one, gram), doc, span, mode)
        out.append(_blobs(_doc_bucket(doc[order][repeated], buckets), 1, doc[order][repeated], span[order][repeated]))
        doc, span = _read(table, 1, 2)
        out.append(_blobs(_doc_bucket(doc, buckets), 1, doc, span))
        return pa.Table.from_batches(out)

    blob, told = "bucket long, kind int, blob binary", "id long, spans binary, few binary, many binary"
    first = rows.mapInArrow(find, blob).groupBy("bucket").applyInArrow(meet, blob).groupBy("bucket").applyInArrow(by_document, told)
    first = checkpoint(first)
    open_ = first.where("few is not null or many is not null").select("id", "few", "many")
    second = rows.select("id", "body_").join(open_, "id").mapInArrow(again, blob).groupBy("bucket").applyInArrow(match, blob).groupBy("bucket").applyInArrow(by_document, told)
    both = first.select("id", "spans").unionByName(second.select("id", "spans")).where("spans is not null")
    return both.groupBy("id").agg(F.collect_list("spans").alias("spans"))


def with_repeats(docs: DataFrame, key: str, text: str, spec: Windows) -> DataFrame:
    """id, body_ (the text), spans (array of binary) for each row of docs. Both joins with the texts deal them by id in the same way, so Spark shuffles them once."""
    # new names: an alias that renames nothing may be dropped from one of the two plans only, which then differ
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("body_"))
    known = rows.where("id is not null and body_ is not null")
    found = known.join(repeated_windows(known, spec), "id", "left")
    return found.unionByName(rows.where("id is null or body_ is null").withColumn("spans", F.lit(None).cast("array<binary>")))


def covered(spans: list, at: np.ndarray, window: int) -> np.ndarray:
    """Which items lie in a repeated window. spans: for each document a list of binary values, or None."""
    edge = np.zeros(int(at[-1]) + 1, np.int64)
    for d, values in enumerate(spans):
        for v in values or ():
            x = np.frombuffer(v, np.uint64)
            lo = at[d] + (x >> _U(16)).astype(np.int64)
            hi = np.minimum(lo + (x & _U(0xFFFF)).astype(np.int64) + window - 1, at[d + 1])
            fits = lo < hi
            np.add.at(edge, lo[fits], 1)
            np.add.at(edge, hi[fits], -1)
    return np.cumsum(edge)[:-1] > 0
