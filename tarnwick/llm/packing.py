"""Packing of documents into windows of tokens by lexical retrieval.

Each document becomes token ids and an end mark. Whole windows are cut from its front; what is left, its tail, is packed
with tails of related documents by a sharded BM25 inverted index: each shard indexes its documents that have a tail, whole, with the document
frequencies and mean length of all documents, and a seed's window is filled greedily with the unused tails whose documents score highest for it.
The tail that no longer fits is cut, and its rest is the next seed, so every window but a shard's last is full. The
last is cut into powers of two, which need no padding.

A seed reaches the tails of its own shard, so the shards are made of documents that are alike: a document's topic is the list of its TOPIC_TERMS terms of
the largest BM25 weight that another document has too, in the vocabulary's order, documents are sorted by it, and each SHARD_DOCS in a row are a shard. The sort is
a range partitioning of all documents (a large group of equal topics is split by the documents' hashes), and each task packs its sorted rows as they come,
so memory is bounded by SHARD_DOCS documents whatever the input's size.

Each id lies in exactly one piece. Token ids are written once to the checkpoint folder, with each task's document frequencies, and
shuffled once, at two bytes each.

Cases: a null or empty text is the end mark alone. Repeated rows are packed each by itself. Equal scores go by the order of the shard's rows. An empty table gives an empty
result. Further columns aren't kept: a piece refers to its document by the key. A null key is a piece's null key.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.columns import pieces
from tarnwick.llm.graph import checkpoint

WINDOW = 2048
SHARD_DOCS = 256
TOPIC_TERMS = 24
END = 1
K1, B = 1.2, 0.75

_TASK_BYTES = 16 << 20
_SCHEMA = "key long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_loaded: dict = {}


def _encoding(path: str, pattern: str, added: dict[str, int] | None):
    name = (path, pattern, *sorted((added or {}).items()))
    if name not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _loaded[name] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=added or {})
    return _loaded[name]


def encoder(path: str, pattern: str, added: dict[str, int] | None = None, arrays: bool = False):
    """A function from texts to ids, lists or ``arrays`` of them, by the ranks of a byte-level vocabulary, with texts split at its ``added`` tokens first; loaded once a process."""
    found = _encoding(path, pattern, added)
    return partial(found.encode_to_numpy if arrays else found.encode, allowed_special="all" if added else set(), disallowed_special=())


@dataclass
class Corpus:
    """Of all documents: their number, mean length and, by term, the number that hold it."""

    n: int
    mean: float
    df: np.ndarray

    def __post_init__(self) -> None:
        self.idf = np.log1p((self.n - self.df + 0.5) / (self.df + 0.5))


class Index:
    """A BM25 inverted index of a shard's documents: for each term, its documents and their weights. Without a corpus the shard is its own."""

    def __init__(self, texts: list[np.ndarray], corpus: Corpus | None = None):
        n = len(texts)
        sizes = np.array([len(t) for t in texts])
        terms = np.concatenate(texts) if n else np.empty(0, np.int64)
        pair, count = np.unique(terms.astype(np.int64) * n + np.repeat(np.arange(n), sizes), return_counts=True)
        term, self.docs = pair // n, pair % n
        self.terms, first, held = np.unique(term, return_index=True, return_counts=True)
        self.bounds = np.append(first, len(term))
        total, mean, df = (corpus.n, corpus.mean, corpus.df[self.terms]) if corpus else (n, sizes.mean(), held)
        idf = np.log1p((total - df + 0.5) / (df + 0.5))
        weight = count * (K1 + 1) / (count + K1 * (1 - B + B * sizes[self.docs] / max(1.0, mean)))
        self.weights = weight * np.repeat(idf, held)
        order = np.argsort(self.docs, kind="stable")
        self.own = np.split(np.repeat(np.arange(len(self.terms)), held)[order], np.cumsum(np.bincount(self.docs, minlength=n))[:-1])
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        """Each document's BM25 score for the seed's terms as a query."""
        own = self.own[seed]
        first, size = self.bounds[own], self.bounds[own + 1] - self.bounds[own]
        at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.bincount(self.docs[at], self.weights[at], self.n)


def fill(tails: list[np.ndarray], window: int, index: Index | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (tail, start, length): all but the last ones are full windows; the last ones are powers of two. index: of the tails' documents, in the same order."""
    out: list[list[tuple[int, int, int]]] = []
    live = [k for k in range(len(tails)) if len(tails[k])]
    if not live:
        return out
    index = index or Index(tails)
    unused = np.zeros(len(tails), bool)
    unused[live] = True
    rest: tuple[int, int] | None = None
    queue = sorted(live, key=lambda k: (-len(tails[k]), k))
    while rest or unused.any():
        if rest is None:
            while not unused[queue[0]]:
                queue.pop(0)
            rest = (queue[0], 0)
            unused[queue[0]] = False
        seed, at = rest
        sequence, room, rest = [(seed, at, len(tails[seed]) - at)], window - (len(tails[seed]) - at), None
        if room > 0 and unused.any():
            near = np.where(unused, index.scores(seed), -1.0)
            for k in np.lexsort((np.arange(len(near)), -near)):
                if near[k] < 0 or not room:
                    break
                take = min(room, len(tails[k]))
                sequence.append((int(k), 0, take))
                unused[k] = False
                room -= take
                if take < len(tails[k]):
                    rest = (int(k), take)
        out.append(sequence)
    left = out.pop()
    total = sum(x[2] for x in left)
    while total:
        size = min(window, 1 << (total.bit_length() - 1))
        total -= size
        part = []
        while size:
            k, a, n = left.pop(0)
            part.append((k, a, min(n, size)))
            if n > size:
                left.insert(0, (k, a + size, n - size))
            size -= min(n, size)
        out.append(part)
    return out


def tokenise(docs: DataFrame, vocabulary: str, pattern: str, added: dict[str, int] | None, key: str, text: str) -> DataFrame:
    """Documents as ids, as unsigned 16-bit numbers where they fit. A task's last row, without ``of``, has its number of documents (key), of ids (doc_tokens) and its document frequencies."""
    rows = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("of"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern, added, arrays=True)
        n, total, df = 0, 0, np.zeros(1 << 16, np.int64)

        def batch(out: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["of", "key", "doc_tokens", "wide", "raw"])

        for b in pieces(batches):
            of, keys, texts = (c.to_pylist() for c in b.columns)
            out: list[tuple] = []
            for h, k, t in zip(of, keys, texts, strict=True):
                ids = np.append(encode(t or ""), np.uint32(END))
                wide = bool(ids.max() > 0xFFFF)
                raw = ids if wide else ids.astype(np.uint16)
                out.append((h, k, len(ids), wide, raw.tobytes()))
                terms = np.unique(raw)
                if terms[-1] >= len(df):
                    df = np.append(df, np.zeros(int(terms[-1]) + 1 - len(df), np.int64))
                df[terms] += 1
                n, total = n + 1, total + len(ids)
            yield batch(out)
        if n:
            terms = np.flatnonzero(df)
            yield batch([(None, n, total, True, np.concatenate([terms, df[terms]]).tobytes())])

    return rows.mapInArrow(tokens, "of long, key long, doc_tokens long, wide boolean, raw binary")


def statistics(dealt: DataFrame) -> Corpus:
    """The statistics of all documents, from the last rows of the tasks that cut them; a row for each term goes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, total, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                terms, df = np.frombuffer(raw, np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], terms])), pa.array(np.concatenate([[n, total], df]))], ["term", "n"])

    rows = dealt.where("of is null").select("key", "doc_tokens", "raw").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    n, total = found.pop(-2, 0), found.pop(-1, 0)
    df = np.zeros(max(found, default=-1) + 1, np.int64)
    df[list(found)] = list(found.values())
    return Corpus(n, total / max(1, n), df)


def topic(ids: np.ndarray, corpus: Corpus, terms: int = TOPIC_TERMS) -> bytes:
    """The heaviest shared terms of a document in the vocabulary's order, as bytes that sort like the numbers."""
    ids = np.sort(ids)
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    found, count = ids[first], np.diff(np.append(first, len(ids)))
    shared = np.flatnonzero(corpus.df[found] > 1)
    if len(shared) > terms:  # equal weights by the smaller term
        f = count[shared]
        weight = f * corpus.idf[found[shared]] / (f + K1 * (1 - B + B * len(ids) / max(1.0, corpus.mean)))
        shared = np.sort(shared[np.argsort(-weight, kind="stable")[:terms]])
    return found[shared].astype(">u4").tobytes()


def _ids_of(raw: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, np.uint32 if wide else np.uint16)


def pack_shard(docs: list[np.ndarray], window: int, corpus: Corpus | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) of a shard's documents."""
    whole = [len(x) // window * window for x in docs]
    tails = [k for k, x in enumerate(docs) if len(x) > whole[k]]
    out = [[(k, a, window)] for k in range(len(docs)) for a in range(0, whole[k], window)]
    if tails:
        found = fill([docs[k][whole[k] :] for k in tails], window, Index([docs[k] for k in tails], corpus))
        out += [[(tails[k], whole[tails[k]] + a, n) for k, a, n in sequence] for sequence in found]
    return out


def pack(docs: DataFrame, vocabulary: str, pattern: str, added: dict[str, int] | None = None, key: str = "doc_id", text: str = "text", window: int = WINDOW, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row for each piece: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset. vocabulary: path of a rank file, on every machine; added: its tokens that aren't in the file."""
    dealt = checkpoint(tokenise(docs, vocabulary, pattern, added, key, text))
    found = statistics(dealt)
    corpus = docs.sparkSession.sparkContext.broadcast(found)

    def topics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "raw"):
            made = [topic(_ids_of(r, w), corpus.value) for r, w in zip(b.column(4).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], [*b.schema.names, "topic"])

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number, held = TaskContext.get().partitionId() << 40, 0, []
        for b in pieces(batches, "raw"):
            held += zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)
            while len(held) >= shard_docs:
                out = list(shard(held[:shard_docs], first + number))
                number, held = out[-1][5] - first + 1, held[shard_docs:]
                yield batch(out)
        if held:
            yield batch(list(shard(held, first + number)))

    def shard(rows: list[tuple], number: int) -> Iterator[tuple]:
        ids = [_ids_of(raw, wide) for _, _, wide, raw in rows]
        for at, sequence in enumerate(pack_shard(ids, window, corpus.value)):
            offset = 0
            for k, a, n in sequence:
                yield rows[k][0], a, n, ids[k][a : a + n].astype("<u4").tobytes(), rows[k][1], number + at, offset
                offset += n

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    tasks = max(1, -(-int(2 * found.n * found.mean) // _TASK_BYTES))
    order = ["topic", "of", "row"]  # the row's number tells repeated rows apart
    rows = dealt.where("of is not null").mapInArrow(topics, "of long, key long, doc_tokens long, wide boolean, raw binary, topic binary").withColumn("row", F.monotonically_increasing_id())
    dealt_out = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return dealt_out.select("key", "doc_tokens", "wide", "raw").mapInArrow(pack_rows, _SCHEMA).withColumnRenamed("key", key)
