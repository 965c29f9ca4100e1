"""Benchmark decontamination by a generalised suffix automaton of the test items.

Words are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased. The items' words build one
suffix automaton; a document's words stream through it, which tracks the longest match that ends at each word. Wherever it reaches
``window`` words, or a whole item that is shorter, those words are hit. A document is contaminated when hits cover
``share`` of its words; spans that exceed the length limit are cut from ``clean_text``.

Only words that can take part reach the automaton: numpy first finds the runs of words whose q-grams all occur in
items, for all documents of a chunk at once. That loses nothing, since every q-gram of a match occurs in an item.

The items are dealt into blocks of BLOCK_BYTES of text, and each block's automaton is built by a task of its own and packed into arrays, which take
about a tenth of what its dictionaries do. At most BLOCKS_AT_ONCE automata are gathered and broadcast for one pass over the documents; more items
take more passes, and hits are joined over passes, so neither the driver nor a worker ever holds more than that.

Cases: null and empty texts have no words and are never contaminated; items without words have no windows. An empty table of items leaves
every document clean. Equal documents are answered alike; items with equal ids count once. Further columns pass through; columns
named like the outputs are replaced. One item must fit into a task (with some 160 times its bytes while its automaton is built).
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.llm.columns import ALNUM, LOWER, Rolling, pieces, runs_hash, text_bytes, unused, words

WINDOW = 13
BLOCK_BYTES = 1 << 20
BLOCKS_AT_ONCE = 8
_GRAM = 4
_FILTER_BITS = 20


class SuffixAutomaton:
    """A generalised suffix automaton of sequences of hashable symbols."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]

    def add(self, sequence) -> list[int]:
        """Adds a sequence; the state of each of its prefixes."""
        last, path = 0, []
        for c in sequence:
            last = self._extend(last, c)
            path.append(last)
        return path

    def _extend(self, last: int, c) -> int:
        nxt, link, length = self.next, self.link, self.len
        q = nxt[last].get(c)
        if q is not None:  # the prefix is there from an earlier sequence
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def by_length(self) -> list[int]:
        """States, longest first."""
        return sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True)


class PackedAutomaton:
    """A finished automaton in arrays: the arcs of a state are a sorted slice of symbols (unsigned 64-bit) and their targets."""

    def __init__(self, sam: SuffixAutomaton):
        sizes = np.array([len(arcs) for arcs in sam.next], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        symbol = np.fromiter((c for arcs in sam.next for c in arcs), np.uint64, int(sizes.sum()))
        target = np.fromiter((v for arcs in sam.next for v in arcs.values()), np.int32, int(sizes.sum()))
        order = np.lexsort((symbol, np.repeat(np.arange(len(sizes)), sizes)))
        self.symbol, self.target = symbol[order], target[order]
        self.link, self.len = np.array(sam.link, np.int32), np.array(sam.len, np.int32)

    def step(self, state: int, symbol) -> int:
        """The state that the arc leads to, or -1."""
        a, z = int(self.first[state]), int(self.first[state + 1])
        k = a if z - a == 1 else bisect_left(self.symbol, symbol, a, z)
        return int(self.target[k]) if k < z and self.symbol[k] == symbol else -1


class ItemIndex:
    """The automaton of a block of items, with what is needed to tell which items a match belongs to."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int):
        data, off = text_bytes(texts)
        data = LOWER[data]
        start, end, at = words(data, off, ALNUM)
        hashes = Rolling(data).of(start, end)
        sequences = [hashes[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        sam = SuffixAutomaton()
        self.window, self.names = window, sorted(set(ids))
        number = {name: k for k, name in enumerate(self.names)}
        self.short: dict[int, list[tuple[int, str]]] = {}
        states: dict[int, set] = {}
        grams, least = [], [len(s) for s in sequences if len(s)]
        self.gram = min(_GRAM, min(least, default=_GRAM))
        self.least = min(window, min(least, default=window))
        for s in sequences:
            if len(s):
                sam.add(s.tolist())
                grams.append(runs_hash(s, self.gram))
        for name, s in zip(ids, sequences, strict=True):  # states can be split until all are in
            v = 0
            for k, c in enumerate(s.tolist()):
                v = sam.next[v][c]
                if len(s) >= window and k + 1 >= window:
                    states.setdefault(v, set()).add(number[name])
            if 0 < len(s) < window:
                self.short.setdefault(v, []).append((len(s), name))
        for v in sam.by_length():
            up = sam.link[v]
            if v in states and sam.len[up] >= window:
                states.setdefault(up, set()).update(states[v])
        #: States that hold windows, in order, and the items of each, as a slice of item numbers.
        self.states = np.array(sorted(states), np.int32)
        self.bounds = np.concatenate([[0], np.cumsum([len(states[v]) for v in self.states.tolist()])]).astype(np.int64)
        self.items = np.fromiter((k for v in self.states.tolist() for k in sorted(states[v])), np.int32, int(self.bounds[-1]))
        self.sam = PackedAutomaton(sam)
        self.grams = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.uint64)
        self._fill()

    def _fill(self) -> None:
        self.mask = np.zeros(1 << _FILTER_BITS, bool)
        self.mask[(self.grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "mask"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._fill()

    def items_of(self, state: int) -> list[str]:
        """The items that hold the windows of a state."""
        k = int(np.searchsorted(self.states, state))
        if k == len(self.states) or self.states[k] != state:
            return []
        return [self.names[i] for i in self.items[self.bounds[k] : self.bounds[k + 1]].tolist()]

    def runs(self, hashes: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
        """Maximal runs of words of one document whose grams all occur in items."""
        grams = runs_hash(hashes, self.gram)
        near = np.flatnonzero(self.mask[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(near) or not len(self.grams):
            return []
        found = grams[near]
        place = np.minimum(np.searchsorted(self.grams, found), len(self.grams) - 1)
        near = near[self.grams[place] == found]
        doc = np.searchsorted(at, near, side="right") - 1
        fits = near + self.gram <= at[doc + 1]
        near, doc = near[fits], doc[fits]
        if not len(near):
            return []
        cut = np.flatnonzero((np.diff(near) > 1) | (np.diff(doc) > 0)) + 1
        first, last = near[np.concatenate([[0], cut])], near[np.concatenate([cut - 1, [len(near) - 1]])] + self.gram
        long = last - first >= self.least
        return list(zip(first[long].tolist(), last[long].tolist(), strict=True))

    def stream(self, run: np.ndarray, base: int, spans: list[tuple[int, int]], items: set) -> None:
        """Matching statistics of one run of words; adds the windows that are hit and their items."""
        step, link, length, window = self.sam.step, self.sam.link, self.sam.len, self.window
        v = n = 0
        for k, c in enumerate(run):
            to = step(v, c)
            while v and to < 0:
                v = int(link[v])
                n = int(length[v])
                to = step(v, c)
            if to >= 0:
                v = to
                n += 1
            else:
                v = n = 0
            if n >= window:
                u = v
                while length[link[u]] >= window:
                    u = int(link[u])
                spans.append((base + k + 1 - window, base + k + 1))
                items.update(self.items_of(u))
            if self.short:
                u, most = v, n
                while u > 0:
                    for size, name in self.short.get(u, ()):
                        if size <= most:
                            spans.append((base + k + 1 - size, base + k + 1))
                            items.add(name)
                    u = int(link[u])
                    most = int(length[u])


def _hits(hashes: np.ndarray, at: np.ndarray, indexes: list[ItemIndex]) -> tuple[dict[int, list], dict[int, set]]:
    """Hit windows and items, by document."""
    spans: dict[int, list] = {}
    items: dict[int, set] = {}
    for index in indexes:
        for a, b in index.runs(hashes, at):
            doc = int(np.searchsorted(at, a, side="right")) - 1
            index.stream(hashes[a:b], a - int(at[doc]), spans.setdefault(doc, []), items.setdefault(doc, set()))
    return spans, items


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, share: float = 0.05, clean: bool = True) -> DataFrame:
    """docs with n_words, n_hit, items (sorted ids), contaminated and, if ``clean``, clean_text without the hit spans."""
    docs = docs.drop("n_words", "n_hit", "items", "contaminated", "clean_text")
    held = dict(zip(("spans", "items", "n", "clean", "hit"), unused(docs.columns, "spans", "items_", "n", "clean", "hit"), strict=True))
    out = docs.withColumns({held["spans"]: F.array().cast("array<int>"), held["items"]: F.array().cast("array<string>"), held["n"]: F.lit(0).cast("long"), held["clean"]: F.lit(None).cast("string")})
    bench = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    size = bench.agg(F.sum(F.octet_length("text")).alias("n")).head()["n"] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    bench = bench.select(F.pmod(F.xxhash64("text", "id"), F.lit(blocks)).alias("block"), "id", "text")
    context = docs.sparkSession.sparkContext

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("text", "ascending"), ("id", "ascending")])  # the same automaton each time
        index = ItemIndex(table["id"].to_pylist(), table["text"].combine_chunks(), window)
        return pa.table([table["block"][:1], pa.array([pickle.dumps(index)], pa.binary())], names=["block", "index"])

    for first in range(0, blocks, BLOCKS_AT_ONCE):
        made = bench.where((F.col("block") >= first) & (F.col("block") < first + BLOCKS_AT_ONCE)).groupBy("block").applyInArrow(build, "block long, index binary").collect()
        indexes = [pickle.loads(r["index"]) for r in sorted(made, key=lambda r: r["block"])]
        out = _stream(out, held, context.broadcast(indexes), text, clean, last=first + BLOCKS_AT_ONCE >= blocks)
    out = out.withColumns({"n_words": F.col(held["n"]), "n_hit": F.col(held["hit"]), "items": F.col(held["items"])})
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= share * F.col("n_words")))
    return (out.withColumn("clean_text", F.col(held["clean"])) if clean else out).drop(*held.values())


def _stream(docs: DataFrame, names: dict[str, str], held, text: str, clean: bool, last: bool) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, *([T.StructField(names["hit"], T.LongType())] if last else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = held.value
        for b in pieces(batches, text):
            column = b.column(b.schema.get_field_index(text))
            data, off = text_bytes(column)
            start, end, at = words(lower := LOWER[data], off, ALNUM)
            spans, items = _hits(Rolling(lower).of(start, end), at, indexes)
            counts = np.diff(at)
            before, listed = b.column(b.schema.get_field_index(names["spans"])).to_pylist(), b.column(b.schema.get_field_index(names["items"])).to_pylist()
            hit = np.zeros(b.num_rows, np.int64)
            cleaned = None
            for d in range(b.num_rows):
                if d in spans or before[d]:
                    flat = [*zip(before[d][::2], before[d][1::2], strict=True), *spans.get(d, [])]
                    covered = np.zeros(counts[d] + 1, np.int64)
                    for a, z in flat:
                        covered[a] += 1
                        covered[z] -= 1
                    covered = np.cumsum(covered) > 0
                    hit[d] = covered.sum()
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], covered]).astype(np.int8)))
                    before[d] = edge.tolist()
                    listed[d] = sorted({*listed[d], *items.get(d, ())})
                    if last and clean:
                        cleaned = cleaned or column.to_pylist()
                        keep, lo = [], int(off[d])
                        for a, z in zip(edge[::2], edge[1::2], strict=True):
                            keep.append(bytes(data[lo : start[at[d] + a]]))
                            lo = int(end[at[d] + z - 1])
                        cleaned[d] = b"".join([*keep, bytes(data[lo : off[d + 1]])]).decode()
            made = {names["spans"]: pa.array(before, pa.list_(pa.int32())), names["items"]: pa.array(listed, pa.list_(pa.string())), names["n"]: pa.array(counts, pa.int64())}
            if last and clean:
                made[names["clean"]] = column if cleaned is None else pa.array(cleaned, column.type)
            arrays = [made.get(n, b.column(i)) for i, n in enumerate(b.schema.names)]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(hit)] if last else [])], [*b.schema.names, *([names["hit"]] if last else [])])

    return docs.mapInArrow(run, schema)
