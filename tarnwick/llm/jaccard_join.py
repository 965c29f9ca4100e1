"""N-gram Jaccard join: near-duplicate documents by a recursive join of regions in the metric space of shingle sets.

Two documents link when 100 * intersection >= percent * union of their sets of word shingles. The Jaccard distance is a metric, but
nearly all documents are at distance 1 from any pivot document, so pivots chosen among the documents split nothing at
first. The first regions are therefore those of pivots that are parts of the shingle universe: for a class of set
sizes the universe is dealt into parts by a hash, and a document belongs to the region of each (part, what it holds of that part). The
symmetric difference of two linked sets is bounded by ``(100 - percent) * smaller size // percent``, and by the triangle inequality no more parts than that
can tell them apart; so of each document's parts, ordered by what they hold, the first bound + 1 suffice, and linked
documents meet in at least one region. Sizes are cut into classes by the same ratio, and a document near a class's border is replicated to the neighbour.

Documents that share a region form groups. A group of at most GROUP_DOCS documents and GROUP_SHINGLES shingles is joined exactly in one task, block by block on a
matrix of shingles. A larger one is cut by pivot documents into Voronoi cells, where a document is
replicated to each cell whose pivot is at most twice the link distance farther than its nearest, and the cells are joined in the same way; a
cell that doesn't get smaller is joined as pairs of blocks, each in a task of its own. So any link is found,
by an exact test, and no task holds more than two blocks.

Equal sets are found by a 128-bit fingerprint and linked without being compared; within one task only the first of them takes part further.

Cases: null and empty texts have no shingles and link with nothing. Fewer words than a shingle are one shingle. Rows with equal ids are one
document whose texts are all tried. Further columns of the input aren't kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.columns import LOWER, NOT_SPACE, Rolling, mix, pieces, runs_hash, text_bytes, words
from tarnwick.llm.graph import checkpoint, components, forest, text_size

SHINGLE = 4
#: With SHINGLE, fixed by the contract of op1; others pass their own.
PERCENT = 85
#: Documents that one task joins at most in one block, and the shingles that as many have at most: a group of long documents counts as more of them.
GROUP_DOCS = 1024
GROUP_SHINGLES = 1 << 20
#: Levels of pivot cells before blocks.
LEVELS = 2
#: Ids of at most so many documents are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
_BUCKET_BYTES = 16 << 20
_FLUSH = 1 << 19
#: Columns of the matrix of shingles at a time.
_ITEMS = 2048
_U = np.uint64


@cache
def _size_classes(percent: int, limit: int = 1 << 40) -> np.ndarray:
    """Least size of each class; a linked pair's classes differ by one at most."""
    out = [1]
    while out[-1] < limit:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out, np.int64)


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and each text's offsets in them."""
    data, off = text_bytes(column)
    lower = LOWER[data]
    start, end, at = words(lower, off, NOT_SPACE)
    h = Rolling(lower).of(start, end)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    found = runs_hash(h, shingle)
    fits = doc[: len(found)] == doc[shingle - 1 :] if len(found) else np.empty(0, bool)
    owner, found = doc[: len(found)][fits], found[fits]
    for d in np.flatnonzero((n > 0) & (n < shingle)).tolist():
        part = h[at[d] : at[d + 1]]
        owner, found = np.append(owner, d), np.append(found, runs_hash(part, len(part)) ^ _U(len(part)))
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    if len(owner):
        fresh = np.ones(len(owner), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
        owner, found = owner[fresh], found[fresh]
    return found, np.searchsorted(owner, np.arange(len(n) + 1))


def _signatures(sets: np.ndarray, at: np.ndarray, who: np.ndarray, upper: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Region keys of the documents ``who``, in the space of their own size class or (``upper``) of the class below."""
    size, least = np.diff(at)[who], _size_classes(percent)
    own = np.searchsorted(least, size, side="right") - 1
    space = own - upper
    fine = space >= 0
    who, size, own, space = who[fine], size[fine], own[fine], space[fine]
    most = least[space + 1] - 1  # of the smaller of two linked documents
    apart = (100 - percent) * most // percent
    bound = (100 - percent) * np.minimum(size, most) // percent
    if upper:
        bound = np.minimum(bound, (100 - percent) * (most + size) // (100 + percent))
        fine = (apart > 0) | (least[own] * percent <= 100 * most)
        who, size, space, apart, bound = who[fine], size[fine], space[fine], apart[fine], bound[fine]
    parts = np.maximum(1, -(-5 * (apart + 1) // 4))
    parts[apart == 0] = 1
    base = np.concatenate([[0], np.cumsum(parts)])
    take = np.repeat(at[who] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    item = sets[take]
    salt = mix(space.astype(np.uint64) + _U(77))
    part = ((mix(item ^ np.repeat(salt, size)) >> _U(32)) * np.repeat(parts, size).astype(np.uint64)) >> _U(32)
    slot = np.repeat(base[:-1], size) + part.astype(np.int64)
    held = np.bincount(slot, minlength=base[-1])
    content = np.zeros(base[-1], np.uint64)
    np.add.at(content, slot, mix(item + _U(0x1234567)))
    owner = np.repeat(np.arange(len(who)), parts)
    content = mix(content + held.astype(np.uint64))
    order = np.lexsort((content, -held, owner))
    rank = np.arange(len(order)) - base[:-1][owner[order]]
    kept = order[rank <= bound[owner[order]]]
    place = (kept - base[:-1][owner[kept]]).astype(np.uint64)
    return mix(content[kept] ^ np.repeat(salt, parts)[kept] + place * _U(0x9E3779B97F4A7C15)), who[owner[kept]]


class _Buckets:
    """Pairs of unsigned 64-bit columns collected by bucket, given out as one binary value for each bucket."""

    def __init__(self, buckets: int, kind: int):
        self.buckets, self.kind, self.held, self.n = buckets, kind, [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.held.append(columns)
        self.n += len(columns[0])

    def drain(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        columns = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        bucket = (mix(columns[0]) % _U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[order])) + 1
        groups = np.split(order, cut)
        blobs = [b"".join(np.ascontiguousarray(c[g]).tobytes() for c in columns) for g in groups]
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[g[0]]) for g in groups], pa.int64()), pa.array([self.kind] * len(groups), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "blob"])
        self.held, self.n = [], 0


def _columns(blobs: list[bytes], width: int) -> list[np.ndarray]:
    """The columns of several binary values."""
    parts = [np.frombuffer(b, np.uint64).reshape(width, -1) for b in blobs]
    return [np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.uint64) for k in range(width)]


def _groups(keys: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that share all keys: each id with the smallest id, unless it is that."""
    order = np.lexsort((ids, *keys))
    ids = ids[order]
    fresh = np.ones(len(ids), bool)
    if len(ids):
        same = np.ones(len(ids) - 1, bool)
        for k in keys:
            same &= k[order][1:] == k[order][:-1]
        fresh[1:] = ~same
    first = ids[np.maximum.accumulate(np.where(fresh, np.arange(len(ids)), 0))] if len(ids) else ids
    return ids[ids != first], first[ids != first]


def candidates(docs: DataFrame, buckets: int, key: str, text: str, shingle: int, percent: int) -> DataFrame:
    """kind, a, b: documents that share a region with the smallest one there (kind 0), or have the same set (kind 1)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regions, equal, seen = _Buckets(buckets, 0), _Buckets(buckets, 1), {}
        for b in pieces(batches):
            ids = b.column(0).to_numpy().astype(np.int64).view(np.uint64)
            sets, at = shingle_sets(b.column(1), shingle)
            some = np.flatnonzero(np.diff(at))
            if not len(some):
                continue
            one, two = (np.add.reduceat(mix(sets ^ _U(s)), at[some]) for s in (0xA5A5A5A5, 0x5EED5EED5EED))
            one, two = mix(one + np.diff(at)[some].astype(np.uint64)), mix(two)
            equal.add(one, two, ids[some])
            new = []
            for d, f in zip(some.tolist(), zip(one.tolist(), two.tolist(), strict=True), strict=True):
                if f not in seen:
                    new.append(d)
                    if len(seen) < 1_000_000:
                        seen[f] = True
            who = np.array(new, np.int64)
            for upper in (False, True):
                if len(who):
                    found, owner = _signatures(sets, at, who, upper, percent)
                    regions.add(found, ids[owner])
            if regions.n >= _FLUSH:
                yield from regions.drain()
            if equal.n >= _FLUSH:
                yield from equal.drain()
        yield from regions.drain()
        yield from equal.drain()

    def meet(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        blobs = table["blob"].to_pylist()
        sig, ids = _columns([x for x, k in zip(blobs, kinds, strict=True) if k == 0], 2)
        one, two, same = _columns([x for x, k in zip(blobs, kinds, strict=True) if k == 1], 3)
        pairs = np.unique(np.stack(_groups([sig], ids)), axis=1)
        equal = np.stack(_groups([one, two], same))
        both = np.concatenate([pairs, equal], axis=1).view(np.int64)
        return pa.table([pa.array(np.repeat([0, 1], [pairs.shape[1], equal.shape[1]]), pa.int32()), pa.array(both[0]), pa.array(both[1])], names=["kind", "a", "b"])

    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(sign, "bucket long, kind int, blob binary").groupBy("bucket").applyInArrow(meet, "kind int, a long, b long")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets, as a matrix; by blocks of shared items."""
    n = len(left)
    items = np.concatenate([*left, *right])
    order = np.argsort(items)
    items = items[order]
    same = items[1:] == items[:-1]
    del items
    # items of one document only are left out; the others are numbered in order
    keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    place = (np.cumsum(np.concatenate([[True], ~same])[keep]) - 1).astype(np.int32)
    owner = np.repeat(np.arange(n + len(right), dtype=np.int32), [len(x) for x in (*left, *right)])[order[keep]]
    del order, keep, same
    out = np.zeros((n, len(right)), np.float32)
    shared = int(place[-1]) + 1 if len(place) else 0
    for lo in range(0, shared, _ITEMS):
        a, z = np.searchsorted(place, (lo, lo + _ITEMS))
        block = np.zeros((n + len(right), min(_ITEMS, shared - lo)), np.float32)
        block[owner[a:z], place[a:z] - lo] = 1
        out += block[:n] @ block[n:].T
    return out


def _links(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the linked pairs."""
    inter = _overlaps(left, right)
    size, other = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    near = np.nonzero((100 + percent) * inter >= (percent - 0.5) * (size[:, None] + other[None]).astype(np.float32))
    # the float matrix only rules out; whole numbers decide
    both = np.rint(inter[near]).astype(np.int64)
    union = size[near[0]] + other[near[1]] - both
    fine = (100 * both >= percent * union) & (union > 0)
    return near[0][fine], near[1][fine]


def _distances(sets: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    inter = _overlaps(sets, pivots)
    union = np.array([len(x) for x in sets])[:, None] + np.array([len(x) for x in pivots])[None] - inter
    return 1 - inter / np.maximum(union, 1)


def _sets_of(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _join_group(table: pa.Table, percent: int) -> pa.Table:
    """Star edges of the links within a group or between two blocks (side 0 and 1; a group has side 0 only)."""
    ids, side = table["id"].to_numpy(), table["side"].to_numpy()
    sets = _sets_of(table["items"])
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(right):
        right = left
    a, b = _links([sets[i] for i in left], [sets[i] for i in right], percent)
    node, root = forest(ids[left][a], ids[right][b])
    return pa.table([pa.array(node[node != root]), pa.array(root[node != root])], names=["a", "b"])


def _cells(table: pa.Table, percent: int) -> pa.Table:
    """Documents of a part of a group with the cells of the group's pivots that they belong to."""
    sets, pivot, ids = _sets_of(table["items"]), table["pivot"].to_numpy(zero_copy_only=False), table["id"].to_numpy()
    pivots = np.flatnonzero(pivot == 1)
    pivots = pivots[np.unique(ids[pivots], return_index=True)[1]]  # in order of their ids, so every part numbers the cells alike
    mine = np.flatnonzero(pivot == 0)
    if not len(mine):
        return table.slice(0, 0).select(["group", "id", "items"]).append_column("cell", pa.array([], pa.int64()))
    d = _distances([sets[i] for i in mine], [sets[i] for i in pivots])
    near = d <= d.min(1, keepdims=True) + 2 * (100 - percent) / 100 + 1e-6
    doc, cell = np.nonzero(near)
    return table.take(pa.array(mine[doc])).select(["group", "id", "items"]).append_column("cell", pa.array(cell.astype(np.int64)))


def _region_edges(rows: DataFrame, group_docs: int, levels: int, percent: int) -> DataFrame:
    """a, b: links among the documents of each group. rows: group, id, items (a binary set), repeated (group, id) allowed."""
    spark = rows.sparkSession
    edges = []

    def join_group(table: pa.Table) -> pa.Table:
        return _join_group(table, percent)

    def cells_of(table: pa.Table) -> pa.Table:
        return _cells(table, percent)

    for level in range(levels + 1):
        sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("docs"), F.min("id").alias("first"), F.sum(F.octet_length("items")).alias("bytes"))
        # n: as many documents of the usual length as the group has shingles for
        weight = F.ceil(F.col("bytes") / 8 * group_docs / GROUP_SHINGLES).cast("long")
        large = checkpoint(sizes.select("group", "first", "docs", F.greatest("docs", weight).alias("n")).where((F.col("n") > group_docs) & (F.col("docs") > 1)))
        n_large = large.count()
        large = F.broadcast(large) if n_large <= BROADCAST_IDS else large
        small = rows.join(large.select("group"), "group", "left_anti") if n_large else rows
        edges.append(small.withColumn("side", F.lit(0)).groupBy("group").applyInArrow(join_group, "a long, b long"))
        if not n_large:
            break
        held = rows.join(large, "group")
        if level < levels:
            # pivots: about four for each group that fits into a task, those with small hashes, and the first document so that there is one
            share = F.least(F.lit(64.0), F.ceil(4 * F.col("n") / group_docs)) / F.col("docs")
            pivots = held.where((F.pmod(F.xxhash64("id", F.lit(31 + level)), F.lit(1 << 30)) < share * (1 << 30)) | (F.col("id") == F.col("first")))
            parts = F.greatest(F.lit(1), F.ceil(F.col("n") / group_docs)).cast("int")
            mine = held.withColumn("part", F.pmod(F.xxhash64("id", F.lit(level)), parts)).withColumn("pivot", F.lit(0))
            copies = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("pivot", F.lit(1))
            both = mine.select("group", "part", "pivot", "id", "items").unionByName(copies.select("group", "part", "pivot", "id", "items"))
            cells = checkpoint(both.groupBy("group", "part").applyInArrow(cells_of, "group long, id long, items binary, cell long"))
            # a group whose documents mostly belong to several cells gets no smaller this way
            dense = checkpoint(cells.groupBy("group").agg(F.count(F.lit(1)).alias("k")).join(large, "group").where(F.col("k") > 2 * F.col("docs")).select("group"))
            rows = cells.join(dense, "group", "left_anti").select(F.xxhash64("group", "cell").alias("group"), "id", "items")
            held = held.join(dense, "group", "left_semi")
        edges.append(_block_edges(held, group_docs, percent))
    out = spark.createDataFrame([], "a long, b long")
    for e in edges:
        out = out.unionByName(e)
    return out


def _block_edges(held: DataFrame, group_docs: int, percent: int) -> DataFrame:
    """Links of groups of n documents by pairs of blocks."""
    blocks = F.ceil(F.col("n") / group_docs).cast("int")
    placed = held.withColumn("mine", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    pairs = placed.select("group", "id", "items", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), (F.col("mine") > F.col("other")).cast("int").alias("side"))

    def join_group(table: pa.Table) -> pa.Table:
        return _join_group(table, percent)

    return pairs.groupBy("group", "lo", "hi").applyInArrow(join_group, "a long, b long")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, group_docs: int = GROUP_DOCS, levels: int = LEVELS) -> DataFrame:
    """id, component_id of the documents that link with another; component_id is the smallest id reachable by links. percent: 1 to 99."""
    if not 1 <= percent <= 99:
        raise ValueError(f"percent must be from 1 to 99, not {percent}")
    buckets = max(256, -(-text_size(docs, text) // _BUCKET_BYTES))
    found = checkpoint(candidates(docs, buckets, key, text, shingle, percent))
    stars, equal = found.where("kind = 0").select("a", "b"), found.where("kind = 1").select("a", "b")
    groups = checkpoint(components(stars, stored=True).select(F.col("node").alias("id"), F.col("component").alias("group")))
    n = groups.count()
    kept = F.broadcast(groups) if n <= BROADCAST_IDS else groups
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(kept, "id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found, at = shingle_sets(b.column(2), shingle)
            items = [found[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(items, pa.binary())], ["group", "id", "items"])

    rows = checkpoint(texts.select("group", "id", "text").mapInArrow(sets, "group long, id long, items binary"))
    edges = _region_edges(rows, group_docs, levels, percent).unionByName(equal)
    return components(edges).select(F.col("node").alias("id"), F.col("component").alias("component_id"))


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, **options) -> DataFrame:
    """One row for each row of docs: key, n_shingles, component_id."""
    linked = jaccard_components(docs, key, text, shingle, percent, **options)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            _, at = shingle_sets(b.column(1), shingle)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at))], ["id", "n_shingles"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(count, "id long, n_shingles long")
    out = rows.join(linked, "id", "left")
    return out.select(F.col("id").alias(key), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs without those that link, over any number of links, to a document with a smaller id."""
    gone = checkpoint(jaccard_components(docs, key, text, shingle, percent).where("id <> component_id").select(F.col("id").alias("_gone")))
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, F.col(key).cast("long") == F.col("_gone"), "left_anti")
