"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells, one vector kept per group.

Equal vectors are first made one, with a count. A sample of FIT_ROWS vectors, chosen by a hash, gives two levels of
centroids: spherical k-means of the vectors, and k-means of what is left of them without their centroid. A cell is a pair of one centroid of each
level, and its direction their sum; each level has the root of one cell for CELL_ROWS vectors, so cells follow the number of vectors while the centroids
that every machine holds follow its root. Each length of vectors has cells of its own. A vector looks into the TOPS nearest first centroids, belongs to the
cell of the largest cosine there, and is a guest in the PROBES - 1 next ones: a fixed number of copies, whatever the input's size.

A cell compares its own vectors with each other and with its guests, in double precision, as
products of blocks; a cell of more than BLOCK_ROWS vectors is dealt out as pairs of blocks, each a task of its own. A pair that
both vectors' cells see is counted in the smaller cell only. Each task returns a count and one link for each vector, never pairs.

The cells are the only approximation: a pair is missed only if neither vector is a guest in the other's cell. Pairs of a
cosine of exactly 0.9 are the hardest (see the README for the recall by size, and the tests for a comparison with brute force).

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and vectors of different lengths
don't link with each other. Rows with a null id are returned with no links and aren't kept. Repeated rows count as further vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.graph import checkpoint, components, forest

THRESHOLD = 0.9
FIT_ROWS = 16_384
CELL_ROWS = 256
TOPS, PROBES = 8, 16
BLOCK_ROWS = 8192
#: Cells of more than one block that are broadcast at most (16 bytes each).
BROADCAST_CELLS = 1_000_000
_ROWS = 4096
#: Numbers in one array of scores.
_SCORES = 1 << 22


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of very large or small components leave the range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors; the seeds are evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        own = np.concatenate([(x[a : a + _ROWS] @ c.T).argmax(1) for a in range(0, len(x), _ROWS)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


def residual_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids of vectors of any length; the seeds are evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        half = (c * c).sum(1) / 2
        own = np.concatenate([(x[a : a + _ROWS] @ c.T - half).argmax(1) for a in range(0, len(x), _ROWS)])
        total, n = np.zeros_like(c), np.bincount(own, minlength=k)[:, None]
        np.add.at(total, own, x)
        c = np.where(n > 0, total / np.maximum(n, 1), c)
    return c


@dataclass
class Cells:
    """The cells of vectors of one length; ``first`` is the number of the first one."""

    first: int
    top: np.ndarray
    rest: np.ndarray

    def __post_init__(self) -> None:
        squares = (self.top * self.top).sum(1)[:, None] + 2 * self.top @ self.rest.T + (self.rest * self.rest).sum(1)[None]
        self.norm = np.sqrt(np.maximum(squares, 1e-12))
        self.n = self.norm.size

    @classmethod
    def fit(cls, first: int, sample: np.ndarray, k: int) -> Cells:
        """k centroids of each level for unit vectors."""
        top = spherical_kmeans(sample, k)
        own = np.concatenate([(sample[a : a + _ROWS] @ top.T).argmax(1) for a in range(0, len(sample), _ROWS)])
        return cls(first, top, residual_kmeans(sample - top[own], k))

    def of(self, x: np.ndarray, tops: int = TOPS, probes: int = PROBES) -> np.ndarray:
        """The cells of unit vectors, a row each, nearest first."""
        tops = min(tops, len(self.top))
        probes, out = min(probes, tops * len(self.rest)), []
        step = max(1, _SCORES // (tops * len(self.rest)))
        for a in range(0, len(x), step):
            part = x[a : a + step]
            s = part @ self.top.T
            t = np.argsort(-s, axis=1, kind="stable")[:, :tops]
            score = ((np.take_along_axis(s, t, 1)[:, :, None] + (part @ self.rest.T)[:, None, :]) / self.norm[t]).reshape(len(part), -1)
            best = np.argpartition(-score, probes - 1, axis=1)[:, :probes] if probes < score.shape[1] else np.tile(np.arange(probes), (len(part), 1))
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(score, best, 1), axis=1, kind="stable"), 1)
            out.append(np.take_along_axis(t, best // len(self.rest), 1) * len(self.rest) + best % len(self.rest))
        return self.first + np.concatenate(out)


def _assign(reps: DataFrame, cells: dict[int, Cells], tops: int, probes: int, kind: type) -> DataFrame:
    """cell, id, copies, vec, home (its own cell) and cells (all its cells), a row for each cell. cells: for each length; kind: of the numbers that vec is sent as."""
    held = reps.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for length in np.unique(lengths).tolist():
                alike = batch.take(pa.array(np.flatnonzero(lengths == length)))
                for a in range(0, alike.num_rows, _ROWS):
                    b = alike.slice(a, _ROWS)
                    x = np.array(b.column(2).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1)
                    listed = held.value[length].of(_unit(x), tops, probes)
                    row = np.repeat(np.arange(len(x)), listed.shape[1])
                    take = pa.array(row)
                    vec = pa.array([v.tobytes() for v in x.astype(kind)], pa.binary()).take(take)
                    all_of = pa.array([z.tobytes() for z in np.sort(listed, 1)], pa.binary()).take(take)
                    yield pa.RecordBatch.from_arrays([pa.array(listed.ravel()), b.column(0).take(take), b.column(1).take(take), vec, pa.array(listed[row, 0]), all_of], ["cell", "id", "copies", "vec", "home", "cells"])

    return reps.mapInArrow(run, "cell long, id long, copies long, vec binary, home long, cells binary")


def _linked(x: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``left`` and ``right`` whose cosine reaches the threshold."""
    found = [np.nonzero(x[left[a : a + 512]] @ x[right].T >= threshold) for a in range(0, len(left), 512)]
    if not found:
        return left[:0], right[:0]
    return np.concatenate([left[512 * k + i] for k, (i, _) in enumerate(found)]), np.concatenate([right[j] for _, j in found])


def _compare(table: pa.Table, threshold: float, kind: type) -> pa.Table:
    """id, links, root of the vectors of a cell, or of two of its blocks (side 0 and 1), that link here: pairs of which one has its home here."""
    table = table.sort_by([("side", "ascending"), ("id", "ascending")]).combine_chunks()
    ids, copies, home, cell, side = (table[c].to_numpy() for c in ("id", "copies", "home", "cell", "side"))
    x = _unit(np.frombuffer(b"".join(table["vec"].to_pylist()), kind).astype(np.float64).reshape(len(ids), -1))
    listed = np.frombuffer(b"".join(table["cells"].to_pylist()), np.int64).reshape(len(ids), -1)
    own = home == cell
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if len(right):
        parts = [_linked(x, left[own[left]], right, threshold), _linked(x, left[~own[left]], right[own[right]], threshold)]
        i, j = (np.concatenate(p) for p in zip(*parts, strict=True))
    else:
        i, j = _linked(x, left[own[left]], left, threshold)
        fine = (i < j) | ~own[j]  # two of this home meet twice (and each itself), a vector and a guest once
        i, j = i[fine], j[fine]
    # a pair of two homes is counted in the smaller of the cells that see it
    owner, guest = np.where(own[i], i, j), np.where(own[i], j, i)
    other = home[guest]
    fine = (other >= cell[0]) | ~(listed[owner] == other[:, None]).any(1) if len(i) else np.zeros(0, bool)
    i, j = i[fine], j[fine]
    links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
    node, root = forest(ids[i], ids[j])
    at = np.flatnonzero(links > 0)
    place = np.searchsorted(node, ids[at])
    return pa.table([pa.array(ids[at]), pa.array(links[at].astype(np.int64)), pa.array(root[place] if len(at) else ids[at])], names=["id", "links", "root"])


def near_dedup(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, tops: int = TOPS, probes: int = PROBES
) -> DataFrame:
    """One row for each vector: key, n_links, component_id and kept."""
    v = F.col(vector)
    valid = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0) & F.col(key).isNotNull()
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("vec"), F.coalesce(valid, F.lit(False)).alias("valid"))
    marked = rows.select("id", "vec", "valid", F.xxhash64("vec").alias("h1"), F.xxhash64("vec", F.lit(11)).alias("h2"))
    good = marked.where("valid")
    reps = checkpoint(good.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")))
    sizes = {r["n"]: r["k"] for r in reps.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("k")).collect()}
    n = sum(sizes.values())
    picked = reps.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, FIT_ROWS / max(1, n))) + 1).select("rep", "vec").collect()
    if not n:
        return marked.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    cells, first = {}, 0
    for length, size in sorted(sizes.items()):
        sample = [r["vec"] for r in sorted((r for r in picked if len(r["vec"]) == length), key=lambda r: r["rep"])]
        k = min(math.ceil(math.sqrt(size / cell_rows)), len(sample) // 4)
        # one cell holds all of its length, so its centroid doesn't matter
        cells[length] = Cells.fit(first, _unit(np.array(sample, np.float64)), k) if k > 1 else Cells(first, np.full((1, length), length**-0.5), np.zeros((1, length)))
        first += cells[length].n
    kind = np.float32 if dict(vectors.dtypes)[vector] == "array<float>" else np.float64  # what the input has, without loss
    placed = _assign(reps.select(F.col("rep").alias("id"), "copies", "vec"), cells, tops, probes, kind)
    # cells of that many rows are few for the vectors that they hold, but their list may still grow, so it is broadcast only by its size
    large = checkpoint(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows))
    hint = F.broadcast if large.count() <= BROADCAST_CELLS else lambda df: df
    blocks = F.coalesce(F.ceil(2 * F.col("n") / block_rows), F.lit(1)).cast("int")
    dealt = placed.join(hint(large), "cell", "left").withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.select("cell", "id", "copies", "vec", "home", "cells", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), (F.col("mine") > F.col("other")).cast("int").alias("side"))

    def compare(table: pa.Table) -> pa.Table:
        return _compare(table, threshold, kind)

    seen = checkpoint(pairs.groupBy("cell", "lo", "hi").applyInArrow(compare, "id long, links long, root long"))
    links = seen.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(seen.select(F.col("id").alias("a"), F.col("root").alias("b")), stored=True)
    told = reps.select("h1", "h2", "rep", "copies").join(links.withColumnRenamed("id", "rep"), "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    out = good.select("id", "h1", "h2").join(told, ["h1", "h2"], "left").select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = out.unionByName(marked.where(~F.col("valid")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
