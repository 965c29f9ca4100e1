"""Pairs of a group's sources, block by block.

A source's readings are one row (two arrays). A group's sources are dealt into blocks by a hash; two blocks meet in a task, and what is asked of their pairs is
taken there. So no pair of readings is ever a row, pairs of sources only where they are the result, and a source is sent once to each block of its group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.operators import fits
from tarnwick.operators.graph import materialise, written

#: Sources of a block on average, rows of a block that are compared at once, and temperatures that are laid out at once.
BLOCK, TILE, WIDTH = 3072, 256, 2048
#: Groups whose numbers of blocks are broadcast.
SMALL = 100_000


#: Parts of readings for each shuffle partition; a part's readings are in a worker at once.
PARTS = 4


def part_of(df: DataFrame, *columns: str) -> Column:
    """A number by which rows are dealt, so that rows that are equal in the columns meet in a part."""
    return F.pmod(F.xxhash64(*columns), F.lit(PARTS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))).cast("int")


def source_rows(df: DataFrame, keys: list[str], source: str, t: str, y: str, order: list[str], digits: int | None = 2, dealt: str | None = None, fitted: bool = False, whole: bool = False, ranked: bool = False, text: bool = True) -> DataFrame:
    """keys, source (as text, if ``text``), ts, ys (the first reading in order of each rounded temperature), lo, hi, n of all its rows: a row for each source of a group. Written once, after one shuffle.

    ``dealt``: a column by which df is dealt already, with a source of a group in one part. ``fitted``: with the columns of fits.apelblat_fits of all its rows, null where there is no fit.
    ``whole``: with xs, zs, the exact temperatures and values of all rows that have both. ``ranked``: with xs, zs of all rows that have a temperature, and os, their rank in order, by which they are sorted.
    """
    kinds = dict(df.dtypes)
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [*keys, source]))
    rows = rows.withColumn("_d", part_of(df, *keys, source)).repartition("_d") if dealt is None else rows.withColumnRenamed(dealt, "_d")
    at = F.col(t) if digits is None else F.bround(F.col(t), digits)
    double = lambda c, name: c.cast("double").alias(name)
    rows = rows.select("_d", *keys, F.col(source).alias("_s"), double(F.col(t), "_x"), double(at, "_t"), double(F.col(y), "_y"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)))
    sums = fits.SUMS if fitted else []
    more = [f"{c} {'long' if c == 'n_points' else 'double'}" for c in sums] + (["xs array<double>", "zs array<double>"] if whole or ranked else []) + (["os array<int>"] if ranked else [])
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"_s {kinds[source]}", "ts array<double>", "ys array<double>", "lo double", "hi double", "n long", *more])

    def run(table: pa.Table) -> pa.Table:
        return _gathered(table, keys, len(order), fitted, whole, ranked)

    name = F.col("_s").cast("string") if text else F.col("_s")
    return written(rows.groupBy("_d").applyInArrow(run, schema).select(*keys, name.alias(source), "ts", "ys", "lo", "hi", "n", *(c.split()[0] for c in more)))


def _ranks(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of the values, as Spark orders them: null first, NaN last."""
    whole = column.combine_chunks().dictionary_encode()
    rank = np.empty(len(whole.dictionary) + 1, np.int64)
    rank[pc.sort_indices(whole.dictionary).to_numpy()] = np.arange(len(whole.dictionary))
    rank[-1] = -1
    return rank[whole.indices.fill_null(len(whole.dictionary)).to_numpy(zero_copy_only=False)]


def _lists(values: np.ndarray, sizes: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values, mask=null))


def _gathered(table: pa.Table, keys: list[str], orders: int, fitted: bool, whole: bool, ranked: bool) -> pa.Table:
    """The rows of source_rows of some sources, from their readings."""
    number = lambda c: table[c].combine_chunks().to_numpy(zero_copy_only=False)
    missing = lambda c: table[c].combine_chunks().is_null().to_numpy(zero_copy_only=False)
    g = np.zeros(len(table), np.int64)
    for c in [*keys, "_s"]:
        codes_ = table[c].combine_chunks().dictionary_encode()
        g = np.unique(g * len(codes_.dictionary) + codes_.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    size = int(g.max()) + 1 if len(g) else 0
    count = lambda rows: np.bincount(g[rows], minlength=size)
    x, t, y, x_null, t_null, y_null = number("_x"), number("_t"), number("_y"), missing("_x"), missing("_t"), missing("_y")
    head = np.unique(g, return_index=True)[1]

    def ends(rows: np.ndarray, over: np.ufunc) -> pa.Array:
        out, by = np.full(size, np.nan), rows[np.argsort(g[rows], kind="stable")]
        there, first = np.unique(g[by], return_index=True)
        out[there] = over.reduceat(x[by], first) if len(by) else 0
        return pa.array(out, mask=~np.isin(np.arange(size), there))

    # the first row in order of each temperature of a source
    by = np.flatnonzero(~t_null)
    by = by[np.lexsort((t[by], g[by]))]
    a, b = by[:-1], by[1:]
    run = np.concatenate(([0], np.cumsum((g[a] != g[b]) | ~((t[a] == t[b]) | (np.isnan(t[a]) & np.isnan(t[b])))))) if len(by) else by
    tied = np.flatnonzero(np.bincount(run)[run] > 1) if len(by) else by
    if len(tied):
        among = table.take(pa.array(by[tied]))
        by[tied] = by[tied[np.lexsort((*(_ranks(among[f"_o{i}"]) for i in reversed(range(orders))), run[tied]))]]
    pick = by[np.unique(run, return_index=True)[1]] if len(by) else by
    out = {k: table[k].take(pa.array(head)) for k in keys} | {"_s": table["_s"].take(pa.array(head))}
    out |= {"ts": _lists(t[pick] + 0.0, count(pick)), "ys": _lists(y[pick], count(pick), y_null[pick])}
    some = np.flatnonzero(~x_null)
    out |= {"lo": ends(some, np.fmin), "hi": ends(some, np.maximum), "n": pa.array(np.bincount(g, minlength=size))}
    known = np.flatnonzero(~x_null & ~y_null)
    if fitted:
        n = count(known)
        bad = (n == 0) | (np.bincount(g[known[x[known] <= 0]], minlength=size) > 0)  # neither 1 / T nor ln T
        with np.errstate(all="ignore"):
            of = {"u": 1000.0 / x[known], "w": np.log(x[known]), "y": y[known]}
            total = lambda v: np.bincount(g[known], v, size)
            mean = {c: total(v) / n for c, v in of.items()}
            off = {c: v - mean[c][g[known]] for c, v in of.items()}
            found = {"u_mean": mean["u"], "w_mean": mean["w"], "_my": mean["y"]} | {f"_{c}": total(off[c[0]] * off[c[1]]) for c in ("uu", "ww", "yy", "uw", "uy", "wy")}
        out |= {"n_points": pa.array(n), "t_min": ends(known, np.fmin), "t_max": ends(known, np.maximum)} | {c: pa.array(v, mask=bad) for c, v in found.items()}
    if ranked:
        o = np.zeros(len(g), np.int64)
        for i in range(orders):
            r = _ranks(table[f"_o{i}"]) + 1
            o = np.unique(o * (r.max(initial=0) + 1) + r, return_inverse=True)[1]
        by = some[np.lexsort((o[some], g[some]))]
        out |= {"xs": _lists(x[by], count(by)), "zs": _lists(y[by], count(by), y_null[by]), "os": _lists(o[by].astype(np.int32), count(by))}
    elif whole:
        by = known[np.argsort(g[known], kind="stable")]
        out |= {"xs": _lists(x[by], count(by)), "zs": _lists(y[by], count(by))}
    names = [*keys, "_s", "ts", "ys", "lo", "hi", "n", *(fits.SUMS if fitted else []), *(["xs", "zs"] if whole or ranked else []), *(["os"] if ranked else [])]
    return pa.table([out[c] for c in names], names=names)


@dataclass
class Side:
    """Some sources of a group: names, their rank among all that are there, spans, and the readings' row, temperature and value."""

    names: list
    rank: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    n: np.ndarray
    at: np.ndarray
    t: np.ndarray
    y: np.ndarray
    null: np.ndarray
    extra: dict

    def some(self, rows: np.ndarray) -> Side:
        to = np.full(len(self.names), -1)
        to[rows] = np.arange(len(rows))
        keep = to[self.at] >= 0
        return Side([self.names[i] for i in rows], self.rank[rows], self.lo[rows], self.hi[rows], self.n[rows], to[self.at[keep]], self.t[keep], self.y[keep], self.null[keep], {k: v[rows] for k, v in self.extra.items()})


def side(table: pa.Table, source: str, extra: list[str] = ()) -> Side:
    names = table[source].to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), int)
    rank[order] = np.cumsum([k > 0 and names[order[k - 1]] != names[i] for k, i in enumerate(order)])  # a source that is there twice has one rank
    whole = lambda c: table[c].combine_chunks()
    number = lambda c: whole(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
    ts, ys = whole("ts"), whole("ys")
    sizes = np.diff(ts.offsets.to_numpy())
    values = ys.flatten()
    return Side(names, rank, number("lo"), number("hi"), number("n"), np.repeat(np.arange(len(names)), sizes), ts.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), values.cast(pa.float64()).to_numpy(zero_copy_only=False), values.is_null().to_numpy(zero_copy_only=False), {c: whole(c).to_numpy(zero_copy_only=False) for c in extra})


def codes(y: np.ndarray, digits: int) -> np.ndarray:
    """Numbers that are equal where the values, rounded half to even as decimals, are equal."""
    x = y * 10.0**digits
    out = np.rint(x)
    for i in np.flatnonzero(np.abs(np.abs(x - np.floor(x)) - 0.5) < 1e-6):  # near a tie the product doesn't tell
        out[i] = float(Decimal(repr(float(y[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_EVEN).scaleb(digits))
    return np.where(np.isnan(out), np.finfo(float).max, out)  # NaN is like NaN


@dataclass
class Tile:
    """Statistics of the pairs of some sources a (rows) with sources b (columns). pair: which are to be looked at. Arrays that weren't asked for are None."""

    a: Side
    b: Side
    pair: np.ndarray
    n: np.ndarray
    mae: np.ndarray
    known: np.ndarray
    exact: np.ndarray
    total: np.ndarray | None
    squares: np.ndarray | None
    largest: np.ndarray | None
    #: Values (row of a temperature, column of a source; 0 where there is none) and where they are, of a and of b, if only pairs that may be copies were looked at one by one: mae is inf of others.
    cells: tuple | None = None
    known_n: np.ndarray | None = None  # readings at which both have values; n counts nulls too
    same: bool = False

    def absolute(self, keep: np.ndarray) -> float:
        """The sum of absolute differences of the pairs ``keep``: that of all pairs, by order of values, less that of the others."""
        if self.cells is None:
            k = keep & self.known
            return float((self.known_n[k] * self.mae[k]).sum())
        (ya, va), (yb, vb) = self.cells
        out = 0.0
        for k in range(len(ya)):
            x, z = np.sort(ya[k, va[k]]), np.sort(yb[k, vb[k]])
            out += _distances(x, z) - (_distances(x, x) / 2 if self.same else 0.0)
        left = self.pair & self.known & ~keep
        return out - float((self.known_n[left] * self.mae[left]).sum())

    def most(self, keep: np.ndarray, so_far: float | None) -> float | None:
        """The largest absolute difference of the pairs ``keep``, or so_far."""
        if self.cells is None:
            found = self.largest[keep & self.known]
            return max([x for x in (so_far, float(found.max()) if len(found) else None) if x is not None], default=None)
        (ya, va), (yb, vb) = self.cells
        spans = [(max(np.max(ya[k, va[k]]) - np.min(yb[k, vb[k]]), np.max(yb[k, vb[k]]) - np.min(ya[k, va[k]])), k) for k in range(len(ya)) if va[k].any() and vb[k].any()]
        for span, k in sorted(spans, reverse=True):
            if so_far is not None and span <= so_far:
                break
            i, j = np.flatnonzero(va[k]), np.flatnonzero(vb[k])
            d = np.abs(ya[k, i][:, None] - yb[k, j])[keep[np.ix_(i, j)]]
            if len(d):
                so_far = max(float(d.max()), -1.0 if so_far is None else so_far)
        return so_far

    def copies(self, near: float) -> np.ndarray:
        return self.pair & (self.exact | (self.mae < near))

    def apart(self, least: float) -> np.ndarray:
        """The range gate."""
        return _apart(self.a, self.b, least)


def _apart(a: Side, b: Side, least: float) -> np.ndarray:
    return (a.hi[:, None] - b.lo >= least) | (b.hi - a.lo[:, None] >= least) | (a.n[:, None] <= 1) | (b.n <= 1)


def _distances(x: np.ndarray, z: np.ndarray) -> float:
    """The sum of |x - z| over all pairs of two ordered arrays."""
    if not len(x) or not len(z):
        return 0.0
    c = z[len(z) // 2]  # sums stay small
    x, z = x - c, z - c
    below = np.searchsorted(z, x)
    upto = np.concatenate(([0.0], np.cumsum(z)))
    return float((x * (2 * below - len(z)) + upto[-1] - 2 * upto[below]).sum())


def _laid_out(side_: Side, common: np.ndarray, digits: int) -> tuple:
    """Presence, validity, values and codes of a side's readings at common temperatures, by source and temperature."""
    place = np.searchsorted(common, side_.t)
    there = (place < len(common)) & (common[np.minimum(place, len(common) - 1)] == side_.t)
    at, col, ok, y = side_.at[there], place[there], ~side_.null[there], side_.y[there]
    shape = (len(side_.names), len(common))
    present, valid, values, code = np.zeros(shape, np.float32), np.zeros(shape, bool), np.zeros(shape), np.zeros(shape)
    present[at, col] = 1
    valid[at, col] = ok
    values[at[ok], col[ok]] = y[ok]
    code[at[ok], col[ok]] = codes(y[ok], digits)
    return present, valid, values, code


def _sifted(a: Side, b: Side, same: bool, digits: int, near: float, also: Callable | None) -> Tile | None:
    """A tile of which only the pairs that may be copies, and those of ``also``, are compared reading by reading: a mean difference or a mean square that is too large rules
    out the others, and both come from products of matrices. None if that doesn't spare much, or values aren't finite."""
    common = np.intersect1d(a.t, b.t)
    if not 0 < len(common) <= WIDTH:
        return None
    (pa_, va, ya, ca), (pb, vb, yb, cb) = _laid_out(a, common, digits), _laid_out(b, common, digits)
    if not (np.isfinite(ya).all() and np.isfinite(yb).all()):
        return None
    fa, fb = va.astype(float), vb.astype(float)
    middle = yb.sum(0) / np.maximum(fb.sum(0), 1)
    za, zb = (ya - middle) * fa, (yb - middle) * fb
    n, known = (pa_ @ pb.T).astype(float), fa @ fb.T
    total = za @ fb.T - fa @ zb.T
    squares = np.maximum((za * za) @ fb.T + fa @ (zb * zb).T - 2 * (za @ zb.T), 0)
    span = max(float(np.max(za) - np.min(zb)), float(np.max(zb) - np.min(za)), 1e-300)  # of any difference, as 0 is a value here
    pair = (n > 0) & (a.rank[:, None] < b.rank if same else a.rank[:, None] != b.rank)
    limit = (max(near, 10.0**-digits) * (1 + 1e-6) + 1e-9) * known
    need = (known > 0) & ~(np.maximum(np.abs(total), (squares - 1e-9) / span) > limit)
    if also is not None:
        need |= also(a, b) & (known > 0)
    need &= pair
    if need.sum() > 0.3 * pair.sum():
        return None
    mae, exact = np.full(n.shape, np.inf), np.zeros(n.shape, bool)
    i, j = np.nonzero(need)
    step = max(1, (1 << 20) // len(common))
    for c in range(0, len(i), step):
        x, z = i[c : c + step], j[c : c + step]
        both = va[x] & vb[z]
        mae[x, z] = np.where(both, np.abs(ya[x] - yb[z]), 0.0).sum(1) / known[x, z]
        exact[x, z] = ((ca[x] == cb[z]) | ~both).all(1)
    total[a.rank[:, None] > b.rank] *= -1
    return Tile(a, b, pair, n, mae, known > 0, exact, total, squares, None, ((np.ascontiguousarray(ya.T), np.ascontiguousarray(va.T)), (np.ascontiguousarray(yb.T), np.ascontiguousarray(vb.T))), known, same)


def tiles(a: Side, b: Side, same: bool, digits: int, sums: bool, near: float | None = None, also: Callable | None = None) -> Iterator[Tile]:
    """Tiles of a x b; ``same``: they are one block, of which each pair is looked at once. Values are y of the smaller name less y of the larger.

    ``near``: only copies(near) and sums will be asked for, and differences of the pairs ``also``.
    """
    if same:
        a = b = a.some(np.argsort(a.rank))
    bt = None
    for start in range(0, len(a.names), TILE):
        one = a.some(np.arange(start, min(start + TILE, len(a.names))))
        if same:  # earlier ones have met these
            b = a.some(np.arange(start, len(a.names)))
        if near is not None and (sifted := _sifted(one, b, same, digits, near, also)) is not None:
            yield sifted
            continue
        if same or bt is None:
            bt, bi = np.unique(b.t, return_inverse=True)
            bc = codes(b.y, digits)
        shape = (len(one.names), len(b.names))
        n, known, s, exact = np.zeros(shape), np.zeros(shape), np.zeros(shape), np.ones(shape, bool)
        total, squares, largest = (np.zeros(shape) if sums else None for _ in range(3))
        place = np.searchsorted(bt, one.t)
        shared = (place < len(bt)) & (bt[np.minimum(place, len(bt) - 1)] == one.t) if len(bt) else np.zeros(len(one.t), bool)
        ac = codes(one.y, digits)
        for low in range(0, len(bt), WIDTH):
            width = min(WIDTH, len(bt) - low)
            sides = []
            for at, col, y, null, code, size in ((one.at[shared], place[shared], one.y[shared], one.null[shared], ac[shared], shape[0]), (b.at, bi, b.y, b.null, bc, shape[1])):
                inside = (col >= low) & (col < low + width)
                at, col, ok = at[inside], col[inside] - low, ~null[inside]
                there, valid, values, rounded = np.zeros((size, width), np.float32), np.zeros((size, width), bool), np.zeros((width, size)), np.full((size, width), np.nan)
                there[at, col] = 1
                valid[at, col] = ok
                values[col, at] = y[inside]
                rounded[at[ok], col[ok]] = code[inside][ok]
                sides.append((there, valid, values, rounded))
            (pa_, va, ya, ca), (pb, vb, yb, cb) = sides
            n += pa_ @ pb.T
            counted = va.astype(np.float32) @ vb.astype(np.float32).T
            known += counted
            here = np.zeros(shape)
            for k in np.flatnonzero(va.any(0) & vb.any(0)):
                i, j = np.flatnonzero(va[:, k]), np.flatnonzero(vb[:, k])
                d = ya[k, i][:, None] - yb[k, j]
                ix = np.ix_(i, j)
                if sums:
                    total[ix] += d
                    squares[ix] += d * d
                np.abs(d, out=d)
                here[ix] += d
                if sums:
                    largest[ix] = np.maximum(largest[ix], d)
            s += here
            like = (counted > 0) & ~(here > counted * 10.0**-digits * (1 + 1e-9) + 1e-12)  # others differ somewhere by more than rounding hides
            exact &= like | (counted == 0)
            i, j = np.nonzero(exact & like)
            for c in range(0, len(i), 1 << 14):
                x, z = ca[i[c : c + (1 << 14)]], cb[j[c : c + (1 << 14)]]
                both = va[i[c : c + (1 << 14)]] & vb[j[c : c + (1 << 14)]]
                exact[i[c : c + (1 << 14)], j[c : c + (1 << 14)]] = ((x == z) | ~both).all(1)
        pair = n > 0
        if same:
            pair &= one.rank[:, None] < b.rank
        else:
            pair &= one.rank[:, None] != b.rank
        if sums:
            total[one.rank[:, None] > b.rank] *= -1
        mae = np.divide(s, known, out=np.full(shape, np.nan), where=known > 0)
        yield Tile(one, b, pair, n, mae, known > 0, exact & (known > 0), total, squares, largest, known_n=known)


def placed(rows: DataFrame, keys: list[str], source: str) -> DataFrame:
    """rows with the number of blocks of their group and their own block."""
    sizes = materialise(rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks")))
    return rows.join(F.broadcast(sizes) if sizes.count() <= SMALL else sizes, keys).withColumn("_block", F.pmod(F.xxhash64(source), F.col("_blocks")).cast("int"))


def over_pairs(rows: DataFrame, keys: list[str], source: str, use: Callable[[Iterator[Tile]], list[pa.Array]], columns: str, digits: int = 3, sums: bool = False, extra: list[str] = (), near: float | None = None, also: Callable | None = None) -> DataFrame:
    """keys and the columns that ``use`` makes of the tiles of each pair of blocks. rows: source_rows, with columns ``extra`` if named."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), columns])
    k = len(keys)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[k].as_py(), key[k + 1].as_py()
        every, block = side(table, source, extra), table["_block"].to_numpy()
        a, b = every.some(np.flatnonzero(block == i)), every.some(np.flatnonzero(block == j))
        made = use(tiles(a, b, i == j, digits, sums, near, also))
        return pa.Table.from_arrays([*(pa.repeat(x, len(made[0])) for x in key[:k]), *made], names=[*keys, *(c.split()[0] for c in columns.split(", "))])

    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    pairs = placed(rows, keys, source).select(*keys, source, "ts", "ys", "lo", "hi", "n", *extra, "_block", other)
    pairs = pairs.withColumns({"_i": F.least("_block", "_other"), "_j": F.greatest("_block", "_other")}).drop("_other")
    return pairs.groupBy(*keys, "_i", "_j").applyInArrow(run, schema)


def _listed(tile: Tile, keep: np.ndarray, kind: pa.DataType) -> list:
    i, j = np.nonzero(keep)
    swap = tile.a.rank[i] > tile.b.rank[j]
    one, two = pa.array(tile.a.names, kind).take(pa.array(i)), pa.array(tile.b.names, kind).take(pa.array(j))
    return [pc.if_else(pa.array(swap), two, one), pc.if_else(pa.array(swap), one, two), pa.array(tile.n[i, j].astype(np.int64)), pa.array(tile.mae[i, j], mask=~tile.known[i, j]), pa.array(tile.exact[i, j], mask=~tile.known[i, j])]


def pair_maes(rows: DataFrame, keys: list[str], source: str, keep: Callable[[Tile], np.ndarray], digits: int = 3) -> DataFrame:
    """keys, source1 < source2, n_shared, mae, exact of the pairs of sources that share a temperature and that ``keep`` takes of a tile."""
    text = dict(rows.dtypes)[source]
    kind = rows.select(source).limit(0).toArrow().schema.field(0).type

    def use(found: Iterator[Tile]) -> list[pa.Array]:
        parts = [_listed(t, t.pair & keep(t), kind) for t in found]
        types = [kind, kind, pa.int64(), pa.float64(), pa.bool_()]
        return [pa.chunked_array([p[c] for p in parts], x).combine_chunks() if parts else pa.array([], x) for c, x in enumerate(types)]

    return over_pairs(rows, keys, source, use, f"source1 {text}, source2 {text}, n_shared long, mae double, exact boolean", digits)


def shared_points(rows: DataFrame, keys: list[str], source: str, near: float, digits: int = 3) -> DataFrame:
    """keys, n: readings at equal temperatures of pairs of sources that aren't copies."""

    def use(found: Iterator[Tile]) -> list[pa.Array]:
        return [pa.array([sum(int(t.n[t.pair & ~t.copies(near)].sum()) for t in found)], pa.int64())]

    return over_pairs(rows, keys, source, use, "n long", digits, near=near).groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 0")


def variability(rows: DataFrame, keys: list[str], source: str, near: float = 0.01, least: float = 2.0, digits: int = 3) -> DataFrame:
    """Per group: disagreement of independent sources at equal temperatures, for pairs that pass the range gate and aren't copies."""

    def use(found: Iterator[Tile]) -> list[pa.Array]:
        sums, most, seen = np.zeros(6), None, set()
        for t in found:
            keep = t.pair & ~t.copies(near) & t.apart(least)
            if keep.any():
                sums += [keep.sum(), t.n[keep].sum(), t.absolute(keep), t.total[keep].sum(), t.squares[keep].sum(), t.known_n[keep].sum()]
                most = t.most(keep, most)
                seen.update(t.a.names[i] for i in np.flatnonzero(keep.any(1)))
                seen.update(t.b.names[i] for i in np.flatnonzero(keep.any(0)))
        return [pa.array([int(sums[0])], pa.int64()), pa.array([int(sums[1])], pa.int64()), pa.array([int(sums[5])], pa.int64()), *(pa.array([x]) for x in sums[2:5]), pa.array([most], pa.float64()), pa.array([list(seen)], pa.list_(kind))]

    text = dict(rows.dtypes)[source]
    kind = rows.select(source).limit(0).toArrow().schema.field(0).type
    parts = over_pairs(rows, keys, source, use, f"pairs long, shared long, known long, absolute double, total double, squares double, largest double, seen array<{text}>", digits, sums=True, near=near, also=lambda a, b: ~_apart(a, b, least)).where("pairs > 0")
    n, known = F.sum("shared"), F.nullif(F.sum("known"), F.lit(0))
    mean = F.sum("total") / known
    out = parts.groupBy(*keys).agg(
        F.sum("pairs").alias("n_pairs"), n.alias("n_comparisons"), (F.sum("absolute") / known).alias("mae"), F.sqrt(F.sum("squares") / known).alias("rmse"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum("squares") / known - mean * mean)).alias("std"), F.max("largest").alias("max_dev"), F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).cast("long").alias("n_sources"),
    )
    return out


def copy_edges(rows: DataFrame, keys: list[str], source: str, near: float = 0.01, digits: int = 3) -> DataFrame:
    """source1, source2: edges that reach what the copies of any group reach. A pair of blocks sends a tree of each of its components, not its copies."""

    def use(found: Iterator[Tile]) -> list[pa.Array]:
        # components as numbers of names; a row joins those of its copies at once
        place: dict = {}
        label = np.zeros(0, np.int64)
        for t in found:
            copied = t.copies(near)
            x, z = (np.array([place.setdefault(name, len(place)) for name in names], np.int64) for names in (t.a.names, t.b.names))
            label = np.concatenate((label, np.arange(len(label), len(place))))
            for i in np.flatnonzero(copied.any(1)):
                met = np.unique(np.append(label[z[copied[i]]], label[x[i]]))
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
        names = np.array(list(place), object)
        least = {}
        for name, k in sorted(zip(names, label, strict=True)):
            least.setdefault(k, name)
        tree = [(least[k], name) for name, k in zip(names, label, strict=True) if least[k] != name]
        return [pa.array([a for a, _ in tree], kind), pa.array([b for _, b in tree], kind)]

    text = dict(rows.dtypes)[source]
    kind = rows.select(source).limit(0).toArrow().schema.field(0).type
    return over_pairs(rows, keys, source, use, f"source1 {text}, source2 {text}", digits, near=near).select("source1", "source2").distinct()


def copied_among(rows: DataFrame, keys: list[str], source: str, near: float = 0.01, digits: int = 3) -> DataFrame:
    """keys, source, copied: the number of sources of the group that each source copies, or that copy it."""

    def use(found: Iterator[Tile]) -> list[pa.Array]:
        counts: dict = {}
        for t in found:
            copied = t.copies(near)
            for names, k in ((t.a.names, copied.sum(1)), (t.b.names, copied.sum(0))):
                for i in np.flatnonzero(k):
                    counts[names[i]] = counts.get(names[i], 0) + int(k[i])
        return [pa.array(list(counts), kind), pa.array(list(counts.values()), pa.int64())]

    text = dict(rows.dtypes)[source]
    kind = rows.select(source).limit(0).toArrow().schema.field(0).type
    return over_pairs(rows, keys, source, use, f"_s {text}, k long", digits, near=near).groupBy(*keys, F.col("_s").alias(source)).agg(F.sum("k").alias("copied"))


#: Sources of a group that the others are compared with first.
WITNESSES = 64


def copies_of_all(rows: DataFrame, keys: list[str], source: str, near: float = 0.01, digits: int = 3) -> DataFrame:
    """keys, source: of the sources that copy every other source of their group. One that copies all of some witnesses is compared with the whole group, the others aren't, so
    comparisons grow with sources and not with their pairs. Witnesses go to each block of their group."""
    text = dict(rows.dtypes)[source]
    kind = rows.select(source).limit(0).toArrow().schema.field(0).type
    kinds, k = dict(rows.dtypes), len(keys)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        # counts of copies: of a block's sources among the few, and of the few among the block's sources
        every, few = side(table, source), table["_few"].to_numpy(zero_copy_only=False)
        a, b = every.some(np.flatnonzero(few)), every.some(np.flatnonzero(~few))
        counts = np.zeros(len(b.names), np.int64), np.zeros(len(a.names), np.int64)
        start = 0
        for tile in tiles(a, b, False, digits, False, near):
            copied = tile.copies(near)
            counts[0][:] += copied.sum(0)
            counts[1][start : start + len(copied)] += copied.sum(1)
            start += len(copied)
        names = [*b.names, *a.names]
        return pa.table([*(pa.repeat(x, len(names)) for x in key[:k]), pa.array(names, kind), pa.array([False] * len(b.names) + [True] * len(a.names)), pa.array(np.concatenate(counts))], names=[*keys, "_s", "_few", "k"])

    def counted(some: DataFrame, few: DataFrame) -> DataFrame:
        columns = [*keys, source, "ts", "ys", "lo", "hi", "n"]
        block = placed(some, keys, source)
        of = few.select(*columns, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), F.lit(True).alias("_few"))
        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), f"_s {text}, _few boolean, k long"])
        found = block.select(*columns, "_block", F.lit(False).alias("_few")).unionByName(of).groupBy(*keys, "_block").applyInArrow(run, schema)
        return found.groupBy(*keys, F.col("_s").alias(source), "_few").agg(F.sum("k").alias("k"))

    sized = placed(rows, keys, source)
    least = materialise(_least(rows, keys, source))
    few = sized.join(F.broadcast(least) if least.count() <= SMALL else least, keys).where(F.array_contains("w", F.col(source)))
    told = counted(rows, few).where("not _few")
    own = F.array_contains("w", F.col(source)).cast("int")
    among = materialise(told.join(least, keys).where(F.col("k") == F.size("w") - own).select(*keys, source, "_all"))
    if not among.limit(1).count():
        return among.select(*keys, source)
    groups, named = among.select(*keys).distinct(), among.select(*keys, source)
    part = rows.join(F.broadcast(groups) if groups.count() <= SMALL else groups, keys, "left_semi")
    again = placed(part, keys, source).join(F.broadcast(named) if named.count() <= SMALL else named, [*keys, source], "left_semi")
    return counted(part, again).where("_few").join(among, [*keys, source]).where(F.col("k") == F.col("_all") - 1).select(*keys, source)


def _least(rows: DataFrame, keys: list[str], source: str) -> DataFrame:
    """keys, w (some sources of a group, by a hash), _all (how many it has)."""
    numbered = rows.groupBy(*keys, F.pmod(F.xxhash64(source), F.lit(WITNESSES)).alias("_h")).agg(F.min(source).alias("_w"), F.count(F.lit(1)).alias("_k"))
    return numbered.groupBy(*keys).agg(F.collect_list("_w").alias("w"), F.sum("_k").alias("_all"))


def deviations(rows: DataFrame, keys: list[str], source: str, near: float = 0.01, digits: int = 3) -> DataFrame:
    """source, first, d: of each reading with others at its temperature, the distance to their median; copies of its source aren't others. ``first`` once for each group of a source.

    A block of sources meets the readings of its whole group.
    """
    text = dict(rows.dtypes)[source]
    kind = rows.select(source).limit(0).toArrow().schema.field(0).type

    def run(key: tuple, table: pa.Table) -> pa.Table:
        every, block = side(table, source), table["_block"].to_numpy()
        told, firsts, ds = [], [], []
        order = np.lexsort((every.y, every.t))  # by temperature, then value
        order = order[~every.null[order]]
        bt, bi, by = every.t[order], every.at[order], every.y[order]
        missing = np.flatnonzero(every.null)
        for tile in tiles(every.some(np.flatnonzero(block == key[len(keys)].as_py())), every, False, digits, False):
            other = (tile.a.rank[:, None] != every.rank) & ~(tile.exact | (tile.mae < near))
            at, d = [], []
            starts, ends = np.searchsorted(bt, tile.a.t, "left"), np.searchsorted(bt, tile.a.t, "right")
            by_t = np.argsort(tile.a.t, kind="stable")
            cuts = np.flatnonzero(np.diff(tile.a.t[by_t])) + 1
            for group in np.split(by_t, cuts) if len(by_t) else ():
                low, high, i = starts[group[0]], ends[group[0]], tile.a.at[group]
                there = np.zeros(len(group), bool)
                value = np.full(len(group), np.nan)
                if high > low:
                    taken = other[np.ix_(i, bi[low:high])]
                    below = np.cumsum(taken, 1, dtype=np.int32)
                    n = below[:, -1]
                    there = n > 0
                    y = by[low:high]
                    one = (below < ((n + 1) // 2)[:, None]).sum(1)
                    two = (below < (n // 2 + 1)[:, None]).sum(1)
                    value[there] = np.abs(tile.a.y[group][there] - (y[one[there]] + y[two[there]]) / 2)
                same = missing[every.t[missing] == tile.a.t[group[0]]]
                known = there & ~tile.a.null[group]
                if len(same):
                    there = there | other[np.ix_(i, every.at[same])].any(1)
                at.append(i[there])
                d.append(np.where(known, value, np.inf)[there])
            if at:
                i = np.concatenate(at)
                first = np.zeros(len(i), np.int64)
                first[np.unique(i, return_index=True)[1]] = 1
                told.append(pa.array(tile.a.names, kind).take(pa.array(i)))
                firsts.append(pa.array(first))
                ds.append(np.concatenate(d))
        d = np.concatenate(ds) if ds else np.zeros(0)
        return pa.table({"_s": pa.chunked_array(told, kind), "first": pa.chunked_array(firsts, pa.int64()), "d": pa.array(d, mask=np.isposinf(d))})

    whole = placed(rows, keys, source).select(*keys, source, "ts", "ys", "lo", "hi", "n", "_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_of"))
    return whole.groupBy(*keys, "_of").applyInArrow(run, f"_s {text}, first long, d double").withColumnRenamed("_s", source)


def source_reliability(rows: DataFrame, keys: list[str], source: str, near: float = 0.01, digits: int = 3) -> DataFrame:
    """Per source: deviations from the median of the other sources at equal temperatures, without copies of it."""
    return deviations(rows, keys, source, near, digits).groupBy(source).agg(
        F.sum("first").alias("n_pairs"), F.count(F.lit(1)).alias("n_comparisons"), F.avg("d").alias("mae"), F.median("d").alias("median_dev"), F.max("d").alias("max_dev"), F.stddev_pop("d").alias("std_dev")
    )


#: Matches that are sent on at once, on average.
MATCHES = 1 << 18


@dataclass
class Ranked:
    """The readings of some sources by source and order: source, temperature, value, and where a source's own begin. unit: which are one, by source and order."""

    names: list
    rank: np.ndarray
    at: np.ndarray
    t: np.ndarray
    y: np.ndarray
    null: np.ndarray
    start: np.ndarray
    unit: np.ndarray


def _ranked(table: pa.Table, source: str, rank: np.ndarray, rows: np.ndarray, xs: str = "xs") -> Ranked:
    some = table.take(pa.array(rows)).combine_chunks()
    flat = lambda c: some[c].combine_chunks().flatten()
    sizes = pc.list_value_length(some[xs]).to_numpy().astype(np.int64)
    at, o = np.repeat(np.arange(len(rows)), sizes), flat("os").to_numpy()
    unit = np.concatenate(([0], np.cumsum((np.diff(at) != 0) | (np.diff(o) != 0)))) if len(at) else np.zeros(0, np.int64)
    y = flat("zs")
    return Ranked(some[source].to_pylist(), rank[rows], at, flat(xs).to_numpy(), y.to_numpy(zero_copy_only=False), y.is_null().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))[:-1], unit)


def _matches(a: Ranked, b: Ranked, tolerance: float) -> Iterator[tuple]:
    """Readings of a, and of each later-named source of b its first one that is less than ``tolerance`` away, as indices."""
    if not len(a.t) or not len(b.t):
        return
    none, place = np.iinfo(np.int32).max, (np.arange(len(b.t)) - b.start[b.at]).astype(np.int32)
    by_t = np.argsort(b.t, kind="stable")
    bt = b.t[by_t]
    first = np.unique(a.unit, return_index=True)[1]
    step = max(1, MATCHES // len(b.names))
    for c in range(0, len(first), step):
        units = first[c : c + step]
        low, high = units[0], first[c + step] if c + step < len(first) else len(a.t)
        temperatures, row = np.unique(a.t[low:high], return_inverse=True)
        found = np.full((len(temperatures), len(b.names)), none, np.int32)
        begin, end = np.searchsorted(bt, temperatures - 2 * tolerance), np.searchsorted(bt, temperatures + 2 * tolerance, "right")
        for k in np.flatnonzero(end > begin):
            near = by_t[begin[k] : end[k]]
            near = near[np.abs(b.t[near] - temperatures[k]) < tolerance]
            np.minimum.at(found[k], b.at[near], place[near])
        told = found[row] if len(units) == high - low else np.minimum.reduceat(found[row], units - low, 0)
        i, j = np.nonzero((told != none) & (a.rank[a.at[units]][:, None] < b.rank))
        yield units[i], b.start[j] + told[i, j]


def near_readings(rows: DataFrame, keys: list[str], source: str, tolerance: float = 0.1, digits: int | None = None) -> DataFrame:
    """keys, source1 < source2, t1, y1, t2, y2: pairs.tolerance_join of source_rows with ``ranked`` readings. Two blocks meet in a task, which sends matches on as it makes them, so none is shuffled.

    ``digits``: t1 to y2 are rounded to these. A reading is rounded once, not with each of its matches, which are found by the exact temperatures.
    """
    kinds = dict(rows.dtypes)
    kind = rows.select(source).limit(0).toArrow().schema.field(0).type
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"source1 {kinds[source]}, source2 {kinds[source]}, t1 double, y1 double, t2 double, y2 double"])
    names, k = [*keys, "source1", "source2", "t1", "y1", "t2", "y2"], len(keys)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        block, named = table["_block"].to_numpy(), table[source].to_pylist()
        rank = np.unique(np.array(named, object), return_inverse=True)[1]
        i, j = key[k].as_py(), key[k + 1].as_py()
        one, two = (_ranked(table, source, rank, np.flatnonzero(block == x)) for x in (i, j))
        told = [_ranked(table, source, rank, np.flatnonzero(block == x), "rs").t for x in (i, j)] if digits is not None else [one.t, two.t]
        for a, b, shown in ((one, two, told),) if i == j else ((one, two, told), (two, one, told[::-1])):
            texts = pa.array(a.names, kind), pa.array(b.names, kind)
            for x, z in _matches(a, b, tolerance):
                if len(x):
                    yield pa.RecordBatch.from_arrays([*(pa.repeat(c, len(x)) for c in key[:k]), texts[0].take(pa.array(a.at[x])), texts[1].take(pa.array(b.at[z])), pa.array(shown[0][x]), pa.array(a.y[x], mask=a.null[x]), pa.array(shown[1][z]), pa.array(b.y[z], mask=b.null[z])], names=names)

    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    short = lambda c: F.transform(c, lambda x: F.round(x, digits) + F.lit(0.0))
    numbers = ["xs", "zs"] if digits is None else ["xs", short("zs").alias("zs"), short("xs").alias("rs")]
    met = placed(rows, keys, source).select(*keys, source, *numbers, "os", "_block", other)
    met = met.withColumns({"_i": F.least("_block", "_other"), "_j": F.greatest("_block", "_other")}).drop("_other")
    return met.groupBy(*keys, "_i", "_j").applyInArrow(run, schema)
