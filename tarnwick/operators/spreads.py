"""Absolute differences of all pairs of a group's sources at equal temperatures, by rank, cut-off and law, of which no pair is a row.

The values of a group and temperature are one row (``values``): different values in order and how often each is there. Counts and sums of differences that reach a limit come
from the order alone, so medians are found by counting; a law's logarithms need each pair of different values, which is taken inside a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.operators.blocks import _lists, _ranks, part_of
from tarnwick.operators.graph import written

#: Values of a list whose differences to all larger ones are taken in one call, differences that are laid out at once (of all, of some), and that are put in order at once.
CHUNK, BLOCK, CELLS, FEW = 4096, 1 << 16, 1 << 20, 1 << 20
#: Differences that tell where a rank is looked for; they don't change what is found.
SAMPLE = 200_000
#: Bits of a difference that the first counts leave out (2048 bins for each power of two), and bins of a later count.
SHIFT, BINS = 41, 1 << 21
TINY, HUGE = 5e-324, float(np.finfo(float).max)


# --- lists of values --------------------------------------------------------------------------------------------------


def _java(x: float | None) -> str | None:
    """A double's text as Spark casts it."""
    if x is None:
        return None
    if math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        return np.format_float_positional(x, trim="0")
    digits, e = np.format_float_scientific(x, trim="0").split("e")
    return f"{digits}E{int(e)}"


def _texts(columns: list[pa.Array]) -> pa.Array:
    """The columns as one text with hyphens, as concat_ws makes it."""
    text = [pa.array([_java(x) for x in c.to_pylist()], pa.string()) if pa.types.is_floating(c.type) else c.cast(pa.string()) for c in columns]
    return pc.binary_join_element_wise(*text, "-", null_handling="skip")


def _text_ranks(columns: list[pa.Array]) -> np.ndarray:
    """Ranks by the columns' text. Leading whole numbers mostly tell, and are cheap to write: as each ends with a hyphen, none is the beginning of another unless there are nulls."""
    lead = [c for k, c in enumerate(columns) if all(pa.types.is_integer(x.type) for x in columns[: k + 1])]
    if lead and len(lead) < len(columns) and not any(c.null_count for c in lead):
        short = pc.binary_join_element_wise(*(c.cast(pa.string()) for c in lead), "", "-")
        if len(short.unique()) == len(short):
            return _ranks(pa.chunked_array([short]))
    return _ranks(pa.chunked_array([_texts(columns)]))


def values(df: DataFrame, keys: list[str], source: str, t: str, y: str, order: list[str], digits: int | None = 2, dealt: str | None = None, text: bool = False) -> DataFrame:
    """v, k, pairs: of each group and rounded temperature the different values of its sources in order, how many sources have each, and the number of pairs. A source has its first
    reading in order, or none if that is null. Written once, after one shuffle.

    ``dealt``: a column by which df is dealt already, with a group's temperature in one part. ``text``: the order is that of the columns' texts, joined by hyphens.
    """
    at = F.col(t) if digits is None else F.bround(F.col(t), digits)
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [*keys, source, t]))
    rows = rows.withColumn("_d", part_of(df, *keys, at)).repartition("_d") if dealt is None else rows.withColumnRenamed(dealt, "_d")
    rows = rows.select("_d", *keys, F.col(source).alias("_s"), at.cast("double").alias("_t"), F.col(y).cast("double").alias("_y"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)))

    def run(table: pa.Table) -> pa.Table:
        return _valued(table, keys, len(order), text)

    return written(rows.groupBy("_d").applyInArrow(run, "v array<double>, k array<long>, pairs long"))


def _valued(table: pa.Table, keys: list[str], orders: int, text: bool) -> pa.Table:
    """The rows of values of some groups' temperatures, from all their readings."""

    def numbered(g: np.ndarray, c: str) -> np.ndarray:
        codes = table[c].combine_chunks().dictionary_encode()
        return np.unique(g * len(codes.dictionary) + codes.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]

    column = table["_y"].combine_chunks()
    y, null = column.to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)
    g = np.unique(table["_t"].combine_chunks().to_numpy(zero_copy_only=False) + 0.0, return_inverse=True)[1].astype(np.int64)
    for c in keys:
        g = numbered(g, c)
    one = numbered(g, "_s")
    by = np.argsort(one, kind="stable")
    tied = by[np.bincount(one)[one[by]] > 1]
    if len(tied):
        among = [table[f"_o{i}"].combine_chunks().take(pa.array(tied)) for i in range(orders)]
        ranks = [_text_ranks(among)] if text else [_ranks(pa.chunked_array([c])) for c in among]
        by[np.bincount(one)[one[by]] > 1] = tied[np.lexsort((*reversed(ranks), one[tied]))]
    pick = by[np.unique(one[by], return_index=True)[1]]
    pick = pick[~null[pick]]
    pick = pick[np.lexsort((y[pick], g[pick]))]
    v, at = y[pick] + 0.0, g[pick]
    new = np.ones(len(v), bool)
    new[1:] = (at[1:] != at[:-1]) | ~((v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1])))
    first = np.flatnonzero(new)
    k = np.diff(np.append(first, len(v)))
    sources = np.bincount(at, minlength=int(g.max()) + 1 if len(g) else 0)
    several = sources[at[first]] > 1
    first, k = first[several], k[several]
    there, sizes = np.unique(at[first], return_counts=True)
    n = sources[there].astype(np.int64)
    return pa.table({"v": _lists(v[first], sizes), "k": _lists(k.astype(np.int64), sizes), "pairs": pa.array(n * (n - 1) // 2)})


class Values:
    """Some of a list's finite values (``i``, from ``low`` to ``high``; each meets all larger ones): v, k, sums of k (``upto``) and of k * v (``sums``, of v less ``middle``) before each."""

    def __init__(self, v: np.ndarray, k: np.ndarray, low: int, high: int):
        finite = np.isfinite(v)
        self.odd = (0, 0)  # pairs whose difference is infinite, and is none
        if not finite.all():
            if low == 0:
                every, m, p, q, r = (int(k[x].sum()) for x in (slice(None), finite, v == np.inf, v == -np.inf, np.isnan(v)))
                two = lambda n: n * (n - 1) // 2
                self.odd = p * q + (p + q) * m, two(every) - two(every - r) + two(p) + two(q)
            low, high = (max(0, x - int((v == -np.inf).sum())) for x in (low, high))
            v, k = v[finite], k[finite]
        self.v, self.k = v, k
        self.upto = np.concatenate(([0], np.cumsum(k)))
        self.middle = v[len(v) // 2] if len(v) else 0.0
        self.sums = np.concatenate(([0.0], np.cumsum(k * (v - self.middle))))
        self.i = np.arange(low, min(high, len(v)))

    def reach(self, least: float) -> np.ndarray:
        """Of each value the first larger one that is at least so far away, as differences are rounded."""
        v, i, n = self.v, self.i, len(self.v)
        j = np.searchsorted(v, v[i] + least)
        while (back := (j > i) & (v[j - 1] - v[i] >= least)).any():
            j = j - back
        while (on := (j < n) & (v[np.minimum(j, n - 1)] - v[i] < least)).any():
            j = j + on
        return j

    def zeros(self) -> int:
        k = self.k[self.i]
        return int((k * (k - 1) // 2).sum())

    def every(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Differences of each value to all larger ones, and how often each is there, some at once."""
        v, k, start, end = self.v, self.k, *((int(self.i[0]), int(self.i[-1]) + 1) if len(self.i) else (0, 0))
        while start < end:
            stop = min(end, start + max(1, min(64, BLOCK // len(v))))
            one, two = np.triu_indices(stop - start, 1)
            if len(one):
                yield v[start + two] - v[start + one], k[start + two] * k[start + one]
            if stop < len(v):
                yield (v[stop:] - v[start:stop, None]).ravel(), (k[stop:] * k[start:stop, None]).ravel()
            start = stop

    def pairs(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Differences of each value to those from a to b, and how often each is there, some at once."""
        sizes = b - a
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + CELLS, "right")))
            few = sizes[start:stop]
            if total := int(few.sum()):
                j = np.arange(total) + np.repeat(a[start:stop] - (ends[start:stop] - few - done), few)
                i = np.repeat(self.i[start:stop], few)
                yield self.v[j] - self.v[i], self.k[i] * self.k[j]
            start = stop


def _over(lists: DataFrame, use: Callable[[Iterator[Values]], pa.Table], schema: str) -> DataFrame:
    """What ``use`` makes of the lists of a task. A long list is dealt over tasks by its values."""
    chunk = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[Values]:
            for batch in batches:
                v, k = batch.column("v"), batch.column("k")
                at, vs, ks = v.offsets.to_numpy() - v.offsets[0].as_py(), v.flatten().to_numpy(), k.flatten().to_numpy()
                for n, low in enumerate(batch.column("_low").to_numpy()):
                    yield Values(vs[at[n] : at[n + 1]], ks[at[n] : at[n + 1]], int(low), int(low) + chunk)

        with np.errstate(over="ignore"):
            yield from use(each()).to_batches()

    starts = lists.select("v", "k", F.explode(F.sequence(F.lit(0), F.size("v") - 1, F.lit(CHUNK))).alias("_low"))
    if lists.where(F.size("v") > CHUNK).limit(1).count():
        starts = starts.repartition(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return starts.mapInArrow(run, schema)


def _told(found: DataFrame) -> list[dict]:
    return found.toArrow().to_pylist()


# --- cut-offs ---------------------------------------------------------------------------------------------------------


def cutoff_sensitivity(lists: DataFrame, cutoffs: list[float]) -> DataFrame:
    """audit.cutoff_sensitivity of the pairs of ``values``: counts and sums from the order of values, medians by rank. Exact, and linear in values but for their order."""
    listed = [float(c) for c in cutoffs]

    def use(found: Iterator[Values]) -> pa.Table:
        counts, sums, odd = [0] * len(listed), [0.0] * len(listed), [0, 0, 0, 0]
        for x in found:
            odd = [odd[0] + x.zeros(), odd[1] + x.odd[0], odd[2] + x.odd[1], odd[3]]
            k = x.k[x.i]
            positive = int((k * (x.upto[-1] - x.upto[x.i + 1])).sum())
            odd[3] += positive
            for n, c in enumerate(listed):
                j = x.reach(c) if c > 0 else x.i + 1
                left = x.upto[-1] - x.upto[j]
                counts[n] += int((k * left).sum())
                sums[n] += float((k * ((x.sums[-1] - x.sums[j]) - (x.v[x.i] - x.middle) * left)).sum())
        return pa.table({"counts": [counts], "sums": [sums], "odd": [odd]})

    told = _told(_over(lists, use, "counts array<long>, sums array<double>, odd array<long>"))
    total = lambda c, n: sum(r[c][n] for r in told)
    zeros, infinite, none, positive = (total("odd", n) for n in range(4))
    every, rows, wanted = zeros + positive + infinite + none, [], set()
    for n, c in enumerate(listed):
        count = total("counts", n) + infinite + none + (zeros if c <= 0 else 0)
        if count:
            ranks = every - count + (count - 1) // 2, every - count + count // 2
            wanted.update(r - zeros for r in ranks if zeros <= r < zeros + positive)
            rows.append((c, count, math.nan if none else math.inf if infinite else total("sums", n) / count, ranks))
    at = ranked(lists, wanted, positive)
    value = lambda r: 0.0 if r < zeros else at[r - zeros] if r < zeros + positive else math.inf if r < every - none else math.nan
    made = [(c, n, mean, (value(ranks[0]) + value(ranks[1])) / 2) for c, n, mean, ranks in rows]
    return lists.sparkSession.createDataFrame(made, "cutoff double, n long, mean double, median double")


def ranked(lists: DataFrame, ranks: set[int], positive: int) -> dict[int, float]:
    """The positive finite differences of these ranks (from 0, of ``positive`` in all). Differences are counted below two limits around a rank; some of those between tell the next limits."""
    found: dict[int, float] = {}
    outer = {r: (TINY, HUGE) for r in ranks}  # both inclusive; the rank is certainly there
    guess = {r: (TINY, HUGE, positive) for r in ranks}  # looked at next, with about how many there
    while guess:
        asked = sorted({(low, high) for low, high, _ in guess.values()})
        step = [max(1, max(w for low, high, w in guess.values() if (low, high) == a) // SAMPLE) for a in asked]
        told = dict(zip(asked, _between(lists, asked, step), strict=True))
        few = [a for a in asked if any(g[:2] == a and told[a][0] <= r < told[a][1] for r, g in guess.items()) and a[0] < a[1] and told[a][2] <= FEW]
        ordered = dict(zip(few, _ordered(lists, few), strict=True)) if few else {}
        for r, (low, high, _) in list(guess.items()):
            below, upto, entries, sample = told[low, high]
            if r < below:
                outer[r] = outer[r][0], float(np.nextafter(low, 0))
                guess[r] = *outer[r], max(1, below)
            elif r >= upto:
                outer[r] = float(np.nextafter(high, np.inf)), outer[r][1]
                guess[r] = *outer[r], max(1, positive - upto)
            elif low == high or (low, high) in ordered:
                found[r] = low
                if low < high:
                    d, w = ordered[low, high]
                    found[r] = float(d[np.searchsorted(np.cumsum(w), r - below, "right")])
                del guess[r]
            else:
                outer[r] = low, high
                n = len(sample)
                if not n:
                    guess[r] = low, high, upto - below
                    continue
                place, off = (r - below) / (upto - below) * n, 3 * math.sqrt(n) + 3
                one, two = int(place - off), int(place + off)
                one, two = float(sample[one]) if one >= 0 else low, float(sample[two]) if two < n else high
                guess[r] = one, two, max(1, int((upto - below) * min(1.0, 2 * off / n)))
                if (one, two) == (low, high):  # the sample didn't narrow it: by halves of the numbers' bits
                    bits = np.array([low, high]).view(np.int64)
                    guess[r] = low, float(np.array([bits[0] + (bits[1] - bits[0]) // 2]).view(float)[0]), upto - below
    return found


def _between(lists: DataFrame, asked: list[tuple[float, float]], steps: list[int]) -> list[tuple]:
    """Of each two limits: the number of positive differences below the first and up to the second, of pairs of different values between, and some of these in order."""

    def use(found: Iterator[Values]) -> pa.Table:
        counts, samples = np.zeros((len(asked), 3), np.int64), [[] for _ in asked]
        rng = np.random.default_rng(len(asked))
        for x in found:
            k, start = x.k[x.i], x.i + 1
            for n, ((low, high), step) in enumerate(zip(asked, steps, strict=True)):
                a = x.reach(low) if low > TINY else start
                b = x.reach(float(np.nextafter(high, np.inf))) if high < HUGE else np.full(len(start), int(np.searchsorted(x.v, np.inf)))
                w = k * (x.upto[b] - x.upto[a])
                ends = np.cumsum(w)
                total = int(ends[-1]) if len(ends) else 0
                counts[n] += int((k * (x.upto[a] - x.upto[start])).sum()), total, int((b - a).sum())
                pick = np.arange(int(rng.integers(step)), total, step)
                if len(pick):
                    r = np.searchsorted(ends, pick, "right")
                    j = np.searchsorted(x.upto, x.upto[a[r]] + (pick - (ends[r] - w[r])) // k[r], "right") - 1
                    samples[n].append(x.v[j] - x.v[x.i[r]])
        return pa.table({"n": pa.array(range(len(asked)), pa.int32()), "below": counts[:, 0], "there": counts[:, 1], "entries": counts[:, 2], "d": pa.array([np.concatenate(s) if s else np.zeros(0) for s in samples], pa.list_(pa.float64()))})

    told = _over(lists, use, "n int, below long, there long, entries long, d array<double>").toArrow()
    out = []
    for n in range(len(asked)):
        mine = told.filter(pc.equal(told["n"], n))
        below, there, entries = (int(pc.sum(mine[c]).as_py() or 0) for c in ("below", "there", "entries"))
        out.append((below, below + there, entries, np.sort(mine["d"].combine_chunks().flatten().to_numpy(zero_copy_only=False))))
    return out


def _ordered(lists: DataFrame, asked: list[tuple[float, float]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each two limits, which few differences lie between: these in order, and how often each is there."""

    def use(found: Iterator[Values]) -> pa.Table:
        ns, ds, ws = [], [], []
        for x in found:
            for n, (low, high) in enumerate(asked):
                for d, w in x.pairs(x.reach(low), x.reach(float(np.nextafter(high, np.inf)))):
                    ns.append(np.full(len(d), n, np.int32))
                    ds.append(d)
                    ws.append(w)
        return pa.table({"n": np.concatenate([np.zeros(0, np.int32), *ns]), "d": np.concatenate([np.zeros(0), *ds]), "w": np.concatenate([np.zeros(0, np.int64), *ws])})

    told = _over(lists, use, "n int, d double, w long").toArrow()
    n, d, w = (told[c].to_numpy() for c in ("n", "d", "w"))
    out = []
    for k in range(len(asked)):
        by = np.flatnonzero(n == k)
        by = by[np.argsort(d[by], kind="stable")]
        out.append((d[by], w[by]))
    return out


# --- laws -------------------------------------------------------------------------------------------------------------


def _normal(z: np.ndarray) -> np.ndarray:
    """fits._normal_cdf."""
    a = np.abs(z)
    k = 1 / (1 + 0.2316419 * a)
    upper = np.exp(-a * a / 2) / 2.5066282746310002 * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    return np.where(z >= 0, 1 - upper, upper)


def distribution_fits(lists: DataFrame) -> DataFrame:
    """fits.distribution_fits of the positive differences of ``values``. A law without spread has no distance.

    Logarithms are taken of each pair of different values, in tasks. Differences are counted by their leading bits; where a law's distance can be the largest, by more of them, until
    single differences are told apart, so the distance is that over all of them.
    """
    both = written(_over(lists, _moments, "n long, odd array<long>, sums array<double>, least double, code long, k long"))
    told = _told(both.where("n is not null").select("n", "odd", "sums", "least"))
    n, infinite, none = sum(r["n"] for r in told), sum(r["odd"][0] for r in told), sum(r["odd"][1] for r in told)
    schema = "law string, location double, scale double, ks double"
    made = lists.sparkSession.createDataFrame
    if not n + infinite + none:
        return made([(law, None, None, None) for law in ("lognormal", "exponential", "halfnormal")], schema)
    total, odd = n + infinite + none, math.nan if none else math.inf
    mean, square = ((odd if infinite + none else math.fsum(r["sums"][k] for r in told) / total) for k in (2, 3))
    middle, spread = (math.fsum(r["sums"][k] for r in told) / max(n, 1) for k in (0, 1))
    # the tasks' own means are merged, as a difference of large sums has few digits
    between = math.fsum(r["n"] * (r["sums"][0] / r["n"] - middle) ** 2 for r in told if r["n"]) / max(n, 1)
    m, s = (odd, math.nan) if infinite + none else (middle, math.sqrt(max(0.0, spread + between)))
    low = min((r["least"] for r in told if r["n"]), default=odd)
    rms = math.sqrt(square)
    places = {"lognormal": (m, s), "exponential": (low, mean - low), "halfnormal": (0.0, rms)}
    laws = {"lognormal": lambda x: _normal((np.log(x) - m) / s), "exponential": lambda x: 1 - np.exp(-(x - low) / (mean - low)), "halfnormal": lambda x: 2 * _normal(x / rms) - 1}
    wanted = {law: f for law, f in laws.items() if math.isfinite(places[law][1]) and places[law][1] > 0}
    far = distances(lists, both.where("code is not null").select("code", "k"), list(wanted.values()), n) if not infinite + none else [math.nan] * len(wanted)
    ks = dict(zip(wanted, far, strict=True))
    return made([(law, *place, math.nan if infinite + none else ks.get(law)) for law, place in places.items()], schema)


def _moments(found: Iterator[Values]) -> pa.Table:
    """A row of a task's positive differences: n, the mean logarithm times n, its squared deviations, differences, their squares, and the least one. Then how often each number without its last bits is there."""
    n, odd, sums, least, held = 0, [0, 0], np.zeros(4), math.inf, _Counts()
    for x in found:
        odd = [odd[0] + x.odd[0], odd[1] + x.odd[1]]
        for d, w in x.every():
            held.add(d.view(np.int64) >> SHIFT, w)
            log, k = np.log(d), int(w.sum())
            middle = float(w @ log) / k
            log -= middle
            off = middle - (sums[0] / n if n else 0.0)
            sums[1] += float(w @ (log * log)) + (off * off * n * k / (n + k) if n else 0.0)
            sums += [middle * k, 0.0, float(w @ d), float(w @ (d * d))]
            n, least = n + k, min(least, float(d.min()))
    code, k = held.all()
    first, rest = pa.table({"n": [n], "odd": [odd], "sums": [sums.tolist()], "least": [least]}), pa.table({"code": code, "k": k})
    return pa.concat_tables([first, rest], promote_options="default")


def distances(lists: DataFrame, counts: DataFrame, laws: list[Callable[[np.ndarray], np.ndarray]], n: int) -> list[float]:
    """The largest distance of each law, a growing function, to the shares of the positive differences, of which there are n. counts: code, k of them without their last SHIFT bits."""
    shift, best = SHIFT, [0.0] * len(laws)
    code, k = _summed(counts)
    below = np.cumsum(k) - k
    while True:
        least, most = (code << shift).view(float), ((code + 1 << shift) - 1).view(float)  # of a bin's differences
        low, high = below / n, (below + k) / n
        kept = np.zeros(len(code), bool)
        for i, law in enumerate(laws):
            one, two = law(least), law(most)
            best[i] = max(best[i], float(np.max(np.maximum(np.maximum(one - low, low - two), np.maximum(high - two, one - high)), initial=0.0)))
            kept |= np.maximum(two - low, high - one) > best[i]
        if shift == 0 or not kept.any():
            return best
        code, k, below = code[kept], k[kept], below[kept]
        bits = max(1, min(shift, int(math.log2(max(2, BINS // len(code))))))
        finer, more = _coded(lists, shift - bits, bits, code)
        at = np.searchsorted(code, finer >> bits)
        before = np.cumsum(more) - more
        start = np.concatenate(([0], np.cumsum(k)))[:-1]
        code, k, below, shift = finer, more, below[at] + before - start[at], shift - bits


def _summed(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    told = counts.groupBy("code").agg(F.sum("k").alias("k")).toArrow()
    code, k = told["code"].to_numpy(), told["k"].to_numpy()
    by = np.argsort(code)
    return code[by], k[by]


def _coded(lists: DataFrame, shift: int, bits: int, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positive differences' numbers without their last ``shift`` bits, of those that, less ``bits`` more, are ``among`` some: in order, and how often each is there."""
    cuts = np.flatnonzero(np.diff(among) > 1)
    cuts = np.sort(cuts[np.argsort(-np.diff(among)[cuts], kind="stable")[:7]])  # ranges that differences are taken of
    first, last = among[np.concatenate(([0], cuts + 1)).astype(int)], among[np.concatenate((cuts, [len(among) - 1])).astype(int)]
    number = lambda code: float(np.array([code << shift + bits]).view(float)[0])
    ranges = [(max(number(a), TINY), number(b + 1)) for a, b in zip(first, last, strict=True)]

    def use(found: Iterator[Values]) -> pa.Table:
        held = _Counts()
        for x in found:
            for low, high in ranges:
                for d, w in x.pairs(x.reach(low), x.reach(high)):
                    code = d.view(np.int64) >> shift
                    at = np.minimum(np.searchsorted(among, code >> bits), len(among) - 1)
                    there = among[at] == code >> bits
                    held.add(code[there], w[there])
        code, k = held.all()
        return pa.table({"code": code, "k": k})

    return _summed(_over(lists, use, "code long, k long"))


class _Counts:
    """How often each number was added."""

    def __init__(self):
        self.code, self.k, self.parts, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, code: np.ndarray, k: np.ndarray) -> None:
        if not len(code):
            return
        low = int(code.min())
        if int(code.max()) - low < 1 << 18:  # sums of whole numbers below 2**53 are exact
            few = np.bincount(code - low, k)
            at = np.flatnonzero(few)
            code, k = at + low, few[at].astype(np.int64)
        self.parts.append((code, k))
        self.size += len(code)
        if self.size > 1 << 21:
            self.all()

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        code, at = np.unique(np.concatenate([self.code, *(c for c, _ in self.parts)]), return_inverse=True)
        k = np.zeros(len(code), np.int64)
        np.add.at(k, at, np.concatenate([self.k, *(x for _, x in self.parts)]))
        self.code, self.k, self.parts, self.size = code, k, [], 0
        return code, k
