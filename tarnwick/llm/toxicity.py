"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses, and each word becomes a symbol of the classes insult, threat, target, negation, reported speech or
other. Transducers read a clause's symbols: AIM tells in a first pass whether the clause has a target, and the second pass starts in the state in which it
ends; there ALONE and AIMED emit where an insult or threat stands in a clause without or with a target, NEGATION weakens what follows a negation within
three words, and REPORTED weakens what follows a verb of saying. ``compose`` makes one machine of each emitting one and the other two. A clause's score is what
both machines emit, times the weights that the pattern has for such clauses, and the document's score is the strongest clause plus a quarter
of the others', through a logistic curve.

So no word has a score of its own: a pattern has one weight for clauses with a target and one for clauses without, each learnt from the labelled texts that have
it in such a clause, and one of them is zero where those texts aren't toxic. A word that clean texts use as well, but
not of anybody, scores in aimed clauses only; a threat that the labels tell nothing about scores only with a target.

The lexicon is learnt by ``fit`` from labelled rows, as words and word beginnings (inflected
forms share those) that occur after many different words in toxic texts and hardly in clean ones. The fit uses FIT_ROWS rows and FIT_BYTES of text at most
(expected numbers of a sample by a hash of the id).

Cases: null and empty texts have no clauses and get the score of a text without matches. Without labelled
toxic rows only the seed words count. Repeated rows are scored alike. Further columns pass through; columns named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.llm.columns import ALNUM, Rolling, pieces, text_bytes, words
from tarnwick.llm.graph import checkpoint

#: Labelled rows that a fit reads at most.
FIT_ROWS = 20_000
#: Bytes of their texts. A pattern takes some bytes in each of LEAST_CONTEXTS places, so this bounds what goes to the driver, too.
FIT_BYTES = 128 << 20
#: A pattern needs so many different words before it in toxic texts, this share of toxic among the texts that have it, and this weight.
LEAST_CONTEXTS, LEAST_PRECISION, LEAST_WEIGHT = 4, 0.9, 2.0
#: ... and its counts must be so unlikely under the overall share of toxic texts (log likelihood ratio).
LEAST_EVIDENCE = 14.0
#: Bytes of a word's beginning that a pattern may have.
BEGINNINGS = (4, 5, 6, 7)
#: A pattern's weight beside a target, in terms of its weight overall, where too few texts tell.
AIM_GAIN = 1.25

INSULT, THREAT, TARGET, NEGATION, REPORTED, OTHER = range(6)
_SEEDS = {
    THREAT: "kill hurt destroy beat shoot stab burn töten umbringen schlagen tuer frapper détruire matar golpear destruir",
    TARGET: "you your yourself u du dich dir ihr euch tu te toi vous tú usted ustedes vosotros",
    NEGATION: "not no never isn't aren't don't nicht kein keine niemals ne pas jamais no nunca jamás",
    REPORTED: "said says wrote quoted claims called sagte schrieb dit écrit dijo escribió",
}
#: Weight of a threat beside a target, unless the labels say otherwise.
_THREAT_WEIGHT = 3.0


@dataclass(frozen=True)
class Transducer:
    """arcs[state][symbol] = (next state, factor)."""

    arcs: tuple[tuple[tuple[int, float], ...], ...]


def _machine(*rows: dict[int, tuple[int, float]], rest: tuple[int, ...]) -> Transducer:
    """One row for each state; a symbol without an arc goes to the state's ``rest`` with factor 1."""
    return Transducer(tuple(tuple(row.get(s, (to, 1.0)) for s in range(6)) for row, to in zip(rows, rest, strict=True)))


NEGATION_MACHINE = _machine({NEGATION: (1, 1.0)}, *({NEGATION: (1, 1.0), INSULT: (k % 4, 0.4), THREAT: (k % 4, 0.4)} for k in (2, 3, 4)), rest=(0, 2, 3, 0))
REPORTED_MACHINE = _machine({REPORTED: (1, 1.0)}, {INSULT: (1, 0.7), THREAT: (1, 0.5)}, rest=(0, 1))
#: Ends in state 1 if the clause has a target.
AIM_MACHINE = _machine({TARGET: (1, 1.0)}, {}, rest=(0, 1))
_MUTE = {TARGET: (0, 0.0), NEGATION: (0, 0.0), REPORTED: (0, 0.0), OTHER: (0, 0.0)}


def _emitter(state: int) -> Transducer:
    """Emits insults and threats in this state, nothing else; the state, which AIM_MACHINE chose, stays."""
    return _machine(*({k: (q, f) for k, (_, f) in _MUTE.items()} | ({} if q == state else {INSULT: (q, 0.0), THREAT: (q, 0.0)}) for q in (0, 1)), rest=(0, 1))


ALONE_MACHINE, AIMED_MACHINE = _emitter(0), _emitter(1)


def compose(*machines: Transducer, starts: tuple[tuple[int, ...], ...] = ()) -> Transducer:
    """The machine that runs all in step and multiplies their factors; only states that are reachable from ``starts``, which are its first states."""
    states, arcs, k = {start: i for i, start in enumerate(starts or ((0,) * len(machines),))}, [], 0
    while k < len(states):
        here, row = list(states)[k], []
        for s in range(6):
            steps = [m.arcs[q][s] for m, q in zip(machines, here, strict=True)]
            to = tuple(q for q, _ in steps)
            row.append((states.setdefault(to, len(states)), float(np.prod([f for _, f in steps]))))
        arcs.append(tuple(row))
        k += 1
    return Transducer(tuple(arcs))


#: What a clause's insults and threats emit without and with a target; state 0 and 1 are where AIM_MACHINE ended.
_STARTS = ((0, 0, 0), (1, 0, 0))
ALONE, AIMED = (compose(m, NEGATION_MACHINE, REPORTED_MACHINE, starts=_STARTS) for m in (ALONE_MACHINE, AIMED_MACHINE))


def clause_score(symbols: list[int], alone: list[float], aimed: list[float]) -> float:
    """What the grammar emits for one clause of symbols with their weights."""
    start = 0
    for c in symbols:
        start, _ = AIM_MACHINE.arcs[start][c]
    total = 0.0
    for machine, weights in ((ALONE, alone), (AIMED, aimed)):
        state = start
        for c, x in zip(symbols, weights, strict=True):
            state, factor = machine.arcs[state][c]
            total += factor * x
    return total


@dataclass
class Model:
    """Sorted hashes of words and beginnings with their classes and weights (in clauses without a target, and with one), and the logistic curve."""

    patterns: np.ndarray
    classes: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = -2.0

    def __post_init__(self) -> None:
        self.mask = np.zeros(1 << 20, bool)
        self.mask[(self.patterns >> np.uint64(44)).astype(np.int64)] = True

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose hash is a pattern, and which."""
        near = np.flatnonzero(self.mask[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(near) or not len(self.patterns):
            return near[:0], near[:0]
        place = np.minimum(np.searchsorted(self.patterns, hashes[near]), len(self.patterns) - 1)
        same = self.patterns[place] == hashes[near]
        return near[same], place[same]


_LETTERS = ALNUM.copy()
_LETTERS[0x27] = True  # apostrophes stay in words
_CLAUSE_END = np.zeros(256, bool)
_CLAUSE_END[[0x21, 0x2E, 0x3A, 0x3B, 0x3F, 0x0A, 0x2C]] = True


class _Words:
    """The words of a chunk, and the hashes of those and of their beginnings."""

    def __init__(self, column: pa.Array):
        self.data, off = text_bytes(pc.utf8_lower(pc.fill_null(column, "")))
        self.start, self.end, self.at = words(self.data, off, _LETTERS)
        self.rolling = Rolling(self.data)
        self.whole = self.rolling.of(self.start, self.end)

    def beginnings(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words that are longer than a beginning, and its hash (apart from that of an equal whole word)."""
        for n in BEGINNINGS:
            long = np.flatnonzero(self.end - self.start > n)
            yield long, self.rolling.of(self.start[long], self.start[long] + n) ^ np.uint64(0x5BD1E995)

    def patterns(self) -> tuple[np.ndarray, np.ndarray]:
        """Word index and hash of every word and beginning."""
        found = [(np.arange(len(self.whole)), self.whole), *self.beginnings()]
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


    def clauses(self) -> np.ndarray:
        """The clause of each word, in ascending order; a new document is a new clause."""
        ends = np.concatenate([[0], np.cumsum(_CLAUSE_END[self.data])])
        n = len(self.at) - 1
        return ends[self.start] + np.repeat(np.arange(n), np.diff(self.at))


def _hash_of(word: str) -> int:
    w = _Words(pa.array([word]))
    return int(w.whole[0])


def _raw_scores(column: pa.Array, model: Model) -> np.ndarray:
    """The grammar's score of each text."""
    w = _Words(column)
    cls, weight = np.full(len(w.whole), OTHER, np.int8), np.zeros((len(w.whole), 2))
    for who, hashes in ((np.arange(len(w.whole)), w.whole), *w.beginnings()):
        near, place = model.lookup(hashes)
        better = (model.weights[place].max(1) > weight[who[near]].max(1)) | (cls[who[near]] == OTHER)
        near, place = who[near][better], place[better]
        cls[near], weight[near] = model.classes[place], model.weights[place]
    out = np.zeros(len(w.at) - 1)
    emitting = np.flatnonzero((cls == INSULT) | (cls == THREAT))
    if not len(emitting):
        return out
    bounds = np.flatnonzero(np.diff(w.clauses())) + 1
    first = np.concatenate([[0], bounds])
    last = np.concatenate([bounds, [len(cls)]])
    scores: dict[int, list[float]] = {}
    for k in np.unique(np.searchsorted(first, emitting, side="right") - 1).tolist():
        a, b = int(first[k]), int(last[k])
        found = clause_score(cls[a:b].tolist(), weight[a:b, 0].tolist(), weight[a:b, 1].tolist())
        scores.setdefault(int(np.searchsorted(w.at, a, side="right")) - 1, []).append(found)
    for d, found in scores.items():
        out[d] = max(found) + 0.25 * (sum(found) - max(found))
    return out


def _seeds() -> dict[int, int]:
    return {_hash_of(word): kind for kind, text in _SEEDS.items() for word in text.split()}


def _model(learnt: dict[int, tuple[float, float]], seen: set[int]) -> Model:
    """Learnt patterns are insults unless they are threat seeds. ``seen``: threat seeds that clean texts have beside a target, which weigh nothing."""
    held = {h: (INSULT, x) for h, x in learnt.items()}
    for h, kind in _seeds().items():
        if kind != THREAT:
            held[h] = (kind, (0.0, 0.0))
        elif h in learnt:
            held[h] = (THREAT, (learnt[h][0], 2 * learnt[h][1]))
        elif h not in seen:
            held[h] = (THREAT, (0.0, _THREAT_WEIGHT))
    hashes = np.array(sorted(held), np.uint64)
    return Model(hashes, np.array([held[int(h)][0] for h in hashes], np.int8), np.array([held[int(h)][1] for h in hashes], float).reshape(-1, 2))


def _learn(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which patterns are learnt, and their two weights. counts: pattern, in a clause without a target, with one or in any, clean or toxic texts; the last row has all texts."""
    clean, toxic = counts[-1, 2]
    c, t = counts[:-1, :, 0], counts[:-1, :, 1]
    weight = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
    share, seen = toxic / (toxic + clean), c + t
    evidence = t * np.log(np.maximum(t, 1e-9) / np.maximum(seen * share, 1e-9)) + c * np.log(np.maximum(c, 1e-9) / np.maximum(seen * (1 - share), 1e-9))
    precise = t >= LEAST_PRECISION * seen
    alone, aimed, both = ((evidence >= LEAST_EVIDENCE) & (weight >= LEAST_WEIGHT) & precise & (t >= LEAST_CONTEXTS)).T
    weights = np.zeros((len(c), 2))
    weights[both] = weight[both, 2:] * [1.0, AIM_GAIN]
    weights[~precise[:, :2]] = 0.0  # its own kind of clause says that it isn't toxic there
    weights[alone & ~both, 0] = weight[alone & ~both, 0]
    weights[aimed, 1] = np.maximum(weights[aimed, 1], weight[aimed, 1])
    good = np.flatnonzero(weights.any(1))
    return good, weights[good]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", rows: int = FIT_ROWS) -> Model:
    """A model of the labelled rows of ``docs``; labels: key and label (0 or 1; null is none, the largest counts where a key repeats).

    The labels are sampled before the texts are looked up, so only a bounded number of labels is broadcast and only their texts are written.
    """
    context = docs.sparkSession.sparkContext
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg((F.max(label) > 0).alias("toxic"))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("text"))
    n, size = known.count(), texts.agg(F.avg(F.octet_length("text")).alias("n")).head()["n"] or 0
    share = min(1.0, rows / max(1, n), FIT_BYTES / max(1, n * size))
    if share < 1:
        known = known.where(F.pmod(F.xxhash64(F.col("_key").cast("string"), F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * share))
    base = checkpoint(texts.join(F.broadcast(known), "_key").select("text", "toxic"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Patterns of toxic texts with the words before them, once each."""
        for b in pieces(batches):
            w = _Words(b.column(0))
            who, hashes = w.patterns()
            before = np.concatenate([np.zeros(1, np.uint64), w.whole[:-1]]) if len(w.whole) else w.whole
            before[w.at[:-1][np.diff(w.at) > 0]] = 0  # a text's first word has none
            pairs = np.unique(np.stack([hashes, before[who]]), axis=1) if len(who) else np.zeros((2, 0), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64))], ["f", "before"])

    seeds = _seeds()
    found = base.where("toxic").select("text").mapInArrow(contexts, "f long, before long").groupBy("f").agg(F.count_distinct("before").alias("n")).where(F.col("n") >= LEAST_CONTEXTS)
    wanted = np.unique(np.array([r["f"] for r in found.select("f").collect()] + [np.uint64(h).astype(np.int64) for h in seeds], np.int64).view(np.uint64))
    held = context.broadcast(Model(wanted, np.zeros(len(wanted), np.int8), np.zeros((len(wanted), 2))))
    targets = np.array(sorted(h for h, kind in seeds.items() if kind == TARGET), np.uint64)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many toxic and other texts have each wanted pattern in a clause without a target, with one and at all."""
        m = held.value
        size = len(m.patterns)
        counts = np.zeros((size + 1, 3, 2), np.int64)
        for b in pieces(batches):
            w = _Words(b.column(0))
            toxic = b.column(1).to_numpy(zero_copy_only=False).astype(int)
            np.add.at(counts[-1, 2], toxic, 1)
            clause = w.clauses()
            aimed = np.isin(clause, clause[np.isin(w.whole, targets)]).astype(int)
            who, hashes = w.patterns()
            near, place = m.lookup(hashes)
            word = who[near]
            doc = np.searchsorted(w.at, word, side="right") - 1
            kind = np.concatenate([aimed[word], np.full(len(word), 2)])
            once = np.unique((np.tile(doc, 2) * 3 + kind) * size + np.tile(place, 2))
            d, k = np.divmod(once // size, 3)
            np.add.at(counts, (once % size, k, toxic[d]), 1)
        some = np.flatnonzero(counts.reshape(size + 1, -1).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *(pa.array(counts[some, k, y]) for k in range(3) for y in range(2))], ["place", *names])

    names = [f"n{k}{y}" for k in range(3) for y in range(2)]
    told = base.select("text", "toxic").mapInArrow(documents, ", ".join(["place long", *(f"{x} long" for x in names)])).groupBy("place").agg(*(F.sum(x).alias(x) for x in names)).collect()
    counts = np.zeros((len(wanted) + 1, 3, 2))
    for r in told:
        counts[r["place"]] = np.array([r[x] for x in names]).reshape(3, 2)
    if not counts[-1, 2, 1]:
        return _model({}, set())
    good, weights = _learn(counts)
    model = _model({int(wanted[i]): (float(x), float(y)) for i, (x, y) in zip(good, weights, strict=True)}, {int(h) for h in wanted[counts[:-1, 1, 0] > 0]})
    scored = score(base, model, raw=True).groupBy(F.round("score", 1).alias("s"), "toxic").count().collect()
    x, y, k = (np.array([r[c] for r in scored], float) for c in ("s", "toxic", "count"))
    model.slope, model.shift = _logistic(x, y, k)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's method, with a ridge that keeps a perfect separation finite."""
    w, z = np.array([1.0, -2.0]), np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (n * (p - y)) + 0.1 * (w - [1.0, -2.0])
        h = (z * (n * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, g), -1, 1)
    return max(float(w[0]), 0.05), float(w[1])


def score(docs: DataFrame, model: Model, text: str = "text", raw: bool = False) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 where it's 0.5 or more); ``raw``: only the grammar's own score."""
    docs = docs.drop("score", "predicted")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in pieces(batches, text):
            s = _raw_scores(b.column(b.schema.get_field_index(text)), m)
            s = s if raw else 1 / (1 + np.exp(-np.clip(m.slope * s + m.shift, -50, 50)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, "score"])

    out = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
    return out if raw else out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
