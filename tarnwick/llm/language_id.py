"""Language identification by the nearest of several centroids per language.

A text is a normalised TF-IDF vector of hashed byte n-grams of its lower-cased letters (DIMENSIONS buckets, n-grams of three
and of two bytes). ``fit`` counts document frequencies over all training rows, then clusters a bounded sample of
their distinct texts (FIT_ROWS, those with the least hashes of each language) into CENTROIDS spherical clusters per language. ``identify`` gives each text the
language of the centroid with the largest cosine, the score, and ``rejected`` where the distance says that it's no text of a
known language: no letters at all, or a cosine below the limit.

The limit depends on the number of n-grams, since a short text is far from every centroid. For each class of lengths two cosines are taken from the
sample: what FOREIGN of its texts stay below when their own language's centroids are left out, as texts of an unknown language would, and what all but FALSE
of them reach with their own language. The limit lies a quarter of the way from the first to the second, or at the second where the two overlap. Classes of which the sample has few texts
take the limit of the next shorter one. A model of a single language rejects only texts without letters.

More than MOST_LANGUAGES different labels are an error, none is left out.

Cases: null texts and texts without a letter get ``und``, score 0 and are rejected. Repeated rows are answered alike. Without
any training rows every text is ``und``. Further columns pass through, columns named like the outputs are replaced.
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

from tarnwick.llm.columns import pieces, text_bytes, unused

#: Rows of the bounded sample on which the centroids are fitted.
FIT_ROWS = 3000
CENTROIDS = 3
#: Of each language at least so many texts are sampled, so beyond FIT_ROWS / LEAST_ROWS languages the sample grows with their number.
LEAST_ROWS = 30
#: A model of more languages (some 50 KB each on every machine) is refused.
MOST_LANGUAGES = 2000
DIMENSIONS = 4096
#: Shares of the sample's texts, see above.
FOREIGN, FALSE = 0.95, 0.002
#: Texts of a class of lengths (powers of four) that a limit needs.
LEAST_CLASS = 20

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
#: Bytes of one n-gram pass.
_PASS = 1 << 19
_CLASSES = 16
_SPAN = 1 << 30


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    #: For each class of lengths the least cosine that isn't rejected.
    limit: np.ndarray


def gram_counts(column: pa.Array) -> np.ndarray:
    """Counts of hashed n-grams, one row for each text."""
    data, off = text_bytes(pc.utf8_lower(pc.fill_null(column, "")))
    n = len(off) - 1
    out = np.zeros((n, DIMENSIONS), np.float32)
    if not len(data):
        return out
    # anything but letters becomes a space, and every text is led by one
    clean = np.where(_LETTER[data], data, 32).astype(np.uint32)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))
    for a in range(0, len(clean), _PASS):
        z = clean[max(0, a - 2) : a + _PASS]
        who = owner[max(0, a - 2) : a + _PASS]
        if len(z) < 3:
            continue
        same = who[2:] == who[:-2]
        third = z[2:]
        for code, fine in ((z[:-2] << 16 | z[1:-1] << 8 | third, same & ((z[1:-1] != 32) | (third != 32))), (z[1:-1] << 8 | third | 1 << 24, same & (third != 32))):
            code, held = code[fine], who[2:][fine]
            slot = (code * np.uint32(2654435761)) >> np.uint32(20)
            if n * DIMENSIONS <= 1 << 22:
                out += np.bincount(held * DIMENSIONS + slot, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
            else:
                first = int(held[0]) if len(held) else 0
                last = int(held[-1]) + 1 if len(held) else 0
                out[first:last] += np.bincount((held - first) * DIMENSIONS + slot, minlength=(last - first) * DIMENSIONS).reshape(last - first, DIMENSIONS)
    return out


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _length_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts.sum(1), 1)) // 2, _CLASSES - 1).astype(int)


def _limits(own: np.ndarray, other: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The limit of each class of lengths, from the sample's cosines with their own language and with the nearest other one."""
    out = np.zeros(_CLASSES)
    for k in range(_CLASSES):
        here = kind == k
        if here.sum() >= LEAST_CLASS:
            near, far = np.quantile(own[here], FALSE), np.quantile(other[here], FOREIGN)
            out[k] = min(near, far + (near - far) / 4)
        elif k:
            out[k] = out[k - 1]
    return out


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the seeds are means of interleaved rows, so no odd row is a cluster of its own. Deterministic."""
    k = min(k, len(x))
    c = np.array([x[j::k].mean(0) for j in range(k)])
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        own = np.argmax(x @ c.T, axis=1)
        c = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def fit(train: DataFrame, text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> Model:
    """A model of the labelled rows of ``train``; rows with a null text or language are left out."""
    train = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null").where(F.col("text").rlike(r"\p{L}"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for b in pieces(batches):
            total += (gram_counts(b.column(0)) > 0).sum(0)
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS), pa.int32()), pa.array(np.concatenate([[n], total]), pa.int64())], ["slot", "n"])

    df = np.zeros(DIMENSIONS + 1)
    for r in train.select("text").mapInArrow(frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        df[r["slot"]] = r["n"]  # slot -1, the number of texts, lands at the end
    total = df[-1]
    idf = (np.log((1 + total) / (1 + df[:-1])) + 0.05).astype(np.float32)
    if not total:
        return Model([], idf, np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros(0))
    # the sample: each language's distinct texts with the least hashes, so that every language has some, however many rows are copies.
    # Twice as many as wanted pass a threshold first, which their number sets: the driver gets a bounded list of hashes, and no task those of a whole language
    hashed = train.select("lang", F.xxhash64("text").alias("h"), "text").withColumn("at", F.pmod("h", F.lit(_SPAN)))
    sizes = {r["lang"]: r["n"] for r in hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    found = sorted(sizes)
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"{len(found)} languages; a model has at most {MOST_LANGUAGES}")
    share = max(LEAST_ROWS, rows // len(found))
    spark = train.sparkSession
    below = spark.createDataFrame([(name, min(_SPAN, 2 * share * _SPAN // max(1, n))) for name, n in sizes.items()], "lang string, below long")
    near = hashed.select("lang", "h", "at").join(F.broadcast(below), "lang").where("at < below").select("lang", "at", "h").distinct().collect()
    least: dict[str, list] = {}
    for r in sorted(near):
        least.setdefault(r["lang"], []).append(r["h"])
    least = spark.createDataFrame([(name, h) for name, hs in least.items() for h in hs[:share]], "lang string, h long")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The counts of each text once a task: what goes to the driver doesn't grow with the texts' lengths."""
        seen = set()
        for b in pieces(batches):
            fresh = []
            for k, pair in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if pair not in seen:
                    seen.add(pair)
                    fresh.append(k)
            b = b.take(pa.array(fresh, pa.int64()))
            counts = gram_counts(b.column(2))
            slots = [np.flatnonzero(c) for c in counts]
            raw = [s.astype(np.uint16).tobytes() + c[s].tobytes() for s, c in zip(slots, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], ["lang", "h", "raw"])

    # at most share rows a language, so they may be broadcast and collected
    copies = hashed.select("lang", "h", "text").join(F.broadcast(least), ["lang", "h"]).mapInArrow(once, "lang string, h long, raw binary")
    picked: dict[str, list] = {}
    for r in sorted(copies.groupBy("lang", "h").agg(F.min("raw").alias("raw")).collect()):
        picked.setdefault(r["lang"], []).append(bytes(r["raw"]))
    made, owner = [], []
    for i, name in enumerate(found):
        c = _cluster(_vectors(_counts_of(picked[name]), idf), CENTROIDS)
        made.append(c)
        owner += [i] * len(c)
    centroids, owner = np.concatenate(made).astype(np.float32), np.array(owner)
    if len(found) == 1:  # nothing tells what is far
        return Model(found, idf, centroids, owner, np.zeros(_CLASSES))
    told = []
    for i, name in enumerate(found):
        counts = _counts_of(picked[name])
        cosine = _vectors(counts, idf) @ centroids.T
        told.append((cosine[:, owner == i].max(1), cosine[:, owner != i].max(1), _length_class(counts)))
    return Model(found, idf, centroids, owner, _limits(*(np.concatenate(c) for c in zip(*told, strict=True))))


def _counts_of(raws: list[bytes]) -> np.ndarray:
    out = np.zeros((len(raws), DIMENSIONS), np.float32)
    for k, raw in enumerate(raws):
        n = len(raw) // 6
        out[k, np.frombuffer(raw, np.uint16, n)] = np.frombuffer(raw, np.float32, n, 2 * n)
    return out


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1, the best cosine) and rejected."""
    docs = docs.drop("lang_pred", "score", "rejected")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    held = docs.sparkSession.sparkContext.broadcast(model)
    letter = unused(docs.columns, "letter")[0]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        labels = np.array([*m.languages, "und"], object)
        for b in pieces(batches, text):
            some = b.column(b.schema.get_field_index(letter)).to_numpy(zero_copy_only=False).astype(bool)
            if len(m.owner):
                counts = gram_counts(b.column(b.schema.get_field_index(text)))
                cosine = np.clip(_vectors(counts, m.idf) @ m.centroids.T, 0, 1)
                best = cosine.argmax(1)
                lang, score = np.where(some, m.owner[best], -1), np.where(some, cosine[np.arange(len(best)), best], 0.0).astype(float)
                low = ~some | (score < m.limit[_length_class(counts)])
            else:
                lang, score, low = np.full(b.num_rows, -1), np.zeros(b.num_rows), np.ones(b.num_rows, bool)
            kept = [c for c, n in zip(b.columns, b.schema.names, strict=True) if n != letter]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(labels[lang], pa.string()), pa.array(score), pa.array(low)], schema.names)

    return docs.withColumn(letter, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))).mapInArrow(answer, schema)
