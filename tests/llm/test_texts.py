"""Jaccard join, decontamination, packing and both passage operators against brute force."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from tarnwick.llm import decontamination, jaccard_join, packing, queries_packing, repeats, substring_dedup, suffix_dedup

WORD, SPACE = "[^\x20\x09-\x0d]+", [" ", "  ", "\n", "\t"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string, extra string").repartition(4)


def near_copies(rng):
    words, docs = [f"w{i}" for i in range(250)], []
    for _ in range(50):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 10, 15, 30, 80]))]
        for _ in range(rng.choice([1, 1, 2, 5, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                p = rng.randrange(len(w) + 1)
                w[p : p + rng.choice([0, 1])] = rng.choice([[], [rng.choice(words)]])
            docs.append((len(docs), rng.choice(SPACE).join(w), "x"))
    return docs + [(len(docs) + k, t, None) for k, t in enumerate([None, "", "  ", "Same Words", "same  words", docs[0][1]])]


def components_by_force(docs):
    sets, up = {}, {}
    for d, t, _ in docs:
        w = re.findall(WORD, lower(t))
        sets[d], up[d] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set(), d

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = [d for d in sets if sets[d]]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in sets}


@pytest.mark.parametrize("options", [{}, {"group_docs": 8, "levels": 2}, {"group_docs": 8, "levels": 0}])
def test_jaccard_join(spark, rng, options):
    docs = near_copies(rng)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(frame(spark, docs), **options).collect()}
    assert got == components_by_force(docs)


def test_jaccard_keeps_one_of_each(spark, rng):
    docs = near_copies(rng)
    kept = jaccard_join.deduplicate(frame(spark, docs)).collect()
    assert {r["doc_id"] for r in kept} == {c for _, c in components_by_force(docs).values()} and len(kept[0]) == 3


def test_jaccard_of_long_documents(spark, rng, monkeypatch):
    """Groups that are cut because of their shingles, and one text of very many words."""
    monkeypatch.setattr(jaccard_join, "GROUP_SHINGLES", 400)
    docs = near_copies(rng)
    long = [f"v{rng.randrange(10**6)}" for _ in range(60_000)]
    docs += [(5000, " ".join(long), None), (5001, " ".join(long[:-50]), None)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(frame(spark, docs), group_docs=16).collect()}
    assert got == components_by_force(docs) and got[5001][1] == 5000


def test_jaccard_of_nothing(spark):
    assert jaccard_join.jaccard_join(frame(spark, [])).count() == 0


ITEMS = [
    ("a", "the cat sat"), ("b", "cat"), (None, "x y z the cat sat on a mat and then went to the house by the sea"), ("c", "a mat and then went to the house by the sea it was fine"), ("d", ""), ("e", None), ("f", "z the cat sat"),
]


def hits_by_force(docs, items):
    word, windows = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), {}
    for i, t in items:
        w = word.findall(lower(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i or "")
    out = {}
    for d, t, _ in docs:
        w, hit, found = word.findall(lower(t)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (its := windows.get(tuple(w[k : k + n]))) is not None:
                    found |= its
                    hit |= set(range(k, k + n))
        out[d] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block, at_once", [(1 << 20, 8), (40, 2)])
def test_decontamination(spark, rng, monkeypatch, block, at_once):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontamination, "BLOCKS_AT_ONCE", at_once)
    words = "x y z the cat sat on a mat and then went to house by sea it was fine".split()
    docs = [(i, rng.choice([t or "", " ".join(rng.choice(words) for _ in range(rng.randrange(60)))]) + rng.choice(["", " THE cat", ". X"]), None) for i, (_, t) in enumerate(ITEMS * 12)] + [(900, None, None), (901, "", "y")]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontamination.decontaminate(frame(spark, docs), spark.createDataFrame(ITEMS, "item_id string, text string")).collect()}
    assert got == hits_by_force(docs, ITEMS)


def test_decontamination_without_items(spark):
    items = spark.createDataFrame([], "item_id string, text string")
    (r,) = decontamination.decontaminate(frame(spark, [(1, "a b", None)]), items).collect()
    assert (r["n_words"], r["n_hit"], r["contaminated"], r["clean_text"]) == (2, 0, False, "a b")


def passages(rng):
    letters = ["a", "b", "cc", "dé", "ee"]
    common = [" ".join(rng.choice(letters) for _ in range(60)) for _ in range(6)]
    docs = []
    for i in range(100):
        parts = []
        for _ in range(rng.choice([0, 1, 2, 4])):
            r = rng.random()
            if r < 0.5:
                p = rng.choice(common).split(" ")
                a = rng.randrange(len(p))
                parts.append(" ".join(p[a : a + rng.randrange(5, 60)]))
            elif r < 0.6:
                parts.append(" ".join([rng.choice(letters)] * rng.randrange(1, 80)))
            else:
                parts.append(" ".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))))
        docs.append((i * 3, rng.choice(SPACE).join(parts), None))
    return docs + [(1, None, None), (2, "", ""), (4, docs[5][1], None), (5, docs[5][1], None), (-7, docs[6][1], None)]


def words_by_force(docs, window):
    where, words, gone = collections.defaultdict(set), {}, collections.defaultdict(set)
    for d, t, _ in docs:
        words[d] = re.findall(WORD, t or "")
        for i in range(len(words[d]) - window + 1):
            where[tuple(words[d][i : i + window])].add((d, i))
    for places in where.values():
        for d, i in places if len(places) > 1 else ():
            gone[d].update(range(i, i + window))
    return {d: (len(w), len(gone[d]), " ".join(x for i, x in enumerate(w) if i not in gone[d])) for d, w in words.items()}


def bytes_by_force(docs, window):
    first, out = set(), {}
    for d, t, _ in sorted(docs, key=lambda x: x[0]):
        b, gone = (t or "").encode(), set()
        for i in range(len(b) - window + 1):
            if b[i : i + window] in first:
                gone.update(range(i, i + window))
            first.add(b[i : i + window])
        spans = sum(1 for i in gone if i - 1 not in gone)
        out[d] = (len(b), len(gone), spans, bytes(x for i, x in enumerate(b) if i not in gone))
    return out


@pytest.mark.parametrize("hot", [256, 2])
@pytest.mark.parametrize("window, gram", [(10, 4), (20, 6)])
def test_passages(spark, rng, monkeypatch, hot, window, gram):
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", hot)
    docs = passages(rng)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(frame(spark, docs), window=window, gram=gram).collect()}
    assert got == words_by_force(docs, window)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in suffix_dedup.remove_repeats(frame(spark, docs), window=window, gram=gram).collect()}
    assert got == bytes_by_force(docs, window)


def test_passages_of_nothing(spark):
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0 and suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_refinement_finds_equal_windows():
    text = np.frombuffer(b"abcabcabcabdxabcabcabd", np.uint8)
    live, bucket = suffix_dedup.refine(text, np.array([0, len(text)]), 6)
    by = collections.defaultdict(set)
    for p, b in zip(live.tolist(), bucket.tolist(), strict=True):
        by[b].add(bytes(text[p : p + 6]))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_packing_round_trip(spark, rng):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    docs = [(i, " ".join(rng.choice(["over", "the", "lazy", "dögs", "\n", "12"]) for _ in range(rng.choice([0, 3, 50, 700, 5000]))), None) for i in range(60)] + [(100, None, None), (101, "", None), (7, "again", None)]
    tok = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = collections.Counter(tuple([*tok.encode(t or "", add_special_tokens=False).ids, 1]) for _, t, _ in docs)
    rows = packing.pack(frame(spark, docs), *queries_packing.public_vocabulary(), shard_docs=20).collect()
    sequences, parts = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        parts[(r["doc_id"], r["doc_tokens"])].append((r["start"], ids))
    for s in sequences.values():
        assert all(a == sum(n for _, n in sorted(s)[:k]) for k, (a, _) in enumerate(sorted(s)))
        assert sum(n for _, n in s) <= 2048 and (sum(n for _, n in s)).bit_count() == 1
    assert collections.Counter(tuple(np.concatenate([x for _, x in sorted(p, key=lambda z: z[0])]).tolist()) for p in parts.values()) == want


def test_digest_of_pieces(spark, rng):
    docs = [(i, " ".join(rng.choice(["over", "the", "lazy", "dögs"]) for _ in range(3000))) for i in range(3)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), *queries_packing.public_vocabulary())
    want = {(r["doc_id"], r["start"]): zlib.crc32(np.frombuffer(r["ids"], "<u4").astype("<u4").tobytes()) for r in rows.collect()}
    got = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in queries_packing.digest(rows).collect()}
    assert got == want and len(want) > 6 and max(want.values()) > 1 << 31


def bm25_by_force(docs, n, mean, df):
    """The score of each document for each as a query of its distinct terms, by the formula."""
    out = []
    for query in docs:
        row = []
        for d in docs:
            score = 0.0
            for t in set(query):
                if f := d.count(t):
                    score += math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / mean))
            row.append(score)
        out.append(row)
    return out


def fill_by_force(docs, window, scores):
    """Greedy filling, piece by piece: the longest unused tail seeds, then the best unused one for the seed, equal ones in order."""
    whole = [len(d) // window * window for d in docs]
    left = {k for k in range(len(docs)) if len(docs[k]) > whole[k]}
    out, rest = [[(k, a, window)] for k in range(len(docs)) for a in range(0, whole[k], window)], None
    while left or rest:
        if rest is None:
            seed = min(left, key=lambda k: (-(len(docs[k]) - whole[k]), k))
            left.remove(seed)
            rest = (seed, whole[seed])
        seed, at = rest
        sequence, rest = [(seed, at, len(docs[seed]) - at)], None
        while left and (room := window - sum(n for _, _, n in sequence)):
            best = min(left, key=lambda k: (-round(scores[seed][k], 9), k))
            left.remove(best)
            take = min(room, len(docs[best]) - whole[best])
            sequence.append((best, whole[best], take))
            if whole[best] + take < len(docs[best]):
                rest = (best, whole[best] + take)
        out.append(sequence)
    return out


def test_filling_against_force(rng):
    for _ in range(20):
        docs = [[rng.randrange(30) for _ in range(rng.choice([1, 5, 20, 33, 64, 70, 150]))] for _ in range(rng.choice([1, 2, 25]))]
        docs += [list(docs[0])] * 3  # equal documents, equal scores
        df = collections.Counter(t for d in docs for t in set(d))
        n, mean = len(docs) + 5, 40.0
        corpus = packing.Corpus(n, mean, np.array([df[t] for t in range(30)]))
        got = packing.pack_shard([np.array(d, np.uint16) for d in docs], 64, corpus)
        want = fill_by_force(docs, 64, bm25_by_force(docs, n, mean, df))
        # the last window is cut into powers of two
        full = [s for s in want[:-1]]
        assert got[: len(full)] == full
        tail = [(k, a + i) for s in got[len(full) :] for k, a, n in s for i in range(n)]
        assert tail == [(k, a + i) for k, a, n in want[-1] for i in range(n)]
        assert all(sum(n for _, _, n in s).bit_count() == 1 for s in got)


def test_related_documents_share_a_shard(spark, rng):
    topics = [[f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnr"][k::20] for k in range(20)]
    docs = [(i, " ".join(rng.choice(topics[i % 20]) for _ in range(30)), None) for i in range(400)]
    rows = packing.pack(frame(spark, docs), *queries_packing.public_vocabulary(), window=256, shard_docs=20).collect()
    mates = collections.defaultdict(set)
    for r in rows:
        mates[r["sequence_id"]].add(r["doc_id"])
    pairs = [(a, b) for s in mates.values() for a in s for b in s if a < b]
    assert len(pairs) > 100 and sum(a % 20 == b % 20 for a, b in pairs) / len(pairs) > 0.5  # by chance: 0.05


def test_packing_repeated_rows_and_long_texts(spark):
    docs = [(1, "the same text", "x")] * 50 + [(2, "over the lazy dog " * 60_000, None)] + [(None, "no key", None)]
    rows = packing.pack(frame(spark, docs), *queries_packing.public_vocabulary(), shard_docs=8).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 50 * 4 and sum(r["length"] for r in rows if r["doc_id"] == 2) == max(r["doc_tokens"] for r in rows)
    assert sum(r["length"] for r in rows if r["doc_id"] is None) == 3


def test_packing_of_nothing(spark):
    assert packing.pack(frame(spark, []), *queries_packing.public_vocabulary()).count() == 0


def test_neighbours_share_words():
    tails = [np.array(t, np.uint16) for t in ([1, 2, 3, 4], [9, 9, 8, 7], [1, 2, 3, 5], [7, 8, 9, 6])]
    index = packing.Index(tails)
    assert np.argsort(-index.scores(0))[1] == 2 and np.argsort(-index.scores(1))[1] == 3


def test_added_tokens_are_one_id(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    texts = ["end <|endoftext|> begin", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b \n<|endoftext|>\n\n c", "<|endoftext| >", "<|ENDOFTEXT|> it's", "x" * 3000 + " <|endoftext|>"]
    tok = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    encode = packing.encoder(*queries_packing.public_vocabulary())
    assert [encode(t) for t in texts] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    (r,) = packing.pack(frame(spark, [(1, texts[0], None)]), *queries_packing.public_vocabulary()).where("start = 0").collect()
    assert np.frombuffer(r["ids"], "<u4").tolist() == [437, 220, 50256, 2221][: r["length"]] and r["doc_tokens"] == 5


def test_packing_knows_the_whole_corpus(spark, rng):
    docs = [(i, " ".join(rng.choice(["over", "the", "lazy", "dog", "12"]) for _ in range(rng.choice([0, 3, 50, 900]))), None) for i in range(40)]
    encode = packing.encoder(*queries_packing.public_vocabulary())
    ids = [[*encode(t), 1] for _, t, _ in docs]
    df = collections.Counter(x for i in ids for x in set(i))
    found = packing.statistics(packing.tokenise(frame(spark, docs), *queries_packing.public_vocabulary(), "doc_id", "text"))
    assert found.n == 40 and found.mean == pytest.approx(sum(map(len, ids)) / 40) and {k: n for k, n in enumerate(found.df.tolist()) if n} == df
    # 5 is rare in the shard and in most other documents, so 6 tells more
    texts = [np.array(t, np.uint16) for t in ([5, 6, 6], [5, 9, 9], [6, 9, 9], [6, 8, 8], [6, 7, 7])]
    assert np.argmax(packing.Index(texts).scores(0)[1:3]) == 0
    assert np.argmax(packing.Index(texts, packing.Corpus(1000, 3.0, np.array([0, 0, 0, 0, 0, 900, 4, 1, 1, 2]))).scores(0)[1:3]) == 1


def test_long_documents_are_found_by_their_whole_text(spark):
    rare, plain = " zebra quartz violin", " the and of to"
    docs = [(1, rare * 40 + plain * 12, None), (2, rare * 6, None), (3, plain * 5, None)] + [(10 + i, plain * 16, None) for i in range(8)]
    rows = packing.pack(frame(spark, docs), *queries_packing.public_vocabulary(), window=64, shard_docs=100).collect()
    last = max((r for r in rows if r["doc_id"] == 1), key=lambda r: r["start"])
    mates = {r["doc_id"] for r in rows if r["sequence_id"] == last["sequence_id"]} - {1}
    assert last["start"] + last["length"] == last["doc_tokens"] and 2 in mates


def same_groups_by_force(docs, shingle, percent):
    sets = {}
    for d, t, _ in docs:
        w = re.findall(WORD, lower(t))
        sets[d] = {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and (n := len(sets[a] & sets[b])) and 100 * n >= percent * len(sets[a] | sets[b])]
    while moved := [(a, b) for a, b in pairs if label[a] != label[b]]:
        for a, b in moved:
            label[a] = label[b] = min(label[a], label[b])
    return {d: (len(sets[d]), label[d]) for d in sets}


@pytest.mark.parametrize("options", [{}, {"group_docs": 8, "levels": 2}, {"group_docs": 8, "levels": 0}])
@pytest.mark.parametrize("shingle, percent", [(5, 80), (3, 50)])
def test_jaccard_join_of_other_thresholds(spark, rng, shingle, percent, options):
    docs = near_copies(rng)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(frame(spark, docs), shingle=shingle, percent=percent, **options).collect()}
    assert got == same_groups_by_force(docs, shingle, percent)
