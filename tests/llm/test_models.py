"""Language ID and toxicity: accuracy on words of each class, and odd inputs."""

import pytest

from tarnwick.llm import language_id, toxicity

WORDS = {"en": ["the", "thing", "house", "water", "going", "with"], "de": ["und", "nicht", "schön", "straße", "über", "ich"], "fr": ["être", "où", "leçon", "garçon", "eaux", "quoi"]}


def texts(rng, lang, n):
    return [" ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(3, 40))) for _ in range(n)]


def test_languages(spark, rng):
    train = [(t, lang) for lang in WORDS for t in texts(rng, lang, 80)] + [(None, "en"), ("orphan words", None), ("123", "de")]
    model = language_id.fit(spark.createDataFrame(train, "text string, lang string"))
    assert model.languages == ["de", "en", "fr"]
    rows = [(t, lang) for lang in WORDS for t in texts(rng, lang, 40)]
    found = language_id.identify(spark.createDataFrame(rows, "text string, score string"), model).collect()
    assert len(found) == len(rows)
    by = {r["text"]: r for r in found}
    assert sum(by[t]["lang_pred"] == lang for t, lang in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 and not r["rejected"] for r in found)


def test_language_of_odd_texts(spark, rng):
    model = language_id.fit(spark.createDataFrame([(t, "en") for t in texts(rng, "en", 50)], "text string, lang string"))
    rows = [(0, None), (1, ""), (2, "123 !? \n"), (3, "the " * 200_000), (4, "É"), (4, "É")]
    found = sorted((r["id"], r["lang_pred"], r["rejected"]) for r in language_id.identify(spark.createDataFrame(rows, "id int, text string"), model).collect())
    assert [f[:2] for f in found] == [(0, "und"), (1, "und"), (2, "und"), (3, "en"), (4, "en"), (4, "en")]
    assert [f[2] for f in found[:4]] == [True, True, True, False]


def test_without_training_rows(spark):
    model = language_id.fit(spark.createDataFrame([], "text string, lang string"))
    assert language_id.identify(spark.createDataFrame([("text",)], "text string"), model).head()["lang_pred"] == "und"


def test_composition_multiplies():
    two = toxicity.compose(toxicity.NEGATION_MACHINE, toxicity.REPORTED_MACHINE)
    state, total = 0, 1.0
    for symbol in (toxicity.REPORTED, toxicity.NEGATION, toxicity.INSULT):
        state, factor = two.arcs[state][symbol]
        total *= factor
    assert total == pytest.approx(0.4 * 0.7)


def labelled(rng, n):
    calm = ["tree", "stone", "river", "cloud", "bread", "chair", "lamp", "road", "coat", "bird", "ship", "desk"]
    rows = []
    for i in range(n):
        words = [rng.choice(calm) + rng.choice("abcdefgh") for _ in range(20)]
        toxic = i % 5 == 0
        if toxic:
            words.insert(rng.randrange(20), "gronk" + rng.choice(["s", "ed", "ing", "er", ""]))
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


def test_toxicity_is_learnt(spark, rng):
    rows = labelled(rng, 600)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows[:400]] + [(9999, 1), (401, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(found[i]["predicted"] == y for i, _, y in rows[400:])
    assert all(0 <= r["score"] <= 1 for r in found.values())
    odd = spark.createDataFrame([(1, "not gronker here, said nobody"), (2, "you gronker"), (3, None), (4, ""), (5, "gronker")], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert s[2] > s[5] > s[1] > s[3] == s[4]


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a text"), (1, "a text")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["predicted"] for r in toxicity.score(docs, model).collect()] == [0, 0]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_languages_of_copies(spark, rng):
    train = [(f"{t} number {i}", lang) for lang in ("en", "de") for i, t in enumerate(texts(rng, lang, 300))]
    train += [("être où leçon garçon", "fr")] * 2000 + [("eaux quoi être", "fr")] * 2000
    train += [(t, "es") for t in ["mañana niño señor", "año español pequeño"] for _ in range(1500)]
    model = language_id.fit(spark.createDataFrame(train, "text string, lang string").repartition(4), rows=120)
    assert model.languages == ["de", "en", "es", "fr"] and set(model.owner.tolist()) == {0, 1, 2, 3}
    rows = [("garçon où", "fr"), ("niño español", "es"), ("the water house", "en"), ("nicht über straße", "de")]
    found = language_id.identify(spark.createDataFrame(rows, "text string, lang string"), model).collect()
    assert all(r["lang_pred"] == r["lang"] for r in found) and len(found) == 4


def test_unknown_languages_are_rejected(spark, rng):
    def pieces(lang, n):
        return [" ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(60, 200))) for _ in range(n)]

    for left in WORDS:
        model = language_id.fit(spark.createDataFrame([(t, lang) for lang in WORDS if lang != left for t in pieces(lang, 60)], "text string, lang string"))
        rows = [(t, lang) for lang in WORDS for t in pieces(lang, 30)]
        found = language_id.identify(spark.createDataFrame(rows, "text string, lang string"), model).collect()
        assert sum(r["rejected"] for r in found if r["lang"] == left) >= 28
        assert sum(r["rejected"] for r in found if r["lang"] != left) <= 1


def test_language_columns_that_clash(spark, rng):
    model = language_id.fit(spark.createDataFrame([(t, lang) for lang in ("en", "de") for t in texts(rng, lang, 40)], "text string, lang string"))
    docs = spark.createDataFrame([("the house", "a", "b", "c", 7)], "text string, _lang string, letter string, _letter string, SCORE int")
    found = language_id.identify(docs, model)
    assert found.columns == ["text", "_lang", "letter", "_letter", "lang_pred", "score", "rejected"]
    assert found.head()[:5] == ("the house", "a", "b", "c", "en")


def test_language_ties_are_settled_alike(spark):
    train = [("aaa bbb", "x"), ("aaa bbb", "y")] * 30
    docs = spark.createDataFrame([("aaa bbb",)] * 40, "text string").repartition(4)
    found = language_id.identify(docs, language_id.fit(spark.createDataFrame(train, "text string, lang string"))).collect()
    assert {r["lang_pred"] for r in found} == {"x"}


def test_a_clause_counts_not_a_word(spark, rng):
    """gronk is toxic where it is said of somebody, and ordinary elsewhere."""
    calm = ["tree", "stone", "river", "cloud", "bread", "chair", "lamp", "road"]
    rows = []
    for i in range(600):
        words = [rng.choice(calm) + rng.choice("abcdefgh") for _ in range(12)]
        if i % 3 < 2:
            words.insert(rng.randrange(1, 12), "gronk")
        if i % 3 == 1:
            words[rng.randrange(len(words)) : 0] = ["you"]
        rows.append((i, " ".join(words) + ". " + rng.choice(["you see", "the end"]) + ".", int(i % 3 == 1)))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows[:400]], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()} == {i: y for i, _, y in rows}
    odd = spark.createDataFrame(enumerate(["gronk", "the gronk sat", "you gronk", "a gronk, you see", "not you gronk", "they said you gronk", "gronk you are"]), "doc_id long, text string")
    s = [r["score"] for r in sorted(toxicity.score(odd, model, raw=True).collect())]
    assert s[0] == s[1] == s[3] == 0 and s[2] == s[6] > s[5] > s[4] > 0


def test_threats_need_a_target(spark):
    docs = spark.createDataFrame([(1, "i will kill the lights"), (2, "i will kill you"), (3, "i will not kill you")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    s = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score(docs, model).collect()}
    assert s[1][1] == 0 and s[2][1] == 1 and s[1][0] < s[3][0] < s[2][0]


def test_the_word_before_stays_in_its_document(spark):
    """Empty texts between others don't lend a word its neighbour's word: one context each, so nothing is learnt."""
    rows = [(i, "" if i % 2 else ("gronk" if i % 4 == 0 else f"calm{i}")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity._hash_of("gronk") not in set(model.patterns.tolist())


def test_toxicity_columns_and_long_texts(spark):
    docs = spark.createDataFrame([("calm words " * 100_000 + "kill you", "k", 3, 0.5)], "text string, _key string, toxic int, SCORE double")
    model = toxicity.fit(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"))
    r = toxicity.score(docs, model).head()
    assert (r["_key"], r["toxic"], r["predicted"]) == ("k", 3, 1)
