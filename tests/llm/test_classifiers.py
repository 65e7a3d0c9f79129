import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from aisleworks.llm.language_id import ORDER, identify, kneser_ney, log_probabilities, predicted_symbols
from aisleworks.llm.quality import quality
from aisleworks.llm.toxicity import toxicity
from aisleworks.llm.weak_labels import label_posteriors, learning_rows

ENGLISH = "the of and to in that with which there their would from have this should thing".split()
GERMAN = "der die und das nicht mit auch eine werden über schön straße zwischen haben".split()


def sentences(words, count, seed, length=30):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(words) for _ in range(length)) for _ in range(count)]


def plain_kneser_ney(words):
    """Interpolated probabilities straight from the definition, over dictionaries."""
    top = Counter()
    for word in words:
        padded = [1] * (ORDER - 1) + [ord(c) for c in word] + [2]
        for i in range(ORDER - 1, len(padded)):
            top[tuple(padded[i - ORDER + 1 : i + 1])] += 1
    levels = {ORDER: dict(top)}
    for order in range(ORDER - 1, 0, -1):
        levels[order] = dict(Counter(g[1:] for g in levels[order + 1]))
    size = len(levels[1]) + 1

    def p(gram):
        order = len(gram)
        if order == 0:
            return 1 / size
        table = levels[order]
        once, twice = sum(v == 1 for v in table.values()), sum(v == 2 for v in table.values())
        d = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
        after = {g: v for g, v in table.items() if g[:-1] == gram[:-1]}
        if not after:
            return p(gram[1:])
        total = sum(after.values())
        return max(after.get(gram, 0) - d, 0) / total + d * len(after) / total * p(gram[1:])

    return p


def test_models_follow_the_definition():
    words = ["haus", "haut", "maus", "mal", "haus", "am", "a"]
    symbols, _ = predicted_symbols(words)
    grams, counts = np.unique(symbols, axis=0, return_counts=True)
    model = kneser_ney(grams, counts)
    p = plain_kneser_ney(words)
    asked, _ = predicted_symbols(["haus", "laus", "xyz", "ma", "u"])
    got = log_probabilities(asked, model)
    assert np.allclose(got, [math.log(p(tuple(int(x) for x in row))) for row in asked])


def test_languages_and_rejection(spark, docs, awkward):
    rows = [(n, t, "en") for n, t in enumerate(sentences(ENGLISH, 60, 1))]
    rows += [(100 + n, t, "de") for n, t in enumerate(sentences(GERMAN, 60, 2))]
    rows += [(200, "the which their", None), (201, "über zwischen", None), (202, "qxzv kwqp zzxq vvkj wqxz", None), (203, "the of", None)]
    rows += [(1000 + n, t, "en") for n, t in [(1, None), (2, ""), (3, " "), (4, "123 !?")]]
    found = identify(docs(rows), F.col("doc_id") < 200).collect()
    got = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows)
    assert all(got[i]["lang_pred"] == lang and not got[i]["rejected"] for i, _, lang in rows if i < 200)
    assert [got[i]["lang_pred"] for i in (200, 201, 203)] == ["en", "de", "en"] and not got[203]["rejected"]
    assert got[202]["rejected"]
    for i in (1001, 1002, 1003, 1004):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in found)


def test_models_beyond_the_broadcast_bound_keep_every_gram(spark, docs, awkward, monkeypatch):
    rows = [(n, t, "en") for n, t in enumerate(sentences(ENGLISH, 30, 1, 8))] + [(n, t, "en") for n, t in awkward]
    rows += [(100 + n, t, "de") for n, t in enumerate(sentences(GERMAN, 30, 2, 8))] + [(200, "zur qxzv the", None)]
    once = [(300 + n, f"{a}{b}x", "fr") for n, (a, b) in enumerate(["kü", "mo", "la"])]  # all of its grams tie at any cut
    small = sorted(map(tuple, identify(docs(rows + once), F.coalesce(F.col("doc_id") != 3, F.lit(True))).collect()), key=str)
    monkeypatch.setattr("aisleworks.llm.language_id.MOST_GRAMS", 10)
    large = sorted(map(tuple, identify(docs(rows + once), F.coalesce(F.col("doc_id") != 3, F.lit(True))).collect()), key=str)
    assert len(large) == len(rows + once)
    for mine, other in zip(large, small, strict=True):
        assert mine[:3] == other[:3] and mine[5] == other[5]
        assert np.allclose([x or 0.0 for x in mine[3:5]], [x or 0.0 for x in other[3:5]], rtol=1e-9)
    assert {r[2] for r in large} == {"de", "en", "fr", "und"}


def test_language_of_awkward_rows_and_of_nothing(spark, docs, awkward):
    got = identify(docs([(i, t, "en") for i, t in awkward]), F.lit(True)).collect()
    assert len(got) == len(awkward) and {r["lang_pred"] for r in got} == {"en", "und"}
    untaught = identify(docs(awkward), F.lit(True)).collect()
    assert {(r["lang_pred"], r["rejected"]) for r in untaught} == {("und", True)}
    assert identify(docs([]), F.lit(True)).count() == 0


def labelled(docs, spark, toxic_words):
    rnd = random.Random(4)
    rows, labels = [], []
    for n, text in enumerate(sentences(ENGLISH, 400, 3, 40)):
        toxic = n % 5 == 0
        words = text.split()
        for _ in range(3 * toxic):
            words[rnd.randrange(len(words))] = rnd.choice(toxic_words)
        rows.append((n, " ".join(words)))
        labels.append((n, int(n % 7 != 0), int(toxic)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_toxicity_on_held_out_rows(spark, docs, awkward):
    rows, labels = labelled(docs, spark, ["idiot", "moron", "trash", "scumbag"])
    extra = [(1000 + (i or 0), t) for i, t in awkward]
    table = spark.createDataFrame(labels + [(1, None, None), (None, 1, 1), (3, 7, 7), (4, 1, 0)], LABELS)
    found = toxicity(docs(rows + extra), table, F.col("doc_id") % 3 != 1).collect()
    got = {r["doc_id"]: r["predicted"] for r in found}
    assert len(found) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 for r in found)
    held = [(got[n], toxic) for n, _, toxic in labels if n % 3 == 1]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    assert all(got[1000 + (i or 0)] == 0 for i, _ in awkward)


def test_toxicity_without_anything_to_learn(spark, docs, awkward):
    nothing = spark.createDataFrame([], LABELS)
    assert {r["predicted"] for r in toxicity(docs(awkward), nothing).collect()} == {0}
    assert toxicity(docs([]), nothing).count() == 0


def test_quality_on_held_out_rows(spark, docs, awkward):
    rnd = random.Random(6)
    rows, labels = [], []
    for n, text in enumerate(sentences(ENGLISH, 400, 5, 40)):
        bad = n % 4 == 0
        if bad:
            text = [text.upper() + "!!", text.replace(" ", " | "), " ".join([text.split()[0]] * 40)][rnd.randrange(3)]
        rows.append((n, text))
        labels.append((n, int(not bad), 0))
    found = quality(docs(rows + [(1000 + (i or 0), t) for i, t in awkward]), spark.createDataFrame(labels, LABELS), F.col("doc_id") % 3 != 1)
    got = {r["doc_id"]: r for r in found.collect()}
    held = [(got[n]["predicted"], good) for n, good, _ in labels if n % 3 == 1]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert quality(docs([]), spark.createDataFrame([], LABELS)).count() == 0


def test_label_model_outvotes_wrong_labels_and_shares_weight():
    rng = np.random.default_rng(1)
    truth = rng.random(3000) < 0.3
    good = np.where(rng.random((3000, 6)) < 0.9, truth[:, None], ~truth[:, None]) * 2 - 1
    votes = np.concatenate([good, good[:, :1], good[:, :1]], axis=1).astype(np.int8)
    given = np.where(rng.random(3000) < 0.005, ~truth, truth).astype(float)
    posterior, accuracy, weight = label_posteriors(votes, given)
    assert ((posterior > 0.5) == truth).mean() > 0.99
    assert np.all(np.abs(accuracy[:-1] - 0.9) < 0.03) and accuracy[-1] > 0.98 and weight[0] < 0.5 < weight[3]


def test_wrong_labels_are_mostly_outvoted_and_their_accuracy_is_estimated():
    rng = np.random.default_rng(3)
    truth = rng.random(3000) < 0.2
    votes = np.stack([np.where(rng.random(3000) < 0.4, np.where(rng.random(3000) < 0.85, truth, ~truth) * 2 - 1, 0) for _ in range(14)], axis=1)
    flipped = rng.random(3000) < 0.1
    posterior, accuracy, _ = label_posteriors(votes.astype(np.int8), np.where(flipped, ~truth, truth).astype(float))
    right = (posterior > 0.5) == truth
    assert right[flipped].mean() > 0.8 and right.mean() > 0.97
    assert abs(accuracy[-1] - 0.9) < 0.02 and np.abs(accuracy[:-1] - 0.85).max() < 0.06


def test_learning_rows_are_bounded_however_often_an_id_is_repeated(spark, docs):
    rows = [(1, f"text {n}") for n in range(300)] + [(2, "two"), (3, None)]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (9, 1, 1)], LABELS)
    taught = learning_rows(docs(rows).select("doc_id", "text"), labels, F.col("toxic"), F.lit(True)).collect()
    assert len(taught) == 3 and sorted(r["y"] for r in taught) == [0, 0, 1]
    assert taught == learning_rows(docs(rows).select("doc_id", "text"), labels, F.col("toxic"), F.lit(True)).collect()


def test_very_long_texts_are_scored_whole(spark, docs):
    rows, labels = labelled(docs, spark, ["idiot", "moron", "trash", "scumbag"])
    long = [(5000, "x" * 5_000_000), (5001, " " * 3_000_000), (5002, "the of and " * 200_000 + "idiot moron trash scumbag")]
    table = spark.createDataFrame(labels, LABELS)
    got = {r["doc_id"]: r["predicted"] for r in toxicity(docs(rows + long), table, F.lit(True)).collect()}
    assert (got[5000], got[5001], got[5002]) == (0, 0, 1)
    assert quality(docs(rows + long), table, F.lit(True)).count() == len(rows) + 3
    named = identify(docs([(n, t, "en") for n, t in rows] + [(n, t, None) for n, t in long]), F.lit(True)).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in named if r["doc_id"] >= 5000} == {5000: "en", 5001: "und", 5002: "en"}
