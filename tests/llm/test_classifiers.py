"""Held-out results and edge cases of the three classifiers."""
import collections
import os
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitewright.llm import language, quality, toxicity
from tests.llm.conftest import frame, prose


def folds(n, parts):
    return [zlib.crc32(str(i).encode()) % parts for i in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    texts, good, toxic = [], [], []
    for i in range(500):
        t = prose(rng, rng.randint(20, 90))
        bad, rude = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            t = " ".join(w + rng.choice(["***", "$$$"]) for w in t.split())
        if rude:
            words = t.split(" ")
            words.insert(rng.randrange(len(words)), rng.choice(["scoundrel", "nitwit,", "Blockhead"]))
            t = " ".join(words)
        texts.append(t)
        good.append(int(not bad))
        toxic.append(int(rude))
    labels = spark.createDataFrame([(i, g, x) for i, (g, x) in enumerate(zip(good, toxic))], "doc_id long, quality int, toxic int")
    return frame(spark, [*texts, "", None]), labels, good, toxic


def test_quality(corpus):
    docs, labels, good, _ = corpus
    got = {r["doc_id"]: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    held = [i for i, f in enumerate(folds(500, 5)) if f == 0]
    assert all(got[i]["held_out"] == (f == 0) for i, f in enumerate(folds(502, 5)))
    assert sum(got[i]["predicted"] == good[i] for i in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert got[500]["score"] == got[501]["score"]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}


def test_held_out_labels_are_not_used(corpus):
    docs, labels, _, _ = corpus
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, x)).collect()} for x in (labels, flipped))
    assert a == b


def test_toxicity(corpus):
    docs, labels, _, toxic = corpus
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i, f in enumerate(folds(500, 5)) if f == 0]
    assert sum(got[i]["predicted"] == toxic[i] for i in held) / len(held) > 0.95
    assert got[500]["score"] == got[501]["score"] <= 0.5
    places = toxicity.locate(docs, model).collect()
    assert places and all(any(w in r["sentence"].lower() for w in ("scoundrel", "nitwit", "blockhead")) for r in places)


@pytest.mark.parametrize("fit,score,column", [(quality.fit, quality.score, "quality"), (toxicity.fit, toxicity.score, "toxic")])
def test_without_labels(corpus, fit, score, column):
    docs, labels, _, _ = corpus
    assert {r["score"] for r in score(docs, fit(docs, labels.limit(0))).collect()} == {0.5}
    one = labels.withColumn(column, F.lit(1))
    assert all(r["score"] > 0.9 for r in score(docs, fit(docs, one)).collect())
    assert score(docs.limit(0), fit(docs, labels.limit(0))).count() == 0


LANGUAGES = {"en": "the quick thing and that which when with there".split(), "de": "der schnelle und nicht über wenn auch zwischen größe".split(), "fr": "le rapide et nous avons été où français chose".split()}


def test_language(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        lang = rng.choice(list(LANGUAGES))
        rows.append((i, " ".join(rng.choice(LANGUAGES[lang]) for _ in range(rng.randint(3, 40))), lang if i % 10 else None, lang))
    docs = spark.createDataFrame([*rows, (400, None, "en", "und"), (401, "123 !!", "en", "und"), (402, "", None, "und")], "doc_id long, text string, lang string, truth string")
    got = {r["doc_id"]: r for r in language.identify(docs, language.learn(docs)).collect()}
    assert all(got[i]["held_out"] == (f == 2) for i, f in enumerate(folds(403, 4)))
    truth = {r["doc_id"]: r["truth"] for r in docs.collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) / len(held) > 0.97
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (400, 401, 402))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = language.learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}


def test_noisy_or_gradient_is_the_numeric_one():
    rng = np.random.default_rng(4)
    n_words, n_sentences, n_bags = 6, 40, 15
    bag = np.sort(rng.integers(0, n_bags, n_sentences))
    sentence, word = rng.integers(0, n_sentences, 90), rng.integers(0, n_words, 90)
    y, weight = rng.integers(0, 2, n_bags).astype(float), rng.random(n_bags) + 0.5
    theta = rng.normal(size=n_words + 1)
    value = lambda t: toxicity.likelihood(t, sentence, word, bag, y, weight)[0]
    step = 1e-6 * np.eye(n_words + 1)
    numeric = [(value(theta + e) - value(theta - e)) / 2e-6 for e in step]
    assert np.allclose(toxicity.likelihood(theta, sentence, word, bag, y, weight)[1], numeric, atol=1e-6)


def test_noisy_or_of_sentences():
    model = toxicity.Model({"bad": 1.5, "worse": 3.0}, -1.0, 0.1)
    p = lambda z: 1 / (1 + np.exp(-z))
    texts = ["It is bad. All fine. Worse, bad bad!\nbad", "", None, "nothing here"]
    want = [1 - 0.9 * (1 - p(0.5)) * (1 - p(5.0)) * (1 - p(0.5)), 0.1, 0.1, 0.1]
    assert np.allclose(model.scores(pa.array(texts)), want)


def test_dual_descent_reaches_the_hinge_optimum():
    """The primal loss at its weights is that of a plain subgradient solver on the same scaled features, or lower."""
    rng = np.random.default_rng(5)
    rows = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(80)]
    scale, y = rng.normal(size=30), np.where(rng.random(80) < 0.5, 1.0, -1.0)
    x = np.zeros((80, 31))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.sqrt(6)
    x[:, 30] = 1.0  # the bias is a weight like others
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    w, bias = quality.dual_descent(rows, scale, y, rounds=500)
    ours = np.append(np.where(scale != 0, w / scale, 0), bias)
    plain, best = np.zeros(31), np.inf
    for t in range(1, 20_001):
        plain = plain - (plain - (y * (y * (x @ plain) < 1)) @ x) / (t + 10)
        best = min(best, loss(plain))
    assert loss(ours) <= best * 1.002


def test_features_are_the_ngrams_of_the_bytes():
    text = "añb añb"
    b = text.encode()
    grams = {b[i : i + n] for n in range(1, quality.ORDERS + 1) for i in range(len(b) - n + 1)}
    found = quality.features(text)
    assert len(found) == len(set(found.tolist())) == len(grams)  # no two of these meet in a bin
    assert len(quality.features("")) == 0


def test_out_of_place_distance_is_the_dictionary_one():
    rng = random.Random(3)
    words = [w for ws in LANGUAGES.values() for w in ws]
    order = {lang: language.ranked(" ".join(rng.choice(ws) for _ in range(300))).tolist() for lang, ws in LANGUAGES.items()}
    profiles = language.Profiles(order)
    for _ in range(50):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))
        own = language.ranked(text).tolist()
        want = {}
        for lang, codes in order.items():
            rank = {c: i for i, c in enumerate(codes)}
            want[lang] = sum(abs(rank[c] - i) if c in rank else language.PROFILE for i, c in enumerate(own))
        assert dict(zip(profiles.languages, profiles.distances(np.array(own)).tolist())) == want
        assert profiles.predict(text)[0] == min(sorted(want), key=want.get)


def test_profile_is_the_most_frequent_ngrams(spark):
    texts = {"en": "that thing then", "fr": "où est-il"}
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts.items())], "doc_id long, text string, lang string")
    got = language.learn(docs, folds=10**6, held=-1).ordered
    for lang, t in texts.items():
        framed = " " + " ".join(re.findall(r"[^\W\d_]+", t)) + " "
        seen = collections.Counter(framed[i : i + n] for n in (1, 2, 3) for i in range(len(framed) - n + 1))
        code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
        want = sorted(((-n, code(g)) for g, n in seen.items() if g != " " and not (len(g) == 3 and g[1] == " ")))
        assert got[lang] == [c for _, c in want]


def test_number_signs_are_no_letters(spark):
    docs = spark.createDataFrame([(0, "½ ²", "de"), (1, "der und", "de"), (2, "Ⅷ ①", None), (3, "漢字", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, language.Profiles({"de": [100]})).collect()}
    assert got == {0: "und", 1: "de", 2: "und", 3: "de"}


def test_repeated_rows_and_shared_ids(corpus):
    """Repeats are learned from once, and a label table or language column with one id for all rows is not lost whole."""
    docs, labels, _, _ = corpus
    once = quality.training_sample(docs, labels, "quality", 3000, 5)
    thrice = quality.training_sample(docs.unionByName(docs).unionByName(docs), labels.unionByName(labels), "quality", 3000, 5)
    assert once[0] == thrice[0] and once[1].tolist() == thrice[1].tolist() and once[2] == thrice[2]
    same = docs.withColumn("doc_id", F.lit(3).cast("long"))
    assert len(quality.training_sample(same, labels.withColumn("doc_id", F.lit(3).cast("long")), "quality", 3000, 5)[0]) in (1, 2)
    assert language.learn(same.unionByName(same), per_language=50).ordered["en"]


def test_training_texts_fit_into_their_bytes(corpus):
    docs, labels, _, _ = corpus
    texts, y, _ = quality.training_sample(docs, labels, "quality", 3000, 5, most_bytes=20_000)
    assert 10 < len(texts) and sum(len(t.encode()) for t in texts) <= 20_000 and set(y.tolist()) == {0.0, 1.0}
    assert len(quality.training_sample(docs, labels, "quality", 3000, 5, most_bytes=2)[0]) == 2  # one text of each class at least
    assert len(quality.training_sample(docs, labels, "quality", 20, 5)[0]) < 90


@pytest.mark.parametrize("score,fit", [(quality.score, quality.fit), (toxicity.score, toxicity.fit)])
def test_very_long_and_empty_texts(spark, corpus, score, fit):
    docs, labels, _, _ = corpus
    model = fit(docs, labels)
    odd = frame(spark, ["", None, "the of and " * 100_000, "x" * 300_000, "\n\n..", "scoundrel " * 3])
    rows = {r["doc_id"]: r for r in score(odd, model).collect()}
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows.values()) and rows[0]["score"] == rows[1]["score"]
    assert len(score(odd.unionByName(odd), model).collect()) == 12


ELSEWHERE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
from sitewright.llm import bpe, language, neardup, quality, registry, toxicity
docs = spark.createDataFrame([(i, "the quiet harbor and " + "good bad "[i % 2 * 5 :] * 5, "en") for i in range(60)], "doc_id long, text string, lang string")
labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
assert quality.score(docs, quality.fit(docs, labels)).count() == 60
assert quality.keep_good(docs, labels).count() > 0
model = toxicity.fit(docs, labels)
assert toxicity.score(docs, model).count() == 60 and toxicity.locate(docs, model).count() >= 0
assert language.identify(docs, language.learn(docs)).count() == 60
assert neardup.classes(docs).count() == 60
assert bpe.round_trip(docs, registry.tokenizer_path()).count() == 60
print("all ran")
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """The driver alone finds the package; it runs in a folder that does not hold it."""
    repo = str(Path(__file__).resolve().parents[2])
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", ELSEWHERE.format(repo=repo, shared=f"file://{tmp_path}")], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]


def test_toxicity_fit_does_not_depend_on_runs(monkeypatch):
    rng = np.random.default_rng(3)
    labels = np.arange(120) % 3 == 0
    say = lambda bad: " ".join(rng.choice(["a", "b", "c", "d"], 6)) + (". You vile fool! " if bad else ". Fine day.\n") + "end"
    texts = [say(bad) for bad in labels] + ["", "w " * 500]
    labels = np.append(labels, [False, False]).astype(int)
    whole = toxicity.fit_rows(texts, labels, 0.3)
    monkeypatch.setattr(toxicity, "CHUNK", 50)
    assert toxicity.fit_rows(texts, labels, 0.3).state() == whole.state() and "vile" in whole.weight


def test_letter_runs_on_every_code_point():
    from itertools import groupby

    from sitewright.llm import language

    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for text in ("".join(every), "a" + "a".join(every)):
        assert language.letter_runs()(text) == ["".join(g) for letter, g in groupby(text, str.isalpha) if letter]
