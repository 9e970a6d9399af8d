"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is logistic in the counts of its telling words, a
document's is the noisy-or of its sentences and of a small leak; the weights are trained from document labels alone,
and the sentences with a probability of a half or more are the located ones.

Telling words are all whose document share differs between the labels by ``MIN_Z`` standard errors and that ``MIN_DOCS``
documents hold: with thousands of words to choose from, weaker ones are chance.  A sentence without any has probability 0.
The fit takes at most about ``PER_CLASS`` labelled ids of each class within the bytes that ``quality.training_sample`` allows
(documented bounds of what the driver holds).  Nulls score as empty texts, which get the leak alone; without labels of both
classes every score is the share of label 1 (0.5 without any).  Texts of any length are taken whole, repeated rows score alike
and are learned from once, other columns are left out, whatever their names; an empty table gives an empty result.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, pick, small_batches, trim
from .quality import FOLDS, training_sample
from .units import slices

PER_CLASS, MIN_Z, MIN_DOCS = 4000, 4.0, 5
CHUNK = 1 << 20  # letters of training texts that the driver cuts into words at a time
SENTENCE_END = r"[.!?]+(?:\s+|$)|\n+"
_EDGE = re.compile(r"^\W+|\W+$")


def bags(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct normalised words, the word at each place, where sentences begin in places, where texts begin in sentences."""
    texts = pc.fill_null(texts, "")
    sentences = pc.split_pattern_regex(texts, SENTENCE_END)
    words = pc.utf8_split_whitespace(sentences.flatten())
    coded = words.flatten().dictionary_encode()
    plain = [_EDGE.sub("", w).lower() for w in coded.dictionary.to_pylist()]
    number: dict[str, int] = {}
    merge = np.array([number.setdefault(w, len(number)) for w in plain], np.int32)
    index = merge[coded.indices.to_numpy(zero_copy_only=False)] if len(merge) else np.empty(0, np.int32)
    offsets = [x.offsets.to_numpy().astype(np.int64) for x in (words, sentences)]
    return list(number), index, offsets[0] - offsets[0][0], offsets[1] - offsets[1][0]


class Model:
    def __init__(self, weight: dict[str, float], bias: float, leak: float):
        self.weight, self.bias, self.leak = weight, bias, leak

    def state(self) -> tuple:
        """Plain values, to be broadcast."""
        return self.weight, self.bias, self.leak

    def sentences(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sentences with a telling word: number, probability, and the text they belong to."""
        words, index, word_at, sentence_at = bags(texts)
        get = self.weight.get
        value = np.fromiter((get(w, np.nan) for w in words), float, len(words))[index] if len(words) else np.empty(0)
        telling = np.flatnonzero(~np.isnan(value))
        sentence, place = np.unique(np.searchsorted(word_at, telling, side="right") - 1, return_inverse=True)
        z = self.bias + np.bincount(place, weights=value[telling], minlength=len(sentence))
        return sentence, 1 / (1 + np.exp(-np.clip(z, -30, 30))), np.searchsorted(sentence_at, sentence, side="right") - 1

    def scores(self, texts: pa.Array) -> np.ndarray:
        _, p, text = self.sentences(texts)
        return self.combined(p, text, len(texts))

    def combined(self, p: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """The noisy-or of each text's sentences and the leak."""
        none = np.bincount(text, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n) if len(p) else np.zeros(n)
        return 1 - (1 - self.leak) * np.exp(none)


def likelihood(theta: np.ndarray, sentence: np.ndarray, word: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean weighted log likelihood of bag labels under the noisy-or, and its gradient; theta ends with the bias."""
    z = theta[-1] + np.bincount(sentence, weights=theta[word], minlength=len(bag))
    p = np.minimum(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 - 1e-9)
    log_none = np.bincount(bag, weights=np.log1p(-p), minlength=len(y))
    none, total = np.exp(log_none), weight.sum()
    value = np.where(y > 0, np.log(np.maximum(1 - none, 1e-12)), log_none)
    pull = np.where(y > 0, none / np.maximum(1 - none, 1e-6), -1.0) * weight
    dz = pull[bag] * p / total
    return float((weight * value).sum() / total), np.append(np.bincount(word, weights=dz[sentence], minlength=len(theta) - 1), dz.sum())


def noisy_or(sentence: np.ndarray, word: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray, n_words: int, rounds: int = 400, penalty: float = 2e-5) -> tuple[np.ndarray, float]:
    """Maximises the weighted likelihood of bag labels; (sentence, word) are the telling words, bag of each sentence."""
    theta = np.append(np.full(n_words, 0.1), -2.0)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        gradient = likelihood(theta, sentence, word, bag, y, weight)[1]
        gradient[:-1] -= penalty * theta[:-1]
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return theta[:-1], float(theta[-1])


def runs(texts: list[str]):
    """The texts in runs of about CHUNK letters, a longer text by itself: the number of the first, and the run."""
    group = np.cumsum([len(t or "") for t in texts]) // CHUNK
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:]):
        yield a, pa.array(texts[a:b], pa.string())


def telling_words(texts: list[str], up: np.ndarray) -> list[str]:
    """Words whose document share differs between the labels, the most telling first."""
    number: dict[str, int] = {}
    hits = np.zeros((2, 1), np.int64)  # documents with label 0 and 1 that hold a word
    for first, run in runs(texts):
        words, index, word_at, sentence_at = bags(run)
        text = np.repeat(np.arange(len(run)), np.diff(word_at[sentence_at]))
        seen = np.unique(text * len(words) + index)  # a word counts once a document
        if not len(seen):
            continue
        place = np.array([number.setdefault(w, len(number)) for w in words])[seen % len(words)]
        label = up[first + seen // len(words)].astype(int)
        if len(number) > hits.shape[1]:
            hits = np.pad(hits, ((0, 0), (0, len(number) - hits.shape[1])))
        for k in (0, 1):
            hits[k] += np.bincount(place[label == k], minlength=hits.shape[1])
    if not number:
        return []
    n1, n0 = up.sum(), (~up).sum()
    pooled = hits.sum(0) / len(texts)
    z = np.abs((hits[1] / n1 - hits[0] / n0) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / n1 + 1 / n0)))
    names = list(number)
    able = (hits.sum(0) >= MIN_DOCS) & (z >= MIN_Z) & (np.array([len(w) for w in names]) > 0)
    return [names[i] for i in np.flatnonzero(able)[np.argsort(-z[able], kind="stable")]]


def fit_rows(texts: list[str], labels: np.ndarray, share: float) -> Model:
    """The texts are cut into words run by run, twice: what is held of all at once is the telling words' places."""
    if len(set(labels.tolist())) < 2:
        return Model({}, 0.0, share)
    up = labels > 0
    telling = telling_words(texts, up)
    if not telling:
        return Model({}, 0.0, share)
    number = {w: i for i, w in enumerate(telling)}
    places, found, bag_of, n_sentences = [], [], [], 0
    for first, run in runs(texts):
        words, index, word_at, sentence_at = bags(run)
        which = np.array([number.get(w, -1) for w in words], np.int32)[index] if words else np.empty(0, np.int32)
        at = np.flatnonzero(which >= 0)
        sentence, place = np.unique(np.searchsorted(word_at, at, side="right") - 1, return_inverse=True)
        places.append((place + n_sentences).astype(np.int32))
        found.append(which[at])
        bag_of.append((first + np.searchsorted(sentence_at, sentence, side="right") - 1).astype(np.int32))
        n_sentences += len(sentence)
    weight = np.where(up, share / up.mean(), (1 - share) / (~up).mean())
    theta, bias = noisy_or(*map(np.concatenate, (places, found, bag_of)), labels, weight, len(telling))
    model = Model({t: float(v) for t, v in zip(telling, theta)}, bias, 0.0)
    bare = np.concatenate([model.scores(run) for _, run in runs(texts)]) < 0.5
    leak = (weight * up)[bare].sum() / max(weight[bare].sum(), 1e-9)
    return Model(model.weight, bias, float(min(leak, 0.45)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, folds: int = FOLDS) -> Model:
    model = fit_rows(*training_sample(docs, labels, "toxic", per_class, folds))
    trim()
    return model


def score(docs: DataFrame, model: Model, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences (those located) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.state())  # the telling words of a bounded sample
    rows = small_batches(pick(docs, doc_id="long", text="string"))

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                _, p, text = m.sentences(part.column("text"))
                n = np.bincount(text[p >= 0.5], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(m.combined(p, text, part.num_rows)), pa.array(n)], names=["doc_id", "score", "n_sentences"])

    scored = rows.mapInArrow(run, "doc_id long, score double, n_sentences long")
    return scored.select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences")


def locate(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, sentence (its text), probability of each offending sentence."""
    shared = docs.sparkSession.sparkContext.broadcast(model.state())
    rows = small_batches(pick(docs, doc_id="long", text="string"))

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                number, p, text = m.sentences(part.column("text"))
                hit = p >= threshold
                spoken = pc.split_pattern_regex(pc.fill_null(part.column("text"), ""), SENTENCE_END).flatten()
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(text[hit])), spoken.take(pa.array(number[hit])), pa.array(p[hit])], names=["doc_id", "sentence", "probability"])

    return rows.mapInArrow(run, "doc_id long, sentence string, probability double")
