"""Quality classifier: Naive Bayes support vectors over byte n-gram indicators.

Each n-gram (1 to 4 bytes, hashed to 2^18 bins) counts once a document; indicators are scaled by the log of the ratio
of the classes' smoothed document shares, a linear hinge-loss model is fitted on them by dual coordinate descent, and
its margin becomes a probability by a logistic curve fitted on rows that the model did not see.

The fit takes at most about ``PER_CLASS`` labelled ids of each class, in the order of a hash of the id and as far as their
texts fit into ``TRAIN_BYTES`` (documented bounds of what the driver holds; scoring covers all rows).  Nulls score as empty
texts, an empty text has no n-gram and gets the curve's value at its own margin.  Without labels of both classes every score
is the share of label 1 (0.5 without any label).  Repeated rows score alike and are learned from once; of an id with several
texts one is learned from, an id with both labels counts in both classes.  Texts of any length are taken whole.  Other columns
are kept (``keep_good``) or left out (``score``), whatever their names.  An empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import class_shares, fold, pick, place, small_batches, trim

BITS, ORDERS, PER_CLASS, FOLDS = 18, 4, 3000, 5
TRAIN_BYTES = 64 << 20  # of the texts of one fit
KEEP = 0.3


def features(text: str) -> np.ndarray:
    """Sorted distinct bins of a text's n-grams."""
    b = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    parts, gram = [], np.zeros(len(b), np.uint32)
    for n in range(1, ORDERS + 1):
        if len(b) < n:
            break
        gram = (gram[: len(b) - n + 1] << np.uint32(8)) | b[n - 1 :]
        parts.append(((gram ^ np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    found = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    found.sort()
    return found[np.concatenate([[True], found[1:] != found[:-1]])] if parts else found


def margin(found: np.ndarray, weights: np.ndarray, bias: float) -> float:
    return float(weights[found].sum() / np.sqrt(max(1, len(found)))) + bias


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights of the scaled indicators (scaled again, so that they apply to plain indicators) and the bias."""
    w, bias, alpha, rng = np.zeros(len(scale)), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    unit = np.array([1 / np.sqrt(max(1, len(r))) for r in rows])
    norm = np.array([((scale[r] * u) ** 2).sum() + 1.0 for r, u in zip(rows, unit)])
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            values = scale[rows[i]] * unit[i]  # made anew each time: only the bins are held
            gradient = y[i] * (w[rows[i]] @ values + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w * scale, float(bias)


def logistic(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1 given a margin, by Newton steps on smoothed targets."""
    up, down = weight[y > 0].sum(), weight[y <= 0].sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g, h = weight * (p - t), weight * p * (1 - p) + 1e-9
        hess = np.array([[(h * m * m).sum() + 1e-3, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, np.array([(g * m).sum(), g.sum()]))
        a, b = max(a - step[0], 1e-3), b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)


class Model:
    def __init__(self, weights: np.ndarray | None, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def state(self) -> tuple:
        """Plain values: what is broadcast names no class, so that workers need no copy of the package."""
        return self.weights, self.bias, self.slope, self.offset

    def score(self, text: str | None) -> float:
        m = 0.0 if self.weights is None else margin(features(text or ""), self.weights, self.bias)
        return float(1 / (1 + np.exp(-np.clip(self.slope * m + self.offset, -30, 30))))


def fit_rows(texts: list[str], labels: np.ndarray, share: float) -> Model:
    """share: of label 1 among all training rows, of which the sample may hold another share."""
    share = min(max(share, 1e-3), 1 - 1e-3)
    if len(set(labels.tolist())) < 2:
        return Model(None, 0.0, 0.0, float(np.log(share / (1 - share))))
    rows, y = [features(t) for t in texts], np.where(labels > 0, 1.0, -1.0)

    def train(at: np.ndarray) -> tuple[np.ndarray, float]:
        count = {s: np.ones(2**BITS) for s in (1.0, -1.0)}
        for i in at:
            count[y[i]][rows[i]] += 1
        ratio = {s: c / (1 + (y[at] == s).sum()) for s, c in count.items()}
        return dual_descent([rows[i] for i in at], np.log(ratio[1.0] / ratio[-1.0]), y[at])

    part = np.arange(len(rows)) % 4
    held, seen = np.flatnonzero(part == 0), np.flatnonzero(part)
    weight = np.where(y > 0, share / (y > 0).mean(), (1 - share) / (y <= 0).mean())
    w, b = train(seen)
    slope, offset = logistic(np.array([margin(rows[i], w, b) for i in held]), y[held], weight[held])
    return Model(*train(np.arange(len(rows))), slope, offset)


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, folds: int, most_bytes: int = TRAIN_BYTES) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of at most about per_class ids a class whose fold is not 0, with at most most_bytes of text (half for
    each class, and at least one text), and the share of label 1 among the labelled ids."""
    known = pick(labels, **{"doc_id": "long", label: "int"}).where(F.col(label).isin(0, 1) & (fold("doc_id", folds) != 0)).distinct()
    counts = {r[label]: r["count"] for r in known.groupBy(label).count().collect()}
    if not counts:
        return [], np.empty(0), 0.5
    at = place(F.concat(F.lit(label), F.col(label).cast("string"), F.col("doc_id").cast("string")))
    shares = class_shares(known, label, per_class)
    chosen = known.withColumn("_u", at).join(F.broadcast(shares), label).where("_u < _share").select("doc_id", label, "_u")  # at most about 2 x per_class ids
    rows = pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("h", F.xxhash64("text"))
    sized = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", label).agg(F.min(F.struct("h", F.octet_length("text").alias("n"))).alias("t"), F.first("_u").alias("u")).collect()
    taken, used, full = [], dict.fromkeys(counts, 0), set()
    for r in sorted(sized, key=lambda r: (r["u"], r["doc_id"])):
        y = r[label]
        if used[y] and used[y] + r["t"]["n"] > most_bytes / 2:
            full.add(y)
        if y not in full:
            used[y] += r["t"]["n"]
            taken.append((r["doc_id"], y, r["t"]["h"]))
    wanted = docs.sparkSession.createDataFrame(taken, f"doc_id long, {label} int, h long")
    got = rows.join(F.broadcast(wanted), ["doc_id", "h"]).dropDuplicates(["doc_id", label]).select("doc_id", "text", label).collect()
    got.sort(key=lambda r: (r["doc_id"], r[label]))
    return [r["text"] for r in got], np.array([float(r[label]) for r in got]), counts.get(1, 0) / sum(counts.values())


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, folds: int = FOLDS) -> Model:
    texts, y, share = training_sample(docs, labels, label, per_class, folds)
    order = np.random.default_rng(11).permutation(len(texts))
    model = fit_rows([texts[i] for i in order], y[order], share)
    del texts
    trim()
    return model


def score(docs: DataFrame, model: Model, keep: float = KEEP, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.state())  # 2^18 weights, whatever the input
    rows = small_batches(pick(docs, doc_id="long", text="string"))

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            s = pa.array([m.score(t.as_py()) for t in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), s], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= keep).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP, per_class: int = PER_CLASS) -> DataFrame:
    """docs without the rows that score below `keep`; all columns are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class=per_class).state())

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            good = pa.array([m.score(t.as_py()) >= keep for t in batch.column("text")], pa.bool_())
            yield batch.filter(good)

    return small_batches(docs).mapInArrow(run, docs.schema)
