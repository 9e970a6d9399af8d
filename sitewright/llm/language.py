"""Language identification by rank-order profiles.

A profile is a language's 400 most frequent letter n-grams (1 to 3 letters, words framed by blanks) in order.  A
document's own most frequent n-grams are compared to each profile: the out-of-place distance adds, for each n-gram, how
far apart its two ranks are, and the profile's length where the profile lacks it.  The nearest profile wins,
ties go to the language first in alphabet; the score is the gap to the second nearest in parts of that distance.

Profiles are learned from about ``PER_LANGUAGE`` texts of each language, chosen by a hash of id and text (a documented
bound; the counts are made by the executors, so that repeated rows cost time and not memory).  A letter is a character of
Unicode category L.  A null text, or one without a letter, is ``und`` with score 0, as is every text if no language is known.
With one known language that language wins with score 1.  Repeated rows are judged alike, texts of any length are taken
whole, other columns are left out, whatever their names; an empty table gives an empty result.  More than
``common.LABELS`` languages are refused.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import class_shares, fold, pick, place, small_batches

PROFILE, PER_LANGUAGE, FOLDS, HELD = 400, 2000, 4, 2


def letter_runs():
    """Finds the runs of letters (category L) of a text.  Word characters without digits and marks that join are nearly that; only the
    few runs that hold a number sign besides are cut by a class that leaves those out."""
    signs = "".join(c for c in map(chr, range(0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
    near, exact = re.compile(r"[^\W\d_]+").findall, re.compile(rf"[^\W\d_{re.escape(signs)}]+").findall

    def find(text: str) -> list[str]:
        found = near(text)
        return found if all(map(str.isalpha, found)) else [r for f in found for r in ([f] if f.isalpha() else exact(f))]

    return find


def grams(text: str, runs=letter_runs()) -> np.ndarray:
    """Codes of all n-grams: three letters of 21 bits, blank is 32."""
    framed = " ".join(runs(text.lower()))
    if not framed:
        return np.empty(0, np.int64)
    c = np.frombuffer(f" {framed} ".encode("utf-32-le"), "<u4").astype(np.int64)
    one, two, three = c[1:-1], c[:-1] << 21 | c[1:], c[:-2] << 42 | c[1:-1] << 21 | c[2:]
    return np.concatenate([one[one != 32], two, three[c[1:-1] != 32]])


def ranked(text: str, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in descending count, ties by code."""
    code = grams(text)
    code.sort()
    begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, np.int64)
    count = np.diff(np.append(begin, len(code)))
    top = np.argsort(-count, kind="stable")[:most]
    return code[begin][top]


class Profiles:
    def __init__(self, ordered: dict[str, list[int]]):
        self.ordered, self.languages = ordered, sorted(ordered)
        self.sorted, self.rank = [], []
        for lang in self.languages:
            codes = np.array(ordered[lang], np.int64)
            by_code = np.argsort(codes)
            self.sorted.append(codes[by_code])
            self.rank.append(by_code)

    def distances(self, codes: np.ndarray) -> np.ndarray:
        own, out = np.arange(len(codes)), []
        for codes_of, rank in zip(self.sorted, self.rank):
            j = np.minimum(np.searchsorted(codes_of, codes), max(0, len(codes_of) - 1))
            found = codes_of[j] == codes if len(codes_of) else np.zeros(len(codes), bool)
            out.append(np.where(found, np.abs(rank[j] - own), PROFILE).sum() if len(codes_of) else PROFILE * len(codes))
        return np.array(out)

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = ranked(text or "")
        if not len(codes) or not self.languages:
            return "und", 0.0
        d = self.distances(codes)
        best = int(d.argmin())
        if len(d) == 1:
            return self.languages[0], 1.0
        second = np.delete(d, best).min()
        return self.languages[best], float((second - d[best]) / second) if second else 0.0


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, folds: int = FOLDS, held: int = HELD) -> Profiles:
    rows = pick(docs, doc_id="long", text="string", lang="string").where((fold("doc_id", folds) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    key = F.xxhash64("doc_id", "text")
    shares = class_shares(rows.select("lang", key.alias("key")).distinct(), "lang", per_language)
    chosen = rows.join(F.broadcast(shares), "lang").where(place(key) < F.col("_share")).select("lang", "text")

    def count(batches):
        totals: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                code, n = np.unique(grams(text), return_counts=True)
                held_codes = totals.setdefault(lang, [np.empty(0, np.int64), np.empty(0, np.int64)])
                both, place = np.unique(np.concatenate([held_codes[0], code]), return_inverse=True)
                totals[lang] = [both, np.bincount(place, weights=np.concatenate([held_codes[1], n]), minlength=len(both)).astype(np.int64)]
        for lang, (code, n) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n)], names=["lang", "code", "n"])

    counts = chosen.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # the first PROFILE codes of each language, by a bounded aggregate instead of a sort of the whole group
    cut = counts.groupBy("lang", F.pmod("code", F.lit(32)).alias("part")).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "code"))), 1, PROFILE).alias("top"))
    best = cut.groupBy("lang").agg(F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, PROFILE).alias("top"))
    return Profiles({r["lang"]: [x["code"] for x in r["top"]] for r in best.collect()})


def identify(docs: DataFrame, profiles: Profiles, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles.ordered)  # PROFILE codes a language, plain values
    rows = small_batches(pick(docs, doc_id="long", text="string"))

    def run(batches):
        p = Profiles(shared.value)
        for batch in batches:
            found = [p.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    told = rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return told.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "lang_pred", "score")
