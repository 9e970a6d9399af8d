"""Near-duplicates and decontamination against brute force over all pairs."""
import collections
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sitewright.llm import decontamination, neardup
from tests.llm.conftest import frame, prose


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = "changed" + str(rng.randint(0, 99))
    return " ".join(words)


def corpus():
    rng = random.Random(3)
    base = [prose(rng, 120) for _ in range(12)]
    rows = list(base)
    for b in base[:6]:
        rows += [edited(rng, b, k) for k in (1, 2, 3, 5, 8)]
    return rows + [base[0].upper(), base[1], base[1], "", None, "   ", "***", "one", "One.", "two words", None]


def multiset(text):
    words = [w for w in (re.sub(r"^\W+|\W+$", "", x).lower() for x in (text or "").split()) if w]
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def plain_classes(rows):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [multiset(t) for t in rows]
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a is None or b is None:
                same = a is b and (rows[i] or "") == (rows[j] or "")
            else:
                common = sum((a & b).values())
                same = common / (sum(a.values()) + sum(b.values()) - common) >= 0.8
            if same:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in range(len(rows))}


def test_classes(spark):
    rows = corpus()
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(frame(spark, rows)).collect()}
    assert got == plain_classes(rows)


def test_large_group(spark):
    """A group beyond the size at which a bucket is compared whole."""
    rng = random.Random(8)
    base = prose(rng, 150)
    rows = [base] + [edited(rng, base, rng.randint(1, 3)) for _ in range(120)] + [prose(rng, 150) for _ in range(20)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(frame(spark, rows)).collect()}
    assert got == plain_classes(rows)


def crowded(rng, n_pairs, base_words=100):
    """A text, and pairs of near-duplicates that are each below 0.8 to it and to all other pairs; large buckets, small classes."""
    base = prose(rng, base_words).split(" ")
    rows = [" ".join(base)]
    for p in range(n_pairs):
        words = list(base)
        for at in rng.sample(range(0, base_words, 5), 6):
            words[at] = f"pair{p}at{at}"
        rows += [" ".join(words), " ".join(words[:-1] + [f"end{p}"])]
    return rows


def test_pairs_inside_large_buckets(spark):
    """Classes are pairs far from the centre."""
    rows = crowded(random.Random(12), 300)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(frame(spark, rows)).collect()}
    want = {0: 0} | {i: i - (i + 1) % 2 for i in range(1, len(rows))}
    assert got == want


def test_pieces_that_all_meet(spark, monkeypatch):
    """A group of many pieces, by count and by characters, with a main component and classes outside it."""
    rng = random.Random(13)
    base = prose(rng, 150)
    rows = [base] + [edited(rng, base, rng.randint(1, 12)) for _ in range(150)]
    for piece, chars in ((7, 10**9), (10**6, 9000)):
        monkeypatch.setattr(neardup, "PIECE", piece)
        monkeypatch.setattr(neardup, "PIECE_CHARS", chars)
        got = {r["doc_id"]: r["class_id"] for r in neardup.classes(frame(spark, rows)).collect()}
        assert got == plain_classes(rows)


def test_common_is_the_multiset_intersection():
    rng = random.Random(14)
    base = prose(rng, 60)
    rows = [edited(rng, base, k % 9) for k in range(40)] + ["a b c d e f a b c d e", "a b c d e f a b c d e f a b c d e", "x"] * 3
    got = neardup.common(*neardup.shingles(*neardup.word_hashes(pa.array(rows))))
    sets = [multiset(t) for t in rows]
    assert all(got[i, j] == sum((sets[i] & sets[j]).values()) for j in range(len(rows)) for i in range(j))


def test_keep_one(spark):
    rows = corpus()
    docs = frame(spark, rows)
    twice = docs.unionByName(docs).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    kept = neardup.keep_one(twice)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(plain_classes(rows).values())) and ids.count(None) == 1
    assert neardup.classes(docs.limit(0)).count() == 0


def test_signatures_are_unbiased():
    """Agreement of signatures is the weighted Jaccard similarity, also for weights above 1."""
    rng = np.random.default_rng(2)
    errors = []
    for weight in (1, 2, 5, 11):
        for shared in (20, 60, 90):
            s = rng.integers(0, 2**63, 100 + 100 - shared).astype(np.uint64)
            a, b = np.sort(s[:100]), np.sort(s[100 - shared :])
            count = np.full(100, weight)
            sig = neardup.signatures(np.concatenate([a, b]), np.concatenate([count, count]), np.repeat([0, 1], 100), 2, m=1000)
            errors.append((sig[0] == sig[1]).mean() - shared / (200 - shared))
    s = np.arange(1, 51).astype(np.uint64)
    sig = neardup.signatures(np.concatenate([s, s]), np.concatenate([np.full(50, 6), np.full(50, 3)]), np.repeat([0, 1], 50), 2, m=1000)
    errors.append((sig[0] == sig[1]).mean() - 0.5)  # 3 of 6 everywhere
    assert max(map(abs, errors)) < 0.06 and abs(np.mean(errors)) < 0.02


def test_overlap():
    a = ["a b c d e f a b c d e", "x", "", "p q r s t u"]
    b = ["a b c d e f g h i j k", "x", "", "v w x y z a"]
    want = []
    for x, y in zip(a, b):
        m, n = multiset(x) or collections.Counter(), multiset(y) or collections.Counter()
        common = sum((m & n).values())
        want.append(common / max(1, sum(m.values()) + sum(n.values()) - common))
    assert neardup.overlap(pa.array(a), pa.array(b)).tolist() == want


def plain_leaks(rows, items):
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    out = {}
    for i, t in enumerate(rows):
        words = cut(t)
        for k, item in enumerate(items):
            want, n = grams(cut(item)), len(cut(item))
            m = min(n, len(words))
            for s in range(len(words) - m + 1) if n >= 5 and m >= 5 else ():
                common = sum((grams(words[s : s + m]) & want).values())
                out[i, k] = max(out.get((i, k), 0), common / (n - 4 + m - 4 - common))
    return {p for p, v in out.items() if v >= 0.8}


def test_leaks(spark, texts):
    rng = random.Random(4)
    items = [prose(rng, n) for n in (8, 20, 45, 59, 3)] + [None, ""]
    rows = [*texts[:10], texts[0] + " " + items[1] + " " + texts[1], items[2], items[2].upper() + "!", texts[2] + " " + edited(rng, items[3], 1), texts[3] + edited(rng, items[2], 9), items[0] + " " + items[0], items[4], None, "", (texts[5] + " ") * 40 + items[3]]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, doc_id long")
    docs = frame(spark, rows)
    got = decontamination.find_leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == plain_leaks(rows, items)
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(rows))) - {r["doc_id"] for r in got}
    assert decontamination.find_leaks(docs.limit(0), bench).count() == 0 and decontamination.find_leaks(docs, bench.limit(0)).count() == 0


def test_leaks_at_the_edges(spark):
    """Items cut at an edge of the document, and items shortened to a whole document."""
    rng = random.Random(9)
    items = [prose(rng, n) for n in (30, 45, 59)]
    rows, want = [], set()
    for k, item in enumerate(items):
        words, other = item.split(), prose(rng, 80)
        short = [words[1:], words[:-1], words[2:], words[:-2]]
        for doc in [" ".join(x) for x in short] + [" ".join(x) + " " + other for x in short[::2]] + [other + " " + " ".join(x) for x in short[1::2]]:
            want.add((len(rows), k))
            rows.append(doc)
        rows.append(" ".join(words[len(words) // 2 :]) + " " + other)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontamination.find_leaks(frame(spark, rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want


def test_several_items_in_one_text(spark):
    rng = random.Random(6)
    items = [prose(rng, 20) for _ in range(6)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontamination.find_leaks(frame(spark, [" ".join(items), items[3]]), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(0, i) for i in range(6)} | {(1, 3)}


def test_blocks_miss_nothing_inside_the_radius(spark):
    rng = random.Random(7)
    masks = [sum(1 << b for b in rng.sample(range(64), k)) for k in (0, 5, 15, decontamination.RADIUS) for _ in range(50)]
    near = [any(bin(m >> 8 * b & 255).count("1") <= decontamination.FLIPS for b in range(decontamination.BLOCKS)) for m in masks]
    assert all(near)


def test_leaks_cut_swapped_and_spliced(spark):
    """Random damage to items, alone and inside other text, against brute force over all windows."""
    rng = random.Random(21)
    items = [prose(rng, n) for n in (9, 15, 31, 45, 59, 80)] + [prose(rng, 30) * 2]
    rows = []
    for _ in range(160):
        words = rng.choice(items).split()
        for _ in range(rng.randint(1, 3)):
            at, n = rng.randrange(len(words)), rng.randint(1, 4)
            words = rng.choice([
                words[at:] + words[:at], words[n:], words[:-n], words[:at] + words[at + n :], words[:at] + prose(rng, n).split() + words[at:],
                words[:at] + ["other"] + words[at + 1 :], words + words[:at]]) or ["none"]
        before, after = ("", prose(rng, rng.randint(1, 60)), prose(rng, 3))[rng.randrange(3)], ("", prose(rng, rng.randint(1, 60)), prose(rng, 2))[rng.randrange(3)]
        rows.append(f"{before} {' '.join(words)} {after}".strip())
    rows += [" ".join(items), items[5].split(" ", 40)[-1] + " " + " ".join(items[5].split()[:40]), items[0], None, ""]
    docs = frame(spark, rows)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = plain_leaks(rows, items)
    assert len(want) > 60
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(docs, bench).collect()} == want
    twice = decontamination.find_leaks(docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long"))), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in twice if r["doc_id"] is not None} == want and {r["item_id"] for r in twice if r["doc_id"] is None} == {k for _, k in want}


def test_very_long_text(spark):
    rng = random.Random(22)
    item = prose(rng, 40)
    rows = [prose(rng, 20_000) + " " + item + " " + prose(rng, 20_000), (item + " ") * 300]
    got = decontamination.find_leaks(frame(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {0, 1}


def test_crowded_filter_loses_nothing(spark, monkeypatch):
    """So many hashes a bit that most of the text passes the filter."""
    monkeypatch.setattr(decontamination, "FILTER_BITS", 7)
    rng = random.Random(23)
    items = [prose(rng, 20) for _ in range(30)]
    rows = [prose(rng, 100) for _ in range(5)] + [items[3] + " " + prose(rng, 50), items[7]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(frame(spark, rows), bench).collect()} == {(5, 3), (6, 7)}


def test_one_id_with_several_texts(spark):
    """Rows of one id are judged by their own texts: nothing unlike is joined or lost."""
    rng = random.Random(31)
    a, b, c, e = (prose(rng, 60) for _ in range(4))
    rows = [(1, a), (1, b), (2, a), (3, b), (4, c), (4, e), (4, c), (5, None), (5, ""), (6, edited(rng, c, 1))]
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id long, text string, tk long, class_id string")
    got = neardup.classes(docs).collect()
    assert len(got) == len(rows)
    of = collections.defaultdict(set)
    for r in got:
        of[r["doc_id"]].add(r["class_id"])
    assert of[2] == {2} and of[3] == {3} and of[1] == {2, 3} and of[5] == {5} and of[6] == {6}
    assert len(of[4]) == 2 and 6 in of[4] and max(of[4]) >= neardup.NO_ID
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted([(2, a), (3, b), (4, e), (5, ""), (6, rows[9][1])])


def test_hot_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(neardup, "DEALT", 7)
    monkeypatch.setattr(neardup, "DEALT_TEXTS", 3)
    rng = random.Random(32)
    base = prose(rng, 120)
    rows = [base] * 30 + [edited(rng, base, rng.randint(1, 4)) for _ in range(60)] + [prose(rng, 40) for _ in range(10)]
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(frame(spark, rows)).collect()} == plain_classes(rows)
    same = frame(spark, [base] * 40 + [prose(rng, 30)]).withColumn("doc_id", F.lit(3).cast("long"))
    assert neardup.keep_one(same).count() == 2 and neardup.classes(same).select("class_id").distinct().count() == 2
