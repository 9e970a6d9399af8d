"""Filter audit, source divergence and packing against brute force."""
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitewright.llm import divergence, filter_audit, packing, units
from sitewright.llm.common import Scratch

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, n long, digest string, run long, ids string, begin long, term string, strip int"
ODD = ["", None, " ", "\n\n", "  two  Spaces \n\n x", "é😀漢字 É", "a" * 5000, "don't we'll 's", "<|endoftext|>", "X<|ENDOFTEXT|> y", "<|startoftext|> z", "<|STARTOFTEXT|> a<|startoftext|>b", " 　\x85 z", "12 3 456", "!?...", "á e ́x", "\x00\x1c q"]


def rows_frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 0, "p", 1, 2, "d", 3, "i", 4, "t", 5) for r in rows], EXTRA).repartition(4)


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text))]


def slow_audit(rows, labels):
    docs = []
    for doc_id, text, lang, _ in rows:
        text = text or ""
        again = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _, _ in rows)
        docs.append((lang or "", dict(zip("ABCDE", [*fails(text), again])), any(d == doc_id and q == 1 for d, q, _ in labels if d is not None), any(d == doc_id and x == 1 for d, _, x in labels if d is not None)))
    out = {}
    for part in {d[0] for d in docs}:
        own, shapley = [d for d in docs if d[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                failing = [d for d in own if d[1][f]]
                unique = sum(sum(d[1].values()) == 1 for d in failing)
                out[part, "".join(order), step] = [len(gone), len(failing) - len(gone), unique, sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[f] += len(gone)
                left = [d for d in left if not d[1][f]]
        for key in [k for k in out if k[0] == part]:
            out[key].append(shapley[key[1][key[2] - 1]])
    return out


def audit_rows(seed, n=120):
    rng = random.Random(seed)
    bodies = [None, "", "#", "ABC def", "x " * 300, " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(250)), " ".join(f"$v{i}" for i in range(201)), "tab\x0bword\x0c" * 120]
    rows = [(rng.choice([None, *range(n)]), rng.choice(bodies), rng.choice([None, "", "en", "en", "fr"]), None) for _ in range(n)]
    return rows + rows[:7]


def test_filter_audit_like_brute_force(spark):
    rows = audit_rows(1)
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 120, 2)] + [(4, 1, None), (None, 1, 1), (6, None, 1), (9999, 1, 1)]
    table = spark.createDataFrame([(d, q, None if t is None else int(t)) for d, q, t in labels], "doc_id long, quality int, toxic int")
    found = filter_audit.filter_audit(rows_frame(spark, rows), table).collect()
    got = {(r["part"], r["filter_order"], r["step"]): [r[f] for f in filter_audit.FIELDS] for r in found}
    assert len(got) == len(found)
    assert got == slow_audit(rows, [(d, q, None if t is None else int(t)) for d, q, t in labels])


def test_filter_audit_keeps_what_no_filter_so_far_fails(spark):
    rows = audit_rows(2)
    found = filter_audit.filter_audit(rows_frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(found) == 600 * len({lang or "" for _, _, lang, _ in rows})
    own = defaultdict(list)
    for doc_id, text, lang, _ in rows:
        again = doc_id is not None and any(d is not None and d < doc_id and (t or "") == (text or "") for d, t, _, _ in rows)
        own[lang or ""].append(dict(zip("ABCDE", [*fails(text or ""), again])))
    for r in found:
        assert r.kept == sum(not any(doc[f] for f in r.filter_order[: r.step]) for doc in own[r.part])


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 15), st.tuples(*[st.integers(0, 9)] * 3), min_size=1))
def test_diagram_keeps_counts_through_swaps(counts):
    diagram = filter_audit.Diagram("WXYZ", counts)
    seen = {"WXYZ"}
    for level in filter_audit.adjacent_swaps(4):
        diagram.swap(level)
        seen.add("".join(diagram.order))
        left = dict(counts)
        for name, removed in diagram.steps():
            bit = 1 << "WXYZ".index(name)
            gone = [v for m, v in left.items() if m & bit]
            assert removed == tuple(sum(v[k] for v in gone) for k in range(3))
            left = {m: v for m, v in left.items() if not m & bit}
        assert all(len(nodes) <= 2**k for k, nodes in enumerate(diagram.known))
    assert len(seen) == 24


def slow_divergence(rows):
    words, docs = defaultdict(Counter), defaultdict(Counter)
    groups = sorted({(lang or "", source or "") for _, _, lang, source in rows})
    for _, text, lang, source in rows:
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        words[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = {}
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        sources = [s for x, s in groups if x == lang]
        n = {s: {t: words[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(n[s][t] for s in sources) for t in kept}
        price = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: price(n[s]) for s in sources}, price(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if n[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= 200:
                        out[lang, s, part, rank] = (item, value)
    return out


@pytest.mark.parametrize("cells, seed", [(divergence.CELLS, 1), (40, 2)])
def test_divergence_like_brute_force(spark, cells, seed):
    rng = random.Random(seed)
    vocabulary = ["Ärger", "ärger", "straße", "漢字", "Don", "t", "KK"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(320)]
    body = lambda k: rng.choice([None, "", "12 34 --", *[rng.choice([" ", "_", "\x00", "'"]).join(rng.choices(vocabulary, k=k)) for _ in range(9)]])
    rows = [(rng.randrange(50), body(rng.choice([5, 40, 900])), rng.choice(["en", "en", "de", None]), rng.choice([None, "", *"abcdefg"])) for _ in range(150)]
    rows += rows[:5] + [(1, "lone words", "xx", "a"), (1, None, "xx", "b"), (2, "same same same", "yy", "only")]
    found = divergence.source_divergence(rows_frame(spark, rows), cells=cells).collect()
    got = {(r["lang"], r["source"], r["part"], r["rank"]): (r["item"], r["value"]) for r in found}
    assert len(got) == len(found)
    assert got == slow_divergence(rows)


@pytest.mark.parametrize("n_rows, n_cols, side, most", [(1, 1, 4, 10), (7, 50, 2, 16), (40, 9, 8, 500), (5, 300, 256, 64), (33, 33, 16, 10**6)])
def test_joint_leaves_are_all_pairs_of_cells(n_rows, n_cols, side, most):
    rng = np.random.default_rng(n_rows)
    full = rng.random((n_rows, n_cols)) < 0.15
    row, col = np.nonzero(full)
    mixed = rng.permutation(len(row))
    tree, got = divergence.K2Tree(row[mixed], col[mixed], n_rows, n_cols), []
    blocks = range(-(-n_rows // side))
    for i, j in itertools.combinations_with_replacement(blocks, 2):
        for g, h, a, b in tree.joint_leaves(n_rows, (i, j), side, most):
            assert (g // side == i).all() and (h // side == j).all()
            for x, y, u, v in zip(g, h, a, b):
                assert u < 0 or row[mixed][u] == x
                assert v < 0 or row[mixed][v] == y
                got.append((x, y, col[mixed][u if u >= 0 else v], u >= 0, v >= 0))
    want = [(g, h, t, full[g, t], full[h, t]) for g in range(n_rows) for h in range(g + 1, n_rows) for t in range(n_cols) if full[g, t] or full[h, t]]
    assert sorted(got) == sorted(want)


def test_price_of_counts_beyond_the_product():
    count, total = np.array([0, 10**13, 9 * 10**17]), np.array([10**18] * 3)
    assert divergence.price(count, total, 5).tolist() == [1 + 10**9 * (c + 1) // (10**18 + 5) for c in count.tolist()]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abcdeThING .,'\n\t  é漢😀 \x1c12!<|>́")), max_size=40), min_size=1, max_size=5))
def test_word_tokenizer_by_units(texts):
    cache = units.worker_cache()
    if "word-library" not in cache:
        cache["word-library"] = library()
    ids, offsets = units.library_encoder(PATH)(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [e.ids for e in cache["word-library"].encode_batch(texts, add_special_tokens=False)]


def test_packing_cuts_one_line(spark, texts):
    rows = [(None if i == 3 else i // 2, t, None, None) for i, t in enumerate([*ODD, *texts, " ".join(texts) * 5, *texts[:4]])]
    placed = packing.pack(rows_frame(spark, rows), PATH, Scratch(spark, "t-packing"))
    ids = {}
    for (doc_id, text, _, _), e in zip(rows, library().encode_batch([r[1] or "" for r in rows], add_special_tokens=False)):
        ids.setdefault(doc_id, []).append([*e.ids, packing.END_ID])

    length = 512
    lines = sorted(((r["begin"], r["n_tokens"], r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in placed.collect()), key=lambda x: x[0])
    assert sorted((str(d), i) for _, _, d, i in lines) == sorted((str(d), i) for d, all_ids in ids.items() for i in all_ids)
    line = [i for *_, own in lines for i in own]
    assert [b for b, *_ in lines] == [0, *itertools.accumulate(n for _, n, *_ in lines)][:-1]

    want = []
    for begin, n, doc_id, own in lines:
        for w in range(begin // length, (begin + n - 1) // length + 1):
            a, b = max(begin, w * length), min(begin + n, (w + 1) * length)
            want.append((doc_id, a - begin, b - a, zlib.crc32(np.array(own[a - begin : b - begin], "<u4").tobytes()), n, w, a - w * length))
    got = [tuple(r) for r in packing.pieces(placed, length).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)

    made = {r["sequence_id"]: (r["n_tokens"], r["ids"]) for r in packing.sequences(placed, length, pad_id=-1).collect()}
    assert sorted(made) == list(range(-(-len(line) // length)))
    for k, (n, own) in made.items():
        part = line[k * length : (k + 1) * length]
        assert n == len(part) and own[:n] == part
        assert len(own) == (n if n & (n - 1) == 0 else length) and set(own[n:]) <= {-1}


def test_a_short_sequence_of_a_power_of_two_is_not_padded(spark):
    rows = [(1, np.arange(4, dtype="<u4").tobytes(), 4, 0), (2, np.arange(3, dtype="<u4").tobytes(), 3, 4)]
    placed = spark.createDataFrame(rows, "doc_id long, ids binary, n_tokens long, begin long")
    assert [len(r["ids"]) for r in packing.sequences(placed, 8).collect()] == [8]
    assert [len(r["ids"]) for r in packing.sequences(placed.where("doc_id = 1"), 8).collect()] == [4]


def test_empty_tables(spark):
    none = rows_frame(spark, []).repartition(1)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(none, labels).collect() == []
    assert divergence.source_divergence(none).collect() == []
    placed = packing.pack(none, PATH)
    assert packing.pieces(placed).collect() == [] and packing.sequences(placed).collect() == []


def test_missing_columns_read_as_null(spark):
    ids = spark.range(3).select(F.col("id").alias("doc_id"))
    assert {r["part"] for r in filter_audit.filter_audit(ids, ids).collect()} == {""}
    assert divergence.source_divergence(ids).collect() == []
    assert sorted(r["doc_tokens"] for r in packing.pieces(packing.pack(ids, PATH)).collect()) == [1, 1, 1]
