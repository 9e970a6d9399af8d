"""BPE against the library, exact round trips of the binary form."""
import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitewright.llm import bpe, token_binary, units
from sitewright.llm.common import Scratch
from tests.llm.conftest import frame

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "\n\n", "  two  spaces \n\n x", "é😀漢字", "a" * 5000, "don't we'll 's", "<|endoftext|>", "x<|endoftext|> y", " 　\x85 z", "12 3 456", "!?...", " \t mixed\r\n"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abcdeThing .,'\n\t  é漢😀 \x1c12!<|>")), max_size=40), min_size=1, max_size=5))
def test_same_as_library(texts):
    from tokenizers import Tokenizer

    lib = units.worker_cache().setdefault("test-library", None) or units.worker_cache().__setitem__("test-library", Tokenizer.from_file(PATH)) or units.worker_cache()["test-library"]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    for encoder in (bpe.codec(PATH)[1], units.library_encoder(PATH)):
        ids, offsets = encoder(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want


def test_forgetting_changes_nothing(library):
    vocabulary, _ = bpe.codec(PATH)
    small = units.UnitEncoder(vocabulary.encode_units, limit=20, recent=0)
    rng = random.Random(1)
    for _ in range(30):
        texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta,", "x."]) + str(rng.randint(0, 40)) for _ in range(20)) for _ in range(3)]
        ids, offsets = small(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_pair_check_agrees_with_merging():
    v, _ = bpe.codec(PATH)
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 3000, 4000), rng.integers(0, 3000, 4000)


    raw = lambda t: v.blob[v.start[t] : v.start[t] + v.size[t]]
    exact = [v.merge_long(v.byte_id[np.concatenate([raw(x), raw(y)])].tolist()) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert (~v.crossed(a, b)).tolist() == exact


def test_long_pieces_are_proposed_and_verified(library):
    """Pieces of any length go the same way: proposed, verified, and merged only if a pair is bad."""
    v, _ = bpe.codec(PATH)
    rng = random.Random(9)
    pieces = ["a" * n for n in (63, 64, 65, 300)] + ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(65, 400))) for _ in range(30)] + ["é" * 90, "漢字" * 50, "internationalization" * 20]
    ids, size = v.encode_pieces(pieces)
    ends = np.cumsum(size)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, size)] == [library.encode(p, add_special_tokens=False).ids for p in pieces]
    raw = [p.encode() for p in pieces]
    buf, end = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])
    piece, token = v.propose(buf, end - np.array([len(r) for r in raw]), end)
    assert [token[piece == i].tolist() for i in range(len(raw))] == [v.propose_one(r) for r in raw]


def test_units_kept_have_a_limit_in_bytes(library):
    small = units.UnitEncoder(bpe.codec(PATH)[0].encode_units, most_ids=500)
    rng = random.Random(10)
    for _ in range(20):
        texts = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 900))) + " x" for _ in range(3)]
        ids, offsets = small(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(small.ids) <= 500 + 3 * 900 and small.letters <= 8 * 500 + 3 * 900


def test_query_columns(spark, library):
    docs = frame(spark, ODD)
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, PATH, with_ids=True).collect()}
    for i, t in enumerate(ODD):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["token_ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert {r["doc_id"]: r["decoded"] for r in back.collect()} == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
    assert bpe.codec(PATH)[0].decode(np.array([102]), np.array([0, 1])) == ["�".encode()]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=30), max_size=8))
def test_pack(runs):
    count = np.array([len(r) for r in runs], np.int64)
    ranks = np.array([x for r in runs for x in r], np.uint32)
    control, n_control, data, n_data = token_binary.pack(ranks, count)
    assert len(control) == n_control.sum() and len(data) == n_data.sum()
    assert token_binary.unpack(control, data, count).tolist() == ranks.tolist()


def test_files(spark, library, monkeypatch):
    monkeypatch.setattr(token_binary, "SHARD_TOKENS", 400)
    monkeypatch.setattr(token_binary, "BLOCK_TOKENS", 150)
    texts = ODD + ["the harbor lantern " * n for n in range(1, 40)]
    scratch = Scratch(spark, "test")
    root = token_binary.write(frame(spark, texts), PATH, scratch)
    got = {r["doc_id"]: r for r in token_binary.checksums(token_binary.read(spark, root)).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert spark.read.parquet(f"{root}/blocks").select("shard").distinct().count() > 1
    assert spark.read.parquet(f"{root}/ranks").where("rank = 0").count() == 1


def test_shards_are_runs_of_tokens(spark, monkeypatch):
    """One id with many rows, null ids and texts longer than a shard: shards hold equal numbers of ids but for whole texts."""
    monkeypatch.setattr(token_binary, "SHARD_TOKENS", 60)
    monkeypatch.setattr(token_binary, "BLOCK_TOKENS", 25)
    rng = random.Random(4)
    texts = ["b " * rng.randint(0, 20) for _ in range(150)] + ["long " * 200]
    docs = frame(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") < 60, 7).when(F.col("doc_id") < 70, None).otherwise(F.col("doc_id")))
    scratch = Scratch(spark, "test")
    rows = token_binary.read(spark, token_binary.write(docs, PATH, scratch)).orderBy("start").collect()
    assert len(rows) == 151 and [r["start"] for r in rows] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])])[:-1].tolist()
    ids = [r["doc_id"] if r["doc_id"] is not None else -1 for r in rows]
    assert ids == sorted(ids) and ids[:10] == [-1] * 10 and ids[10:70] == [7] * 60
    held = {r["shard"]: r["n"] for r in spark.read.parquet(scratch.path("blocks")).selectExpr("shard", "aggregate(n_tokens, 0L, (a, n) -> a + n) AS n").groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    assert sorted(held) == list(range(len(held))) and max(n for s, n in held.items() if s < len(held) - 1) <= 60 + 42
    assert len(held) > 20


def test_repeated_ids_and_no_rows(spark):
    docs = frame(spark, ["b b", "a", "b b"]).selectExpr("7L as doc_id", "text")
    rows = token_binary.read(spark, token_binary.write(docs, PATH, Scratch(spark, "test"))).orderBy("start").collect()
    assert [r["n_tokens"] for r in rows] == [2, 3, 3] and [r["start"] for r in rows] == [0, 2, 5]
    empty = token_binary.write(docs.limit(0), PATH, Scratch(spark, "test"))
    assert token_binary.read(spark, empty).count() == 0
