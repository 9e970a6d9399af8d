"""Near-duplicates by weighted MinHash (BagMinHash), banding and exact multiset overlap.

A document is the multiset of its five-word shingles (words: lower case, parted by white space, without punctuation at
their edges; a text of one to four words is one shingle).  Each shingle owns, on every dyadic block of discretised
weights [0,1), [1,2), [2,4), [4,8) ..., a Poisson process in time whose rate is the block's width; a point lies at a
random weight inside its block, belongs to one of the signature's components, and counts only if the shingle's weight
reaches it.  A component keeps its earliest point, so two documents agree in it with the probability of their weighted
Jaccard similarity.  Points are drawn in time order and only up to the time by which all components are
surely filled; the few documents where one is not are drawn again up to a later time.

Copies (equal word sequences) collapse first.  Signatures are cut into 25 bands of 4; a pair at 0.8 meets in some band
with probability 1 - 2e-6.  Candidates must agree in 62 of 100 components (a pair at 0.8 falls below that
once in 10^5) and are then compared exactly, on whole texts.  Links are found in two rounds, so that a group is never
turned into all its pairs as rows: each member of a bucket with the bucket's most central member (the one that shares most
buckets), then every pair of a bucket that is still in different components: as rows in buckets of up to 16, and in a
larger one block by block.  There the members outside the bucket's main component and those inside it are each dealt
into pieces, and every piece of the former meets every other piece in some task.  A task first compares signatures,
each pair in the first band that it shares, and sends on only members with a partner that agrees; these are then compared
exactly.  Nothing is left out at any size: the time for a bucket grows with its members outside the main component times
all its members, the memory of a task does not grow.

Hot keys are dealt: the rows of a text, a centre or a component that has more than ``DEALT`` of them (``DEALT_TEXTS`` where
they carry texts) go to several tasks, and the one row that they all need is copied to each.

Null texts count as empty.  Texts without a word match only equal texts, texts of any length are taken whole.  Repeated rows are
in one class; rows of one doc_id with unlike texts are judged by their own texts.  class_id is the least doc_id of the class
that has one text only, or, in a class that has none, a number from 2^62 on that follows from the text.  A null doc_id gets
no class (null).  Other columns of the input are kept by ``keep_one``, whatever their names, and left out by ``classes``.  An
empty table gives an empty result.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick, small_batches, unlike
from .units import ranges, slices

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 4
COMPONENTS = BANDS * ROWS
AGREE = 62
SMALL, PIECE, PIECE_CHARS = 16, 1024, 4_000_000
RARE, COLUMNS = 16, 1024
BROADCAST_IDS = 2_000_000  # ids (at most 32 MB) that may be sent to every executor; more are joined by shuffle
DEALT, DEALT_TEXTS = 200_000, 4096  # rows of one key that one task may hold
NO_ID = 1 << 62  # from here on class numbers of texts without a doc_id of their own
_EDGE = re.compile(r"^\W+|\W+$")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and where each text's words begin (one more than texts)."""
    import xxhash

    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    words = [_EDGE.sub("", w).lower() for w in coded.dictionary.to_pylist()]
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) | 1 if w else 0 for w in words), np.uint64, len(words))
    h = hashed[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.uint64)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    real = h != 0
    before = np.concatenate([[0], np.cumsum(real)])
    return h[real], before[offsets - offsets[0]]


def shingles(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes, ascending inside each text, and where each text's begin."""
    n = np.diff(offsets)
    count = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(np.int64))
    at = ranges(offsets[:-1], count)
    width = np.repeat(np.minimum(n, WORDS), count)
    s = np.zeros(len(at), np.uint64)
    padded = np.concatenate([h, np.zeros(WORDS, np.uint64)])
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            s = mix(s * np.uint64(3) + np.where(width > k, padded[at + k], np.uint64(k)))
    begin = np.concatenate([[0], np.cumsum(count)])
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        s[a:b].sort()
    return s, begin


def distinct(s: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles with their counts, and the text of each."""
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    first[begin[:-1][begin[:-1] < len(s)]] = True
    at = np.flatnonzero(first)
    return s[at], np.diff(np.append(at, len(s))), np.searchsorted(begin, at, side="right") - 1


def signatures(s: np.ndarray, count: np.ndarray, doc: np.ndarray, n_docs: int, m: int = COMPONENTS) -> np.ndarray:
    """n_docs x m values of 16 bits; rows of documents without a shingle are 0."""
    values = np.zeros((n_docs, m), np.uint16)
    weight = np.bincount(doc, weights=count, minlength=n_docs)
    todo = np.flatnonzero(weight > 0)
    until = np.zeros(n_docs)
    until[todo] = (np.log(m) + 3) / weight[todo]
    # one row for each shingle and dyadic block that its weight reaches into
    item, block = [np.arange(len(s))], [np.zeros(len(s), np.int64)]
    k = 1
    while (reach := np.flatnonzero(count > 2 ** (k - 1))).size:
        item.append(reach)
        block.append(np.full(len(reach), k))
        k += 1
    item, block = np.concatenate(item), np.concatenate(block)
    while len(todo):
        use = np.zeros(n_docs, bool)
        use[todo] = True
        keep = use[doc[item]]
        i, b = item[keep], block[keep]
        width = np.where(b > 0, 2.0 ** (b - 1), 1.0)
        with np.errstate(over="ignore"):
            seed = mix(s[i] + b.astype(np.uint64) * _STEP)
        d, time, end = doc[i], np.zeros(len(i)), until[doc[i]]
        rate, floor, limit = width, np.where(b > 0, width, 0.0), count[i]
        got_key, got_time, got_value = [], [], []
        while len(seed):
            with np.errstate(over="ignore"):
                seed = seed + _STEP
            x = mix(seed)
            time = time - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (rate * m)
            live = time < end
            seed, time, end, rate, floor, limit, d, x = (v[live] for v in (seed, time, end, rate, floor, limit, d, x))
            y = mix(x)
            inside = floor + np.floor((mix(y) >> np.uint64(11)).astype(np.float64) * 2.0**-53 * rate) < limit
            component = ((y >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            got_key.append((d * m + component.astype(np.int64))[inside])
            got_time.append(time[inside])
            got_value.append(y.astype(np.uint16)[inside])
        key, when, value = np.concatenate(got_key), np.concatenate(got_time), np.concatenate(got_value)
        order = np.argsort(-when, kind="stable")  # the earliest is written last
        filled = np.zeros(n_docs * m, bool)
        flat = values.reshape(-1)
        flat[key[order]] = value[order]
        filled[key] = True
        todo = todo[~filled.reshape(n_docs, m)[todo].all(axis=1)]
        until[todo] *= 3
    return values


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def dealt(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame, by: str) -> DataFrame:
    """The join of many rows a key with one row a key.  hot (keys, parts) names the keys whose many rows are dealt, by a hash
    of column `by`; the one row is copied to every part."""
    left = many.join(hot, keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), F.col("parts")), F.lit(0))).drop("parts")
    right = one.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts"), F.lit(1)).cast("long") - 1))).drop("parts")
    return left.join(right, [*keys, "_part"]).drop("_part")


def hot_keys(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """keys, parts: those with more than `most` rows; at most rows / most of them."""
    return _bounded(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / most).cast("long").alias("parts")))


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, tk (hash of the text), k1, k2 (128 bits of the word sequence), size (characters), sig, bands."""
    rows = small_batches(pick(docs, doc_id="long", text="string")).where("doc_id is not null").withColumn("tk", text_key(F.col("text")))

    def run(batches):
        import xxhash

        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                texts = part.column("text")
                h, offsets = word_hashes(texts)
                n = np.diff(offsets)
                owner = np.repeat(np.arange(len(n)), n)
                place = (np.arange(len(h)) - offsets[owner]).astype(np.uint64)
                key = np.zeros((2, len(n)), np.uint64)
                with np.errstate(over="ignore"):
                    for row, salt in enumerate((np.uint64(1), np.uint64(0x5851F42D4C957F2D))):
                        terms = np.concatenate([[np.uint64(0)], np.cumsum(mix(h + (place + salt) * _STEP), dtype=np.uint64)])
                        key[row] = terms[offsets[1:]] - terms[offsets[:-1]]
                for i in np.flatnonzero(n == 0).tolist():  # no word: the text itself
                    digest = xxhash.xxh3_128_intdigest(texts[i].as_py() or "")
                    key[:, i] = digest & (1 << 64) - 1, digest >> 64
                s, begin = shingles(h, offsets)
                sig = signatures(*distinct(s, begin), len(n))
                with np.errstate(over="ignore"):
                    bands = mix(sig.reshape(-1).view(np.uint64).reshape(len(n), BANDS) + np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP)
                has = np.flatnonzero(n > 0)
                lens = np.where(n > 0, BANDS, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(bands[has].reshape(-1).view(np.int64)))
                blobs = pa.array([x.tobytes() for x in sig], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tk"), pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64)), pc.cast(pc.utf8_length(pc.fill_null(texts, "")), pa.int32()), blobs, lists], names=["doc_id", "tk", "k1", "k2", "size", "sig", "bands"])

    return rows.mapInArrow(run, "doc_id long, tk long, k1 long, k2 long, size int, sig binary, bands array<long>")


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree in AGREE components or more."""
    sig = nodes.select("rep", "sig")
    ends = pairs.join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
    both = dealt(ends, sig.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), ["a"], hot_keys(pairs, ["a"], DEALT), "b")

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, COMPONENTS) for c in ("sa", "sb"))
            near = pa.array((x == y).sum(axis=1) >= AGREE)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near)], names=["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _blocks(members: DataFrame) -> DataFrame:
    """members with i, j and piece: a row for each block (two pieces) of its bucket that a member takes part in.

    Members of the component with most members in the bucket need not meet each other.  The others are dealt into
    pieces 0 .. po-1, these into po .. po+pm-1; blocks are i < po and j > i.  Pairs inside piece i are compared in the one
    block with j = po (`inner`)."""
    held = members.groupBy("bucket", "comp").agg(F.count("*").alias("c"), F.sum("size").alias("s"))
    dims = held.groupBy("bucket").agg(F.max(F.struct("c", (-F.col("comp")).alias("k"), "s")).alias("m"), (F.sum("c") - F.max("c")).alias("others"), F.sum("s").alias("s")).where("others > 0")
    pieces = lambda c, s: F.greatest(F.ceil(c / PIECE), F.ceil(s / PIECE_CHARS), F.lit(1)).cast("int")
    dims = dims.select("bucket", (-F.col("m.k")).alias("main"), pieces(F.col("others"), F.col("s") - F.col("m.s")).alias("po"), pieces(F.col("m.c"), F.col("m.s")).alias("pm"))
    deal = lambda n: F.pmod(F.xxhash64("rep", "bucket"), F.col(n)).cast("int")
    dealt = members.join(dims, "bucket").withColumn("piece", F.when(F.col("comp") == F.col("main"), F.col("po") + deal("pm")).otherwise(deal("po")))
    partner = F.sequence(F.lit(0), F.when(F.col("comp") == F.col("main"), F.col("po") - 1).otherwise(F.col("po") + F.col("pm") - 1))
    met = dealt.withColumn("x", F.explode(partner)).where("x <> piece")
    return met.select("bucket", "rep", "comp", "piece", F.least("x", "piece").alias("i"), F.greatest("x", "piece").alias("j"), (F.greatest("x", "piece") == F.col("po")).alias("inner"))


def _partnered(table: pa.Table) -> pa.Table:
    """Members of a block with a partner in another component that agrees in AGREE components or more, where this
    bucket's band is the first that the two share."""
    comp, piece = (table.column(c).to_numpy() for c in ("comp", "piece"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, COMPONENTS)
    quads = np.ascontiguousarray(sig).view(np.uint64)
    bucket, i = np.int64(table.column("bucket")[0].as_py()).view(np.uint64), table.column("i")[0].as_py()
    with np.errstate(over="ignore"):
        band = int(np.argmax(mix(quads[0] + np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP) == bucket))
    left, right = np.flatnonzero(piece == i), np.flatnonzero(piece != i)
    keep = np.zeros(len(comp), bool)
    for other in (right, left) if table.column("inner")[0].as_py() else (right,):
        agree = np.zeros((len(left), len(other)), np.uint8)
        x, y = np.ascontiguousarray(sig[left].T), np.ascontiguousarray(sig[other].T)
        for c in range(COMPONENTS):
            agree += x[c][:, None] == y[c]
        a, b = np.nonzero((agree >= AGREE) & (comp[left][:, None] != comp[other]))
        for part in range(0, len(a), 1 << 18):
            u, v = left[a[part : part + (1 << 18)]], other[b[part : part + (1 << 18)]]
            here = ~(quads[u, :band] == quads[v, :band]).any(axis=1)
            keep[u[here]] = keep[v[here]] = True
    return table.select(["bucket", "i", "j", "rep", "comp"]).filter(pa.array(keep))


def common(s: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """n x n, above the diagonal: the size of the multiset intersection of the shingles of each two texts."""
    n = len(begin) - 1
    doc = np.repeat(np.arange(n), np.diff(begin))
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    copy = np.arange(len(s)) - np.repeat(at, np.diff(np.append(at, len(s))))
    with np.errstate(over="ignore"):  # the k-th copy of a shingle is an element of its own
        _, column, often = np.unique(mix(s + copy.astype(np.uint64) * _STEP), return_inverse=True, return_counts=True)
    out = np.zeros((n, n), np.float32)  # whole numbers, exact up to 2^24
    dense = np.flatnonzero(often > RARE)
    number = np.full(len(often), -1)
    number[dense] = np.arange(len(dense))
    number = number[column]
    for c in range(0, len(dense), COLUMNS):
        at = np.flatnonzero((number >= c) & (number < c + COLUMNS))
        has = np.zeros((n, min(COLUMNS, len(dense) - c)), np.float32)
        has[doc[at], number[at] - c] = 1
        out += has @ has.T
    at = np.flatnonzero((often[column] > 1) & (number < 0))
    at = at[np.argsort(column[at], kind="stable")]
    for step in range(1, RARE):
        same = np.flatnonzero(column[at[step:]] == column[at[:-step]])
        np.add.at(out, (doc[at[same]], doc[at[same + step]]), 1)
    return out


def _block_links(kept: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between components that connect all that the exact comparison of each block connects."""

    def links(table: pa.Table) -> pa.Table:
        comp = table.column("comp").to_numpy()
        s, begin = shingles(*word_hashes(table.column("text").combine_chunks()))
        both, weight = common(s, begin).astype(np.float64), np.diff(begin)
        near = np.triu(both / (weight[:, None] + weight - both) >= similarity, 1) & (comp[:, None] != comp)
        near |= near.T
        todo, a, b = np.ones(len(comp), bool), [], []
        for start in range(len(comp)):
            ahead = [start] if todo[start] else []
            todo[start] = False
            while ahead:
                u = ahead.pop()
                new = np.flatnonzero(near[u] & todo)
                todo[new] = False
                ahead += new.tolist()
                a.append(np.minimum(comp[u], comp[new]))
                b.append(np.maximum(comp[u], comp[new]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return kept.join(texts, "rep").select("bucket", "i", "j", "comp", "text").groupBy("bucket", "i", "j").applyInArrow(links, "a long, b long")


def overlap(texts_a: pa.Array, texts_b: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets, row by row."""
    (sa, ba), (sb, bb) = (shingles(*word_hashes(t)) for t in (texts_a, texts_b))
    out = np.zeros(len(texts_a))
    for i in range(len(out)):
        x, y = sa[ba[i] : ba[i + 1]], sb[bb[i] : bb[i + 1]]
        both = np.concatenate([x, y])
        if not len(both):
            continue
        side = np.concatenate([np.ones(len(x), np.int64), np.zeros(len(y), np.int64)])
        order = both.argsort(kind="stable")
        run = np.flatnonzero(np.concatenate([[True], both[order][1:] != both[order][:-1]]))
        in_x = np.add.reduceat(side[order], run)
        common = np.minimum(in_x, np.diff(np.append(run, len(both))) - in_x).sum()
        out[i] = common / (len(both) - common)
    return out


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs at or above the similarity; b is the end with few pairs, its text is joined first, those of a hot a are dealt."""
    ends = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b")
    both = dealt(ends, texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), ["a"], hot_keys(pairs, ["a"], DEALT_TEXTS), "b")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "ta", 2_000_000):
                near = pa.array(overlap(part.column("ta"), part.column("tb")) >= similarity)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(near), part.column("b").filter(near)], names=["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """node, comp (least node of its component) of all nodes with a link: least labels pass along links and labels
    jump to their own label, until nothing changes."""
    links = scratch.table(f"{tag}-links", links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    label = scratch.table(f"{tag}-0", links.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("c")))
    hot = hot_keys(links, ["v"], DEALT)
    step = 0
    while True:
        near = dealt(links, label.select(F.col("u").alias("v"), "c"), ["v"], hot, "u").groupBy("u").agg(F.min("c").alias("n"))
        told = label.join(near, "u").select("u", F.least("c", "n").alias("c"))
        jump = label.select(F.col("u").alias("c"), F.col("c").alias("cc"))
        told = told.join(jump, "c", "left").select("u", F.least("c", F.coalesce("cc", "c")).alias("c"))
        step += 1
        new = scratch.table(f"{tag}-{step}", told)
        changed = new.join(label.select("u", F.col("c").alias("old")), "u").where("c <> old").limit(1).count()
        scratch.drop(f"{tag}-{step - 1}")
        label = new
        if not changed:
            scratch.drop(f"{tag}-links")
            return label.select(F.col("u").alias("node"), F.col("c").alias("comp"))


def _bounded(ids: DataFrame) -> DataFrame:
    """For broadcast only if its counted rows are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _classed(docs: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """doc_id, tk, class_id of every row with a doc_id."""
    signed = scratch.table("signed", sign(docs).withColumn("uid", F.monotonically_increasing_id()))
    ends = [f(c).alias(f"{c}_{i}") for c in ("k1", "k2") for i, f in enumerate((F.min, F.max))]
    shared = signed.groupBy("doc_id").agg(*ends).where("k1_0 <> k1_1 or k2_0 <> k2_1").select("doc_id", F.lit(True).alias("shared"))
    known = signed.select("doc_id", "tk", "uid", "k1", "k2").join(_bounded(scratch.table("shared", shared)), "doc_id", "left")
    reps = known.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "tk", "uid")).alias("src"), F.min(F.when(F.col("shared").isNull(), F.col("doc_id"))).alias("own"), F.count("*").alias("n"))
    named = F.coalesce("own", F.xxhash64("k1", "k2").bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID))
    reps = scratch.table("reps", reps.select("k1", "k2", named.alias("rep"), "src.*", "n"))
    nodes = scratch.table("nodes", signed.select("uid", "size", "sig", "bands").join(reps.select("uid", "rep"), "uid").select("rep", "size", "sig", "bands"))
    members_of = scratch.table("member", signed.select("doc_id", "tk", "k1", "k2"))
    repeated = members_of.groupBy("doc_id", "tk").count().where("count > 1").limit(1).count() > 0
    scratch.drop("signed")

    banded = nodes.select("rep", F.explode("bands").alias("bucket")).distinct()
    buckets = scratch.table("buckets", banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    held = scratch.table("held", banded.join(buckets, "bucket"))
    reach = scratch.table("reach", held.groupBy("rep").agg(F.sum("n").alias("reach")))
    centre = held.join(reach, "rep").groupBy("bucket").agg(F.max(F.struct("reach", (-F.col("rep")).alias("r"))).alias("x")).select("bucket", (-F.col("x.r")).alias("a"))
    wanted = reps.join(_bounded(reach.select("rep")), "rep", "left_semi").select("rep", "doc_id", "tk")
    texts = pick(docs, doc_id="long", text="string").withColumn("tk", text_key(F.col("text"))).join(_bounded(wanted), ["doc_id", "tk"]).select("rep", "text")
    texts = scratch.table("texts", texts.dropDuplicates(["rep"]) if repeated else texts)

    first = held.join(centre, "bucket").where("a <> rep").select("a", F.col("rep").alias("b")).distinct()
    first = scratch.table("first", _agreeing(first, nodes))
    linked = scratch.table("linked-1", _verified(first, texts, similarity).distinct())
    joined = components(linked, scratch, "comp-1")

    comp = held.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    comp = scratch.table("dealt", comp.select("bucket", "n", "rep", "comp"))
    small = comp.where(F.col("n") <= SMALL)
    left, right = small.select("bucket", F.col("rep").alias("a"), F.col("comp").alias("ca")), small.select("bucket", F.col("rep").alias("b"), F.col("comp").alias("cb"))
    every = left.join(right, "bucket").where("a < b and ca <> cb").select("a", "b").distinct()
    second = scratch.table("second", _agreeing(every, nodes))
    more = _verified(second, texts, similarity)
    large = comp.where(F.col("n") > SMALL).select("bucket", "rep", "comp").join(nodes.select("rep", "size"), "rep")
    met = _blocks(large).join(nodes.select("rep", "sig"), "rep").select("bucket", "i", "j", "piece", "inner", "rep", "comp", "sig")
    kept = scratch.table("kept", met.groupBy("bucket", "i", "j").applyInArrow(_partnered, "bucket long, i int, j int, rep long, comp long"))
    named = joined.select(F.col("node"), "comp")
    lifted = more.join(named.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(named.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
    lifted = lifted.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").union(_block_links(kept, texts, similarity)).distinct()
    lifted = scratch.table("linked-2", lifted)
    scratch.drop("texts", "dealt", "kept", "nodes", "held", "buckets")
    top = components(lifted, scratch, "comp-2")

    # a text's class; then each row looks up its text
    known = reps.select("k1", "k2", "rep", "n").join(joined.select(F.col("node").alias("rep"), "comp"), "rep", "left").withColumn("c1", F.coalesce("comp", "rep"))
    known = scratch.table("known", known.select("k1", "k2", "c1", "n"))
    top = top.select(F.col("node").alias("c1"), F.col("comp").alias("c2"))
    moved = dealt(known.select("c1", "k1", "k2", "n").join(_bounded(top.select("c1")), "c1", "left_semi"), top, ["c1"], hot_keys(known, ["c1"], DEALT), "k1")
    told = known.join(_bounded(top.select("c1")), "c1", "left_anti").select("k1", "k2", F.col("c1").alias("class_id"), "n").unionByName(moved.select("k1", "k2", F.col("c2").alias("class_id"), "n"))
    told = scratch.table("told", told)
    hot = _bounded(told.where(F.col("n") > DEALT).select("k1", "k2", F.ceil(F.col("n") / DEALT).cast("long").alias("parts")))
    return dealt(members_of, told.drop("n"), ["k1", "k2"], hot, "doc_id").select("doc_id", "tk", "class_id")


def classes(docs: DataFrame, similarity: float = SIMILARITY, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, class_id of every row."""
    scratch = scratch or Scratch(docs.sparkSession, "near-dup")
    unnamed = pick(docs, doc_id="long").where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"))
    return _classed(docs, similarity, scratch).select("doc_id", "class_id").union(unnamed)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, scratch: Scratch | None = None) -> DataFrame:
    """docs with one row of each class: that of its class_id, or of the least doc_id and text hash where all ids of the class have
    several texts.  Rows with a null doc_id stay.  All columns are kept, in their order."""
    scratch = scratch or Scratch(docs.sparkSession, "near-dup")
    classed = scratch.table("classed", _classed(docs, similarity, scratch).groupBy("doc_id", "tk", "class_id").agg(F.count("*").alias("n")))
    own, no_own = classed.where(F.col("class_id") < NO_ID), classed.where(F.col("class_id") >= NO_ID)
    least = no_own.groupBy("class_id").agg(F.min(F.struct("doc_id", "tk")).alias("l")).select("class_id", "l.doc_id", "l.tk")
    # of several writings of one text under its own id the least hash stays
    stays = own.where("doc_id = class_id").groupBy("doc_id").agg(F.min("tk").alias("tk")).unionByName(no_own.join(least, ["class_id", "doc_id", "tk"], "left_semi").select("doc_id", "tk"))
    stays = scratch.table("stays", stays)
    gone = scratch.table("gone", classed.join(stays, ["doc_id", "tk"], "left_anti").select("doc_id", "tk"))
    d, t = unlike(docs, "doc_id"), unlike(docs, "tk")
    same = lambda rows: rows.select(F.col("doc_id").alias(d), F.col("tk").alias(t))
    texts = F.col("text").cast("string") if "text" in {c.lower() for c in docs.columns} else F.lit(None).cast("string")
    match = (F.col("doc_id").cast("long") == F.col(d)) & (text_key(texts) == F.col(t))
    kept = docs.join(_bounded(same(gone)), match, "left_anti")
    again = classed.where("n > 1").join(stays, ["doc_id", "tk"], "left_semi").select("doc_id", "tk")
    if again.limit(1).count():  # repeated rows of a kept document: only those are moved
        again = scratch.table("again", again)
        once = docs.join(_bounded(same(again)), match).dropDuplicates([d, t]).select(*docs.columns)
        kept = kept.join(_bounded(same(again)), match, "left_anti").unionByName(once)
    return kept
