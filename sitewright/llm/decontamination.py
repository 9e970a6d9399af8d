"""Benchmark decontamination; built-in functions only.

Item-sized windows of a document get a 64-bit SimHash over their weighted five-word shingles.  Items and
windows meet on eight 8-bit blocks; an item is entered under every block value within two bits, so every pair of
fingerprints within 23 bits meets in some block (23 = 8 x 2 + 7).  Pairs inside that radius are then compared exactly:
weighted Jaccard of the shingle multisets, 0.8 or more.

Every window of an item's length that can reach the similarity is fingerprinted, wherever it begins: two multisets of
m and n shingles at similarity s share s / (1 + s) * (m + n) of them, so a window with fewer places that hold a shingle of
some item of its length cannot.  Windows lie inside the document; a document shorter than the item is one window of its own
length.  Passages cut at an edge, shortened, put in another order or spliced into other text are therefore found as soon as some
window is similar enough.

Documents are read once, whatever the number of items: a row tests its own shingle hashes against a Bloom filter of the
items' (two bits a hash in at most 2^``FILTER_BITS`` bits, the bound of what is sent to the executors), and only the stretches
around hits leave the row, as hashes.  A join on the hashes then drops what the filter let through wrongly.  Equal
stretches are looked at once.

Null and empty texts, texts under five words, and items under five words, have no shingle and match nothing.  Texts are
taken whole, of any length; the work for a stretch grows in proportion to its length.  A pair (doc_id, item_id) is returned once
with its best window (the first of equal ones), however often rows or passages repeat; rows of one doc_id count
together, a null doc_id is reported as null.  Other columns of the inputs are not looked at, whatever their names.  Empty
tables give an empty result.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let, pick

WORDS, SIMILARITY = 5, 0.8
BLOCKS, BLOCK_BITS, FLIPS = 8, 8, 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
FILTER_BITS, BITS_A_HASH = 24, 128


def words_of(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(words: Column) -> Column:
    empty = F.array().cast("array<bigint>")
    return F.when(F.size(words) >= WORDS, F.transform(F.sequence(F.lit(1), F.size(words) - (WORDS - 1)), lambda i: F.xxhash64(F.slice(words, i, WORDS)))).otherwise(empty)


def simhash(shingles: Column) -> Column:
    """Bit j is set if most of the weight of the shingles has it set; a shingle counts as often as it occurs.  Bits
    j and j + 32 are counted in the two halves of one number."""
    pair = F.lit((1 << 32) | 1)
    votes = lambda j: F.aggregate(shingles, F.lit(0).cast("long"), lambda a, h: a + F.call_function("shiftright", h, j).bitwiseAND(pair))
    half = F.size(shingles)
    bit = lambda n, at: F.when(n * 2 > half, F.call_function("shiftleft", F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long"))
    low = lambda v: v.bitwiseAND(F.lit((1 << 32) - 1))
    high = lambda v: F.call_function("shiftright", v, F.lit(32))
    both = lambda j: let(votes(j), lambda v: bit(low(v), j).bitwiseOR(bit(high(v), j + 32)))
    return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda a, j: a.bitwiseOR(both(j)))


def blocks(fingerprint: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda b: F.struct(b.alias("block"), F.call_function("shiftright", fingerprint, b * BLOCK_BITS).bitwiseAND(F.lit(2**BLOCK_BITS - 1)).cast("int").alias("value")))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as multisets: sum of the smaller counts by the sum of the larger counts."""
    count = lambda arr, x: F.size(arr) - F.size(F.array_remove(arr, x))
    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return common / (F.size(a) + F.size(b) - common).cast("double")


def needed(m: Column, n: Column, similarity: float) -> Column:
    """The least number of shared shingles with which multisets of m and n can have the similarity."""
    return F.greatest(F.lit(1), F.ceil((m + n) * F.lit(similarity / (1 + similarity)) - 1e-9)).cast("int")


def _probes(h: Column, bits: int) -> tuple[Column, Column]:
    """The two bits of a hash in the filter: its low bits and its high bits."""
    mask = F.lit((1 << bits) - 1)
    return h.bitwiseAND(mask), F.call_function("shiftrightunsigned", h, F.lit(64 - bits)).bitwiseAND(mask)


def bloom(hashes: DataFrame, n: int) -> tuple[Column, int]:
    """The filter as a constant array of 64-bit words, and the bits of a probe.  At most 2^(FILTER_BITS - 6) words come
    back to the driver; with more hashes than fit well more stretches go to the join, none is lost."""
    bits = min(FILTER_BITS, max(10, math.ceil(math.log2(max(1, n) * BITS_A_HASH))))
    at = hashes.select(F.explode(F.array(*_probes(F.col("h"), bits))).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
    made = at.groupBy(F.call_function("shiftright", "p", F.lit(6)).alias("w")).agg(F.bit_or(one).alias("b")).collect()
    words = [0] * (1 << (bits - 6))
    for r in made:
        words[r["w"]] = r["b"]
    return F.from_json(F.lit("[" + ",".join(map(str, words)) + "]"), "array<bigint>"), bits


def _stretches(text: str, words: Column, bits: int, longest: int) -> Column:
    """The runs of a document's shingle hashes around the filter's hits: where a run begins, and its hashes, so far to both sides
    that every window with a hit lies inside.  One expression that binds words, hashes and hits once: were they
    columns, the optimizer could copy them into the inner loop."""

    def held(h: Column) -> Column:
        bit = lambda p: F.call_function("shiftright", F.get(words, F.call_function("shiftright", p, F.lit(6)).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
        first, second = _probes(h, bits)
        return bit(first) & bit(second)

    def runs(s: Column, hits: Column) -> Column:
        gap = 2 * longest
        begins = F.filter(hits, lambda x, i: (i == 0) | (x - F.get(hits, i - 1) > gap))
        ends = F.filter(hits, lambda x, i: (i == F.size(hits) - 1) | (F.get(hits, i + 1) - x > gap))

        def cut(a: Column, e: Column) -> Column:
            start = F.greatest(F.lit(0), a - longest)
            return F.struct(start.alias("from"), F.slice(s, start + 1, e + longest + 1 - start).alias("hashes"))

        return F.when(F.size(hits) > 0, F.zip_with(begins, ends, cut))

    def found(s: Column) -> Column:
        return let(F.filter(F.transform(s, lambda h, i: F.when(held(h), i)), lambda i: i.isNotNull()), lambda hits: runs(s, hits))

    return let(words_of(text), lambda w: let(shingle_hashes(w), found))


def prepare_items(benchmark: DataFrame, scratch: Scratch) -> DataFrame:
    """item_id, n (shingles), shingles, fp; equal rows once."""
    items = pick(benchmark, item_id="long", text="string").select("item_id", let(words_of("text"), shingle_hashes).alias("shingles")).where("size(shingles) > 0").distinct()
    return scratch.table("items", items.select("item_id", F.size("shingles").alias("n"), "shingles", simhash(F.col("shingles")).alias("fp")))


def windows_of(stretches: DataFrame, places: DataFrame, similarity: float) -> DataFrame:
    """sid, start (in the stretch), n (shingles of the items looked for), w (the window's shingles): every window that
    can be similar enough to an item of n shingles.  A run of as many hits as are needed that is no longer than a window
    tells which starts take it in."""
    hits = stretches.select("sid", F.posexplode("hashes").alias("at", "h")).join(places, "h").groupBy("sid", "n").agg(F.array_sort(F.collect_set("at")).alias("q"))
    rows = hits.join(stretches, "sid").withColumn("m", F.least(F.size("hashes"), F.col("n"))).withColumn("need", needed(F.col("m"), F.col("n"), similarity))
    last = F.size("hashes") - F.col("m")

    def starts(q: Column, need: Column, m: Column) -> Column:
        runs = F.transform(F.slice(q, need, F.size(q)), lambda e, i: F.struct(F.get(q, i).alias("a"), e.alias("e")))
        fits = F.filter(runs, lambda r: r["e"] - r["a"] < m)
        return F.array_distinct(F.flatten(F.transform(fits, lambda r: F.sequence(F.greatest(F.lit(0), r["e"] - m + 1), F.greatest(F.lit(0), F.least(r["a"], last))))))

    rows = rows.where(F.size("q") >= F.col("need")).select("sid", "n", "m", "hashes", F.explode(starts(F.col("q"), F.col("need"), F.col("m"))).alias("start"))
    return rows.select("sid", "start", "n", F.slice("hashes", F.col("start") + 1, F.col("m")).alias("w"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, item_id, similarity, hamming, start_word: the documents that hold an item, with each item's best window."""
    scratch = scratch or Scratch(docs.sparkSession, "leaks")
    items = prepare_items(benchmark, scratch)
    places = scratch.table("places", items.select("n", F.explode("shingles").alias("h")).distinct())
    hashes = places.select("h").distinct()
    longest, n = items.agg(F.max("n")).first()[0] or 1, hashes.count()
    words, bits = bloom(hashes, n)
    held = pick(docs, doc_id="long", text="string").select("doc_id", F.explode(_stretches("text", words, bits, longest)).alias("x")).select("doc_id", "x.*")
    held = scratch.table("held", held.withColumn("sid", F.concat(F.hex(F.xxhash64("hashes")), F.hex(F.xxhash64(F.lit(1), F.reverse("hashes"))))))
    stretches = held.select("sid", "hashes").dropDuplicates(["sid"])
    windows = scratch.table("windows", windows_of(stretches, places, similarity).withColumn("wfp", simhash(F.col("w"))))

    flips = [0] + [1 << i for i in range(BLOCK_BITS)] + [1 << i | 1 << j for i in range(BLOCK_BITS) for j in range(i)]
    entered = items.select("item_id", "n", "fp", F.explode(blocks(F.col("fp"))).alias("b")).select("item_id", "n", "fp", "b.block", F.explode(F.transform(F.array(*map(F.lit, flips)), lambda f: f.bitwiseXOR(F.col("b.value")))).alias("value"))
    asked = windows.select("wfp", "n").distinct().select("wfp", "n", F.explode(blocks(F.col("wfp"))).alias("b")).select("wfp", "n", "b.*")
    hamming = F.bit_count(F.col("wfp").bitwiseXOR(F.col("fp")))
    near = asked.join(entered, ["n", "block", "value"]).where(hamming <= RADIUS).select("wfp", "n", "item_id", hamming.alias("hamming")).distinct()
    pairs = windows.join(near, ["wfp", "n"]).join(items.select("item_id", "n", "shingles"), ["item_id", "n"])
    pairs = pairs.withColumn("similarity", weighted_jaccard(F.col("w"), F.col("shingles"))).where(F.col("similarity") >= similarity)
    order = lambda at: F.struct("similarity", (-F.col("hamming")).alias("h"), (-at).alias("s"))
    inside = scratch.table("leaks", pairs.groupBy("sid", "item_id").agg(F.max(order(F.col("start"))).alias("b")).select("sid", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.h")).alias("hamming"), (-F.col("b.s")).alias("start")))
    told = held.select("doc_id", "sid", "from").join(inside, "sid").withColumn("at", (F.col("from") + F.col("start")).cast("long"))
    best = told.groupBy("doc_id", "item_id").agg(F.max(order(F.col("at"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.h")).alias("hamming"), (-F.col("b.s")).alias("start_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, scratch: Scratch | None = None) -> DataFrame:
    """docs without the documents that hold an item.  A row with a null doc_id cannot be told by its id: it stays.  All columns
    are kept, in their order."""
    leaked = find_leaks(docs, benchmark, similarity, scratch).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(*docs.columns)
