"""Sharding along a Hilbert curve; built-in functions only.

Language, source and size become codes of 6 bits that keep the order of the values: the 64 codes of a dimension hold
about equally many rows, counted over all documents, and a value that many rows share has one code.  A row's cell is its index on
the three-dimensional curve, and the curve's order is cut into runs of equal row counts (law ``rows``: at most one apart).
Neighbours on the curve are neighbours in all three dimensions, so the least and greatest language, source and
size of a shard (or of a file of it) span little and prune on each of them.

A cell is dealt into as many pieces as its rows ask for (``PIECE_ROWS`` each), so one source with a third of all rows is
no hot group; a row's place is the cell's offset + the piece's + its place there, and only counts meet in one task: of cells (at most
2^18) and of pieces.  Only ids, sizes and checksums are shuffled, never text.

A null text has size 1 and checksum 0, null lang or source count as empty and come first, texts of any length and repeated
rows get slots of their own, equal texts are grouped by the caller through text_crc32 and size; other columns are left out,
whatever their names; an empty table gives an empty result.  Rows in one piece are ordered by id, checksum and size; equal rows
may change places.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pick

DIMS, BITS, PIECE_ROWS = 3, 6, 100_000


def _tables() -> tuple[list[int], list[int], list[int]]:
    """For each cell w of a curve step: entry corner, direction; for each Gray code its index."""
    n, gray = DIMS, lambda i: i ^ (i >> 1)
    trailing_ones = lambda i: (~i & (i + 1)).bit_length() - 1
    entry = [0 if w == 0 else gray(2 * ((w - 1) // 2)) for w in range(2**n)]
    turn = [0 if w == 0 else trailing_ones(w - 1 if w % 2 == 0 else w) % n for w in range(2**n)]
    index = [0] * 2**n
    for w in range(2**n):
        index[gray(w)] = w
    return entry, turn, index


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """Index of a point on the Hilbert curve, most significant step first; state: entry corner and direction."""
    n, mask = DIMS, 2**DIMS - 1
    entry, turn, index = (F.array(*[F.lit(x) for x in t]) for t in _tables())
    left = lambda x, k: (F.call_function("shiftleft", x, k).bitwiseOR(F.call_function("shiftright", x, F.lit(n) - k))).bitwiseAND(F.lit(mask))
    right = lambda x, k: (F.call_function("shiftright", x, k).bitwiseOR(F.call_function("shiftleft", x, F.lit(n) - k))).bitwiseAND(F.lit(mask))

    def step(acc: Column, b: Column) -> Column:
        corner = F.lit(0)
        for j, d in enumerate(dims):
            corner = corner + F.call_function("shiftleft", F.call_function("shiftright", d, b).bitwiseAND(F.lit(1)), F.lit(j))
        k = (acc["d"] + 1) % n
        w = F.get(index, right(corner.bitwiseXOR(acc["e"]), k))
        return F.struct(
            (acc["h"] * 2**n + w).cast("long").alias("h"),
            acc["e"].bitwiseXOR(left(F.get(entry, w), k)).cast("int").alias("e"),
            ((acc["d"] + F.get(turn, w) + 1) % n).cast("int").alias("d"),
        )

    zero = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), zero, step, lambda acc: acc["h"])


def depth_codes(rows: DataFrame, column: str, scratch: Scratch, levels: int = 2**BITS) -> Column:
    """The code of a column's value: where the middle of its rows lies in the order of values, in `levels` steps.

    Values are counted before they are ordered; sorted ranges of them, fixed by a written table, add up by range first.
    A code is told by at most levels - 1 least values, which alone come to the driver: no value is looked up by a join."""
    counted = rows.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    placed = scratch.table(f"values-{column}", counted.repartitionByRange("v").sortWithinPartitions("v").withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("range").agg(F.sum("n").alias("s")).select("range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("before"), F.sum("s").over(Window.partitionBy()).alias("total"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = placed.withColumn("inside", inside).join(ranges, "range")
    middle = (F.col("before") + F.col("inside") + F.col("n") / 2) * levels / F.col("total")
    firsts = known.groupBy(F.least(F.lit(levels - 1), F.floor(middle)).cast("int").alias("code")).agg(F.min("v").alias("v")).orderBy("code").collect()
    if not firsts:
        return F.lit(0)
    code = F.lit(firsts[0]["code"])
    for r in firsts[1:]:
        code = F.when(F.col(column) >= F.lit(r["v"]), r["code"]).otherwise(code)
    return code


def shard_rows(df: DataFrame, shards: int = 16, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size, text_crc32, lang, source, curve, shard, slot."""
    scratch = scratch or Scratch(df.sparkSession, "shards")
    rows = pick(df, doc_id="long", text="string", lang="string", source="string")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = rows.select("doc_id", size.alias("size"), crc.alias("text_crc32"), "lang", "source", plain("lang").alias("x"), plain("source").alias("y"), F.monotonically_increasing_id().alias("uid"))
    rows = scratch.table("rows", rows)
    codes = [depth_codes(rows, c, scratch).cast("int") for c in ("x", "y", "size")]
    rows = scratch.table("placed", rows.select("doc_id", "size", "text_crc32", "lang", "source", "uid", hilbert_index(codes).alias("curve")))

    cells = scratch.table("cells", rows.groupBy("curve").agg(F.count("*").alias("n")))
    whole = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("curve", F.ceil(F.col("n") / PIECE_ROWS).alias("parts"), F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    dealt = rows.join(F.broadcast(cells), "curve")  # at most 2^18 cells of four numbers
    dealt = dealt.withColumn("piece", F.pmod(F.xxhash64("doc_id", "text_crc32", "uid"), F.col("parts"))).drop("parts")
    pieces = scratch.table("pieces", dealt.groupBy("curve", "piece").agg(F.count("*").alias("n")))
    inner = Window.partitionBy("curve").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("curve", "piece", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("inside"))

    place = F.row_number().over(Window.partitionBy("curve", "piece").orderBy("doc_id", "text_crc32", "size")) - 1
    ranked = dealt.withColumn("_place", place).join(offsets, ["curve", "piece"]).withColumn("_rank", F.col("before") + F.col("inside") + F.col("_place"))
    shard = F.expr(f"(_rank * {shards}) div total")
    ranked = ranked.withColumn("shard", shard.cast("int"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return ranked.select("doc_id", "size", "text_crc32", "lang", "source", "curve", "shard", (F.col("_rank") - first).cast("long").alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, run_rows: int = 100_000) -> None:
    """One folder a shard; rows lie in curve order, each file holds a run of at most about run_rows slots.  docs must have a doc_id
    without repeats.  All columns of docs are kept but for a column `shard`, which is that of the folder."""
    run = F.floor(F.col("slot") / run_rows)
    rows = docs.drop("shard", "slot").join(placed.select("doc_id", "shard", "slot"), "doc_id").withColumn("_run", run)
    rows.repartition("shard", "_run").sortWithinPartitions("shard", "slot").drop("_run", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
