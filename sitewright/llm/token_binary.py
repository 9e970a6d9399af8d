"""Token ids in a byte-aligned binary form with separate control bytes.

Ids are replaced by their rank in descending corpus frequency (counted over all documents), so frequent ids take
one byte.  A document's ranks are written as one to four bytes each; two-bit lengths of four ranks share a control
byte, and controls lie apart from data.  numpy decodes a block by table lookup.

Files are Parquet with one row a block: shard, block, start (ids before the block in its shard), doc_ids,
n_tokens, control, data; a second small table holds the id of each rank.  Spark's committer writes them, so a task that
is run again leaves one copy, on any file system.

A shard is a run of ``SHARD_TOKENS`` ids in ascending order of doc_id (rows of equal doc_id: by length, checksum, place in the
input; a null doc_id comes first), so shards are equally large whatever the texts' lengths, and one id with many rows is
parted like any other.  Where shards begin is counted exactly: keys and lengths alone are sorted in ranges, which a
written table fixes, only the ranges' sums meet in one task, and one key a shard reaches the driver.

Nulls encode as empty texts (the end id alone), texts of any length are taken whole and lie in one shard, repeated rows are written
each, other columns are left out, whatever their names; an empty table gives no block.
"""
from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pick, small_batches
from .units import library_encoder, ranges, slices

BLOCK_TOKENS, SHARD_TOKENS = 2_000_000, 8_000_000
END_ID = 0

#: Fixed rule: the four lengths that a control byte stands for, least significant pair first.
LENGTHS = (1 + ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3)).astype(np.uint8)


def real_slots(count: np.ndarray, n_control: np.ndarray) -> np.ndarray:
    """Which of the slots of all control bytes hold a rank; up to three at the end of a run are unused."""
    real = np.ones(4 * int(n_control.sum()), bool)
    unused = 4 * n_control - count
    real[ranges(4 * np.cumsum(n_control) - unused, unused)] = False
    return real


def pack(ranks: np.ndarray, count: np.ndarray) -> tuple[bytes, np.ndarray, bytes, np.ndarray]:
    """Control and data bytes of runs of ranks, and how many bytes of each belong to a run.  Every run begins a new
    control byte; the unused length pairs of its last one are 0 and have no data."""
    width = 2 if not len(ranks) or ranks.max() <= 0xFFFF else 4
    size = 1 + (ranks > 0xFF).astype(np.uint8)
    if width == 4:
        size += (ranks > 0xFFFF).astype(np.uint8) + (ranks > 0xFFFFFF)
    data = ranks.astype(f"<u{width}").view(np.uint8).reshape(-1, width)[np.arange(width, dtype=np.uint8) < size[:, None]]
    n_control = (count + 3) // 4
    pairs = np.zeros(int(n_control.sum()) * 4, np.uint8)
    pairs[real_slots(count, n_control)] = size - 1
    control = pairs[0::4] | pairs[1::4] << 2 | pairs[2::4] << 4 | pairs[3::4] << 6
    edge = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    ends = np.cumsum(count)
    return control.tobytes(), n_control, data.tobytes(), edge[ends] - edge[ends - count]


def unpack(control: bytes, data: bytes, count: np.ndarray) -> np.ndarray:
    """All ranks of a block."""
    n_control = (count + 3) // 4
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[real_slots(count, n_control)]
    begin = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data, np.uint8)
    ranks = raw[begin].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        ranks[more] |= raw[begin[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def flat(column: pa.Array, dtype: str) -> np.ndarray:
    """The bytes of a binary column end to end, as numbers; no copy."""
    offsets = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_binary(column.type) else np.int64)
    a, b = int(offsets[column.offset]), int(offsets[column.offset + len(column)])
    return np.frombuffer(column.buffers()[2], np.uint8)[a:b].view(dtype) if b > a else np.empty(0, dtype)


def id_type(path: str) -> str:
    """Two bytes hold every id of a vocabulary below 65536, else four are used."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() < 65536 else "<u4"


COUNTS = pa.list_(pa.struct([("id", pa.int32()), ("n", pa.int64())]))


def tokenize(df: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, as id_type says), with the end id; counts is null.  Each task adds one row with
    counts alone: how often it wrote each id."""
    dtype = id_type(path)
    width = int(dtype[2])
    rows = small_batches(pick(df, doc_id="long", text="string"))
    names = ["doc_id", "n_tokens", "ids", "counts"]

    def run(batches):
        encoder, total = library_encoder(path), np.zeros(1 << 16, np.int64)
        for batch in batches:
            for part in slices(batch, "text", 16_000_000):
                ids, offsets = encoder(part.column("text"))
                ids = np.insert(ids.astype(dtype), offsets[1:], end_id)
                edge = offsets + np.arange(len(offsets))
                data = ids.tobytes()
                blobs = pa.array([data[width * a : width * b] for a, b in zip(edge.tolist(), edge[1:].tolist())], pa.binary())
                seen = np.bincount(ids)
                if len(seen) > len(total):
                    total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
                total[: len(seen)] += seen
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(edge)), blobs, pa.nulls(len(blobs), COUNTS)], names=names)
        found = np.flatnonzero(total)
        pairs = pa.StructArray.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["id", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([b""], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pairs)], names=names)

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, counts array<struct<id:int,n:long>>")


def rank_table(tokens: DataFrame) -> list[int]:
    """Ids by descending count over all documents, ties by id.  One row per id comes back: bounded by the vocabulary."""
    counted = tokens.where("counts is not null").select(F.explode("counts").alias("c")).groupBy("c.id").agg(F.sum("c.n").alias("n"))
    return [r["id"] for r in counted.orderBy(F.desc("n"), "id").collect()]


KEY = ("doc_id", "n_tokens", "crc", "uid")
FIRST = -(1 << 63)  # the place of a null doc_id


def shard_starts(tokens: DataFrame, scratch: Scratch) -> list[tuple[int, ...]]:
    """The key of the first row of each shard, in order: a row belongs to shard i if i * SHARD_TOKENS ids or more and
    fewer than the next multiple stand before it.  Shards without a row of their own (one very long text) have no number."""
    keys = tokens.select(*KEY).repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("range", F.spark_partition_id())
    keys = scratch.table("keys", keys)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = keys.groupBy("range").agg(F.sum("n_tokens").alias("s")).select("range", F.coalesce(F.sum("s").over(earlier(Window.orderBy("range"))), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n_tokens").over(earlier(Window.partitionBy("range").orderBy(*KEY))), F.lit(0))
    placed = keys.withColumn("inside", inside).join(sums, "range").withColumn("shard", F.floor((F.col("before") + F.col("inside")) / SHARD_TOKENS))
    first = placed.groupBy("shard").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(FIRST)).alias("doc_id"), *KEY[1:])).alias("k")).orderBy("shard").select("k.*").collect()
    return [tuple(r) for r in first]


def shard_of(part: pa.RecordBatch, starts: list[tuple[int, ...]]) -> np.ndarray:
    """The number of the last shard that begins at or before each row's key."""
    ids = np.array([s[0] for s in starts], np.int64)
    doc = part.column("doc_id").fill_null(FIRST).to_numpy(zero_copy_only=False)
    low, shard = np.searchsorted(ids, doc, side="left"), np.searchsorted(ids, doc, side="right") - 1
    tied = np.flatnonzero(low <= shard)  # a shard begins with this very id: the rest of the key decides
    if len(tied):
        rest = [part.column(c).to_numpy(zero_copy_only=False)[tied].tolist() for c in KEY[1:]]
        shard[tied] = [bisect.bisect_right(starts, key) - 1 for key in zip(doc[tied].tolist(), *rest)]
    return np.maximum(shard, 0).astype(np.int32)


def write(df: DataFrame, path: str, scratch: Scratch, end_id: int = END_ID) -> str:
    """Encodes df into files below the scratch folder; the path of the files.  Text is read once."""
    spark = df.sparkSession
    tokens = scratch.table("ids", tokenize(df, path, end_id).withColumns({"crc": F.crc32("ids"), "uid": F.monotonically_increasing_id()}))
    dtype = id_type(path)
    order = rank_table(tokens)
    tokens = tokens.where("counts is null").drop("counts")
    scratch.table("ranks", spark.createDataFrame([(r, i) for r, i in enumerate(order)], "rank int, id int").coalesce(1))

    starts = shard_starts(tokens, scratch)
    shared, n_shards = spark.sparkContext.broadcast(starts), max(1, len(starts))

    table = np.zeros(max(order, default=0) + 1, np.uint32)
    table[order] = np.arange(len(order), dtype=np.uint32)

    def encode(batches):
        for batch in batches:
            count = batch.column("n_tokens").to_numpy()
            ends = np.cumsum(count)
            for group in np.split(np.arange(len(count)), np.searchsorted(ends, np.arange(BLOCK_TOKENS, int(ends[-1]) if len(ends) else 0, BLOCK_TOKENS))):
                if not len(group):
                    continue
                part = batch.slice(int(group[0]), len(group))
                n = count[group]
                control, n_control, data, n_data = pack(table[flat(part.column("ids"), dtype)], n)
                ce, de = np.concatenate([[0], np.cumsum(n_control)]).tolist(), np.concatenate([[0], np.cumsum(n_data)]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard_of(part, shared.value)), *[part.column(c) for c in KEY], pa.array([control[a:b] for a, b in zip(ce, ce[1:])], pa.binary()), pa.array([data[a:b] for a, b in zip(de, de[1:])], pa.binary())],
                    names=["shard", *KEY, "control", "data"],
                )

    def blocks(batches):
        shard, block, start, held = None, 0, 0, []

        def flush():
            nonlocal block, start, held
            n = [x[1] for x in held]
            row = [[shard], [block], [start], [[x[0] for x in held]], [n], [b"".join(x[2] for x in held)], [b"".join(x[3] for x in held)]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=["shard", "block", "start", "doc_ids", "n_tokens", "control", "data"])
            block, start, held = block + 1, start + sum(n), []
            return out

        size = 0
        for batch in batches:
            for s, d, n, c, x in zip(*(batch.column(k).to_pylist() for k in ("shard", "doc_id", "n_tokens", "control", "data"))):
                if held and (s != shard or size + n > BLOCK_TOKENS):
                    yield flush()
                    size = 0
                if s != shard:
                    shard, block, start = s, 0, 0
                held.append((d, n, c, x))
                size += n
        if held:
            yield flush()

    coded = tokens.mapInArrow(encode, "shard int, doc_id long, n_tokens long, crc long, uid long, control binary, data binary")
    placed = coded.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", *KEY)
    files = placed.mapInArrow(blocks, "shard int, block long, start long, doc_ids array<long>, n_tokens array<long>, control binary, data binary")
    scratch.table("blocks", files, "none")  # coded already: another compression gains nothing
    scratch.drop("ids", "keys")
    return scratch.root


def read(spark, root: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian, 4 bytes each) from the files, in no order."""
    ids = [r["id"] for r in spark.read.parquet(f"{root}/ranks").orderBy("rank").collect()]  # bounded by the vocabulary
    blocks = spark.read.parquet(f"{root}/blocks")
    table = np.array(ids or [0], np.uint32)
    shards = blocks.select("shard", F.expr("aggregate(n_tokens, 0L, (a, n) -> a + n)").alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    with_start = blocks.join(shards.select("shard", before.alias("before")), "shard").withColumn("start", F.col("start") + F.col("before"))

    def decode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i] for k in ("doc_ids", "n_tokens", "control", "data", "start")}
                count = row["n_tokens"].values.to_numpy(zero_copy_only=False)
                found = table[unpack(row["control"].as_py(), row["data"].as_py(), count)]
                ends = np.cumsum(count)
                data, edge = found.astype("<u4").tobytes(), np.concatenate([[0], ends]).tolist()
                blobs = pa.array([data[4 * a : 4 * b] for a, b in zip(edge, edge[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array(row["start"].as_py() + ends - count), pa.array(count), blobs], names=["doc_id", "start", "n_tokens", "ids"])

    return with_start.select("doc_ids", "n_tokens", "control", "data", "start").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def checksums(decoded: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of read(); the checksum is a built-in function."""
    return decoded.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
