"""Packing into sequences of fixed length: concatenate and cut.

Documents are laid end to end and the line is cut every ``LENGTH`` ids.  Where a document lies on the line takes two passes of
prefix sums: each task numbers the ids of its own documents, and the totals of tasks, one number a task, are added up to
the offset of each.  The ids themselves never move: a document is cut where its own place on the line says.

A document inside one window is one record; a document that crosses a boundary has a record for each window it touches.  Only
the last window of all can be short, so padding is below one sequence whatever the documents' lengths.  ``sequences`` puts the
windows together: those that one run of documents fills are made in place, and only the records at a run's two ends are shuffled.

Null texts are empty and hold the end id alone; texts of any length are taken whole; repeated rows and rows of one doc_id are
packed each; a null doc_id stays null; other columns are left out, whatever their names; an empty table gives an empty result.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pick, small_batches
from .units import library_encoder, slices

LENGTH, END_ID = 4096, 2


def encode(df: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, 4 bytes each, with the end id), run (the task), inside (ids before it in its task)."""
    rows = small_batches(pick(df, doc_id="long", text="string"))

    def run(batches):
        encoder, inside, task = library_encoder(path), 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, "text", 16_000_000):
                ids, offsets = encoder(part.column("text"))
                data = np.insert(ids.astype("<u4"), offsets[1:], end_id).tobytes()
                edge = offsets + np.arange(len(offsets))
                blobs = pa.array([data[4 * a : 4 * b] for a, b in zip(edge.tolist(), edge[1:].tolist())], pa.binary())
                columns = [part.column("doc_id"), pa.array(np.diff(edge)), blobs, pa.array(np.full(len(blobs), task)), pa.array(inside + edge[:-1])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "run", "inside"])
                inside += int(edge[-1])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, run long, inside long")


def place(encoded: DataFrame, scratch: Scratch) -> DataFrame:
    """encoded (a written table) with `begin`, the ids on the line before each document."""
    totals = encoded.groupBy("run").agg(F.sum("n_tokens").alias("n"))
    earlier = F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))  # one row a task of the first pass
    offsets = scratch.table("offsets", totals.select("run", F.coalesce(earlier, F.lit(0)).alias("before")))
    return encoded.join(offsets, "run").select("doc_id", "n_tokens", "ids", (F.col("before") + F.col("inside")).alias("begin"))


def pieces(placed: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each window that a document touches."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(batches):
        for batch in batches:
            n, begin = (batch.column(c).to_numpy() for c in ("n_tokens", "begin"))
            first, last = begin // length, (begin + n - 1) // length
            row = np.repeat(np.arange(len(n)), last - first + 1)
            window = first[row] + np.arange(len(row)) - np.searchsorted(row, row)
            low, high = np.maximum(begin[row], window * length), np.minimum((begin + n)[row], (window + 1) * length)
            start, size = low - begin[row], high - low
            blobs = [memoryview(b.as_buffer()) for b in batch.column("ids")]
            crc = [zlib.crc32(blobs[r][4 * s : 4 * (s + k)]) for r, s, k in zip(row.tolist(), start.tolist(), size.tolist())]
            columns = [batch.column("doc_id").take(pa.array(row)), *map(pa.array, (start, size)), pa.array(crc, pa.int64()), *map(pa.array, (n[row], window, low - window * length))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return small_batches(placed).select("doc_id", "n_tokens", "ids", "begin").mapInArrow(cut, ", ".join(f"{c} long" for c in names))


def sequences(placed: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens (without padding), ids (array<int>): the filled windows.  A short window is padded to `length` unless the
    number of its ids is a power of two."""
    names, types = ["sequence_id", "offset", "ids"], [pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

    def windows(batches):
        """Windows of runs of documents that follow each other; a run's ends give records of less than a window."""
        held, at = np.empty(0, np.int32), 0
        for batch in batches:
            out = []
            for n, begin, blob in zip(batch.column("n_tokens").to_pylist(), batch.column("begin").to_pylist(), batch.column("ids")):
                if at + len(held) != begin:
                    if len(held):
                        out.append((at // length, at % length, held))
                    held, at = np.empty(0, np.int32), begin
                held = np.concatenate([held, np.frombuffer(blob.as_buffer(), "<i4")])
                edge = length - at % length
                while len(held) >= edge:
                    out.append((at // length, at % length, held[:edge]))
                    held, at, edge = held[edge:], at + edge, length
            if out:
                yield batch_of(out)
        if len(held):
            yield batch_of([(at // length, at % length, held)])

    made = small_batches(placed).select("n_tokens", "begin", "ids").mapInArrow(windows, "sequence_id long, offset long, ids array<int>")
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # a window has at most `length` records
    joined = made.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    n = F.size("ids")
    short = (n < length) & (n.bitwiseAND(n - 1) != 0)
    filled = F.when(short, F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(length) - n))).otherwise(F.col("ids"))
    return joined.select("sequence_id", n.cast("long").alias("n_tokens"), filled.alias("ids"))


def pack(df: DataFrame, path: str, scratch: Scratch | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens, ids, begin for every document; the ids are written once to the shared folder."""
    scratch = scratch or Scratch(df.sparkSession, "packing")
    return place(scratch.table("ids", encode(df, path, end_id)), scratch)
