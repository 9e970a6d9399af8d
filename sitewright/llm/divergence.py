"""How far the sources of a language diverge in the terms they use.

Terms are runs of letters and of characters beyond ASCII, A to Z in lower case.  A language keeps its terms of at least
``MIN_DOCS`` documents, V of them.  A group (language and source) gives a kept term the price p = 1 + floor(SCALE * (count + 1) / (N + V)),
N its count of all kept terms; so does the language as a whole.  The divergence of p from q is floor((p - q)^2 / q), in whole numbers.

``pair``: for each group every other source of its language, with the sum of divergences over all kept terms.  ``term``: a group's terms
above the language's price, the greatest ``TOP`` of them.

Counts are made in one pass: a task adds up (group, term) over slices of its documents of a bounded size.  Kept terms are dealt by
hash into strips of about ``CELLS`` non-zero counts, so no term, source or language is a hot group: a term has at most one count a
group.  A strip's matrix of groups and terms is a k2-tree (k = 2), level by level the children of the quadrants that are not zero.  Pairs of
groups go down the tree together; quadrants empty for both are left at once and priced at (number of terms) x (the divergence of the two
prices of count 0), the leaves by their counts.  Pairs are added up over strips; a task keeps sums for ``ROWS`` x ``ROWS`` groups at a time.

Null text, lang and source are empty; a group without terms has its pairs, and with V = 0 they are 0; texts of any length are taken whole;
repeated rows count each; ties are ordered by the item's bytes; other columns are left out, whatever their names; an empty table gives an
empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pick, small_batches
from .units import slices

SCALE, MIN_DOCS, TOP = 1_000_000_000, 3, 200
CELLS, ROWS, FRONTIER = 200_000, 256, 500_000
_TERM = bytes(c if c >= 0x80 or chr(c).isalpha() else 32 for c in range(256)).lower()


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, one after another, and the text of each."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    data, ends = np.frombuffer(_TERM, np.uint8)[data], ends - ends[0]
    inside = data != 32
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = ends[(ends > 0) & (ends < len(data))]  # a term ends with its text
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    begin = np.flatnonzero(first)
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - begin)])
    found = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return found, np.searchsorted(ends, begin, side="right") - 1


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and its length."""
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(sorted_keys)), bool), sorted_keys[1:] != sorted_keys[:-1]]))
    return begin, np.diff(np.append(begin, len(sorted_keys)))


def term_counts(docs: DataFrame, most: int = 16_000_000) -> DataFrame:
    """lang, source, term, n, docs added up within slices of about `most` bytes of text; a row with a null term tells of a group."""
    rows = pick(docs, text="string", lang="string", source="string")
    rows = small_batches(rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", most):
                lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
                n_sources = len(source.dictionary)
                group = lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy()
                terms, doc = terms_of(part.column("text"))
                terms = terms.dictionary_encode()
                v = max(1, len(terms.dictionary))
                own = np.sort(doc * v + terms.indices.to_numpy())  # (text, term), then (group, term)
                begin, n = runs(own)
                cell = group[own[begin] // v] * v + own[begin] % v
                order = np.argsort(cell, kind="stable")
                begin, n_docs = runs(cell[order])
                cell, n = cell[order][begin], np.add.reduceat(n[order], begin) if len(begin) else n
                seen = np.unique(group)
                of = np.concatenate([seen, cell // v])
                term = pa.concat_arrays([pa.nulls(len(seen), pa.string()), terms.dictionary.take(pa.array(cell % v)).cast(pa.string())])
                counts = [pa.array(np.concatenate([np.zeros(len(seen), np.int64), x])) for x in (n, n_docs)]
                columns = [lang.dictionary.take(pa.array(of // n_sources)), source.dictionary.take(pa.array(of % n_sources)), term, *counts]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def matrix(docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS, cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """Non-zero counts of kept terms (lang, source, term, n, whole: the language's count) with their strip, and the groups (lang, source,
    total, whole_total, vocabulary) once for each strip of their language.  Both are written tables."""
    found = scratch.table("found", term_counts(docs))
    # dealt by (lang, term) once: the sums and the window below both keep that partitioning
    counts = found.where("term is not null").repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")  # at most one row a group
    counts = counts.select("lang", "source", "term", "n", F.sum("n").over(term).alias("whole"), F.sum("docs").over(term).alias("docs"), F.row_number().over(term.orderBy("source")).alias("k"))
    kept = scratch.table("kept", counts.where(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "whole", (F.col("k") == 1).cast("int").alias("leads")))

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("cells"), F.sum("leads").alias("leads"))
    groups = found.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").fillna(0, ["total", "cells", "leads"])
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("whole_total"), F.sum("leads").alias("vocabulary"), F.greatest(F.lit(1), F.ceil(F.sum("cells") / cells)).cast("int").alias("strips"))
    of_lang = scratch.table("langs", of_lang)
    groups = groups.select("lang", "source", "total").join(of_lang, "lang")
    groups = scratch.table("groups", groups.select("lang", "source", "total", "whole_total", "vocabulary", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("strip")))
    strip = F.pmod(F.xxhash64("term"), F.col("strips")).cast("int")
    return kept.join(of_lang, "lang").select("lang", strip.alias("strip"), "source", "term", "n", "whole"), groups


def price(count: np.ndarray, total: np.ndarray, vocabulary: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + vocabulary)); counts too large for that product go by whole numbers of any size."""
    if len(count) and int(count.max()) + 1 > (1 << 62) // SCALE:
        return np.array([1 + SCALE * (c + 1) // (t + vocabulary) for c, t in zip(count.tolist(), total.tolist())], np.int64)
    return 1 + SCALE * (count + 1) // (total + vocabulary)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q  # prices are at most 1 + SCALE, so squares fit


class K2Tree:
    """Non-zero cells of a matrix; ``children[l][node]`` are the quadrants (upper left, upper right, lower left, lower right) of a node of side
    2^(l+1), -1 where all is zero.  Nodes of side 1 are the cells, in the order of ``cell``."""

    def __init__(self, row: np.ndarray, col: np.ndarray, n_rows: int, n_cols: int):
        self.depth = max(1, max(n_rows, n_cols) - 1).bit_length()
        order = np.lexsort([col, row])
        self.cell, self.children = order, []
        r, c = row[order].astype(np.int64), col[order].astype(np.int64)
        for _ in range(self.depth):
            quadrant, r2, c2 = 2 * (r & 1) + (c & 1), r >> 1, c >> 1
            code, parent = np.unique(r2 << 32 | c2, return_inverse=True)
            below = np.full((len(code), 4), -1, np.int64)
            below[parent, quadrant] = np.arange(len(r))
            self.children.append(below)
            r, c = code >> 32, code & 0xFFFFFFFF

    def joint_leaves(self, n_rows: int, block: tuple[int, int], side: int, most: int = FRONTIER) -> Iterator[tuple[np.ndarray, ...]]:
        """(g, h, cell of g or -1, cell of h or -1) for all rows g < h, g in the first row block and h in the second (block i holds the rows from
        i * side; side is a power of two), and all columns where one of the two is not zero."""
        if not len(self.cell):
            return
        width = side.bit_length() - 1
        zero = np.zeros(1, np.int64)
        todo = [(self.depth, zero, zero, zero, zero)]  # level, row blocks and nodes of both
        while todo:
            level, i, j, a, b = todo.pop()
            if level == 0:
                low = i < j
                yield i[low], j[low], np.where(a >= 0, self.cell[a], -1)[low], np.where(b >= 0, self.cell[b], -1)[low]
                continue
            if len(i) > most:
                half = len(i) // 2
                todo += [(level, *(x[:half] for x in (i, j, a, b))), (level, *(x[half:] for x in (i, j, a, b)))]
                continue
            below, parts = self.children[level - 1], []
            shift = width - (level - 1)
            within = lambda x, k: x >> shift == k if shift >= 0 else x == k >> -shift
            for upper in (0, 1):
                for lower in (0, 1):
                    x, y = 2 * i + upper, 2 * j + lower
                    real = (x <= y) & (y << (level - 1) < n_rows) & within(x, block[0]) & within(y, block[1])
                    for right in (0, 1):
                        na = np.where(a >= 0, below[a, 2 * upper + right], -1)
                        nb = np.where(b >= 0, below[b, 2 * lower + right], -1)
                        on = real & ((na >= 0) | (nb >= 0))  # all-zero quadrants end here
                        parts.append((x[on], y[on], na[on], nb[on]))
            todo.append((level - 1, *(np.concatenate(p) for p in zip(*parts))))


SUMS = "lang string, source string, part string, item string, value long"


def strip_sums(cells: pa.Table, groups: pa.Table, top: int = TOP, side: int = ROWS) -> Iterator[pa.RecordBatch]:
    """A strip's share of each pair's sum, and each group's greatest terms in it."""
    names = groups.column("source").to_pylist()
    lang, vocabulary = groups.column("lang")[0], int(groups.column("vocabulary")[0].as_py())
    total = groups.column("total").to_numpy()

    def batch(source, part, item, value):
        columns = [pa.array([lang.as_py()] * len(value), pa.string()), source, pa.array([part] * len(value), pa.string()), item, pa.array(value, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "part", "item", "value"])

    row, col = np.empty(0, np.int64), np.empty(0, np.int64)
    n = own = row
    n_terms = 0
    if cells.num_rows:
        number = {s: k for k, s in enumerate(names)}
        row = np.array([number[s] for s in cells.column("source").to_pylist()], np.int64)
        coded = cells.column("term").combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        col, n_terms = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        n = cells.column("n").to_numpy()
        own = price(n, total[row], vocabulary)
        whole = price(cells.column("whole").to_numpy(), np.full(len(row), groups.column("whole_total")[0].as_py()), vocabulary)

        value, by_bytes = divergence(own, whole), np.empty(n_terms, np.int64)
        by_bytes[np.array(sorted(range(n_terms), key=coded.dictionary.cast(pa.binary()).to_pylist().__getitem__), np.int64)] = np.arange(n_terms)
        above = np.flatnonzero(own > whole)
        above = above[np.lexsort([by_bytes[col[above]], -value[above], row[above]])]
        first = np.searchsorted(row[above], row[above])
        above = above[np.arange(len(above)) - first < top]
        if len(above):
            yield batch(pa.array([names[k] for k in row[above].tolist()], pa.string()), "term", coded.dictionary.take(pa.array(col[above])), value[above])

    zero = price(np.zeros(len(names), np.int64), total, vocabulary) if vocabulary else None
    tree = K2Tree(row, col, len(names), n_terms)
    blocks = range(-(-len(names) // side))
    for i, j in [(i, j) for i in blocks for j in blocks if i <= j]:
        up, down = np.arange(i * side, min(len(names), (i + 1) * side)), np.arange(j * side, min(len(names), (j + 1) * side))
        there, back = np.zeros((len(up), len(down)), np.int64), np.zeros((len(up), len(down)), np.int64)
        if vocabulary:
            seen = np.zeros((len(up), len(down)), np.int64)
            for g, h, a, b in tree.joint_leaves(len(names), (i, j), side):
                p, q = np.where(a >= 0, own[a], zero[g]), np.where(b >= 0, own[b], zero[h])
                at = (g - i * side, h - j * side)
                np.add.at(there, at, divergence(p, q))
                np.add.at(back, at, divergence(q, p))
                np.add.at(seen, at, 1)
            p, q = zero[up][:, None], zero[down][None, :]
            there, back = there + (n_terms - seen) * divergence(p, q), back + (n_terms - seen) * divergence(q, p)
        g, h = (x.ravel() for x in np.meshgrid(up, down, indexing="ij"))
        keep = np.flatnonzero(g < h)
        left, right = (pa.array([names[k] for k in x[keep].tolist()], pa.string()) for x in (g, h))
        yield batch(left, "pair", right, there.ravel()[keep])
        yield batch(right, "pair", left, back.ravel()[keep])


def source_divergence(docs: DataFrame, scratch: Scratch | None = None, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank."""
    scratch = scratch or Scratch(docs.sparkSession, "divergence")
    counted, groups = matrix(docs, scratch, cells=cells)

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        batches = list(strip_sums(left, right))
        return pa.Table.from_batches(batches) if batches else _nothing()

    sums = counted.groupBy("lang", "strip").cogroup(groups.groupBy("lang", "strip")).applyInArrow(one, SUMS)
    sums = scratch.table("sums", sums)
    pairs = sums.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(sums.where("part = 'term'")).where(F.col("rank") <= TOP))


def _nothing() -> pa.Table:
    return pa.table({c: pa.array([], t) for c, t in zip(["lang", "source", "part", "item", "value"], [*[pa.string()] * 4, pa.int64()])})
