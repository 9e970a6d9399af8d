"""BPE encoding and decoding by speculation and verification.

For each distinct piece of text the longest token at every place is proposed (one numpy step walks all
pieces by a byte; the few pieces that are longer than ``STEPS`` walk the same trie one by one).  A proposal is the true encoding exactly if each adjacent pair of tokens is: merging the bytes of
the pair alone gives the pair back.  Pairs are checked together, as arrays, by taking both sides apart from the last
merge to the first and looking for a merge across the border that would have come earlier.  Only pieces with a bad
pair are merged exactly, lowest rank and leftmost first.

Nulls encode as empty texts (no ids), empty texts decode to empty texts, any length is taken in whole, repeated
rows are encoded alike, an empty table gives an empty result, other columns of the input are left out or kept as the
caller says.  Memory is bound by slices of about 2 MB of text, by one text, and by the units that a worker keeps, which have a
limit in number and in bytes.
"""
from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import pick, small_batches
from .units import UnitEncoder, ranges, slices, worker_cache

# Fixed value: the pattern that splits text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = np.int64(1) << 40
STEPS = 64  # bytes that pieces walk side by side; padded merging ends there too, longer pieces are merged with a heap


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and the trie of a byte-level BPE file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        self.split = regex.compile(PATTERN).findall
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        n = max([*vocab.values(), *special.values()]) + 1
        self.n = n
        texts: list[bytes] = [b""] * n
        for t, i in vocab.items():
            texts[i] = bytes(letters[c] for c in t)
        for t, i in special.items():
            texts[i] = t.encode()
        self.blob = np.frombuffer(b"".join(texts), np.uint8)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]

        self.birth, self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        keys, made = [], []
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            new = vocab[a + b]
            keys.append(vocab[a] * n + vocab[b])
            made.append(new)
            if self.birth[new] < 0:
                self.birth[new], self.left[new], self.right[new] = rank, vocab[a], vocab[b]
        order = np.argsort(keys)
        self.merge_key, self.merge_rank = np.append(np.array(keys, np.int64)[order], -1), np.append(order.astype(np.int64), NEVER)
        self.merge_new = np.append(np.array(made, np.int64)[order], -1)
        self.rank_of = dict(zip(keys, range(len(keys))))
        self.new_of = dict(zip(keys, made))

        merged = np.flatnonzero(self.birth >= 0)
        usable = np.zeros(n, bool)
        usable[self.byte_id] = True
        usable[merged] = ~self.crossed(self.left[merged], self.right[merged], self.birth[merged])
        for t in merged[np.argsort(self.birth[merged])]:
            usable[t] &= usable[self.left[t]] and usable[self.right[t]]
        self._build_trie(texts, np.flatnonzero(usable))
        digits = [f"{i},".encode() for i in range(n)]
        width = max(map(len, digits))
        self.digits = np.frombuffer(b"".join(d.ljust(width) for d in digits), np.uint8).reshape(n, width)
        self.digit_size = np.array([len(d) for d in digits])

    def _build_trie(self, texts: list[bytes], tokens: np.ndarray) -> None:
        step: dict[int, int] = {}
        token_at = [-1]
        for t in tokens.tolist():
            state = 0
            for b in texts[t]:
                key = state << 8 | b
                if key not in step:
                    step[key] = len(token_at)
                    token_at.append(-1)
                state = step[key]
            token_at[state] = t
        self.step = step
        keys = np.array(list(step), np.int64)
        order = np.argsort(keys)
        self.step_key = np.append(keys[order], np.int64(-1))
        self.step_to = np.append(np.array(list(step.values()), np.int64)[order], 0)
        self.token_at = np.array(token_at, np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a * self.n + b
        j = np.searchsorted(self.merge_key[:-1], key)
        j[self.merge_key[j] != key] = len(self.merge_key) - 1
        return self.merge_rank[j], self.merge_new[j]

    def crossed(self, a: np.ndarray, b: np.ndarray, end: np.ndarray | np.int64 = NEVER) -> np.ndarray:
        """Whether merging the bytes of a and b joins something across their border before rank `end`."""
        x, y = a.copy(), b.copy()
        gone_x, gone_y = np.full(len(a), end, np.int64), np.full(len(a), end, np.int64)
        bad, live = np.zeros(len(a), bool), np.arange(len(a))
        while len(live):
            r, _ = self.rank(x[live], y[live])
            hit = (r < gone_x[live]) & (r <= gone_y[live]) & (r < NEVER)
            hit &= r < np.broadcast_to(end, len(a))[live]
            bad[live[hit]] = True
            bx, by = self.birth[x[live]], self.birth[y[live]]
            live, bx, by = (v[~hit & ((bx >= 0) | (by >= 0))] for v in (live, bx, by))
            last_x = bx > by
            i, k = live[last_x], live[~last_x]
            gone_x[i], x[i] = bx[last_x], self.right[x[i]]
            gone_y[k], y[k] = by[~last_x], self.left[y[k]]
        return bad

    def propose(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest-match tokens of all pieces: (piece, token), in order within each piece."""
        at, state, best, best_end = start.copy(), np.zeros_like(start), np.full_like(start, -1), start.copy()
        live, pieces, tokens = np.flatnonzero(end > start), [], []
        while len(live):
            p = at[live]
            key = state[live] << 8 | buf[np.minimum(p, len(buf) - 1)]
            j = np.searchsorted(self.step_key[:-1], key)
            hit = (p < end[live]) & (self.step_key[j] == key)
            go = live[hit]
            state[go] = self.step_to[j[hit]]
            at[go] += 1
            token = self.token_at[state[go]]
            ends = token >= 0
            best[go[ends]], best_end[go[ends]] = token[ends], at[go[ends]]
            stop = live[~hit]
            pieces.append(stop)
            tokens.append(best[stop])
            at[stop], state[stop], best[stop] = best_end[stop], 0, -1
            live = live[~((at[live] >= end[live]) & (best[live] < 0))]
        piece = np.concatenate(pieces) if pieces else np.empty(0, np.int64)
        token = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
        order = np.argsort(piece, kind="stable")
        return piece[order], token[order]

    def propose_one(self, piece: bytes) -> list[int]:
        """Longest-match tokens of one piece, as propose() gives them."""
        step, token_at, out, at = self.step, self.token_at, [], 0
        while at < len(piece):
            state, i, best, end = 0, at, -1, at
            while i < len(piece) and (state := step.get(state << 8 | piece[i], -1)) >= 0:
                i += 1
                if token_at[state] >= 0:
                    best, end = int(token_at[state]), i
            out.append(best)
            at = end
        return out

    def merge_short(self, ids: np.ndarray) -> np.ndarray:
        """Exact merging of many pieces at once; rows padded with -1."""
        ids = ids.copy()
        todo, cols = np.arange(len(ids)), np.arange(ids.shape[1] - 1)
        while len(todo) and ids.shape[1] > 1:
            t = ids[todo]
            r, new = self.rank(t[:, :-1].ravel(), t[:, 1:].ravel())
            r = np.where((t[:, :-1] >= 0) & (t[:, 1:] >= 0), r.reshape(len(t), -1), NEVER)
            j = r.argmin(axis=1)
            rows = np.flatnonzero(r[np.arange(len(t)), j] < NEVER)
            if not len(rows):
                break
            todo, t, j = todo[rows], t[rows], j[rows]
            merged = new.reshape(len(r), -1)[rows, j]
            shifted = np.where(cols[None, :] > j[:, None], t[:, 1:], t[:, :-1])
            shifted[np.arange(len(t)), j] = merged
            t[:, :-1], t[:, -1] = shifted, -1
            ids[todo] = t
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """Exact merging of one long piece with a heap and a linked list."""
        n, rank_of = self.n, self.rank_of
        nxt, prev, dead = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)], bytearray(len(ids))
        heap = [(rank_of[k], i, k) for i, k in enumerate(a * n + b for a, b in zip(ids, ids[1:])) if k in rank_of]
        heapq.heapify(heap)
        while heap:
            _, i, key = heapq.heappop(heap)
            k = nxt[i]
            if dead[i] or k < 0 or ids[i] * n + ids[k] != key:
                continue
            ids[i], dead[k], nxt[i] = self.new_of[key], 1, nxt[k]
            if nxt[i] >= 0:
                prev[nxt[i]] = i
            for a, b in ((prev[i], i), (i, nxt[i])):
                if a >= 0 and b >= 0 and (key := ids[a] * n + ids[b]) in rank_of:
                    heapq.heappush(heap, (rank_of[key], a, key))
        return [t for i, t in enumerate(ids) if not dead[i]]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of distinct pieces, and the count of each."""
        raw = [p.encode() for p in pieces]
        size = np.array([len(r) for r in raw], np.int64)
        buf, end = np.frombuffer(b"".join(raw) or b"\0", np.uint8), np.cumsum(size)
        start = end - size
        long = np.flatnonzero(size > STEPS)
        stop = end.copy()
        stop[long] = start[long]
        piece, token = self.propose(buf, start, stop)
        if len(long):
            more = [self.propose_one(raw[g]) for g in long.tolist()]
            piece = np.concatenate([piece, np.repeat(long, [len(m) for m in more])])
            token = np.concatenate([token, np.array([t for m in more for t in m], np.int64)])
        pair = np.flatnonzero(piece[1:] == piece[:-1])
        key, which = np.unique(token[pair] * self.n + token[pair + 1], return_inverse=True)
        failed = np.unique(piece[pair[self.crossed(key // self.n, key % self.n)[which]]])

        # failed pieces: exact merging, padded in groups of like length
        parts_piece, parts_token = [], []
        keep = np.ones(len(pieces), bool)
        keep[failed] = False
        kept = keep[piece]
        parts_piece.append(piece[kept])
        parts_token.append(token[kept])
        for low, high in ((0, 8), (8, 16), (16, 32), (32, STEPS)):
            g = failed[(size[failed] > low) & (size[failed] <= high)]
            if len(g):
                width = int(size[g].max())
                cell = np.arange(width)[None, :] < size[g][:, None]
                ids = np.full((len(g), width), -1, np.int64)
                ids[cell] = self.byte_id[buf[ranges(start[g], size[g])]]
                ids = self.merge_short(ids)
                parts_piece.append(np.repeat(g, (ids >= 0).sum(axis=1)))
                parts_token.append(ids[ids >= 0])
        for g in failed[size[failed] > STEPS].tolist():
            ids = self.merge_long(self.byte_id[buf[start[g] : end[g]]].tolist())
            parts_piece.append(np.full(len(ids), g))
            parts_token.append(np.array(ids, np.int64))
        piece, token = np.concatenate(parts_piece), np.concatenate(parts_token)
        order = np.argsort(piece, kind="stable")
        return token[order].astype(np.uint32), np.bincount(piece, minlength=len(pieces)).astype(np.int64)

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        number: dict[str, int] = {}
        rows = []
        for u in units:
            if self.cut_special is not None and self.cut_special.search(u):
                row = [x for i, part in enumerate(self.cut_special.split(u)) for x in ([part] if i % 2 else self.split(part))]
                rows.append([-1 - self.special[x] if x in self.special else number.setdefault(x, len(number)) for x in row])
            else:
                rows.append([number.setdefault(x, len(number)) for x in self.split(u)])
        count = np.fromiter(map(len, rows), np.int64, len(rows))
        index = np.fromiter((x for r in rows for x in r), np.int64, int(count.sum()))
        ids, size = self.encode_pieces(list(number))
        special = np.unique(-1 - index[index < 0])
        start = np.concatenate([np.cumsum(size) - size, len(ids) + np.arange(len(special))])
        ids, size = np.concatenate([ids, special.astype(np.uint32)]), np.concatenate([size, np.ones(len(special), np.int64)])
        index = np.where(index < 0, len(number) + np.searchsorted(special, -1 - index), index)
        n_ids = size[index]
        ends = np.concatenate([[0], np.cumsum(n_ids)])
        edge = np.concatenate([[0], np.cumsum(count)])
        return ids[ranges(start[index], n_ids)], ends[edge[1:]] - ends[edge[:-1]]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The text of each run of ids, in UTF-8; bytes that are no UTF-8 become the replacement character."""
        size = self.size[ids]
        data = self.blob[ranges(self.start[ids], size)].tobytes()
        edge = np.concatenate([[0], np.cumsum(size)])[offsets].tolist()
        out = []
        for a, b in zip(edge, edge[1:]):
            part = data[a:b]
            try:
                part.decode()
            except UnicodeDecodeError:
                part = part.decode(errors="replace").encode()
            out.append(part)
        return out

    def decimal(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each run in decimal, joined by commas."""
        size = self.digit_size[ids]
        data = self.digits[ids][np.arange(self.digits.shape[1])[None, :] < size[:, None]].tobytes()
        edge = np.concatenate([[0], np.cumsum(size)])[offsets].tolist()
        return [data[a : max(a, b - 1)] for a, b in zip(edge, edge[1:])]


def codec(path: str) -> tuple[Vocabulary, UnitEncoder]:
    cache = worker_cache()
    if ("bpe", path) not in cache:
        vocabulary = Vocabulary(path)
        cache["bpe", path] = vocabulary, UnitEncoder(vocabulary.encode_units, limit=150_000, recent=1)
    return cache["bpe", path]


def _ids_array(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(df: DataFrame, path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """df with the ids of a text column; all other columns are kept, an older column of that name is replaced."""
    kept = df.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches):
        _, encoder = codec(path)
        for batch in batches:
            for part in slices(batch, text, 2_000_000):
                yield pa.RecordBatch.from_arrays([*part.columns, _ids_array(*encoder(part.column(text)))], names=[*part.schema.names, out])

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with the text of a column of ids."""
    kept = df.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        vocabulary, _ = codec(path)
        for batch in batches:
            lists = pa.array([x or [] for x in batch.column(ids).to_pylist()], pa.list_(pa.int32()))
            texts = vocabulary.decode(lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t.decode() for t in texts], pa.string())], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, token_ids: encoding and decoding in one pass."""
    rows = small_batches(pick(df, doc_id="long", text="string"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids

    def run(batches):
        vocabulary, encoder = codec(path)
        sha = lambda runs: pa.array([hashlib.sha256(x).hexdigest() for x in runs], pa.string())
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                ids, offsets = encoder(part.column("text"))
                columns = [part.column("doc_id"), pa.array(np.diff(offsets)), sha(vocabulary.decimal(ids, offsets)), sha(vocabulary.decode(ids, offsets))]
                columns += [_ids_array(ids, offsets)] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"][: len(columns)])

    return rows.mapInArrow(run, schema)
