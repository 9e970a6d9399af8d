"""Texts cut into units that any byte-level tokenizer with the usual pattern encodes independently.

The pattern joins one space to what follows it, and looks ahead only inside a run of white space.  So a space
between two other characters always begins a new token: cutting before every such space changes no id.  Units repeat
a lot; each distinct one of a batch is encoded once, and arrays of ids are put together with numpy.
"""
from __future__ import annotations

import gc
import re
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space in any Unicode version, and marks that some version counts as such; next to these no cut is made.
_WS = r"\s\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
_RISKY = f"[{_WS}] | [{_WS}]".replace(r"\x1c-\x1f", r"\x{1c}-\x{1f}").replace(r"\x85\xa0", r"\x{85}\x{a0}")
_RISKY = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", _RISKY)
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_JOINED = re.compile(rf"([{_LETTERS}]+)(?=[.,!?;:\n])([.,!?;:]*)(\n?)([{_LETTERS}]*)").fullmatch
_CUT = re.compile(f"(?<=[^{_WS}])(?= [^{_WS}])")


def worker_cache() -> dict:
    """What one Python worker keeps between tasks."""
    return sys.modules.setdefault("_sitewright_worker_cache", types.ModuleType("_sitewright_worker_cache")).__dict__


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000):
    """The batch in runs of rows of about `most` bytes of text, so that memory follows bytes and not rows."""
    col = batch.column(column)
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(size) - size) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def split_units(texts: pa.Array) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """Distinct words that follow a space, other distinct units, the unit of each place (words first, then the others),
    and where each text's places begin (one more than texts)."""
    texts = pc.fill_null(texts, "")
    risky = pc.match_substring_regex(texts, _RISKY).to_numpy(zero_copy_only=False)
    parts = pc.split_pattern(texts.filter(pa.array(~risky)), " ")
    offsets = parts.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0] if len(offsets) else 0
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    number: dict[str, int] = {}
    firsts = offsets[:-1]
    index[firsts] = [len(words) + number.setdefault(words[c], len(number)) for c in index[firsts].tolist()]
    if not risky.any():
        return words, list(number), index, offsets
    odd = [[len(words) + number.setdefault(u, len(number)) for u in _CUT.split(t)] for t in texts.filter(pa.array(risky)).to_pylist()]
    lens = np.empty(len(texts), np.int64)
    lens[~risky], lens[risky] = np.diff(offsets), [len(o) for o in odd]
    begin = np.concatenate([[0], np.cumsum(lens)])
    whole = np.empty(begin[-1], np.int32)
    odd_place = np.repeat(risky, lens)
    whole[~odd_place] = index
    whole[odd_place] = [u for o in odd for u in o]
    return words, list(number), whole, begin


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... lens[0] times, then the same for the next."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 30 and (not len(starts) or int(starts.max()) < 1 << 30) else np.int64
    out = np.repeat((starts - (ends - lens)).astype(kind), lens)
    out += np.arange(total, dtype=kind)
    return out


class UnitEncoder:
    """encode_units(list of units) -> (ids, count for each unit).  Results are kept for up to about `limit` units and
    `most_ids` ids in all (a unit has at least a byte an id, so long unbroken units count by their length); then those that
    the last few calls did not use are forgotten, and all if that is not enough."""

    def __init__(self, encode_units, limit: int = 1_500_000, recent: int = 4, most_ids: int = 8_000_000):
        self.encode_units, self.limit, self.recent, self.most_ids, self.calls, self.letters = encode_units, limit, recent, most_ids, 0, 0
        self.spaced: dict[str, int] = {}  # by the word after the space
        self.whole: dict[str, int] = {}
        self.ids, self.start, self.size, self.used = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def _full(self) -> bool:
        return len(self.size) > self.limit or len(self.ids) > self.most_ids or self.letters > 8 * self.most_ids

    def _forget(self) -> None:
        keep = self.used >= self.calls - self.recent
        if len(self.ids) > self.most_ids or self.letters > 8 * self.most_ids:
            keep[:] = False
        place = np.cumsum(keep) - 1
        flags, places = keep.tolist(), place.tolist()
        self.spaced = {u: places[i] for u, i in self.spaced.items() if flags[i]}
        self.whole = {u: places[i] for u, i in self.whole.items() if flags[i]}
        self.ids = self.ids[ranges(self.start[keep], self.size[keep])]
        self.size, self.used = self.size[keep], self.used[keep]
        self.start = np.cumsum(self.size) - self.size
        self.letters = sum(map(len, self.spaced)) + sum(map(len, self.whole))

    def _store(self, spaced: list[str], whole: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        base = len(self.size)
        self.letters += sum(map(len, spaced)) + sum(map(len, whole))
        self.spaced.update(zip(spaced, range(base, base + len(spaced))))
        self.whole.update(zip(whole, range(base + len(spaced), base + len(spaced) + len(whole))))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])
        self.used = np.concatenate([self.used, np.full(len(size), self.calls, np.int32)])

    def _add(self, words: list[str], others: list[str]) -> None:
        """New units.  A word with a mark or line break after it is put together from the ids of its parts, which are
        often known: between a letter and these marks, and around a single line break, a token always ends."""
        spaced, whole = self.spaced, self.whole
        joined, plain, parts = [], {}, dict.fromkeys(others)
        for w in words:
            m = None if w.isalpha() else _JOINED(w)
            if m is None:
                plain[w] = None
            else:
                joined.append((w, m[1], [x for x in m.groups()[1:] if x]))
                if m[1] not in spaced:
                    plain[m[1]] = None
                for x in joined[-1][2]:
                    if x not in whole:
                        parts[x] = None
        self._store([*plain], [*parts], *self.encode_units([" " + w for w in plain] + [*parts]))
        joined = [j for j in joined if j[0] not in plain]
        if joined:
            slots = np.array([x for _, core, rest in joined for x in (spaced[core], *map(whole.__getitem__, rest))], np.int64)
            edge = np.cumsum([1 + len(rest) for _, _, rest in joined])
            size = self.size[slots]
            ends = np.concatenate([[0], np.cumsum(size)])
            self._store([w for w, _, _ in joined], [], self.ids[ranges(self.start[slots], size)], np.diff(ends[np.concatenate([[0], edge])]))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids begin (one more than texts)."""
        words, others, index, offsets = split_units(texts)
        self.calls += 1
        if self._full():
            self._forget()
        found = [*map(self.spaced.get, words), *map(self.whole.get, others)]
        fresh = [i for i, x in enumerate(found) if x is None]
        if fresh:
            n = len(words)
            gc.disable()  # only strings and short-lived tuples are made here; scanning them again and again finds nothing
            self._add([words[i] for i in fresh if i < n], [others[i - n] for i in fresh if i >= n])
            for i in fresh:
                found[i] = self.spaced[words[i]] if i < n else self.whole[others[i - n]]
            gc.enable()
        slots = np.array(found, np.int64)
        self.used[slots] = self.calls
        start, size = self.start[slots][index], self.size[slots][index]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.ids[ranges(start, size)], ends[offsets]


def library_encoder(path: str) -> UnitEncoder:
    """Units through the tokenizers library itself; kept for the life of the worker."""
    cache = worker_cache()
    if ("library", path) not in cache:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        special = next((t.content for t in tokenizer.get_added_tokens_decoder().values() if t.special and not (t.lstrip or t.rstrip)), None)
        mark = tokenizer.token_to_id(special) if special else None

        def one_by_one(units: list[str]) -> list[list[int]]:
            return [e.ids for e in tokenizer.encode_batch_fast(units, add_special_tokens=False)]

        def encode_units(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Units go through the library in runs, parted by a special token; it encodes what lies between such tokens
            by itself, so a unit's ids are those between two marks."""
            if special is None or any(special in u for u in units):
                rows = one_by_one(units)
                size = np.fromiter(map(len, rows), np.int64, len(rows))
                return np.fromiter((i for r in rows for i in r), np.uint32, int(size.sum())), size
            runs = [special.join(units[i : i + 500]) + special for i in range(0, len(units), 500)]
            ids = np.concatenate([np.array(r, np.uint32) for r in one_by_one(runs)])
            marks = np.flatnonzero(ids == mark)
            return ids[ids != mark], np.diff(np.concatenate([[-1], marks])) - 1

        cache["library", path] = UnitEncoder(encode_units, limit=1_000_000)
    return cache["library", path]
