"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of word characters, lower-cased. An overlap of ``overlap`` tokens (or the whole item, if shorter) with at
least ``share`` of them equal is a leak. Masks choose some positions of a window of tokens and ignore the others, so a
hash of the chosen tokens still meets its twin when ignored tokens were substituted. The masks of an item follow from the
tokens it needs and the substitutions the threshold admits: :func:`masks` adds masks until every admitted pattern is hit,
so no leak is missed; where no substitution is admitted, the mask is the whole sequence. Every window of every
document is hashed with every mask in use and looked up in the benchmark's sorted hashes; around each hit the document
and the item are compared token by token along that diagonal.

The benchmark is the query set: it is taken in blocks of about ``block_tokens`` tokens, two at most, whose index (about 16 bytes a
token and mask) is broadcast, and each block is held against all documents. However large the benchmark, memory stays bounded: an item
longer than a block is taken in pieces, and :func:`leaks` gives a row for each piece that leaks.

Cases: null texts have no tokens; items with under ``least`` tokens are not searched (the queries search all, with ``least=1``); repeated
documents and items are each reported; an empty table on either side gives no leaks; extra columns are ignored by
:func:`leaks` and kept by :func:`remove`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ._common import map_batches, settle, small_batches

#: At most so many masks for one length; where more would be needed, a lower weight is taken.
MOST_MASKS = 8
#: Longer windows are covered by runs of tokens, for their masks are too many to search.
LONGEST = 14
#: Documents are searched together up to so many tokens.
_TOGETHER = 400_000
_CELLS = 2_000_000
_TOKEN = re.compile(r"\w+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


class Tokens(dict):
    def __missing__(self, token: str) -> int:
        value = self[token] = xxhash.xxh3_64_intdigest(token)
        return value

    def of(self, text: str | None) -> np.ndarray:
        if len(self) > 200_000:
            self.clear()
        found = _TOKEN.findall(text.lower()) if text else []
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


@lru_cache(maxsize=64)
def masks(need: int, wrong: int) -> tuple[tuple[int, ...], ...]:
    """Masks of the greatest weight of which some placement in ``need`` tokens avoids any ``wrong`` of them."""
    if wrong <= 0:
        return (tuple(range(need)),)
    run = max(1, -(-(need - wrong) // (wrong + 1)))  # of wrong + 1 gaps that hold need - wrong tokens, one has so many
    if need <= LONGEST:
        patterns = [sum(1 << p for p in c) for c in combinations(range(need), wrong)]
        for weight in range(need - wrong, run, -1):
            hits = {}
            for rest in combinations(range(1, need), weight - 1):
                placed = [sum(1 << p + k for p in (0, *rest)) for k in range(need - (rest[-1] if rest else 0))]
                hits[(0, *rest)] = {k for k, x in enumerate(patterns) if any(not x & y for y in placed)}
            left, found = set(range(len(patterns))), []
            while left and len(found) < MOST_MASKS:
                found.append(max(hits, key=lambda m: (len(hits[m] & left), m)))
                left -= hits[found[-1]]
            if not left:
                return tuple(found)
    return (tuple(range(run)),)


def seeds(tokens: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The hash of every window, by the tokens that the mask chooses."""
    n = max(len(tokens) - mask[-1], 0)
    h = np.full(n, np.uint64(sum(1 << p for p in mask) % (1 << 61)), np.uint64)
    for offset in mask if n else ():
        h ^= tokens[offset : offset + n]
        h *= _FACTOR
        h ^= h >> np.uint64(29)
    return h


class Index:
    """The seeds of some items by mask, each sorted by hash."""

    def __init__(self, items: list[tuple[object, np.ndarray]], overlap: int, share: float):
        self.keys = [k for k, _ in items]
        self.size = np.array([len(t) for _, t in items], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.tokens = np.concatenate([np.empty(0, np.uint64), *[t for _, t in items]])
        self.need = np.minimum(self.size, overlap)
        self.least = np.ceil(share * self.need).astype(np.int64)
        by: dict[tuple[int, ...], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k, (_, tokens) in enumerate(items):
            for mask in masks(int(self.need[k]), int(self.need[k] - self.least[k])):
                h = seeds(tokens, mask)
                by.setdefault(mask, []).append((h, np.full(len(h), k, np.int32), np.arange(len(h), dtype=np.int32)))
        self.seeds = {}
        for mask, parts in by.items():
            hashes, item, offset = map(np.concatenate, zip(*parts))
            order = np.argsort(hashes, kind="stable")
            seen = np.zeros(1 << _BITS, bool)
            seen[hashes >> np.uint64(64 - _BITS)] = True
            self.seeds[mask] = hashes[order], item[order], offset[order], np.packbits(seen)

    def leaks(self, texts: list[np.ndarray]) -> list[list[tuple[object, int, int, int]]]:
        """For each text (item, first token, tokens, equal tokens) of the best overlap with each item that leaks into it."""
        out, at = [], 0
        while at < len(texts):
            stop, size = at + 1, len(texts[at])
            while stop < len(texts) and size + len(texts[stop]) <= _TOGETHER:
                size += len(texts[stop])
                stop += 1
            out += self._leaks(texts[at:stop])
            at = stop
        return out

    def _diagonals(self, tokens: np.ndarray, size: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text, item, shift of every distinct diagonal that some seed hits."""
        wide, longest, found = int(size.max()) + int(self.size.max()) + 1, int(self.size.max()), [np.empty(0, np.int64)]
        for mask, (hashes, item, offset, seen) in self.seeds.items():
            h, bits = seeds(tokens, mask), np.unpackbits(seen).view(bool)
            at = np.flatnonzero(bits[h >> np.uint64(64 - _BITS)])
            low, high = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            at, low, high = at[low < high], low[low < high], high[low < high]
            text = np.searchsorted(start, at, "right") - 1
            inside = at + mask[-1] < start[text] + size[text]
            at, low, n, text = at[inside], low[inside], (high - low)[inside], text[inside]
            ends, step = np.cumsum(n), 0
            while step < len(at):  # a common seed meets many items
                stop = max(step + 1, int(np.searchsorted(ends, (ends[step - 1] if step else 0) + _CELLS, "right")))
                part = slice(step, stop)
                m = n[part]
                entry = np.repeat(low[part] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                shift = np.repeat(at[part] - start[text[part]], m) - offset[entry]
                found.append(np.unique((np.repeat(text[part], m) * len(self.size) + item[entry]) * wide + shift + longest))
                step = stop
        key = np.unique(np.concatenate(found))
        return key // wide // len(self.size), key // wide % len(self.size), key % wide - longest

    def _leaks(self, texts: list[np.ndarray]) -> list[list[tuple[object, int, int, int]]]:
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        size = np.array([len(t) for t in texts], np.int64)
        start, tokens = np.cumsum(size) - size, np.concatenate([np.empty(0, np.uint64), *texts])
        if len(tokens) and self.seeds:
            full = np.flatnonzero(size)  # empty texts have no place of their own
            text, item, shift = self._diagonals(tokens, size[full], start[full])
            text = full[text]
            first, last = np.maximum(0, -shift), np.minimum(self.size[item], size[text] - shift)
            enough = last - first >= self.need[item]
            text, item, shift, first, n = (x[enough] for x in (text, item, shift, first, last - first))
            ends, at = np.cumsum(n), 0
            while at < len(n):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CELLS, "right")))
                part = slice(at, stop)
                m, need = n[part], self.need[item[part]]
                edge = np.cumsum(m) - m
                along = np.arange(int(m.sum())) - np.repeat(edge, m)
                equal = self.tokens[np.repeat(self.start[item[part]] + first[part], m) + along] == tokens[np.repeat(start[text[part]] + first[part] + shift[part], m) + along]
                upto = np.r_[0, np.cumsum(equal)]
                good = np.flatnonzero(along <= np.repeat(m - need, m))
                good = good[upto[good + (need_ := np.repeat(need, m))[good]] - upto[good] >= np.repeat(self.least[item[part]], m)[good]]
                which = np.searchsorted(edge, good, "right") - 1
                head = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else np.empty(0, np.int64)
                for d, a, b in zip(which[head].tolist(), good[head].tolist(), good[np.r_[head[1:], len(good)] - 1].tolist() if len(good) else []):
                    b += int(need_[b])
                    k, i = int(text[at + d]), int(item[at + d])
                    found = (int(upto[b] - upto[a]), -int(along[a] + first[at + d] + shift[at + d]), b - a)
                    best[k][i] = max(best[k].get(i, found), found)
                at = stop
        return [[(self.keys[i], -place, n, equal) for i, (equal, place, n) in sorted(x.items())] for x in best]


def pieces(tokens: np.ndarray, overlap: int, block_tokens: int) -> Iterator[np.ndarray]:
    """An item in pieces of at most a block's size that share ``overlap`` - 1 tokens with the next, so every window lies whole in one."""
    step = max(block_tokens, 2 * overlap)
    for at in range(0, max(1, len(tokens) - overlap + 1), step - overlap + 1):
        yield tokens[at : at + step]


def blocks(benchmark: DataFrame, item: str, text: str, overlap: int, share: float, least: int, block_tokens: int) -> Iterator[Index]:
    tokens, held, size = Tokens(), [], 0
    for row in benchmark.select(item, text).distinct().orderBy(item, text).toLocalIterator():
        found = tokens.of(row[1])
        if len(found) < max(least, 1):
            continue
        for part in pieces(found, overlap, block_tokens):
            held.append((row[0], part))
            size += len(part)
            if size >= block_tokens:
                yield Index(held, overlap, share)
                held, size = [], 0
    if held:
        yield Index(held, overlap, share)


def leaks(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", overlap: int = 13, share: float = 0.8, least: int = 8, block_tokens: int = 400_000) -> DataFrame:
    """key, item, first_token, n_tokens, n_equal: one row for each document and item that leaks into it."""
    names = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item}` {benchmark.schema[item].dataType.simpleString()}, first_token long, n_tokens long, n_equal long"
    out = docs.sparkSession.createDataFrame([], names)
    for index in blocks(benchmark, item, item_text, overlap, share, least, block_tokens):
        shared, tokens = docs.sparkSession.sparkContext.broadcast(index), Tokens()

        def run(batch: pa.RecordBatch, shared: object = shared, tokens: Tokens = tokens) -> Iterator[dict]:
            leaking = shared.value.leaks([tokens.of(t.as_py()) for t in batch.column(1)])
            rows = [(k.as_py(), *found) for k, of in zip(batch.column(0), leaking) for found in of]
            if rows:
                yield dict(zip((key, item, "first_token", "n_tokens", "n_equal"), zip(*rows)))

        out = out.unionByName(map_batches(docs.select(key, text), run, names, lambda tokens=tokens: settle(tokens)))
    return out


def remove(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", overlap: int = 13, share: float = 0.8, least: int = 8, block_tokens: int = 400_000) -> DataFrame:
    """The documents into which no item leaks, all columns kept. No shuffle."""
    at = docs.columns.index(text)
    small_batches(docs.sparkSession)
    for index in blocks(benchmark, item, item_text, overlap, share, least, block_tokens):
        shared, tokens = docs.sparkSession.sparkContext.broadcast(index), Tokens()

        def run(batches: Iterator[pa.RecordBatch], shared: object = shared, tokens: Tokens = tokens) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not found for found in shared.value.leaks([tokens.of(t.as_py()) for t in batch.column(at)])]
                yield batch.filter(pa.array(clean, pa.bool_()))
            settle(tokens)

        docs = docs.mapInArrow(run, docs.schema)
    return docs
