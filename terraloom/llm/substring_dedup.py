"""Substring deduplication by relative Lempel-Ziv parsing of every document against the corpus.

The reference is the corpus itself. Its index lies in blocks: the 64-bit hash space of ``window``-word seeds is cut into
ranges, and each block maps the seeds of its range to their first source: the smallest document that holds the seed, and the first
position there. A document is factored greedily from left to right. A seed with a source in a smaller document opens a factor
(start, length, source document, source position); each next word extends it as long as the seed that ends with that word has the
source one word further on. Where it has another source, the factor ends, and the seed, which crosses the boundary, is checked by itself: it
opens the next factor if any smaller document holds it. So factors have at least ``window`` words, may overlap by
``window`` - 1 at a boundary, and cover just the words of repeated windows. Factors that overlap or touch are one span.

Seeds are compared by hashes, no source text travels: among n distinct seeds one is taken for another with probability n / 2^64.

Execution: documents are packed into batches that stay where they are (:mod:`batches`). A batch sends each distinct seed
once, with its own first source, to the block that owns it; so a passage that a third of all documents hold reaches its
block once a batch, not once a document. A block answers the seeds that a smaller document of any batch holds. The batch
then factors its documents.

``batch_bytes`` and ``block_windows`` bound a task's memory: about 16 bytes of Python memory a byte of batch, 60 a seed of a
block. Both grow with the square root of the input beyond the size at which a batch would send under ``row_windows`` seeds to a block.

Cases: null and empty texts have no words; a document shorter than the window keeps all its words; rows that share a
doc_id never remove one another's words; rows with a null doc_id count as larger than all others; repeated rows each
give a row; very long texts are one document of one batch; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from ._common import WordHashes, small_batches
from .batches import opened, packed_batches, planes, squeezed, unplaned, unsqueezed

WINDOW = 13
BATCH_BYTES = 8 << 20
BLOCK_WINDOWS = 2_000_000
ROW_WINDOWS = 1000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LAST = np.iinfo(np.int64).max
_SENT = pa.schema([("block", pa.int32()), ("batch", pa.int64()), ("seeds", pa.binary()), ("docs", pa.binary()), ("place", pa.binary()), ("at", pa.binary())])
_TOLD = pa.schema([("batch", pa.int64()), ("block", pa.int32()), ("bits", pa.binary()), ("docs", pa.binary()), ("place", pa.binary()), ("at", pa.binary())])

_hashes = WordHashes()


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").split() if text else []


def windows(words: list[bytes], window: int) -> np.ndarray:
    """A 64-bit hash of every window of consecutive words."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    _hashes.trim()
    each = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h *= _FACTOR
        h += each[k : n + k]
    h ^= h >> np.uint64(31)
    h *= _MIX
    return h ^ h >> np.uint64(29)


def packed(values: np.ndarray) -> bytes:
    """Sorted numbers as differences in byte planes, compressed."""
    return squeezed(planes(np.diff(values, prepend=values.dtype.type(0))), 1)


def unpacked(data: pa.Scalar, kind: type = np.uint64) -> np.ndarray:
    return np.cumsum(unplaned(unsqueezed(data), kind), dtype=kind)


def small(values: np.ndarray) -> bytes:
    return squeezed(planes(values.astype(np.uint32)), 1)


def unsmall(data: pa.Scalar) -> np.ndarray:
    return unplaned(unsqueezed(data), np.uint32).astype(np.int64)


def sources(docs: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Documents and positions, packed: distinct documents, which one each is, positions."""
    own, place = np.unique(docs, return_inverse=True)
    return packed(own), small(place), small(at)


def unsourced(docs: pa.Scalar, place: pa.Scalar, at: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    return unpacked(docs, np.int64)[unsmall(place)], unsmall(at)


class Batch:
    """The seeds of some documents, which come in order of their ids, and the distinct ones, sorted, with the first source of each."""

    def __init__(self, docs: list[tuple[int, list[bytes]]], window: int):
        each = [windows(words, window) for _, words in docs]
        self.length = [len(x) for x in each]
        self.doc = np.repeat(np.array([d for d, _ in docs], np.int64), self.length)
        at = np.concatenate([np.empty(0, np.int32), *[np.arange(n, dtype=np.int32) for n in self.length]])
        joined = np.concatenate([np.empty(0, np.uint64), *each])
        alike = len({d for d, _ in docs}) < len(docs)  # rows that share an id: their first position counts
        order = np.lexsort((at, self.doc, joined)) if alike else np.argsort(joined, kind="stable")
        ordered = joined[order]
        first = np.r_[True, ordered[1:] != ordered[:-1]] if len(joined) else np.empty(0, bool)
        self.distinct, self.least, self.at = ordered[first], self.doc[order[first]], at[order[first]]
        self.which = np.empty(len(joined), np.int64)
        self.which[order] = np.cumsum(first) - 1

    def cut(self, blocks: int) -> np.ndarray:
        """Where each block's range begins among the distinct seeds; ``blocks`` is a power of two."""
        bits = blocks.bit_length() - 1
        return np.r_[np.searchsorted(self.distinct, np.arange(blocks, dtype=np.uint64) << np.uint64(64 - bits)), len(self.distinct)]

    def sourced(self, earlier: np.ndarray, docs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every window the source document and position in a smaller document, or -1: told by the blocks for the distinct seeds that are ``earlier``, else the batch's own."""
        least, place = self.least.copy(), self.at.astype(np.int64)
        least[earlier], place[earlier] = docs, at
        found = least[self.which] < self.doc
        return np.where(found, least[self.which], -1), np.where(found, place[self.which], -1)


def ordered(rows: list[tuple[int | None, str | None]]) -> list[tuple[int | None, str | None]]:
    return sorted(rows, key=lambda x: (_LAST if x[0] is None else x[0], x[1] or ""))


def block_answer(seeds: list[np.ndarray], docs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the seeds of all batches, one after the other: is there a smaller document than the batch's own, and the first source of each seed."""
    joined = np.concatenate(seeds)
    order = np.lexsort((at, docs, joined))
    ordered_ = joined[order]
    start = np.flatnonzero(np.r_[True, ordered_[1:] != ordered_[:-1]]) if len(joined) else np.empty(0, np.int64)
    first = np.empty(len(joined), np.int64)
    first[order] = np.repeat(order[start], np.diff(np.r_[start, len(joined)]))
    return docs[first] < docs, docs[first], at[first]


def factors(doc: np.ndarray, at: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """The greedy parse of one document: (start, end, source document, source start) in words, from each window's source; -1: none."""
    if not len(doc) or at.max() < 0:
        return []
    found = at >= 0
    goes_on = np.r_[False, found[1:] & found[:-1] & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1] + 1)]
    start = np.flatnonzero(found & ~goes_on)
    last = np.flatnonzero(found & ~np.r_[goes_on[1:], False])
    return list(zip(start.tolist(), (last + window).tolist(), doc[start].tolist(), at[start].tolist()))


def merged(parse: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Spans [start, end): factors that overlap or touch are one."""
    out: list[list[int]] = []
    for start, end, *_ in parse:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, batch_bytes: int = BATCH_BYTES, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """key, n_words, n_removed, kept (the remaining words, joined by a space), spans (array of start, end in words), factors (array of start, end, source, source_start)."""

    def make(kept: bytes, found: list[tuple[int, int]], parse: list[tuple[int, int, int, int]]) -> tuple:
        return kept.decode(), [{"start": a, "end": b} for a, b in found], [dict(zip(("start", "end", "source", "source_start"), f)) for f in parse]

    more = "kept string, spans array<struct<start:int,end:int>>, factors array<struct<start:int,end:int,source:long,source_start:int>>"
    return _parse(docs, key, text, window, batch_bytes, block_windows, more, make)


def digests(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    chosen = (options.get(k, v) for k, v in (("window", WINDOW), ("batch_bytes", BATCH_BYTES), ("block_windows", BLOCK_WINDOWS)))
    return _parse(docs, "doc_id", "text", *chosen, "kept_sha256 string", lambda kept, *_: (hashlib.sha256(kept).hexdigest(),))


def _parse(docs: DataFrame, key: str, text: str, window: int, batch_bytes: int, block_windows: int, more: str, make: Callable[..., tuple]) -> DataFrame:
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    side = int((ROW_WINDOWS * size / 6) ** 0.5)  # windows of a batch and of a block at which a row holds row_windows
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    boxes, _, _ = packed_batches(rows, max(batch_bytes, 6 * side))
    blocks = 1 << max(5, (size // 6 // max(block_windows, side)).bit_length())

    def read(own: pa.Table) -> list[tuple[int | None, str | None]]:
        return ordered([pair for part in opened(own) for pair in zip(part["doc"].to_pylist(), part["text"].to_pylist())])

    def batch_of(rows_: list[tuple[int | None, str | None]]) -> tuple[list[list[bytes]], Batch]:
        words = [words_of(t) for _, t in rows_]
        return words, Batch([(_LAST if d is None else d, w) for (d, _), w in zip(rows_, words)], window)

    def send(own: pa.Table) -> pa.Table:
        batch = batch_of(read(own))[1]
        cut = batch.cut(blocks)
        used = np.flatnonzero(cut[1:] > cut[:-1])
        part = [slice(cut[b], cut[b + 1]) for b in used]
        held = list(zip(*(sources(batch.least[p], batch.at[p]) for p in part))) or [(), (), ()]
        columns = used.astype(np.int32), np.full(len(used), own["batch"][0].as_py(), np.int64), [packed(batch.distinct[p]) for p in part], *held
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _SENT)], schema=_SENT)

    def answer(table: pa.Table) -> pa.Table:
        seeds = [unpacked(x) for x in table["seeds"]]
        held = [unsourced(*x) for x in zip(table["docs"], table["place"], table["at"])]
        earlier, doc, at = block_answer(seeds, *(np.concatenate(x) for x in zip(*held)))
        ends = np.cumsum([len(x) for x in seeds])
        told = [(earlier[a:z], *sources(doc[a:z][earlier[a:z]], at[a:z][earlier[a:z]])) for a, z in zip(np.r_[0, ends[:-1]], ends)]
        columns = table["batch"].to_pylist(), table["block"].to_pylist(), [np.packbits(t[0]).tobytes() for t in told], *zip(*(t[1:] for t in told))
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _TOLD)], schema=_TOLD)

    def finish(own: pa.Table, answers: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _empty
        rows_ = read(own)
        words, batch = batch_of(rows_)
        cut = batch.cut(blocks)
        earlier, doc, at = np.zeros(len(batch.distinct), bool), np.empty(len(batch.distinct), np.int64), np.empty(len(batch.distinct), np.int64)
        for b, bits, *held in zip(answers["block"].to_pylist(), *(answers[c] for c in ("bits", "docs", "place", "at"))):
            own_ = slice(cut[b], cut[b + 1])
            earlier[own_] = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=cut[b + 1] - cut[b])
            hit = np.flatnonzero(earlier[own_]) + cut[b]
            doc[hit], at[hit] = unsourced(*held)
        doc, at = batch.sourced(earlier, doc[earlier], at[earlier])
        out, begin = [], 0
        for (k, _), w, n in zip(rows_, words, batch.length):
            parse = factors(doc[begin : begin + n], at[begin : begin + n], window)
            begin += n
            found, keep = merged(parse), np.ones(len(w), bool)
            for a, b in found:
                keep[a:b] = False
            out.append((k, len(w), int(len(w) - keep.sum()), *make(b" ".join(compress(w, keep)) if found else b" ".join(w), found, parse)))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), _empty.schema)], schema=_empty.schema)

    schema = StructType.fromDDL(f"doc long, n_words long, n_removed long, {more}")
    _empty = to_arrow_schema(schema).empty_table()
    sent = boxes.groupBy("batch").applyInArrow(send, from_arrow_schema(_SENT))
    answers = sent.groupBy("block").applyInArrow(answer, from_arrow_schema(_TOLD)).withColumnRenamed("batch", "home")
    parsed = boxes.groupBy("batch").cogroup(answers.groupBy("home")).applyInArrow(finish, schema)
    return parsed.withColumnRenamed("doc", key)
