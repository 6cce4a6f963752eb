"""Character n-grams of a corpus by language: modified Kneser-Ney, counted in batches, stored in sorted hash arrays.

N-grams are five code points, as they stand, with four starts before a text. An n-gram's count is the number of documents
that hold it, so one document that repeats a pattern teaches it once. The model of a language interpolates
orders 5 to 1 with modified Kneser-Ney's discounts; the lower orders count distinct left neighbours. No count is left out.

Every text that is scored has been counted, so an n-gram's probability is looked up whole, without back-off at lookup:

1. Batches (:mod:`batches`): tasks pack their documents into batches of about ``batch_bytes``, written once, bucketed by
   batch, so that no later step moves texts.
2. ``sent``: a batch sends its distinct n-grams with their counts to the blocks that own their two middle characters. All
   n-grams with one context, or with one left-stripped suffix, down to order 3, therefore meet in one block. Sorted by code points and
   compressed they take 2 to 4 bytes each.
3. ``totals``: a block adds up, first by groups of ``group`` batches, then all. What is left for orders 2 and 1 is
   one row a pair of characters and language.
4. ``model``: a block's sorted 64-bit hashes with the negative log-probabilities at orders 5 and 3, one row a block.
5. ``answers``: each batch gets the values of the n-grams that it sent; the batch then scores its texts.

What is sent, counted and stored grows with the corpus; a task holds a batch, a block of the model, or what ``group`` batches sent to a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from ._common import small_batches, written
from .batches import opened, packed_batches, planes, squeezed, unplaned, unsqueezed

ORDER = 5
BATCH_BYTES = 32 << 20
GROUP = 1000
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_STEP = 1 << 20  # characters hashed together
_SCALE = 2048  # values travel as multiples of 1 / 2048
_GRAMS = [("langs", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("data", pa.binary())]
_SENT = pa.schema([("block", pa.int32()), ("batch", pa.int64()), *_GRAMS])
_TOTAL = pa.schema([("block", pa.int32()), *_GRAMS])
_FEW = pa.struct([("lang", pa.string()), ("few", pa.list_(pa.list_(pa.int64())))])
_PAIR = pa.struct([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])
_TOTALS = pa.schema([*_TOTAL, ("few", pa.list_(_FEW)), ("pairs", pa.list_(_PAIR))])
_MODEL = pa.schema([("block", pa.int32()), ("hashes", pa.binary()), ("fifth", pa.binary()), ("third", pa.binary())])
_ANSWER = pa.schema([("batch", pa.int64()), *_GRAMS, ("fifth", pa.binary()), ("third", pa.binary())])


def _table(schema: pa.Schema, *columns: list) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def mixed(seed: np.uint64, *codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of code points in order."""
    h = np.full(len(codes[0]), seed, np.uint64)
    for c in codes:
        h = (h ^ c) * _FACTOR
        h ^= h >> np.uint64(29)
    return h


def seed_of(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang))


def code_points(text: str) -> np.ndarray:
    """A text's code points as they are counted: starts are 0, so characters are one more."""
    return np.concatenate([np.zeros(ORDER - 1, np.uint32), np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32) + np.uint32(1)])


def chunks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Code points of texts one after the other, the places where n-grams begin, and how many each text has."""
    at = 0
    while at < len(texts):
        stop, size = at + 1, len(texts[at])
        while stop < len(texts) and size + len(texts[stop]) <= _STEP:
            size += len(texts[stop])
            stop += 1
        codes = [code_points(t) for t in texts[at:stop]]
        n = np.array([len(c) - ORDER + 1 for c in codes])
        begin = np.arange(int(n.sum())) + np.repeat(np.arange(len(n)) * (ORDER - 1), n)
        yield np.concatenate(codes), begin, n.tolist()
        at = stop


def hashes(codes: np.ndarray, begin: np.ndarray, seed: np.uint64) -> np.ndarray:
    n = len(codes) - ORDER + 1
    return mixed(seed, *[codes[k : n + k] for k in range(ORDER)])[begin]


class Grams:
    """Distinct n-grams of one language: code points [n, 5] and counts."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        self.codes, self.n = codes, n

    @classmethod
    def of(cls, texts: list[str], seed: np.uint64) -> Grams:
        parts = []
        for codes, begin, n in chunks(texts):
            h, at, edge = hashes(codes, begin, seed), [], 0
            for k in n:  # once a document
                own = h[edge : edge + k]
                order = np.argsort(own)
                own = own[order]
                at.append(order[np.r_[True, own[1:] != own[:-1]]] + edge if k else order)
                edge += k
            at = np.concatenate(at)
            _, first, count = np.unique(h[at], return_index=True, return_counts=True)
            begin = begin[at[first]]
            parts.append(cls(np.stack([codes[begin + k] for k in range(ORDER)], axis=1), count))
            if sum(len(p.n) for p in parts) > 4 * _STEP:
                parts = [cls.added(parts, seed)]
        return cls.added(parts, seed)

    @classmethod
    def added(cls, parts: list[Grams], seed: np.uint64) -> Grams:
        codes, n = np.concatenate([p.codes for p in parts]), np.concatenate([p.n for p in parts])
        _, first, which = np.unique(mixed(seed, *codes.T), return_index=True, return_inverse=True)
        return cls(codes[first], np.bincount(which, n, len(first)).astype(np.int64))

    def __getitem__(self, which: object) -> Grams:
        return Grams(self.codes[which], self.n[which])

    def sorted(self) -> Grams:
        c = self.codes
        return self[np.lexsort((c[:, 4], c[:, 0], c[:, 1], c[:, 3], c[:, 2]))]

    def block(self, seed: np.uint64, blocks: int) -> np.ndarray:
        return (mixed(seed, self.codes[:, 2], self.codes[:, 3]) * _MIX >> np.uint64(33)).astype(np.int64) % blocks


def to_bytes(parts: list[Grams]) -> bytes:
    codes = np.concatenate([p.codes for p in parts]).astype(np.uint32)
    return squeezed(b"".join(planes(np.ascontiguousarray(codes[:, k])) for k in (2, 3, 1, 0, 4)) + planes(np.concatenate([p.n for p in parts]).astype(np.uint32)))


def from_bytes(data: pa.Scalar, langs: list[str], sizes: list[int]) -> dict[str, Grams]:
    c3, c4, c2, c1, c5, n = (np.ascontiguousarray(x) for x in unplaned_six(unsqueezed(data)))
    ends, codes = np.cumsum(sizes)[:-1], np.stack([c1, c2, c3, c4, c5], axis=1)
    return {g: Grams(c, m.astype(np.int64)) for g, c, m in zip(langs, np.split(codes, ends), np.split(n, ends))}


def unplaned_six(data: bytes) -> list[np.ndarray]:
    each = len(data) // 6
    return [unplaned(data[k * each : (k + 1) * each], np.uint32) for k in range(6)]


def _gathered(table: pa.Table) -> dict[str, Grams]:
    """The n-grams of all rows, added up by language; rows are taken in portions, so memory follows the distinct ones."""
    held: dict[str, list[Grams]] = {}
    for langs, sizes, data in zip(table["langs"].to_pylist(), table["sizes"].to_pylist(), table["data"]):
        for g, grams in from_bytes(data, langs, sizes).items():
            held.setdefault(g, []).append(grams)
            if len(held[g]) > 16 and sum(len(p.n) for p in held[g]) > 4 * _STEP:
                held[g] = [Grams.added(held[g], seed_of(g))]
    return {g: Grams.added(parts, seed_of(g)).sorted() for g, parts in sorted(held.items())}


def counts_of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def discounts(few: list[int]) -> np.ndarray:
    """Modified Kneser-Ney's discounts for counts 0, 1, 2, 3 and more, from the numbers of n-grams with counts 1 to 4."""
    n1, n2, n3, n4 = few
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.05, [0.95, 1.9, 2.9])])


def discounted(context: np.ndarray, n: np.ndarray, discount: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Interpolated probabilities of n-grams, from those of their suffixes."""
    _, which = np.unique(context, return_inverse=True)
    less = discount[np.minimum(n, 3)]
    total = np.bincount(which, n)[which]
    return (n - less) / total + np.bincount(which, less)[which] / total * lower


class Levels:
    """The n-grams of a block and language at orders 5, 4 and 3, and their pairs: counts, and where each one's suffix is."""

    def __init__(self, grams: Grams, seed: np.uint64):
        self.seed, codes, n, self.codes, self.n, self.suffix = seed, grams.codes, grams.n, [], [], []
        for _ in range(3):
            self.codes.append(codes)
            self.n.append(n)
            _, first, which, n = np.unique(mixed(seed, *codes[:, 1:].T), return_index=True, return_inverse=True, return_counts=True)
            self.suffix.append(which)
            codes = codes[first][:, 1:]
        self.pairs, self.pair_n = codes, n

    def probabilities(self, few: list[list[int]], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At orders 5 and 3, for each n-gram of order 5; ``few`` are the counts of counts of orders 5, 4 and 3, ``pairs`` the pairs' probabilities."""
        lower, third = pairs, None
        for k in (2, 1, 0):
            codes = self.codes[k]
            lower = discounted(mixed(self.seed, *codes[:, :-1].T), self.n[k], discounts(few[k]), lower[self.suffix[k]])
            third = lower if third is None else third[self.suffix[k]]
        return lower, third


def pair_probabilities(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Orders 2 and 1 of one language, from each pair's number of left neighbours."""
    _, which, kinds = np.unique(right, return_inverse=True, return_counts=True)
    single = discounted(np.zeros(len(kinds), np.int8), kinds, discounts(counts_of_counts(kinds)), np.full(len(kinds), 1 / max(len(kinds), 1)))
    return discounted(left, n, discounts(counts_of_counts(n)), single[which])


class Lookup:
    """Values by 64-bit hash: sorted arrays, entered at the hash's leading bits."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], [v[order] for v in values]
        self.shift = np.uint64(64 - max(1, len(keys).bit_length()))
        self.start = np.searchsorted(self.keys, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift)

    def __call__(self, wanted: np.ndarray) -> list[np.ndarray]:
        at = self.start[(wanted >> self.shift).astype(np.int64)]
        behind = np.flatnonzero(self.keys[at] < wanted) if len(at) else at
        while len(behind):
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < wanted[behind]]
        return [v[at] for v in self.values]


def _send(blocks: int) -> Callable[[pa.Table], pa.Table]:
    def run(own: pa.Table) -> pa.Table:
        parts: dict[str, list[Grams]] = {}
        for rows in opened(own):
            by: dict[str, list[str]] = {}
            for g, t in zip(rows["lang"].to_pylist(), rows["text"].to_pylist()):
                if t:
                    by.setdefault(g, []).append(t)
            for g, texts in by.items():
                parts.setdefault(g, []).append(Grams.of(texts, seed_of(g)))
        mine: dict[int, list[tuple[str, Grams]]] = {}
        for g, found in sorted(parts.items()):
            grams = Grams.added(found, seed_of(g)).sorted()
            block = grams.block(seed_of(g), blocks)
            for b in np.unique(block).tolist():
                mine.setdefault(b, []).append((g, grams[block == b]))
        batch = own["batch"][0].as_py()
        return _table(_SENT, list(mine), [batch] * len(mine), [[g for g, _ in x] for x in mine.values()], [[len(p.n) for _, p in x] for x in mine.values()], [to_bytes([p for _, p in x]) for x in mine.values()])

    return run



def _add(table: pa.Table) -> pa.Table:
    found = _gathered(table)
    return _table(_TOTAL, [table["block"][0].as_py()], [list(found)], [[len(x.n) for x in found.values()]], [to_bytes(list(found.values()))])


def _add_all(table: pa.Table) -> pa.Table:
    added = _add(table)
    few, pairs = [], []
    for g, grams in from_bytes(added["data"][0], added["langs"][0].as_py(), added["sizes"][0].as_py()).items():
        levels = Levels(grams, seed_of(g))
        few.append({"lang": g, "few": [counts_of_counts(n) for n in levels.n]})
        pairs += [{"lang": g, "a": a, "b": b, "n": n} for (a, b), n in zip(levels.pairs.tolist(), levels.pair_n.tolist())]
    return _table(_TOTALS, *[added[c].to_pylist() for c in added.column_names], [few], [pairs])


def _lower(table: pa.Table) -> pa.Table:
    p = pair_probabilities(*(table[c].to_numpy() for c in ("a", "b", "n")))
    return table.drop_columns("n").append_column("p", pa.array(p))




def _build(totals: pa.Table, aux: pa.Table) -> pa.Table:
    if not totals.num_rows:
        return _MODEL.empty_table()
    keys, fifth, third = [], [], []
    for g, grams in from_bytes(totals["data"][0], totals["langs"][0].as_py(), totals["sizes"][0].as_py()).items():
        seed = seed_of(g)
        own = aux.filter(pc.equal(aux["lang"], g))
        levels = Levels(grams, seed)
        known = Lookup(mixed(seed, *(own[c].to_numpy().astype(np.uint32) for c in ("a", "b"))), own["p"].to_numpy())
        p5, p3 = levels.probabilities(own["few"][0].as_py(), known(mixed(seed, *levels.pairs.T))[0])
        keys.append(mixed(seed, *grams.codes.T))
        fifth.append(-np.log(p5))
        third.append(-np.log(p3))
    table = Lookup(*(np.concatenate(x) for x in (keys, fifth, third)))
    return _table(_MODEL, [totals["block"][0].as_py()], [table.keys.tobytes()], *[[v.astype(np.float32).tobytes()] for v in table.values])




def _answer(sent: pa.Table, model: pa.Table) -> pa.Table:
    if not sent.num_rows:
        return _ANSWER.empty_table()
    known = Lookup(np.frombuffer(model["hashes"][0].as_buffer(), np.uint64), *(np.frombuffer(model[c][0].as_buffer(), np.float32) for c in ("fifth", "third")))
    values = [], []
    for langs, sizes, data in zip(sent["langs"].to_pylist(), sent["sizes"].to_pylist(), sent["data"]):
        found = [known(mixed(seed_of(g), *x.codes.T)) for g, x in from_bytes(data, langs, sizes).items()]
        for out, v in zip(values, zip(*found)):
            out.append(squeezed(planes(np.minimum(np.rint(np.concatenate(v) * _SCALE), 65535).astype(np.uint16))))
    return _table(_ANSWER, *[sent[c].to_pylist() for c in ("batch", "langs", "sizes", "data")], *values)


def _finish(row: Callable[[str | None], tuple], schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        if not own.num_rows:
            return schema.empty_table()
        parts: dict[str, list[tuple]] = {}
        for langs, sizes, data, *values in zip(*(answers[c] if c not in ("langs", "sizes") else answers[c].to_pylist() for c in answers.column_names if c != "batch")):
            values = [np.split(unplaned(unsqueezed(v), np.uint16), np.cumsum(sizes)[:-1]) for v in values]
            for g, x, *v in zip(langs, from_bytes(data, langs, sizes).values(), *values):
                parts.setdefault(g, []).append((mixed(seed_of(g), *x.codes.T), *v))
        known = {g: Lookup(*(np.concatenate(c) for c in zip(*x))) for g, x in parts.items()}
        out = []
        for rows in opened(own):
            langs, texts = rows["lang"].to_pylist(), rows["text"].to_pylist()
            means = np.full((2, len(texts)), np.nan)
            for g in sorted(set(langs)):
                at = [k for k, (x, t) in enumerate(zip(langs, texts)) if x == g and t]
                done = 0
                for codes, begin, n in chunks([texts[k] for k in at]):
                    edges = np.cumsum(n) - n
                    for out_, v in zip(means, known[g](hashes(codes, begin, seed_of(g)))):
                        out_[at[done : done + len(n)]] = np.add.reduceat(v.astype(np.int64), edges) / n / _SCALE
                    done += len(n)
            columns = [rows["doc_id"], langs, *zip(*map(row, texts)), *([None if np.isnan(x) else float(x) for x in v] for v in means)]
            out.append(pa.table([c.cast(f.type) if isinstance(c, pa.ChunkedArray) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))
        return pa.concat_tables(out)

    return run


def model(sent: DataFrame, batches: int, group: int = GROUP) -> DataFrame:
    """block, hashes, fifth, third: the model in sorted hash arrays, written in the shared folder."""
    salt = F.pmod(F.xxhash64("batch"), F.lit(max(1, -(-batches // group))))
    added = sent.withColumn("salt", salt).groupBy("block", "salt").applyInArrow(lambda t: _add(t), from_arrow_schema(_TOTAL))
    totals = written(added.groupBy("block").applyInArrow(_add_all, from_arrow_schema(_TOTALS)), "totals")
    pairs = totals.select(F.col("block").alias("home"), F.explode("pairs").alias("x")).select("home", "x.*")
    low = pairs.groupBy("lang", "a", "b").agg(F.sum("n").alias("n")).groupBy("lang").applyInArrow(_lower, "lang string, a int, b int, p double")
    each = totals.select(F.explode("few").alias("x")).select("x.*").select("lang", F.posexplode("few").alias("o", "few"))
    few = each.groupBy("lang", "o").agg(F.array(*[F.sum(F.col("few")[k]) for k in range(4)]).alias("few"))
    few = few.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "few"))), lambda x: x["few"]).alias("few"))  # three rows a language
    aux = pairs.drop("n").join(low, ["lang", "a", "b"]).join(few, "lang")
    return written(totals.select("block", "langs", "sizes", "data").groupBy("block").cogroup(aux.groupBy("home")).applyInArrow(_build, from_arrow_schema(_MODEL)), "model")


def score(docs: DataFrame, row: Callable[[str | None], tuple], more: str, *, text: str = "text", lang: str = "lang", key: str = "doc_id", batch_bytes: int = BATCH_BYTES, group: int = GROUP, blocks: int | None = None) -> DataFrame:
    """doc_id, lang (null: '-', others after a '+'), the columns ``more`` that ``row`` makes of each text, and the mean negative log-probability of a character at orders 5 and 3 (null without a character)."""
    small_batches(docs.sparkSession)
    named = F.coalesce(F.concat(F.lit("+"), F.col(lang).cast("string")), F.lit("-"))
    kind = docs.schema[key].dataType.simpleString()
    boxes, batches, _ = packed_batches(docs.select(F.col(key).alias("doc_id"), named.alias("lang"), F.col(text).alias("text")), batch_bytes)
    blocks = blocks or min(256, max(16, 1 << (batches - 1).bit_length()))
    sent = written(boxes.groupBy("batch").applyInArrow(_send(blocks), from_arrow_schema(_SENT)), "sent")
    salts = max(1, -(-batches // group))
    salted = sent.withColumn("salt", F.pmod(F.xxhash64("batch"), F.lit(salts)))
    stored = model(sent, batches, group).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    answers = salted.groupBy("block", "salt").cogroup(stored.groupBy("block", "salt")).applyInArrow(lambda s, m: _answer(s, m), from_arrow_schema(_ANSWER))
    out = StructType.fromDDL(f"doc_id {kind}, lang string, {more}, fifth double, third double")
    return boxes.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_finish(row, to_arrow_schema(out)), out)
