"""Near-duplicate detection by MinHash: banding, signature verification, exact confirmation, connected components.

1. Sketch. A document's set is its distinct shingles (64-bit hashes). Universal hash functions a*x+b give ``bands`` x ``rows``
   minima; each band's minima hash to a key. One pass, no shuffle; the table is written.
2. Classes. Documents with equal sets form a class, named by its smallest document, aggregated map-side first, so copies
   cost nothing further on.
3. Stars. In each bucket (documents with an equal band key) every class is paired with the smallest one only; so a
   bucket of n classes makes n - 1 pairs.
4. Verification. Pairs whose signatures agree in under ``screen`` of the minima are dropped (0.8 - 0.2 is more than six standard errors at 180
   minima); the others are confirmed on their full sets. Sets are fetched by one scan that a Bloom filter of bounded size prunes.
5. Components by alternating large-star and small-star.
6. The rest. Two classes of one bucket may be linked without being linked to its smallest. Buckets of three or more that
   still hold several components are searched whole. Large ones first: their classes are dealt to blocks, every two blocks meet in one task,
   which intersects the full sets of all its pairs by matrix products and returns only a spanning forest of the components that it found
   linked, so n classes send about n * n / block rows and no pairs. Components are joined, and the small buckets that still hold several
   give their pairs across components to step 4, and the links found to step 5.

At similarity 0.8 a pair misses every band with probability (1 - 0.8^5)^36 = 6e-7.

Cases: null and empty texts have an empty set and are linked with nothing; a text of fewer words than a shingle is one
shingle; rows that share a doc_id belong to one component; a row whose doc_id is null is linked with nothing and kept, its component null;
repeated rows each give a row, of which :func:`remove` leaves one; very long texts are shingled whole; an empty table gives none; extra
columns are ignored, or kept by :func:`remove`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WordHashes, map_batches, settle, small_batches, written

BANDS, ROWS = 36, 5
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BLOOM_BITS = 20, 28  # 16 bits an id within these limits, so 32 MB at most; beyond, it prunes less
SMALL = 32  # members of a bucket whose pairs are made; larger ones are searched in blocks, just as completely
BLOCK_SETS, BLOCK_BYTES = 1024, 16 << 20

_hashes = WordHashes()


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; A-Z lower-cased."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    _hashes.trim()
    each = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = h * _FACTOR + each[k : n + k]
    h ^= h >> np.uint64(31)
    h *= _MIX
    return np.unique(h ^ h >> np.uint64(29))


class MinHash:
    """Minima of a*x+b modulo 2^32 with odd a: one family for each seed."""

    def __init__(self, bands: int, rows: int, seed: int = 5):
        r = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = (r.integers(0, 1 << 31, bands * rows, np.uint32) << np.uint32(1) | np.uint32(1))[:, None]
        self.b = r.integers(0, 1 << 32, bands * rows, np.uint32)[:, None]

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 512):
            np.minimum(out, (self.a * x[at : at + 512] + self.b).min(axis=1), out=out)
        return out

    def keys(self, signature: np.ndarray) -> np.ndarray:
        h = np.arange(1, self.bands + 1, dtype=np.uint64)
        for column in signature.reshape(self.bands, self.rows).T.astype(np.uint64):
            h = (h ^ column) * _FACTOR
            h ^= h >> np.uint64(29)
        return h.view(np.int64)


def sketch(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n, set_hash, signature (a byte of each minimum), keys of every document of (doc_id, text)."""
    family = MinHash(bands, rows)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        n, name, signature, keys = [], [], [], []
        for t in batch.column(1):
            own = shingles(t.as_py(), size)
            n.append(len(own))
            name.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            full = family.signature(own) if len(own) else None
            signature.append((full & np.uint32(0xFF)).astype(np.uint8).tobytes() if len(own) else None)
            keys.append(family.keys(full) if len(own) else None)
        yield {"doc_id": batch.column(0), "n": n, "set_hash": name, "signature": signature, "keys": keys}

    return map_batches(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, set_hash binary, signature binary, keys array<long>", lambda: settle(_hashes))


def _bloom(ids: DataFrame) -> tuple[int, np.ndarray]:
    """A Bloom filter of the ids, and the bits of a place in it: at most 2^22 words of 64 bits reach the driver, whatever their number."""
    h, low = F.col("h"), _BLOOM_BITS[0]
    size = min(_BLOOM_BITS[1], max(low, (16 * ids.count()).bit_length()))
    bits = ids.select(F.xxhash64("doc_id").alias("h")).select(F.explode(F.array(*[F.pmod(F.shiftrightunsigned(h, s), F.lit(1 << size)) for s in (0, 18, 36)])).alias("bit"))
    found = bits.groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(CAST(1 AS BIGINT), CAST(bit % 64 AS INT))")).alias("bits"))
    out = np.zeros(1 << (size - 6), np.int64)
    table = found.toPandas()
    out[table["word"].to_numpy(np.int64)] = table["bits"].to_numpy(np.int64)
    return size, out


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """doc_id, shingles (binary) of the documents whose ids are asked for: the Bloom filter prunes before the shuffle."""
    size_, filled = _bloom(ids)
    bits = docs.sparkSession.sparkContext.broadcast(filled)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        h, words = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits.value
        hit = np.ones(len(h), bool)
        for s in (0, 18, 36):
            bit = (h >> np.uint64(s)) & np.uint64((1 << size_) - 1)
            hit &= (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)).astype(np.int64) & 1) == 1
        if hit.any():
            part = batch.filter(pa.array(hit))
            own = [shingles(t.as_py(), size) for t in part.column(1)]
            yield {"doc_id": part.column(0), "shingles": [x.tobytes() for x in own]}

    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    found = map_batches(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, shingles binary", lambda: settle(_hashes))
    return found.where(F.octet_length("shingles") > 0).join(ids, "doc_id", "left_semi")


def _screened(pairs: DataFrame, classes: DataFrame, screen: float) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least ``screen`` of the minima."""
    signed = classes.select(F.col("rep").alias("id"), "signature")
    both = pairs.join(signed.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a").join(signed.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        left = [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(2)]
        right = [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(3)]
        if left:
            good = batch.filter(pa.array((np.stack(left) == np.stack(right)).mean(axis=1) >= screen))
            yield {"a": good.column(0), "b": good.column(1)}

    kind = pairs.schema["a"].dataType.simpleString()
    return map_batches(both.select("a", "b", "sa", "sb"), run, f"a {kind}, b {kind}").distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    sets = written(_sets(docs, ids, size), "sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        good = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * shared >= percent * (len(x) + len(y) - shared))
        part = batch.filter(pa.array(good, pa.bool_()))
        yield {"a": part.column(0), "b": part.column(1)}

    kind = pairs.schema["a"].dataType.simpleString()
    return map_batches(both.select("a", "b", "sa", "sb"), run, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of the links (a, b), by alternating large-star and small-star."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        edges = written(joined.select("u", F.col("m").alias("v")).unionByName(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """node, component after links between components."""
    if links.isEmpty():
        return comp
    return written(components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)), "components")


def _mixed(members: DataFrame, comp: DataFrame) -> DataFrame:
    """key, id, c, n of the members of the buckets that hold several components."""
    placed = members.join(comp, members["id"] == comp["node"], "left").select("key", "id", "n", F.coalesce("component", "id").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key")
    return written(placed.join(mixed.hint("merge"), "key"), "mixed")  # hot keys are split, as above


def _across(small: DataFrame, classes: DataFrame, screen: float) -> DataFrame:
    """a, b: the pairs of small buckets across components whose signatures pass the screen."""
    rows = small.join(classes.select(F.col("rep").alias("id"), "signature"), "id").select("key", "id", "c", "signature")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def pairs(table: pa.Table) -> pa.RecordBatch:
            key, c = table["key"].to_numpy(), table["c"].to_numpy()
            ids = table["id"].to_numpy()
            signature = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8).reshape(len(key), -1) if len(key) else np.empty((0, 1), np.uint8)
            left, right = [], []
            for shift in range(1, SMALL):  # rows of a bucket stand together, so every pair is some shift apart
                if shift >= len(key):
                    break
                at = np.flatnonzero((key[shift:] == key[:-shift]) & (c[shift:] != c[:-shift]))
                at = at[(signature[at] == signature[at + shift]).mean(axis=1) >= screen] if len(at) else at
                left.append(ids[at])
                right.append(ids[at + shift])
            x, y = (np.concatenate(z) if z else ids[:0] for z in (left, right))
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])

        for batch in batches:
            table = pa.concat_tables([*held, pa.Table.from_batches([batch])])
            key = table["key"].to_numpy()
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if len(key) and (key != key[-1]).any() else 0
            if cut:
                yield pairs(table.slice(0, cut))
            held = [table.slice(cut)]  # the last bucket may go on in the next batch
        if held:
            yield pairs(held[0])

    return rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _linked_components(large: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: components that full sets link, found block by block in the large buckets."""
    ids = written(large.select(F.col("id").alias("doc_id")).distinct(), "ids")
    sets = written(_sets(docs, ids, size), "sets")
    rows = large.join(sets.select(F.col("doc_id").alias("id"), "shingles"), "id")
    load = rows.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.octet_length("shingles")).alias("bytes"))
    blocks = load.select("key", F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = rows.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "c", "shingles")
    kind = large.schema["c"].dataType.simpleString()

    def run(key: tuple, table: pa.Table) -> pa.Table:
        own, c = table["own"].to_numpy(), table["c"].to_numpy()
        sets_ = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]
        left = np.flatnonzero(own == key[1].as_py())
        right = np.flatnonzero(own == key[2].as_py())
        names, comp = np.unique(c, return_inverse=True)
        linked = _pairs_of_components(sets_, left, right, comp, percent)
        parent = list(range(len(names)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for x, y in linked.tolist():
            if (rx := root(x)) != (ry := root(y)):
                parent[max(rx, ry)] = min(rx, ry)
                out.append((names[x], names[y]))
        return pa.table({"a": pa.array([x for x, _ in out], table["c"].type), "b": pa.array([y for _, y in out], table["c"].type)})

    return dealt.groupBy("key", "low", "high").applyInArrow(run, f"a {kind}, b {kind}").distinct()


def _pairs_of_components(sets_: list[np.ndarray], left: np.ndarray, right: np.ndarray, comp: np.ndarray, percent: int) -> np.ndarray:
    """The distinct pairs of components with a linked pair of sets, one from each side: exact intersections by products of incidence matrices."""
    n = np.array([len(x) for x in sets_])
    owner, flat = np.repeat(np.arange(len(sets_)), n), np.concatenate(sets_)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    place = [np.full(len(sets_), -1), np.full(len(sets_), -1)]
    place[0][left], place[1][right] = np.arange(len(left)), np.arange(len(right))
    width, top = 4096, int(column[-1]) + 1 if len(column) else 0
    for at in range(0, top, width):
        part = slice(*np.searchsorted(column, [at, at + width]))
        sides = []
        for where, rows in zip(place, (len(left), len(right))):
            m = np.zeros((rows, width), np.float32)
            r, k = where[owner[part]], column[part] - at
            m[r[r >= 0], k[r >= 0]] = 1
            sides.append(m)
        common += sides[0] @ sides[1].T
    good = (100 * common >= percent * (n[left][:, None] + n[right][None, :] - common)) & (comp[left][:, None] != comp[right][None, :])
    x, y = np.nonzero(good)
    return np.unique(np.stack([comp[left][x], comp[right][y]], axis=1), axis=0) if len(x) else np.empty((0, 2), np.int64)


def cluster(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """key, n_shingles, component_id, kept of every document."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    small_batches(docs.sparkSession)
    screen = max(0.0, percent / 100 - 0.2)
    sketched = written(sketch(docs, size, bands, rows), "sketch")
    classes = sketched.where("n > 0 AND doc_id IS NOT NULL").groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("keys").alias("keys"))
    classes = written(classes, "classes")
    banded = classes.select(F.col("rep").alias("id"), F.explode("keys").alias("key"))
    buckets = written(banded.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = written(banded.join(buckets.hint("merge"), "key"), "members")  # a merge join, for adaptive execution splits its hot keys
    stars = members.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    stars = written(_screened(stars, classes, screen), "stars")
    links = written(_confirmed(stars, docs, size, percent), "links")
    comp = written(components(links), "components")
    large = _mixed(members.where(F.col("n") > SMALL), comp)
    if not large.isEmpty():
        joined = written(_linked_components(large, docs, size, percent), "linked")
        comp = _merged(comp, joined)
    small = _mixed(members.where((F.col("n") > 2) & (F.col("n") <= SMALL)), comp)
    if not small.isEmpty():
        across = written(_across(small, classes, screen).join(stars, ["a", "b"], "left_anti"), "across")
        found = _confirmed(across, docs, size, percent)
        name = lambda side, c: F.coalesce(F.col(f"{side}.component"), F.col(f"l.{c}")).alias(c)
        joined = found.alias("l").join(comp.alias("p"), F.col("l.a") == F.col("p.node"), "left").join(comp.alias("q"), F.col("l.b") == F.col("q.node"), "left").select(name("p", "a"), name("q", "b"))
        comp = _merged(comp, written(joined, "linked"))
    named = sketched.select("doc_id", "n", "set_hash").join(classes.select("set_hash", "rep"), "set_hash", "left").join(comp, F.col("rep") == comp["node"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return named.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


def remove(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, all columns kept: of the rows that :func:`cluster` keeps, one for each id that isn't null."""
    found = cluster(docs, key=key, text=text, size=size, percent=percent)
    kept = docs.join(found.where(~F.col("kept")).select(key).distinct(), key, "left_anti")
    again = written(docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key), "again")
    if again.isEmpty():
        return kept
    once = kept.join(again, key, "left_semi").dropDuplicates([key])  # only rows whose id stands twice move
    return kept.join(again, key, "left_anti").unionByName(once)
