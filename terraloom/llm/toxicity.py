"""Toxicity: a linear classifier over hashed words, regularised by counterfactuals.

A text is the set of its lower-cased words and their prefixes of three to eight letters, hashed to 2^18 columns, so the broadcast model is 2 MB at any size.
Training minimises logistic loss, plus an L2 term, plus a penalty on every squared difference between the score of a
labelled text and the score of its counterfactual: the same text with each identity term swapped for the next term
of its group. So neutral mentions of a group can't carry score. Columns that fewer than ``min_df`` training texts use,
copies counted once, are not learnt; nor are those whose use differs between the classes by under ``min_z`` standard errors.

Training takes a bounded, hash-chosen sample of labelled rows: at most about ``max_rows`` a class. Scoring reads every whole text.

Cases: null and empty texts get the score of a text without words; labels that are null are ignored; repeated rows
count once in training and are scored alike; with no labels, or one class only, the score is that class's share
(0 without labels); extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import map_batches, unit_hash

BITS = 18
_WORD = re.compile(r"[^\W\d_]+")

#: Identity terms by group and language; a swap goes to the next term of the row.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("she", "he"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("american", "german", "french", "spanish", "mexican", "african", "chinese", "turkish"),
    ("old", "young"),
    ("disabled", "blind", "deaf"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos"),
)
_SWAP = {t: row[(k + 1) % len(row)] for row in IDENTITY_TERMS for k, t in enumerate(row)}


class Columns(dict):
    """Words to the columns of the word and of its prefixes, which catch inflected and compound forms."""

    def __missing__(self, word: str) -> bytes:
        parts = [word, *(f"{word[:k]}~" for k in range(3, min(len(word), 9)))]
        value = self[word] = np.array([xxhash.xxh3_64_intdigest(x) & ((1 << BITS) - 1) for x in parts], np.int32).tobytes()
        return value

    def of(self, words: set[str]) -> np.ndarray:
        if len(self) > 200_000:
            self.clear()
        return np.unique(np.frombuffer(b"".join(map(self.__getitem__, words)), np.int32))


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def swapped(words: set[str]) -> set[str] | None:
    """The counterfactual's words, or None if the text names no group."""
    named = words & _SWAP.keys()
    return (words - named) | {_SWAP[w] for w in named} if named else None


def _sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows) if rows else np.empty(0, np.int32)


def fit(rows: list[np.ndarray], labels: np.ndarray, twins: list[np.ndarray | None], *, l2: float = 2e-4, counterfactual: float = 1.0, min_df: int = 5, min_z: float = 3.0, rounds: int = 300) -> np.ndarray:
    """Weights by column, and the bias last: full-batch Adam on the regularised loss."""
    positive = float(labels.mean()) if len(labels) else 0.0
    weights = np.zeros((1 << BITS) + 1)
    if positive in (0.0, 1.0):
        weights[-1] = 12.0 if positive else -12.0
        return weights
    df = np.bincount(np.concatenate(rows), minlength=1 << BITS)
    toxic = [r for r, y in zip(rows, labels) if y == 1]
    share = df / len(rows)
    a = np.bincount(np.concatenate(toxic), minlength=1 << BITS) / len(toxic)
    b = (share - a * positive) / (1 - positive)
    z = (a - b) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / len(toxic) + 1 / (len(rows) - len(toxic))))
    used = np.flatnonzero((df >= min_df) & (np.abs(z) >= min_z))
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    own = lambda r: place[r][place[r] >= 0]
    i, j = _sparse([own(r) for r in rows])
    pairs = [(own(r), own(t)) for r, t in zip(rows, twins) if t is not None]
    pi, pj = _sparse([np.concatenate(p) for p in pairs])
    sign = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in pairs]) if pairs else np.empty(0)
    balance = np.where(labels == 1, 0.5 / positive, 0.5 / (1 - positive))
    w, bias, n = np.zeros(len(used)), 0.0, len(rows)
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, rounds + 1):
        score = np.bincount(i, w[j], n) + bias
        error = balance * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels) / n
        gradient = np.bincount(j, error[i], len(w)) + l2 * w
        if pairs:
            gap = np.bincount(pi, sign * w[pj], len(pairs))
            gradient += counterfactual * 2 * np.bincount(pj, sign * gap[pi], len(w)) / len(pairs)
        full = np.r_[gradient, error.sum()]
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    weights[used], weights[-1] = w, bias
    return weights


def train(docs: DataFrame, labels: DataFrame, *, learn: Column | None = None, text: str = "text", label: str = "toxic", key: str = "doc_id", max_rows: int = 4000, seed: int = 7, **kind: float) -> np.ndarray:
    """Fit on a hash-chosen sample of labelled rows, at most about ``max_rows`` a class; ``learn`` filters on the id."""
    marked = labels.select(key, label).where(F.col(label).isNotNull() & F.col(key).isNotNull())
    marked = marked if learn is None else marked.where(learn)
    sizes = {r[0]: r[1] for r in marked.groupBy(label).count().collect()}
    if not sizes:
        return fit([], np.empty(0), [])
    rate = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, max_rows / n)))])
    sample = marked.where(unit_hash(key, seed) < F.element_at(rate, F.col(label))).select(key, F.col(label).cast("int").alias("_label")).distinct()
    # the sample is bounded by max_rows, so its ids fit a broadcast; the texts are not shuffled
    rows = docs.select(key, text).join(F.broadcast(sample), key).select(text, "_label")

    def features(batch: pa.RecordBatch) -> Iterator[dict]:
        columns = Columns()
        words = [words_of(t) for t in batch.column(0).to_pylist()]
        twins = [swapped(w) for w in words]
        yield {"row": [columns.of(w).tobytes() for w in words], "label": batch.column(1), "twin": [None if t is None else columns.of(t).tobytes() for t in twins]}

    found = sorted({(bytes(r.row), r.label, bytes(r.twin) if r.twin is not None else b"") for r in map_batches(rows, features, "row binary, label int, twin binary").toLocalIterator()})
    back = lambda x: np.frombuffer(x, np.int32)
    return fit([back(r) for r, _, _ in found], np.array([y for _, y, _ in found], float), [back(t) if t else None for _, _, t in found], **kind)


def score(docs: DataFrame, weights: np.ndarray, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, score (0 to 1), predicted (1 if score >= 0.5). One row in, one out; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    columns = Columns()

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        w = shared.value
        sums = np.array([w[columns.of(words_of(t.as_py()))].sum() for t in batch.column(len(keep))]) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(sums, -30, 30)))
        yield {c: batch.column(k) for k, c in enumerate(keep)} | {"score": p, "predicted": (p >= 0.5).astype(np.int32)}

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(docs.select(*keep, text), run, f"{schema}{', ' * bool(schema)}score double, predicted int")
