"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Every language has a probability for each piece of a public vocabulary. A word's likelihood in a language is the sum,
over all its segmentations into pieces, of the product of piece probabilities: the forward algorithm. A text's score
is the sum over its words; its language has the highest posterior under equal priors.

Training takes a bounded sample: ``max_docs`` documents a language at most, chosen by a hash of the id (never by
position), then expectation-maximisation of the piece probabilities over the sample's word counts. Prediction reads
every whole text. The model has vocabulary x languages numbers (256 KB a language), which bounds what is broadcast.

Cases: a null text or one without a letter gets ``und`` with score 0; rows whose language is null are never learnt
from; with nothing to learn from, every text gets ``und``; equal posteriors go to the alphabetically first language;
repeated rows are scored alike; very long texts and words are read whole; over ``MAX_LANGUAGES`` languages raise; extra columns are ignored.
Letters are those of Unicode's categories L; digits, superscripts and Roman numerals are none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import map_batches, settle, small_batches, unit_hash

_LETTERS = regex.compile(r"\p{L}+")
_UNKNOWN = 1e-7  # of a character that is no piece, in every language
_MOST_WORDS = 350_000
_CELLS = 200_000
MAX_LANGUAGES = 1000


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, int]:
    """Pieces of a sentencepiece model file that hold letters, with the word mark kept."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    mark = model.encode("a", out_type=str)[0][0]
    found = dict.fromkeys(p.replace(mark, " ").lower() for p in pieces)
    return {p: k for k, p in enumerate(p for p in found if p.strip().isalpha() or p == " ")}


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


_tries: dict[int, tuple[dict[str, int], dict[str, int]]] = {}


def _longest(vocab: dict[str, int]) -> int:
    return max(map(len, vocab), default=1)


def _trie(vocab: dict[str, int]) -> dict[str, int]:
    """Every prefix of a piece: the piece's number, or -1 if the prefix is none."""
    if id(vocab) not in _tries:
        if len(_tries) > 3:
            _tries.clear()
        prefixes = {piece[:k]: -1 for piece in vocab for k in range(1, len(piece))}
        _tries[id(vocab)] = vocab, prefixes | vocab
    return _tries[id(vocab)][1]


def _edges(words: list[str], vocab: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word, start, end, piece of every occurrence of a piece; characters without a piece get the piece after the last."""
    get, none = _trie(vocab).get, len(vocab)
    w, s, e, p = [], [], [], []
    for k, word in enumerate(words):
        n = len(word)
        for start in range(n):
            single = get(word[start])
            if single is None or single < 0:
                w.append(k)
                s.append(start)
                e.append(start + 1)
                p.append(none)
                if single is None:
                    continue
            for end in range(start + 1, n + 1):
                piece = get(word[start:end])
                if piece is None:
                    break
                if piece >= 0:
                    w.append(k)
                    s.append(start)
                    e.append(end)
                    p.append(piece)
    return tuple(np.array(x, np.int64) for x in (w, s, e, p))


def _by(end: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(end, kind="stable")
    return order, np.searchsorted(end[order], np.arange(most + 2))


def _sum_into(target: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add values to target rows; rows are sorted."""
    if len(rows):
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        target[rows[first]] += np.add.reduceat(values, first, axis=0)


def forward(words: list[str], vocab: dict[str, int], probs: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word in each language, all segmentations summed."""
    out = np.empty((len(words), probs.shape[1]))
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop - at + 1) * len(words[order[stop]]) <= _CELLS // 4:
            stop += 1
        part = [words[k] for k in order[at:stop]]
        out[order[at:stop]] = _forward_block(part, vocab, probs)
        at = stop
    return out


def _forward_block(words: list[str], vocab: dict[str, int], probs: np.ndarray) -> np.ndarray:
    lengths = np.array([len(w) for w in words])
    most, longest = int(lengths.max()), _longest(vocab)
    w, s, e, p = _edges(words, vocab)
    order, begin = _by(e, most)
    w, s, p = w[order], s[order], p[order]
    alpha = np.zeros((len(words), most + 1, probs.shape[1]))
    alpha[:, 0] = 1
    scale = np.zeros(len(words))
    logs = np.zeros((len(words), probs.shape[1]))
    for end in range(1, most + 1):
        edge = slice(begin[end], begin[end + 1])
        _sum_into(alpha[:, end], w[edge], alpha[w[edge], s[edge]] * probs[p[edge]])
        done = lengths == end
        if done.any():
            logs[done] = np.log(np.maximum(alpha[done, end], 1e-300)) + scale[done, None]
        low = (lengths > end) & (alpha[:, end].max(axis=1) < 1e-120)
        if low.any():  # long words: carry the factor aside
            window = slice(max(0, end - longest), end + 1)
            alpha[low, window] *= 1e120
            scale[low] -= 120 * np.log(10)
    return logs


def fit(counts: dict[tuple[str, str], int], vocab: dict[str, int], rounds: int = 3) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities [pieces + 1, languages] from the counts of (language, word), by expectation-maximisation."""
    languages = sorted({lang for lang, _ in counts})
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the model is bounded to {MAX_LANGUAGES}")
    column = {lang: k for k, lang in enumerate(languages)}
    words = sorted({f" {w}" for _, w in counts}, key=len)
    row = {w: k for k, w in enumerate(words)}
    n = np.zeros((len(words), len(languages)))
    for (lang, word), c in counts.items():
        n[row[f" {word}"], column[lang]] += c
    probs = np.full((len(vocab) + 1, len(languages)), 1 / len(vocab))
    probs[-1] = _UNKNOWN
    most = _CELLS // 16
    for _ in range(rounds):
        expected = np.full((len(vocab) + 1, len(languages)), 0.02)
        at = 0
        while at < len(words):
            stop = at + 1
            while stop < min(len(words), at + most) and (stop - at + 1) * len(words[stop]) <= 40 * most:
                stop += 1
            _expect(words[at:stop], n[at:stop], vocab, probs, expected)
            at = stop
        probs = expected / expected[:-1].sum(axis=0)
        probs[-1] = _UNKNOWN
    return languages, probs


def _expect(words: list[str], n: np.ndarray, vocab: dict[str, int], probs: np.ndarray, expected: np.ndarray) -> None:
    lengths = np.array([len(w) for w in words])
    most, longest = int(lengths.max()), _longest(vocab)
    w, s, e, p = _edges(words, vocab)
    alpha, beta = np.zeros((2, len(words), most + 1, probs.shape[1]))
    up_a, up_b = np.zeros((2, *(alpha.shape if most > 15 else (0, 0, 0))), np.int32)  # factors of 1e120 carried aside; a shorter word needs none

    def lift(values: np.ndarray, up: np.ndarray, at: int, before: int, window: range) -> None:
        if not len(up):
            return
        up[:, at] = up[:, before]
        low = (values[:, at] > 0) & (values[:, at] < 1e-120)
        if low.any():
            for k in window:
                values[:, k][low] *= 1e120
                up[:, k][low] += 1

    alpha[:, 0] = 1
    beta[np.arange(len(words)), lengths] = 1
    order, begin = _by(e, most)
    for end in range(1, most + 1):
        k = order[begin[end] : begin[end + 1]]
        _sum_into(alpha[:, end], w[k], alpha[w[k], s[k]] * probs[p[k]])
        lift(alpha, up_a, end, end - 1, range(max(0, end - longest), end + 1))
    order, begin = _by(s, most)
    for start in range(most - 1, -1, -1):
        k = order[begin[start] : begin[start + 1]]
        _sum_into(beta[:, start], w[k], beta[w[k], e[k]] * probs[p[k]])
        lift(beta, up_b, start, start + 1, range(start, min(most, start + longest) + 1))
    total = alpha[np.arange(len(words)), lengths]
    share = n / np.maximum(total, 1e-300)
    posterior = alpha[w, s] * probs[p] * beta[w, e] * share[w]
    if up_a.any() or up_b.any():
        posterior *= 10.0 ** (-120.0 * (up_a[w, s] + up_b[w, e] - up_a[np.arange(len(words)), lengths][w]))
    for lang in range(probs.shape[1]):
        expected[:, lang] += np.bincount(p, posterior[:, lang], len(expected))


class Scorer:
    """Adds word likelihoods of texts; keeps a bounded table of scored words."""

    def __init__(self, path: str, probs: np.ndarray):
        self.vocab, self.probs = vocabulary(path), probs
        self.row: dict[str, int] = {}
        self.table = np.empty((0, probs.shape[1]), np.float32)

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.row) > _MOST_WORDS:
            self.row, self.table = {}, self.table[:0]
        new = list(set().union(*texts).difference(self.row))
        if new:
            self.row |= zip(new, range(len(self.row), len(self.row) + len(new)))
            self.table = np.concatenate([self.table, forward([f" {w}" for w in new], self.vocab, self.probs).astype(np.float32)])
        get = self.row.__getitem__
        return np.stack([self.table[np.fromiter(map(get, t), np.int64, len(t))].sum(axis=0, dtype=np.float64) for t in texts])


def train(docs: DataFrame, path: str, *, learn: Column | None = None, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs: int = 400, seed: int = 8) -> tuple[list[str], np.ndarray]:
    """Fit on at most about ``max_docs`` hash-chosen documents a language; ``learn`` says which rows may be learnt from."""
    rows = docs.select(key, text, lang).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows if learn is None else rows.where(learn)
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages: a model has one column of the vocabulary's length for each")
    if not sizes:
        return [], np.empty((0, 0))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, max_docs / n)))])
    sample = rows.where(unit_hash(key, seed) < F.element_at(share, F.col(lang)))

    def count(batch: pa.RecordBatch) -> Iterator[dict]:
        found = Counter((g, w) for t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in words_of(t))
        yield {"g": [g for g, _ in found], "w": [w for _, w in found], "n": list(found.values())}

    counted = map_batches(sample.select(text, lang), count, "g string, w string, n long").groupBy("g", "w").agg(F.sum("n").alias("n"))
    return fit({(r.g, r.w): r.n for r in counted.toLocalIterator()}, vocabulary(path))


def predict(docs: DataFrame, path: str, model: tuple[list[str], np.ndarray], *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, lang_pred, score (posterior of lang_pred). One row in, one out; no shuffle."""
    languages, probs = model
    shared = docs.sparkSession.sparkContext.broadcast(probs)
    state: dict[str, Scorer] = {}

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        kept = {c: batch.column(k) for k, c in enumerate(keep)}
        if not languages:
            yield kept | {"lang_pred": ["und"] * batch.num_rows, "score": [0.0] * batch.num_rows}
            return
        if "scorer" not in state:
            state["scorer"] = Scorer(path, shared.value)
        scorer = state["scorer"]
        best, score = [], []
        texts = batch.column(len(keep))
        for at in range(0, batch.num_rows, 256):
            words = [words_of(t) for t in texts[at : at + 256].to_pylist()]
            logs = scorer.scores(words)
            top = logs.argmax(axis=1)
            posterior = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            best += [languages[k] if w else "und" for k, w in zip(top, words)]
            score += [float(x) if w else 0.0 for x, w in zip(posterior, words)]
        yield kept | {"lang_pred": best, "score": score}

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(docs.select(*keep, text), run, f"{schema}{', ' * bool(schema)}lang_pred string, score double", lambda: settle(state))


def accept(docs: DataFrame, path: str, model: tuple[list[str], np.ndarray], *, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents with a predicted language whose posterior is at least ``least``; all columns kept, no shuffle."""
    languages, probs = model
    shared, at = docs.sparkSession.sparkContext.broadcast(probs), docs.columns.index(text)
    state: dict[str, Scorer] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if languages else ():
            if "scorer" not in state:
                state["scorer"] = Scorer(path, shared.value)
            scorer, good = state["scorer"], []
            for k in range(0, batch.num_rows, 256):
                words = [words_of(t) for t in batch.column(at)[k : k + 256].to_pylist()]
                logs = scorer.scores(words)
                posterior = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                good += [bool(w) and x >= least for w, x in zip(words, posterior.tolist())]
            yield batch.filter(pa.array(good, pa.bool_()))
        settle(state)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
