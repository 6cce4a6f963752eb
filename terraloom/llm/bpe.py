"""Byte-level BPE encoding and decoding by speculation.

Method: greedy longest match proposes the tokens of a word; a word's proposal is its BPE encoding exactly when
every adjacent pair of tokens, merged on its own bytes, comes back as that same pair. The pairs of all new words of a
batch are tested together against a table of tested pairs; only words with a failing pair undergo exact merging.
Words repeat, so each Python worker keeps a bounded table of encoded words.

Cases: a null text counts as empty (0 tokens); special tokens inside a text become their own ids, as the tokenizers
library does by default; repeated rows give repeated rows; very long texts and words are encoded whole; extra input columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import map_batches, settle

#: The pre-tokenization pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this code point the character classes of all Unicode versions in use agree.
_SETTLED = re.compile("[^\x00-ԯ]")
_MOST_WORDS = 400_000
_TOGETHER = 1_000_000
_MOST_PAIRS = 500_000
_NONE = 1 << 60


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class ByteBPE:
    """A vocabulary file of the tokenizers library (model BPE, byte level) as an encoder and decoder."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, stand_in = spec["model"], _byte_chars()
        split, decoder = spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
        if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or decoder.get("type") != "ByteLevel":
            raise ValueError("only BPE models of plain byte level are supported, without a normalizer or prefix space")
        if model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError("dropout, ignored merges and marks of subwords are not supported")
        as_bytes = lambda token: bytes(stand_in[c] for c in token)
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens", [])):
            raise ValueError("special tokens that strip or match whole words are not supported")
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items() if t not in self.specials}
        self.bytes_of = [b""] * (1 + max([*self.ids.values(), *self.specials.values()]))
        for piece, i in self.ids.items():
            self.bytes_of[i] = piece
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.longest = max(map(len, self.ids))
        self.ranks: dict[int, int] = {}  # of the pair a << 32 | b
        self.merged: list[int] = []  # by rank
        for rank, pair in enumerate(model["merges"]):
            a, b = map(as_bytes, pair if isinstance(pair, list) else pair.split(" "))
            self.ranks.setdefault(self.ids[a] << 32 | self.ids[b], rank)
            self.merged.append(self.ids[a + b])
        self.single = [self.ids[bytes([b])] for b in range(256)]
        order = sorted(self.ranks.items())
        self.pair_keys = np.array([k for k, _ in order] + [1 << 62], np.int64)
        self.pair_ranks = np.array([r for _, r in order] + [_NONE], np.int64)
        self.merged_ids = np.array(self.merged, np.int64)
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.special_split = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.split_words = regex.compile(PATTERN).findall
        self.exact_words = 0

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest-ranked adjacent pair first, the leftmost of equals."""
        ids = [self.single[b] for b in word]
        if len(ids) > 256:
            return self._merge_long(ids)
        rank_of = self.ranks.get
        ranks = [rank_of(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != _NONE:
            k = ranks.index(best)
            ids[k : k + 2] = [self.merged[best]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank_of(ids[k - 1] << 32 | ids[k], _NONE)
            if k < len(ranks):
                ranks[k] = rank_of(ids[k] << 32 | ids[k + 1], _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for long words, with a heap over a linked list: n log n."""
        import heapq

        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(self.ranks[a << 32 | b], k, a, b) for k, (a, b) in enumerate(zip(ids, ids[1:])) if a << 32 | b in self.ranks]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            j = after[k] if alive[k] else n
            if j >= n or ids[k] != a or ids[j] != b:
                continue
            ids[k], alive[j], after[k] = self.merged[rank], False, after[j]
            if after[j] < n:
                before[after[j]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < n and (key := ids[left] << 32 | ids[right]) in self.ranks:
                    heapq.heappush(heap, (self.ranks[key], left, ids[left], ids[right]))
        return [i for i, x in zip(ids, alive) if x]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], _NONE)

    def merge_many(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Exact merging of many words at once: in each step every word that still can merges its first pair of lowest rank."""
        out: list[tuple[int, ...]] = [()] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for k in np.flatnonzero(lengths > 48).tolist():  # the same merges, one word at a time, for a matrix of long rows is mostly empty
            out[k] = tuple(self.merge(words[k]))
        order = np.flatnonzero((lengths > 0) & (lengths <= 48))
        order = order[np.argsort(lengths[order], kind="stable")]
        single = np.array(self.single, np.int64)
        for part in np.array_split(order, max(1, len(order) // 2000)):
            if not len(part):
                continue
            width = int(lengths[part].max())
            inside = np.arange(width) < lengths[part][:, None]
            ids = np.full((len(part), width), -1, np.int64)
            ids[inside] = single[np.frombuffer(b"".join(words[k] for k in part), np.uint8)]
            ranks = np.full((len(part), width), _NONE, np.int64)
            ranks[:, :-1] = self._rank(ids[:, :-1], ids[:, 1:])
            final = ids.copy()
            live, columns = np.arange(len(part)), np.arange(width)
            while True:
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(at)), at]
                more = best != _NONE
                if not more.all():
                    final[live[~more]] = ids[~more]
                    live, ids, ranks, at, best = live[more], ids[more], ranks[more], at[more], best[more]
                if not len(live):
                    break
                rows = np.arange(len(live))
                ids[rows, at] = self.merged_ids[best]
                shift = np.minimum(columns + (columns > at[:, None]), width - 1)
                ids = np.take_along_axis(ids, shift, axis=1)
                ids[:, -1] = -1
                ranks = np.take_along_axis(ranks, np.minimum(columns + (columns >= at[:, None]), width - 1), axis=1)
                ranks[:, -1] = _NONE
                after = ids[rows, np.minimum(at + 1, width - 1)]
                ranks[rows, at] = np.where(at + 1 < width, self._rank(ids[rows, at], after), _NONE)
                before = np.maximum(at - 1, 0)
                ranks[rows, before] = np.where(at > 0, self._rank(ids[rows, before], ids[rows, at]), ranks[rows, before])
            for k, row in zip(part.tolist(), final.tolist()):
                out[k] = tuple(row[: row.index(-1)] if row[-1] < 0 else row)
        return out

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, ids, longest = [], 0, len(word), self.ids, self.longest
        while at < n:
            end = min(n, at + longest)
            while (i := ids.get(word[at:end])) is None:
                end -= 1
            out.append(i)
            at = end
        return out

    def learn(self, words: list[str]) -> None:
        """Encode words that the table lacks: speculate, verify all pairs at once, merge only the failing words."""
        raw = [w.encode() for w in words]
        proposed = [self.propose(w) for w in raw]
        lengths = np.fromiter(map(len, proposed), np.int64, len(words))
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        inside = owner[1:] == owner[:-1]
        keys = (flat[:-1] << 32 | flat[1:])[inside]
        unique, where = np.unique(keys, return_inverse=True)
        if len(self.pairs) > _MOST_PAIRS:
            self.pairs.clear()
        known = self.pairs
        fresh = [key for key in unique.tolist() if key not in known]
        joined = self.merge_many([self.bytes_of[key >> 32] + self.bytes_of[key & 0xFFFFFFFF] for key in fresh])
        known.update((key, merged == (key >> 32, key & 0xFFFFFFFF)) for key, merged in zip(fresh, joined))
        good = np.fromiter((known[key] for key in unique.tolist()), bool, len(unique))
        failed = np.zeros(len(words), bool)
        failed[owner[1:][inside][~good[where]]] = True
        self.words.update((words[k], tuple(proposed[k])) for k in np.flatnonzero(~failed).tolist())
        again = np.flatnonzero(failed).tolist()
        self.words.update(zip([words[k] for k in again], self.merge_many([raw[k] for k in again])))
        self.exact_words += int(failed.sum())

    def pieces(self, text: str) -> list[str]:
        if _SETTLED.search(text):  # newer letters: the library's own rule decides
            from tokenizers.pre_tokenizers import ByteLevel

            splitter = ByteLevel(add_prefix_space=False)
            return [text[a:b] for _, (a, b) in splitter.pre_tokenize_str(text)]
        return self.split_words(text)

    def know(self, words: set[str]) -> None:
        """Have all these words in the table; of a full table only the words just asked for are kept."""
        new = list(words.difference(self.words))
        if len(self.words) + len(new) > _MOST_WORDS:
            self.words = {w: self.words[w] for w in words if w in self.words}
        if new:
            self.learn(new)

    def split(self, text: str) -> list[list[str] | int]:
        """The text's stretches of words, and the special tokens between them."""
        if not any(s in text for s in self.specials):
            return [self.pieces(text)]
        out, at = [], 0
        for m in self.special_split.finditer(text):
            out += [self.pieces(text[at : m.start()]), self.specials[m[0]]]
            at = m.end()
        return [*out, self.pieces(text[at:])]

    def encode_many(self, texts: list[str]) -> Iterator[list[int]]:
        """Encode texts; the new words of up to _TOGETHER characters of texts are learnt together."""
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= _TOGETHER):
                size += len(texts[stop])
                stop += 1
            parts = [self.split(t) for t in texts[at:stop]]
            self.know(set(chain.from_iterable(p for part in parts for p in part if not isinstance(p, int))))
            get = self.words.__getitem__
            for part in parts:
                yield list(chain.from_iterable((p,) if isinstance(p, int) else chain.from_iterable(map(get, p)) for p in part))
            at = stop

    def encode(self, text: str) -> list[int]:
        return next(self.encode_many([text]))

    def forget(self) -> None:
        self.words, self.pairs = {}, {}
        settle()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> ByteBPE:
    """One encoder a Python worker and vocabulary file."""
    return ByteBPE(path)


def encode(df: DataFrame, path: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, ``ids`` array<int>, ``decoded`` string (of the ids) of every row. No shuffle; one row in, one out."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        bpe = load(path)
        rows = list(bpe.encode_many([t or "" for t in batch.column(len(keep)).to_pylist()]))
        yield {c: batch.column(k) for k, c in enumerate(keep)} | {"ids": rows, "decoded": [bpe.decode(r) for r in rows]}

    return map_batches(df.select(*keep, text), run, f"{schema}{', ' * bool(schema)}ids array<int>, decoded string", lambda: load(path).forget())


def digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: encode, decode and digest in one pass of each batch."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        bpe = load(path)
        n, hashed, decoded = [], [], []
        for ids in bpe.encode_many([t or "" for t in batch.column(1).to_pylist()]):
            n.append(len(ids))
            hashed.append(hashlib.sha256(",".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
            decoded.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        yield {"doc_id": batch.column(0), "n_tokens": n, "ids_sha256": hashed, "decoded_sha256": decoded}

    return map_batches(df.select("doc_id", "text"), run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: load(path).forget())
