"""Byte-level BPE encoding of a corpus: speculate and verify.

A document is cut at whitespace into pieces the tokenizer's pattern never looks across, so equal pieces have equal
ids wherever they stand and a worker encodes each distinct piece once. Of a new word, greedy longest match proposes tokens. A
proposal is the exact encoding if every token is what its own bytes encode to and every adjacent pair is compatible: no
merge across the boundary would have come before the merges that made the two tokens. All pairs of a
batch are tested in lock-step with array operations, undoing the later merge of each pair until only bytes are left. Only
words with a failing test go through exact merging.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary files of the public tokenizers are; a parameter of every operator.
TOKENIZERS = "/opt/tokenizers"

#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A run of whitespace and what follows it. A match of the pattern always begins where such a run begins.
_PIECE = re.compile(r"\s*\S+|\s+")

#: A worker's memory of pieces and pairs is emptied beyond these; nothing but speed depends on it.
KNOWN_PIECES, KNOWN_IDS, KNOWN_PAIRS = 400_000, 4_000_000, 2_000_000

#: Pieces encoded before a result batch is handed on.
FLUSH_PIECES = 400_000

_NONE = np.iinfo(np.int64).max


def _byte_of_char() -> dict[str, int]:
    """The byte each character of the vocabulary file stands for: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges of a byte-level BPE file, by id: ids below 256 are bytes, later ones merges in order of rank."""

    def __init__(self, file: str) -> None:
        with open(file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of, ids = _byte_of_char(), model["vocab"]
        self.id_of = {bytes(byte_of[c] for c in t): i for t, i in ids.items() if all(c in byte_of for c in t)}
        n = max(self.id_of.values()) + 1
        self.left, self.right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)
        self.rank: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            t = ids[a + b]
            self.left[t], self.right[t] = ids[a], ids[b]
            self.rank[ids[a], ids[b]] = t
        self.size = n
        made = np.array(list(self.rank.values()), dtype=np.int64)
        key = self.left[made] * n + self.right[made]
        order = np.argsort(key)
        self._keys, self._made = key[order], made[order]
        self.byte_id = [self.id_of[bytes([b])] for b in range(256)]
        self.longest = [0] * 256
        for t in self.id_of:
            self.longest[t[0]] = max(self.longest[t[0]], len(t))
        # a token is sound if its own bytes encode to it: its parts are, and nothing crosses their boundary earlier
        self.sound = np.ones(n, dtype=bool)
        self.sound[made] = self.compatible(self.left[made], self.right[made], made)
        for t in sorted(made.tolist()):
            self.sound[t] &= self.sound[self.left[t]] and self.sound[self.right[t]]

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token each pair merges to, or a number above all tokens."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._made[at], _NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether the merges leave each pair apart, of merges before ``limit`` (all where not given)."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), _NONE) if limit is None else limit.astype(np.int64)
        good = np.ones(len(a), dtype=bool)
        at = np.arange(len(a))
        while len(at):
            crossed = self.merged(a[at], b[at]) < limit[at]
            good[at[crossed]] = False
            at = at[~crossed]
            x, y = a[at], b[at]
            later_left = x > y
            whole = np.maximum(x, y) >= 256
            limit[at] = np.where(later_left, x, y + 1)
            a[at] = np.where(later_left, self.right[x], x)
            b[at] = np.where(later_left, y, self.left[y])
            at = at[whole]
        return good

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, i, n, ids, longest = [], 0, len(word), self.id_of, self.longest
        while i < n:
            j = min(n, i + longest[word[i]])
            while (t := ids.get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact encoding: lowest rank first, leftmost of equals; a heap over linked parts."""
        parts = [self.byte_id[b] for b in word]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        heap = [(t, i, i + 1) for i in range(n - 1) if (t := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            t, i, j = heapq.heappop(heap)
            if parts[i] < 0 or after[i] != j or j >= n or rank.get((parts[i], parts[j])) != t:
                continue
            parts[i], parts[j] = t, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (u := rank.get((t, parts[k]))) is not None:
                    heapq.heappush(heap, (u, i, k))
            if (h := before[i]) >= 0 and (u := rank.get((parts[h], t))) is not None:
                heapq.heappush(heap, (u, h, i))
        return [p for p in parts if p >= 0]


class Encoder:
    """Encodes texts with a worker's memory of pieces, words and pairs."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self._find = regex.compile(PATTERN).findall
        self._pairs, self._pair_good = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        self.exact_words = self.new_words = 0
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, list[int]] = {}
        self.piece: dict[str, int] = {}
        self.length = np.zeros(1024, dtype=np.int64)
        self.start = np.zeros(1024, dtype=np.int64)
        self.flat = np.zeros(4096, dtype=np.int32)
        self.held = 0

    def _pair_test(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key, back = np.unique(a * self.v.size + b, return_inverse=True)
        at = np.searchsorted(self._pairs, key)
        known = np.zeros(len(key), dtype=bool)
        inside = at < len(self._pairs)
        known[inside] = self._pairs[at[inside]] == key[inside]
        new = key[~known]
        good = np.empty(len(key), dtype=bool)
        good[known] = self._pair_good[at[known]]
        if len(new):
            good[~known] = tested = self.v.compatible(new // self.v.size, new % self.v.size)
            if len(self._pairs) > KNOWN_PAIRS:
                self._pairs, self._pair_good = new, tested
            else:
                pairs, flags = np.concatenate([self._pairs, new]), np.concatenate([self._pair_good, tested])
                order = np.argsort(pairs)
                self._pairs, self._pair_good = pairs[order], flags[order]
        return good[back]

    def learn_words(self, words: list[str]) -> None:
        """Encode words not met before: propose all, test all pairs at once, merge what fails."""
        raw = [w.encode("utf-8", "replace") for w in words]
        proposals = [self.v.propose(w) for w in raw]
        sizes = np.array([len(p) for p in proposals], dtype=np.int64)
        flat = np.array([t for p in proposals for t in p], dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        bad = np.zeros(len(words), dtype=bool)
        bad[owner[~self.v.sound[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        bad[owner[inner[~self._pair_test(flat[inner], flat[inner + 1])]]] = True
        for i in np.flatnonzero(bad).tolist():
            proposals[i] = self.v.merge(raw[i])
        self.exact_words += int(bad.sum())
        self.new_words += len(words)
        self.words.update(zip(words, proposals))

    def learn_pieces(self, pieces: list[str]) -> None:
        cut = [self._find(p) for p in pieces]
        new = {w for words in cut for w in words if w not in self.words}
        if new:
            self.learn_words(list(new))
        known = self.words
        for piece, words in zip(pieces, cut):
            ids = known[words[0]] if len(words) == 1 else [t for w in words for t in known[w]]
            code, n = len(self.piece), len(ids)
            if code >= len(self.length):
                self.length, self.start = np.resize(self.length, 2 * code), np.resize(self.start, 2 * code)
            if self.held + n > len(self.flat):
                self.flat = np.resize(self.flat, 2 * (self.held + n))
            self.flat[self.held : self.held + n] = ids
            self.start[code], self.length[code] = self.held, n
            self.held += n
            self.piece[piece] = code

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all pieces of all texts, and the number of pieces of each text."""
        if len(self.piece) > KNOWN_PIECES or self.held > KNOWN_IDS:
            self._forget()
        pieces: list[str] = []
        counts = np.empty(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            found = _PIECE.findall(text) if text else ()
            counts[i] = len(found)
            pieces += found
        new = set(pieces).difference(self.piece)
        if new:
            self.learn_pieces(list(new))
        return np.fromiter(map(self.piece.__getitem__, pieces), np.int64, len(pieces)), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of the texts in them."""
        codes, counts = self.codes(texts)
        lengths = self.length[codes]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.start[codes] - (ends - lengths), lengths)]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.concatenate([[0], ends])[bounds]

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        codes, counts = self.codes(texts)
        ends = np.concatenate([[0], np.cumsum(self.length[codes])])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return np.diff(ends[bounds])


@lru_cache(maxsize=4)
def encoder(file: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    return Encoder(Vocabulary(file))


def vocabulary_file(name: str, root: str = TOKENIZERS) -> str:
    """The file of a public tokenizer."""
    return os.path.join(root, f"{name}.json")


def _slices(texts: list[str | None]) -> Iterator[slice]:
    """Runs of texts of bounded size; a text longer than that is a run of its own."""
    start = held = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if held and held + n > 4 * FLUSH_PIECES:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(texts):
        yield slice(start, len(texts))


def _encode_batches(file: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in _slices(texts):
                ids, offsets = enc.encode(texts[part])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in keep), lists], names=[*keep, "ids"])

    return run


def _count_batches(file: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(file)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in _slices(texts):
                rows = batch.slice(part.start, part.stop - part.start)
                counts = pa.array(enc.count(texts[part]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in keep), counts], names=[*keep, "n_tokens"])

    return run


def _with(docs: DataFrame, keep: tuple[str, ...], column: str) -> str:
    return ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), column])


def encode(docs: DataFrame, tokenizer: str = "byte_bpe_50k", root: str = TOKENIZERS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``ids``: the ids of every text, without special tokens (their strings are ordinary text).

    Null and empty texts have the empty list. One row per row of ``docs``, repeated ids included; the whole text is
    encoded, however long; no shuffle.
    """
    return docs.select(*keep, "text").mapInArrow(_encode_batches(vocabulary_file(tokenizer, root), list(keep)), _with(docs, keep, "ids array<int>"))


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k", root: str = TOKENIZERS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``n_tokens``: how many ids every text has; 0 for null and empty texts."""
    return docs.select(*keep, "text").mapInArrow(_count_batches(vocabulary_file(tokenizer, root), list(keep)), _with(docs, keep, "n_tokens bigint"))


def read_ranks(name: str, root: str = TOKENIZERS) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file."""
    with open(os.path.join(root, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
