"""Score documents for abusive, hateful and sexual passages with a counterfactually regularised linear classifier.

Text is read as words with disguises undone (case, look-alike letters, digits for letters, stretched, spaced, hyphenated and
masked spellings). A document's score is that of its worst window of ``WINDOW`` words, a linear function of words
and word pairs; a positive score is a finding. Training starts from hand-labelled sentences and goes on with human reviews: of a
document reviewed as abusive only its worst window is learned, and only while reader and reviewer agree at all, which leaves wrong labels out.
For every sentence with a name or a term for a group, a twin with the term swapped is made, and the square of the difference of
the two scores is part of the loss: neutral mention of a group must not count, whichever group it is.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.abuse_seeds import ABUSIVE, HARMLESS, IDENTITY_TERMS, INSULTS, LEET, LOOKALIKES, MILD, NEUTRAL, PHRASES, SCORNS
from keyloom.llm.mixing import source_key
from keyloom.session import materialize

#: Words of a window; short ones keep a brief passage from drowning in its neighbours.
WIDTHS = (10, 5, 3)

#: Reviewed documents the trainer uses at most, and the longest of them; scoring has no such bounds. Further bounds of training: ``NEUTRAL_WINDOWS``, ``WORDS``, ``HARD_OF_ONE``.
LABELLED, LABELLED_CHARS = 4000, 100_000
#: Words the trainer knows at most beyond those of the seeds, and the documents a word must be in.
WORDS, WORD_DOCS = 20_000, 2
#: Windows of reviewed neutral documents the trainer starts with, and how many of one document it adds in each round, the highest scoring ones.
NEUTRAL_WINDOWS, HARD_OF_ONE = 20_000, 8
#: Beyond ``NEAR`` a window of a neutral document is added; beyond ``WRONG`` a document's neutral review isn't believed; beyond ``LEARN`` an abusive review is.
NEAR, WRONG, LEARN = -1.2, 3.0, -1.0
#: Parts the reviews are dealt into, and rounds of dealing; the share of neutral documents with less evidence than an abusive one needs at first.
FOLDS, ROUNDS, EVIDENCE = 3, 3, 0.95
#: Weight of a window learned from an abusive document; windows that make a word telling.
FOUND_WEIGHT, TELLING = 1.5, 3

#: Score of a window of unknown words: without evidence a text is neutral, however few reviews there are.
BIAS = -2.0
#: Least weights and ridge of words, and of pairs and triples; weight of the counterfactual penalty and twins of a window.
FLOORS, RIDGES, FAIRNESS, TWINS = (-0.25, -0.8), (0.05, 0.15), 2.0, 2

#: A worker's memory of spellings is emptied beyond this.
KNOWN_SPELLINGS = 500_000

_RAW = re.compile(r"[^\s\[\]{}|=<>,;:!?()/\\“”«»„…。、！？，]+")
_SPACED = re.compile(r"(?<![^\s\[\]{}|=<>(,])[^\W_](?: [^\W_]| [@$]){2,}(?![^\s\[\]{}|=<>),.!?])")
_INVISIBLE = re.compile("[­​-‏⁠﻿]|''")
_CJK = re.compile(r"[぀-ヿ㐀-鿿々ー]+")
_QUOTED = re.compile(r"""^(?:"|''|['‘’])[^"]+?(?:"|''|['‘’])$""")
_STRETCH = re.compile(r"(.)\1{2,}")
_MASKED = re.compile(r"^([a-z]{1,4})([#*.\-_]+)([a-z]{0,4})$")
_PARTED = re.compile(r"^[^\W\d_](?:[.\-_*']+[^\W\d_]+)+$")
_LEET, _ALIKE = str.maketrans(LEET), str.maketrans(LOOKALIKES)
_EDGES = ".,'\"*_-~`^’‘&#+"


def _unaccented(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)) if not word.isascii() else word


class Reader:
    """Turns raw words into plain ones; ``strong`` are the words disguises are resolved to."""

    def __init__(self, strong: set[str]) -> None:
        self.strong = strong
        self.by_mask: dict[tuple[int, str, str], str] = {}
        for word in sorted(strong, reverse=True):
            if word.isascii() and len(word) >= 4:
                for i in range(1, min(5, len(word))):
                    for j in range(min(5, len(word) - i)):
                        self.by_mask[len(word), word[:i], word[len(word) - j :]] = word

    def _plain(self, word: str) -> str:
        if word.isdigit():
            return "9"
        if word in self.strong or (word.isalpha() and not _STRETCH.search(word)):
            return word
        for form in (_STRETCH.sub(r"\1", word), _STRETCH.sub(r"\1\1", word)):
            if form in self.strong:
                return form
        if not word.isalpha():
            for swap in ("i", "l"):
                letters = word.replace("1", swap).translate(_LEET)
                for form in (letters, _STRETCH.sub(r"\1", letters), _STRETCH.sub(r"\1\1", letters)):
                    if form in self.strong:
                        return form
            if _PARTED.match(word):
                joined = "".join(c for c in word if c.isalpha())
                for form in (joined, _STRETCH.sub(r"\1", joined)):
                    if form in self.strong:
                        return form
            masked = _MASKED.match(word)
            if masked and (found := self.by_mask.get((len(word), masked[1], masked[3]))):
                return found
        return _STRETCH.sub(r"\1", word)

    def words(self, raw: str) -> list[str]:
        """The plain words of one raw word: none, one, or for scripts without spaces all character pairs."""
        if raw.isascii() and raw.isalpha() and raw.islower():
            return [self._plain(raw)]
        text = unicodedata.normalize("NFKC", raw)
        quoted = _QUOTED.match(text) is not None
        text = _INVISIBLE.sub("", text)
        runs = _CJK.findall(text)
        if runs:
            pairs = [r[i : i + 2] for r in runs for i in range(max(1, len(r) - 1))]
            rest = _CJK.sub(" ", text).split()
            return [w for r in rest for w in self.words(r)] + pairs
        text = text.strip("'\".,’‘`").lower()
        if any("a" <= c <= "z" for c in text):
            text = _unaccented(text.translate(_ALIKE))
        elif not text.isascii():
            text = text.replace("ё", "е")
        bare = text.strip(_EDGES)
        plain = self._plain(text) if text not in (bare, "") else ""
        if plain not in self.strong:
            plain = self._plain(bare) if bare else ""
        if plain.endswith("'s") or plain.endswith("’s"):
            plain = plain[:-2]
        if not plain:
            return []
        return [f"“{plain}”"] if quoted and plain in self.strong else [plain]

    @staticmethod
    def raw(text: str) -> list[str]:
        """Raw words; letters set apart by blanks are put together first."""
        return _RAW.findall(_SPACED.sub(lambda m: m[0].replace(" ", ""), text))


def _filled(words: list[str], qualities: list[str]) -> list[str]:
    """Every word in every phrase, the qualities taken in turn."""
    return [p.replace("{w}", w).replace("{a}", qualities[(i + j) % len(qualities)]) for i, w in enumerate(words) for j, p in enumerate(PHRASES)]


def _abusive_seeds() -> list[str]:
    return ABUSIVE + _filled(INSULTS, SCORNS)


def _neutral_seeds() -> list[str]:
    return NEUTRAL + _filled(HARMLESS, MILD)


def _seed_reader() -> Reader:
    plain = Reader(set())
    common = Counter(w for s in NEUTRAL for r in plain.raw(s) for w in plain.words(r))
    strong = {w for s in _abusive_seeds() for r in plain.raw(s.replace("{n}", "")) for w in plain.words(r) if len(w) >= 3 and common[w] < 2}
    return Reader(strong)


class Model:
    """Weights of words, pairs and triples of words; picklable, sent to the workers with the task."""

    def __init__(self, reader: Reader, ids: dict[str, int], names: np.ndarray) -> None:
        self.reader, self.ids, self.size = reader, ids, len(ids) + 1
        #: What a word is in pairs and triples: itself, or 0 (like unknown words) if it is a name.
        self.kind = np.where(names, 0, np.arange(self.size))
        self.single, self.keys, self.weights = np.zeros(self.size), np.zeros(0, dtype=np.int64), np.zeros(0)
        self.bias = BIAS
        self.forget()

    def forget(self) -> None:
        self._code: dict[str, int] = {}
        self._start, self._length, self._flat = [], [], []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_code": {}, "_start": [], "_length": [], "_flat": []}

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids (0: unknown) of all texts and the offsets of the texts in them."""
        if len(self._code) > KNOWN_SPELLINGS:
            self.forget()
        raw: list[str] = []
        counts = np.empty(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            found = Reader.raw(text) if text else []
            counts[i] = len(found)
            raw += found
        for word in set(raw).difference(self._code):
            ids = [self.ids.get(w, 0) for w in self.reader.words(word)]
            self._code[word] = len(self._start)
            self._start.append(len(self._flat))
            self._length.append(len(ids))
            self._flat += ids
        codes = np.fromiter(map(self._code.__getitem__, raw), np.int64, len(raw))
        lengths = np.array(self._length, dtype=np.int64)[codes] if len(codes) else np.zeros(0, dtype=np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(np.array(self._start, dtype=np.int64)[codes] - (ends - lengths), lengths) if total else np.zeros(0, dtype=np.int64)
        ids = np.array(self._flat, dtype=np.int64)[np.arange(total) + at] if total else np.zeros(0, dtype=np.int64)
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]

    def grams(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the pair and of the triple that end at every word, -1 where there is none; keys of singles are the ids, below all of these."""
        kind, size = self.kind[ids], self.size
        pair, triple = np.full(len(ids), -1), np.full(len(ids), -1)
        pair[1:] = (kind[:-1] + 1) * size + kind[1:]
        triple[2:] = size * (size + 1) + pair[1:-1] * size + kind[2:]
        return pair, triple

    def _weight(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.weights[at], 0.0)

    def learn(self, keys: np.ndarray, weights: np.ndarray) -> None:
        """Take over the weights of sorted keys."""
        at = int(np.searchsorted(keys, self.size))
        self.single = np.zeros(self.size)
        self.single[keys[:at]] = weights[:at]
        kept = np.abs(weights[at:]) > 0.02
        self.keys, self.weights = keys[at:][kept], weights[at:][kept]

    def window_scores(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest score of the windows ending at every word, and the width of that window."""
        pair, triple = self.grams(ids)
        totals = [np.concatenate([[0.0], np.cumsum(w)]) for w in (self.single[ids], self._weight(pair), self._weight(triple))]
        end = np.arange(len(ids))
        first = np.repeat(offsets[:-1], np.diff(offsets))
        best, width_of = np.full(len(ids), -np.inf), np.zeros(len(ids), dtype=np.int64)
        for width in WIDTHS:
            start = np.maximum(end - width + 1, first)
            # a pair counts if it begins within the window, so its last word is one further, and so on
            found = sum(t[end + 1] - t[np.minimum(start + i, end + 1)] for i, t in enumerate(totals))
            better = found > best
            best, width_of = np.where(better, found, best), np.where(better, end - start + 1, width_of)
        return best + self.bias, width_of

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The worst window's score per text; texts without words score the bias alone."""
        ids, offsets = self.read(texts)
        out = np.full(len(texts), self.bias)
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            out[full] = np.maximum.reduceat(self.window_scores(ids, offsets)[0], offsets[:-1][full])
        return out


class Trainer:
    """Fits ``model`` to windows of words; ``identity`` marks the words whose swap must not matter."""

    def __init__(self, model: Model, identity: np.ndarray) -> None:
        self.model, self.identity = model, identity
        self.terms = np.concatenate([np.flatnonzero(identity), [0]])

    def features(self, flat: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and keys of all words, pairs and triples of windows laid end to end."""
        pair, triple = self.model.grams(flat)
        two, three = np.flatnonzero(row[1:] == row[:-1]) + 1, np.flatnonzero(row[2:] == row[:-2]) + 2
        return np.concatenate([row, row[two], row[three]]), np.concatenate([flat, pair[two], triple[three]])

    def fit(self, flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps: int = 100) -> None:
        """Logistic regression with the counterfactual penalty; full-batch Adam. The windows' words lie end to end in ``flat``.

        Only what positive windows hold can carry weight. What speaks for abuse is unbounded, what speaks against
        it is held above ``FLOORS``, so that no neutral neighbours outweigh a passage.
        """
        rng, size, n = np.random.default_rng(7), self.model.size, len(sizes)
        row = np.repeat(np.arange(n), sizes)
        rows, keys = self.features(flat, row)
        known = np.unique(keys[labels[rows] == 1])
        known = known[known > 0]  # unknown words carry no weight
        dead = len(known)

        def column(keys: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(known, keys), dead - 1)
            return np.where(known[at] == keys, at, dead)

        columns = column(keys)
        gaps = []
        for _ in range(TWINS):  # the twins of a window: its names and group terms swapped for others, or for an unknown name
            twin = np.where(self.identity[flat], rng.choice(self.terms, len(flat)), flat)
            other = column(self.features(twin, row)[1])
            differ = columns != other
            gaps.append((rows[differ], columns[differ], other[differ]))
        live = columns != dead
        rows, columns = rows[live], columns[live]
        floor = np.where(known < size, FLOORS[0], FLOORS[1])
        ridge = np.where(known < size, RIDGES[0], RIDGES[1])
        w, total = np.zeros(dead + 1), weights.sum()
        m1, m2 = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[columns], n) + BIAS, -30, 30)))
            g = weights * (p - labels) / total
            grad = np.bincount(columns, g[rows], dead + 1)
            grad[:dead] += ridge * w[:dead] / total
            for r, old, new in gaps:
                gap = FAIRNESS * weights * (np.bincount(r, w[old], n) - np.bincount(r, w[new], n)) / total / TWINS
                grad += np.bincount(old, gap[r], dead + 1) - np.bincount(new, gap[r], dead + 1)
            grad[dead] = 0.0
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
            w -= 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8) * min(1.0, 2 * (1 - step / (steps + 1)))
            w[:dead] = np.maximum(w[:dead], floor)
        self.model.learn(known, w[:dead])


def _document_counts(keys: np.ndarray, valid: np.ndarray, doc: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per place, how many abusive and how many neutral documents hold the key that is there."""
    at, inverse = np.unique(keys, return_inverse=True)
    of_doc = np.unique(inverse[valid] * len(labels) + doc[valid])
    gram, yes = of_doc // max(1, len(labels)), labels[of_doc % max(1, len(labels))] == 1
    return np.bincount(gram[yes], minlength=len(at))[inverse], np.bincount(gram[~yes], minlength=len(at))[inverse]


def _evidence(model: Model, ids: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word, how much more often than in neutral documents what ends there is in *other* abusive documents: (score of the window, width).

    Counting only other documents keeps a wrong review from proving itself.
    """
    doc = np.repeat(np.arange(len(labels)), np.diff(offsets))
    pair, triple = model.grams(ids)
    same = lambda k: np.concatenate([np.zeros(k, dtype=bool), doc[k:] == doc[:-k]]) if len(doc) > k else np.zeros(len(doc), dtype=bool)
    n1 = max(1, int((labels == 1).sum()))
    n0 = max(1, len(labels) - n1)
    own = labels[doc] == 1
    strongest = np.zeros(len(ids))
    for keys, valid in ((ids, ids > 0), (pair, same(1)), (triple, same(2))):
        yes, no = _document_counts(keys, valid, doc, labels)
        others = yes - own
        rate = np.log((np.maximum(others, 0) + 0.05) / n1) - np.log((no - ~own * 0.9 + 1.0) / n0) - 1.0
        # of the grams that end at a word the strongest speaks for it, so that long ones don't count thrice
        strongest = np.maximum(strongest, np.where(valid & (others >= 1), rate, 0.0))
    total = np.concatenate([[0.0], np.cumsum(strongest)])
    end, first = np.arange(len(ids)), np.repeat(offsets[:-1], np.diff(offsets))
    start = np.maximum(end - WIDTHS[0] + 1, first)
    return total[end + 1] - total[start], end - start + 1


def _rank(groups: np.ndarray) -> np.ndarray:
    """The place of every element among those of its group, in order."""
    order = np.argsort(groups, kind="stable")
    ordered = groups[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(groups) else np.zeros(0, dtype=np.int64)
    out = np.empty(len(groups), dtype=np.int64)
    out[order] = np.arange(len(groups)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(groups)]])))
    return out


class Reviews:
    """Reviewed texts as word ids, and which of their windows a model learns.

    Which words of a document the reviewer meant isn't said, and some reviews are wrong. So every document is judged by a
    model that hasn't seen it (one of ``FOLDS``, at first by ``_evidence`` of other documents): the worst window of an abusive one is
    learned if that model finds anything in it, and a neutral one that it clearly finds abusive is left out.
    """

    def __init__(self, trainer: Trainer, seeds: list[tuple[str, int]], texts: list[str], labels: np.ndarray) -> None:
        self.trainer, self.model, self.labels = trainer, trainer.model, labels
        seed_ids = [tuple(self.model.read([s])[0].tolist()) for s, _ in seeds]
        # what is neutral in a sentence is neutral in its parts
        parts = [w[i : i + 5] for w, (_, y) in zip(seed_ids, seeds) if y == 0 and len(w) > 5 for i in range(len(w) - 4)]
        rows = [(w, y, 4.0) for w, (_, y) in zip(seed_ids, seeds) if w] + [(w, 0, 2.0) for w in parts]
        self.seed_flat = np.array([i for w, _, _ in rows for i in w], dtype=np.int64)
        self.seed_sizes, self.seed_labels, self.seed_weights = (np.array(x) for x in zip(*((len(w), y, k) for w, y, k in rows)))
        self.ids, self.offsets = self.model.read(texts)
        self.fold = np.array([zlib.crc32(t.encode("utf-8", "replace")) % FOLDS for t in texts], dtype=np.int64)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.offsets))
        self.full = np.flatnonzero(np.diff(self.offsets))
        self.believed = labels == 0
        place = np.arange(len(self.ids)) - self.offsets[:-1][self.doc]
        plain = np.flatnonzero((labels[self.doc] == 0) & (place % 5 == 4))
        if len(plain) > NEUTRAL_WINDOWS:
            plain = np.sort(np.random.default_rng(11).choice(plain, NEUTRAL_WINDOWS, replace=False))
        width = np.minimum(np.array(WIDTHS)[np.arange(len(plain)) % len(WIDTHS)], place[plain] + 1)
        #: Ends and widths of neutral and of abusive windows.
        self.neutral, self.found = np.stack([plain, width]), np.zeros((2, 0), dtype=np.int64)

    def worst(self, score: np.ndarray) -> np.ndarray:
        """The highest score of every document."""
        most = np.full(len(self.labels), BIAS)
        if len(self.full):
            most[self.full] = np.maximum.reduceat(score, self.offsets[:-1][self.full])
        return most

    def pick(self, score: np.ndarray, width: np.ndarray, bar: float) -> None:
        """Take the worst window of every document reviewed as abusive that has one above ``bar``."""
        ends = [int(self.offsets[d] + np.argmax(score[self.offsets[d] : self.offsets[d + 1]])) for d in self.full[self.labels[self.full] == 1]]
        ends = np.array([e for e in ends if score[e] > bar], dtype=np.int64)
        self.found = np.stack([ends, width[ends]])

    def fit(self, without: int | None = None) -> None:
        """Fit the model to the seeds and the windows of all folds but one."""
        out = []
        for windows, right in ((self.neutral, self.believed), (self.found, self.labels == 1)):
            of = self.doc[windows[0]]
            out.append(windows[:, right[of] & (self.fold[of] != without)])
        ends, sizes = np.concatenate(out, axis=1)
        bounds = np.cumsum(sizes)
        at = np.repeat(ends - bounds + 1, sizes) + np.arange(bounds[-1] if len(bounds) else 0)
        many = [o.shape[1] for o in out]
        self.trainer.fit(
            np.concatenate([self.seed_flat, self.ids[at]]),
            np.concatenate([self.seed_sizes, sizes]),
            np.concatenate([self.seed_labels, np.zeros(many[0], dtype=int), np.ones(many[1], dtype=int)]),
            np.concatenate([self.seed_weights, np.ones(many[0]), np.full(many[1], FOUND_WEIGHT)]),
        )

    def first_guess(self) -> None:
        score, width = _evidence(self.model, self.ids, self.offsets, self.labels)
        most = self.worst(score)[self.full]
        neutral = most[self.labels[self.full] == 0]
        self.pick(score, width, max(1.0, float(np.quantile(neutral, EVIDENCE))) if len(neutral) else 1.0)

    def cross(self) -> np.ndarray:
        """Judge every document by the model of the other folds, pick windows anew; the worst score of every document."""
        score, width = np.zeros(len(self.ids)), np.ones(len(self.ids), dtype=np.int64)
        hard = [self.neutral]
        for k in range(FOLDS):
            self.fit(k)
            s, w = self.model.window_scores(self.ids, self.offsets)
            mine = self.fold[self.doc] == k
            score[mine], width[mine] = s[mine], w[mine]
            # what a neutral document still has that reads as nearly abusive to this model
            near = np.flatnonzero((s > NEAR) & self.believed[self.doc])
            near = near[np.argsort(-s[near], kind="stable")]
            near = near[_rank(self.doc[near]) < HARD_OF_ONE]
            hard.append(np.stack([near, w[near]]))
        most = self.worst(score)
        self.neutral = np.unique(np.concatenate(hard, axis=1), axis=1)
        self.believed = (self.labels == 0) & (most <= WRONG)
        self.pick(score, width, LEARN)
        return most

    def telling(self) -> set[int]:
        """Words of several picked windows that no believed neutral document has."""
        ends, sizes = self.found
        held = Counter(w for e, k in zip(ends.tolist(), sizes.tolist()) for w in set(self.ids[e - k + 1 : e + 1].tolist()))
        neutral = set(self.ids[self.believed[self.doc]].tolist())
        return {w for w, k in held.items() if w and k >= TELLING and w not in neutral}


def _threshold(most: np.ndarray, labels: np.ndarray) -> float:
    """Where documents judged by models that hadn't seen them agree best with the reviews (F1); 0 without enough reviews."""
    if (labels == 1).sum() < 2 * TELLING:
        return 0.0
    best = []
    for bar in np.arange(-1.0, 2.01, 0.25):
        hit = most > bar
        best.append((2 * (hit & (labels == 1)).sum() / max(1, hit.sum() + (labels == 1).sum()), -abs(bar - 0.5), bar))
    return float(max(best)[2])


def train(labelled: list[tuple[str, int]], rounds: int = ROUNDS) -> Model:
    """A model from the seeds and reviewed texts (text, 1 if abusive)."""
    named = lambda s: [s.replace("{n}", x) for x in (["Zzyx Qorv", "women"] if "{n}" in s else [s])]
    seeds = [(x, 1) for s in _abusive_seeds() for x in named(s)] + [(x, 0) for s in _neutral_seeds() for x in named(s)]
    texts, labels = [t for t, _ in labelled], np.array([y for _, y in labelled], dtype=np.int64)
    raw_words = [dict.fromkeys(Reader.raw(t)) for t in texts]
    reader, learned = _seed_reader(), set()
    for last in (False, True):
        read = functools.cache(reader.words)
        support, capital = Counter(), Counter()
        for raws in raw_words:
            support.update({w for r in raws for w in read(r)})
            capital.update({w for r in raws if r[:1].isupper() for w in read(r)})
        vocabulary = list(dict.fromkeys(w for s, _ in seeds for r in Reader.raw(s) for w in read(r) if w not in ("zzyx", "qorv")))
        own = len(vocabulary)
        vocabulary = list(dict.fromkeys([*vocabulary, *(w for w, k in support.most_common(WORDS) if k >= WORD_DOCS)]))
        # of the reviewed words, those mostly written with a capital are taken for names
        names = np.array([False] + [i >= own and w not in learned and capital[w] > 0.8 * support[w] for i, w in enumerate(vocabulary)])
        identity = names | np.array([False] + [w in IDENTITY_TERMS for w in vocabulary])
        model = Model(reader, {w: i + 1 for i, w in enumerate(vocabulary)}, names)
        reviews = Reviews(Trainer(model, identity), seeds, texts, labels)
        if not len(reviews.ids):
            break
        reviews.first_guess()
        for _ in range(rounds if last else 1):
            most = reviews.cross()
        if not last:
            # disguises may hide what these passages have in common, too
            learned = {vocabulary[w - 1] for w in reviews.telling() if len(vocabulary[w - 1]) >= 3}
            reader = Reader(reader.strong | learned)
    reviews.fit()
    model.bias = BIAS - (_threshold(most, labels) if len(reviews.ids) else 0.0)
    model.forget()
    return model


def labelled_texts(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """A bounded sample of reviewed documents: at most ``LABELLED``, chosen by hash, none longer than ``LABELLED_CHARS``.

    Several reviews of a document are averaged; ties, null verdicts and reviews of absent or null texts are left out.
    """
    verdicts = labels.where("abusive is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("abusive").alias("mean")).where("mean <> 0.5")
    # ids first: the texts of the chosen alone are read and sent
    chosen = materialize(verdicts.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED), "abuse-sample")
    texts = docs.select("doc_id", "text").where((F.length("text") > 0) & (F.length("text") <= LABELLED_CHARS)).join(F.broadcast(chosen), "doc_id")
    rows = texts.dropDuplicates(["doc_id"]).collect()
    return [(r.text, int(r.mean > 0.5)) for r in sorted(rows, key=lambda r: r.doc_id)]


def _score_batches(model: Model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            start = 0
            while start < len(texts):
                stop, held = start, 0
                while stop < len(texts) and (stop == start or held < 2_000_000):
                    held += len(texts[stop] or "")
                    stop += 1
                rows = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in keep), pa.array(model.scores(texts[start:stop]))], names=[*keep, "score"])
                start = stop

    return run


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``score`` of every document; positive scores are findings. The whole text is read, markup included.

    Null, empty and wordless texts get the model's bias, a negative score. One row per row of ``docs``; no shuffle.
    """
    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), "score double"])
    return docs.select(*keep, "text").mapInArrow(_score_batches(model, list(keep)), schema)


def rates(scored: DataFrame) -> DataFrame:
    """``source`` (without case and blanks, null where there is none), ``n_docs``, ``n_abusive``, ``rate``."""
    found = F.count_if(F.col("score") > 0)
    return scored.groupBy(source_key(F.col("source")).alias("source")).agg(
        F.count(F.lit(1)).alias("n_docs"), found.alias("n_abusive"), (found / F.count(F.lit(1))).alias("rate")
    )
