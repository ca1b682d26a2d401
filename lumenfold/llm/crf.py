"""Language identification by a linear-chain conditional random field over words.

Each word (a run of letters, lower-cased) has affix, character n-gram and lexicon (whole word)
features, hashed to `BUCKETS` weights for each language; transitions between the languages of
neighbouring words are learned with them. Forward-backward gives each word's distribution, so texts
that switch languages get their words labelled apart; a text's language is the one with the
largest mean share. Chains are `CHAIN` words long and cover the whole text, so texts of any length
cost memory in proportion to a batch.

The languages are all those that a text of the training documents has; each has rows in the fit, however few its distinct
texts and however many rows repeat. The field is fitted on about `SAMPLE_DOCS` distinct documents, and on `LANG_DOCS` of each
language at least, if it has so many, by stochastic gradient steps on the
chains' likelihood; a third of the training chains is spliced from two documents, since the
transitions must see switches.

Defined cases: null texts and texts without a letter are "und" with score 0; without any training
row every text is; of equal shares the language that sorts first wins; repeated rows are predicted
alike; texts of any length are read whole, numerals such as ½ are no letters; an empty table gives an
empty result; language, source and id are never inputs; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Documents, about, that the field is fitted on, besides those that rare languages add.
SAMPLE_DOCS = 1_500
#: Documents that each language gives to the fit at least, if it has so many.
LANG_DOCS = 50
CHAIN = 64
BUCKETS = 1 << 16
UNDETERMINED = "und"

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text in small letters; numerals such as ½ or Ⅷ, which the pattern takes as well, part them."""
    found = _LETTERS.findall(text.lower()) if text else []
    if all(w.isascii() or w.isalpha() for w in found):
        return found
    return [part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()]


_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def _bucket(x: np.ndarray, kind: int) -> np.ndarray:
    """A bucket for each number, apart for each kind of feature."""
    x = (x + np.uint64(kind)) * _MIX
    x ^= x >> np.uint64(29)
    return ((x * _STEPS[0]) >> np.uint64(64 - 16)).astype(np.int64) % BUCKETS


def features(words: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Hashed features of words: one row for each word (itself, beginnings, ends), and its n-grams as
    (buckets, where each word's begin). Words stand between marks, so each has n-grams of 2 and 3.
    """
    points = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    place = np.arange(len(points)) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max(initial=1)), _STEPS[1], np.uint64))
    whole = np.add.reduceat(points * powers[place], starts)
    rows = [_bucket(whole, 1)]
    for n in (2, 3, 4):
        first = last = np.zeros(len(words), np.uint64)
        for i in range(n):  # a shorter word gives what it has
            inside = lengths > i
            first = first * _STEPS[2] + np.where(inside, points[np.minimum(starts + i, ends - 1)], 0).astype(np.uint64)
            last = last * _STEPS[3] + np.where(inside, points[np.maximum(ends - 1 - i, starts)], 0).astype(np.uint64)
        rows += [_bucket(first, 10 + n), _bucket(last, 20 + n)]
    grams = []
    for n in (2, 3):
        x = points[: len(points) - n + 1]
        for i in range(1, n):
            x = x * _STEPS[2] + points[i : len(points) - n + 1 + i]
        own = place[: len(points) - n + 1] + n <= np.repeat(lengths, lengths)[: len(points) - n + 1]
        counts = lengths - n + 1
        grams.append((_bucket(x[own], 30 + n), np.cumsum(counts) - counts))
    return np.stack(rows, axis=1), grams


class Field:
    CACHE = 200_000

    def __init__(self, labels: list[str]):
        self.labels = labels
        k = len(labels)
        self.weights = np.zeros((BUCKETS, k), np.float32)
        self.step, self.start = np.zeros((k, k)), np.zeros(k)
        self.known: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "rows": []}

    def marginals(self, emission: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Word distributions of chains: emission (chain, place, label) in logs, mask of real places (a prefix of each chain)."""
        alpha, beta, _ = self._passes(emission, mask)
        p = alpha * beta
        return p / np.maximum(p.sum(axis=2, keepdims=True), 1e-300)

    def _passes(self, emission: np.ndarray, mask: np.ndarray):
        n, length, k = emission.shape
        e = np.exp(emission - emission.max(axis=2, keepdims=True))
        move = np.exp(self.step - self.step.max())
        alpha, beta = np.empty((n, length, k)), np.ones((n, length, k))
        a = np.exp(self.start - self.start.max()) * e[:, 0]
        alpha[:, 0] = a / a.sum(axis=1, keepdims=True)
        for t in range(1, length):
            a = (alpha[:, t - 1] @ move) * e[:, t]
            alpha[:, t] = a / np.maximum(a.sum(axis=1, keepdims=True), 1e-300)
        for t in range(length - 2, -1, -1):
            b = (beta[:, t + 1] * e[:, t + 1]) @ move.T
            b /= np.maximum(b.sum(axis=1, keepdims=True), 1e-300)
            beta[:, t] = np.where(mask[:, t + 1, None], b, 1)
        return alpha, beta, (e, move)

    def fit(self, chains: list[tuple[list[str], list[int]]], epochs: int = 3, block: int = 128, rate: float = 0.3) -> None:
        """Adagrad on the likelihood of labelled chains."""
        index: dict[str, int] = {}
        for words, _ in chains:
            for w in words:
                index.setdefault(w, len(index))
        rows, grams = features(list(index))
        owner_of = np.concatenate([np.repeat(np.arange(len(index)), rows.shape[1]), *[np.repeat(np.arange(len(index)), np.diff([*at, len(h)])) for h, at in grams]])
        order = np.argsort(owner_of, kind="stable")
        flat = np.concatenate([rows.ravel(), *[h for h, _ in grams]])[order]
        lengths = np.bincount(owner_of, minlength=len(index))
        begin = np.concatenate([[0], np.cumsum(lengths)])
        k = len(self.labels)
        g_w, g_s, g_0 = np.full((BUCKETS, k), 1e-6), np.full((k, k), 1e-6), np.full(k, 1e-6)
        random, onehot = np.random.default_rng(0), np.eye(k)
        for _ in range(epochs):
            order = random.permutation(len(chains))
            for at in range(0, len(order), block):
                mine = [chains[i] for i in order[at : at + block]]
                types = np.full((len(mine), CHAIN), -1)
                gold = np.zeros((len(mine), CHAIN), np.int64)
                for i, (words, labels) in enumerate(mine):
                    types[i, : len(words)] = [index[w] for w in words]
                    gold[i, : len(words)] = labels
                mask = types >= 0
                used, where = np.unique(types[mask], return_inverse=True)
                spans = np.concatenate([np.arange(begin[u], begin[u + 1]) for u in used])
                owner = np.repeat(np.arange(len(used)), lengths[used])
                scores = np.stack([np.bincount(owner, self.weights[flat[spans], j], len(used)) for j in range(k)], axis=1)
                emission = np.zeros((*types.shape, k))
                emission[mask] = scores[where]
                alpha, beta, (e, move) = self._passes(emission, mask)
                p = alpha * beta
                p /= np.maximum(p.sum(axis=2, keepdims=True), 1e-300)
                diff = np.where(mask[..., None], p - onehot[gold], 0)
                d_types = np.stack([np.bincount(where, diff[mask][:, j], len(used)) for j in range(k)], axis=1)
                d_w = np.stack([np.bincount(flat[spans], d_types[owner, j], BUCKETS) for j in range(k)], axis=1) / len(mine)
                pair = alpha[:, :-1, :, None] * move[None, None] * (e * beta)[:, 1:, None, :]
                pair /= np.maximum(pair.sum(axis=(2, 3), keepdims=True), 1e-300)
                both = mask[:, 1:]
                d_s = pair[both].sum(axis=0)
                np.add.at(d_s, (gold[:, :-1][both], gold[:, 1:][both]), -1)
                d_s, d_0 = d_s / len(mine), diff[:, 0].mean(axis=0)
                g_w += d_w**2
                g_s += d_s**2
                g_0 += d_0**2
                self.weights -= (rate * d_w / np.sqrt(g_w)).astype(np.float32)
                self.step -= rate * d_s / np.sqrt(g_s)
                self.start -= rate * d_0 / np.sqrt(g_0)

    def _emissions(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.CACHE:
            self.known, self.rows = {}, []
        known = self.known
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        if fresh:
            at = len(known)
            for i, w in enumerate(fresh):
                known[w] = at + i
            for a in range(0, len(fresh), 20_000):
                rows, grams = features(fresh[a : a + 20_000])
                out = self.weights[rows].sum(axis=1)
                for hashes, begin in grams:
                    out += np.add.reduceat(self.weights[hashes], begin, axis=0)
                self.rows.append(out)
            self.rows = [np.concatenate(self.rows)]
        return self.rows[0][np.fromiter((known[w] for w in words), np.int64, len(words))]

    def shares(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The mean distribution over languages of each text's words; None for texts without letters."""
        out: list[np.ndarray | None] = [None] * len(texts)
        pending: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            chains = [(i, words[a : a + CHAIN]) for i, words in pending for a in range(0, len(words), CHAIN)]
            for at in range(0, len(chains), 4_000):
                part = chains[at : at + 4_000]
                lengths = np.array([len(w) for _, w in part])
                mask = np.arange(CHAIN)[None] < lengths[:, None]
                emission = np.zeros((len(part), CHAIN, len(self.labels)))
                emission[mask] = self._emissions([w for _, ws in part for w in ws])
                sums = np.where(mask[..., None], self.marginals(emission, mask), 0).sum(axis=1)
                for (i, _), s in zip(part, sums):
                    out[i] = s if out[i] is None else out[i] + s
            pending.clear()

        for i, t in enumerate(texts):
            words = words_of(t)
            if words:
                pending.append((i, words))
                size += len(words)
            if size > 150_000:
                flush()
                size = 0
        flush()
        return [None if s is None else s / s.sum() for s in out]


def training_chains(rows: list[tuple[str, int]], seed: int = 0) -> list[tuple[list[str], list[int]]]:
    random = np.random.default_rng(seed)
    chains = []
    for text, label in rows:
        words = words_of(text)
        chains += [(words[a : a + CHAIN], [label] * len(words[a : a + CHAIN])) for a in range(0, len(words), CHAIN)]
    if not chains:
        return []
    mixed = []
    for i in random.permutation(len(chains))[: len(chains) // 3]:
        (a, la), (b, lb) = chains[i], chains[int(random.integers(len(chains)))]
        x, y = int(random.integers(1, CHAIN // 2 + 1)), int(random.integers(1, CHAIN // 2 + 1))
        mixed.append((a[:x] + b[:y], la[:x] + lb[:y]))
    return chains + mixed


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """A field for every language that a text outside of the held-out third has.

    It is fitted on about sample_docs distinct documents, dealt to the languages by their distinct texts, and on
    LANG_DOCS of each at least (all of them if there are no more); one document, however often it is repeated, is enough.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out(3, 1)).select("text", "lang")
    rows = sorted((r["text"], r["lang"]) for r in common.sample_of_each(usable, "lang", sample_docs, LANG_DOCS, F.octet_length("text")).collect())
    labels = sorted({lang for _, lang in rows})
    field = Field(labels)
    chains = training_chains([(t, labels.index(lang)) for t, lang in rows])
    if len(labels) > 1 and chains:
        field.fit(chains)
    return field


def predict(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, lang_pred and score of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shares = field.shares(b.column(1).to_pylist()) if field.labels else [None] * b.num_rows
            best = [(UNDETERMINED, 0.0) if s is None else (field.labels[int(s.argmax())], float(min(1.0, s.max()))) for s in shares]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in best], pa.string()), pa.array([y for _, y in best], pa.float64())], ["doc_id", "lang_pred", "score"])

    return common.map_texts(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def label_words(field: Field, text: str) -> list[tuple[str, str]]:
    """Each word of a text with its most probable language."""
    words = words_of(text)
    out = []
    for a in range(0, len(words), CHAIN):
        part = words[a : a + CHAIN]
        p = field.marginals(field._emissions(part)[None].astype(float), np.ones((1, len(part)), bool))[0]
        out += [(w, field.labels[int(x.argmax())]) for w, x in zip(part, p)]
    return out


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = predict(docs, train(docs))
    return found.select("doc_id", common.held_out(3, 1).alias("held_out"), "lang_pred", "score")
