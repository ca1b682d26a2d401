"""Language-model scores: the marginal likelihood of the lattice of all segmentations into pieces.

An existing piece vocabulary gives the lattice of a word and the prior weights of its arcs; the
forward recursion in log space sums all paths. Scores in files of the BPE kind are merge ranks, so
they become probabilities by Zipf's law, 1 / (rank + 10); those of unigram files are used as they
are. The weights then take one step of expectation maximisation over the words of all training
documents (forward-backward, by word counts), with the prior as pseudo-counts. A text's probability
is that of its words, each after a space, and of one end.

The recursion runs over blocks of words of like length in numpy. Each distinct word of the corpus
is scored once, in the word table (word, count in training, score). Documents meet that table in
two ways, which give the same sums: at most `HEAVY_WORDS` frequent words are sent to the tasks (of those
of over `LONG` bytes a digest), so the others, which are joined by a shuffle, are each a small share. What is gathered are the counts of all words of all documents.

Defined cases: null and empty texts have only the end; with no training document all counts are 0;
words and texts of any length are whole; of equally frequent words all or none are sent, to the same result; repeated rows each get their score; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pieces import NORMAL, SPACE, UNIGRAM, USER_DEFINED, PieceMachine, Vocabulary, blocks

#: Frequent words sent to every task, at most; of words of over LONG bytes a digest is sent.
HEAVY_WORDS = 100_000
LONG = 64
PRIOR = 1_000.0
END = b"\n"
CELLS = 1_000_000

def words_of(data: bytes | str | None) -> list[bytes]:
    """The words of a text as UTF-8, with A-Z in lower case; bytes.split() parts at exactly the blanks meant."""
    if not data:
        return []
    return (data.encode("utf-8", "replace") if isinstance(data, str) else data).lower().split()


class Lattice:
    """Piece lattices of words, by composition with the token transducer."""

    def __init__(self, v: Vocabulary):
        self.machine = PieceMachine(v)
        self.bytes_of = np.array(v.byte_ids() or [0] * 256)
        usable = np.array([k in (NORMAL, USER_DEFINED) for k in v.kinds])
        scores = np.array(v.scores)
        weight = np.exp(scores - scores[usable].max()) if v.model_type == UNIGRAM else 1 / (np.maximum(-scores, 0) + 10)
        weight = np.where(usable, weight, 0)
        weight[self.bytes_of] = weight[usable].min()
        self.prior = weight / weight.sum()
        self.logp = np.log(np.maximum(self.prior, 1e-300))
        self.end = np.log(0.5)

    def set_counts(self, expected: np.ndarray, ends: float) -> None:
        """Weights from expected counts of the pieces and the count of ends."""
        total = expected + PRIOR * self.prior
        norm = total.sum() + ends + 1
        self.logp, self.end = np.log(np.maximum(total / norm, 1e-300)), float(np.log((ends + 1) / norm))

    def _spelled(self, points: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Log weight, and ids, of the bytes of characters."""
        uniq, back = np.unique(points, return_inverse=True)
        ids = [[int(self.bytes_of[b]) for b in chr(c).encode("utf-8", "replace")] for c in uniq.tolist()]
        return np.array([self.logp[i].sum() for i in ids] or [0.0])[back] if len(uniq) else np.zeros(0), [ids[i] for i in back]

    def run(self, words: list[str], weights: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """Log likelihood of each word (with its space in front); adds weights' expected piece counts to expected."""
        out = np.zeros(len(words))
        for take, width in blocks([SPACE + x for x in words], CELLS):
            out[take] = self._block([SPACE + words[i] for i in take], width, None if weights is None else weights[take], expected)
        return out

    def _block(self, words: list[str], width: int, weights: np.ndarray | None, expected: np.ndarray | None) -> np.ndarray:
        (w, s, e, piece), points, lengths = self.machine.compose(words, width)
        logp = self.logp[piece]
        spelled = np.flatnonzero(piece < 0)
        cost, ids = self._spelled(points[w[spelled], s[spelled]])
        logp[spelled] = cost
        order = np.lexsort((s, e))
        w, s, e, piece, logp = w[order], s[order], e[order], piece[order], logp[order]
        alpha = np.full((len(words), width + 1), -np.inf)
        alpha[:, 0] = 0
        cuts = np.flatnonzero(np.diff(e * (width + 1) + s)) + 1
        groups = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(w)])) if len(w) else []
        for a, b in groups:  # a group has one start and one end, so at most one arc for each word
            i, x, y = w[a:b], s[a], e[a]
            alpha[i, y] = np.logaddexp(alpha[i, y], alpha[i, x] + logp[a:b])
        total = alpha[np.arange(len(words)), lengths]
        if expected is not None:
            beta = np.full((len(words), width + 1), -np.inf)
            beta[np.arange(len(words)), lengths] = 0
            for a, b in reversed(groups):
                i, x, y = w[a:b], s[a], e[a]
                beta[i, x] = np.logaddexp(beta[i, x], beta[i, y] + logp[a:b])
            with np.errstate(invalid="ignore"):
                share = np.exp(alpha[w, s] + logp + beta[w, e] - total[w]) * weights[w]
            share = np.nan_to_num(share)
            real = piece >= 0
            expected += np.bincount(piece[real], share[real], len(expected))
            lone = dict(zip(spelled.tolist(), ids))
            for k in np.flatnonzero(~real).tolist():
                for b in lone[int(order[k])]:
                    expected[b] += share[k]
        return total


def word_table(docs: DataFrame, learns) -> DataFrame:
    """word, c (count in the documents where `learns` holds), n (count in all): over every word of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {True: Counter(), False: Counter()}

        def flush() -> pa.RecordBatch:
            words = list(counts[True].keys() | counts[False].keys())
            c = [counts[True][w] for w in words]
            n = [a + counts[False][w] for a, w in zip(c, words)]
            for k in counts.values():
                k.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], ["word", "c", "n"])

        for b in batches:
            for text, mine in zip(b.column(0).cast(pa.binary()), b.column(1).to_pylist()):
                own = counts[bool(mine)]
                own.update(words_of(text.as_py()))
                own[END] += 1
                if len(own) > 300_000:
                    yield flush()
        yield flush()

    return docs.select("text", learns.alias("mine")).mapInArrow(run, "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fitted(table: DataFrame, lattice: Lattice, ends: int) -> Lattice:
    """lattice after one step of expectation maximisation over the table's words by their training counts."""
    size = len(lattice.logp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expected = np.zeros(size)
        for b in batches:
            lattice.run(b.column(0).to_pylist(), b.column(1).to_numpy().astype(float), expected)
        some = np.flatnonzero(expected)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(expected[some])], ["piece", "expected"])

    rows = table.filter((F.col("c") > 0) & (F.col("word") != END.decode())).select("word", "c").mapInArrow(run, "piece long, expected double")
    expected = np.zeros(size)
    for r in rows.groupBy("piece").agg(F.sum("expected").alias("e")).collect():  # one row for each piece of the vocabulary at most
        expected[r["piece"]] = r["e"]
    lattice.set_counts(expected, ends)
    return lattice


def score(docs: DataFrame, modulus: int = 10, model: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs."""
    spark = docs.sparkSession
    counts = common.stored(word_table(docs, ~common.held_out(modulus, 0)), "lm-counts")
    end, tokens, kinds = counts.agg(
        F.sum(F.when(F.col("word") == END.decode(), F.col("c"))), F.sum("c"), F.sum((F.col("c") > 0).cast("long"))
    ).first()
    end, tokens, kinds = end or 0, tokens or 0, kinds or 0
    lattice = fitted(counts, Lattice(Vocabulary.load(model)), end)
    below, ln10 = np.log10(tokens + 0.1 * (kinds + 1)), float(np.log(10))
    base_of = lambda c: np.log10(np.asarray(c) + 0.1) - below

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = lattice.run(b.column(0).to_pylist()) / ln10
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(base_of(b.column(1).to_numpy())), pa.array(found)], ["word", "c", "n", "base", "lm"])

    table = common.stored(counts.filter(F.col("word") != END.decode()).mapInArrow(weigh, "word string, c long, n long, base double, lm double"), "lm-words")
    common.dropped(counts)
    step = F.floor(F.log2("n") * 8)
    sizes = sorted(table.groupBy(step.alias("step")).count().collect(), reverse=True)  # a row for each eighth of a power of two
    least, held = None, 0
    for s, k in sizes:
        held += k
        if held > HEAVY_WORDS:
            break
        least = s
    frequent = table.filter(step >= (least if least is not None else 1 << 40))
    # at most HEAVY_WORDS keys of LONG bytes
    key = F.when(F.octet_length("word") > LONG, F.concat(F.lit(b" "), F.unhex(F.md5("word")))).otherwise(F.col("word").cast("binary"))
    sent = frequent.select(key.alias("key"), "base", "lm", (F.col("c") > 0).alias("known")).toLocalIterator()
    rows = [(bytes(r["key"]), r["base"], r["lm"], r["known"]) for r in sent]
    numbers = {w: i for i, (w, *_) in enumerate(rows)}
    values = np.array([(x, y, z) for _, x, y, z in rows] + [(0.0, 0.0, 0.0)])  # the last row is for words that were not sent
    heavy = spark.sparkContext.broadcast((numbers, values))
    end_base, end_lm, end_known = float(base_of(end)), lattice.end / ln10, int(end > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (number, values), task, row = heavy.value, TaskContext.get().partitionId() << 40, 0
        names = ["row", "word", "times", "doc_id", "held_out", "n_tokens", "n_known", "base", "lm"]
        get = number.get
        for b in batches:
            heads, tails = [], ([], [], [])
            for doc, text, out in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist()):
                words = words_of(text.as_py())
                at = np.array([get(w, -1) for w in words], np.int64)
                for i in np.flatnonzero(at < 0).tolist():
                    if len(words[i]) > LONG:
                        at[i] = get(b" " + md5(words[i]).digest(), -1)
                base, lm, seen = values[at].sum(axis=0).tolist()
                rare = Counter([words[i] for i in np.flatnonzero(at < 0).tolist()])
                base, lm, seen = base + end_base, lm + end_lm, int(seen) + end_known
                key = task + row
                row += 1
                heads.append((key, b"\n%d" % key, 1, doc, out, len(words) + 1, seen, base, lm))
                tails[0].extend([key] * len(rare))
                tails[1].extend(rare.keys())
                tails[2].extend(rare.values())
            types = [pa.int64(), pa.string(), pa.int64(), b.schema.field(0).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*heads), types)], names) if heads else pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names)
            n = len(tails[0])
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(tails, types)], *[pa.nulls(n, t) for t in types[3:]]], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, word string, times long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, lm double"
    parts = docs.select("doc_id", "text", common.held_out(modulus, 0).alias("h")).mapInArrow(run, schema)
    # rows of documents carry a word of their own, so they are spread and meet nothing
    words = table.select("word", F.col("c").alias("w_c"), F.col("base").alias("w_base"), F.col("lm").alias("w_lm"))
    joined = parts.join(words, "word", "left")
    add = lambda own, word: F.sum(F.coalesce(F.col(own), F.col("times") * word, F.lit(0)))
    return (
        joined.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
            add("n_known", (F.col("w_c") > 0).cast("long")).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
            add("base", F.col("w_base")).alias("base_score"), add("lm", F.col("w_lm")).alias("score"),
        )
        .drop("row")
    )


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))
