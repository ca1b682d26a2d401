"""SentencePiece encoding and decoding by weighted finite-state transducers.

Compiled from a model file are the normaliser (character rewrites, then spaces to U+2581 and the
leading one), the token machine (a character trie whose final states emit a piece at the cost of
minus its score, and for a character that is no piece an arc that emits its UTF-8 bytes at the cost
of an unknown one), and for files of the BPE kind the pair machine. Each input is composed with them
and its encoding is the path of least cost in the tropical semiring (min, +); of equal paths the one
with the longer last piece wins. The composition is never built as a whole: the lattices of many
words are stepped and relaxed at once, in blocks of bounded size. A text falls apart between two
characters that no piece holds in a row: where no piece goes on after an inner space, before spaces,
and if the vocabulary allows it also before line breaks and after letters that another sign follows.
These parts are encoded once per task and remembered in a bounded table.

In files of the BPE kind the scores are merge ranks, and not every path is one that merging could
leave. A path is what merging gives exactly if each piece, and each two neighbouring pieces, are
what merging makes of their own text. The pair machine, whose state is the last piece and whose arcs
are the pairs that stand, leaves just these paths (its arcs are found when first needed); the
cheapest that remains is the encoding of the library.

Defined cases: null gives null ids and null text; an empty text has no ids; characters outside the
vocabulary come back from bytes; a text of any length is encoded whole; repeated rows are encoded
alike; an empty table gives an empty result; further columns stay where the caller keeps them, but for
those with the names of results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .pieces import BPE, BYTE, CONTROL, NORMAL, SPACE, UNKNOWN, USER_DEFINED, PieceMachine, Vocabulary, blocks

UNKNOWN_COST = 10.0


class Rewriter:
    """A transducer from characters to strings: the longest rule that matches is applied, others pass as they are.

    Rules of one character that begin no longer rule are loops of the start state; the others are paths
    of a trie, left by the longest final state passed.
    """

    def __init__(self, rules: dict[str, str]):
        heads = {k[0] for k in rules if len(k) > 1}
        self.loops = str.maketrans({k: v for k, v in rules.items() if len(k) == 1 and k not in heads})
        self.arcs: dict[tuple[int, str], int] = {}
        self.final: dict[int, str] = {}
        states = 1
        for key, value in rules.items():
            if key[0] in heads:
                state = 0
                for ch in key:
                    state = self.arcs.setdefault((state, ch), states)
                    states = max(states, state + 1)
                self.final[state] = value
        self.heads = heads

    def __call__(self, text: str) -> str:
        if not self.heads or self.heads.isdisjoint(text):
            return text.translate(self.loops) if self.loops else text
        out, at = [], 0
        while at < len(text):
            state, end, best = 0, at, None
            while end < len(text) and (to := self.arcs.get((state, text[end]))) is not None:
                state, end = to, end + 1
                if state in self.final:
                    best = end, self.final[state]
            if best:
                at = best[0]
                out.append(best[1])
            else:
                out.append(text[at].translate(self.loops))
                at += 1
        return "".join(out)


class Normaliser:
    """The rewriting rules of a model, then its treatment of spaces, as transducers one after the other."""

    def __init__(self, v: Vocabulary):
        self.rules = Rewriter(v.rewrites())
        self.prefix, self.squeeze = v.dummy_prefix, v.squeeze

    def __call__(self, text: str) -> str:
        text = self.rules(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)  # a transducer of one state


class PairMachine:
    """The transducer over pieces whose state is the last piece and whose arcs are the pairs that merging leaves.

    An arc is worked out when it is first asked for and kept in a table of fixed size, in which a later
    pair may take its place.
    """

    SLOTS = 1 << 20

    def __init__(self, v: Vocabulary):
        self.pieces = v.pieces
        self.rank = {p: s for p, s, k in zip(v.pieces, v.scores, v.kinds) if k in (NORMAL, USER_DEFINED)}
        self._clear()

    def _clear(self) -> None:
        self.tracks: dict[int, tuple | None] = {}
        self.keys, self.stand = np.full(self.SLOTS, -1, np.int64), np.zeros(self.SLOTS, bool)

    def __getstate__(self) -> dict:
        return {"pieces": self.pieces, "rank": self.rank}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._clear()

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text: the best-scored pair of neighbours first, the leftmost of equals."""
        parts = list(text)
        rank = self.rank.get
        scores = [rank(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, r in enumerate(scores):
                if r is not None and (best is None or r > best):
                    best, at = r, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at < len(scores):
                scores[at] = rank(parts[at] + parts[at + 1])
            if at:
                scores[at - 1] = rank(parts[at - 1] + parts[at])

    def track(self, piece: int) -> tuple[list[float], list[str], list[str]] | None:
        """How merging makes a piece of its characters: the score of each step (then minus infinity), and the first and last part before it; null if it doesn't."""
        if piece not in self.tracks:
            parts, rank, steps = list(self.pieces[piece]), self.rank.get, []
            while (best := max(((r, -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank(a + b)) is not None), default=None)) is not None:
                steps.append((best[0], parts[0], parts[-1]))
                parts[-best[1] : 2 - best[1]] = [parts[-best[1]] + parts[1 - best[1]]]
            steps.append((-np.inf, parts[0], parts[-1]))
            self.tracks[piece] = tuple(map(list, zip(*steps))) if len(parts) == 1 else None
        return self.tracks[piece]

    def stands(self, left: int, right: int) -> bool:
        """Whether merging leaves the pieces apart: their own steps, the best scored first and the left one of equals, never let a merge over their border win."""
        after = self.track(right)
        if after is None or left < 0:
            return after is not None
        if (before := self.track(left)) is None:
            return False
        rank, i, j = self.rank.get, 0, 0
        (a, _, last), (b, first, _) = before, after
        over = rank(last[0] + first[0])
        while True:
            if over is not None and over > a[i] and over >= b[j]:
                return False
            if a[i] >= b[j]:
                if a[i] == -np.inf:
                    return True
                i += 1
            else:
                j += 1
            over = rank(last[i] + first[j])

    def arcs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether there is an arc from each left to each right piece; left is -1 at the start and after bytes."""
        key = (left + 1).astype(np.int64) * len(self.pieces) + right
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64) % self.SLOTS
        out = self.stand[slot]
        missing = np.flatnonzero(self.keys[slot] != key)
        if len(missing):
            fresh, first, back = np.unique(key[missing], return_index=True, return_inverse=True)
            at = missing[first]
            found = np.array(list(map(self.stands, left[at].tolist(), right[at].tolist())))
            self.keys[slot[at]], self.stand[slot[at]] = fresh, found
            out[missing] = found[back]
        return out


class Codec:
    """Normaliser, token machine and, for vocabularies of merges, pair machine; and their shortest paths."""

    CACHE = 300_000
    LONG = 64
    CELLS = 200_000

    def __init__(self, v: Vocabulary):
        self.normalise, self.tokens = Normaliser(v), PieceMachine(v)
        self.pairs = PairMachine(v) if v.model_type == BPE else None
        usual = [s for s, k in zip(v.scores, v.kinds) if k == NORMAL]
        low, high = min(usual, default=0.0), max(usual, default=0.0)
        cost = [-(len(p.encode()) * high - 0.1) if k == USER_DEFINED else -s for p, s, k in zip(v.pieces, v.scores, v.kinds)]
        self.cost = np.array([*cost, UNKNOWN_COST - low])  # PieceMachine.BYTES is the last one
        self.bytes_of, self.unknown_id = v.byte_ids(), next((i for i, k in enumerate(v.kinds) if k == UNKNOWN), 0)
        self.split = v.words_split() and v.dummy_prefix
        self.surface = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.encode() for p, k in zip(v.pieces, v.kinds)]
        self.prefix = v.dummy_prefix
        self.parts = re.compile(self._cuts(v))
        self.seen: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}, "old": {}}

    @staticmethod
    def _cuts(v: Vocabulary) -> str:
        """A pattern of the parts that no piece crosses, of normalised lines whose words can be taken apart."""
        pieces = [p for p, k in zip(v.pieces, v.kinds) if k in (NORMAL, USER_DEFINED)]
        breaks, figures = not any("\n" in p for p in pieces), "".join(sorted({c for p in pieces for c in p if c.isnumeric() and not c.isalpha() and not c.isdecimal()}))
        letter, other = rf"[^\W\d_{figures}]", rf"[\W\d_{figures}]"  # raised figures and fractions are no letters
        marks = SPACE + "\n" * breaks
        begin = rf"(?:{SPACE}+|\n)" if breaks else SPACE + "+"
        if any(re.search(letter + other, p) for p in pieces):
            return f"{begin}[^{marks}]*|[^{marks}]+"
        other = f"(?:(?![{marks}]){other})"
        return f"{begin}{other}*{letter}*|{other}+{letter}*|{letter}+"

    def shortest(self, words: list[str]) -> list[bytes]:
        """The ids (little-endian, 32 bits) on the cheapest path of each normalised word."""
        out = [b""] * len(words)
        for take, width in blocks(words, self.CELLS):
            for i, ids in zip(take, self._block([words[i] for i in take], width)):
                out[i] = ids
        return out

    def _block(self, words: list[str], width: int) -> list[bytes]:
        """shortest() of a block: paths are extended from place to place, all words at once (min, +).

        With the pair machine a state is a place and the piece that ends there. Merging leaves one
        sequence of pieces for each beginning of a word, so each place has one live state.
        """
        (w, s, e, piece), points, lengths = self.tokens.compose(words, width)
        order = np.argsort(s.astype(np.int16) if width < 1 << 15 else s, kind="stable")  # short numbers are sorted by digits
        w, s, e, piece = w[order], s[order], e[order], piece[order]
        best = np.full((len(words), width + 1), np.inf)
        best[:, 0] = 0
        last, came = np.full(best.shape, -1), np.zeros(best.shape, np.int64)
        bounds = np.searchsorted(s, np.arange(width + 1))
        for place in range(width):
            a, b = bounds[place], bounds[place + 1]
            i, to, label = w[a:b], e[a:b], piece[a:b]
            total = best[i, place] + self.cost[label]
            live = np.flatnonzero(total < best[i, to])
            if self.pairs and len(live):
                plain = live[label[live] >= 0]
                stand = np.ones(len(i), bool)
                stand[plain] = self.pairs.arcs(last[i[plain], place], label[plain])
                live = live[stand[live]]
            i, to = i[live], to[live]  # from one place a word has one arc to each other place
            best[i, to], last[i, to], came[i, to] = total[live], label[live], place
        at, live, steps = lengths.copy(), np.flatnonzero(lengths > 0), []
        while len(live):
            here = at[live]
            at[live] = came[live, here]
            steps.append((live, at[live], last[live, here]))
            live = live[at[live] > 0]
        if not steps:
            return [b""] * len(words)
        w, s, ids = (np.concatenate(x) for x in zip(*steps))
        order = np.lexsort((s, w))
        w, s, ids = w[order], s[order], ids[order]
        lone = np.flatnonzero(ids < 0)
        if len(lone):
            spelled = [self._spelled(int(c)) for c in points[w[lone], s[lone]]]
            times = np.ones(len(ids), np.int64)
            times[lone] = [len(x) for x in spelled]
            w, ids = np.repeat(w, times), np.repeat(ids, times)
            ids[ids < 0] = np.concatenate(spelled)
        packed, ends = ids.astype("<i4").tobytes(), np.cumsum(np.bincount(w, minlength=len(words))) * 4
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _spelled(self, point: int) -> list[int]:
        return [self.bytes_of[b] for b in chr(point).encode("utf-8", "replace")] if self.bytes_of else [self.unknown_id]

    def _learn(self, parts: set[str]) -> None:
        """Put parts into the table of this task."""
        fresh = []
        for p in parts:
            if (known := self.old.get(p)) is not None:
                self.seen[p] = known
            else:
                fresh.append(p)
        self.seen.update(zip(fresh, self.shortest(fresh)))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        lines = [self.normalise(t) for t in texts]
        if not self.split:
            return self.shortest(lines)
        rows = [[] if not x else x[1:].split(SPACE) if SPACE * 2 not in x else [w[1:] for w in re.findall(f"{SPACE}+[^{SPACE}]*", x)] for x in lines]
        words = list(set().union(*rows))
        parts = [self.parts.findall(SPACE + w) for w in words]
        used = set().union(*parts)
        self._learn(used - self.seen.keys())
        seen = self.seen
        known = {w: seen[own[0]] if len(own) == 1 else b"".join([seen[p] for p in own]) for w, own in zip(words, parts)}
        out = [b"".join([known[w] for w in own]) for own in rows]
        for p in used:
            if len(p) > self.LONG:
                del seen[p]
        if len(seen) >= self.CACHE:  # two generations: parts in use survive
            self.old, self.seen = seen, {}
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], "<i4").tolist()

    def decode(self, ids) -> str:
        surface = self.surface
        text = b"".join([surface[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


RESULTS = ("ids", "n_tokens", "n_fallback", "round_trip")


def encode(docs: DataFrame, codec: Codec, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (default doc_id), and ids, n_tokens, n_fallback (ids of bytes) and round_trip.

    round_trip: decoding the ids gives the text back (with spaces as the normaliser leaves them). A column
    of docs with the name of a result gives way to it.
    """
    keep = [c for c in keep or ["doc_id"] if c not in RESULTS]
    text_at = keep.index("text") if "text" in keep else len(keep)
    byte_ids = np.zeros(len(codec.surface), bool)
    byte_ids[codec.bytes_of] = True

    def same(text: str, packed: np.ndarray) -> bool:
        line = codec.normalise(text).replace(SPACE, " ")
        return codec.decode(packed.tolist()) == (line[1:] if codec.prefix and line else line)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                b = whole.slice(at, 1_000)
                texts = b.column(text_at).to_pylist()
                arrays = [np.frombuffer(p, "<i4") for p in codec.encode_many([t or "" for t in texts])]
                offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
                missing = pa.array([t is None for t in texts])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int32)])), mask=missing)
                count = pa.array([len(a) for a in arrays], pa.int64())
                spare = pa.array([int(byte_ids[a].sum()) for a in arrays], pa.int64())
                trip = pa.array([None if t is None else same(t, a) for t, a in zip(texts, arrays)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], ids, count, spare, trip], [*keep, *RESULTS])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return common.map_texts(docs.select(*keep, *([] if "text" in keep else ["text"])), run, f"{fields}, ids array<int>, n_tokens long, n_fallback long, round_trip boolean")


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents"), Codec(Vocabulary.load(model)))
