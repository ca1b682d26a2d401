"""Toxicity scores by a weighted finite-state pattern grammar over clauses.

Words become symbols by the lexicon transducer, a trie of whole words and word beginnings ("pref*"):
insults in grades, threats, second persons (as subject or in an object's form), third persons, first persons, forms
of "be", words that join (articles, intensifiers), negations and reporting verbs. Five transducers over symbols are
composed with it, state by state as texts need them. Negation and report mark the insults and threats in their scope as
weakened. Target marks how an insult or threat is aimed: an insult at the addressee ("you are such an idiot", "you
idiot": only joining words between) or at a third person ("he is an idiot"), a threat at an object before it ("ich werde
dich töten") or by the passive ("you will be killed"). Insult gives the weight of an aimed insult, and one for a second
person right after an insult; threat gives its weight where it is aimed or its object follows at once, so "kill the
process" and "shoot me an email, you" match nothing. Path weights are summed over a clause. A listed insult that stands
alone ("the idiot box") is in no construction: one counts nothing, but different ones in one text add up. Words that
only the labels teach (slurs that stand in toxic texts and hardly elsewhere) count where they stand.

The document's score is a logistic function of its best clause, the sum over clauses, the listed lone insults beyond the
strongest one, and the learned ones.

Insults are a fixed list and what labelled rows teach: beginnings of words and whole words that
stand in toxic texts far more often than chance allows, all that pass that test. At most
`SAMPLE_ROWS` labelled rows and common.SAMPLE_BYTES of text are used, equal texts once and near copies
as one; they are counted by tasks, and the driver sees hashes, counts of entries and features, no texts.
No score sees labels, language, source or id.

Defined cases: null and empty texts have no clause and get the score of that; texts of any length are
read whole; without labels of both kinds the fixed lists and default weights hold; a row labelled
twice alike counts once, with both labels once for each; the longest learned beginning wins, of equal
evidence the longer and then the smaller entry is kept; repeated rows score alike; an empty table
gives an empty result; drop_toxic() keeps further columns, score() ignores them, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows, at most, from which the grammar learns.
SAMPLE_ROWS = 12_000
#: Counts that a task holds before it hands them on to be summed.
HELD_COUNTS = 50_000

# Seed lexicon (fixed values): common words of each class in four languages.
INSULT = "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown dumb fool imbecile dumm idiotisch trottel abschaum connard imbécile stupide ordure tonto estúpido basura imbécil".split()
THREAT = (
    "kill kills killed killing hurt hurts hurting destroy destroyed destroying burn burned burning beat beaten beating stab stabbed stabbing shoot shot shooting murder murdered strangle strangled "
    "töten tötet getötet umbringen umgebracht vernichten vernichtet erschießen verprügeln tuer tue tué frapper frappé détruire détruit égorger matar mataré mata matado golpear golpeado destruir destruido"
).split()
TARGET = "you your yours yourself u ya you're ur du dein deine ihr tu ton vous votre tú usted ustedes vosotros".split()
AIM = "dich dir euch te toi ti os".split()
OBJECT = "him her them those sie ihn ihnen lui eux leur los las ellos ellas".split()
PERSON = "he she they he's she's they're er il elle él ella".split()
ME = "me us it mich mir uns moi nous mí nosotros".split()
BE = "be been being wirst werdet werden être seras serez ser serás".split()
JOIN = (
    "is are am was were isn't aren't wasn't a an such so really very just too all total complete utter absolute little big damn bloody bist ist sind seid war ein eine einen sehr "
    "es est êtes un une si très eres una muy tan"
).split()
NEGATION = "not never no cannot can't isn't aren't wasn't don't doesn't won't nicht nie kein keine pas jamais aucun nunca jamás ningún".split()
REPORT = "said says say called calls claimed claims wrote quoted reported alleged sagte sagt schrieb dit écrit dijo escribió".split()

#: Symbols: the classes, then insults of weight GRADE, 2 * GRADE and so on.
OTHER, THREATS, TARGETS, AIMS, OBJECTS, PERSONS, FIRST, BEING, JOINING, NEGATED, REPORTED, INSULTS = range(12)
GRADE, GRADES = 0.5, 12
SYMBOLS = INSULTS + GRADES
INSULT_WEIGHT, THREAT_WEIGHT, OTHERS_THREAT, VOCATIVE, MAX_WEIGHT = 3.0, 3.0, 2.0, 3.0, GRADE * GRADES
#: What is left of a weight for each weakening: none, negated, reported, both; and its share for each aim: none, a third person, the addressee.
LEFT, AIMED = (1.0, 0.25, 0.4, 0.1), (0.0, 1.0, 1.5)
#: Words that negations and reports reach, an object before and after its threat, and between the parts of a passive.
NEGATION_REACH, REPORT_REACH, BEFORE_REACH, OBJECT_REACH, PASSIVE_REACH = 3, 6, 4, 2, 3
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;:\n]")
_ENDS = frozenset(".!?;:\n")


class Transducer:
    """A deterministic weighted transducer: (state, symbol) -> (state, symbol out, weight).

    Symbols are numbers; a mark times SYMBOLS is added to those of insults and threats: 0..3 for how they are
    weakened, and 4 times how they are aimed.
    """

    def __init__(self, start, step: Callable[[Any, int], tuple[Any, int, float]]):
        self.start, self.step = start, step


def weakening(symbol: int, reach: int, mark: int) -> Transducer:
    """Marks insults and threats for `reach` words after `symbol`; the state is how many words are left."""

    def step(left: int, s: int) -> tuple[int, int, float]:
        kind = s % SYMBOLS
        if kind == symbol:
            return reach, s, 0.0
        hit = left and (kind == THREATS or kind >= INSULTS)
        return max(left - 1, 0), s + mark * SYMBOLS if hit else s, 0.0

    return Transducer(0, step)


def target() -> Transducer:
    """Marks insults and threats by how they are aimed.

    The state: whether the addressee was named and only joining words came since, the same for a third person (1:
    named, 2: joined), words that an object's form still reaches, and the passive: words to wait for "be" after the
    addressee, or beyond PASSIVE_REACH, for the threat after "be".
    """

    def step(state: tuple[int, int, int, int], s: int) -> tuple[tuple[int, int, int, int], int, float]:
        you, they, before, passive = state
        kind, aim = s % SYMBOLS, 0
        insult = kind >= INSULTS
        if insult:
            aim = 2 if you else 1 if they == 2 else 0
        elif kind == THREATS:
            aim = 2 if before or passive > PASSIVE_REACH else 0
        joining = kind in (JOINING, BEING, NEGATED, REPORTED) or insult
        after = (
            int(kind in (TARGETS, AIMS) or you and joining),
            1 if kind == PERSONS else 2 if they and joining else 0,
            BEFORE_REACH if kind == AIMS else max(before - 1, 0),
            PASSIVE_REACH if kind == TARGETS else PASSIVE_REACH + 2 if 0 < passive <= PASSIVE_REACH and kind == BEING else max(passive - 1, 0) if passive != PASSIVE_REACH + 1 else 0,
        )
        return after, s + 4 * aim * SYMBOLS, 0.0

    return Transducer((0, 0, 0, 0), step)


def insult() -> Transducer:
    """Gives the weight of an aimed insult, and VOCATIVE where a second person follows an insult at once; the state is that insult's mark."""

    def step(last: int | None, s: int) -> tuple[int | None, int, float]:
        kind, mark = s % SYMBOLS, s // SYMBOLS
        if kind >= INSULTS:
            gain = GRADE * (kind - INSULTS + 1) * LEFT[mark % 4] * AIMED[mark // 4]
            return (None if gain else mark), s, gain
        return None, s, VOCATIVE * LEFT[last % 4] if last is not None and kind in (TARGETS, AIMS) else 0.0

    return Transducer(None, step)


def threat() -> Transducer:
    """Gives a threat's weight where it is aimed or a person follows within OBJECT_REACH words, less for a third person; a
    first person or a thing ("me", "it") as object ends the wait. The state: words left to wait, and the threat's mark.
    """

    def step(state: tuple[int, int], s: int) -> tuple[tuple[int, int], int, float]:
        waits, held = state
        kind, mark = s % SYMBOLS, s // SYMBOLS
        if kind == THREATS:
            return ((0, 0), s, THREAT_WEIGHT * LEFT[mark % 4]) if mark // 4 else ((OBJECT_REACH, mark), s, 0.0)
        if waits and kind in (TARGETS, AIMS, OBJECTS):
            return (0, 0), s, (OTHERS_THREAT if kind == OBJECTS else THREAT_WEIGHT) * LEFT[held % 4]
        return ((waits - 1, held) if waits > 1 and kind != FIRST else (0, 0)), s, 0.0

    return Transducer((0, 0), step)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """second reads what first writes; weights add."""

    def step(state: tuple, s: int) -> tuple[tuple, int, float]:
        a, mid, x = first.step(state[0], s)
        b, out, y = second.step(state[1], mid)
        return (a, b), out, x + y

    return Transducer((first.start, second.start), step)


class Composed:
    """A machine as tables of the states that texts have reached so far: moves[state * SYMBOLS + symbol] is (state, weight, symbol out)."""

    def __init__(self, machine: Transducer):
        self.machine = machine
        self.ids, self.states, self.moves = {machine.start: 0}, [machine.start], {}

    def move(self, state: int, s: int) -> tuple[int, float, int]:
        found = self.moves.get(state * SYMBOLS + s)
        if found is None:
            to, out, weight = self.machine.step(self.states[state], s)
            if to not in self.ids:
                self.ids[to] = len(self.states)
                self.states.append(to)
            found = self.moves[state * SYMBOLS + s] = self.ids[to], weight, out
        return found


GRAMMAR = reduce(compose, (weakening(NEGATED, NEGATION_REACH, 1), weakening(REPORTED, REPORT_REACH, 2), target(), insult(), threat()))


def grade(weight: float) -> int:
    """The symbol of an insult of about that weight."""
    return INSULTS + min(GRADES, max(1, round(weight / GRADE))) - 1


class Lexicon:
    """The transducer from the letters of a word to its symbol: a trie, in which `whole` holds the symbols of
    words that end there and `begins` those of beginnings. Its paths are remembered for each word.
    """

    CACHE = 200_000

    def __init__(self, learned: dict[str, float]):
        self.arcs: dict[tuple[int, str], int] = {}
        self.whole: dict[int, int] = {}
        self.begins: dict[int, int] = {}
        self.states = 1
        classes = (TARGETS, TARGET), (AIMS, AIM), (OBJECTS, OBJECT), (PERSONS, PERSON), (FIRST, ME), (BEING, BE), (JOINING, JOIN), (NEGATED, NEGATION), (REPORTED, REPORT), (THREATS, THREAT)
        for symbol, words in (*classes, (grade(INSULT_WEIGHT), INSULT)):
            for w in words:
                self.whole[self._path(w)] = symbol
        for entry, weight in learned.items():
            (self.begins if entry.endswith("*") else self.whole)[self._path(entry.rstrip("*"))] = grade(weight)
        self.seen: dict[str, int] = {}

    def _path(self, word: str) -> int:
        state = 0
        for ch in word:
            state = self.arcs.setdefault((state, ch), self.states)
            self.states = max(self.states, state + 1)
        return state

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}

    def __call__(self, word: str) -> int:
        found = self.seen.get(word)
        if found is None:
            found = self._symbol(word)
            if len(self.seen) >= self.CACHE:
                self.seen.clear()
            self.seen[word] = found
        return found

    def _symbol(self, word: str) -> int:
        """Listed or learned insults and threats, then the longest learned beginning, then the other classes."""
        state, begin = 0, None
        for ch in word:
            state = self.arcs.get((state, ch))
            if state is None:
                return OTHER if begin is None else begin
            begin = self.begins.get(state, begin)
        own = self.whole.get(state, OTHER)
        return own if begin is None or own == THREATS or own >= INSULTS else begin


RIDGE = np.array([0.01, 5.0, 5.0, 0.5, 0.5])
#: Weights of the logistic function without labels: constant, best clause, sum of clauses, lone insults, learned ones.
DEFAULT = np.array([-4.0, 1.2, 0.4, 1.5, 0.8])
LISTED = frozenset(INSULT)


class Grammar:
    """The lexicon and the composed machine, with the weights of the final logistic function."""

    def __init__(self, learned: dict[str, float] | None = None):
        self.lexicon = Lexicon(learned or {})
        self.machine = Composed(GRAMMAR)
        self.coef = DEFAULT

    def __getstate__(self) -> dict:
        return self.__dict__ | {"machine": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"machine": Composed(GRAMMAR)}

    def matched(self, text: str | None) -> tuple[list[float], dict[str, float]]:
        """The weight of each clause that the grammar matches, and the lone insults with their weights."""
        out: list[float] = []
        lone: dict[str, float] = {}
        tokens = _TOKEN.findall((text or "").lower())
        symbol, move = self.lexicon, self.machine.move
        symbols = [symbol(t) for t in tokens]
        last = -1
        for i in [i for i, s in enumerate(symbols) if s >= INSULTS or s == THREATS]:
            if i <= last:
                continue
            a = i
            while a > 0 and tokens[a - 1] not in _ENDS and a > last + 1:
                a -= 1
            state, total, j = 0, 0.0, a
            while j < len(tokens) and tokens[j] not in _ENDS:
                state, gain, shown = move(state, symbols[j])
                total += gain
                if symbols[j] >= INSULTS and shown // SYMBOLS < 4:
                    weight = GRADE * (symbols[j] - INSULTS + 1) * LEFT[shown // SYMBOLS]
                    lone[tokens[j]] = max(lone.get(tokens[j], 0.0), weight)
                j += 1
            last = j
            if total:
                out.append(total)
        return out, lone

    def clauses(self, text: str | None) -> list[float]:
        return self.matched(text)[0]

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """The best clause, the sum of clauses, the lone listed insults but the strongest, and the lone learned ones (each word once)."""
        c, lone = self.matched(text)
        listed = [w for t, w in lone.items() if t in LISTED]
        learned = sum(w for t, w in lone.items() if t not in LISTED)
        return min(max(c, default=0.0), 12.0), math.log1p(sum(c)), math.log1p(sum(listed) - max(listed, default=0.0)), math.log1p(learned)

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts], float).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(self.coef[0] + x @ self.coef[1:], -30, 30)))


def _entries(word: str) -> Iterator[str]:
    yield word
    for n in range(3, min(len(word), 9)):
        yield word[:n] + "*"


def copy_keys(text: str, width: int = 5, keys: int = 3) -> list[int]:
    """A few minimum hashes of a text's runs of `width` words."""
    words = text.lower().split()
    runs = {" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}
    hashes = np.array([zlib.crc32(r.encode("utf-8", "replace")) for r in runs], np.uint64)
    return [int(((hashes * np.uint64(2 * k * 0x9E3779B1 + 0x85EBCA6B) + np.uint64(k)) & np.uint64(0xFFFFFFFF)).min()) for k in range(keys)]


def copies(keys: list[list[int]]) -> list[int]:
    """A group number for each text; texts that share one of their keys are one group.

    Else the chance words of one much copied text would look like marks of its label.
    """
    parent = list(range(len(keys)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen: dict[tuple[int, int], int] = {}
    for i, own in enumerate(keys):
        for key in enumerate(own):
            a, b = root(i), root(seen.setdefault(key, i))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(keys))]


def entries(text: str) -> set[str]:
    return {e for w in set(_TOKEN.findall(text.lower())) if len(w) >= 3 for e in _entries(w)}


class Evidence:
    """The test that an entry of `a` toxic and `b` other groups must pass, of n1 and n0, with `seen` entries in toxic ones."""

    SHARE = 0.85

    def __init__(self, n1: int, n0: int, seen: int):
        self.n1, self.n0 = n1, n0
        self.base = n1 / (n0 + n1)
        self.least = max(2, n1 // 400)
        self.enough = 3 + math.log(seen + 1)  # so that of all entries seen few pass by chance

    def of(self, a, b, log=np.log, greatest=max):
        """Log likelihood ratio against the base rate."""
        q = (a + 0.01) / (a + b + 0.02)
        return a * log(q / self.base) + b * log(greatest(1 - q, 1e-9) / (1 - self.base))

    def weight(self, a: int, b: int) -> float:
        return min(MAX_WEIGHT, math.log((a + 0.5) / (self.n1 + 1)) - math.log((b + 0.5) / (self.n0 + 1)))


def chosen(rows: list[tuple[str, int, int]], test: Evidence) -> dict[str, float]:
    """Weights of the entries (entry, a, b) that pass, but for those that another one kept makes needless."""
    scored = [(test.of(a, b), len(f), f, a, b) for f, a, b in rows]
    scored = sorted((x for x in scored if x[0] > test.enough), key=lambda x: (-x[0], -x[1], x[2]))
    kept: dict[str, float] = {}
    most: dict[str, int] = {}  # of each beginning of a kept entry, the most groups of one
    for _, _, f, a, b in scored:
        stem = f.rstrip("*")
        if any(stem[:n] + "*" in kept for n in range(3, len(stem) + 1)):
            continue  # a kept beginning covers it
        if f.endswith("*") and most.get(stem, 0) >= 0.9 * a:
            continue  # it adds nothing to a longer kept one
        kept[f] = test.weight(a, b)
        for n in range(3, len(stem) + 1):
            most[stem[:n]] = max(most.get(stem[:n], 0), a)
    return {f: w for f, w in kept.items() if w > 0}


def learn(sample: DataFrame) -> Grammar:
    """A grammar from a stored, bounded sample with row, text and y (0 or 1).

    Groups of near copies fall into two halves; each half's lexicon gives the features of the other
    half's rows, to which the logistic weights are fitted; the final lexicon is of all rows.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([copy_keys(t) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["row", "y", "keys"])

    rows = sorted(tuple(r) for r in common.map_texts(sample, keys, "row long, y int, keys array<long>").collect())  # a few numbers for each row of the sample
    if len({y for _, y, _ in rows}) < 2:
        return Grammar()
    group = dict(zip([r for r, _, _ in rows], copies([k for _, _, k in rows])))
    half = {g: zlib.crc32(b"%d" % g) % 2 for g in group.values()}

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([group[r] for r in b.column(0).to_pylist()], pa.int64())], [*b.schema.names, "grp"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, key, own = Counter(), None, set()

        def handed_on() -> pa.RecordBatch:
            names, halves, labels = zip(*counts) if counts else ((), (), ())
            columns = (names, pa.string()), (halves, pa.int32()), (labels, pa.int32()), (list(counts.values()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["entry", "half", "y", "n"])

        for b in batches:
            for t, y, g in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if (g, y) != key:
                    if key:
                        counts.update((e, half[key[0]], key[1]) for e in own)
                    key, own = (g, y), set()
                    if len(counts) > HELD_COUNTS:
                        yield handed_on()
                        counts.clear()
                own |= entries(t.as_py())
        if key:
            counts.update((e, half[key[0]], key[1]) for e in own)
        yield handed_on()

    tasks = int(sample.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = common.map_texts(sample, grouped, "row long, text string, y int, grp long").repartition(tasks, "grp").sortWithinPartitions("grp", "y")
    counted = common.map_texts(dealt, count, "entry string, half int, y int, n long")
    of = lambda h, y: F.sum(F.when((F.col("half") == h) & (F.col("y") == y), F.col("n")).otherwise(0))
    table = common.stored(counted.groupBy("entry").agg(*[of(h, y).alias(f"c{h}{y}") for h in (0, 1) for y in (0, 1)]), "tox-entries")
    n = Counter((half[g], y) for g, y in {(group[r], y) for r, y, _ in rows})
    seen = table.agg(*[F.sum((F.col(f"c{h}1") > 0).cast("long")) for h in (0, 1)], F.count("*")).first()
    lexica = []
    for parts, entries_seen in (((0,), seen[0]), ((1,), seen[1]), ((0, 1), seen[2])):
        n1, n0 = (sum(n[h, y] for h in parts) for y in (1, 0))
        if not n1 or not n0:
            lexica.append({})
            continue
        test = Evidence(n1, n0, entries_seen or 0)
        a, b = (sum((F.col(f"c{h}{y}") for h in parts), F.lit(0)) for y in (1, 0))
        passing = table.select("entry", a.alias("a"), b.alias("b")).filter((F.col("a") >= test.least) & (F.col("a") / (F.col("a") + F.col("b")) >= test.SHARE))
        passing = passing.filter(test.of(F.col("a"), F.col("b"), F.log, lambda x, y: F.greatest(x, F.lit(y))) > test.enough - 1e-6)
        lexica.append(chosen([tuple(r) for r in passing.collect()], test))  # each stands in test.least sampled rows or more
    common.dropped(table)
    graders = [Grammar(x) for x in lexica[:2]]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [graders[1 - half[group[r]]].features(t) for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *[pa.array(c, pa.float64()) for c in zip(*own)]] if own else [b.column(0), b.column(2), *[pa.array([], pa.float64())] * 4], ["row", "y", "best", "sum", "lone", "learned"])

    found = np.array(sorted(tuple(r) for r in common.map_texts(sample, features, "row long, y int, best double, sum double, lone double, learned double").collect()))
    x, y = np.column_stack([np.ones(len(found)), found[:, 2:]]), found[:, 1]
    coef = DEFAULT
    for _ in range(60):  # Newton steps; a small ridge holds what the labels don't tell at the default weights
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(RIDGE)
        coef = coef - np.linalg.solve(h, x.T @ (p - y) + RIDGE * (coef - DEFAULT))
    # a clause never speaks against toxicity, and without any the score is under one half
    coef = np.concatenate([np.minimum(coef[:1], -1.0), np.maximum(coef[1:], [DEFAULT[1] / 2, 0.0, 0.0, 0.0])])
    full = Grammar(lexica[2])
    full.coef = coef
    return full


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Grammar:
    """A grammar from labelled documents outside of the held-out fifth, `rows` of them at most."""
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~common.held_out(5, 0)).select("doc_id", (F.col("toxic") > 0).cast("int").alias("y"))
    few = common.stored(common.bounded_sample(marked, rows, F.lit(16)), "tox-labels")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id").select("text", "y")  # `rows` rows at most
    some = common.bounded_sample(texts, rows, F.octet_length("text"))
    sample = common.stored(some.select(F.monotonically_increasing_id().alias("row"), "text", "y"), "tox-sample")
    grammar = learn(sample.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row"))
    common.dropped(sample)
    common.dropped(few)
    return grammar


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, score and predicted of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = grammar.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.map_texts(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double, predicted int")


def drop_toxic(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """docs without the rows that the grammar predicts toxic."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = grammar.score(b.column(columns.index("text")).to_pylist()) < 0.5
            yield b.filter(pa.array(clean))

    return common.map_texts(docs, run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return found.select("doc_id", common.held_out(5, 0).alias("held_out"), "score", "predicted")
