import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import toxicity

from .helpers import awkward, documents, write

LABELS = "doc_id long, quality int, toxic int, score double"


def test_grammar_scores_clauses():
    g = toxicity.Grammar()
    one = lambda t: max(g.clauses(t), default=0)
    assert one("you are an idiot") == one("you idiot") == one("you really are such a total idiot") == 4.5 > one("he is an idiot") == 3
    assert one("you are not an idiot") == 4.5 / 4 and one("they said you are an idiot") == pytest.approx(4.5 * 0.4) and one("he is not an idiot") == 0.75
    assert g.clauses("you idiot. he is a moron") == [4.5, 3.0] and g.clauses(None) == [] == g.clauses("")
    # insults in no construction
    assert [one(t) for t in ("the idiot box", "this movie is stupid", "the clown made the children laugh", "you like the clown", "he idiot")] == [0] * 5
    assert one("idiot you") == toxicity.VOCATIVE and one("you kind idiot") == 0
    # threats need their object
    assert one("I will kill you") == one("you will be killed") == one("ich werde dich töten") == one("töte oder tuer te") == 3
    assert one("kill them") == one("I will hurt all of them") + 2 == 2 and one("they hurt") == 0
    assert [one(t) for t in ("kill the process", "the server was killed", "shoot me an email, you", "burn the toast you made", "you killed it", "kill it you", "kill the process. you see", "you are killing time")] == [0] * 8
    assert 0 < one("they said you will be killed") < one("you will be killed") and one("I would never hurt you") == 0.75


def test_constructions_decide():
    g = toxicity.Grammar()
    toxic = ["you idiot", "you are a moron", "I will kill you", "he is an idiot", "you will be killed", "a clown, a moron, a loser: trash and scum, all of it, worthless"]
    clean = ["the idiot box", "shoot me an email, you", "this movie is stupid", "you are not an idiot", "they said you are an idiot", "the clown met a clown and a clown", "kill the process", None, ""]
    assert (g.score(toxic) >= 0.5).all() and (g.score(clean) < 0.5).all()
    words = [any(g.lexicon(t) >= toxicity.INSULTS for t in x.split()) for x in clean[:6]]
    assert sum(words) == 5  # a word list would flag these


def plain(words, symbol):
    """The weight of a clause and its lone insults straight from the rules, without machines."""
    kinds = [symbol(w) for w in words]
    insult = [k >= toxicity.INSULTS for k in kinds]
    joins = [k in (toxicity.JOINING, toxicity.BEING, toxicity.NEGATED, toxicity.REPORTED) or i for k, i in zip(kinds, insult)]

    def left(i):
        out = 1.0
        for kind, reach, factor in ((toxicity.NEGATED, 3, 0.25), (toxicity.REPORTED, 6, 0.4)):
            out *= factor if any(kinds[j] == kind for j in range(max(0, i - reach), i)) else 1
        return out

    def behind(i):
        """The places before i up to the first word that doesn't join, that one included."""
        j = i - 1
        while j >= 0 and joins[j]:
            j -= 1
        return j

    total, lone = 0.0, {}
    second, aims = (toxicity.TARGETS, toxicity.AIMS), []
    for i, k in enumerate(kinds):
        if insult[i]:
            j = behind(i)
            weight = 0.5 * (k - toxicity.INSULTS + 1) * left(i)
            factor = 1.5 if j >= 0 and kinds[j] in second else 1.0 if j >= 0 and kinds[j] == toxicity.PERSONS and j < i - 1 else 0.0
            total += weight * factor
            if not factor:
                lone[words[i]] = max(lone.get(words[i], 0), weight)
                if i + 1 < len(kinds) and kinds[i + 1] in second:
                    total += toxicity.VOCATIVE * left(i)
        elif k == toxicity.THREATS:
            before = any(kinds[j] == toxicity.AIMS for j in range(max(0, i - 4), i))
            passive = any(kinds[b] == toxicity.BEING and named(kinds, b) for b in range(max(0, i - 2), i))
            if before or passive:
                total += 3 * left(i)
                continue
            for j in (i + 1, i + 2):
                if j >= len(kinds) or kinds[j] in (toxicity.FIRST, toxicity.THREATS):
                    break
                if kinds[j] in (*second, toxicity.OBJECTS):
                    total += (2 if kinds[j] == toxicity.OBJECTS else 3) * left(i)
                    break
    return total, lone


def named(kinds, b):
    """Whether the addressee stands in the three words before a form of "be", with no other such form between."""
    for j in range(b - 1, max(-1, b - 4), -1):
        if kinds[j] == toxicity.TARGETS:
            return True
        if kinds[j] == toxicity.BEING and named(kinds, j):
            return False
    return False


def test_machine_agrees_with_the_plain_rules():
    g = toxicity.Grammar({"grum*": 4.2, "zork": 1.0})
    words = ["you", "dich", "them", "he", "me", "is", "be", "not", "said", "kill", "killed", "idiot", "grumble", "zork", "zorks", "a", "the", "box"]
    r = random.Random(3)
    for _ in range(6_000):
        clause = [r.choice(words) for _ in range(r.randint(1, 14))]
        total, lone = plain(clause, g.lexicon)
        found, own = g.matched(" ".join(clause))
        assert (sum(found), own) == (pytest.approx(total), pytest.approx(lone)), clause


def test_composition():
    a, b = toxicity.weakening(toxicity.NEGATED, 2, 1), toxicity.compose(toxicity.target(), toxicity.insult())
    both, r = toxicity.compose(a, b), np.random.default_rng(0)
    lazy, state = toxicity.Composed(both), 0
    x, y, z = a.start, b.start, both.start
    for s in r.integers(0, toxicity.SYMBOLS, 2_000).tolist():
        x, mid, _ = a.step(x, s)
        y, out, w = b.step(y, mid)
        z, other, v = both.step(z, s)
        state, gain, shown = lazy.move(state, s)
        assert z == (x, y) and other == out == shown and v == w == gain


def test_lexicon_precedence():
    lex = toxicity.Lexicon({"ab*": 1.0, "abc*": 2.0, "abcd": 3.0, "yo*": 6.0})
    g = toxicity.grade
    assert [lex(w) for w in ("ab", "abx", "abcz", "abcd", "abcde", "you", "kill", "zz", "q")] == [g(1), g(1), g(2), g(3), g(2), g(6), toxicity.THREATS, 0, 0]


def test_sample_is_bounded_under_one_id(spark):
    docs = spark.range(4_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("some text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(7, 1, 1, 0.0), (7, 1, 0, 0.0)], LABELS)
    seen = []
    plain_learn, toxicity.learn = toxicity.learn, lambda sample: seen.append(sample.count()) or plain_learn(sample)
    try:
        toxicity.train(docs, labels, 150)
    finally:
        toxicity.learn = plain_learn
    assert seen[0] <= 150


def corpus(n=600, seed=1):
    r = random.Random(seed)
    syllables = ["ba", "re", "no", "ti", "lu", "ka", "mi", "so"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(2, 4)))
    rows = []
    for i in range(n):
        words, toxic = [word() for _ in range(r.randint(20, 120))], int(r.random() < 0.2)
        if toxic:
            for _ in range(2):
                words.insert(r.randrange(len(words)), "grumpf" + r.choice(syllables))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_accuracy(spark, tmp_path):
    rows = corpus()
    docs = awkward(spark, *[(1_000 + i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(1_000 + i, 1, y, 0.0) for i, _, y in rows] + [(None, 1, 1, 0.0), (4, 1, None, 0.0)], LABELS)
    found = toxicity.op4_toxicity(spark, write(tmp_path, documents=docs, labels=labels)).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    truth = {1_000 + i: y for i, _, y in rows}
    held = [(r.predicted, truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(r.predicted == 0 for r in found if r.doc_id in (1, 2, 3))


def test_without_labels(spark, tmp_path):
    docs = documents(spark, [(1, "you idiot, you worthless scum"), (2, "a kind word")])
    found = toxicity.op4_toxicity(spark, write(tmp_path, documents=docs, labels=spark.createDataFrame([], LABELS))).collect()
    assert {r.doc_id: r.predicted for r in found} == {1: 1, 2: 0}
    g = toxicity.train(docs, spark.createDataFrame([], LABELS))
    assert [r.doc_id for r in toxicity.drop_toxic(docs, g).collect()] == [2]
    assert toxicity.drop_toxic(documents(spark, []), g).count() == 0
    assert toxicity.op4_toxicity(spark, write(tmp_path / "e", documents=documents(spark, []), labels=spark.createDataFrame([], LABELS))).count() == 0


def test_counts_handed_on_early_are_summed(spark, monkeypatch):
    rows = [(i, f"{'you are a ' + ('grobbler' if i % 3 else 'snarfelo') if i % 2 else 'have a nice day'} {chr(97 + i % 26)}word{i}", i % 2) for i in range(120)]
    sample = spark.createDataFrame(rows, "row long, text string, y int")
    whole = toxicity.learn(sample)
    monkeypatch.setattr(toxicity, "HELD_COUNTS", 5)
    early = toxicity.learn(sample)
    assert whole.lexicon.begins and (early.lexicon.whole, early.lexicon.begins) == (whole.lexicon.whole, whole.lexicon.begins)
    assert np.allclose(early.coef, whole.coef)
