import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenfold.llm import lattice, pieces

from .helpers import awkward, documents, write

VOCABULARY = pieces.Vocabulary.load()
TRIE = VOCABULARY.trie()


def by_paths(model, word):
    """Probability of a word as the sum over all its segmentations, one by one; and expected piece counts."""
    text, total, counts = "▁" + word, 0.0, Counter()

    def walk(i, logp, used):
        nonlocal total
        if i == len(text):
            total += math.exp(logp)
            for u in used:
                counts[u] += math.exp(logp)
            return
        node, single = TRIE, False
        for j in range(i, len(text)):
            node = node.get(text[j])
            if node is None:
                break
            if "" in node:
                single = single or j == i
                walk(j + 1, logp + model.logp[node[""]], [*used, node[""]])
        if not single:
            ids = [int(model.bytes_of[b]) for b in text[i].encode()]
            walk(i + 1, logp + sum(model.logp[k] for k in ids), [*used, *ids])

    walk(0, 0.0, [])
    return math.log(total), {k: v / total for k, v in counts.items()}


def test_forward_backward_against_paths():
    model = lattice.Lattice(VOCABULARY)
    words = ["the", "hello", "a", "ñandú", "日x", "😀", "thethe", "x,", ""]
    got = model.run(words)
    assert np.allclose(got, [by_paths(model, w)[0] for w in words])
    for w in words[:6]:
        expected = np.zeros(len(model.logp))
        model.run([w], np.array([2.0]), expected)
        want = by_paths(model, w)[1]
        assert {int(i) for i in np.flatnonzero(expected > 1e-12)} <= set(want) and all(abs(expected[k] - 2 * v) < 1e-9 for k, v in want.items())


def test_words_of_mixed_lengths_and_very_long_ones():
    model = lattice.Lattice(VOCABULARY)
    r = random.Random(0)
    words = ["".join(r.choice("abcdeé") for _ in range(n)) for n in (1, 3, 200, 7, 40, 3, 90, 1)]
    assert np.allclose(model.run(words), [model.run([w])[0] for w in words])
    assert np.isfinite(model.run(["z" * 20_000])).all()


def test_weights_are_a_distribution():
    model = lattice.Lattice(VOCABULARY)
    expected = np.zeros(len(model.logp))
    model.run(["the", "cat"], np.array([5.0, 1.0]), expected)
    model.set_counts(expected, 3)
    assert np.exp(model.logp)[np.exp(model.logp) > 1e-200].sum() + math.exp(model.end) == pytest.approx(1)


def test_query(spark, tmp_path):
    r = random.Random(4)
    rows = [(1_000 + i, " ".join(r.choice(["Die", "the", "x y", f"w{r.randint(0, 50)}", "ÄÖ", "É\u001c"]) for _ in range(r.randint(0, 60)))) for i in range(200)]
    docs = awkward(spark, *rows)
    found = lattice.op10_lattice_lm(spark, write(tmp_path, documents=docs)).collect()
    source = docs.select("doc_id", "text").collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = lambda t: [*lattice.words_of(t), b"\n"]
    counts = Counter(w for d in source if not held(d.doc_id) for w in tokens(d.text))
    n, v = sum(counts.values()), len(counts)
    want = []
    for d in source:
        t = tokens(d.text)
        want.append((str(d.doc_id), held(d.doc_id), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4)))
    assert sorted((str(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 4)) for x in found) == sorted(want)
    assert all(math.isfinite(x.score) and x.score < 0 for x in found)
    by = {}
    for x in found:
        by.setdefault(x.doc_id, set()).add(round(x.score, 6))
    assert by[1] == by[2] == by[3] and len(by[4]) == 1


def test_rare_and_frequent_words_agree(spark, tmp_path, monkeypatch):
    ruler = "=-" * 400
    docs = documents(spark, [(i, f"common words here and rare{i} {ruler}{'x' * (i % 2)}") for i in range(50)])
    read = lambda: sorted((x.doc_id, x.n_known, round(x.base_score, 9), round(x.score, 9)) for x in lattice.score(docs).collect())
    one = read()
    monkeypatch.setattr(lattice, "HEAVY_WORDS", 2)
    assert read() == one
    monkeypatch.setattr(lattice, "LONG", 4)  # nearly all words are sent as digests
    monkeypatch.setattr(lattice, "HEAVY_WORDS", 100)
    assert read() == one


def test_empty(spark, tmp_path):
    assert lattice.op10_lattice_lm(spark, write(tmp_path, documents=documents(spark, []))).count() == 0
