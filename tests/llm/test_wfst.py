import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm import pieces, wfst

from .helpers import awkward, documents, write

MODEL = pieces.default_model()
VOCABULARY = pieces.Vocabulary.load()
CODEC = wfst.Codec(VOCABULARY)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TEXTS = ["", " ", "  Hello   wörld\n\tx 日本 😀 ", "a  b", "▁x", " " * 17 + "x", "a" + " " * 40 + "b", "\n\n x\n\ny", "The the THE", "x" * 300, "\u0000", "token = \"ab12\"\nnext"]


@pytest.mark.parametrize("text", TEXTS)
def test_same_as_the_library(text):
    assert CODEC.encode(text) == LIBRARY.encode(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60) | st.text(alphabet="ab th e\n.", max_size=80))
def test_round_trip(text):
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode(text)
    assert CODEC.decode(ids) == (text if "▁" not in text else text.replace("▁", " "))


def every_path(codec, word):
    """All (cost, ids) of a word's composition with the token machine and the pairs, one by one."""
    text, out = word, []

    def go(at, last, cost, ids):
        if at == len(text):
            out.append((cost, ids))
            return
        found = [(i, p) for i, p in enumerate(VOCABULARY.pieces) if VOCABULARY.kinds[i] == pieces.NORMAL and text.startswith(p, at)]
        for i, p in found:
            if codec.pairs.arcs(np.array([last]), np.array([i]))[0]:
                go(at + len(p), i, cost + codec.cost[i], [*ids, i])
        if not any(len(p) == 1 for _, p in found):
            go(at + 1, -1, cost + codec.cost[-1], [*ids, *codec._spelled(ord(text[at]))])

    go(0, -1, 0.0, [])
    return out


@pytest.mark.parametrize("word", ["▁internat", "▁thththe", "▁日x", "▁aaaaa", "▁Anblewh"])
def test_shortest_of_all_paths(word):
    paths = every_path(CODEC, word)
    assert min(paths)[1] == np.frombuffer(CODEC.shortest([word])[0], "<i4").tolist()
    assert len(paths) == 1  # merging leaves one sequence


def test_a_word_is_learned_once_whatever_signs_follow_it():
    codec, text = wfst.Codec(VOCABULARY), "foo$$$ foo, foo.\nfoo (foo) it's foo"
    assert codec.encode(text) == LIBRARY.encode(text)
    assert {p for p in codec.seen if "foo" in p} == {"▁foo", "\nfoo", "▁(foo"}


def test_texts_are_not_cut_where_pieces_go_on():
    v = unigram()
    v.pieces += ["b.", "\n"]
    v.scores += [-1.0, -1.0]
    v.kinds += [1, 1]
    assert wfst.Codec(v).parts.findall("▁ab.\na▁▁b") == ["▁ab.\na", "▁▁b"]
    assert wfst.Codec(unigram()).parts.findall("▁ab.\na▁▁b,a") == ["▁ab", ".", "\na", "▁▁b", ",a"]


def test_pairs_stand_as_merging_leaves_them():
    machine, ids = CODEC.pairs, {p: i for i, p in enumerate(VOCABULARY.pieces) if VOCABULARY.kinds[i] == pieces.NORMAL}
    cuts = [(p[:k], p[k:]) for p in list(ids)[::7] for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
    pairs = [*cuts, *zip(list(ids)[::5], list(ids)[3::5])]
    assert all(machine.stands(ids[a], ids[b]) == (machine.merged(a + b) == [a, b]) for a, b in pairs)
    assert all(machine.stands(-1, ids[p]) == (machine.merged(p) == [p]) for p in ids)


def test_rewriter():
    r = wfst.Rewriter({"a": "1", "ab": "2", "abcd": "3", "x": "yy", "é": "é"})
    assert [r(t) for t in ("", "aab", "abc", "abcd", "xa", "zz", "é")] == ["", "12", "2c", "3", "yy1", "zz", "é"]


def unigram():
    v = pieces.Vocabulary(model_type=pieces.UNIGRAM, byte_fallback=True, squeeze=False)
    for p, s, k in [("<unk>", 0, 2), *[(f"<0x{b:02X}>", 0, 6) for b in range(256)], ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.5, 1), ("ab", -4.0, 1), ("▁a", -4.5, 1), ("abb", -9.0, 1), ("ba", -5.5, 1)]:
        v.pieces.append(p), v.scores.append(float(s)), v.kinds.append(k)
    return v


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab ", max_size=9))
def test_unigram_paths_are_cheapest(text):
    codec = wfst.Codec(unigram())
    cost = {p: -s for p, s, k in zip(unigram().pieces, unigram().scores, unigram().kinds) if k == 1}

    def best(rest):
        return 0.0 if not rest else min((cost[p] + best(rest[len(p) :]) for p in cost if rest.startswith(p)), default=float("inf"))

    ids = codec.encode(text)
    assert sum(cost[unigram().pieces[i]] for i in ids) == pytest.approx(best(codec.normalise(text)))
    assert codec.decode(ids) == text


def test_query_on_awkward_rows(spark, tmp_path):
    docs = awkward(spark)
    rows = wfst.op3_sentencepiece(spark, write(tmp_path, documents=docs)).collect()
    assert len(rows) == docs.count()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, set()).add(r.text)
    for r in rows:
        assert any((None if t is None else LIBRARY.encode(t)) == r.ids for t in texts[r.doc_id])
        assert r.round_trip is (None if r.ids is None else True) and r.n_tokens == len(r.ids or [])
    assert wfst.encode(documents(spark, []), CODEC).count() == 0
