import random

import corpus_pipeline
from pyspark.sql import functions as F

from lumenfold.llm import decontam, pieces, secrets, toxicity, wfst

from .helpers import documents, write

#: Columns whose names the stages use inside, or for results.
CLASHING = ("text_key", "kept_text", "ids", "row", "fp", "root", "chk", "row_key", "times", "y", "part", "key")


def widened(docs):
    for c in CLASHING:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return docs


def near(a, b):
    """The rule of the dedup stage for two texts: similarity of five-word shingles."""
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in (a, b)))
    return 5 * len(x & y) >= 4 * len(x | y)


def tables(spark, tmp_path, rows, passage):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string")
    return write(tmp_path, documents=widened(documents(spark, rows)), labels=labels, benchmark=bench)


def test_stages_against_plain_versions(spark, tmp_path):
    r = random.Random(8)
    passage = " ".join(f"bench{i}" for i in range(30))
    rows = [(i, f"document {i} speaks of rivers and of numbered hills {i * 7} near town {i}") for i in range(40)]
    rows += [(100, "you stupid idiot, you worthless scum, you pathetic moron"), (101, passage), (102, "intro " * 5 + passage), (103, 'the token = "0123456789abcdef0123456789abcdef" leaked'), (104, None), (105, "")]
    rows += [(200 + i, "an exact copy of a page that many sites hold in the very same words") for i in range(30)]
    rows += [(300, "one text of an id that stands twice"), (300, "and quite another text with its own words"), (300, "one text of an id that stands twice"), (None, "a row without any id"), (None, "a row without any id")]
    long = " ".join(f"w{r.randint(0, 10**6)}" for _ in range(30_000))
    rows += [(400, long), (401, long + " end"), (402, long)]
    sf = tables(spark, tmp_path, rows, passage)
    found = corpus_pipeline.run(spark, sf)
    out = {(x.doc_id, None if x.doc_id == 103 else x.text): x for x in found.collect()}

    grammar = toxicity.Grammar()
    stay = [(i, t) for i, t in rows if grammar.score([t])[0] < 0.5]
    order = sorted(dict.fromkeys(stay), key=lambda x: (x[0] is None, x[0] or 0))
    firsts = []
    for i, t in order:
        if not any(near(t, u) for _, u in firsts):
            firsts.append((i, t))
    windows = {tuple(passage.split()[k : k + 13]) for k in range(18)}
    words = {t: decontam.words_of(t) for _, t in firsts}
    clean = [(i, t) for i, t in firsts if not any(tuple(words[t][k : k + 13]) in windows for k in range(len(words[t])))]
    assert set(out) == {(i, None if i == 103 else t) for i, t in clean} and found.count() == len(clean)
    ids = {i for i, _ in out}
    assert not ids & {100, 101, 102, 201, 401, 402} and {200, 104, 300, 400, None} <= ids
    assert secrets.MASK in out[103, None].text and "0123456789abcdef" not in out[103, None].text
    codec = wfst.Codec(pieces.Vocabulary.load())
    assert all(x.ids == (None if x.text is None else codec.encode(x.text)) for x in out.values()) and out[103, None].round_trip
    own = [c for c in CLASHING if c not in wfst.RESULTS]
    assert all(x[c] == f"{c}{'none' if x.doc_id is None else x.doc_id}" for x in out.values() for c in own)


def test_stage_columns(spark, tmp_path):
    docs = widened(documents(spark, [(1, "a b c"), (2, "d e f g")]))
    sf = tables(spark, tmp_path, [], "a passage")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).schema == docs.schema
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert set(docs.columns) | set(wfst.RESULTS) == set(last.columns) and len(last.columns) == len(set(last.columns))


def test_empty(spark, tmp_path):
    sf = tables(spark, tmp_path, [], "a passage")
    assert corpus_pipeline.run(spark, sf).count() == 0
