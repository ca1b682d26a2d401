"""Small document tables with the awkward rows that every operator must take."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kind string"


def documents(spark, rows, extra=True):
    """rows: (doc_id, text[, lang[, source]]). Two further columns have names that clash with results."""
    full = []
    for r in rows:
        i, t, lang, source = (*r, *[None] * 4)[:4]
        full.append((i, t, lang, source, None if t is None else len(t), 0.5, "own"))
    df = spark.createDataFrame(full, DOCS)
    return df if extra else df.drop("score", "kind")


def awkward(spark, *more):
    """Null and empty texts, a null id, blanks only, repeated rows, a long text, odd characters."""
    base = [
        (1, None), (2, ""), (None, "a row without id"), (3, " \t\n "), (4, "same text here twice"), (4, "same text here twice"), (5, "same text here twice"),
        (6, "long " * 30_000), (7, "日本語 😀 naïve Ünïcode \u0000 nul"), (8, "x" * 5_000),
    ]
    return documents(spark, [*base, *more])


def write(tmp_path, **tables):
    """A folder of tables as the queries expect it."""
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)
