"""Names of a table, of any size, that stand as whole tokens in texts: one pass over a text, whatever the table's length.

Texts and names are cut alike into atoms (runs of letters, digits, _, # and +) and what stands between. A row for each
atom of a text, with the few pieces that follow, is joined by its first atom with the table's first atoms and
the numbers of atoms of their names, and what passes by the whole run of pieces with the names. So the work is that of
the text's atoms and of the hits, not texts times names. Both tables of names are broadcast up to `BROADCAST` names
(counted first); beyond that Catalyst joins by shuffles, and splits skewed atoms at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

BROADCAST = 200_000
_ATOM = r"[\w#+]+"


def _pieces(low: Column) -> Column:
    """Each atom with what follows it."""
    return F.regexp_extract_all(low, F.lit(T.rx(rf"({_ATOM}[^\w#+]*)")), F.lit(1))


def _lead(low: Column) -> Column:
    return F.regexp_extract(low, T.rx(r"^([^\w#+]*)"), 1)


def _atom(piece: Column) -> Column:
    return F.regexp_extract(piece, T.rx(f"^({_ATOM})"), 1)


def names_table(names: DataFrame) -> DataFrame:
    """names (name, ...) with what is looked up: lead (before its first atom), core, tail, first and n (its atoms)."""
    low = F.lower("name")
    rows = names.withColumns({"_pieces": _pieces(low), "lead": _lead(low), "_low": low}).filter(F.size("_pieces") > 0)
    body = F.substring("_low", F.length("lead") + 1, F.length("_low"))
    tail = F.regexp_extract("_low", T.rx(r"([^\w#+]*)$"), 1)
    rows = rows.withColumns({"tail": tail, "first": _atom(F.col("_pieces")[0]), "n": F.size("_pieces")})
    return rows.withColumn("core", F.substring(body, F.lit(1), F.length(body) - F.length("tail"))).drop("_pieces", "_low")


def find(docs: DataFrame, key: str, text: Column, names: DataFrame, before: str = ".") -> DataFrame:
    """key and the columns of names, once for each name that stands in a row's text in any case.

    No atom's character and none of `before` may stand right before a name, no atom's character right after it. Names
    without an atom are never found; null texts hold none.
    """
    table = names_table(names)
    n_names, longest = names.count(), table.agg(F.max("n")).first()[0] or 1
    hint = F.broadcast if n_names <= BROADCAST else (lambda t: t)
    low = F.lower(F.coalesce(text, F.lit("")))
    window = lambda ps, i: F.slice(ps, i + 1, F.lit(longest))
    before_of = lambda ps, head, i: F.when(i == 0, head).otherwise(F.regexp_extract(ps[F.greatest(i - 1, F.lit(0))], T.rx(rf"^{_ATOM}([^\w#+]*)"), 1))
    places = T.let(_pieces(low), lambda ps: F.transform(ps, lambda p, i: F.struct(_atom(p).alias("first"), before_of(ps, _lead(low), i).alias("gap"), (i == 0).alias("start"), window(ps, i).alias("next"))))
    rows = docs.select(key, F.explode_outer(places).alias("p")).select(key, "p.*").filter(F.col("first").isNotNull())
    starts = hint(table.select("first", "n").distinct())
    rows = rows.join(starts, "first").filter(F.col("n") <= F.size("next"))
    last = F.get("next", F.col("n") - 1)
    core = F.concat(F.array_join(F.slice("next", F.lit(1), F.col("n") - 1), ""), _atom(last))
    rows = rows.select(key, "gap", "start", core.alias("core"), F.substring(last, F.length(_atom(last)) + 1, F.length(last)).alias("after"), (F.size("next") == F.col("n")).alias("end"))
    hits = rows.join(hint(table.drop("first", "n")), "core")
    # what stands before lead is a character of the gap, the atom before the gap, or nothing
    rest = F.substring("gap", F.lit(1), F.length("gap") - F.length("lead"))
    free = F.col("gap").endswith(F.col("lead")) & F.when(rest == "", F.col("start") | (F.col("lead") == "")).otherwise(~F.right(rest, F.lit(1)).isin(*before) if before else F.lit(True))
    closed = F.col("after").startswith(F.col("tail")) & ((F.col("after") != F.col("tail")) | (F.col("tail") == "") | F.col("end"))
    return hits.filter(free & closed).select(key, *names.columns).distinct()
