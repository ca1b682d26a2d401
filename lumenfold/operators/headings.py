"""Headings of a table, of any size, found in lines of texts, and the sections that they open.

The row-wise form (`sections`) has the fixed headings in its patterns. Here headings are rows (name, section, rank), and
the search walks a trie of their words as two joins: a line's words meet the first words of the names with the names'
numbers of words, and what passes meets the whole names. So a line costs its words and hits, however many headings there
are. Both tables of names are broadcast up to `BROADCAST` names (counted first); beyond that Catalyst joins by
shuffles. Only lines with a heading are grouped. Python does nothing here.

A line is a heading if, after ornaments, it begins with a name, a separator and a tail of two characters or more (then the
tail belongs to the section), or else if, bare of ornaments and numbering, it has `LONGEST` characters at most and holds
a name as whole words. The first kind wins over the second; then the smallest rank wins. Case doesn't count, nor how
much space stands between words. Of a name counts what lies from its first to its last word; names without a word
are never found. Null and empty texts have no headings; an empty table of names finds none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import SECTIONS
from .sections import _plain, bare

BROADCAST = 200_000
LONGEST = 50
BEGINNING = 100
_CORE = r"(\w+(?:.*\w)?)"


def fixed(spark: SparkSession) -> DataFrame:
    """The fixed headings as a table: name, section, rank."""
    patterns = [(s, p) for s, names in SECTIONS.items() for p in names]
    return spark.createDataFrame([(name, s, i) for i, (s, p) in enumerate(patterns) for name in _plain(p)], "name string, section string, rank int")


def _folded(c: Column) -> Column:
    """Lower case of the same length; letters that differ only in case, by whatever form, become one."""
    for a, b in ("İi", "ıi", "ſs"):
        c = F.replace(c, F.lit(a), F.lit(b))  # translate would look up each character of the text
    return F.replace(F.lower(c), F.lit("ς"), F.lit("σ"))


def _spaced(c: Column) -> Column:
    return F.regexp_replace(c, T.rx(r"\s+"), " ")


def _pieces(c: Column) -> Column:
    """Each word with what follows it."""
    return F.regexp_extract_all(c, F.lit(T.rx(r"(\w+\W*)")), F.lit(1))


def _begin(c: Column, n: int) -> Column:
    """The first n words with what follows them, if a text begins with a word, else an empty text; all of it if n is over `BEGINNING`."""
    return F.regexp_extract(c, T.rx(rf"^(?:\w++\W*+){{1,{n}}}+"), 0) if n <= BEGINNING else c


def _short(line: Column) -> Column:
    """The bare line if it can be short enough for a heading, else null: all letters of a line are in the bare one."""
    long = F.length(line) > LONGEST
    return F.when(~(long & T.matches(line, rf"(?:\p{{L}}\P{{L}}*+){{{LONGEST + 1}}}")), bare(line))


def _word(piece: Column) -> Column:
    return F.regexp_extract(piece, T.rx(r"^(\w+)"), 1)


def names_table(headings: DataFrame) -> DataFrame:
    """section, rank, core (what is looked up), first and n (its words); of equal cores the smallest rank."""
    core = F.regexp_extract(_spaced(_folded(F.col("name"))), T.rx(_CORE), 1)
    rows = headings.select(core.alias("core"), "section", "rank").filter("core <> ''")
    rows = rows.groupBy("core").agg(F.min(F.struct("rank", "section")).alias("h")).select("core", "h.*")
    return rows.withColumn("_pieces", _pieces(F.col("core"))).withColumns({"first": _word(F.col("_pieces")[0]), "n": F.size("_pieces")}).drop("_pieces")


def lines(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """key, line_no (from 0) and line, stripped, for each line that isn't blank."""
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line", T.strip(F.col("line")))
    return rows.filter("line <> ''")


def find(docs: DataFrame, key: str, text: Column, headings: DataFrame) -> DataFrame:
    """key, line_no (from 0), section, tail (null if none) of each line that is a heading; key tells the rows of docs apart."""
    table = names_table(headings)
    n_names, longest = table.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(1))).first()
    hint = F.broadcast if n_names <= BROADCAST else (lambda t: t)
    rest = F.ltrim(F.col("line"), F.lit(T.SPACES + "#*=-"))
    rows = lines(docs, key, text).select(key, "line_no", rest.alias("rest"), _short(F.col("line")).alias("bare"))

    def places(c: Column, kind: int) -> Column:
        part = lambda ps, i: F.struct(F.lit(kind).alias("kind"), _word(ps[i]).alias("first"), F.slice(ps, i + 1, F.lit(longest)).alias("next"))
        if kind == 0:  # only at the line's start
            return T.let(_pieces(c), lambda ps: F.when((F.size(ps) > 0) & c.startswith(ps[0]), F.array(part(ps, F.lit(0)))))
        return T.let(_pieces(c), lambda ps: F.transform(ps, lambda _, i: part(ps, i)))

    none = F.expr("cast(array() as array<struct<kind:int,first:string,next:array<string>>>)")
    at = F.concat(F.coalesce(places(_folded(_begin(F.col("rest"), longest)), 0), none), F.when(F.length("bare") <= LONGEST, places(_folded(F.col("bare")), 1)).otherwise(none))
    rows = rows.select(key, "line_no", "rest", F.explode(at).alias("p")).select(key, "line_no", "rest", "p.*")
    rows = rows.join(hint(table.select("first", "n").distinct()), "first").filter(F.col("n") <= F.size("next"))
    whole = F.concat(F.array_join(F.slice("next", F.lit(1), F.col("n") - 1), ""), _word(F.get("next", F.col("n") - 1)))
    rows = rows.select(key, "line_no", "rest", "kind", whole.alias("whole")).withColumn("core", _spaced(F.col("whole")))
    hits = rows.join(hint(table.select("core", "section", "rank")), "core")
    after = F.substring(F.col("rest"), F.length("whole") + 1, F.length("rest"))
    tail = T.found(after, r"^[:\s|-]++(?![:*=-]+$)(..+)$", 1)
    hits = hits.withColumn("tail", F.when(F.col("kind") == 0, tail)).filter((F.col("kind") == 1) | F.col("tail").isNotNull())
    best = hits.groupBy(key, "line_no").agg(F.min(F.struct("kind", "rank", "section", "tail")).alias("h"))
    return best.select(key, "line_no", "h.section", "h.tail")


def contents(docs: DataFrame, key: str, text: Column, headings: DataFrame) -> DataFrame:
    """key, section, content: what stands under each section's headings, joined by a blank line; sections without text are left out.

    A document's headings come to it in one join by key; its lines are sliced and joined once. The join is by sorting: Spark
    guesses the size of composed texts from that of the columns they come from, and would send whole documents to the driver.
    """
    found = find(docs, key, text, headings).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "section", "tail"))).alias("heads"))
    rows = docs.select(key, F.transform(F.split(text, "\n"), T.strip).alias("lines")).join(found.hint("merge"), key)

    def part(h: Column, i: Column) -> Column:
        end = F.coalesce(F.get("heads", i + 1)["line_no"], F.size("lines"))
        own = F.concat(F.array_compact(F.array(h["tail"])), F.slice("lines", h["line_no"] + 2, end - h["line_no"] - 1))
        return F.struct(h["section"].alias("section"), T.strip(F.array_join(own, "\n")).alias("content"))

    def joined(parts: Column) -> Column:
        own = lambda s: F.array_join(F.transform(F.filter(parts, lambda p: p["section"] == s), lambda p: p["content"]), "\n\n")
        return F.transform(F.array_distinct(F.transform(parts, lambda p: p["section"])), lambda s: F.struct(s.alias("section"), own(s).alias("content")))

    full = F.filter(F.transform("heads", part), lambda p: p["content"] != "")
    return rows.select(key, F.explode(T.let(full, joined)).alias("s")).select(key, "s.*")
