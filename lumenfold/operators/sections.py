"""Cleaning and sections: one document is one row all the way, so nothing is shuffled."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicon import MAX_CHARS, SECTIONS

HEADER = "struct<section:string,tail:string>"


def _plain(pattern: str) -> list[str]:
    """The names that a pattern of the fixed headings stands for."""
    pattern = pattern.replace(r"\s+", " ")
    choice = re.search(r"\(\?:([^)]*)\)|\[([^\]]*)\]", pattern)
    if not choice:
        return [pattern]
    options = choice[1].split("|") if choice[1] else list(choice[2])
    return [name for o in options for name in _plain(pattern[: choice.start()] + o + pattern[choice.end() :])]


def _trie(patterns: Iterable[str], space: str) -> str:
    return T.trie({name for p in patterns for name in _plain(p)}, space=space)


def bare(line: Column) -> Column:
    """A possible header without its ornaments, in lower case."""
    for pattern, by in ((r"^[\s#*=-]*", ""), (r"[\s:*=-]*$", ""), (r"^(?:\d+[\s.)|/-]+|\/\/\s*)", ""), (r"[\[\]{}()]", " "), (r"\s+", " ")):
        line = F.regexp_replace(line, T.rx(pattern), by)
    return F.lower(T.strip(line))


def _named(section: str, names: tuple[str, ...]) -> str:
    """The pattern of a heading with text after it. The order of the names decides where one begins with another."""
    return rf"(?i)^[\s#*=-]*(?:{'|'.join(names)})[:\s|-]++(?![:*=-]+$)(..+)$"


@cache
def _exact() -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """The names that are headings as they stand, by the section that header() gives them: as bare lines, and as whole lines (without those that are read as a shorter name and its text)."""
    found = {s: [] for s in SECTIONS}
    for name in dict.fromkeys(n for names in SECTIONS.values() for p in names for n in _plain(p)):
        found[next(s for s, names in SECTIONS.items() if re.search(rf"\b(?:{'|'.join(names)})\b", name))].append(name)
    tailed = lambda n: any(re.search(_named(s, names), n) for s, names in SECTIONS.items())
    return found, {s: [n for n in names if not tailed(n)] for s, names in found.items()}


def header(line: Column) -> Column:
    """struct(section, tail) if a stripped line is a header, else null.

    A header with text after it on its line wins over a bare one, and sections win in their order.
    Separators are matched possessively: a tail never begins with one.
    """

    def inline(section: str, names: tuple[str, ...]) -> Column:
        return T.let(T.found(line, _named(section, names), 1), lambda t: F.when(t.isNotNull(), F.struct(F.lit(section).alias("section"), t.alias("tail"))))

    empty = lambda s: F.struct(F.lit(s).alias("section"), F.lit(None).cast("string").alias("tail"))
    listed = lambda name, known: F.coalesce(*[F.when(name.isin(*names), empty(s)) for s, names in known.items()])
    bares, wholes = _exact()

    def alone(name: Column) -> Column:
        named = [F.when(T.matches(name, r"\b" + _trie(names, " ") + r"\b"), empty(s)) for s, names in SECTIONS.items()]
        return F.when(F.length(name) <= 50, F.coalesce(listed(name, bares), *named))  # most are the name itself

    # most lines hold no heading, which a trie of all names is quick to see; brackets between words become spaces of the bare line
    names = [p for names in SECTIONS.values() for p in names]
    plain = {n for p in names for n in _plain(p)}
    every, first = rf"(?<![A-Za-z0-9])(?={T.ahead(plain, 4)})\b" + _trie(names, r"[\s\[\]{}()]+"), r"^[\s#*=-]*" + _trie(names, r"\s+") + r"[:\s|-]+[^\n]"
    tailed = F.when(T.matches(line, first), F.coalesce(*[inline(s, names) for s, names in SECTIONS.items()]))
    return F.when(T.matches(line, every), F.coalesce(T.let(F.lower(line), lambda low: listed(low, wholes)), tailed, T.let(bare(line), alone)))


def section_map(clean: Column, tidy: bool = False) -> Column:
    """map of section to its content; the contents of repeated headers are joined by a blank line.

    The headers' places part the lines; each part is sliced and joined once. tidy: see `text.split_lines`.
    """

    def parts_of(lines: Column) -> Column:
        heads = F.transform(lines, lambda x: F.when(x != "", header(x)))
        return T.let(heads, lambda h: T.let(F.filter(F.transform(h, lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull()), lambda at: cut(lines, h, at)))

    def cut(lines: Column, heads: Column, at: Column) -> Column:
        def part(start: Column, k: Column) -> Column:
            head, end = F.get(heads, start), F.coalesce(F.get(at, k + 1), F.size(lines))
            own = F.concat(F.array_compact(F.array(head["tail"])), F.slice(lines, start + 2, end - start - 1))
            return F.struct(head["section"].alias("section"), F.array_join(own, "\n").alias("content"))

        return F.transform(at, part)

    def joined(parts: Column) -> Column:
        full = F.filter(F.transform(parts, lambda p: F.struct(p["section"].alias("section"), T.strip(F.coalesce(p["content"], F.lit(""))).alias("content"))), lambda p: p["content"] != "")

        def entry(full: Column, section: str) -> Column:
            own = F.transform(F.filter(full, lambda p: p["section"] == section), lambda p: p["content"])
            return F.struct(F.lit(section).alias("key"), F.array_join(own, "\n\n").alias("value"))

        return T.let(full, lambda f: F.map_from_entries(F.filter(F.array(*[entry(f, s) for s in SECTIONS]), lambda e: e["value"] != "")))

    return joined(T.let(T.split_lines(clean, tidy), parts_of))


def normalise(docs: DataFrame, column: str = "raw_text", max_chars: int = MAX_CHARS) -> DataFrame:
    """docs with clean_text, sections, word_count and char_count; blank texts give '' and zeros."""
    out = docs.withColumn("clean_text", T.clean(F.col(column), max_chars))
    counts = {"word_count": F.size(T.words(F.col("clean_text"))), "char_count": F.length("clean_text")}
    return out.withColumns({"sections": section_map(F.col("clean_text"), tidy=True), **counts})
