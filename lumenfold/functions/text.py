"""Column functions on text. Patterns run with Unicode classes and with line ends of \\n only."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .lexicon import BULLETS, LIGATURES, MAX_CHARS


def rx(pattern: str) -> str:
    """The pattern with its flags, in ASCII: Spark decodes it anew for each value, which is slow for other characters."""
    return "(?Ud)" + "".join(c if c < "\x80" else f"\\x{{{ord(c):x}}}" for c in pattern)


#: What \\s stands for in patterns with Unicode classes.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """A group of the first match, or null; for groups that are never empty. (nullif would search twice wherever Spark can't set its value apart, as in lambdas.)"""
    return let(F.regexp_extract(c, rx(pattern), group), blank_to_null)


def matches(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(rx(pattern)))


def any_match(c: Column, patterns) -> Column:
    """Whether any pattern is found; one scan over the alternatives."""
    return matches(c, "(?:" + "|".join(patterns) + ")")


def trie(names, space: str = " ", any_case: bool = True) -> str:
    """A pattern of names (in small letters), the longest that fits, in which shared beginnings stand once: far quicker than a list of alternatives.

    space: a pattern for spaces. any_case: letters are classes of those that differ only in case.
    """
    fold = {"i": "iIİı", "k": "kK\u212a", "s": "sSſ"}
    tails: dict[str, set[str]] = {}
    for n in names:
        if n:
            tails.setdefault(n[0], set()).add(n[1:])
    one = lambda a: space if a == " " else f"[{fold.get(a, a + a.upper())}]" if any_case and a.isalpha() else re.escape(a)
    parts = [one(a) + trie(rest, space, any_case) for a, rest in sorted(tails.items())]
    if not parts:
        return ""
    if "" in names:
        return "(?:" + "|".join(parts) + ")?"
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def ahead(names, n: int, any_case: bool = True) -> str:
    """A quick pattern of the next n characters (n: at most the length of the shortest name) that all names match and few other words: by place, the letters of the names.

    A space of a name may be longer, so that any character may follow it. any_case: whatever isn't ASCII passes too. The classes are of ASCII only, which Java looks up in a table.
    """
    classes = []
    for i in range(n):
        if any(" " in name[:i] for name in names):
            break
        letters = sorted({x for name in names for c in name[i] for x in {c, c.upper() if any_case else c} if x.isascii() and x != " "})
        apart = r"\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f" if any(name[i] == " " for name in names) else ""
        classes.append(f"[{''.join(map(re.escape, letters))}{apart}]")
    return "(?:" + "".join(classes) + (rf"|[\x00-\x7f]{{0,{len(classes) - 1}}}[^\x00-\x7f]" if any_case else "") + ")"


def contains_any(c: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in parts])


def starts_with_any(c: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(c, F.lit(p)) for p in parts])


def split_lines(c: Column, tidy: bool = False) -> Column:
    """Stripped lines. tidy: c comes from clean() or is made of its lines, so that only the end of the whole can hold spaces (where it was cut)."""
    return F.split(strip(c), "\n") if tidy else F.transform(F.split(c, "\n"), strip)


def lines(c: Column, tidy: bool = False) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(split_lines(c, tidy), lambda x: x != "")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(rx(r"\S+")), F.lit(0))  # split would compile its pattern anew for each value


def title(c: Column) -> Column:
    """Each run of letters with a capital first and small letters after it."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), F.initcap), "")


def fixed(c: Column, digits: int) -> Column:
    """The number with so many decimals, halves to even on its exact value."""
    return F.replace(F.format_number(c, digits), F.lit(","), F.lit(""))


def rounded(c: Column) -> Column:
    return fixed(c, 1).cast("double")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x))


@cache
def composable() -> str:
    """A pattern of one of the characters that the composed form changes, alone or after others.

    Those are: characters that are not composed themselves, marks that move, and what stands second in
    a canonical decomposition (Hangul vowels and finals by their range).
    """
    found = set(range(0x1161, 0x11C3))
    for point in range(0x80, 0x110000):
        ch = chr(point)
        if 0xD800 <= point < 0xE000 or not (parts := unicodedata.decomposition(ch)) and not unicodedata.combining(ch):
            continue
        if unicodedata.combining(ch) or unicodedata.normalize("NFC", ch) != ch:
            found.add(point)
        if parts and "<" not in parts:
            found.update(int(x, 16) for x in parts.split()[1:])
    ranges, points = [], sorted(found)
    for point in points:
        if ranges and ranges[-1][1] == point - 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    shown = lambda pairs: "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in pairs)
    # the class has hundreds of ranges: plain text, then its largest gaps and punctuation are seen before it
    gaps = [(a[1] + 1, b[0] - 1) for a, b in zip(ranges, ranges[1:])]
    quick = sorted({*sorted(gaps, key=lambda g: g[0] - g[1])[:4], *(g for g in gaps if 0x2000 <= g[0] < 0x2600 and g[1] - g[0] > 100)})
    return f"(?=[^\\x00-\\x{{2ff}}])(?=[^{shown(quick)}])[{shown(ranges)}]"


def nfc(c: Column) -> Column:
    """Composed form; only texts with a character that composing could change go through Python."""
    return F.coalesce(_nfc(F.when(F.regexp_like(c, F.lit(composable())), c)), c)


def unify(c: Column) -> Column:
    """Ligatures, composed form, spaces, line ends and bullets made uniform."""
    plain = c
    for a, b in LIGATURES:
        plain = F.replace(plain, F.lit(a), F.lit(b))
    c = nfc(F.when(F.regexp_like(c, F.lit(_any_of("".join(a for a, _ in LIGATURES)))), plain).otherwise(c))
    for a, b in (("\xa0", " "), ("\r\n", "\n"), ("\r", "\n")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, _any_of(BULLETS), "\n- ")


def _any_of(chars: str) -> str:
    """A class of characters that are compared one by one, seen by their range first: most characters of a text lie outside it."""
    points = sorted(map(ord, chars))
    return f"(?=[\\x{{{points[0]:x}}}-\\x{{{points[-1]:x}}}])[{''.join(f'\\x{{{p:x}}}' for p in points)}]"


def clean(c: Column, max_chars: int | None = MAX_CHARS) -> Column:
    """The normalised text: tidy lines, at most two blank ones in a row, at most max_chars characters if it is given."""
    c = F.regexp_replace(unify(F.coalesce(c, F.lit(""))), r"\t[ \t]*| [ \t]+", " ")  # a single space stays
    c = F.regexp_replace(c, r"(?Umd)(?=[^!-~])(?:^[^\S\n]+|[^\S\n]+$)", "")
    c = strip(F.regexp_replace(c, "\n{4,}", "\n\n\n"))
    return c if max_chars is None else F.substring(c, 1, max_chars)
