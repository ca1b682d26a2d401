"""From glyph runs to lines and blocks, and the reading order of blocks on a page, for one and two columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def band(x0: Column, x1: Column, width: Column) -> Column:
    """Where a block stands: both columns (span), left or right."""
    return F.when((x0 < 0.25 * width) & (x1 > 0.65 * width), "span").when(x1 <= 0.48 * width, "left").when(x0 >= 0.35 * width, "right").otherwise("span")


def page_order(blocks: Column) -> Column:
    """The text of a page in reading order, from its array of blocks (block_no, page_width, x0, y0, x1, y1, text).

    With at least two blocks in each column it is read top, middle, left, right, bottom; else in the
    order of the blocks. Blank blocks count nowhere.
    """
    field = lambda r: F.struct(r["block_no"].alias("block_no"), r["x0"].alias("x0"), r["y0"].alias("y0"), r["y1"].alias("y1"), band(r["x0"], r["x1"], r["page_width"]).alias("band"), F.struct(T.strip(r["text"]).alias("text")).alias("t"))
    rows = F.array_sort(F.filter(F.transform(blocks, field), lambda r: r["t"]["text"] != ""))
    by_height = lambda rows: F.array_sort(F.transform(rows, lambda r: F.struct(r["y0"].alias("y0"), r["x0"].alias("x0"), r["block_no"].alias("n"), r["t"].alias("t"))))
    texts = lambda rows: F.transform(rows, lambda r: r["t"])

    def ordered(b: Column, l: Column, r: Column, s: Column) -> Column:
        both = F.concat(l, r)
        top, bottom = F.array_min(F.transform(both, lambda x: x["y0"])), F.array_max(F.transform(both, lambda x: x["y1"]))
        above = F.filter(s, lambda x: x["y1"] <= top + 20)
        below = F.filter(s, lambda x: ~(x["y1"] <= top + 20) & (x["y0"] >= bottom - 20))
        middle = F.filter(s, lambda x: ~(x["y1"] <= top + 20) & ~(x["y0"] >= bottom - 20))
        columns = F.concat(texts(by_height(above)), texts(middle), texts(by_height(l)), texts(by_height(r)), texts(by_height(below)))
        return F.when((F.size(l) >= 2) & (F.size(r) >= 2), columns).otherwise(texts(b))

    def banded(b: Column) -> Column:
        own = lambda name: F.filter(b, lambda r: r["band"] == name)
        return T.let(F.struct(own("left").alias("l"), own("right").alias("r"), own("span").alias("s")), lambda x: ordered(b, x["l"], x["r"], x["s"]))

    return F.array_join(F.transform(T.let(rows, banded), lambda t: t["text"]), "\n\n")


def _cut(rows: Column, starts: Callable[[Column, Column], Column]) -> Column:
    """An array cut before each element (but the first) for which starts(element before, element) holds."""
    places = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: (i == 0) | starts(rows[F.greatest(i - 1, F.lit(0))], rows[i]))
    parts = lambda at: F.transform(at, lambda p, j: F.slice(rows, p + 1, F.when(j + 1 < F.size(at), at[F.least(j + 1, F.size(at) - 1)]).otherwise(F.size(rows)) - p))
    return F.when(F.size(rows) > 0, T.let(places, parts)).otherwise(F.array(rows))


def _hull(rows: Column, text: Column) -> Column:
    edge = lambda f, of: of(F.transform(rows, lambda r: r[f])).alias(f)
    return F.struct(edge("y0", F.array_min), edge("x0", F.array_min), edge("x1", F.array_max), edge("y1", F.array_max), edge("size", F.array_max), text.alias("text"))


def text_lines(runs: Column) -> Column:
    """Pieces of lines from an array of glyph runs (x0, y0, x1, y1, size, text), top down, then left to right.

    Runs whose feet are within a third of their size stand on one line; a gap of over 1.2 sizes parts a
    line (so columns stay apart), one of over 0.15 sizes is a space.
    """
    by_foot = F.array_sort(F.transform(runs, lambda r: F.struct(*[r[f].alias(f) for f in ("y1", "x0", "x1", "y0", "size", "text")])))
    by_left = lambda rows: F.array_sort(F.transform(rows, lambda r: F.struct(*[r[f].alias(f) for f in ("x0", "y1", "x1", "y0", "size", "text")])))
    size = lambda a, b: F.greatest(a["size"], b["size"])
    lines = T.let(by_foot, lambda rows: _cut(rows, lambda a, b: b["y1"] - a["y1"] > 0.34 * size(a, b)))

    def joined(rows: Column) -> Column:
        start = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("x1"))
        apart = lambda a, r: (r["x0"] - a["x1"] > 0.15 * r["size"]) & ~a["text"].endswith(" ") & ~r["text"].startswith(" ")
        step = lambda a, r: F.struct(F.concat(a["text"], F.when(F.coalesce(apart(a, r), F.lit(False)), " ").otherwise(""), r["text"]).alias("text"), r["x1"].alias("x1"))
        return F.aggregate(rows, start, step, lambda a: a["text"])

    pieces = lambda line: T.let(by_left(line), lambda rows: _cut(rows, lambda a, b: b["x0"] - a["x1"] > 1.2 * size(a, b)))
    found = F.transform(F.flatten(F.transform(lines, pieces)), lambda rows: _hull(rows, joined(rows)))
    return F.when(F.size(runs) > 0, F.array_sort(found)).otherwise(F.filter(found, lambda _: F.lit(False)))


def text_blocks(runs: Column, width: Column) -> Column:
    """Blocks, as page_order takes them, from a page's glyph runs: a piece of a line goes to the last block above it that
    it overlaps, if their sizes differ by a quarter at most and the gap is under 0.6 sizes. A page's runs are one bounded group.

    Lines come top down, so a block is done with once a line is 0.81 of the block's sizes below it (0.6 of the largest size that
    differs by a quarter is 0.8): only the few open blocks are looked at, not all above.
    """
    kind = "array<struct<y0:double,x0:double,x1:double,y1:double,size:double,text:string>>"

    def fits(b: Column, l: Column) -> Column:
        size, gap = F.greatest(b["size"], l["size"]), l["y0"] - b["y1"]
        return (l["x0"] < b["x1"]) & (l["x1"] > b["x0"]) & (gap < 0.6 * size) & (gap > -0.5 * size) & (F.least(b["size"], l["size"]) >= 0.75 * size)

    def placed(blocks: Column, l: Column) -> Column:
        at = F.array_max(F.filter(F.sequence(F.lit(0), F.size(blocks)), lambda i: F.coalesce(fits(F.get(blocks, i), l), F.lit(False))))
        merged = lambda b: _hull(F.array(b, l), F.concat(b["text"], F.lit("\n"), l["text"]))
        return T.let(at, lambda n: F.when(n.isNull(), F.concat(blocks, F.array(l))).otherwise(F.transform(blocks, lambda b, i: F.when(i == n, merged(b)).otherwise(b))))

    def step(all_: Column, l: Column) -> Column:
        past = lambda b: F.coalesce(l["y0"] - b["y1"] > 0.81 * b["size"], F.lit(False))
        still = T.let(F.filter(all_["open"], lambda b: ~past(b)), lambda blocks: placed(blocks, l))
        gone = F.filter(all_["open"], past)
        return T.let(gone, lambda g: F.struct(F.when(F.size(g) > 0, F.concat(all_["done"], g)).otherwise(all_["done"]).alias("done"), still.alias("open")))

    none = F.array().cast(kind)
    blocks = F.aggregate(text_lines(runs), F.struct(none.alias("done"), none.alias("open")), step, lambda all_: F.concat(all_["done"], all_["open"]))
    full = lambda b, i: F.struct(i.alias("block_no"), width.cast("double").alias("page_width"), b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1"), b["text"].alias("text"))
    return F.transform(F.array_sort(blocks), full)


def page_text(blocks: DataFrame) -> DataFrame:
    """doc_id, page, text from blocks as rows (doc_id, page, block_type and the fields of page_order). A page's blocks are one bounded group."""
    text = blocks.filter("block_type = 0")
    own = F.collect_list(F.struct("block_no", "page_width", "x0", "y0", "x1", "y1", "text"))
    pages = text.filter(T.strip("text") != "").groupBy("doc_id", "page").agg(own.alias("b"))
    return pages.select("doc_id", "page", page_order(F.col("b")).alias("text"))
