"""Quality rules on whole hosts, in DataFrame operations only.

Every document is measured and judged by five rules. Failures are summed by host (the host of `source`
where that is an address, else `source` itself). A host's failure rate under a rule is shrunk towards the rate
of all hosts by a beta prior, fitted to the hosts by the method of moments for each rule: hosts of a few
documents are judged by the prior, large ones by themselves. A host fails if one of its shrunk rates is over
`LIMIT`; this verdict is joined back, and a document is kept if it passes the base rules and its host doesn't fail.

Measuring shuffles nothing: repeated windows are found by sorting each text's own window hashes, and
the few windows with a common hash are then compared by their words. Sums of a host are formed before the
shuffle, so a host may hold any share of the rows. Failing hosts are broadcast up to `BROADCAST_HOSTS`
(counted first); beyond that hot hosts and the rest are joined apart.

Defined cases: null and empty texts have no words (all measures 0) and fail as too short; texts of any length count
whole; a null source has no host, so only the base rules judge its documents, and they are no part of the
prior; a rate of exactly `LIMIT` passes; repeated rows each count and each have a result; an empty table gives
an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 50
#: A host of which more than this share fails a rule, after shrinking, fails.
LIMIT = 0.5
#: Documents that the prior weighs at least and at most.
LEAST_PRIOR, MOST_PRIOR = 2.0, 10_000.0
BROADCAST_HOSTS = 100_000
RULES = ("short", "repeats", "symbols", "lines", "lengths")
_BLANKS = " \t\n\x0b\f\r"
_ADDRESS = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)"
_PLACE_BITS = 31


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _neighbours_equal(ordered: Column, key: Callable[[Column], Column]) -> Column:
    """The entries of a sorted array whose key one of their neighbours has too."""
    before = lambda i: (i > 0) & (key(ordered[F.greatest(i - 1, F.lit(0))]) == key(ordered[i]))
    after = lambda i: (i + 1 < F.size(ordered)) & (key(ordered[F.least(i + 1, F.size(ordered) - 1)]) == key(ordered[i]))
    return F.filter(ordered, lambda _, i: before(i) | after(i))


def repeat_words(words: Column) -> Column:
    """Number of words in windows of three that stand twice or more in an array of words without blanks."""
    window = lambda i: F.concat_ws(" ", words[i], words[i + 1], words[i + 2])
    places = F.sequence(F.lit(0), F.size(words) - 3)
    # 33 bits of a window's hash over its place: plain numbers sort fast
    hashes = F.transform(places, lambda i: F.shiftleft(F.xxhash64(words[i], words[i + 1], words[i + 2]), _PLACE_BITS).bitwiseOR(i.cast("long")))
    place = lambda x: x.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int")
    alike = let(F.sort_array(hashes), lambda s: _neighbours_equal(s, lambda x: F.shiftright(x, _PLACE_BITS)))
    exact = F.sort_array(F.transform(alike, lambda x: F.struct(window(place(x)).alias("k"), place(x).alias("i"))))
    found = let(exact, lambda s: _neighbours_equal(s, lambda x: x["k"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
    covered = F.aggregate(F.sort_array(F.transform(found, lambda x: x["i"])), start, step, lambda a: a["n"])
    return F.when(F.size(words) < 4, 0).otherwise(covered)


def host_of(source: Column) -> Column:
    """The host of an address, else the whole value; in small letters."""
    inside = F.regexp_extract(source, _ADDRESS, 1)
    return F.lower(F.when(inside != "", inside).otherwise(source))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, host, the five measures, n_lines and a boolean fail_<rule> for each rule."""
    text = F.coalesce("text", F.lit(""))
    inner = F.btrim(text, F.lit(_BLANKS))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("chars"), repeat_words(w).alias("repeats")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")))
    symbols = F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]", ""))
    m = docs.select("doc_id", host_of(F.col("source")).alias("host"), of_words.alias("w"), of_lines.alias("l"), symbols.alias("s"))
    long = lambda c, name: F.col(c).cast("long").alias(name)
    m = m.select(
        "doc_id", "host", long("w.n", "n_words"), long("w.chars", "word_chars"), long("s", "n_symbols"),
        (F.col("l.n") - F.col("l.distinct")).cast("long").alias("n_dup_lines"), long("w.repeats", "n_repeat_words"), long("l.n", "n_lines"),
    )
    n = F.col("n_words")
    fails = {
        "short": n < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "lengths": (n > 0) & ((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 12 * n)),
    }
    return m.select("*", *[fails[r].alias(f"fail_{r}") for r in RULES])


def failing_hosts(rows: DataFrame, limit: float = LIMIT) -> DataFrame:
    """host and the shrunk rate of each rule (rate_<rule>) of the hosts that fail; rows as measure() gives them."""
    per_host = rows.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col(f"fail_{r}").cast("long")).alias(r) for r in RULES])
    per_host = common.stored(per_host, "host-counts")
    n = F.col("n")
    sums = [x for r in RULES for x in (F.sum(r).alias(r), F.sum(F.col(r) * F.col(r) / n).alias(f"{r}_squares"))]
    all_ = per_host.agg(F.count("*").alias("hosts"), F.sum("n").alias("rows"), F.sum(n * n.cast("double")).alias("squares"), *sums).first()
    rates = []
    for r in RULES:
        mean, strength = prior(all_["hosts"], all_["rows"] or 0, all_["squares"] or 0.0, all_[r] or 0, all_[f"{r}_squares"] or 0.0)
        rates.append(((F.col(r) + F.lit(mean * strength)) / (n + F.lit(strength))).alias(f"rate_{r}"))
    return per_host.select("host", *rates).filter(F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > limit)


def prior(hosts: int, rows: int, squares: float, failed: int, failed_squares: float) -> tuple[float, float]:
    """Mean and weight (alpha + beta) of the beta prior of a rule, from sums over hosts of n, n^2, f and f^2 / n.

    The variance between hosts beyond the binomial one gives the correlation within hosts, rho; the
    weight is 1 / rho - 1, within LEAST_PRIOR and MOST_PRIOR (no variance beyond: MOST_PRIOR).
    """
    if not rows:
        return 0.0, LEAST_PRIOR
    mean = failed / rows
    spread, within = failed_squares - failed * failed / rows, mean * (1 - mean)
    room = within * (rows - squares / rows - (hosts - 1))
    beyond = spread - within * (hosts - 1)
    if room <= 0 or beyond <= 0:
        return mean, MOST_PRIOR
    return mean, min(MOST_PRIOR, max(LEAST_PRIOR, room / beyond - 1))


def judge(docs: DataFrame, limit: float = LIMIT, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """measure() of docs with base_failed, host_failed and kept."""
    rows = common.stored(measure(docs), "host-rows")
    bad = common.stored(failing_hosts(rows, limit).select("host", F.lit(True).alias("bad")), "host-failing")
    judged = rows.join(F.broadcast(bad), "host", "left") if bad.count() <= broadcast_hosts else common.lookup(rows, bad, "host")
    base = F.col("fail_short") | F.col("fail_repeats")
    failed = F.coalesce("bad", F.lit(False))
    return judged.select(*rows.columns, base.alias("base_failed"), failed.alias("host_failed"), (~base & ~failed).alias("kept"))


def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "host_failed")


_IN_RULES = ", ".join(f"sum(fail_{r}::BIGINT) AS {r}" for r in RULES)
_SUMS = ", ".join(f"sum({r})::DOUBLE AS f_{r}, sum({r}::DOUBLE * {r} / n) AS q_{r}" for r in RULES)


def _weight_sql(r: str) -> str:
    within = f"(f_{r} / t) * (1 - f_{r} / t)"
    room, beyond = f"({within} * (t - s / t - (h - 1)))", f"(q_{r} - f_{r} * f_{r} / t - {within} * (h - 1))"
    return f"CASE WHEN {room} <= 0 OR {beyond} <= 0 THEN {MOST_PRIOR} ELSE least({MOST_PRIOR}, greatest({LEAST_PRIOR}, {room} / {beyond} - 1)) END AS k_{r}"


_WORST = ", ".join(f"({r} + f_{r} / t * k_{r}) / (n + k_{r})" for r in RULES)

#: The same measures by tables of words, windows and lines.
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
  lower(CASE WHEN regexp_extract(source, '{_ADDRESS}', 1) <> '' THEN regexp_extract(source, '{_ADDRESS}', 1) ELSE source END) AS host FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1) GROUP BY r),
ln AS (SELECT r, count(*) AS n, count(DISTINCT x) AS u FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT r, doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(ln.n - ln.u, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(ln.n, 0) AS n_lines
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN ln USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} AS fail_short, 100 * n_repeat_words > 50 * n_words AS fail_repeats, 10 * n_symbols > n_words AS fail_symbols,
  10 * n_dup_lines > 3 * n_lines AS fail_lines, n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words) AS fail_lengths FROM m),
per AS (SELECT host, count(*)::DOUBLE AS n, {_IN_RULES} FROM f WHERE host IS NOT NULL GROUP BY host),
tot AS (SELECT count(*)::DOUBLE AS h, sum(n) AS t, sum(n * n) AS s, {_SUMS} FROM per),
pri AS (SELECT *, {", ".join(_weight_sql(r) for r in RULES)} FROM tot),
bad AS (SELECT host, true AS bad FROM per, pri WHERE greatest({_WORST}) > {LIMIT})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_short OR fail_repeats AS base_failed,
  NOT (fail_short OR fail_repeats) AND bad IS NULL AS kept, f.host, bad IS NOT NULL AS host_failed
FROM f LEFT JOIN bad ON bad.host = f.host
"""
