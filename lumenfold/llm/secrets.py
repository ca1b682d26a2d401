"""Secret scans: fixed patterns, and a character convolutional network over every candidate.

The patterns (assign, access, hex) find what they always find; the network adds spans. A candidate
is a run of 16 or more characters [A-Za-z0-9+/_=-]; a pattern's span inside of a run parts it. The
network sees windows of 32 characters, with 24 before and 8 after. In longer runs they slide by
`STEP`, so that every character of every candidate is scored, and all windows at or above the
threshold are reported: each with the letters and digits that continue it, merged where they
meet, with the best score. It is trained in numpy on labelled findings: candidates of
a bounded sample of documents, labelled by the patterns, and generated ones of well-known secret
and harmless formats, so that it learns what secrets look like and not only the patterns. A
candidate without a label that looks like a well-known key is left out of the fit and of the
validation part: no pattern found it, but that doesn't make it harmless. In part of the training
rows the context is blanked. Its scores are calibrated by Platt scaling on a validation part, and
the threshold is the largest one that keeps the recall there at `MIN_RECALL` or more, among
findings of documents and among generated ones apart.

Defined cases: a null text is empty; a text without findings gives zero counts and an empty span
list; overlapping spans of different kinds are all reported, redaction merges them; repeated rows
are scanned alike; texts of any length are scanned whole, in blocks of windows; a score of exactly the
threshold is a finding; an empty table gives an empty result (the generated rows train the network);
redact() keeps further columns, scan() ignores them, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "network")
#: Documents, at most, from which labelled findings for training are taken.
SAMPLE_DOCS = 4_000
MIN_RECALL = 0.98
#: Windows, at most, that a text gives for training; of more, evenly spaced ones are taken.
TEXT_WINDOWS = 64
BEFORE, INSIDE, AFTER = 24, 32, 8
STEP = 8
#: Windows that are scored at once.
BLOCK = 20_000
WIDTH = BEFORE + INSIDE + AFTER
MASK = "[SECRET]"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
MIN_RUN = 16
_CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
_GOES_ON = re.compile(r"[A-Za-z0-9]*")
#: Beginnings of well-known keys, and runs of random look: 20 or more with both cases and a digit, or long hex in capitals.
_KEY_LIKE = re.compile(
    r"(?<![A-Za-z0-9])(?:gh[opsur]_[A-Za-z0-9]{16}|github_pat_|glpat-|npm_[A-Za-z0-9]{16}|[sr]k_(?:live|test)_|sk-[A-Za-z0-9]{16}|xox[abeoprs]-|eyJ[A-Za-z0-9_-]{13}|AIza|AKIA|ASIA)"
    r"|(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{20}|[0-9A-F]{32}"
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's number, end), ordered, of the fixed patterns; offsets in code points."""
    out = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, ...]] = ()) -> list[tuple[int, int]]:
    """(start, end) of the runs, without the spans (start, .., end) of base, which are ordered by start."""
    out, k, covered = [], 0, 0
    for m in _CANDIDATE.finditer(text):
        at, end = max(m.start(), covered), m.end()
        while k < len(base) and base[k][0] < end:
            if base[k][0] - at >= MIN_RUN:
                out.append((at, base[k][0]))
            at = covered = max(at, covered, base[k][2])
            k += 1
        if end - at >= MIN_RUN:
            out.append((at, end))
    return out


def windows_of(start: int, end: int) -> list[tuple[int, int]]:
    """The parts of a candidate that the network sees one by one: INSIDE long at most, every character in one."""
    last = end - INSIDE
    return [(a, a + INSIDE) for a in [*range(start, last, STEP), last]] if last > start else [(start, end)]


def window(text: str, start: int, end: int) -> str:
    """The WIDTH characters that the network sees, padded with NUL."""
    before, inside, after = text[max(0, start - BEFORE) : start], text[start : min(end, start + INSIDE)], text[end : end + AFTER]
    return before.rjust(BEFORE, "\0") + inside.ljust(INSIDE, "\0") + after.ljust(AFTER, "\0")


def encoded(windows: list[str]) -> np.ndarray:
    """Rows of WIDTH character codes: 0 padding, 1 others, 2-96 printable ASCII."""
    raw = np.frombuffer("".join(windows).encode("ascii", "replace"), np.uint8).reshape(-1, WIDTH)
    return np.where(raw == 0, 0, np.where((raw >= 32) & (raw < 127), raw - 30, 1)).astype(np.int64)


class Network:
    """Embedding, one convolution, max pooling over context and candidate apart, logistic output."""

    CODES, DIM, KERNEL, FILTERS = 97, 8, 5, 24

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.w = {
            "e": r.normal(0, 0.3, (self.CODES, self.DIM)), "k": r.normal(0, 0.2, (self.KERNEL * self.DIM, self.FILTERS)),
            "b": np.zeros(self.FILTERS), "o": r.normal(0, 0.2, 2 * self.FILTERS), "c": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        e = self.w["e"][x]
        cols = np.concatenate([e[:, i : WIDTH - self.KERNEL + 1 + i] for i in range(self.KERNEL)], axis=2)
        h = np.maximum(cols @ self.w["k"] + self.w["b"], 0)
        edge = BEFORE - self.KERNEL // 2
        parts = (h[:, :edge], h[:, edge:])
        at = [p.argmax(axis=1) for p in parts]
        pooled = np.concatenate([np.take_along_axis(p, a[:, None], 1)[:, 0] for p, a in zip(parts, at)], axis=1)
        return cols, at, edge, pooled, pooled @ self.w["o"] + self.w["c"]

    def raw(self, x: np.ndarray, block: int = 2_000) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + block])[-1] for i in range(0, len(x), block)] or [np.zeros(0)])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(x) + self.shift, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.01, block: int = 128, seed: int = 1) -> None:
        r, m, v, step = np.random.default_rng(seed), {}, {}, 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), block):
                idx = order[i : i + block]
                cols, at, edge, pooled, z = self._forward(x[idx])
                d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[idx]) / len(idx)
                g = {"o": pooled.T @ d, "c": np.array([d.sum()]), "k": np.zeros_like(self.w["k"]), "b": np.zeros(self.FILTERS), "e": np.zeros_like(self.w["e"])}
                dp = np.where(pooled > 0, d[:, None] * self.w["o"], 0)
                n, f = np.arange(len(idx))[:, None], np.arange(self.FILTERS)[None]
                for part in (0, 1):
                    grad, pos = dp[:, part * self.FILTERS : (part + 1) * self.FILTERS], at[part] + part * edge
                    seen = cols[n, pos]
                    g["k"] += np.einsum("nfc,nf->cf", seen, grad)
                    g["b"] += grad.sum(axis=0)
                    back = (grad[:, :, None] * self.w["k"].T[f[0]]).reshape(len(idx), self.FILTERS, self.KERNEL, self.DIM)
                    chars = x[idx][n[:, :, None], pos[:, :, None] + np.arange(self.KERNEL)]
                    np.add.at(g["e"], chars.ravel(), back.reshape(-1, self.DIM))
                step += 1
                for k in self.w:
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g[k]
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g[k] ** 2
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, min_recall: float = MIN_RECALL, part: np.ndarray | None = None) -> None:
        """Platt scaling, then the largest threshold whose recall is min_recall or more in each part (0.5 without positives)."""
        z = self.raw(x)
        spread = z.std() + 1e-9
        z1, a, b = z / spread, 1.0, 0.0
        for _ in range(300):
            d = 1 / (1 + np.exp(-np.clip(a * z1 + b, -40, 40))) - y
            a, b = a - 0.5 * (d * z1).mean(), b - 0.5 * d.mean()
        self.scale, self.shift = a / spread, b
        p, part = self.probability(x), np.zeros(len(x)) if part is None else part
        positive = [np.sort(p[(y == 1) & (part == k)]) for k in np.unique(part[y == 1])]
        self.threshold = min((float(q[int((1 - min_recall) * len(q))]) for q in positive), default=0.5)


def generated(n: int = 600, seed: int = 3) -> tuple[list[str], list[int]]:
    """Labelled windows of well-known formats: keys and tokens (1), and numbers, ids, paths and words (0)."""
    r = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    mixed = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
    pick = lambda s, k: "".join(r.choice(s, k))
    word = lambda: pick(letters, int(r.integers(2, 9)))
    hexa, upper, digits = np.array(list("0123456789abcdef")), np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")), np.array(list("0123456789"))
    secret = (
        lambda: "ghp_" + pick(mixed, 36), lambda: "sk_live_" + pick(mixed, 24), lambda: "AKIA" + pick(upper, 16), lambda: pick(hexa, int(r.choice([32, 40, 64]))),
        lambda: "eyJ" + pick(mixed, 40), lambda: "xoxb-" + pick(digits, 11) + "-" + pick(mixed, 24), lambda: pick(mixed, int(r.integers(20, 44))), lambda: pick(mixed, 38) + "==",
    )
    plain = (
        lambda: pick(digits, int(r.integers(16, 20))), lambda: word() + "-" + word() + "-" + word() + "-" + pick(digits, 4), lambda: "/".join(["", word(), word(), word(), word() + pick(digits, 1)]),
        lambda: "-".join(pick(digits, k) for k in (4, 2, 2, 4, 4)), lambda: word() + word() + word() + word() + pick(digits, 1), lambda: "_".join([word(), word(), word(), pick(digits, 3)]), lambda: "=" * 20 + pick(digits, 1),
        lambda: word() + word() + word() + word() + word(), lambda: (word() + word() + word() + word() + word()).upper(), lambda: "-_/"[int(r.integers(3))].join(word() for _ in range(int(r.integers(4, 14)))), lambda: "=-_+"[int(r.integers(4))] * int(r.integers(16, 60)),
        lambda: "/".join(f"{word()}={pick(digits, 2)}" if r.random() < 0.3 else word() for _ in range(int(r.integers(4, 14)))),
    )
    leads = ('key = "', "Authorization: Bearer ", "secret: ", "token=")
    rows, labels = [], []
    for i in range(2 * n):
        label = i % 2
        token = (secret if label else plain)[int(r.integers(len(secret if label else plain)))]()
        if len(token) < 16:
            token += pick(digits, 16 - len(token))
        before = " ".join(word() for _ in range(5)) + " "
        if label and r.random() < 0.5:
            before += leads[int(r.integers(len(leads)))]
        start = len(before)
        if label and r.random() < 0.25:  # behind the beginning of a longer run
            before += "/".join(word() for _ in range(int(r.integers(3, 10)))) + "/="[int(r.integers(2))]
        text = before + token + ('" ' if '"' in before else " ") + word()
        key, end = len(before), len(before) + len(token)
        seen = [(a, z) for a, z in windows_of(start, end) if min(z, end) - max(a, key) >= MIN_RUN]
        rows.append(window(text, *seen[int(r.integers(len(seen)))]))
        labels.append(label)
    return rows, labels


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Network:
    """A network fitted to the candidates of about sample_docs documents at most, and to generated ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, int] = {}
            for t in b.column(0):
                text = t.as_py() or ""
                base = base_spans(text)
                places = [w for c in candidates(text) for w in windows_of(*c)]
                if len(places) > TEXT_WINDOWS:
                    places = [places[i * len(places) // TEXT_WINDOWS] for i in range(TEXT_WINDOWS)]
                for s, e in places:
                    label = int(any(a < e and s < z for a, _, z in base))
                    if label or not _KEY_LIKE.search(text, s, e):
                        found[window(text, s, e)] = label
            yield pa.RecordBatch.from_pydict({"w": pa.array(list(found), pa.string()), "y": pa.array(list(found.values()), pa.int32())})

    some = common.bounded_sample(docs.select("text").filter("text is not null"), sample_docs, F.octet_length("text"))
    rows = common.map_texts(some, run, "w string, y int").distinct().collect()
    rows = sorted((r["w"], r["y"]) for r in rows)
    windows, labels = generated(1_800)
    x = np.concatenate([encoded([w for w, _ in rows]), encoded(windows)]) if rows else encoded(windows)
    y = np.array([v for _, v in rows] + labels, float)
    order = np.random.default_rng(5).permutation(len(x))
    cut = max(1, len(x) // 5)
    check, learn = order[:cut], order[cut:]
    weights = [learn]
    if 0 < (few := learn[y[learn] == 1]).size < learn.size / 4:  # the rarer label is repeated
        weights.append(np.resize(few, learn.size // 3))
    learn = np.concatenate(weights)
    bare = x[learn].copy()
    blank = np.random.default_rng(6).random(len(learn)) < 0.4
    bare[blank, :BEFORE] = 0
    net = Network()
    net.fit(bare, y[learn])
    net.calibrate(x[check], y[check], part=check < len(rows))
    return net


def _scan_batch(texts: list[str], net: Network) -> list[list[tuple[int, int, int, float]]]:
    """(start, kind's number, end, score) of each text's spans, ordered."""
    found = [[(s, k, e, 1.0) for s, k, e in base_spans(t)] for t in texts]
    places: list[tuple[int, int, int, int, int]] = []  # text, candidate, window
    flagged: list[tuple[int, int, int, int, int, float]] = []

    def flush() -> None:
        p = net.probability(encoded([window(texts[i], a, z) for i, _, _, a, z in places]))
        flagged.extend((*places[j], float(p[j])) for j in np.flatnonzero(p >= net.threshold))
        places.clear()

    for i, t in enumerate(texts):
        for s, e in candidates(t, found[i]):
            for a, z in windows_of(s, e):
                places.append((i, s, e, a, z))
                if len(places) == BLOCK:
                    flush()
    if places:
        flush()
    at = None  # the candidate and its last span; a candidate's windows come in order
    for i, s, e, a, z, p in flagged:
        if at and at[0] == (i, s) and a <= at[1][2]:
            begin, _, end, score = at[1]
            found[i].pop()
        else:
            begin, end, score = a, z, 0.0
            while begin > s and texts[i][begin - 1].isalnum():
                begin -= 1
        end = max(end, z)
        end = min(e, _GOES_ON.match(texts[i], end, e).end())
        span = (begin, 3, end, max(score, p))
        found[i].append(span)
        at = (i, s), span
    return [sorted(f) for f in found]


def scan(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id and findings (kind, start, end, score; ordered) of each row of docs."""
    net = net or train(docs)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _scan_batch([t or "" for t in b.column(1).to_pylist()], net)
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, k, e, p in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(kind))], ["doc_id", "findings"])

    return common.map_texts(docs.select("doc_id", "text"), run, "doc_id long, findings array<struct<kind string, start long, end long, score double>>")


def redact(docs: DataFrame, net: Network | None = None, mask: str = MASK) -> DataFrame:
    """docs with each merged span of findings replaced by mask; other columns as they are, n_chars kept true."""
    net = net or train(docs)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            out = []
            for t, spans in zip(texts, _scan_batch([t or "" for t in texts], net)):
                if spans:
                    parts, at, end = [], 0, -1
                    for s, _, e, _ in spans:
                        if s >= end:  # touching or apart: a new merged span begins
                            parts += [t[max(at, 0) : s], mask]
                        at = end = max(end, e)
                    t = "".join([*parts, t[at:]])
                out.append(t)
            arrays = {c: b.column(c) for c in columns} | {"text": pa.array(out, b.schema.field("text").type)}
            if "n_chars" in arrays:
                arrays["n_chars"] = pa.array([None if n is None else len(t or "") if t is not s else n for n, t, s in zip(arrays["n_chars"].to_pylist(), out, texts)], arrays["n_chars"].type)
            yield pa.RecordBatch.from_arrays([arrays[c] for c in columns], columns)

    return common.map_texts(docs, run, docs.schema)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    net = train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _scan_batch([t or "" for t in b.column(1).to_pylist()], net)
            joined = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)
            counts = [pa.array([sum(x[1] == k for x in f) for f in found], pa.int64()) for k in range(4)]
            sha = [sha256(joined(x for x in f if x[1] < 3).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts[:3], pa.array(sha, pa.string()), pa.array([joined(f) for f in found], pa.string()), counts[3]],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_network"],
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_network long"
    return common.map_texts(docs.select("doc_id", "text"), run, schema)
