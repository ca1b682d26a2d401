"""The piece vocabulary of a SentencePiece model file, read without that library."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def default_model() -> str:
    """Where this machine keeps the public vocabulary; only the driver reads it."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class Vocabulary:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True

    @classmethod
    def load(cls, path: str | None = None) -> Vocabulary:
        with open(path or default_model(), "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, data: bytes) -> Vocabulary:
        v = cls()
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, x in _fields(value):
                    if k == 1:
                        piece = x.decode("utf-8")
                    elif k == 2:
                        score = struct.unpack("<f", x)[0]
                    elif k == 3:
                        kind = x
                v.pieces.append(piece)
                v.scores.append(score)
                v.kinds.append(kind)
            elif number == 2:
                for k, x in _fields(value):
                    if k == 3:
                        v.model_type = x
                    elif k == 35:
                        v.byte_fallback = bool(x)
            elif number == 3:
                for k, x in _fields(value):
                    if k == 2:
                        v.charsmap = x
                    elif k == 3:
                        v.dummy_prefix = bool(x)
                    elif k == 4:
                        v.squeeze = bool(x)
        return v

    def byte_ids(self) -> list[int]:
        """The ids of the 256 byte pieces, or an empty list."""
        ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        return [ids[b] for b in range(256)] if len(ids) == 256 else []

    def words_split(self) -> bool:
        """Whether no piece goes on after a space that follows another character, so that words can be taken apart."""
        return all(SPACE not in p.lstrip(SPACE) and (p == SPACE * len(p) or SPACE not in p[1:]) for p, k in zip(self.pieces, self.kinds) if k in (NORMAL, USER_DEFINED))

    def trie(self) -> dict:
        """Nested dicts by character; the key "" of a node holds the id of the piece that ends there."""
        root: dict = {}
        for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds)):
            if kind in (NORMAL, USER_DEFINED) and piece:
                node = root
                for ch in piece:
                    node = node.setdefault(ch, {})
                node[""] = i
        return root

    def rewrites(self) -> dict[str, str]:
        """The character map of the normaliser as rules, read from its double-array trie."""
        if not self.charsmap:
            return {}
        size = struct.unpack("<I", self.charsmap[:4])[0]
        units = struct.unpack(f"<{size // 4}I", self.charsmap[4 : 4 + size])
        strings = self.charsmap[4 + size :]
        offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        rules, todo = {}, [(b"", offset(units[0]))]
        while todo:
            key, base = todo.pop()
            for byte in range(1, 256):
                at = base ^ byte
                if at < len(units) and units[at] & (0x80000000 | 0xFF) == byte:
                    here = at ^ offset(units[at])
                    if units[at] & 0x100:
                        value = units[here] & 0x7FFFFFFF
                        rules[(key + bytes([byte])).decode("utf-8", "replace")] = strings[value : strings.index(b"\0", value)].decode("utf-8")
                    todo.append((key + bytes([byte]), here))
        return rules


class PieceMachine:
    """The token transducer over characters: a trie whose final states emit a piece, and for a character
    that is no piece an arc of its own that emits its bytes. Arcs are kept as sorted arrays, so that the
    composition with many words is stepped at once.
    """

    #: The label of an arc that emits the bytes of its character.
    BYTES = -1

    def __init__(self, v: Vocabulary):
        chars = sorted({ch for p, k in zip(v.pieces, v.kinds) if k in (NORMAL, USER_DEFINED) for ch in p})
        self.code = {ch: i + 1 for i, ch in enumerate(chars)}
        self.codes = np.zeros(max(map(ord, chars), default=0) + 2, np.int64)  # by code point; the last stands for all above
        self.codes[[ord(ch) for ch in chars]] = range(1, len(chars) + 1)
        self.base = len(chars) + 1
        edges, final, todo = {}, [-1], [(v.trie(), 0)]
        while todo:
            node, at = todo.pop()
            for ch, child in node.items():
                if ch == "":
                    final[at] = child
                    continue
                final.append(-1)
                edges[at * self.base + self.code[ch]] = len(final) - 1
                todo.append((child, len(final) - 1))
        self.keys = np.array(sorted(edges), np.int64)
        self.to = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.final = np.array(final, np.int64)

    def compose(self, words: list[str], width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The composition of words (of at most width characters) with the machine, as a lattice each.

        Gives its arcs (word, start, end, piece or BYTES), the words' code points in rows, their lengths.
        """
        n = len(words)
        points = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "replace"), "<u4").reshape(n, width).astype(np.int64)
        lengths = np.array([len(w) for w in words])
        codes = self.codes[np.minimum(points, len(self.codes) - 1)]
        w, s = np.nonzero(np.arange(width)[None] < lengths[:, None])
        state, end = np.zeros(len(w), np.int64), s.copy()
        found, single = [], np.zeros(len(w), bool)
        alive = np.arange(len(w))
        while len(alive):
            key = state[alive] * self.base + codes[w[alive], end[alive]]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            alive, at = alive[hit := self.keys[at] == key], at[hit]
            state[alive] = self.to[at]
            piece = self.final[state[alive]]
            good = piece >= 0
            first = end[alive] == s[alive]
            single[alive[good & first]] = True
            end[alive] += 1
            found.append((w[alive[good]], s[alive[good]], end[alive[good]], piece[good]))
            alive = alive[end[alive] < lengths[w[alive]]]
        lone = np.flatnonzero(~single)
        found.append((w[lone], s[lone], s[lone] + 1, np.full(len(lone), self.BYTES)))
        return [np.concatenate(x) for x in zip(*found)], points, lengths


def blocks(words: list[str], cells: int = 1_000_000) -> Iterator[tuple[list[int], int]]:
    """(places of words, width) of blocks of words of like length, of about `cells` characters at most or one word."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        width = len(words[order[at]]) + 2
        end = at
        while end < len(order) and len(words[order[end]]) <= width and (end == at or (end - at + 1) * width <= cells):
            end += 1
        yield order[at:end], width
        at = end
