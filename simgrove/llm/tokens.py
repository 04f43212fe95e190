"""Whole texts to token ids with the tokenizers library, each distinct piece of text encoded once.

Both vocabularies split a text before their merges, and no part of that split holds a non-space character followed
by white space, nor a letter followed by a mark. So a text may be cut there and its pieces encoded apart: the ids,
joined, are those of the whole text. Pieces repeat far more often than texts, so a worker keeps the ids of the pieces it
has met. Cutting and looking up run on arrays of bytes: a piece is known by a 64-bit hash. Texts with other white space
than blank, tab and line ends, or with a special token's string, are one piece.

A word of Latin letters is one split and needs no normalizing but lower case, so it goes to the tokenizer's own BPE
model at once; the encoder probes at its start that this gives the tokenizer's ids.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from simgrove.llm.common import _GOLD, _LETTERS, distinct, hash_spans, kept, mix64, ragged, spans

_WORD = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)")
_PROBE = "a I Zu the Übermaß château niños Ærø ÿ running Xylophonists ciónquemies Èeauê öberein"
#: Letters of bytes as they are, for hashes that tell A from a.
_EXACT = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLD)


def _bytes_in(chars: str | list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) if isinstance(c, str) else c for c in chars]] = True
    return out


_BLANK = _bytes_in(" \t\n\r")
_MARKS = _bytes_in(",.;:!?*$%&#|")
_LATIN = _bytes_in([*range(65, 91), *range(97, 123)])
#: First bytes of what makes a text one piece: control characters, `<|` and white space of two and three bytes.
_LEADS = _bytes_in([11, 12, 28, 29, 30, 31, 60, 0xC2, 0xE1, 0xE2, 0xE3])
#: The white space beyond ASCII.
_WIDE = {c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"}
#: Closing marks that are cut off a word, at most.
_MOST_MARKS = 4


def _rare_places(raw: np.ndarray) -> np.ndarray:
    """Where other white space or `<|` begins."""
    at = np.flatnonzero(_LEADS[raw])
    if not len(at):
        return at
    one, two, three = (raw[np.minimum(at + k, len(raw) - 1)].astype(np.int64) for k in range(3))
    found = (one < 32) | ((one == 60) & (two == 124) & (at + 1 < len(raw)))
    for c in _WIDE:
        same = (one == c[0]) & (two == c[1]) & (at + len(c) <= len(raw))
        found |= same & (three == c[2]) if len(c) == 3 else same
    return at[found]


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(sorted({*range(256)} - own))}


_BYTES = _byte_letters()


def vocabulary(name: str) -> str:
    """The path of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class HashIndex:
    """Numbers of 64-bit hashes, by open addressing in two arrays."""

    def __init__(self, bits: int):
        self.bits, self.keys, self.numbers = bits, np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Their numbers, -1 for unknown ones. A hash of 0 counts as 1."""
        hashes = np.maximum(hashes, np.uint64(1))
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        met = self.keys[slot]
        out = np.where(met == hashes, self.numbers[slot], -1).astype(np.int64)
        left = np.flatnonzero((met != hashes) & (met != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            met = self.keys[slot[left]]
            same = met == hashes[left]
            out[left[same]] = self.numbers[slot[left[same]]]
            left = left[~same & (met != 0)]
        return out

    def add(self, hashes: np.ndarray, first: int) -> None:
        """Number distinct unknown hashes from first on."""
        hashes = np.maximum(hashes, np.uint64(1))
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = hashes[free]
            self.numbers[slot[free]] = first + free
            won = self.numbers[slot[left]] == first + left
            won &= self.keys[slot[left]] == hashes[left]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)


class PieceEncoder:
    """A tokenizer with the ids of the pieces met; plain: a special token's string in a text is text."""

    #: Pieces kept at most between groups of texts; beyond it the first KEEP stay, which hold nearly all frequent ones.
    LIMIT, KEEP, BITS = 1_600_000, 800_000, 22

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        encode = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.drops_space = encode("a \n b") == encode("a b")
        self.lowers = encode("THE QUICK ÀÉÖ") == encode("the quick àéö")
        self.letters = _LETTERS if self.lowers else _EXACT
        self.model = self.tokenizer.model
        words = _PROBE.split() + ([] if self.drops_space else [f" {w}" for w in _PROBE.split()])
        self.direct = [self.word(w) for w in words] == [encode(w) for w in words]
        self.index, self.hashes = HashIndex(self.BITS), np.empty(0, np.uint64)
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.at, self.size = np.empty(0, np.int64), np.empty(0, np.int64)

    def forget(self) -> None:
        """Drop the pieces met last."""
        self.hashes, self.at, self.size = (x[: self.KEEP].copy() for x in (self.hashes, self.at, self.size))
        self.index = HashIndex(self.BITS)
        self.index.add(self.hashes, 0)
        self.used = int((self.at + self.size).max(initial=0))
        self.flat = self.flat[: max(1, self.used)].copy()

    def pieces(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of texts begin and end."""
        rare = _rare_places(raw)
        whole = distinct(np.searchsorted(at, rare, "right") - 1)
        begins, ends = spans(raw, at, _BLANK)
        cut = ends.copy()
        for _ in range(_MOST_MARKS):
            cut -= (cut > begins) & _MARKS[raw[cut - 1]] if len(cut) else 0
        if len(cut):
            cut = cut[(cut > begins) & (cut < ends) & _LATIN[raw[cut - 1]]]
        if len(whole):
            own = lambda x: np.isin(np.searchsorted(at, x, "right") - 1, whole)
            keep = ~own(begins)
            begins, ends, cut = begins[keep], ends[keep], cut[~own(cut - 1)]
        if self.drops_space:
            begins, ends = (np.concatenate([x, cut, at[whole + k]]) for k, x in ((0, begins), (1, ends)))
            return np.sort(begins), np.sort(ends)
        ends = distinct(np.concatenate([ends, cut, at[1:]]))
        ends = ends[ends > 0]
        return np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)], ends

    def word(self, piece: str) -> list[int]:
        """The ids of a piece that _WORD matches, by the model alone."""
        piece = piece.lower() if self.lowers else piece
        letters = piece.replace(" ", "\u0120") if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)
        return [t.id for t in self.model.tokenize(letters)]

    def learn(self, pieces: list[bytes], hashes: np.ndarray) -> None:
        """Find and keep the ids of new pieces."""
        texts = [p.decode("utf-8", "surrogatepass") for p in pieces]
        plain = (lambda p: p.isalpha() and p.isascii() or _WORD.fullmatch(p)) if self.direct else lambda p: False
        ids: list = [self.word(p) if plain(p) else None for p in texts]
        rest = [k for k, x in enumerate(ids) if x is None]
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            ids[k] = e.ids
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        if self.used + len(flat) > len(self.flat):
            grown = np.empty(max(2 * len(self.flat), self.used + len(flat)), np.uint32)
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used : self.used + len(flat)] = flat
        self.index.add(hashes, len(self.hashes))
        self.hashes, self.at, self.size = np.append(self.hashes, hashes), np.append(self.at, self.used + np.cumsum(size) - size), np.append(self.size, size)
        self.used += len(flat)

    def encode_bytes(self, raw: np.ndarray, at: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (UTF-8, one after the other, and the places between), each followed by the end id; and
        their number for each text."""
        if len(self.hashes) > self.LIMIT:
            self.forget()
        begins, ends = self.pieces(raw, at)
        hashes = hash_spans(raw, begins, ends, self.letters)
        which = self.index.find(hashes)
        new = np.flatnonzero(which < 0)
        if len(new):
            fresh, first = np.unique(hashes[new], return_index=True)
            order = np.argsort(first)  # those met first are kept longest
            fresh, first = fresh[order], new[first[order]]
            for k in range(0, len(first), 200_000):
                part = first[k : k + 200_000]
                self.learn([raw[b:e].tobytes() for b, e in zip(begins[part].tolist(), ends[part].tolist(), strict=True)], fresh[k : k + 200_000])
            which[new] = self.index.find(hashes[new])
        sizes = self.size[which]
        ids = self.flat[ragged(self.at[which], sizes)] if len(which) else np.empty(0, np.uint32)
        edges = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(begins, at)]
        lengths = np.diff(edges)
        if end is not None:
            ids = np.insert(ids, edges[1:], np.uint32(end))
            lengths = lengths + 1
        return ids, lengths

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        at = np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)]).astype(np.int64)
        return self.encode_bytes(np.frombuffer(b"".join(raw), np.uint8), at, end)


def encoder(path: str, plain: bool = False) -> PieceEncoder:
    """The worker's own for this vocabulary and way with special tokens' strings."""
    return kept.of(f"{path} {plain}", lambda: PieceEncoder(path, plain))


#: Bytes of text that are encoded at a time.
GROUP_BYTES = 4_000_000
