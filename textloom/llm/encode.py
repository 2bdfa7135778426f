"""Ids of whole texts by the tokenizers library, with a bounded table of space-separated pieces.

A text is cut before each space that a character other than white space follows. Byte-level and
word-level pre-tokenisers always cut there, so the ids of the pieces, joined, are the ids of the text;
only pieces not met before reach the library. Pieces of Latin letters, digits, ASCII marks and single
line ends are cut as pre-tokenisers cut them and go straight to the library's BPE model; other pieces
take the library's whole way. Word-level, such pieces are cut before they are looked up, so that a word is
one piece whatever marks stand beside it and however it is capitalised.

Cutting, finding and joining pieces are array operations. A piece is known by a 64-bit hash (a sum of a
random number for each byte and place): two of a million pieces share one with a chance of about 3e-8.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

import numpy as np

_L = "A-Za-zÀ-ÖØ-öø-įı-ɏ"  # letters without combining marks, whose lower case is one letter
_M = r"!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~"  # ASCII marks but the apostrophe, which may begin a contraction, and "<", which begins special strings
_LONG = 64
_HASH = np.random.default_rng(20_231).integers(1, 2**64, (_LONG, 256), dtype=np.uint64).ravel()
#: First bytes of white space; a space before one of these stays inside its piece.
_BLANK = np.isin(np.arange(256), [*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3])
#: Lower-cases A-Z, and what a byte of a plain piece is: nothing (space, line end), part of a letter, mark or digit; 4 is in no plain piece.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_KIND = np.full(256, 4, dtype=np.uint8)
_KIND[[10, 32]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = 1
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<"]] = 2
_KIND[48:58] = 3


def spans(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, `many` of them, joined."""
    stop = np.cumsum(many)
    return np.repeat(first - stop + many, many) + np.arange(int(stop[-1]) if len(stop) else 0)


def _byte_chars() -> list[str]:
    """Byte-level vocabularies' character of each byte: printable Latin-1 is itself, the rest follow U+0100 in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class PieceTable:
    """From hashes to numbers, by open addressing; room for `most` hashes at half load."""

    def __init__(self, most: int):
        self.bits = max(4, (2 * most - 1).bit_length())
        self.keys, self.at = np.zeros(1 << self.bits, dtype=np.uint64), np.full(1 << self.bits, -1, dtype=np.int32)

    def _place(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash; -1 if it has none."""
        out, todo, place = np.full(len(h), -1, dtype=np.int64), np.arange(len(h)), self._place(h)
        while len(todo):
            held = self.at[place]
            same = (self.keys[place] == h[todo]) & (held >= 0)
            out[todo[same]] = held[same]
            on = (held >= 0) & ~same
            todo, place = todo[on], (place[on] + 1) & (len(self.at) - 1)
        return out

    def add(self, h: np.ndarray, number: np.ndarray) -> None:
        """Distinct hashes that aren't held yet."""
        todo, place = np.arange(len(h)), self._place(h)
        while len(todo):
            free = np.flatnonzero(self.at[place] < 0)
            self.at[place[free]] = number[todo[free]]  # of several at one place the last stays
            won = free[self.at[place[free]] == number[todo[free]]]
            self.keys[place[won]] = h[todo[won]]
            on = np.ones(len(todo), dtype=bool)
            on[won] = False
            todo, place = todo[on], (place[on] + 1) & (len(self.at) - 1)


class PieceEncoder:
    """encode(texts) gives the ids of each UTF-8 text as an array of unsigned 32-bit numbers.

    keep_spaces: the pre-tokeniser joins a space to the word after it (byte-level); otherwise white
    space is dropped, letters are lower-cased, digits stand alone, and a piece's ids don't depend on a
    space before it. `most`: pieces that the table may hold; a full one is emptied.
    """

    def __init__(self, path: str, keep_spaces: bool, most: int = 1_000_000, step: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib, self.keep_spaces, self.most, self.step = Tokenizer.from_file(path), keep_spaces, most, step
        self.lib.no_truncation()
        self.lib.no_padding()
        self.bpe = self.lib.model.tokenize
        special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        if any(" " in s or "<" not in s for s in special):
            raise ValueError(f"special strings with spaces or without '<': {special}")
        mark = rf"[{_M}]+"
        self.cut = re.compile(rf" ?[{_L}]+| ?[0-9]+| ?{mark}|\n|\x01")
        fit = f"{_L}{_M}0-9"
        self.odd = re.compile(rf"[^{fit}\n \x01]|\n(?![{fit}])|(?<!\x01) | (?![{fit}])" if keep_spaces else rf"[^{fit}\n\x01]")
        chars = _byte_chars()
        letters = {*map(chr, range(0xC0, 0x250))}
        self.bytes_of = {ord(c): "".join([chars[b] for b in c.encode()]) for c in {"\n", " "} | letters | {c.lower() for c in letters if len(c.lower()) == 1}}
        self.empty()

    def empty(self) -> None:
        self.table, self.pieces = PieceTable(self.most), 0
        self.pool, self.used = np.zeros(1 << 18, dtype=np.uint32), 0
        self.first, self.size = np.zeros(self.most, dtype=np.int64), np.zeros(self.most, dtype=np.int32)
        self.short: dict[str, list[int]] = {"\x01": [-1]}

    def _whole(self, texts: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all, the first one of each, number of ids of each)."""
        stream = b"\x01".join(pieces).decode() + "\x01"
        bad = [m.start() for m in self.odd.finditer(stream)]
        odd, more = [], []
        if bad or stream.count("\x01") != len(pieces):
            text = stream[:-1].split("\x01") if stream.count("\x01") == len(pieces) else [p.decode() for p in pieces]
            ends = np.cumsum([len(t) + 1 for t in text])
            bad = np.searchsorted(ends, bad, side="right").tolist()
            odd = sorted({*bad, *(i for i, t in enumerate(text) if "\x01" in t)})
            more = self._whole([text[i] for i in odd])
            for i in odd:
                text[i] = ""
            stream = "\x01".join(text) + "\x01"
        ids: list[int] = []
        short, bpe, bytes_of = self.short, self.bpe, self.bytes_of
        if self.keep_spaces:
            for w in self.cut.findall(stream):
                x = short.get(w)
                if x is None:
                    if w.isascii() and w != "\n":
                        x = [t.id for t in bpe("Ġ" + w[1:] if w[0] == " " else w)]
                    else:
                        x = [t.id for t in bpe(w.translate(bytes_of))]
                    if len(w) < 5 and len(short) < 100_000:
                        short[w] = x
                ids += x
            out = np.array(ids, dtype=np.int64)
            ends = np.flatnonzero(out < 0)
            size = np.diff(ends, prepend=-1) - 1
            out = np.delete(out, ends)
        else:  # each is one run already, or whole in `odd`
            many = []
            for w in stream[:-1].lower().split("\x01"):
                x = bpe(w if w.isascii() else w.translate(bytes_of)) if w else ()
                many.append(len(x))
                ids += [t.id for t in x]
            out, size = np.array(ids, dtype=np.int64), np.array(many, dtype=np.int64)
        first = np.cumsum(size) - size
        if odd:
            n = np.array([len(x) for x in more])
            size[odd], first[odd] = n, len(out) + np.cumsum(n) - n
            out = np.concatenate([out, *(np.array(x, dtype=np.int64) for x in more)])
        return out.astype(np.uint32), first, size

    def _hold(self, ids: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new pieces with these ids."""
        n, m = self.pieces, self.pieces + len(sizes)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(self.pool), len(ids)), dtype=np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.first[n:m], self.size[n:m] = self.used + first, sizes
        self.used, self.pieces = self.used + len(ids), m
        return np.arange(n, m)

    def _cuts(self, raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each piece of the texts between the borders, in order."""
        space = raw == 32
        if self.keep_spaces:
            space[:-1] &= ~_BLANK[raw[1:]]
            space[borders[1:] - 1] = False  # the last character of a text
            space[borders[:-1]] = True
            begin = np.flatnonzero(space)
            return begin, np.append(begin[1:], len(raw))
        new = np.empty_like(space)
        new[1:] = space[:-1]
        new[borders[:-1]] = True
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(raw))
        return begin, end - ((end > begin) & space[end - 1])

    def _words(self, raw: np.ndarray, borders: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes with the plain pieces' A-Z and À-Þ in lower case, begin and end of each piece: plain pieces are cut
        into runs of letters, runs of marks and single digits, without line ends; other pieces stay as they are."""
        kind = _KIND[raw]
        lead = np.flatnonzero((raw >= 0xC3) & (raw < 0xCA))
        pair = raw[lead].astype(np.int32) << 8 | raw[lead + 1]
        kind[lead[(pair == 0xC397) | (pair == 0xC3B7) | (pair == 0xC4B0) | (pair > 0xC98F)]] = 4  # × ÷ İ and all after ɏ are not in _L
        odd = np.unique(np.searchsorted(begin, np.flatnonzero(kind == 4), side="right") - 1)
        kept = spans(begin[odd], (end - begin)[odd])
        kind[kept] = 4
        low = _LOWER[raw]
        low[kept] = raw[kept]
        up = lead[(pair >= 0xC380) & (pair < 0xC39F) & (kind[lead] == 1)]
        low[up + 1] += 32
        new = kind == 3
        new[1:] |= kind[1:] != kind[:-1]
        new[borders[:-1]] = True
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(raw))
        some = kind[begin] > 0
        return low, begin[some], end[some]

    def _some(self, texts: list[bytes]) -> list[np.ndarray]:
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        borders = np.concatenate([[0], np.cumsum(sizes[sizes > 0])])
        joined = b"".join(texts)
        if not joined:
            return [np.zeros(0, dtype=np.uint32) for _ in texts]
        raw = np.frombuffer(joined, np.uint8)
        begin, end = self._cuts(raw, borders)
        keep = end > begin
        begin, end = begin[keep], end[keep]
        if not self.keep_spaces:
            raw, begin, end = self._words(raw, borders, begin, end)
            joined = raw.tobytes()
        size = end - begin
        number = np.full(len(begin), -1, dtype=np.int64)
        near = np.flatnonzero(size <= _LONG)
        b, n = begin[near], size[near]
        stop = np.cumsum(n)
        place = np.arange(int(stop[-1]) if len(stop) else 0) - np.repeat(stop - n, n)
        flat = raw if len(place) == len(raw) else raw[place + np.repeat(b, n)]
        h = np.add.reduceat(_HASH[place << 8 | flat], stop - n) if len(near) else np.zeros(0, np.uint64)
        number[near] = self.table.find(h)
        many, first = np.zeros(len(begin), dtype=np.int64), np.zeros(len(begin), dtype=np.int64)
        own: list[np.ndarray] = []  # ids of pieces that the table doesn't keep, which follow its own

        def alone(at: np.ndarray, which: np.ndarray, places: np.ndarray) -> None:
            ids, begins, n = self._ids([joined[x:y] for x, y in zip(begin[at].tolist(), end[at].tolist(), strict=True)])
            many[places], first[places] = n[which], (self.used + sum(map(len, own)) + begins)[which]
            own.append(ids)

        if len(new := np.flatnonzero(number[near] < 0)):
            fresh, where, which = np.unique(h[new], return_index=True, return_inverse=True)
            if self.pieces + len(fresh) > self.most and self.pieces:
                self.empty()
                return self._some(texts)
            at = near[new[where]]
            if len(fresh) > self.most:
                alone(at, which, near[new])
            else:
                held = self._hold(*self._ids([joined[x:y] for x, y in zip(begin[at].tolist(), end[at].tolist(), strict=True)]))
                self.table.add(fresh, held)
                number[near[new]] = held[which]
        short = number >= 0
        many[short], first[short] = self.size[number[short]], self.first[number[short]]
        if len(far := np.flatnonzero(size > _LONG)):
            alone(far, np.arange(len(far)), far)
        pool = np.concatenate([self.pool[: self.used], *own]) if own else self.pool
        stop = np.cumsum(many)
        ids = pool[spans(first, many)]
        at = np.concatenate([[0], stop])[np.searchsorted(begin, np.cumsum(sizes))].tolist()
        return [ids[x:y] for x, y in zip([0, *at[:-1]], at, strict=True)]

    def encode(self, texts: Sequence[bytes]) -> list[np.ndarray]:
        out, held, load = [], [], 0
        for t in texts:
            if held and load + len(t) > self.step:
                out += self._some(held)
                held, load = [], 0
            held.append(t)
            load += len(t)
        return out + (self._some(held) if held else [])


_made: dict[tuple, PieceEncoder] = {}


def encoder(path: str, keep_spaces: bool) -> PieceEncoder:
    """One for each worker process, so that the table lives on from task to task."""
    if (path, keep_spaces) not in _made:
        _made[path, keep_spaces] = PieceEncoder(path, keep_spaces)
    return _made[path, keep_spaces]
