"""Public word-level BPE tokenizer with a bounded table of words.

The tokenizer cuts texts at white space before it merges, so ids of a text are
the ids of its space-separated words in turn. Each Python worker keeps the ids
of words it has met; the library encodes only what is new:

* ASCII letters are lower-cased first, as the tokenizer would, but in texts
  with combining marks, which it composes before;
* numpy finds the words of many texts at once and hashes each (a polynomial of
  its bytes modulo 2**64, by prefix sums), looks the hashes up in an open-
  addressed table, and puts the ids together by one ragged gather;
* a new word of plain letters and final ASCII punctuation is its letters and
  then its marks, as the tokenizer cuts there as well; letters are encoded many
  in one call and parted where an id closes a word. If the count differs, or
  for any other word, the word is encoded on its own. Plain letters (``PLAIN``)
  stay letters, one for one, under the tokenizer's normaliser; others may turn
  into a letter and a mark, which belongs to the punctuation.

Words are told apart by 64-bit hashes and lengths; the table is emptied before
words that it has no room for, and texts with too many words for one table are
handled in halves. Long texts are cut at spaces into turns, so memory is
bounded but for a single word.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np

#: Slots of the table (a power of two), words it holds at most, letter pieces
#: and marks that are kept, and the longest (bytes) word that is kept.
SLOTS = 1 << 21
CACHE_WORDS = 1_200_000
CACHE_PIECES = 300_000
CACHE_MARKS = 20_000
CACHE_BYTES = 64
#: Words given to the library in one call.
CALL_WORDS = 1000
#: Bytes of text handled in one turn.
TURN_BYTES = 1 << 20
#: Letters that stay letters when composed and lower-cased: Latin but U+0130,
#: Greek, Cyrillic, kana, Han and Hangul syllables.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0391-\u03a1\u03a3-\u03c9\u0400-\u0481\u048a-\u052f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3]+")
#: ASCII punctuation.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())

_SPACE = re.compile(rb"[ \n]")
_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ENCODERS: dict[str, "WordEncoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.marks: dict[bytes, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}
        self.powers = self.inverse = np.ones(1, np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)  # 0: free
        self.entry = np.zeros(SLOTS, np.int32)
        self.count = 0
        self.first = np.zeros(1 << 16, np.int64)  # of each entry, in the pool
        self.size = np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, "<u4")
        self.used = 0

    # New words

    def _alone(self, word: bytes) -> bytes:
        return array("I", self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def _letters(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(words), CALL_WORDS):
            call = words[i : i + CALL_WORDS]
            ids = np.array(self.tokenizer.encode(b" ".join(call).decode(), add_special_tokens=False).ids, "<u4")
            ends = (4 * (np.nonzero(self.closes[ids])[0] + 1)).tolist()
            if len(ends) != len(call):
                out += map(self._alone, call)
                continue
            raw, start = ids.tobytes(), 0
            for end in ends:
                out.append(raw[start:end])
                start = end
        return out

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        out: list[bytes] = [b""] * len(words)
        plain, marks, pieces = [], self.marks, self.pieces
        for i, word in enumerate(words):
            core = word.rstrip(MARKS)
            if core.isalpha() or not core.isascii() and PLAIN.fullmatch(core.decode("utf-8", "replace")):
                mark = word[len(core) :]
                if mark not in marks:
                    if len(marks) > CACHE_MARKS:
                        marks.clear()
                    marks[mark] = self._alone(mark)
                plain.append((i, core, marks[mark]))
            else:
                out[i] = self._alone(word)
        new = [*{core for _, core, _ in plain if core not in pieces}]
        got = dict(zip(new, self._letters(new), strict=True))
        for i, core, mark in plain:
            out[i] = (got[core] if core in got else pieces[core]) + mark
        if len(pieces) + len(got) > CACHE_PIECES:
            pieces.clear()
        pieces.update((p, x) for p, x in got.items() if len(p) <= CACHE_BYTES)
        return out

    # The table

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        at = np.arange(len(h))
        slot = (h >> np.uint64(43)).astype(np.int64) & (SLOTS - 1)
        while len(at):
            k = self.keys[slot]
            hit = k == h[at]
            out[at[hit]] = self.entry[slot[hit]]
            go = ~hit & (k != 0)
            at, slot = at[go], (slot[go] + 1) & (SLOTS - 1)
        return out

    def _add(self, h: np.ndarray, ids: list[bytes]) -> np.ndarray:
        """Entries for distinct new hashes."""
        n = len(h)
        while self.count + n > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        flat = np.frombuffer(b"".join(ids), "<u4")
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        new = np.arange(self.count, self.count + n)
        self.size[new] = sizes
        self.first[new] = self.used + sizes.cumsum() - sizes
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.count += n
        at, slot = np.arange(n), (h >> np.uint64(43)).astype(np.int64) & (SLOTS - 1)
        while len(at):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]] = h[at[put]]
            self.entry[slot[put]] = new[at[put]]
            rest = np.ones(len(at), bool)
            rest[put] = False
            at, slot = at[rest], (slot[rest] + 1) & (SLOTS - 1)
        return new

    # Texts

    def _hashes(self, a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.powers) < len(a):
            n = len(a) + 1
            base, inverse = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
            self.powers, self.inverse = (np.concatenate([[np.uint64(1)], np.full(n - 1, x)]).cumprod(dtype=np.uint64) for x in (base, inverse))
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_VALUES[a] * self.powers[: len(a)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.inverse[starts]
        h ^= (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h | np.uint64(1)

    def _halves(self, texts: list[bytes], starts: np.ndarray) -> list[bytes]:
        if len(texts) > 1:
            k = len(texts) // 2
            return self._some(texts[:k]) + self._some(texts[k:])
        cut = int(starts[len(starts) // 2])
        return [self._some([texts[0][:cut]])[0] + self._some([texts[0][cut:]])[0]]

    def _some(self, texts: list[bytes]) -> list[bytes]:
        # a special token is matched, and marks are composed, before letters are lowered
        joined = b" ".join([t if b"<|" in t or b"\xcc" in t or b"\xcd" in t else t.lower() for t in texts]).replace(b"\n", b" ") + b" "
        a = np.frombuffer(joined, np.uint8)
        inside = np.zeros(len(a) + 1, bool)
        np.not_equal(a, 32, out=inside[1:])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        h = self._hashes(a, starts, ends)
        entry = self._find(h)
        if (entry < 0).any():
            most = min(CACHE_WORDS, SLOTS // 4 * 3)
            missing = np.flatnonzero(entry < 0)
            new, first, back = np.unique(h[missing], return_index=True, return_inverse=True)
            if self.count + len(new) > most:
                self._clear()
                missing = np.arange(len(h))
                new, first, back = np.unique(h, return_index=True, return_inverse=True)
                if len(new) > most:
                    return self._halves(texts, starts)
            at = missing[first]
            words = [joined[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            entry[missing] = self._add(new, self._ids(words))[back]
        sizes = self.size[entry].astype(np.int64)
        after = np.concatenate([[0], sizes.cumsum()])
        out = self.pool[np.repeat(self.first[entry] - after[:-1], sizes) + np.arange(after[-1])].tobytes()
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        cut = (4 * after[np.searchsorted(starts, bounds)]).tolist()
        return [out[x:y] for x, y in zip(cut, cut[1:], strict=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, without end ids, as unsigned 32-bit bytes."""
        out: list[bytes] = []
        some: list[bytes] = []
        size = 0
        for t in texts:
            if len(t) > TURN_BYTES:
                out += self._some(some) if some else []
                out.append(b"".join(self._some([part])[0] for part in turns(t)))
                some, size = [], 0
                continue
            some.append(t)
            size += len(t)
            if size > TURN_BYTES:
                out += self._some(some)
                some, size = [], 0
        return out + self._some(some) if some else out


def turns(text: bytes) -> Iterator[bytes]:
    """A text cut after spaces, into parts of at most ``TURN_BYTES`` where no
    word is longer."""
    at = 0
    while len(text) - at > TURN_BYTES:
        end = at + TURN_BYTES
        cut = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end)) + 1
        if not cut:
            found = _SPACE.search(text, end)
            if not found:
                break
            cut = found.end()
        yield text[at:cut]
        at = cut
    yield text[at:]


def encoder(path: str) -> WordEncoder:
    """This worker's encoder; kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
