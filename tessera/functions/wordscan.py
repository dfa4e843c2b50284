"""The words of many texts at once, as arrays: what analysis.words gives of each text, without a loop over characters.

Words are marked in the code points of all texts of a batch, laid end to end: runs of word characters, and the joining
characters between two of them. A character costs a few table look-ups, so a pass over the texts is near to reading them.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa

from tessera.functions import analysis

_WORD, _LETTER, _NUMBER, _BEFORE_LETTER, _BEFORE_NUMBER = 1, 2, 4, 8, 16
#: Characters of the texts that are taken at once; a longer text is taken alone.
GROUP = 1 << 20


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, frozenset[int]]:
    """Of every code point its kind and its lower case; and those whose lower case hangs on what is around it, or is longer, which stay."""
    kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    bits = {"L": _WORD | _LETTER, "M": _WORD, "N": _WORD | _NUMBER}
    odd = {0x3A3}  # the sigma that has another form at the end of a word
    for at in (*range(0xD800), *range(0xE000, 0x32400), *range(0xE0000, 0xE0200)):  # no letters elsewhere
        ch = chr(at)
        kind[at] = bits.get(unicodedata.category(ch)[0], 0)
        if kind[at] and len(low := ch.lower()) == 1:
            lower[at] = ord(low)
        elif kind[at]:
            odd.add(at)
    lower[list(odd)] = list(odd)
    kind[ord("_")] = _WORD
    for ch in "'’.:":
        kind[ord(ch)] |= _BEFORE_LETTER
    for ch in ".,":
        kind[ord(ch)] |= _BEFORE_NUMBER
    return kind, lower, frozenset(odd)


_stem = lru_cache(maxsize=1 << 16)(analysis.porter)


class Words:
    """The words of some texts, dropped ones too: of the i-th text those from bounds[i] to bounds[i + 1]."""

    def __init__(self, texts: list[str]):
        kind, lower, odd = _tables()
        chars = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        kinds = kind[chars]
        inside = np.zeros(len(chars) + 1, bool)
        inside[1:] = (kinds & _WORD) > 0
        at = np.flatnonzero(kinds & (_BEFORE_LETTER | _BEFORE_NUMBER))
        at = at[inside[at]]  # after a word character; a line end closes every text, so there is a next one
        nxt, here = kinds[at + 1], kinds[at]
        at = at[((here & _BEFORE_LETTER > 0) & (nxt & _LETTER > 0)) | ((here & _BEFORE_NUMBER > 0) & (nxt & _NUMBER > 0))]
        inside[at + 1] = True
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[0::2], edges[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.bounds = np.searchsorted(start, np.concatenate([[0], ends]))
        keep = (kinds & (_LETTER | _NUMBER)) > 0
        owned = (end - start > 2) & (chars[end - 1] == ord("s")) & ((chars[end - 2] == ord("'")) | (chars[end - 2] == ord("’")))
        keep[end[owned] - 1] = False
        before = np.concatenate([[0], np.cumsum(keep)])
        self._first, self._last = before[start], before[end]
        raw = chars[keep]
        self._kept = lower[raw]
        self._bytes = np.concatenate([[0], np.cumsum(1 + (self._kept > 0x7F) + (self._kept > 0x7FF) + (self._kept > 0xFFFF))])
        self._size = self._last - self._first
        self._wide = self._bytes[self._last] - self._bytes[self._first] >= 2
        strange = np.flatnonzero(np.isin(self._kept, list(odd)))
        #: Words with a character that is no table's: their terms are taken one by one.
        self._odd = {}
        for w in np.unique(np.searchsorted(self._last, strange, "right")).tolist():
            self._odd[w] = raw[self._first[w] : self._last[w]].tobytes().decode("utf-32-le").lower()

    def __len__(self) -> int:
        return len(self._first)

    def _term(self, w: int) -> str:
        return self._odd[w] if w in self._odd else self._kept[self._first[w] : self._last[w]].tobytes().decode("utf-32-le")

    @cached_property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    @cached_property
    def place(self) -> np.ndarray:
        return np.arange(len(self)) - self.bounds[self.text_of]

    def lengths(self) -> list[int | None]:
        """Of each text the place of its last term plus one; none, if it has no term."""
        out = []
        for first, w in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist()):
            while w > first and not (self._wide[w - 1] and (self._size[w - 1] > _LONGEST_STOP or self._term(w - 1) not in _STOP)):
                w -= 1
            out.append(w - first if w > first else None)
        return out

    def find(self, term: str) -> np.ndarray:
        """The words that are this term, in order."""
        at = np.flatnonzero(self._size == len(term))
        for i, ch in enumerate(term):
            at = at[self._kept[self._first[at] + i] == ord(ch)]
        more = [w for w, t in self._odd.items() if t == term]
        return np.union1d(at, np.array(more, at.dtype)) if more else at

    def terms(self, among: np.ndarray) -> pa.DictionaryArray:
        """The terms of these words, by codes of the different ones."""
        size = self._size[among]
        offset = np.concatenate([[0], np.cumsum(size)])
        chars = self._kept[np.repeat(self._first[among] - offset[:-1], size) + np.arange(offset[-1])]
        wide = np.concatenate([[0], np.cumsum(1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF))])
        data = chars.tobytes().decode("utf-32-le").encode()
        out = pa.LargeStringArray.from_buffers(len(among), pa.py_buffer(wide[offset].astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
        if self._odd:
            names = out.to_pylist()
            for i in np.flatnonzero(np.isin(among, list(self._odd))).tolist():
                names[i] = self._odd[int(among[i])]
            out = pa.array(names, pa.string())
        return out.dictionary_encode()

    def remaining(self) -> tuple[np.ndarray, pa.DictionaryArray]:
        """The words that remain as terms, and their terms."""
        at = np.flatnonzero(self._wide)
        terms = self.terms(at)
        stop = np.array([t in _STOP for t in terms.dictionary.to_pylist()], bool)
        shown = ~stop[terms.indices.to_numpy()] if len(at) else np.zeros(0, bool)
        return at[shown], terms.filter(pa.array(shown))

    def find_stems(self, stems: list[str]) -> dict[str, np.ndarray]:
        """The words of each stem, in order. A stem begins as its words do and is no longer than they are."""
        found = {}
        heads = np.array([ord(s[0]) for s in stems], np.uint32)
        at = np.flatnonzero(self._wide & (self._size >= min(map(len, stems))))
        at = np.union1d(at[np.isin(self._kept[self._first[at]], heads)], np.array(list(self._odd), at.dtype))
        terms = self.terms(at)
        names = [None if t in _STOP else _stem(t) for t in terms.dictionary.to_pylist()]
        codes = terms.indices.to_numpy() if len(at) else np.zeros(0, np.int32)
        for s in stems:
            found[s] = at[np.array([n == s for n in names], bool)[codes]] if names else at[:0]
        return found


_STOP = frozenset(analysis.STOPWORDS)
_LONGEST_STOP = max(map(len, _STOP))


def groups(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts of a column, null ones as empty, in groups of few characters: the first one's index, and the group."""
    some, first, size = [], 0, 0
    for i, raw in enumerate(column.cast(pa.binary())):
        text = (raw.as_py() or b"").decode("utf-8", "replace")
        if some and size + len(text) > GROUP:
            yield first, some
            some, first, size = [], i, 0
        some.append(text)
        size += len(text)
    if some:
        yield first, some


def count_phrase(places: list[list[int]], slop: int) -> int:
    """Occurrences of a phrase: from each place of its first term the nearest later place of each next one, at most `slop` words skipped in sum."""
    found = 0
    for start in places[0]:
        at, gaps = start, 0
        for nxt in places[1:]:
            i = bisect_right(nxt, at)
            if i == len(nxt):
                break
            gaps += nxt[i] - at - 1
            at = nxt[i]
        else:
            found += gaps <= slop
    return found


def least_span(places: list[list[int]]) -> int:
    """Words that the shortest stretch with a place of each list covers."""
    every = sorted((p, i) for i, ps in enumerate(places) for p in ps)
    last: dict[int, int] = {}
    best = None
    for p, i in every:
        last[i] = p
        if len(last) == len(places):
            span = p - min(last.values()) + 1
            best = span if best is None else min(best, span)
    return best or 0
