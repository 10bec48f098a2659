"""Cutting a text at blanks so that every cut is also a cut of the byte-level BPE pattern.

The pattern never joins a blank to what stands before it unless that is white space, and a blank before a visible
character opens a new match. So a text can be cut before every blank, except where white space stands before the blank
and white space or the end behind it. The parts repeat a lot and are looked up instead of being encoded again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

#: Entries of a task's table of known parts; beyond it the table is emptied. Bounds memory, never changes results.
KNOWN_PARTS = 600_000
#: Longer parts are encoded each time and not kept.
KEPT_CHARS = 64
#: Characters of the texts whose new words are learned together.
TOGETHER_CHARS = 1 << 20
MARKS = (",", ".")


def parts_of(text: str) -> list[str]:
    """The parts of a text; joined they give the text."""
    words = text.split(" ")
    out = [words[0]]
    for word in words[1:]:
        if (not word or word[0].isspace()) and out[-1] and out[-1][-1].isspace():
            out[-1] += " " + word
        else:
            out.append(" " + word)
    return out


class PartCoder:
    """Little-endian 32-bit ids of whole texts from ids of parts, each distinct part encoded about once until the parts are forgotten."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], most: int | None = None):
        self.encode, self.most = encode, most or KNOWN_PARTS
        self.known: dict[str, bytes] = {}  # of a word that follows a blank
        self.marks: dict[str, bytes] = {}
        self.odd: set[str] = set()  # words that may have to be joined to the part before them

    def forget(self) -> None:
        self.known.clear()
        self.odd.clear()

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Makes the usual words known; returns the ids of the long ones."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.most:
            self.forget()
            new = list(words)
        self.odd.update(w for w in new if not w or w[0].isspace())
        # A comma or full stop behind a letter is a match of its own, so such words follow from their stems.
        stems = {w: w[:-1] if w[-1:] in MARKS and w[-2:-1].isalpha() else w for w in new}
        distinct = [s for s in set(stems.values()) if s not in self.known]
        coded = dict(zip(distinct, self.encode([" " + s for s in distinct]), strict=True))
        got = coded | {w: (coded[s] if s in coded else self.known[s]) + self._mark(w[-1]) for w, s in stems.items() if s is not w}
        self.known.update((w, b) for w, b in got.items() if len(w) <= KEPT_CHARS)
        return {w: b for w, b in got.items() if len(w) > KEPT_CHARS}

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            self.marks[mark] = b"".join(self.encode([mark]))
        return self.marks[mark]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        words, size = set(), 0
        begin = 0
        for n, text in enumerate(texts, 1):
            words.update(text.split(" ")[1:])
            size += len(text)
            if size >= TOGETHER_CHARS or n == len(texts):
                self._learn({w for w in words if len(w) <= KEPT_CHARS})
                out += [b"".join(self._text(t)) for t in texts[begin:n]]
                words, size, begin = set(), 0, n
        return out

    def _text(self, text: str) -> Iterable[bytes]:
        first, *rest = text.split(" ")
        distinct = set(rest)
        if "" in distinct or not self.odd.isdisjoint(distinct):
            first, *parts = parts_of(text)
            rest = [p[1:] for p in parts]
            distinct = set(rest)
        long = {} if all(map(self.known.__contains__, distinct)) else self._learn(distinct)
        if not self.odd.isdisjoint(distinct) and len(parts_of(text)) != len(rest) + 1:  # seen for the first time here
            return self._text(text)
        ids = [*self.encode([first])] if first else []
        return ids + [long[w] if w in long else self.known[w] for w in rest] if long else ids + [self.known[w] for w in rest]
