"""Many literal values looked for in a text at once, in time linear in the text."""

from __future__ import annotations

import re
from collections.abc import Iterable

_BLANK = re.compile(r"[ \t\n\x0b\f\r]+")


def folded(text: str) -> tuple[str, list[int] | None]:
    """The text in lower case with runs of white space as one blank, and where each character came from.

    None in place of the list when no place moved. A character without a lower case of one
    character stays as it is.
    """
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    short = _BLANK.sub(" ", low)
    if len(short) == len(low):
        return short, None
    at, places = 0, []
    for run in _BLANK.finditer(low):
        places += range(at, run.start() + 1)
        at = run.end()
    return short, places + list(range(at, len(low) + 1))


class Values:
    """An automaton over values; every value keeps what replaces it."""

    def __init__(self, values: Iterable[tuple[str, str]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for value, replacement in values:
            name = folded(value)[0]
            if name:
                self.automaton.add_word(name, (len(name), value, replacement))
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, value, replacement) of every occurrence, nested and overlapping ones too."""
        if not self.any:
            return []
        short, places = folded(text)
        out = []
        for last, (n, value, replacement) in self.automaton.iter(short):
            start, end = last + 1 - n, last + 1
            if places is not None:
                # an end after a run of blanks is the run's own end only if the value ends in a blank, which no value does
                start, end = places[start], places[last] + 1
            out.append((start, end, value, replacement))
        return out


def replaced(text: str, spans: Iterable[tuple[int, int, str, str]]) -> str:
    """The text with spans replaced: longer values first, then by value, from left to right; what overlaps one that is taken stays."""
    taken = bytearray(len(text))
    kept = []
    for start, end, _, replacement in sorted(spans, key=lambda s: (-len(s[2]), s[2], s[3], s[0])):
        if not any(taken[start:end]):
            taken[start:end] = b"\x01" * (end - start)
            kept.append((start, end, replacement))
    out, at = [], 0
    for start, end, replacement in sorted(kept):
        out += [text[at:start], replacement]
        at = end
    return "".join([*out, text[at:]])
