"""Cutting texts into units whose tokens do not depend on what stands around them.

The split pattern of byte-level BPE takes a single space together with what
follows it, and never joins letters, digits or signs across white space. So a
text may be cut before each space, and equal units be tokenised once. A run of
white space that goes on beyond such a cut is the one exception; those texts
are cut by the pattern itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

#: Separators that Python takes for white space but Unicode does not.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_WHITE = re.compile(r"[\s\x1c-\x1f]")


def unicode_pattern(pattern: str) -> str:
    """``pattern`` for the regex module, with white space as Unicode defines it."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class Units:
    """The distinct units of a block of texts: ``texts`` has them by place, ``size`` is their characters together."""

    def __init__(self, find: Callable[[str], list[str]] | None = None):
        self.find, self.texts, self.size = find, [], 0
        self._bare: dict[str, int] = {}
        self._spaced: dict[str, int] = {}
        self._joined: set[int] = set()

    def _add(self, table: dict[str, int], key: str, unit: str) -> int:
        place = table[key] = len(self.texts)
        self.texts.append(unit)
        self.size += len(unit)
        if not key or key[0].isspace() or key[-1].isspace() or _SEPARATORS.search(key):
            self._joined.add(place)
        return place

    def cut(self, text: str) -> np.ndarray | None:
        """Places of the units of ``text``, in order; None if it can't be cut and there is no ``find``."""
        bare, spaced = self._bare, self._spaced
        first, *later = text.split(" ")
        places = [bare[first] if first in bare else self._add(bare, first, first)]
        for x in later:
            place = spaced.get(x)
            places.append(self._add(spaced, x, " " + x) if place is None else place)
        if not self._joined.isdisjoint(places):  # white space may go on beyond a cut
            if self.find is None:
                return None
            places = [bare[x] if x in bare else self._add(bare, x, x) for x in self.find(text)]
        return np.array(places, np.int64)


def parts(text: str, size: int) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, whose tokens together are those of the text.

    A part begins at a space between two characters that are no white space; a
    stretch without such a place stays whole.
    """
    a = 0
    while len(text) - a > size:
        b = text.find(" ", a + size)
        while b > 0 and (b + 1 == len(text) or _WHITE.match(text, b - 1) or _WHITE.match(text, b + 1)):
            b = text.find(" ", b + 1)
        if b < 0:
            break
        yield text[a:b]
        a = b
    yield text[a:]
