"""Pre-tokens of the byte-level vocabularies, and bounded caches over them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

import regex

#: Entries that a worker's cache holds before it starts anew.
CACHE_ENTRIES = 300_000
#: A longer pre-token is encoded each time, so that no cache holds long texts.
CACHED_LENGTH = 64


class Cache(dict):
    """Pre-token to what ``make`` says of it, for a list of them at once.

    Beside ``fixed``, at most ``entries`` stay from one call of :meth:`learn` to the next.
    """

    def __init__(self, make: Callable[[list[str]], Iterable], fixed: dict | None = None, entries: int = CACHE_ENTRIES):
        super().__init__(fixed or {})
        self.make, self.fixed, self.entries, self.long = make, fixed or {}, entries, []

    def bounded(self) -> None:
        """Starts anew if it holds too many entries."""
        if len(self) > self.entries + len(self.fixed):
            self.clear()
            self.update(self.fixed)

    def learn(self, lists: Iterable[Iterable[str]]) -> None:
        """Makes every piece of the lists known."""
        for piece in self.long:
            self.pop(piece, None)
        self.bounded()
        missing = list({piece for pieces in lists for piece in pieces if piece not in self})
        self.long = [piece for piece in missing if len(piece) > CACHED_LENGTH]
        self.update(zip(missing, self.make(missing), strict=True))


@cache
def pattern(source: str) -> regex.Pattern:
    return regex.compile(source)


@cache
def newer_characters() -> regex.Pattern:
    """Characters that Unicode 3.2 did not have.

    Libraries carry different Unicode versions, so that their classes of letters and numbers
    may differ for these. A text that holds one is left to the library as a whole.
    """
    old, runs = unicodedata.ucd_3_2_0, []
    for c in range(0x110000):
        if old.category(chr(c)) in ("Cn", "Cs"):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")


#: Beyond Latin letters with accents and common punctuation.
_FAR = re.compile("[^\x00-\u0220\u2010-\u2027\u20ac]")


def settled(text: str) -> bool:
    """Whether all libraries split this text alike."""
    return text.isascii() or _FAR.search(text) is None or newer_characters().search(text) is None


@cache
def _near(source: str) -> re.Pattern:
    """The pattern for texts within ``_FAR``, with its classes spelled out for the faster ``re``."""
    chars = [chr(c) for c in (*range(0x221), *range(0x2010, 0x2028), 0x20AC)]
    out = source
    for name in "LN":
        own = "".join(f"\\U{ord(c):08x}" for c in chars if unicodedata.category(c)[0] == name)
        out = out.replace(f"[^\\s\\p{{L}}\\p{{N}}]", "[^\\s\\p{L}\\p{N}]").replace(f"\\p{{{name}}}+", f"[{own}]+").replace(f"\\p{{{name}}}", own)
    space = "".join(f"\\U{ord(c):08x}" for c in chars if regex.match(r"\s", c))
    return re.compile(out.replace("[^\\s", f"[^{space}").replace("\\S", f"[^{space}]").replace("\\s", f"[{space}]"))


def split(text: str, source: str) -> list[str]:
    """All matches of the pattern."""
    return (_near if text.isascii() or _FAR.search(text) is None else pattern)(source).findall(text)
