"""Where Python's Unicode data and those of the tokenizers library differ, and how to bridge it.

The library follows Unicode 16; the regex module follows a later version and Python's str.lower an earlier one.
"""

from __future__ import annotations

import re

# Letters and numbers of the regex module that the library takes for other characters (first, last).
LATER_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9),
    (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF3), (0x16FF4, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
# Capitals that Python does not lower yet (first, last, offset to the small letter).
LATER_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)

_any_later = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER_LETTERS) + "]")
_any_capital = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b, _ in LATER_CAPITALS) + "Σ]")
_lower = {c: c + by for a, b, by in LATER_CAPITALS for c in range(a, b + 1)} | {ord("Σ"): ord("σ")}


def lower(text: str) -> str:
    """Lower case letter by letter: a capital sigma never becomes its word-final form."""
    if not text.isascii() and _any_capital.search(text):
        text = text.translate(_lower)
    return text.lower()


def as_classed(text: str) -> str:
    """``text`` with the later letters and numbers replaced by a character that is neither, one for one."""
    return text if text.isascii() else _any_later.sub("\0", text)


def find_words(pattern, text: str) -> list[str]:
    """Matches of a word pattern of the regex module as the library would find them."""
    if text.isascii() or not _any_later.search(text):
        return pattern.findall(text)
    return [text[m.start() : m.end()] for m in pattern.finditer(as_classed(text))]
