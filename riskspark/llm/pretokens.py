r"""Splitting texts by pre-token patterns with \p{L}, \p{N} and \s.

Most texts hold only characters for which the classes are a few ranges; for those the pattern is compiled with the
ranges, which the standard engine matches several times faster. All other texts go to the engine that knows Unicode.
"""

from __future__ import annotations

import re

import regex

#: Letters, numbers and white space among the characters of a plain text.
RANGES = {r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ɏ", r"\p{N}": "0-9²³¹¼-¾", r"\s": "\t-\r \x85\xa0"}
PLAIN = re.compile("[\x00-ɏ‐-‧‰-⁞₠-₿]*+")


def plain_pattern(pattern: str) -> str:
    """The pattern with ranges in place of its classes."""

    def ranges(found: re.Match) -> str:
        part = found[0]
        if part == r"\S":
            return f"[^{RANGES[r'\s']}]"
        if not part.startswith("["):
            return f"[{RANGES[part]}]"
        for name, own in RANGES.items():
            part = part.replace(name, own)
        return part

    return re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\s|\\S", ranges, pattern)


def is_plain(text: str) -> bool:
    return text.isascii() or PLAIN.fullmatch(text) is not None


class Splitter:
    """All matches of a pattern in a text."""

    def __init__(self, pattern: str):
        self.plain = re.compile(plain_pattern(pattern)).findall
        self.full = regex.compile(pattern).findall

    def __call__(self, text: str) -> list[str]:
        return self.plain(text) if is_plain(text) else self.full(text)
