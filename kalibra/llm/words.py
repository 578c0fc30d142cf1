"""Word splitting that all text operators share."""

from __future__ import annotations

import re

#: A word: a run of characters other than space and the ASCII controls 09-0D.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Where str.split() splits as well, though these belong to words here.
_MORE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def ascii_lower(text: str) -> str:
    """``text`` with A-Z lower-cased and every other character as it is."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def words(text: str) -> list[str]:
    return WORD.findall(text) if _MORE.search(text) else text.split()
