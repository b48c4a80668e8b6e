"""Long texts in bounded parts, cut where no word is cut."""
from __future__ import annotations

import re

PART_BYTES = 1 << 20


def parts(text: bytes, between: re.Pattern, size: int = PART_BYTES):
    """Consecutive parts of at least ``size`` bytes that end before a match of
    ``between`` (a pattern of one byte that no word holds)."""
    at = 0
    while at < len(text):
        found = between.search(text, at + size)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end
