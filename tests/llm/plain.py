"""Plain-Python twins of the contracts' text rules."""

import re
import string

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return WORD.findall(text or "")


def ascii_lower(text):
    return text.translate(_LOWER)
