"""Which name stands for which catalogued field: the alias table's rules."""

from __future__ import annotations

import re
from functools import lru_cache

# Tokens that say nothing about which field is meant, in a field's
# name (OPTIONAL) or in the name that replaces it (NOISE), and token synonyms.
OPTIONAL = {"total", "count", "engine"}
NOISE = {"ml", "in", "inch", "inches", "cm", "mm", "pt", "page", "doc", "total", "count", "of", "the"}
SYNONYMS = {"n": "count", "num": "count", "nr": "count", "no": "count", "number": "count", "sz": "size"}


_VERSION = re.compile(r"(?<=[a-z])[_\-. ]?[vV]?\d+$")


@lru_cache(100_000)
def tokens(name: str) -> tuple[str, ...]:
    """Lower-case words of a name in any case style, plurals and a version's number at the end cut."""
    name = _VERSION.sub("", name)
    words = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)
    out = (SYNONYMS.get(w.lower(), w.lower()) for w in words)
    return tuple(w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in out)


def abbreviates(short: str, word: str) -> bool:
    """Is ``short`` an abbreviation: same first letter, letters in the word's order, at least two."""
    if len(short) < 2 or len(short) >= len(word) or short[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


@lru_cache(100_000)
def alias_cost(field: str, context: tuple[str, ...], found: tuple[str, ...]) -> int | None:
    """How far the names ``found`` (a path) are from ``field``, or None if they don't mean it.

    Every telling word of the field must be there, in any order, whole or
    abbreviated; each other word must be one of the field's, of its containers'
    or an empty one. The cost counts words missing or in excess.
    """
    own = tokens(field)
    there = tuple(t for name in found for t in tokens(name))
    if not there:
        return None
    if "".join(there) == "".join(own):
        return 0
    around = {t for name in context for t in tokens(name)}
    left, excess = list(own), 0
    for t in there:
        match = next((w for w in left if w == t), None) or next((w for w in left if abbreviates(t, w)), None)
        if match:
            left.remove(match)
        elif t in NOISE or t in around or t in own:
            excess += 1
        else:
            return None
    core = [w for w in left if w not in OPTIONAL]
    if core or len(left) == len(own):
        return None
    return 1 + excess + len(left)
