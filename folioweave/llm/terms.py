"""Terms of free-hand labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of which a run becomes one underscore, and those cut from both ends.
JOINTS = " \t\n\u00a0_\\-\u2010-\u2014"
ENDS = "_.,;:"


def _cut(col: Column) -> Column:
    joined = F.regexp_replace(F.lower(col), f"[{JOINTS}]+", "_")
    return F.regexp_replace(joined, f"^[{ENDS}]+|[{ENDS}]+$", "")


def term(col: Column) -> Column:
    """Term of a label; null for null and where nothing is left."""
    return F.nullif(_cut(col), F.lit(""))


def terms(col: Column) -> Column:
    """Terms of an array of labels in their order, those without term left out; null gives an empty array.

    The labels are cut once each; a null-if inside the loop would cut them twice.
    """
    found = F.filter(F.transform(col, _cut), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(found, F.array().cast("array<string>"))


def term_of(text: str | None) -> str | None:
    """:func:`term` of one Python string."""
    if text is None:
        return None
    return re.sub(f"[{JOINTS}]+", "_", text.lower()).strip(ENDS) or None
