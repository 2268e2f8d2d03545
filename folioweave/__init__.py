"""folioweave: format and structure specifications as Spark DataFrames.

Every public function takes and returns DataFrames or Columns, is lazy unless
its docstring says otherwise, and never changes the session's configuration.
"""

from folioweave.operators.cascade import built_in_defaults, resolve, rules_from_dicts, rules_from_json, to_wide
from folioweave.operators.drift import SpecDrift
from folioweave.operators.outline import suggest_outline
from folioweave.operators.shred import shred
from folioweave.sources.specs import (
    parse_format_specs,
    parse_structure_specs,
    read_format_specs,
    read_structure_specs,
)

__all__ = [
    "SpecDrift",
    "built_in_defaults",
    "parse_format_specs",
    "parse_structure_specs",
    "read_format_specs",
    "read_structure_specs",
    "resolve",
    "rules_from_dicts",
    "rules_from_json",
    "shred",
    "suggest_outline",
    "to_wide",
]
