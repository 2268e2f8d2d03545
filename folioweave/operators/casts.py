"""Casts of the consistent table: any file's values in the catalogued columns and types.

A caster is generated from the catalogue. Values come as the standard library
reads them, numbers as they are written (``jsontext.Literal``).
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa

from folioweave.functions.jsontext import Literal, clean, held, written
from folioweave.operators.names import alias_cost, tokens

# How many of a unit make an inch.
UNITS = {"mm": 25.4, "millimeter": 25.4, "millimetre": 25.4, "cm": 2.54, "centimeter": 2.54, "centimetre": 2.54}
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?")
_UNIT = re.compile(r"\d\s*([a-z]+)\b")
_WRAPPED = {"value", "confidence"}


def _text(value: object) -> str | None:
    """A scalar as it is written, an object or array as JSON text."""
    return None if value is None else clean(value) if isinstance(value, str) else written(value)


def _float(value: object, unit: str | None) -> float | None:
    """A number, or the first in a text, in inches if its unit is another one of length."""
    text = _text(value)
    if text is None or isinstance(value, bool):
        return None
    try:
        n = float(text)
    except ValueError:
        found = _NUMBER.search(text)
        if not found:
            return None
        n = float(found[0])
        unit = next((u for u in _UNIT.findall(text) if u in UNITS), unit)
    return round(n / UNITS[unit], 4) if unit in UNITS else n


def _integer(value: object) -> int | None:
    text = _text(value)
    if text is None or isinstance(value, bool):
        return None
    if isinstance(value, dict) and value and all(isinstance(x, Literal) for x in value.values()):
        text = str(sum(float(x) for x in value.values()))  # a count told by its parts
    try:
        n = int(text)
    except ValueError:
        x = _float(text, None)
        n = int(x) if x is not None and abs(x) < 2**63 else None
    return n if n is not None and -(2**63) <= n < 2**63 else None


def _boolean(value: object) -> bool | None:
    if isinstance(value, bool):
        return value
    return {"true": True, "false": False}.get(value.strip().lower()) if isinstance(value, str) else None


def _version(value: object) -> str | None:
    """A version told by the parts of an object or array is joined with dots."""
    text = _text(value)
    return ".".join(re.findall(r"\d+", text)) if isinstance(value, (dict, list)) else text


def _unit_of(name: str) -> str | None:
    """The unit of length that a field's name tells."""
    return next((t for t in tokens(name) if t in UNITS), None)


class Caster:
    """Casts of one family's files; ``types`` and ``children`` are those of its catalogue."""

    def __init__(self, types: dict[str, str], children: dict[str, list[str]]):
        self.types, self.children = types, children

    def _inner(self, path: str) -> list[str]:
        return self.children.get(f"{path}[]" if self.types[path] == "array" else path, [])

    def ddl(self, path: str) -> str:
        """Spark type of a catalogued field."""
        inner = self._inner(path)
        struct = f"STRUCT<{', '.join(f'`{_last(c)}`: {self.ddl(c)}' for c in inner)}>"
        t = self.types[path]
        if t == "array":
            return f"ARRAY<{struct if inner else 'STRING'}>"
        if t == "object":
            return struct if inner else "MAP<STRING, STRING>"
        return {"string": "STRING", "integer": "BIGINT", "number": "DOUBLE", "boolean": "BOOLEAN"}[t]

    def arrow(self, path: str) -> pa.DataType:
        inner = self._inner(path)
        struct = pa.struct([(_last(c), self.arrow(c)) for c in inner])
        t = self.types[path]
        if t == "array":
            return pa.list_(struct if inner else pa.string())
        if t == "object":
            return struct if inner else pa.map_(pa.string(), pa.string())
        return {"string": pa.string(), "integer": pa.int64(), "number": pa.float64(), "boolean": pa.bool_()}[t]

    def row(self, doc: dict, moved: dict[str, str]) -> dict[str, object]:
        """A file's values by top-level field; ``moved`` tells where renamed fields stand in it."""

        def found(path: str, parent: object) -> tuple[object, str]:
            """The field's value, and the name that it has."""
            name = _last(path)
            if isinstance(parent, dict) and parent.get(name) is not None:
                return parent[name], name
            if path in moved:
                x = _at(doc, moved[path])
                return x, _last(moved[path])
            return None, name

        return {p: self._cast(p, *found(p, doc), found) for p in self.children[""]}

    def _cast(self, path: str, value: object, name: str, found: Callable) -> object:
        value = value if isinstance(value, Literal) else held(value, literal=True)
        t, inner = self.types[path], self._inner(path)
        if t == "array":
            if value is None:
                return None
            items = value if isinstance(value, list) else [value]
            return [self._element(inner, x) for x in items] if inner else [_text(x) for x in items]
        if t == "object":
            return self._struct(path, inner, value, name, found) if inner else _map(value)
        if t == "string":
            return _version(value) if "version" in tokens(name) or "version" in tokens(_last(path)) else _text(value)
        if t == "number":
            return _float(value, _unit_of(name))
        return _integer(value) if t == "integer" else _boolean(value)

    def _struct(self, path: str, inner: list[str], value: object, name: str, found: Callable) -> dict | None:
        wraps = {_last(c) for c in inner} >= _WRAPPED
        if wraps:
            if value is None:
                return None
            parts = value if isinstance(value, dict) else {"value": value}
            unit = parts.get("unit") if isinstance(parts.get("unit"), str) else _unit_of(name)
            return {
                _last(c): _float(parts.get(_last(c)), unit) if _last(c) == "value" and self.types[c] == "number" else self._cast(c, parts.get(_last(c)), _last(c), found)
                for c in inner
            }
        out = {}
        for c in inner:
            x, their_name = found(c, value)
            if x is None:
                x, their_name = _listed(value, _last(c)), _last(c)
            out[_last(c)] = self._cast(c, x, their_name, found)
        return out if value is not None or any(x is not None for x in out.values()) else None

    def _element(self, inner: list[str], value: object) -> dict | None:
        """An element of an array of objects; what is none is null and keeps its place."""
        value = value if isinstance(value, Literal) else held(value, literal=True)
        if not isinstance(value, dict):
            return None
        known = {_last(c) for c in inner}
        strays = [n for n, x in value.items() if n not in known and x is not None]

        def found(path: str, parent: object) -> tuple[object, str]:
            name = _last(path)
            if not isinstance(parent, dict):
                return None, name
            if parent.get(name) is not None or parent is not value:
                return parent.get(name), name
            costs = sorted((cost, n) for n in strays if (cost := alias_cost(name, (), (n,))) is not None)
            return (parent[costs[0][1]], costs[0][1]) if costs else (None, name)

        return {_last(c): self._cast(c, *found(c, value), found) for c in inner}


def _last(path: str) -> str:
    return path.rpartition(".")[2]


def _at(doc: object, path: str) -> object:
    """The value at a path of names; names may hold dots themselves."""
    names = path.split(".")
    waiting = [(doc, 0)]
    while waiting:
        obj, low = waiting.pop()
        if low == len(names):
            if obj is not None:
                return obj
        elif isinstance(obj, dict):
            waiting += [(obj[n], high) for high in range(len(names), low, -1) if (n := ".".join(names[low:high])) in obj]
    return None


def _map(value: object) -> list[tuple[str, str | None]] | None:
    """Texts by key; an array's by their places, anything else's by the empty key."""
    if value is None:
        return None
    parts = value if isinstance(value, dict) else dict(enumerate(value)) if isinstance(value, list) else {"": value}
    return list({clean(str(k)): _text(x) for k, x in parts.items()}.items())


def _listed(container: object, name: str) -> object:
    """A named part of a container written as a list of named objects or as name=value text."""
    if isinstance(container, list):
        parts = (x if isinstance(x, Literal) else held(x, literal=True) for x in container)
        return next((x for x in parts if isinstance(x, dict) and x.get("name") == name), None)
    if isinstance(container, str):
        found = re.search(rf"(?:^|[;,\s]){re.escape(name)}\s*=\s*([^;,\s]+)", container)
        return found and found[1]
    return None
