"""JSON text as the standard library reads it: NaN allowed, the last of repeated keys counts."""

from __future__ import annotations

import json
import sys

BROKEN = object()


class Literal(str):
    """A number (NaN and infinities too) as it is written."""

    __slots__ = ()


_WRITTEN = {"parse_int": Literal, "parse_float": Literal, "parse_constant": Literal}


def load(text: str | None, *, literal: bool = False) -> object:
    """The parsed text, or ``BROKEN`` if it is null, not JSON, or nested too deeply to read.

    With ``literal`` its numbers are ``Literal``.
    """
    if text is None:
        return BROKEN
    try:
        return json.loads(text, **_WRITTEN) if literal else json.loads(text)
    except RecursionError:
        return BROKEN
    except ValueError:
        if hasattr(sys, "set_int_max_str_digits") and sys.get_int_max_str_digits():
            sys.set_int_max_str_digits(0)  # a very long integer is JSON all the same
            return load(text)
        return BROKEN


def held(value: object, *, literal: bool = False) -> object:
    """A value, or what it holds if it is a string with a JSON object or array in it."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        inner = load(value, literal=literal)
        return value if inner is BROKEN else inner
    return value


def kind(value: object) -> str:
    """JSON type name."""
    return _KINDS[type(value)]


_KINDS = {
    dict: "object",
    list: "array",
    str: "string",
    bool: "boolean",
    int: "integer",
    float: "number",
    type(None): "null",
}


def scalar_text(value: object) -> str | None:
    """Text of a scalar: strings as they are, others as JSON; null for null."""
    if value is None:
        return None
    if isinstance(value, str):
        return clean(value)
    return str(value) if type(value) is int else json.dumps(value)


def written(value: object) -> str:
    """JSON text of what ``load`` gave with ``literal``, however deeply nested; numbers as they were written."""
    out: list[str] = []
    waiting: list[object] = [value]
    while waiting:
        x = waiting.pop()
        if isinstance(x, _Raw):
            out.append(x.text)
        elif isinstance(x, dict):
            waiting.append(_Raw("}"))
            for i, (name, inner) in reversed(list(enumerate(x.items()))):
                waiting += [inner, _Raw(f"{', ' if i else ''}{_quoted(name)}: ")]
            out.append("{")
        elif isinstance(x, list):
            waiting.append(_Raw("]"))
            for i, inner in reversed(list(enumerate(x))):
                waiting += [inner, _Raw(", ")] if i else [inner]
            out.append("[")
        elif isinstance(x, Literal):
            out.append(x)
        else:
            out.append(_quoted(x) if isinstance(x, str) else json.dumps(x))
    return "".join(out)


class _Raw:
    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = text


def _quoted(text: str) -> str:
    return json.dumps(clean(text), ensure_ascii=False)


def clean(text: str) -> str:
    """Text that UTF-8 can hold: lone surrogates become U+FFFD."""
    return text.encode("utf-8", "surrogatepass").decode("utf-8", "replace") if not text.isascii() else text
