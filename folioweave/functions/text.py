"""String expressions Spark has no single built-in for."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioweave.schemas import COMPONENT_DESCRIPTIONS

_CASED = r"\p{IsLowercase}\p{IsUppercase}\p{IsTitlecase}"


def title_case(col: Column) -> Column:
    """Capitalise each run of cased characters, as Python's ``str.title``.

    ``initcap`` only starts a word after white space; here any uncased
    character starts one (``o'neil 3rd`` -> ``O'Neil 3Rd``). Null gives null.
    """
    runs = F.regexp_extract_all(col, F.lit(f"([{_CASED}]+|[^{_CASED}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda t: F.initcap(t)), "")


def component_description(col: Column) -> Column:
    """Known description of a reasoning component, else its name in title case."""
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(COMPONENT_DESCRIPTIONS.items())])
    return F.coalesce(F.try_element_at(known, col), title_case(F.replace(col, F.lit("_"), F.lit(" "))))


def json_scalar(col: Column) -> Column:
    """Tagged value of a JSON value's text; null text is the JSON null. Arrays and objects keep their JSON text."""
    text = F.trim(col)
    number = text.try_cast("double")
    kind = (
        F.when(text.isNull() | (text == "null"), "null")
        .when(text.isin("true", "false"), "boolean")
        .when(number.isNotNull(), "number")
        .when(text.startswith("["), "array")
        .when(text.startswith("{"), "object")
        .otherwise("string")
    )
    # from_json undoes the escapes of a quoted string.
    unquoted = F.coalesce(F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v STRING")["v"], text)
    return F.struct(
        kind.alias("type"),
        F.when(kind == "string", unquoted).when(kind.isin("array", "object"), text).alias("s"),
        F.when(kind == "number", number).alias("d"),
        F.when(kind == "boolean", text == "true").alias("b"),
    )
