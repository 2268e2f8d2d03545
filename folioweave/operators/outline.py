"""Best reasoning pattern of a structure spec, expanded to an ordered outline.

All of it is local to a spec's row: folds and filters over its arrays, so no
spec is shuffled. ``specs`` are parsed structure specs with a ``spec_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.functions.text import component_description
from folioweave.schemas import ALWAYS_KEPT_SECTIONS, PREFERRED_PATTERN


def _given(argument_type: Column) -> Column:
    return F.coalesce(argument_type != "", F.lit(False))


def best_model(models: Column, argument_type: Column | None = None) -> Column:
    """The chosen element of ``models`` with its 0-based ``pos``, null for none.

    The most frequent pattern, the first of tied ones. NaN is no greater than
    anything, and nothing is greater than a NaN that comes first. With a (non
    empty) argument type the first pattern of the preferred type, if any.
    """
    placed = F.transform(
        models,
        lambda m, i: F.struct(
            i.alias("pos"), m["pattern_type"].alias("pattern_type"), m["components"].alias("components"), m["frequency"].alias("frequency")
        ),
    )
    greatest = F.aggregate(
        placed,
        F.try_element_at(placed, F.lit(1)),
        lambda acc, x: F.when(
            ~F.isnan(x["frequency"]) & ~F.isnan(acc["frequency"]) & (x["frequency"] > acc["frequency"]), x
        ).otherwise(acc),
    )
    if argument_type is None:
        return greatest
    preferred = F.try_element_at(F.filter(placed, lambda x: x["pattern_type"] == PREFERRED_PATTERN), F.lit(1))
    return F.when(_given(argument_type), F.coalesce(preferred, greatest)).otherwise(greatest)


def matching_sections(sections: Column, argument_type: Column | None = None) -> Column:
    """Sections an outline for this argument type may use; all without a type."""
    if argument_type is None:
        return sections
    kept = F.filter(
        sections,
        lambda s: F.coalesce(s["argument_type"] == argument_type, F.lit(False))
        | F.coalesce(s["section_type"].isin(ALWAYS_KEPT_SECTIONS), F.lit(False)),
    )
    return F.when(_given(argument_type), kept).otherwise(sections)


def suggest_outline(specs: DataFrame, argument_type: str | Column | None = None) -> DataFrame:
    """Outline rows of every spec.

    Columns: spec_id, outline_kind (``pattern`` or ``sections``), ord (from 1),
    component, description, pattern_type, section_type, argument_type,
    reasoning_flow, expected_citations; those of the other kind are null. A
    chosen pattern without components gives no rows; sections are used only
    where a spec has no pattern. ``argument_type`` may be a column of the specs; null
    and the empty string filter nothing. Repeated specs give repeated rows.
    """
    wanted = F.lit(argument_type) if isinstance(argument_type, str) else argument_type
    no_models = F.size("reasoning_models") == 0
    best = best_model(F.col("reasoning_models"), wanted)
    text, integer, steps = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("array<string>")

    def item(kind: str, ord_: Column, **given: Column) -> Column:
        empty = {
            "component": text, "description": text, "pattern_type": text, "section_type": text,
            "argument_type": text, "reasoning_flow": steps, "expected_citations": integer,
        }
        return F.struct(
            F.lit(kind).alias("outline_kind"), ord_.cast("int").alias("ord"), *[c.alias(k) for k, c in (empty | given).items()]
        )

    pattern = F.transform(
        best["components"],
        lambda c, i: item("pattern", i + 1, component=c, description=component_description(c), pattern_type=best["pattern_type"]),
    )
    sections = F.transform(
        matching_sections(F.col("sections"), wanted),
        lambda s, i: item(
            "sections",
            i + 1,
            section_type=s["section_type"],
            argument_type=s["argument_type"],
            reasoning_flow=s["reasoning_flow"],
            expected_citations=s["citation_count"],
        ),
    )
    return specs.select("spec_id", F.inline(F.when(no_models, sections).otherwise(pattern)))
