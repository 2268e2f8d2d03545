"""JSON specs to fixed columns: one row a document, any number of documents.

``parse_*`` take a DataFrame with JSON text, ``read_*`` a path. Documents the
families' rules call broken (not JSON, a null section, a null array, an array
element that is no object) are handled as ``on_error`` says:

* ``"fail"``: the query fails with the problem's name when such a row is read;
* ``"quarantine"``: the row stays, its fields defaulted, its problem in ``problem``;
* ``"tolerate"``: as quarantine without the column.

Fields the families don't know are never parsed. An explicit null in a scalar
counts as missing; a scalar of the wrong type is null; null text is not JSON.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.schemas import FORMAT_SCHEMA, STRUCTURE_SCHEMA

_FORMAT_PARTS = (["_export_metadata", "typography", "layout"], ["headings", "sections"])
_STRUCTURE_PARTS = (
    ["_export_metadata", "document_metrics", "citation_graph"],
    ["argument_sections", "reasoning_patterns"],
)


def json_problem(text: Column, objects: list[str], arrays: list[str]) -> Column:
    """Name of the first defect of a document that a strict loader rejects, else null.

    A string that holds JSON is a string: where an object is due, it is a defect.
    """
    top = F.from_json(text, "MAP<STRING, STRING>")
    # Read with these types, what is no object (or has an element that is none) comes out as null.
    kinds = [f"`{p}` STRUCT<`~`: STRING>" for p in objects] + [f"`{p}` ARRAY<STRUCT<`~`: STRING>>" for p in arrays]
    shape = F.from_json(text, ", ".join(kinds))
    problem = F.when(top.isNull(), F.lit("malformed"))
    for part in objects:
        problem = problem.when(F.map_contains_key(top, part) & shape[part].isNull(), F.lit(f"not_an_object:{part}"))
    for part in arrays:
        bad = shape[part].isNull() | F.exists(shape[part], lambda x: x.isNull())
        problem = problem.when(F.map_contains_key(top, part) & bad, F.lit(f"not_an_array_of_objects:{part}"))
    return problem


def _checked(df: DataFrame, json_col: str, parts: tuple[list[str], list[str]], on_error: str) -> DataFrame:
    if on_error not in ("fail", "quarantine", "tolerate"):
        raise ValueError(f"on_error: {on_error!r}")
    if on_error == "tolerate":
        return df
    problem = json_problem(F.col(json_col), *parts)
    if on_error == "quarantine":
        return df.withColumn("problem", problem)
    return df.withColumn(json_col, F.when(problem.isNull(), F.col(json_col)).otherwise(F.raise_error(problem)))


def _keep(df: DataFrame, json_col: str, new: list[str]) -> list[str]:
    """Columns carried through: all but the text and those the parse replaces."""
    return [c for c in df.columns if c != json_col and c not in new]


def parse_format_specs(df: DataFrame, json_col: str = "value", on_error: str = "tolerate") -> DataFrame:
    """Format specs of a column of JSON text; other columns are carried through.

    A carried column whose name the parse gives anew is dropped.
    """
    df = _checked(df, json_col, _FORMAT_PARTS, on_error)
    d = F.from_json(F.col(json_col), FORMAT_SCHEMA)
    meta, typo, lay = d["_export_metadata"], d["typography"], d["layout"]

    def conf(name: str) -> Column:
        return F.coalesce(typo[name]["confidence"], F.lit(0.0))

    typography = F.struct(
        typo["font_family"]["value"].alias("font_family"),
        conf("font_family").alias("font_family_confidence"),
        typo["font_size_pt"]["value"].alias("font_size_pt"),
        conf("font_size_pt").alias("font_size_confidence"),
        typo["line_spacing"]["value"].alias("line_spacing"),
        conf("line_spacing").alias("line_spacing_confidence"),
    )
    sides = ["margin_top", "margin_bottom", "margin_left", "margin_right", "body_indent", "block_quote_indent"]
    headings = F.transform(
        d["headings"],
        lambda h: F.struct(
            F.coalesce(h["level"], F.lit(1)).alias("level"),
            *[h[c]["value"].alias(c) for c in ("case_style", "alignment", "bold", "font_size_pt", "numbering")],
        ),
    )
    sections = F.transform(
        d["sections"],
        lambda s: F.struct(
            F.coalesce(s["id"], F.lit("")).alias("id"),
            F.coalesce(s["frequency"], F.lit(0.0)).alias("frequency"),
            F.coalesce(s["median_order"], F.lit(0)).alias("median_order"),
        ),
    )
    new = {
        "document_count": F.coalesce(meta["document_count"], F.lit(0)),
        "overall_confidence": F.coalesce(meta["overall_confidence"], F.lit(0.0)),
        "typography": typography,
        "layout": F.struct(*[lay[c]["value"].alias(c) for c in sides]),
        "headings": F.coalesce(headings, F.array().cast(_HEADINGS)),
        "sections": F.coalesce(sections, F.array().cast(_SECTIONS)),
    }
    return df.select(*_keep(df, json_col, list(new)), *[c.alias(k) for k, c in new.items()])


_HEADINGS = (
    "ARRAY<STRUCT<level: INT, case_style: STRING, alignment: STRING, bold: BOOLEAN, "
    "font_size_pt: DOUBLE, numbering: STRING>>"
)
_SECTIONS = "ARRAY<STRUCT<id: STRING, frequency: DOUBLE, median_order: INT>>"
_ARGUMENTS = (
    "ARRAY<STRUCT<id: STRING, section_type: STRING, argument_type: STRING, standard_of_review: STRING, "
    "reasoning_flow: ARRAY<STRING>, citation_count: INT, word_count: INT, depth: INT>>"
)
_MODELS = (
    "ARRAY<STRUCT<pattern_type: STRING, components: ARRAY<STRING>, frequency: DOUBLE, "
    "typical_citation_density: DOUBLE>>"
)


def parse_structure_specs(df: DataFrame, json_col: str = "value", on_error: str = "tolerate") -> DataFrame:
    """Structure specs of a column of JSON text; see :func:`parse_format_specs`."""
    df = _checked(df, json_col, _STRUCTURE_PARTS, on_error)
    d = F.from_json(F.col(json_col), STRUCTURE_SCHEMA)
    metrics, graph = d["document_metrics"], d["citation_graph"]
    no_steps, no_counts = F.array().cast("ARRAY<STRING>"), F.create_map().cast("MAP<STRING, INT>")
    sections = F.transform(
        d["argument_sections"],
        lambda s: F.struct(
            *[F.coalesce(s[c], F.lit("")).alias(c) for c in ("id", "section_type", "argument_type", "standard_of_review")],
            F.coalesce(s["reasoning_flow"], no_steps).alias("reasoning_flow"),
            F.coalesce(s["citation_count"], F.lit(0)).alias("citation_count"),
            F.coalesce(s["word_count"], F.lit(0)).alias("word_count"),
            F.coalesce(s["depth"], F.lit(1)).alias("depth"),
        ),
    )
    models = F.transform(
        d["reasoning_patterns"],
        lambda m: F.struct(
            F.coalesce(m["pattern_type"], F.lit("")).alias("pattern_type"),
            F.coalesce(m["components"], no_steps).alias("components"),
            F.coalesce(m["frequency"], F.lit(0.0)).alias("frequency"),
            F.coalesce(m["typical_citation_density"], F.lit(0.0)).alias("typical_citation_density"),
        ),
    )
    patterns = F.struct(
        F.coalesce(graph["total_citations"], F.lit(0)).alias("total_citations"),
        F.coalesce(graph["unique_authorities"], F.lit(0)).alias("unique_authorities"),
        F.coalesce(graph["citation_density"], F.lit(0.0)).alias("citation_density"),
        *[F.coalesce(graph[c], no_counts).alias(c) for c in ("by_section", "signal_distribution", "court_distribution")],
        F.coalesce(graph["pinpoint_rate"], F.lit(0.0)).alias("pinpoint_rate"),
    )
    new = {
        "document_type": F.coalesce(d["_export_metadata"]["document_type"], F.lit("")),
        **{c: F.coalesce(metrics[c], F.lit(0)) for c in ("total_word_count", "total_sections", "total_arguments")},
        "argument_to_total_ratio": F.coalesce(metrics["argument_to_total_ratio"], F.lit(0.0)),
        "sections": F.coalesce(sections, F.array().cast(_ARGUMENTS)),
        "citation_patterns": patterns,
        "reasoning_models": F.coalesce(models, F.array().cast(_MODELS)),
    }
    return df.select(*_keep(df, json_col, list(new)), *[c.alias(k) for k, c in new.items()])


def read_json_texts(spark: SparkSession, path: str | os.PathLike) -> DataFrame:
    """One row a file: ``spec_id`` (the file's path) and ``value`` (its text)."""
    df = spark.read.text(os.fspath(path), wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("spec_id"), "value")


def read_format_specs(spark: SparkSession, path: str | os.PathLike, on_error: str = "fail") -> DataFrame:
    """Format specs of a JSON file, a directory or a glob; a missing path is an error."""
    return parse_format_specs(read_json_texts(spark, path), on_error=on_error)


def read_structure_specs(spark: SparkSession, path: str | os.PathLike, on_error: str = "fail") -> DataFrame:
    """Structure specs of a JSON file, a directory or a glob; a missing path is an error."""
    return parse_structure_specs(read_json_texts(spark, path), on_error=on_error)
