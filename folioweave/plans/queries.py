"""The core's queries over the test tables, and the same in SQL.

q01-q25 go through JSON: the latest delivery of each spec is written as JSON
text and read back by the loaders, so a loader's mistake shows as a mismatch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.functions.text import component_description, json_scalar, title_case
from folioweave.operators.cascade import (
    built_in_defaults,
    learned_entries,
    resolve,
    typography_candidates,
)
from folioweave.operators.deliveries import latest
from folioweave.operators.drift import SpecDrift
from folioweave.operators.outline import best_model, suggest_outline
from folioweave.operators.shred import adjacency, entities, other_fields, parent_child_links, tables
from folioweave.schemas import BUILT_IN_DEFAULTS, COMPONENT_DESCRIPTIONS
from folioweave.session import scratch
from folioweave.sources.specs import _FORMAT_PARTS, _STRUCTURE_PARTS, parse_format_specs, parse_structure_specs, read_structure_specs

CUSTOM_DEFAULTS = {"font_name": "Plinth Sans", "gutter_inches": 0.25}
ARGUMENT_TYPE = "statutory_construction"


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _specs(spark: SparkSession, sf: str, table: str, parts: list[str]) -> DataFrame:
    keys = ["spec_id", "received_at", "court_code"]
    rows = latest(_read(spark, sf, table).select(*keys, *parts), "spec_id")
    return rows.select("spec_id", "court_code", F.to_json(F.struct(*parts)).alias("value"))


def formats(spark: SparkSession, sf: str, *parts: str) -> DataFrame:
    return parse_format_specs(_specs(spark, sf, "format_specs", list(parts)))


def structures(spark: SparkSession, sf: str, *parts: str) -> DataFrame:
    return parse_structure_specs(_specs(spark, sf, "structure_specs", list(parts)))


def page_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = _read(spark, sf, "page_rules")
    return rules.select("court_code", F.col("rule_key").alias("key"), json_scalar(F.col("rule_value")).alias("val"))


def _flat(resolved: DataFrame) -> DataFrame:
    return resolved.select("spec_id", "key", F.col("val.s").alias("val_s"), F.col("val.d").alias("val_d"), "provenance")


_LEARNED = ("_export_metadata", "typography", "layout")


def q01(spark: SparkSession, sf: str) -> DataFrame:
    return formats(spark, sf, "_export_metadata").select("spec_id", "document_count", "overall_confidence")


def q02(spark: SparkSession, sf: str) -> DataFrame:
    return formats(spark, sf, "typography").select("spec_id", "typography.*")


def q03(spark: SparkSession, sf: str) -> DataFrame:
    return formats(spark, sf, "layout").select("spec_id", "layout.*")


def q04(spark: SparkSession, sf: str) -> DataFrame:
    rows = formats(spark, sf, "headings").select("spec_id", F.posexplode("headings").alias("pos", "h"))
    return rows.select("spec_id", "pos", "h.*")


def q05(spark: SparkSession, sf: str) -> DataFrame:
    rows = formats(spark, sf, "sections").select("spec_id", F.posexplode("sections").alias("pos", "s"))
    return rows.select("spec_id", "pos", "s.*")


def q06(spark: SparkSession, sf: str) -> DataFrame:
    """Every spec read with its font family bare: a bare scalar is no wrapped value."""
    rows = latest(_read(spark, sf, "format_specs").select("spec_id", "received_at", "typography"), "spec_id")
    family = F.col("typography.font_family.value")
    bare = F.to_json(F.struct(F.struct(family.alias("font_family"), F.col("typography.line_spacing").alias("line_spacing")).alias("typography")))
    typo = parse_format_specs(rows.select("spec_id", bare.alias("value"))).select("spec_id", "typography.*")
    return typo.select("spec_id", "font_family", "font_family_confidence", "line_spacing", "line_spacing_confidence")


def q07(spark: SparkSession, sf: str) -> DataFrame:
    return built_in_defaults(spark).select("key", F.col("val.s").alias("val_s"), F.col("val.d").alias("val_d"))


def q08(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(resolve(formats(spark, sf, *_LEARNED), learned=False))


def q09(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(resolve(formats(spark, sf, *_LEARNED), page_rules(spark, sf), rule_set_col="court_code", learned=False))


def q10(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(resolve(formats(spark, sf, *_LEARNED)))


def q11(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(resolve(formats(spark, sf, *_LEARNED), page_rules(spark, sf), rule_set_col="court_code"))


def q12(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(resolve(formats(spark, sf, *_LEARNED), page_rules(spark, sf), CUSTOM_DEFAULTS, "court_code"))


def q13(spark: SparkSession, sf: str) -> DataFrame:
    rows = resolve(formats(spark, sf, *_LEARNED), page_rules(spark, sf), rule_set_col="court_code")
    nulls = rows.filter("val.type = 'null'")
    return nulls.select("spec_id", "key", F.col("val.s").alias("val_s"), "provenance")


def q14(spark: SparkSession, sf: str) -> DataFrame:
    return formats(spark, sf, *_LEARNED).select("spec_id", F.size(learned_entries()).alias("n_ml_keys"))


def q15(spark: SparkSession, sf: str) -> DataFrame:
    rows = formats(spark, sf, "typography").select("spec_id", F.inline(typography_candidates()))
    return rows.select("spec_id", "key", "admitted")


def q16(spark: SparkSession, sf: str) -> DataFrame:
    return structures(spark, sf, "_export_metadata", "document_metrics").select(
        "spec_id", "document_type", "total_word_count", "total_sections", "total_arguments", "argument_to_total_ratio"
    )


def _joined(steps: Column) -> Column:
    return F.array_join(steps, "|", "~")


def q17(spark: SparkSession, sf: str) -> DataFrame:
    rows = structures(spark, sf, "argument_sections").select("spec_id", F.posexplode("sections").alias("pos", "s"))
    return rows.select("spec_id", "pos", "s.*").withColumn("reasoning_flow", _joined(F.col("reasoning_flow")))


def q18(spark: SparkSession, sf: str) -> DataFrame:
    names = ["by_section", "signal_distribution", "court_distribution"]
    maps = F.array(*[F.struct(F.lit(n).alias("map_name"), F.col(f"citation_patterns.{n}").alias("m")) for n in names])
    rows = structures(spark, sf, "citation_graph").select("spec_id", F.inline(maps))
    return rows.select("spec_id", "map_name", F.explode("m").alias("k", "n"))


def q18b(spark: SparkSession, sf: str) -> DataFrame:
    p = "citation_patterns"
    return structures(spark, sf, "citation_graph").select(
        "spec_id", f"{p}.total_citations", f"{p}.unique_authorities", f"{p}.citation_density", f"{p}.pinpoint_rate"
    )


def q19(spark: SparkSession, sf: str) -> DataFrame:
    rows = structures(spark, sf, "reasoning_patterns").select("spec_id", F.posexplode("reasoning_models").alias("pos", "m"))
    return rows.select(
        "spec_id", "pos", "m.pattern_type", "m.frequency", "m.typical_citation_density", F.size("m.components").alias("n_components")
    )


def _best(specs: DataFrame, argument_type: Column | None) -> DataFrame:
    best = specs.select("spec_id", best_model(F.col("reasoning_models"), argument_type).alias("b")).filter("b IS NOT NULL")
    return best.select("spec_id", "b.pattern_type", "b.frequency", "b.pos")


def q20(spark: SparkSession, sf: str) -> DataFrame:
    return _best(structures(spark, sf, "reasoning_patterns"), None)


def q21(spark: SparkSession, sf: str) -> DataFrame:
    return _best(structures(spark, sf, "reasoning_patterns"), F.lit(ARGUMENT_TYPE))


_OUTLINED = ("argument_sections", "reasoning_patterns")


def q22(spark: SparkSession, sf: str) -> DataFrame:
    rows = suggest_outline(structures(spark, sf, *_OUTLINED)).filter("outline_kind = 'pattern'")
    return rows.select("spec_id", "ord", "component", "description", "pattern_type")


def _fallback(rows: DataFrame) -> DataFrame:
    rows = rows.filter("outline_kind = 'sections'")
    return rows.select(
        "spec_id", "ord", "section_type", "argument_type", _joined(F.col("reasoning_flow")).alias("reasoning_flow"), "expected_citations"
    )


def q23(spark: SparkSession, sf: str) -> DataFrame:
    return _fallback(suggest_outline(structures(spark, sf, *_OUTLINED)))


def q24(spark: SparkSession, sf: str) -> DataFrame:
    return _fallback(suggest_outline(structures(spark, sf, *_OUTLINED), ARGUMENT_TYPE))


def q25(spark: SparkSession, sf: str) -> DataFrame:
    steps = _read(spark, sf, "structure_specs").select(F.explode("reasoning_patterns").alias("p"))
    names = steps.select(F.explode("p.components").alias("component")).filter("component IS NOT NULL").distinct()
    return names.select(
        "component",
        title_case(F.replace(F.col("component"), F.lit("_"), F.lit(" "))).alias("title"),
        component_description(F.col("component")).alias("description"),
    )


def q26(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "events")
    return rows.select("event_id", F.coalesce(F.from_json("props", "k INT")["k"], F.lit(0)).alias("k"))


def _raw(spark: SparkSession, sf: str, spec_kind: str) -> DataFrame:
    files = latest(_read(spark, sf, "spec_files").select("file_id", "spec_kind", "received_at", "raw_json"), "file_id")
    return files.filter(F.col("spec_kind") == spec_kind).select("file_id", F.col("raw_json").alias("value"))


def q27(spark: SparkSession, sf: str) -> DataFrame:
    """Raw files through both loaders: every file with what is wrong with it."""
    formats = parse_format_specs(_raw(spark, sf, "format"), on_error="quarantine").select("file_id", "problem")
    return formats.unionByName(parse_structure_specs(_raw(spark, sf, "structure"), on_error="quarantine").select("file_id", "problem"))


def q28(spark: SparkSession, sf: str) -> DataFrame:
    """What the strict loader reads of the format files that aren't quarantined."""
    rows = parse_format_specs(_raw(spark, sf, "format"), on_error="quarantine").filter("problem IS NULL")
    return rows.select("file_id", "document_count", F.size("headings").alias("n_headings"), F.size("sections").alias("n_sections"))


def q29(spark: SparkSession, sf: str) -> DataFrame:
    """Structure files written as files, one each, and read from their folder."""
    folder = scratch(spark)
    _raw(spark, sf, "structure").filter("file_id IS NOT NULL").write.partitionBy("file_id").text(folder)
    rows = read_structure_specs(spark, f"{folder}/*/*.txt", on_error="quarantine")
    file_id = F.regexp_extract("spec_id", r"/file_id=(-?\d+)/", 1).cast("bigint").alias("file_id")
    return rows.select(file_id, "problem", F.when(F.col("problem").isNull(), F.size("sections")).alias("n_sections"))


def _drift(spark: SparkSession, sf: str) -> SpecDrift:
    return SpecDrift(_read(spark, sf, "spec_files"), _read(spark, sf, "field_catalog"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _drift(spark, sf).changes().select("file_id", "field_path", "change_kind").distinct()


def p1_lifespans(spark: SparkSession, sf: str) -> DataFrame:
    return _drift(spark, sf).lifespans()


def p1_log(spark: SparkSession, sf: str) -> DataFrame:
    return _drift(spark, sf).log()


def p1_aliases(spark: SparkSession, sf: str) -> DataFrame:
    return _drift(spark, sf).aliases()


def p1_format_table(spark: SparkSession, sf: str) -> DataFrame:
    return _drift(spark, sf).table("format")


def p1_structure_table(spark: SparkSession, sf: str) -> DataFrame:
    return _drift(spark, sf).table("structure")


PARTS = {
    "format": ["_export_metadata", "typography", "headings", "sections"],
    "structure": ["_export_metadata", "document_metrics", "argument_sections", "citation_graph", "reasoning_patterns"],
}


def p1_parts_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the consistent tables that have each part; none is renamed here, so that every file that has it must count."""
    drift, out = _drift(spark, sf), []
    for spec_kind, parts in PARTS.items():
        counts = [F.struct(F.lit(p).alias("part"), F.count(p).alias("n_files")) for p in parts]
        out.append(drift.table(spec_kind).agg(F.array(*counts).alias("c")).select(F.lit(spec_kind).alias("spec_kind"), F.inline("c")))
    return out[0].unionByName(out[1])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return parent_child_links(_read(spark, sf, "spec_files"))


def p5_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The whole adjacency table."""
    return adjacency(_read(spark, sf, "spec_files"))


def p5_other_fields(spark: SparkSession, sf: str) -> DataFrame:
    return other_fields(_read(spark, sf, "spec_files"))


def _p5(name: str):  # noqa: ANN202
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return tables(entities(_read(spark, sf, "spec_files")))[name]

    return query


QUERIES = {
    "q01_format_metadata": q01,
    "q02_typography": q02,
    "q03_layout": q03,
    "q04_headings": q04,
    "q05_format_sections": q05,
    "q06_wrapped_tolerance": q06,
    "q07_default_relation": q07,
    "q08_defaults_only": q08,
    "q09_rules_over_defaults": q09,
    "q10_ml_over_defaults": q10,
    "q11_full_cascade": q11,
    "q12_custom_defaults": q12,
    "q13_null_rule_wins": q13,
    "q14_overall_gate": q14,
    "q15_field_gate": q15,
    "q16_structure_metrics": q16,
    "q17_argument_sections": q17,
    "q18_citation_maps": q18,
    "q18b_citation_scalars": q18b,
    "q19_reasoning_models": q19,
    "q20_best_pattern": q20,
    "q21_preferred_pattern": q21,
    "q22_component_outline": q22,
    "q23_section_fallback": q23,
    "q24_filtered_fallback": q24,
    "q25_title_case": q25,
    "q26_events_json_field": q26,
    "q27_quarantined_files": q27,
    "q28_format_files": q28,
    "q29_structure_files_in_a_folder": q29,
    "p1_found": p1_found,
    "p1_lifespans": p1_lifespans,
    "p1_log": p1_log,
    "p1_aliases": p1_aliases,
    "p1_format_table": p1_format_table,
    "p1_structure_table": p1_structure_table,
    "p1_parts_kept": p1_parts_kept,
    "p5_found": p5_found,
    "p5_nodes": p5_nodes,
    "p5_other_fields": p5_other_fields,
} | {
    f"p5_{n}": _p5(n)
    for n in (
        "typography", "typography_fields", "headings", "heading_fields", "sections", "steps", "citation_graph", "citation_counts",
    )
}

# --- SQL ---------------------------------------------------------------------

_LATEST = "SELECT * FROM {0} QUALIFY row_number() OVER (PARTITION BY spec_id ORDER BY received_at DESC) = 1"
_F = f"f AS ({_LATEST.format('format_specs')})"
_S = f"s AS ({_LATEST.format('structure_specs')})"


def _lit(x: object) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE"


def _defaults_sql(defaults: dict) -> str:
    rows = ", ".join(
        f"('{k}', {_lit(v) if isinstance(v, str) else 'NULL'}::VARCHAR, {'NULL' if isinstance(v, str) else _lit(v)}::DOUBLE)"
        for k, v in defaults.items()
    )
    return f"d(key, val_s, val_d) AS (VALUES {rows})"


_RULES = """r AS (SELECT court_code, rule_key AS key,
  CASE WHEN json_type(rule_value::JSON) = 'VARCHAR' THEN json_extract_string(rule_value::JSON, '$') END AS val_s,
  try_cast(rule_value AS DOUBLE) AS val_d FROM page_rules)"""
_T, _L = "typography", "layout"
_GATE = "coalesce(_export_metadata.overall_confidence, 0) > 0"
_ADMITTED = {
    "font_name": f"coalesce({_T}.font_family.value <> '' AND coalesce({_T}.font_family.confidence, 0) >= 0.3, false)",
    "font_size_pt": f"coalesce({_T}.font_size_pt.value <> 0 AND coalesce({_T}.font_size_pt.confidence, 0) >= 0.3, false)",
    "line_spacing": f"coalesce({_T}.line_spacing.value <> 0 AND coalesce({_T}.line_spacing.confidence, 0) >= 0.3, false)",
}
_LAYOUT_SQL = {
    "margin_top": "margin_top_inches",
    "margin_bottom": "margin_bottom_inches",
    "margin_left": "margin_left_inches",
    "margin_right": "margin_right_inches",
    "body_indent": "body_first_line_indent_inches",
    "block_quote_indent": "block_quote_indent_inches",
}
_ML = "m AS (" + " UNION ALL ".join(
    [
        f"SELECT spec_id, 'font_name' AS key, {_T}.font_family.value AS val_s, NULL::DOUBLE AS val_d FROM f WHERE {_GATE} AND {_ADMITTED['font_name']}",
        f"SELECT spec_id, 'font_size_pt', NULL, {_T}.font_size_pt.value FROM f WHERE {_GATE} AND {_ADMITTED['font_size_pt']}",
        f"SELECT spec_id, 'line_spacing', NULL, {_T}.line_spacing.value FROM f WHERE {_GATE} AND {_ADMITTED['line_spacing']}",
    ]
    + [
        f"SELECT spec_id, '{key}', NULL, {_L}.{name}.value FROM f WHERE {_GATE} AND {_L}.{name}.value IS NOT NULL"
        for name, key in _LAYOUT_SQL.items()
    ]
) + ")"


def _cascade_sql(defaults: dict, ml: bool, rules: bool, where: str = "", columns: str = "spec_id, key, val_s, val_d, provenance") -> str:
    tiers = ["SELECT spec_id, key, val_s, val_d, 'default' AS provenance, 0 AS tier FROM f CROSS JOIN d"]
    if ml:
        tiers.append("SELECT spec_id, key, val_s, val_d, 'ml_learned', 1 FROM m")
    if rules:
        tiers.append("SELECT spec_id, key, val_s, val_d, 'rule', 2 FROM f JOIN r USING (court_code)")
    ctes = [_F, _defaults_sql(defaults)] + [_ML] * ml + [_RULES] * rules
    return (
        f"WITH {', '.join(ctes)}, t AS ({' UNION ALL '.join(tiers)}), w AS (SELECT * FROM t "
        f"QUALIFY row_number() OVER (PARTITION BY spec_id, key ORDER BY tier DESC) = 1) SELECT {columns} FROM w {where}"
    )


_MODELS = (
    "m AS (SELECT spec_id, i::INT AS pos, coalesce(reasoning_patterns[i + 1].pattern_type, '') AS pattern_type, "
    "coalesce(reasoning_patterns[i + 1].frequency, 0) AS frequency, coalesce(reasoning_patterns[i + 1].typical_citation_density, 0) AS density, "
    "coalesce(reasoning_patterns[i + 1].components, []) AS components "
    "FROM (SELECT *, unnest(range(len(reasoning_patterns))) AS i FROM s))"
)
_SECTIONS_SQL = (
    "a AS (SELECT spec_id, i::INT AS pos, "
    + ", ".join(
        f"coalesce(argument_sections[i + 1].{c}, '') AS {c}" for c in ("id", "section_type", "argument_type", "standard_of_review")
    )
    + ", array_to_string(list_transform(argument_sections[i + 1].reasoning_flow, lambda x: coalesce(x, '~')), '|') AS flow, "
    + ", ".join(f"coalesce(argument_sections[i + 1].{c}, {d})::INT AS {c}" for c, d in (("citation_count", 0), ("word_count", 0), ("depth", 1)))
    + ", coalesce(len(reasoning_patterns), 0) AS n_models FROM (SELECT *, unnest(range(len(argument_sections))) AS i FROM s))"
)
_TITLE = (
    "array_to_string(list_transform(regexp_extract_all({0}, '[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+|[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+'), "
    "lambda t: upper(t[1]) || lower(t[2:])), '')"
)
_DESCRIBED = "CASE component " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COMPONENT_DESCRIPTIONS.items())
_TITLED = _TITLE.format("replace(component, '_', ' ')")
_DESCRIBED += f" ELSE {_TITLED} END"
_BEST = "b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY spec_id ORDER BY {0}frequency DESC, pos) = 1)"
_PREFER = "CASE WHEN pattern_type = 'rule_application' THEN pos END NULLS LAST, "
_FALLBACK = (
    f"WITH {_S}, {_SECTIONS_SQL} SELECT spec_id, row_number() OVER (PARTITION BY spec_id ORDER BY pos)::INT AS ord, section_type, argument_type, "
    "coalesce(flow, '') AS reasoning_flow, citation_count AS expected_citations FROM a WHERE n_models = 0"
)
_G = "citation_graph"

_FILES = (
    "file AS (SELECT file_id, spec_kind, raw_json::JSON AS j FROM spec_files WHERE json_valid(raw_json) "
    "QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY received_at DESC) = 1)"
)

def _held(x: str) -> str:
    """What a string that holds JSON holds, else the value."""
    inner = f"({x} ->> '$')"
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches({inner}, '^\\s*[\\[{{]') AND json_valid({inner}) THEN {inner}::JSON ELSE {x} END"


def _items(x: str) -> str:
    """Elements of an array, an object alone as an array of one."""
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN json_extract({x}, '$[*]') WHEN 'OBJECT' THEN [{x}] ELSE [] END"


def _int(x: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({x}), '[+-]?\\d+') THEN try_cast({x} AS INT) END"


_HEADINGS_SQL = (
    f"WITH {_FILES}, a AS (SELECT file_id, {_held('(j -> ' + chr(39) + '$.headings' + chr(39) + ')')} AS a FROM file), l AS (SELECT file_id, {_items('a')} AS l FROM a), "
    f"e AS (SELECT file_id, i - 1 AS i, l[i] AS x FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM l)), h AS (SELECT file_id, i, {_held('x')} AS h FROM e) "
    f"SELECT file_id, 'headings[' || i || ']' AS node, '$' AS parent, i::INT AS ordinal, {_int('(h ->> ' + chr(39) + '$.level' + chr(39) + ')')} AS level "
    "FROM h WHERE json_type(h) = 'OBJECT'"
)
# Sections in sections, by levels: an object's sections are opened until none are left.
_SECTION_ROWS = (
    f"WITH RECURSIVE {_FILES}, sec AS (SELECT file_id, NULL::VARCHAR AS node, NULL::VARCHAR AS parent, NULL::BIGINT AS ordinal, j AS s FROM file UNION ALL "
    f"SELECT file_id, node, parent, i, s FROM (SELECT file_id, coalesce(node || '.', '') || 'argument_sections[' || (i - 1) || ']' AS node, coalesce(node, '$') AS parent, "
    f"i - 1 AS i, {_held('l[i]')} AS s FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT file_id, node, {_items('a')} AS l FROM "
    f"(SELECT file_id, node, {_held('(s -> ' + chr(39) + '$.argument_sections' + chr(39) + ')')} AS a FROM sec)))) WHERE json_type(s) = 'OBJECT')"
)
_SECTIONS_FLAT = (
    f"{_SECTION_ROWS} SELECT file_id, node, parent, ordinal::INT AS ordinal, "
    + ", ".join(f"s ->> '$.{c}' AS {c}" for c in ("id", "section_type", "argument_type", "standard_of_review"))
    + ", "
    + ", ".join(f"{_int('(s ->> ' + chr(39) + '$.' + c + chr(39) + ')')} AS {c}" for c in ("citation_count", "word_count", "depth"))
    + " FROM sec WHERE node IS NOT NULL"
)
_STEPS_FLAT = (
    f"{_SECTION_ROWS}, f AS (SELECT file_id, node, {_held('(s -> ' + chr(39) + '$.reasoning_flow' + chr(39) + ')')} AS f FROM sec WHERE node IS NOT NULL), "
    "t AS (SELECT file_id, node, unnest(json_extract(f, '$[*]')) AS x, unnest(range(json_array_length(f)::BIGINT)) AS i FROM f WHERE json_type(f) = 'ARRAY') "
    "SELECT file_id, node || '.reasoning_flow[' || i || ']' AS node, node AS parent, i::INT AS ordinal, x ->> '$' AS step FROM t WHERE json_type(x) <> 'NULL'"
)
_COUNTS_FLAT = (
    f"WITH {_FILES}, g AS (SELECT file_id, {_held('(j -> ' + chr(39) + '$.citation_graph' + chr(39) + ')')} AS g FROM file), m AS ("
    + " UNION ALL ".join(f"SELECT file_id, '{m}' AS map_name, {_held('(g -> ' + chr(39) + '$.' + m + chr(39) + ')')} AS m FROM g" for m in ("by_section", "signal_distribution", "court_distribution"))
    + "), k AS (SELECT file_id, map_name, unnest(map_entries(m::MAP(VARCHAR, JSON))) AS e FROM m WHERE json_type(m) = 'OBJECT') "
    "SELECT file_id, 'citation_graph.' || map_name || '[' || e.key || ']' AS node, 'citation_graph' AS parent, map_name, e.key AS key, "
    f"{_int('(e.value ->> ' + chr(39) + '$' + chr(39) + ')')} AS n FROM k WHERE coalesce(json_type(e.value), 'NULL') <> 'NULL'"
)

def _problem_sql(parts: tuple[list[str], list[str]]) -> str:
    """The first defect of a file, as the strict loaders name it."""
    objects, arrays = parts
    cases = ["WHEN coalesce(json_type(j), '') <> 'OBJECT' THEN 'malformed'"]
    for p in objects:
        cases.append(f"WHEN json_exists(j, '$.{p}') AND json_type(j, '$.{p}') <> 'OBJECT' THEN 'not_an_object:{p}'")
    for p in arrays:
        bad = f"len(list_filter(json_extract(j, '$.{p}[*]'), lambda x: json_type(x) <> 'OBJECT')) > 0"
        cases.append(f"WHEN json_exists(j, '$.{p}') AND (json_type(j, '$.{p}') <> 'ARRAY' OR {bad}) THEN 'not_an_array_of_objects:{p}'")
    return f"CASE {' '.join(cases)} END"


_RAW = (
    "raw AS (SELECT file_id, spec_kind, CASE WHEN json_valid(raw_json) THEN raw_json::JSON END AS j FROM spec_files "
    "QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY received_at DESC) = 1), told AS (SELECT *, CASE spec_kind "
    f"WHEN 'format' THEN {_problem_sql(_FORMAT_PARTS)} ELSE {_problem_sql(_STRUCTURE_PARTS)} END AS problem FROM raw)"
)


def _length(x: str) -> str:
    return f"coalesce(json_array_length(json_extract(j, '$.{x}')), 0)::INT"


SQL = {
    "q27_quarantined_files": f"WITH {_RAW} SELECT file_id, problem FROM told WHERE spec_kind IN ('format', 'structure')",
    "q28_format_files": f"WITH {_RAW} SELECT file_id, coalesce(try_cast(json_extract_string(j, '$._export_metadata.document_count') AS INT), 0) AS document_count, "
    f"{_length('headings')} AS n_headings, {_length('sections')} AS n_sections FROM told WHERE spec_kind = 'format' AND problem IS NULL",
    "q29_structure_files_in_a_folder": f"WITH {_RAW} SELECT file_id, problem, CASE WHEN problem IS NULL THEN {_length('argument_sections')} END AS n_sections "
    "FROM told WHERE spec_kind = 'structure'",
    "p5_headings": _HEADINGS_SQL,
    "p5_sections": _SECTIONS_FLAT,
    "p5_steps": _STEPS_FLAT,
    "p5_citation_counts": _COUNTS_FLAT,
    "p1_parts_kept": f"WITH {_FILES} "
    + " UNION ALL ".join(
        f"SELECT '{k}' AS spec_kind, '{p}' AS part, count(*) FILTER (coalesce(json_type(j, '$.{p}'), 'NULL') <> 'NULL') AS n_files FROM file WHERE spec_kind = '{k}'"
        for k, parts in PARTS.items()
        for p in parts
    ),
    "q01_format_metadata": f"WITH {_F} SELECT spec_id, coalesce(_export_metadata.document_count, 0)::INT AS document_count, "
    "coalesce(_export_metadata.overall_confidence, 0)::DOUBLE AS overall_confidence FROM f",
    "q02_typography": f"WITH {_F} SELECT spec_id, {_T}.font_family.value AS font_family, coalesce({_T}.font_family.confidence, 0)::DOUBLE AS font_family_confidence, "
    f"{_T}.font_size_pt.value AS font_size_pt, coalesce({_T}.font_size_pt.confidence, 0)::DOUBLE AS font_size_confidence, "
    f"{_T}.line_spacing.value AS line_spacing, coalesce({_T}.line_spacing.confidence, 0)::DOUBLE AS line_spacing_confidence FROM f",
    "q03_layout": f"WITH {_F} SELECT spec_id, {', '.join(f'{_L}.{c}.value AS {c}' for c in _LAYOUT_SQL)} FROM f",
    "q04_headings": f"WITH {_F}, h AS (SELECT spec_id, i, headings[i + 1] AS h FROM (SELECT *, unnest(range(len(headings))) AS i FROM f)) "
    "SELECT spec_id, i::INT AS pos, coalesce(h.level, 1)::INT AS level, h.case_style.value AS case_style, h.alignment.value AS alignment, "
    "h.bold.value AS bold, h.font_size_pt.value AS font_size_pt, h.numbering.value AS numbering FROM h",
    "q05_format_sections": f"WITH {_F}, h AS (SELECT spec_id, i, sections[i + 1] AS h FROM (SELECT *, unnest(range(len(sections))) AS i FROM f)) "
    "SELECT spec_id, i::INT AS pos, coalesce(h.id, '') AS id, coalesce(h.frequency, 0)::DOUBLE AS frequency, coalesce(h.median_order, 0)::INT AS median_order FROM h",
    "q06_wrapped_tolerance": f"WITH {_F} SELECT spec_id, NULL::VARCHAR AS font_family, 0::DOUBLE AS font_family_confidence, {_T}.line_spacing.value AS line_spacing, "
    f"coalesce({_T}.line_spacing.confidence, 0)::DOUBLE AS line_spacing_confidence FROM f",
    "q07_default_relation": f"WITH {_defaults_sql(BUILT_IN_DEFAULTS)} SELECT * FROM d",
    "q08_defaults_only": _cascade_sql(BUILT_IN_DEFAULTS, False, False),
    "q09_rules_over_defaults": _cascade_sql(BUILT_IN_DEFAULTS, False, True),
    "q10_ml_over_defaults": _cascade_sql(BUILT_IN_DEFAULTS, True, False),
    "q11_full_cascade": _cascade_sql(BUILT_IN_DEFAULTS, True, True),
    "q12_custom_defaults": _cascade_sql(CUSTOM_DEFAULTS, True, True),
    "q13_null_rule_wins": _cascade_sql(BUILT_IN_DEFAULTS, True, True, "WHERE val_s IS NULL AND val_d IS NULL", "spec_id, key, val_s, provenance"),
    "q14_overall_gate": f"WITH {_F}, {_ML} SELECT spec_id, count(m.key)::INT AS n_ml_keys FROM f LEFT JOIN m USING (spec_id) GROUP BY spec_id",
    "q15_field_gate": f"WITH {_F} " + " UNION ALL ".join(f"SELECT spec_id, '{k}' AS key, {e} AS admitted FROM f" for k, e in _ADMITTED.items()),
    "q16_structure_metrics": f"WITH {_S} SELECT spec_id, coalesce(_export_metadata.document_type, '') AS document_type, "
    + ", ".join(f"coalesce(document_metrics.{c}, 0)::INT AS {c}" for c in ("total_word_count", "total_sections", "total_arguments"))
    + ", coalesce(document_metrics.argument_to_total_ratio, 0)::DOUBLE AS argument_to_total_ratio FROM s",
    "q17_argument_sections": f"WITH {_S}, {_SECTIONS_SQL} SELECT spec_id, pos, id, section_type, argument_type, standard_of_review, "
    "coalesce(flow, '') AS reasoning_flow, citation_count, word_count, depth FROM a",
    "q18_citation_maps": f"WITH {_S} SELECT spec_id, map_name, e.key AS k, e.value AS n FROM ("
    + " UNION ALL ".join(
        f"SELECT spec_id, '{c}' AS map_name, unnest(map_entries({_G}.{c})) AS e FROM s" for c in ("by_section", "signal_distribution", "court_distribution")
    )
    + ")",
    "q18b_citation_scalars": f"WITH {_S} SELECT spec_id, coalesce({_G}.total_citations, 0)::INT AS total_citations, coalesce({_G}.unique_authorities, 0)::INT AS unique_authorities, "
    f"coalesce({_G}.citation_density, 0)::DOUBLE AS citation_density, coalesce({_G}.pinpoint_rate, 0)::DOUBLE AS pinpoint_rate FROM s",
    "q19_reasoning_models": f"WITH {_S}, {_MODELS} SELECT spec_id, pos, pattern_type, frequency, density AS typical_citation_density, len(components)::INT AS n_components FROM m",
    "q20_best_pattern": f"WITH {_S}, {_MODELS}, {_BEST.format('')} SELECT spec_id, pattern_type, frequency, pos FROM b",
    "q21_preferred_pattern": f"WITH {_S}, {_MODELS}, {_BEST.format(_PREFER)} SELECT spec_id, pattern_type, frequency, pos FROM b",
    "q22_component_outline": f"WITH {_S}, {_MODELS}, {_BEST.format('')}, c AS (SELECT spec_id, pattern_type, components, unnest(range(len(components))) AS i FROM b), "
    f"n AS (SELECT spec_id, (i + 1)::INT AS ord, components[i + 1] AS component, pattern_type FROM c) SELECT spec_id, ord, component, "
    f"CASE WHEN component IS NOT NULL THEN {_DESCRIBED} END AS description, pattern_type FROM n",
    "q23_section_fallback": _FALLBACK,
    "q24_filtered_fallback": _FALLBACK + f" AND (argument_type = '{ARGUMENT_TYPE}' OR section_type IN ('main_argument', 'sub_argument'))",
    "q25_title_case": "WITH n AS (SELECT DISTINCT unnest(p.components) AS component FROM (SELECT unnest(reasoning_patterns) AS p FROM structure_specs)) "
    f"SELECT component, {_TITLED} AS title, {_DESCRIBED} AS description FROM n WHERE component IS NOT NULL",
    "q26_events_json_field": "SELECT event_id, coalesce(json_extract_string(props, '$.k')::INT, 0) AS k FROM events",
}
