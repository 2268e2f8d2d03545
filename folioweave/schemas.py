"""Read schemas of the two spec families and the constant relations."""

from __future__ import annotations

FORMAT_SCHEMA = """
  _export_metadata STRUCT<document_count: INT, overall_confidence: DOUBLE>,
  typography STRUCT<font_family:  STRUCT<value: STRING, confidence: DOUBLE>,
                    font_size_pt: STRUCT<value: DOUBLE, confidence: DOUBLE>,
                    line_spacing: STRUCT<value: DOUBLE, confidence: DOUBLE>>,
  layout STRUCT<margin_top: STRUCT<value: DOUBLE>, margin_bottom: STRUCT<value: DOUBLE>,
                margin_left: STRUCT<value: DOUBLE>, margin_right: STRUCT<value: DOUBLE>,
                body_indent: STRUCT<value: DOUBLE>, block_quote_indent: STRUCT<value: DOUBLE>>,
  headings ARRAY<STRUCT<level: INT, case_style: STRUCT<value: STRING>, alignment: STRUCT<value: STRING>,
                        bold: STRUCT<value: BOOLEAN>, font_size_pt: STRUCT<value: DOUBLE>,
                        numbering: STRUCT<value: STRING>>>,
  sections ARRAY<STRUCT<id: STRING, frequency: DOUBLE, median_order: INT>>
"""

STRUCTURE_SCHEMA = """
  _export_metadata STRUCT<document_type: STRING>,
  document_metrics STRUCT<total_word_count: INT, total_sections: INT, total_arguments: INT,
                          argument_to_total_ratio: DOUBLE>,
  argument_sections ARRAY<STRUCT<id: STRING, section_type: STRING, argument_type: STRING,
                                 standard_of_review: STRING, reasoning_flow: ARRAY<STRING>,
                                 citation_count: INT, word_count: INT, depth: INT>>,
  citation_graph STRUCT<total_citations: INT, unique_authorities: INT, citation_density: DOUBLE,
                        by_section: MAP<STRING, INT>, signal_distribution: MAP<STRING, INT>,
                        court_distribution: MAP<STRING, INT>, pinpoint_rate: DOUBLE>,
  reasoning_patterns ARRAY<STRUCT<pattern_type: STRING, components: ARRAY<STRING>, frequency: DOUBLE,
                                  typical_citation_density: DOUBLE>>
"""

#: A scalar of an open-keyed relation; ``type`` is string, number, boolean or null.
VALUE_TYPE = "STRUCT<type: STRING, s: STRING, d: DOUBLE, b: BOOLEAN>"
ENTRY_TYPE = f"STRUCT<key: STRING, val: {VALUE_TYPE}, provenance: STRING>"

#: Key of the wide result that holds the provenance of the others.
RESERVED_KEY = "_provenance"

# The defaults tier.
BUILT_IN_DEFAULTS = {
    "font_name": "Times New Roman",
    "font_size_pt": 13.0,
    "line_spacing": 2.0,
    "margin_top_inches": 1.0,
    "margin_bottom_inches": 1.0,
    "margin_left_inches": 1.0,
    "margin_right_inches": 1.0,
    "body_first_line_indent_inches": 0.5,
    "block_quote_indent_inches": 0.5,
    "page_width_inches": 8.5,
    "page_height_inches": 11.0,
}

# The least confidence that admits a learned typography value.
MIN_CONFIDENCE = 0.3

# Result key of each learned typography and layout field.
TYPOGRAPHY_KEYS = [
    ("font_family", "font_family_confidence", "font_name"),
    ("font_size_pt", "font_size_confidence", "font_size_pt"),
    ("line_spacing", "line_spacing_confidence", "line_spacing"),
]
LAYOUT_KEYS = {
    "margin_top": "margin_top_inches",
    "margin_bottom": "margin_bottom_inches",
    "margin_left": "margin_left_inches",
    "margin_right": "margin_right_inches",
    "body_indent": "body_first_line_indent_inches",
    "block_quote_indent": "block_quote_indent_inches",
}

# Descriptions of the known reasoning components.
COMPONENT_DESCRIPTIONS = {
    "standard_of_review": "State the applicable standard of review",
    "rule_statement": "State the governing legal rule with authority",
    "rule_explanation": "Explain how courts have applied the rule",
    "fact_application": "Apply the rule to the facts of this case",
    "conclusion": "State the conclusion that follows",
    "transition": "Transition to the next point",
    "analysis": "Develop the analytical argument",
    "issue_statement": "Frame the issue for the court",
}

# The preferred pattern and the sections any argument type keeps.
PREFERRED_PATTERN = "rule_application"
ALWAYS_KEPT_SECTIONS = ["main_argument", "sub_argument"]
