"""Representative documents of both families."""


def wrapped(value, confidence=0.88):
    return {"value": value, "confidence": confidence, "sample_count": 9, "agreement": 0.75}


def format_doc(**changes):
    doc = {
        "_export_metadata": {"exported_at": "2025-06-30T09:15:00Z", "engine_version": "3.4", "document_count": 41, "overall_confidence": 0.58, "governance": "layout group"},
        "typography": {"font_family": wrapped("Garamond", 0.77), "font_size_pt": wrapped(11.5, 0.64), "line_spacing": wrapped(1.15)},
        "layout": {"margin_top": wrapped(0.9), "margin_bottom": wrapped(0.8), "margin_left": wrapped(1.4), "margin_right": wrapped(1.1)},
        "headings": [
            {"level": 1, "case_style": wrapped("small_caps"), "alignment": wrapped("right"), "bold": wrapped(False)},
            {"level": 3, "case_style": wrapped("sentence"), "alignment": wrapped("justify"), "bold": wrapped(True)},
        ],
        "sections": [{"id": "cover", "frequency": 0.91, "median_order": 1}, {"id": "docket_history", "frequency": 0.4, "median_order": 4}, {"id": "prayer", "frequency": 0.85, "median_order": 9}],
    }
    return doc | changes


def structure_doc(**changes):
    doc = {
        "_export_metadata": {"document_type": "reply_memorandum", "engine_version": "3.4"},
        "document_metrics": {"total_word_count": 3120, "total_page_count": 12, "total_sections": 5, "total_arguments": 2, "argument_to_total_ratio": 0.48},
        "argument_sections": [
            section("main_argument", "riparian_rights", ["issue_statement", "rule_statement", "analogy", "conclusion"], citation_count=7),
            section("factual_background", "", [], citation_count=0),
            section("sub_argument", "laches", ["counterargument", "rebuttal"], citation_count=3),
        ],
        "citation_graph": {
            "total_citations": 22,
            "unique_authorities": 17,
            "citation_density": 2.6,
            "by_section": {"main_argument": 15, "sub_argument": 7},
            "signal_distribution": {"cf.": 5, "accord": 2, "but see": 4},
            "court_distribution": {"Mill Ct.": 12, "Harbor App.": 10},
            "pinpoint_rate": 0.39,
        },
        "reasoning_patterns": [
            pattern("analogical", ["issue_statement", "analogy", "distinction"], 0.21),
            pattern("rule_application", ["rule_statement", "exception", "analysis", "fact_application", "conclusion"], 0.55),
        ],
    }
    return doc | changes


def section(section_type, argument_type="", flow=(), **more):
    return {
        "id": "part", "section_type": section_type, "argument_type": argument_type, "standard_of_review": "plain_error",
        "reasoning_flow": list(flow), "citation_count": 0, "word_count": 240, "depth": 1,
    } | more


def pattern(pattern_type, components=(), frequency=0.5):
    return {"pattern_type": pattern_type, "components": list(components), "frequency": frequency, "typical_citation_density": 1.3}
