import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from payloads import pattern, section, structure_doc
from pyspark.sql import functions as F

from folioweave import parse_structure_specs, suggest_outline
from folioweave.functions.text import component_description, title_case


def outline(spark, doc, argument_type=None):
    df = spark.createDataFrame([("x", json.dumps(doc))], "spec_id STRING, value STRING")
    return suggest_outline(parse_structure_specs(df), argument_type).orderBy("ord").collect()


@pytest.mark.parametrize("argument_type", [None, "", "laches"])
def test_basic(spark, argument_type):
    rows = outline(spark, structure_doc(), argument_type)
    assert [(r.ord, r.component) for r in rows] == [(1, "rule_statement"), (2, "exception"), (3, "analysis"), (4, "fact_application"), (5, "conclusion")]
    assert all(r.description and r.pattern_type == "rule_application" and r.outline_kind == "pattern" for r in rows)


def test_ties_nan_and_null(spark):
    pick = lambda *fs: outline(spark, structure_doc(reasoning_patterns=[pattern(str(i), ["c"], f) for i, f in enumerate(fs)]))[0].pattern_type
    assert pick(0.5, 0.5) == "0" and pick(0.1, 0.5, 0.5) == "1"
    assert pick(math.nan, 0.9) == "0" and pick(0.2, math.nan) == "0"
    assert pick(None, 0.0) == "0" and pick(None, 0.1) == "1"


def test_preferred_pattern(spark):
    doc = structure_doc(reasoning_patterns=[pattern("a", ["x"], 0.9), pattern("rule_application", ["y"], 0.1), pattern("rule_application", ["z"], 0.8)])
    assert outline(spark, doc)[0].component == "x"
    assert outline(spark, doc, "anything")[0].component == "y"


def test_empty_components_give_no_fallback(spark):
    assert outline(spark, structure_doc(reasoning_patterns=[pattern("a", [], 0.9)])) == []


def test_section_fallback(spark):
    doc = structure_doc(reasoning_patterns=[])
    assert [(r.ord, r.section_type, r.expected_citations) for r in outline(spark, doc)] == [
        (1, "main_argument", 7), (2, "factual_background", 0), (3, "sub_argument", 3),
    ]
    doc["argument_sections"] = [section("x", "other"), section("x", "wanted"), section("main_argument", "other")]
    assert [(r.ord, r.argument_type) for r in outline(spark, doc, "wanted")] == [(1, "wanted"), (2, "other")]
    doc["argument_sections"] = [section("x", "other")]
    assert outline(spark, doc, "wanted") == []


def test_type_by_column(spark):
    doc = json.dumps(structure_doc(reasoning_patterns=[], argument_sections=[section("x", "a"), section("x", "b")]))
    df = spark.createDataFrame([(1, "a", doc), (2, "b", doc), (3, None, doc)], "spec_id INT, wanted STRING, value STRING")
    rows = suggest_outline(parse_structure_specs(df), F.col("wanted")).collect()
    assert sorted((r.spec_id, r.argument_type) for r in rows) == [(1, "a"), (2, "b"), (3, "a"), (3, "b")]


def test_descriptions(spark):
    df = spark.createDataFrame([("policy_argument",), ("o'neil_3rd_test",), ("conclusion",), (None,)], "c STRING")
    assert [r[0] for r in df.select(component_description(F.col("c"))).collect()] == [
        "Policy Argument", "O'Neil 3Rd Test", "State the conclusion that follows", None,
    ]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abzÄé9 _'-中Zß\t", max_size=12), min_size=40, max_size=60))
def test_title_case_as_python(spark, words):
    words = [w for w in words if "ß" not in w]  # one sharp s has no capital of its own
    df = spark.createDataFrame([(w,) for w in words] or [("",)], "c STRING")
    assert [r[0] for r in df.select(title_case(F.col("c"))).collect()] == [w.title() for w in words] or not words
