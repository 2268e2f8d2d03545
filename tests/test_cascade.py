import json
import math

import pytest
from payloads import format_doc, wrapped
from pyspark.sql import functions as F

from folioweave import built_in_defaults, parse_format_specs, resolve, rules_from_dicts, rules_from_json, to_wide
from folioweave.functions.text import json_scalar
from folioweave.operators.cascade import resolve_by_union, truthy, value_text


def specs(spark, *docs, sets=None):
    rows = [(i, (sets or [None] * len(docs))[i], json.dumps(d)) for i, d in enumerate(docs)]
    return parse_format_specs(spark.createDataFrame(rows, "spec_id INT, rule_set STRING, value STRING"))


def rules(spark, rows):
    """(set, key, JSON scalar) rows as a relation of rules."""
    df = spark.createDataFrame([(s, k, None if v is None else json.dumps(v)) for s, k, v in rows], "rule_set STRING, key STRING, v STRING")
    return df.select("rule_set", "key", json_scalar(F.col("v")).alias("val"))


def found(df, spec=0):
    out = {}
    for r in df.filter(F.col("spec_id") == spec).collect():
        v = r.val
        out[r.key] = ({"string": v.s, "number": v.d, "boolean": v.b, "null": None}[v.type], r.provenance)
    return out


def test_defaults_only(spark):
    got = found(resolve(specs(spark, format_doc()), learned=False))
    assert len(got) == 11 and got["font_name"] == ("Times New Roman", "default") and got["page_height_inches"] == (11.0, "default")
    assert built_in_defaults(spark).count() == 11


def test_rules_override_defaults(spark):
    r = rules(spark, [("a", "font_name", "Courier New"), ("a", "font_size_pt", 12.0)])
    got = found(resolve(specs(spark, format_doc(), sets=["a"]), r, learned=False))
    assert got["font_name"] == ("Courier New", "rule") and got["font_size_pt"] == (12.0, "rule") and got["line_spacing"] == (2.0, "default")


def test_learned_override_defaults(spark):
    got = found(resolve(specs(spark, format_doc())))
    assert got["margin_left_inches"] == (1.4, "ml_learned") and got["page_width_inches"] == (8.5, "default")


def test_all_three_tiers(spark):
    r = rules(spark, [("a", "font_size_pt", 12.0)])
    got = found(resolve(specs(spark, format_doc(), sets=["a"]), r))
    assert got["font_size_pt"] == (12.0, "rule")
    assert got["font_name"] == ("Garamond", "ml_learned")
    assert got["block_quote_indent_inches"] == (0.5, "default")
    assert "headings" not in got and "document_count" not in got


@pytest.mark.parametrize(("confidence", "admitted"), [(0.3, True), (0.29, False), (None, False), (math.nan, False)])
def test_field_gate(spark, confidence, admitted):
    typography = {"font_family": wrapped("Book Antiqua", confidence)}
    got = found(resolve(specs(spark, format_doc(typography=typography))))
    assert got["font_name"] == (("Book Antiqua", "ml_learned") if admitted else ("Times New Roman", "default"))


def test_falsy_typography_is_refused_but_zero_margin_applies(spark):
    typography = {"font_family": wrapped("", 1.0), "font_size_pt": wrapped(0, 1.0)}
    got = found(resolve(specs(spark, format_doc(typography=typography, layout={"margin_top": wrapped(0.0, 0.0)}))))
    assert got["font_name"][1] == "default" and got["font_size_pt"] == (13.0, "default")
    assert got["margin_top_inches"] == (0.0, "ml_learned")


@pytest.mark.parametrize("overall", [0.0, None, math.nan, -1.0])
def test_overall_gate_shuts_layout_too(spark, overall):
    doc = format_doc(_export_metadata={"overall_confidence": overall})
    assert {p for _, p in found(resolve(specs(spark, doc))).values()} == {"default"}


def test_null_rule_wins_and_unknown_keys_are_added(spark):
    r = rules(spark, [("a", "line_spacing", None), ("a", "gutter_inches", 0.1), ("a", "font_family", "X"), ("b", "font_name", "Y"), (None, "font_name", "Z")])
    got = found(resolve(specs(spark, format_doc(), sets=["a"]), r))
    assert got["line_spacing"] == (None, "rule") and got["gutter_inches"] == (0.1, "rule")
    assert got["font_family"] == ("X", "rule") and got["font_name"] == ("Garamond", "ml_learned")
    without = found(resolve(specs(spark, format_doc(), sets=[None]), r))
    assert "gutter_inches" not in without and without["font_name"][1] == "ml_learned"


def test_custom_defaults(spark):
    one = specs(spark, format_doc())
    assert len(found(resolve(one, defaults={}, learned=False))) == 11
    got = found(resolve(one, defaults={"a": None, "b": True, "c": 1}))
    assert got["a"] == (None, "default") and got["b"] == (True, "default") and got["c"] == (1.0, "default")
    assert got["font_name"][1] == "ml_learned" and "page_width_inches" not in got


def test_reserved_key(spark):
    with pytest.raises(ValueError, match="reserved"):
        resolve(specs(spark, format_doc()), defaults={"_provenance": 1})
    with pytest.raises(Exception, match="reserved"):
        resolve(specs(spark, format_doc(), sets=["a"]), rules(spark, [("a", "_provenance", 1)])).collect()


def test_union_form_is_equal(spark):
    docs = [format_doc(), format_doc(layout={}), format_doc(_export_metadata={}), {}]
    s = specs(spark, *docs, sets=["a", "b", None, "a"])
    r = rules(spark, [("a", "line_spacing", None), ("a", "x", True), ("b", "font_name", "Y"), ("b", "font_name", "X"), ("b", None, 1)])
    flat = lambda df: sorted(map(str, df.select("spec_id", "key", "val", "provenance").collect()))
    assert flat(resolve(s, r)) == flat(resolve_by_union(s, r))


def test_wide_repeated_empty_and_clashing(spark):
    s = specs(spark, format_doc())
    wide = to_wide(resolve(s)).first()
    assert wide["values"]["font_name"] == "Garamond" and wide["_provenance"]["page_width_inches"] == "default"
    assert resolve(s.unionAll(s)).count() == 2 * resolve(s).count()
    assert resolve(s.limit(0)).count() == 0
    assert resolve(s.withColumn("key", F.lit(1)).withColumn("_rules", F.lit(2))).count() == resolve(s).count()
    assert resolve(s).filter(value_text(F.col("val")).isNull()).count() == 0


def test_rules_as_the_caller_holds_them(spark):
    r = rules_from_dicts(spark, {"a": {"page_format": {"font_name": "Caslon", "columns": [1, "x"], "gutter": {"in": 0.5}, "line_spacing": None, "double_sided": True, "n": "12"}, "other": 1}, "b": {}})
    rows = {x.key: x for x in resolve(specs(spark, format_doc(), sets=["a"]), r).collect()}
    assert (rows["columns"].val.type, json.loads(rows["columns"].val.s)) == ("array", [1, "x"])
    assert (rows["gutter"].val.type, json.loads(rows["gutter"].val.s)) == ("object", {"in": 0.5})
    assert rows["line_spacing"].val.type == "null" and rows["double_sided"].val.b is True and rows["n"].val.s == "12" and rows["font_name"].provenance == "rule"
    assert resolve(specs(spark, format_doc(), sets=["b"]), r).filter("provenance = 'rule'").count() == 0
    with pytest.raises(Exception, match="reserved"):
        resolve(specs(spark, format_doc(), sets=["a"]), rules_from_dicts(spark, {"a": {"page_format": {"_provenance": 1}}})).collect()


def test_the_last_of_repeated_rules_counts(spark):
    texts = [("a", '{"page_format": {"x": 9, "y": 1, "x": 2}}'), ("a", None), ("b", "{"), ("c", '{"page_format": null}')]
    r = rules_from_json(spark.createDataFrame(texts, "rule_set STRING, value STRING"))
    assert found(resolve(specs(spark, format_doc(), sets=["a"]), r))["x"] == (2.0, "rule") and {x.rule_set for x in r.collect()} == {"a"}


def test_typed_values(spark):
    wide = to_wide(resolve(specs(spark, format_doc()), defaults={"a": 1.0, "tags": ["x"], "empty": {}})).first()
    assert (wide.typed["a"].type, wide.typed["a"].d) == ("number", 1.0) and json.loads(wide.typed["tags"].s) == ["x"]
    df = resolve(specs(spark, format_doc()), defaults={"tags": ["x"], "empty": {}}, learned=False)
    assert {r.key: r.t for r in df.select("key", truthy(F.col("val")).alias("t")).collect()} == {"tags": True, "empty": False}
