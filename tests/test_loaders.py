import json

import pytest
from payloads import format_doc, structure_doc, wrapped
from pyspark.sql import functions as F

from folioweave import parse_format_specs, parse_structure_specs, read_format_specs, read_structure_specs


def formats(spark, *docs, on_error="tolerate"):
    rows = [(i, d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(docs)]
    return parse_format_specs(spark.createDataFrame(rows, "spec_id INT, value STRING"), on_error=on_error).orderBy("spec_id").collect()


def structures(spark, *docs, on_error="tolerate"):
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)]
    return parse_structure_specs(spark.createDataFrame(rows, "spec_id INT, value STRING"), on_error=on_error).orderBy("spec_id").collect()


def test_format_basic(spark):
    (r,) = formats(spark, format_doc())
    assert (r.document_count, r.overall_confidence) == (41, 0.58)
    assert (r.typography.font_family, r.typography.font_size_pt, r.typography.line_spacing) == ("Garamond", 11.5, 1.15)
    assert r.typography.font_size_confidence == 0.64
    assert (r.layout.margin_top, r.layout.margin_left, r.layout.body_indent) == (0.9, 1.4, None)
    assert [(h.level, h.case_style, h.bold) for h in r.headings] == [(1, "small_caps", False), (3, "sentence", True)]
    assert [s.id for s in r.sections] == ["cover", "docket_history", "prayer"]
    assert r.sections[1].frequency == 0.4


def test_no_content_bearing_fields(spark):
    df = parse_format_specs(spark.createDataFrame([("{}",)], "value STRING"))
    df2 = parse_structure_specs(spark.createDataFrame([("{}",)], "value STRING"))
    for name in ("text", "content", "body", "raw"):
        assert name not in json.dumps([df.schema.jsonValue(), df2.schema.jsonValue()]).replace("body_indent", "")


def test_structure_basic(spark):
    (r,) = structures(spark, structure_doc())
    assert (r.document_type, r.total_word_count, r.total_arguments) == ("reply_memorandum", 3120, 2)
    assert len(r.sections) == 3 and r.sections[0].reasoning_flow == ["issue_statement", "rule_statement", "analogy", "conclusion"]
    c = r.citation_patterns
    assert (c.total_citations, c.unique_authorities, c.citation_density, c.pinpoint_rate) == (22, 17, 2.6, 0.39)
    assert c.signal_distribution["accord"] == 2 and c.court_distribution["Mill Ct."] == 12
    assert len(r.reasoning_models) == 2 and r.reasoning_models[1].frequency == 0.55


def test_missing_parts_have_defaults(spark):
    (r,) = formats(spark, {})
    assert (r.document_count, r.overall_confidence, r.headings, r.sections) == (0, 0.0, [], [])
    assert r.typography.font_family is None and r.typography.font_family_confidence == 0.0
    (r,) = structures(spark, {"argument_sections": [{}], "reasoning_patterns": [{}]})
    assert (r.sections[0].depth, r.sections[0].section_type, r.sections[0].reasoning_flow) == (1, "", [])
    assert (r.reasoning_models[0].frequency, r.reasoning_models[0].components) == (0.0, [])
    assert r.citation_patterns.by_section == {}


def test_bare_scalar_and_partly_wrapped_values(spark):
    typography = {"font_family": "Arial", "font_size_pt": {"value": 12}, "line_spacing": {"confidence": 0.5}}
    (r,) = formats(spark, format_doc(typography=typography))
    t = r.typography
    assert (t.font_family, t.font_family_confidence) == (None, 0.0)
    assert (t.font_size_pt, t.font_size_confidence) == (12.0, 0.0)
    assert (t.line_spacing, t.line_spacing_confidence) == (None, 0.5)
    assert r.layout.margin_left == 1.4


def test_headings_keep_size_and_numbering(spark):
    (r,) = formats(spark, format_doc(headings=[{"font_size_pt": wrapped(14.0), "numbering": wrapped("roman")}]))
    assert (r.headings[0].level, r.headings[0].font_size_pt, r.headings[0].numbering) == (1, 14.0, "roman")


def test_nan_and_repeated_keys(spark):
    text = '{"_export_metadata": {"document_count": 1, "document_count": 2, "overall_confidence": NaN}}'
    (r,) = formats(spark, text)
    assert r.document_count == 2 and r.overall_confidence != r.overall_confidence


BROKEN = {
    "not json": ('{"layout": {', "malformed"),
    "top-level array": ("[{}]", "malformed"),
    "null section": ('{"layout": null}', "not_an_object:layout"),
    "null array": ('{"headings": null}', "not_an_array_of_objects:headings"),
    "element that only holds JSON": ('{"headings": [{"level": 1}, "{\\"level\\": 2}"]}', "not_an_array_of_objects:headings"),
    "section that only holds JSON": ('{"layout": "{}"}', "not_an_object:layout"),
    "null element": ('{"sections": [{}, null]}', "not_an_array_of_objects:sections"),
    "scalar element": ('{"headings": [1]}', "not_an_array_of_objects:headings"),
}


@pytest.mark.parametrize("case", BROKEN)
def test_broken_documents(spark, case):
    text, problem = BROKEN[case]
    bad, good = formats(spark, text, format_doc(), on_error="quarantine")
    assert (bad.problem, good.problem) == (problem, None)
    assert good.document_count == 41
    with pytest.raises(Exception, match=problem.split(":")[0]):
        formats(spark, text, on_error="fail")
    assert formats(spark, text)[0].document_count == 0


def test_null_and_empty_text(spark):
    rows = formats(spark, None, "", on_error="quarantine")
    assert [r.problem for r in rows] == ["malformed", "malformed"]


def test_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.json").write_text(json.dumps(format_doc(), indent=2))
    rows = read_format_specs(spark, tmp_path).collect()
    assert len({r.spec_id for r in rows}) == 3 and {r.document_count for r in rows} == {41}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text(json.dumps(structure_doc()))
    assert read_structure_specs(spark, str(tmp_path / "s")).first().total_sections == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_format_specs(spark, tmp_path / "none").collect()


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "{}", "mine", 7)], "spec_id INT, value STRING, layout STRING, extra INT")
    out = parse_format_specs(df)
    assert out.columns.count("layout") == 1 and out.first().extra == 7
    assert parse_structure_specs(df.limit(0)).count() == 0


def test_unknown_mode(spark):
    with pytest.raises(ValueError, match="on_error"):
        parse_format_specs(spark.range(1).select(F.lit("{}").alias("value")), on_error="no")


def test_stream(spark, tmp_path):
    from folioweave.streaming.specs import stream_specs

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(format_doc()))
    (tmp_path / "in" / "b.json").write_text("{")
    stream = stream_specs(spark, tmp_path / "in", "format").select("document_count", "problem")
    query = stream.writeStream.format("memory").queryName("specs").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("specs").collect()} == {(41, None), (0, "malformed")}
