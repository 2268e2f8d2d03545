import json
from datetime import datetime

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from payloads import format_doc, pattern, section, structure_doc, wrapped

from folioweave import shred
from folioweave.operators.shred import adjacency, nodes, other_fields, parent_child_links, rebuilt


def files(spark, *docs):
    rows = [(i, datetime(2025, 1, 1), d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in docs]
    return spark.createDataFrame(rows, "file_id BIGINT, received_at TIMESTAMP, raw_json STRING")


def links(spark, *docs):
    return {(r.file_id, r.parent_path, r.child_path) for r in parent_child_links(files(spark, *docs)).collect()}


def test_links_of_all_parts(spark):
    doc = {
        "typography": {"font_family": "Arial", "font_size_pt": wrapped(12), "line_spacing": None, "other": 1},
        "headings": [None, {"level": 1, "bold": wrapped(True), "alignment": None}],
        "argument_sections": [section("a", flow=["x", None, ""], argument_sections=[section("b", flow=["y"])])],
        "citation_graph": {"by_section": {"a.b": 0, "c": None}, "signal_distribution": {}, "court_distribution": None},
        "sections": [{"id": "no"}],
    }
    got = {(p, c) for _, p, c in links(spark, (1, doc))}
    s = "argument_sections[0]"
    assert got == {
        ("$", "typography"), ("typography", "typography.font_family"), ("typography", "typography.font_size_pt"),
        ("$", "headings[1]"), ("headings[1]", "headings[1].bold"),
        ("$", s), (s, f"{s}.reasoning_flow[0]"), (s, f"{s}.reasoning_flow[2]"),
        (s, f"{s}.argument_sections[0]"), (f"{s}.argument_sections[0]", f"{s}.argument_sections[0].reasoning_flow[0]"),
        ("$", "citation_graph"), ("citation_graph", "citation_graph.by_section[a.b]"),
    }


def test_other_shapes(spark):
    one = {"headings": {"level": 1}, "argument_sections": json.dumps([section("a"), json.dumps(section("b"))]), "typography": json.dumps({"font_family": "x"})}
    two = {"headings": json.dumps({"level": 1}), "argument_sections": section("a"), "typography": "Arial 12", "citation_graph": json.dumps({"by_section": {"k": 1}})}
    three = {"headings": [json.dumps({"bold": True}), 3, "x", [1]], "argument_sections": [None, section("a", reasoning_flow=None)], "citation_graph": []}
    got = links(spark, (1, one), (2, two), (3, three))
    assert {(i, c) for i, _, c in got} == {
        (1, "headings[0]"), (1, "argument_sections[0]"), (1, "argument_sections[1]"), (1, "typography"), (1, "typography.font_family"),
        (2, "headings[0]"), (2, "argument_sections[0]"), (2, "citation_graph"), (2, "citation_graph.by_section[k]"),
        (3, "headings[0]"), (3, "headings[0].bold"), (3, "argument_sections[1]"),
    }


def test_flat_tables(spark):
    doc = format_doc() | structure_doc(reasoning_patterns=[pattern("x")])
    t = {n: df.collect() for n, df in shred(files(spark, (7, doc))).items()}
    assert {n: len(rows) for n, rows in t.items()} == {
        "typography": 1, "typography_fields": 3, "headings": 2, "heading_fields": 6, "sections": 3, "steps": 6, "citation_graph": 1, "citation_counts": 7,
    }
    size = next(r for r in t["typography_fields"] if r.field == "font_size_pt")
    assert (size.file_id, size.parent, size.value, size.confidence, size.sample_count) == (7, "typography", "11.5", 0.64, 9)
    assert sorted((r.ordinal, r.level) for r in t["headings"]) == [(0, 1), (1, 3)]
    assert sorted((r.parent, r.ordinal, r.step) for r in t["steps"])[:2] == [
        ("argument_sections[0]", 0, "issue_statement"), ("argument_sections[0]", 1, "rule_statement"),
    ]
    assert {(r.map_name, r.key, r.n) for r in t["citation_counts"]} >= {("court_distribution", "Mill Ct.", 12), ("signal_distribution", "accord", 2)}
    assert t["citation_graph"][0].total_citations == 22
    assert next(r for r in t["sections"] if r.section_type == "main_argument").citation_count == 7


def test_broken_repeated_null_and_empty(spark):
    doc = {"headings": [{"level": 1}]}
    rows = [(1, doc), (1, doc), (2, "{"), (3, None), (4, ""), (5, "[1]"), (6, '{"headings": [{"level": NaN, "level": 2}]}'), (7, '{"citation_graph": {"by_section": {"\\ud800": 1}}}')]
    got = parent_child_links(files(spark, *rows)).collect()
    assert sorted((r.file_id, r.child_path) for r in got) == [
        (1, "headings[0]"), (6, "headings[0]"), (7, "citation_graph"), (7, "citation_graph.by_section[���]"),
    ]
    assert links(spark, (None, doc), (None, {"headings": [{}, {}]})) == {(None, "$", "headings[0]"), (None, "$", "headings[1]")}
    assert parent_child_links(files(spark, (1, doc)).limit(0)).count() == 0
    clash = files(spark, (1, doc)).selectExpr("*", "'x' AS node", "'y' AS role", "1 AS level")
    assert parent_child_links(clash).count() == 1


def test_very_deep_nesting(spark):
    doc = section("leaf")
    for _ in range(200):
        doc = section("inner", argument_sections=[doc])
    got = links(spark, (1, {"argument_sections": [doc]}))
    assert len(got) == 201


def test_files_without_an_id_have_rows_of_their_own(spark):
    docs = [{"headings": [{"level": 1}]}, {"headings": [{"level": 2}, {}]}]
    rows = shred(files(spark, *[(None, d) for d in docs * 2]))["headings"].collect()
    assert sorted((r.ordinal, r.level or 0) for r in rows) == [(0, 1), (0, 2), (1, 0)]


SCALARS = st.one_of(st.none(), st.booleans(), st.integers(-(10**20), 10**20), st.floats(allow_nan=False), st.text(max_size=6), st.sampled_from(['{"a": [1]}', "[", '["x"]', "{}"]))
NAMES = st.one_of(st.text(max_size=4), st.sampled_from(["headings", "argument_sections", "typography", "font_family", "reasoning_flow", "citation_graph", "by_section", "value", "bold", "level"]))
JSON = st.recursive(SCALARS, lambda x: st.one_of(st.lists(x, max_size=4), st.dictionaries(NAMES, x, max_size=5)), max_leaves=25)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(NAMES, JSON, max_size=6))
def test_files_are_rebuilt_from_their_nodes(doc):
    doc = json.loads(json.dumps(doc).encode("utf-8", "surrogatepass"))
    rows = list(nodes(doc))
    assert rebuilt(rows) == doc
    assert len({r[0] for r in rows}) == len(rows)
    told = lambda rows: sorted(map(str, (r[2:6] + r[7:] for r in rows if r[7] not in (None, "document"))))
    assert told(rows) == told(nodes(doc, every=False))


def test_fields_that_no_table_lists_are_kept(spark):
    doc = {"headings": [{"level": 1, "color": "red", "case_style": wrapped("upper") | {"source": [1, None]}}], "argument_sections": [section("a", tags=["x"], authors={"first": "y"})], "other": 1}
    df = files(spark, (1, doc))
    assert {(r.parent, r.node, r.kind, r.scalar) for r in other_fields(df).collect()} == {
        ("headings[0]", "headings[0].color", "string", "red"), ("headings[0].case_style.source", "headings[0].case_style.source[0]", "integer", "1"),
        ("argument_sections[0].tags", "argument_sections[0].tags[0]", "string", "x"), ("argument_sections[0].authors", "argument_sections[0].authors.first", "string", "y"),
    }
    rows = [tuple(r)[1:] for r in adjacency(df).collect()]
    assert rebuilt(rows) == doc
    assert adjacency(df.limit(0)).count() == 0


def test_large_batches_come_out_in_parts(spark, monkeypatch):
    from folioweave.operators import shred as module

    doc = {"headings": [{"level": i} for i in range(30)]}
    batch = pa.RecordBatch.from_pylist([{"file": str(i), "raw_json": json.dumps(doc) if i % 3 else "{"} for i in range(10)])
    whole = list(module._shred_batches(iter([batch]), ["node", "scalar"], True))
    monkeypatch.setattr(module, "_BATCH_NODES", 50)
    parts = list(module._shred_batches(iter([batch]), ["node", "scalar"], True))
    assert len(parts) > 2 and pa.Table.from_batches(parts).to_pylist() == pa.Table.from_batches(whole).to_pylist()
