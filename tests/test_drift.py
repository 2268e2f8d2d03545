import itertools
import json
import random
from datetime import datetime, timedelta

import pytest
from payloads import wrapped

from folioweave import SpecDrift
from folioweave.functions.jsontext import BROKEN, load, written
from folioweave.functions.jsontext import kind as kind_of
from folioweave.operators.drift import DEFAULT_SCOPE, Catalog, file_states
from folioweave.operators.names import abbreviates, alias_cost

W = [("value", "number", True), ("confidence", "number", False), ("sample_count", "integer", False), ("agreement", "number", False)]
SIDES = [("margin_top", True), ("margin_left", True), ("body_indent", False)]
FIELDS = {
    "format": [
        ("_export_metadata", "object", True),
        ("_export_metadata.engine_version", "string", True),
        ("_export_metadata.overall_confidence", "number", False),
        ("layout", "object", True),
        *[(f"layout.{s}", "object", need) for s, need in SIDES],
        *[(f"layout.{s}.{n}", t, need) for s, _ in SIDES for n, t, need in W],
        ("headings", "array", False),
        ("headings[].level", "integer", False),
    ],
    "structure": [
        ("_export_metadata", "object", True),
        ("_export_metadata.engine_version", "string", True),
        ("document_metrics", "object", True),
        ("document_metrics.total_page_count", "integer", True),
        ("document_metrics.total_sections", "integer", False),
        ("citation_graph", "object", False),
        ("citation_graph.by_section", "object", False),
    ],
}
CATALOGS = {k: Catalog() for k in FIELDS}
for kind, fields in FIELDS.items():
    for f in fields:
        CATALOGS[kind].add(*f)


def layout(**changes):
    return {"margin_top": wrapped(1.0), "margin_left": wrapped(1.0), "body_indent": wrapped(0.5)} | changes


def doc(**changes):
    return {"_export_metadata": {"engine_version": "0.1.0"}, "layout": layout()} | changes


def without(obj, name):
    return {k: v for k, v in obj.items() if k != name}


def metrics(**fields):
    return {"_export_metadata": {"engine_version": "1"}, "document_metrics": fields}


def found(document, kind="format"):
    states = file_states(document, CATALOGS[kind], DEFAULT_SCOPE[kind])
    return {(p, s) for p, s, _, _ in states if s in ("removed", "renamed", "retyped", "added")}


NO_MARGIN = without(layout(), "margin_top")
FORMAT_CASES = {
    "as agreed": (doc(), set()),
    "integer for number": (doc(layout=layout(margin_top=wrapped(1))), set()),
    "nulls": (doc(layout=layout(margin_top=None), _export_metadata={"engine_version": None, "x": None}), set()),
    "null layout": (doc(layout=None), set()),
    "removed": (doc(layout=NO_MARGIN), {("layout.margin_top", "removed")}),
    "optional missing": (doc(layout=without(layout(), "body_indent")), set()),
    "value removed": (doc(layout=layout(margin_top={"confidence": 1.0})), {("layout.margin_top.value", "removed")}),
    "layout removed": (without(doc(), "layout"), {("layout", "removed")}),
    "metadata missing": (without(doc(), "_export_metadata"), set()),
    "camel case": (doc(layout=NO_MARGIN | {"marginTop": wrapped(1.0)}), {("layout.margin_top", "renamed")}),
    "turned round": (doc(layout=NO_MARGIN | {"top_margin": wrapped(1.0)}), {("layout.margin_top", "renamed")}),
    "abbreviated": (doc(layout=NO_MARGIN | {"mrg_top": wrapped(1.0)}), {("layout.margin_top", "renamed")}),
    "with a unit": (doc(layout=NO_MARGIN | {"margin_top_in": wrapped(1.0)}), {("layout.margin_top", "renamed")}),
    "in a container": (
        doc(layout={"margins": {"top": wrapped(1.0), "left": wrapped(1.0)}}),
        {("layout.margin_top", "renamed"), ("layout.margin_left", "renamed")},
    ),
    "container with more": (
        doc(layout=NO_MARGIN | {"margins": {"top": wrapped(1.0), "gutter": wrapped(1.0)}}),
        {("layout.margin_top", "renamed"), ("layout.margins", "added")},
    ),
    "not another's name": (doc(layout=NO_MARGIN | {"gutter": wrapped(1.0)}), {("layout.margin_top", "removed"), ("layout.gutter", "added")}),
    "both names": (doc(layout=layout(marginTop=wrapped(1.0))), {("layout.marginTop", "added")}),
    "layout renamed": (without(doc(), "layout") | {"pageLayout": NO_MARGIN}, {("layout", "renamed")}),
    "layout in other case": (without(doc(), "layout") | {"Layout": layout()}, {("layout", "renamed")}),
    "layout retyped": (doc(layout="margin_top=1.0"), {("layout", "retyped")}),
    "field retyped": (doc(layout=layout(margin_top=1.0)), {("layout.margin_top", "retyped")}),
    "value retyped": (doc(layout=layout(margin_top=wrapped("1 in"))), {("layout.margin_top.value", "retyped")}),
    "added inside": (doc(layout=layout(margin_top=wrapped(1.0) | {"unit": {"a": 1}})), {("layout.margin_top.unit", "added")}),
    "moved to the top": (doc(_export_metadata={"tags": []}, engine_version="1"), {("_export_metadata.engine_version", "renamed"), ("_export_metadata.tags", "added")}),
    "moved into an object": (doc(_export_metadata={"engine": {"version": "1"}}), {("_export_metadata.engine_version", "renamed")}),
    "boolean is no number": (doc(layout=layout(margin_top=wrapped(True))), {("layout.margin_top.value", "retyped")}),
    "another version of the name": (without(doc(), "layout") | {"layout_v2": layout()}, {("layout", "renamed")}),
    "a name with a dot": (doc(layout=layout() | {"margin_top.value": 1}), {("layout.margin_top.value", "added")}),
    "not an object": ([1], set()),
}
STRUCTURE_CASES = {
    "renamed": (metrics(n_pages=3), {("document_metrics.total_page_count", "renamed")}),
    "in totals": (metrics(totals={"page_count": 3}), {("document_metrics.total_page_count", "renamed")}),
    "below is not told": (metrics(total_page_count={"body": 1}), {("document_metrics.total_page_count", "retyped")}),
    "moved": (
        {"_export_metadata": {"engine_version": "1", "total_page_count": 3}, "document_metrics": {}},
        {("document_metrics.total_page_count", "renamed")},
    ),
    "another total": (metrics(total_footnotes=3), {("document_metrics.total_page_count", "removed"), ("document_metrics.total_footnotes", "added")}),
}


@pytest.mark.parametrize("case", FORMAT_CASES)
def test_format_files(case):
    document, expected = FORMAT_CASES[case]
    assert found(document) == expected


@pytest.mark.parametrize("case", STRUCTURE_CASES)
def test_structure_files(case):
    document, expected = STRUCTURE_CASES[case]
    assert found(document, "structure") == expected


def test_names():
    assert abbreviates("mrg", "margin") and abbreviates("cnt", "count") and not abbreviates("m", "margin") and not abbreviates("lft", "right")
    assert alias_cost("margin_top", (), ("marginTop",)) == 0
    assert alias_cost("margin_top", (), ("margin_bottom",)) is None
    assert alias_cost("engine_version", (), ("version",)) is not None and alias_cost("engine_version", (), ("engine",)) is None


def test_json_text():
    assert load('{"a": 1, "a": NaN}')["a"] != 1 and load("{") is BROKEN and load(None) is BROKEN and load("[" * 100_000) is BROKEN
    assert load("1" * 5000) > 0


T0 = datetime(2025, 1, 1)


def drift(spark, files):
    rows = [(i, k, c, T0 + timedelta(hours=h), d if isinstance(d, str) or d is None else json.dumps(d)) for i, k, c, h, d in files]
    df = spark.createDataFrame(rows, "file_id BIGINT, spec_kind STRING, court_code STRING, received_at TIMESTAMP, raw_json STRING")
    catalog = [(k, *f) for k, fs in FIELDS.items() for f in fs]
    return SpecDrift(df.selectExpr("*", "1 AS states", "2 AS day"), spark.createDataFrame(catalog, "spec_kind STRING, field_path STRING, json_type STRING, is_required BOOLEAN"))


RENAMED = doc(layout=NO_MARGIN | {"marginTop": wrapped(2.0)})


def test_lifespans_and_log(spark):
    files = [(i, "format", "a", 20 * i, RENAMED if 2 <= i < 5 else doc()) for i in range(8)] + [(9, "format", None, 0, doc())]
    d = drift(spark, files)
    spans = [
        (r.state, r.n_files, r.started_at, r.ended_at)
        for r in d.lifespans().filter("field_path = 'layout.margin_top' AND producer = 'a'").orderBy("started_at").collect()
    ]
    at = [T0 + timedelta(hours=20 * i) for i in range(8)]
    assert spans == [("ok", 2, at[0], at[2]), ("renamed", 3, at[2], at[5]), ("ok", 3, at[5], None)]
    log = d.log().filter("field_path = 'layout.margin_top' AND producer = 'a'").groupBy("event").count().collect()
    assert {r.event: r["count"] for r in log} == {"start": 3, "end": 2}
    assert d.lifespans().filter("producer = '(none)'").count() > 0
    (alias,) = d.aliases().collect()
    assert (alias.field_path, alias.alias_path, alias.n_files) == ("layout.margin_top", "layout.marginTop", 3)


def test_repeated_broken_and_null_rows(spark):
    files = [(1, "format", "a", 0, doc()), (1, "format", "a", 5, RENAMED), (2, "format", "a", 0, "{"), (3, None, "a", 0, doc()), (4, "format", "a", 0, None)]
    files += [(None, "format", "a", 0, RENAMED), (None, "format", "a", 0, doc(layout=1)), (5, "other", "a", 0, doc()), (6, "format", "a", 0, "")]
    rows = sorted((str(r.file_id), r.field_path, r.change_kind) for r in drift(spark, files * 2).changes().collect())
    assert rows == [("1", "layout.margin_top", "renamed"), ("None", "layout", "retyped"), ("None", "layout.margin_top", "renamed")]
    assert drift(spark, files).footers().filter("NOT is_json").count() == 3
    empty = drift(spark, files[:1])
    empty.files = empty.files.limit(0)
    assert empty.changes().count() == 0 and empty.lifespans().count() == 0 and empty.table("format").count() == 0


def test_consistent_table(spark):
    files = [
        (1, "format", "a", 0, RENAMED),
        (2, "format", "a", 0, doc(layout=layout(margin_top=wrapped("50.8 mm")), _export_metadata={"engine": {"version": "0.2.0"}})),
        (3, "format", "a", 0, doc(layout=layout(margin_top=2.0), _export_metadata={"engine_version": [0, 4, 6]})),
        (4, "format", "a", 0, doc(layout=json.dumps(layout(margin_top=wrapped(2.0))), _export_metadata={"engine_version": {"major": 0, "minor": 4}})),
        (5, "format", "a", 0, doc(layout=[{"name": "margin_top", "value": 2.0}])),
        (6, "format", "a", 0, doc(layout="margin_left=1; margin_top=2.0")),
        (7, "format", "a", 0, without(doc(), "layout") | {"page_layout": layout(margin_top=wrapped(2.0))}),
        (8, "format", "a", 0, "{"),
    ]
    rows = {r.file_id: r for r in drift(spark, files).table("format").collect()}
    assert set(rows) == set(range(1, 8))
    assert {i: r.layout.margin_top.value for i, r in rows.items()} == dict.fromkeys(range(1, 8), 2.0)
    versions = {i: r["_export_metadata"].engine_version for i, r in rows.items()}
    assert (versions[1], versions[2], versions[3], versions[4]) == ("0.1.0", "0.2.0", "0.4.6", "0.4")
    pages = [(i, "structure", "a", 0, metrics(**{k: v})) for i, (k, v) in enumerate([("pages", 7), ("total_page_count", "ca. 7"), ("total_page_count", [7]), ("total_page_count", "007")])]
    assert {r.document_metrics.total_page_count for r in drift(spark, pages).table("structure").collect()} == {7}


def test_consistent_table_reads_as_the_footers_do(spark):
    def text(metadata, end=""):
        return f'{{"_export_metadata": {metadata}, "layout": {json.dumps(layout())}}}{end}'

    deep = "[" * 1200 + "]" * 1200
    files = [
        (1, "format", "a", 0, text('{"engine_version": "draft", "engine_version": "1.2"}')),
        (2, "format", "a", 0, text('{"engine_version": "draft", "engine_version": null}')),
        (3, "format", "a", 0, text('{"engine_version": "1"}', " xyz")),
        (4, "format", "a", 0, text(f'{{"engine_version": "4", "extra": {deep}}}')),
        (5, "format", "a", 0, text('{"engine_version": 0.10, "overall_confidence": NaN}')),
        (6, "format", "a", 0, text(json.dumps('{"engine_version": "draft", "engine_version": "6"}'))),
        (7, "format", "a", 0, text('{"engine_version": "7"}')[:-1] + f', "headings": [{{"level": 1, "level": 2, "x": {deep}}}, {{"level": {"9" * 3000}}}, {{"level": 3}}]}}'),
    ]
    rows = {r.file_id: r for r in drift(spark, files).table("format").collect()}
    assert {i: r["_export_metadata"].engine_version for i, r in rows.items()} == {1: "1.2", 2: None, 4: "4", 5: "0.10", 6: "6", 7: "7"}
    assert str(rows[5]["_export_metadata"].overall_confidence) == "nan"
    assert [h.level for h in rows[7].headings] == [2, None, 3]


def test_arrays_lose_nothing(spark):
    level = {"level": 1}
    files = [
        (1, "format", "a", 0, doc(headings=[level, json.dumps({"level": 2}), 7, None, {"level": "x"}, {"Level": "3"}])),
        (2, "format", "a", 0, doc(headings=json.dumps([level]))),
        (3, "format", "a", 0, doc(headings={"level": 4})),
        (4, "format", "a", 0, doc(headings="none")),
        (5, "format", "a", 0, doc(headings=None)),
    ]
    rows = {r.file_id: r.headings for r in drift(spark, files).table("format").collect()}
    assert {i: h and [x and x.level for x in h] for i, h in rows.items()} == {1: [1, 2, None, None, None, 3], 2: [1], 3: [4], 4: [None], 5: None}


def test_units_and_texts(spark):
    mm = NO_MARGIN | {"margin_top_mm": wrapped(25.4)}
    files = [
        (1, "format", "a", 0, doc(layout=mm)),
        (2, "format", "a", 0, doc(layout=layout(margin_top=wrapped(25.4) | {"unit": "mm"}))),
        (3, "format", "a", 0, doc(layout=layout(margin_top=wrapped(1.0) | {"unit": "in"}))),
        (4, "format", "a", 0, doc(layout=NO_MARGIN | {"margin_top_in": wrapped(1.0)})),
        (5, "format", "a", 0, doc(layout=layout(margin_top="2.54cm"))),
    ]
    files += [(6, "structure", "a", 0, metrics(total_page_count={"body": 5, "appendix": 2}) | {"citation_graph": {"by_section": {"a": 1, "b": {"note": "rev 7"}}}})]
    d = drift(spark, files)
    assert {r.layout.margin_top.value for r in d.table("format").collect()} == {1.0}
    (r,) = d.table("structure").collect()
    assert r.document_metrics.total_page_count == 7 and r.citation_graph.by_section == {"a": "1", "b": '{"note": "rev 7"}'}


def test_aliases_count_where_they_were_seen(spark):
    """``pages`` is the count of pages in one file and an added field beside the count in another."""
    files = [(1, "structure", "a", 0, metrics(pages=7)), (2, "structure", "b", 0, metrics(total_page_count=None, pages=9)), (3, "structure", "a", 1, metrics(total_page_count=3, pages=9))]
    d = drift(spark, files)
    assert {r.file_id: r.document_metrics.total_page_count for r in d.table("structure").collect()} == {1: 7, 2: None, 3: 3}
    assert [(r.producer, r.alias_path, r.n_files) for r in d.aliases().collect()] == [("a", "document_metrics.pages", 1)]


def test_lifespans_over_partitions_are_whole(spark):
    rng = random.Random(4)
    shapes = [metrics(total_page_count=1), metrics(total_page_count="1"), metrics(total_page_count=None), metrics(pages=2)]
    files = [(i, "structure", rng.choice("ab"), i, shapes[0] if i % 60 < 40 else rng.choice(shapes)) for i in range(300)]
    d = drift(spark, files)
    expected = []
    for producer in "ab":
        own = [(("absent" if "pages" in x["document_metrics"] else kind_of(x["document_metrics"]["total_page_count"])), T0 + timedelta(hours=h)) for _, _, c, h, x in files if c == producer]
        runs = [(k, [t for _, t in g]) for k, g in itertools.groupby(own, key=lambda x: x[0])]
        ends = [r[1][0] for r in runs[1:]] + [None]
        expected += [(producer, None if k == "absent" else k, ts[0], ts[-1], end, len(ts)) for (k, ts), end in zip(runs, ends, strict=True)]
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = d.lifespans().filter("field_path = 'document_metrics.total_page_count'").collect()
        assert len({r.run >> 32 for r in d.islands().select("run").collect()}) > 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(str, [(r.producer, r.json_type, r.started_at, r.last_at, r.ended_at, r.n_files) for r in rows])) == sorted(map(str, expected))
    assert {(r.json_type, r.state) for r in rows} == {("integer", "ok"), ("string", "retyped"), ("null", "null"), (None, "renamed")}


def test_written_json():
    text = '{"a": [1.50, -0, 1e400, NaN, "é\\n", true, null, {}, []], "b": {"c": [{"d": "x"}, []]}}'
    assert written(load(text, literal=True)) == text
    deep = '{"a": ' * 1200 + "1" + "}" * 1200
    assert written(load(deep, literal=True)) == deep


def test_fields_moved_far():
    assert found(metrics(totals={"doc": {"count": {"of": {"page_count": 3}}}}), "structure") == {("document_metrics.total_page_count", "renamed")}
    deep = {"page_count": 3}
    for _ in range(600):
        deep = {"doc": deep}
    assert found(metrics(**deep), "structure") == {("document_metrics.total_page_count", "renamed")}
    assert found(metrics(total_page_count=3, **deep), "structure") == {("document_metrics.doc", "added")}
