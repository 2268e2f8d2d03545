"""Nested JSON specs as flat tables, by an adjacency table.

``adjacency`` turns each file into rows (file, node, parent, label, ordinal,
scalar), one for every node that it holds. The entity tables join its object
nodes with their scalar children, pivoted by label. A node is named by its path
in the file, so every row of every table tells its file, its parent and its place.
"""

from __future__ import annotations

import itertools
import json
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.functions.jsontext import BROKEN, clean, held, kind, load, scalar_text
from folioweave.operators.deliveries import latest_of_few

# The nested parts and what they hold.
TYPOGRAPHY_FIELDS = ["font_family", "font_size_pt", "line_spacing"]
HEADING_FIELDS = ["case_style", "alignment", "bold", "font_size_pt", "numbering"]
WRAPPED = {"value": "string", "confidence": "double", "sample_count": "int", "agreement": "double"}
SECTION_SCALARS = {
    "id": "string", "section_type": "string", "argument_type": "string", "standard_of_review": "string",
    "citation_count": "int", "word_count": "int", "depth": "int",
}
GRAPH_SCALARS = {"total_citations": "int", "unique_authorities": "int", "citation_density": "double", "pinpoint_rate": "double"}
GRAPH_MAPS = ["by_section", "signal_distribution", "court_distribution"]

#: What a node's children are by their labels: (shape due there, role). Shapes: object, array (of objects), wrapped
#: (a value with its statistics, or bare), list (of scalars), map (of scalars by free keys), scalar.
GRAMMAR: dict[str, dict[str, tuple[str, str]]] = {
    "document": {
        "typography": ("object", "typography"),
        "headings": ("array", "heading"),
        "argument_sections": ("array", "section"),
        "citation_graph": ("object", "citation_graph"),
    },
    "typography": {n: ("wrapped", "typography_field") for n in TYPOGRAPHY_FIELDS},
    "heading": {"level": ("scalar", "scalar")} | {n: ("wrapped", "heading_field") for n in HEADING_FIELDS},
    "section": {n: ("scalar", "scalar") for n in SECTION_SCALARS} | {"reasoning_flow": ("list", "step"), "argument_sections": ("array", "section")},
    "citation_graph": {n: ("scalar", "scalar") for n in GRAPH_SCALARS} | {n: ("map", "count") for n in GRAPH_MAPS},
    "typography_field": {n: ("scalar", "scalar") for n in WRAPPED},
    "heading_field": {n: ("scalar", "scalar") for n in WRAPPED},
}
_ANY = ("any", None)
_SCALARS = ("scalar", "step", "count")
#: Shapes in whose place a string that holds JSON counts as that.
_OPENED = ("object", "array", "element", "wrapped", "list", "map")

#: Columns of the adjacency table; numbers link a node with the one that holds it.
_COLUMNS = {
    "node_no": ("INT", pa.int32()),
    "parent_no": ("INT", pa.int32()),
    "node": ("STRING", pa.string()),
    "parent": ("STRING", pa.string()),
    "label": ("STRING", pa.string()),
    "ordinal": ("INT", pa.int32()),
    "kind": ("STRING", pa.string()),
    "role": ("STRING", pa.string()),
    "scalar": ("STRING", pa.string()),
}
_BATCH_NODES = 50_000


def nodes(doc: object, every: bool = True) -> Iterator[tuple]:
    """Adjacency rows of one parsed file, a row for each node: the values of ``_COLUMNS``.

    ``label`` and ``ordinal`` tell a node's key or place in the one that holds it,
    ``kind`` its JSON type, ``scalar`` its text; with the numbers, a file can be
    put together again (see ``rebuilt``). ``node`` names it by its path, ``parent``
    the entity it belongs to: what holds it, but for elements of the arrays
    and maps of ``GRAMMAR`` the owner of these. ``role`` is what it is by ``GRAMMAR``.
    There, an object where an array is due counts as an array of one, and a
    string that holds JSON has that for its child, which has the role. Nulls
    have no role but count in ordinals. Unless ``every``, only nodes with a role
    come out, as the flat tables need no other.
    """
    if not isinstance(doc, dict):
        return
    number = itertools.count()
    waiting: list[tuple] = [(doc, None, "$", None, None, None, ("object", "document"))]
    while waiting:
        value, holder, path, parent, label, ordinal, (shape, role) = waiting.pop()
        no = next(number)
        if isinstance(value, str) and shape in _OPENED:
            inner = held(value)
            if inner is not value:
                if every:
                    yield no, holder, path, parent, label, ordinal, "string", None, clean(value)
                value, holder, no = inner, no, next(number)
        is_dict, is_list = isinstance(value, dict), isinstance(value, list)
        if is_dict and shape == "array":
            path, ordinal, shape = f"{path}[0]", 0, "element"
        here = None
        if shape in ("object", "element"):
            here = role if is_dict else None
        elif shape in ("wrapped", "scalar", "value") and value is not None:
            here = role
        if every or (here is not None and here != "document"):
            text = scalar_text(value) if not (is_dict or is_list) or here in _SCALARS or (here and is_list) else None
            yield no, holder, path, parent, label, ordinal, kind(value), here, text
        if is_dict:
            known = GRAMMAR.get(here, {}) if here else {}
            below = value.items() if every or shape == "map" or len(value) < len(known) else [(n, value[n]) for n in known if n in value]
            for name, x in below:
                name = clean(name)
                if shape == "map":
                    waiting.append((x, no, f"{path}[{name}]", parent, name, None, ("value", role)))
                elif every or name in known:
                    waiting.append((x, no, name if path == "$" else f"{path}.{name}", path, name, None, known.get(name, _ANY)))
        elif is_list:
            due = {"array": ("element", role), "list": ("value", role)}.get(shape, _ANY)
            if every or due is not _ANY:
                for i, x in enumerate(value):
                    waiting.append((x, no, f"{path}[{i}]", path if due is _ANY else parent, label, i, due))


def rebuilt(rows: list[tuple]) -> object:
    """The parsed file of all its adjacency rows; lone surrogates came out as U+FFFD."""
    below: dict[int | None, list[tuple]] = defaultdict(list)
    for row in rows:
        below[row[1]].append(row)
    values: dict[int, object] = {}
    for no, _, _, _, _, _, what, _, text in sorted(rows, reverse=True):  # what a node holds has greater numbers
        if what == "object":
            values[no] = {row[4]: values[row[0]] for row in below[no]}
        elif what == "array":
            values[no] = [values[row[0]] for row in sorted(below[no], key=lambda r: r[5])]
        else:
            values[no] = text if what == "string" or text is None else json.loads(text)
    return values[0]


def _shred_batches(batches: Iterator[pa.RecordBatch], columns: list[str], every: bool) -> Iterator[pa.RecordBatch]:
    at = [list(_COLUMNS).index(c) for c in columns]
    schema = pa.schema([("file", pa.string())] + [(c, _COLUMNS[c][1]) for c in columns])

    def told(rows: list[tuple], files: list[str]) -> pa.RecordBatch:
        by_column = list(zip(*rows, strict=True)) if rows else [()] * len(_COLUMNS)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((files, *(by_column[i] for i in at)), schema, strict=True)], schema=schema)

    for batch in batches:
        rows, files = [], []
        for file, text in zip(batch.column("file").to_pylist(), batch.column("raw_json").to_pylist(), strict=True):
            doc = load(text)
            if doc is not BROKEN:
                rows += nodes(doc, every)
                files += [file] * (len(rows) - len(files))
            if len(rows) >= _BATCH_NODES:
                yield told(rows, files)
                rows, files = [], []
        yield told(rows, files)


def _adjacency(files: DataFrame, columns: list[str], every: bool, apart: bool = True) -> DataFrame:
    """Adjacency rows under the file's name: its id, or a hash of what it holds (a question mark unless ``apart``). Files are
    parsed where they are read."""
    one = latest_of_few(files.select(F.col("file_id").cast("bigint").alias("file_id"), "received_at", "raw_json"), "file_id")
    content = F.concat(F.lit("?"), F.sha2(F.concat_ws(" ", F.col("received_at").cast("string"), "raw_json"), 256))
    one = one.select(F.coalesce(F.col("file_id").cast("string"), content if apart else F.lit("?")).alias("file"), "raw_json")
    fields = ", ".join(f"{c} {_COLUMNS[c][0]}" for c in columns)
    return one.mapInArrow(lambda batches: _shred_batches(batches, columns, every), f"file STRING, {fields}")


def _with_id(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("file").try_cast("bigint").alias("file_id"), *[c for c in rows.columns if c != "file"])


def adjacency(files: DataFrame) -> DataFrame:
    """Adjacency rows of all that the files hold: file_id, and for every node those of ``nodes``.

    ``files`` has file_id, received_at and raw_json. Of a file delivered again
    the latest row counts (of rows received together, one by content). Null,
    empty, broken or non-object text gives no rows, nor does an empty table.
    Texts are read whole; other columns, whatever their names, are not looked at.
    """
    return _with_id(_adjacency(files, list(_COLUMNS), every=True))


_PIVOTED = list(WRAPPED | {"level": "int"} | SECTION_SCALARS | GRAPH_SCALARS)
_NEEDED = ["node", "parent", "label", "ordinal", "role", "scalar"]


def entities(files: DataFrame, apart: bool = True) -> DataFrame:
    """Every entity of the nested parts, its scalar children pivoted beside it.

    Object nodes meet their scalar children in one shuffle on file and node, to
    which an object row brings its place and a scalar row its value: the join of
    the adjacency table with itself without a second pass over it.
    Columns: file_id, node, parent, label, ordinal, role, scalar (of steps, counts
    and bare values), then one text column for each scalar label. Files without
    an id are told apart by their content, unless ``apart`` is false.
    """
    adj = _adjacency(files, _NEEDED, every=False, apart=apart)
    is_scalar = F.col("role") == "scalar"
    place = F.struct("role", "parent", "label", "ordinal", "scalar")
    grouped = adj.groupBy("file", F.when(is_scalar, F.col("parent")).otherwise(F.col("node")).alias("node")).agg(
        F.max(F.when(~is_scalar, place)).alias("_o"),
        *[F.max(F.when(is_scalar & (F.col("label") == n), F.col("scalar"))).alias(n) for n in _PIVOTED],
    )
    return _with_id(grouped.select("file", "node", "_o.*", *_PIVOTED))


def other_fields(files: DataFrame) -> DataFrame:
    """What the parts hold beside the columns of the flat tables: file_id, node, parent, label, ordinal, kind, scalar.

    A row for each scalar in typography, headings, argument sections and the
    citation graph that no flat table has; nulls give none.
    """
    rows = adjacency(files).filter("role IS NULL AND kind NOT IN ('object', 'array', 'null')")
    part = F.regexp_extract("node", r"^\w+", 0).isin(list(GRAMMAR["document"]))
    return rows.filter(part).select("file_id", "node", "parent", "label", "ordinal", "kind", "scalar")


def shred(files: DataFrame) -> dict[str, DataFrame]:
    """The flat tables of the nested parts, by name; each has file_id, node and parent.

    typography, typography_fields, headings, heading_fields, sections, steps,
    citation_graph, citation_counts; ``other_fields`` has what none of them has.
    Sections within sections are rows of ``sections`` whose parent is a section. Files without an id have rows of
    their own, told apart by the files' content. Every table is lazy; write
    ``entities`` first to fill several of them from one pass.
    """
    return tables(entities(files))


def tables(all_entities: DataFrame) -> dict[str, DataFrame]:
    """The flat tables of :func:`shred`, of the rows of :func:`entities`."""

    def table(role: str, scalars: dict[str, str], *extra: object, **texts: Column) -> DataFrame:
        typed = [texts.get(n, F.col(n)).try_cast(t).alias(n) for n, t in scalars.items()]
        return all_entities.filter(F.col("role") == role).select("file_id", "node", "parent", *extra, *typed)

    field, bare = F.col("label").alias("field"), {"value": F.coalesce("value", "scalar")}
    return {
        "typography": table("typography", {}),
        "typography_fields": table("typography_field", WRAPPED, field, **bare),
        "headings": table("heading", {"level": "int"}, "ordinal"),
        "heading_fields": table("heading_field", WRAPPED, field, **bare),
        "sections": table("section", SECTION_SCALARS, "ordinal"),
        "steps": table("step", {}, "ordinal", F.col("scalar").alias("step")),
        "citation_graph": table("citation_graph", GRAPH_SCALARS),
        "citation_counts": table(
            "count", {}, F.regexp_extract("node", r"^citation_graph\.(\w+)", 1).alias("map_name"), F.col("label").alias("key"), F.col("scalar").try_cast("int").alias("n")
        ),
    }


def parent_child_links(files: DataFrame) -> DataFrame:
    """Distinct (file_id, parent_path, child_path) of the rows of all flat tables."""
    rows = entities(files, apart=False).filter("role IS NOT NULL")
    return rows.select("file_id", F.col("parent").alias("parent_path"), F.col("node").alias("child_path"))
