"""Schemas that drift between files: one table a family, and a report of each change.

Each file's footer tells its fields' paths and JSON types. Footers are exploded
and put in order of producer, field and arrival; where a field's type differs
from that of the file before, one lifespan of the field ends and the next
starts. A lifespan is compared with the catalogue of agreed fields: as agreed,
null, of another type, absent, or unknown. Files are joined back to the
lifespans that are not as agreed; there, absent fields whose content stands
under an unknown name are renamed. The names found are the alias table, and with
it the casts of the consistent table are generated.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioweave.functions.jsontext import BROKEN, clean, kind, load
from folioweave.operators.casts import Caster
from folioweave.operators.deliveries import latest
from folioweave.operators.names import alias_cost
from folioweave.session import checkpoint

#: Tracked paths: a container with True for all below it, False for its direct fields.
DEFAULT_SCOPE = {
    "format": {"layout": True, "_export_metadata": False},
    "structure": {"_export_metadata": False, "document_metrics": False},
}
#: Bound of the catalogue, which is all that the driver holds.
MAX_CATALOG_FIELDS = 100_000
#: Files that one row of an island lists.
ISLAND_FILES = 1000
#: Joins the names of a path; catalogued paths are told with dots.
SEP = "\x1f"


@dataclass
class Catalog:
    """The agreed fields of one family."""

    types: dict[str, str] = field(default_factory=dict)
    required: set[str] = field(default_factory=set)
    children: dict[str, list[str]] = field(default_factory=dict)
    by_names: dict[str, str] = field(default_factory=dict)  # path by its names, joined by ``SEP``

    def add(self, path: str, json_type: str, is_required: bool) -> None:
        self.types[path] = json_type
        if is_required:
            self.required.add(path)
        parent, _, _ = path.rpartition(".")
        self.children.setdefault(parent, []).append(path)
        self.by_names[path.replace(".", SEP)] = path


def read_catalog(catalog: DataFrame) -> dict[str, Catalog]:
    """The catalogue as Python objects; more than ``MAX_CATALOG_FIELDS`` rows are an error."""
    rows = catalog.select("spec_kind", "field_path", "json_type", "is_required").limit(MAX_CATALOG_FIELDS + 1).collect()
    if len(rows) > MAX_CATALOG_FIELDS:
        raise ValueError(f"more than {MAX_CATALOG_FIELDS} catalogued fields")
    out: dict[str, Catalog] = {}
    for r in sorted((r for r in rows if r.field_path), key=lambda r: r.field_path):
        out.setdefault(r.spec_kind, Catalog()).add(r.field_path, r.json_type, bool(r.is_required))
    return out


def footer(doc: object, cat: Catalog, scope: dict[str, bool]) -> list[tuple[str, str]]:
    """Paths and JSON types of a parsed file's fields, each once.

    The tracked fields of the catalogue (``absent`` if only their parent is
    there), and every field that it doesn't know, with what objects among these
    hold. Fields of objects in arrays and tracked fields' parts of a wrong
    type are not looked into.
    """
    if not isinstance(doc, dict):
        return []
    out: list[tuple[str, str]] = []
    for root, deep in scope.items():
        waiting = [root] if deep and root in cat.types else []
        if not deep and isinstance(doc.get(root), dict):
            waiting = list(cat.children.get(root, []))
        while waiting:
            path = waiting.pop()
            *above, name = path.split(".")
            parent = doc
            for n in above:
                parent = parent[n]
            shape = _shape(parent[name]) if name in parent else "absent"
            out.append((path.replace(".", SEP), shape))
            if deep and isinstance(parent.get(name), dict) and cat.types[path] == "object":
                waiting += cat.children.get(path, [])
    below = [((), doc, True)]
    while below:
        at, obj, known = below.pop()
        for name, x in obj.items():
            here = (*at, name.replace(SEP, "\ufffd"))
            path = SEP.join(here)
            if known and path in cat.by_names:
                if isinstance(x, dict) and cat.by_names[path] in cat.children:
                    below.append((here, x, True))
            elif x is not None:
                out.append((path, _shape(x)))
                if isinstance(x, dict):
                    below.append((here, x, False))
    return out


def _shape(value: object) -> str:
    """JSON type; of an object that wraps a value, with that."""
    return "object(value)" if isinstance(value, dict) and "value" in value else kind(value)


def verdict(path: str, shape: str, cat: Catalog) -> str:
    """How a field's lifespan stands to the catalogue: ok, null, retyped, absent or unknown."""
    if (known := cat.by_names.get(path)) is None:
        return "unknown"
    if shape in ("absent", "null"):
        return shape
    agreed = cat.types[known]
    return "ok" if shape.partition("(")[0] == agreed or (agreed == "number" and shape == "integer") else "retyped"


DEVIATING = ("retyped", "absent", "unknown")


def resolved(fields: tuple[tuple[str, str, str], ...], cat: Catalog, scope: dict[str, bool]) -> dict[str, tuple[str, str | None]]:
    """What became of one file's deviating fields (path, type, verdict): path -> (state, alias).

    States: retyped, renamed, removed, absent (not required), added, moved (an
    unknown field that only serves a renamed one), inside (of an unknown one) and
    elsewhere (not tracked).
    """
    out: dict[str, tuple[str, str | None]] = {p: (v, None) for p, _, v in fields if v == "retyped"}
    missing = sorted(cat.by_names[p] for p, _, v in fields if v == "absent")
    strays = {tuple(p.split(SEP)): shape for p, shape, v in fields if v == "unknown"}
    pairs = []
    for path in missing:
        *context, name = path.split(".")
        for at, shape in strays.items():
            # Names shared with the field's own place tell nothing; the rest must mean it.
            own = 0
            while own < min(len(context), len(at) - 1) and at[own] == context[own]:
                own += 1
            if len(context) > 1 and own < len(context):
                continue  # parts of a wrapped value move only with it
            rest = at[own:] if own == len(context) else _beyond(at, cat)
            cost = alias_cost(name, tuple(context), rest)
            if cost is not None and _may_hold(shape, cat.types[path]):
                pairs.append((cost, len(context) - own, len(at), path, at))
    taken: dict[tuple[str, ...], str] = {}
    done: set[str] = set()
    for _, _, _, path, at in sorted(pairs):
        if path not in done and not any(at[: len(t)] == t or t[: len(at)] == at for t in taken):
            done.add(path)
            taken[at] = path
            out[path.replace(".", SEP)] = ("renamed", SEP.join(at))
    for path in missing:
        if path not in done:
            out[path.replace(".", SEP)] = ("removed" if path in cat.required else "absent", None)

    inner: dict[tuple[str, ...], list[tuple[str, ...]]] = defaultdict(list)
    for at in strays:
        inner[at[:-1]].append(at)

    def serves(at: tuple[str, ...]) -> bool:
        """Does the field hold nothing but moved fields?"""
        waiting = [at]
        while waiting:
            at = waiting.pop()
            if at not in taken:
                if not inner[at]:
                    return False
                waiting += inner[at]
        return True

    for at in strays:
        if at[:-1] in strays:
            state = "inside"
        elif not _tracked(at[:-1], cat, scope):
            state = "elsewhere"
        else:
            state = "moved" if taken and serves(at) else "added"
        out[SEP.join(at)] = (state, None)
    return out


def _tracked(parent: tuple[str, ...], cat: Catalog, scope: dict[str, bool]) -> bool:
    """Are the fields of this object tracked?"""
    if not parent or parent[0] not in scope:
        return False
    return len(parent) == 1 or (scope[parent[0]] and cat.types.get(cat.by_names.get(SEP.join(parent))) == "object")


def file_states(doc: object, cat: Catalog, scope: dict[str, bool]) -> list[tuple[str, str, str | None, str | None]]:
    """State of every field in the footer of one parsed file, alone: (path, state, json type, alias)."""
    found = [(p, t, verdict(p, t, cat)) for p, t in footer(doc, cat, scope)]
    states = resolved(tuple(sorted(f for f in found if f[2] in DEVIATING)), cat, scope)
    return [(p.replace(SEP, "."), *_told(states.get(p, (v, None)), t)) for p, t, v in found]


def _told(state: tuple[str, str | None], shape: str) -> tuple[str, str | None, str | None]:
    name, alias = state
    return name, None if shape == "absent" else shape, alias and alias.replace(SEP, ".")


def _beyond(at: tuple[str, ...], cat: Catalog) -> tuple[str, ...]:
    """A stray's names without the catalogued objects it stands in."""
    n = 0
    while n < len(at) - 1 and SEP.join(at[: n + 1]) in cat.by_names:
        n += 1
    return at[n:]


def _may_hold(shape: str, json_type: str) -> bool:
    """Can this be the content of such a field, in whatever shape; objects hold scalars only if wrapped."""
    if json_type == "object":
        return shape != "boolean"
    if shape.startswith("object"):
        return shape == "object(value)"
    return (shape == "boolean") == (json_type == "boolean")


_FIELD = pa.struct([("path", pa.string()), ("json_type", pa.string())])


def _footer_batches(batches: Iterator[pa.RecordBatch], catalogs: dict[str, Catalog], scope: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flags, paths, types, ends = [], [], [], [0]
        for spec_kind, text in zip(batch.column("spec_kind").to_pylist(), batch.column("raw_json").to_pylist(), strict=True):
            doc = load(text)
            flags.append(doc is not BROKEN)
            if spec_kind in catalogs:
                for path, shape in footer(doc, catalogs[spec_kind], scope.get(spec_kind, {})):
                    paths.append(clean(path))
                    types.append(shape)
            ends.append(len(paths))
        fields = pa.StructArray.from_arrays([pa.array(paths, pa.string()), pa.array(types, pa.string())], fields=list(_FIELD))
        kept = batch.drop_columns(["raw_json"])
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array(flags), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)], names=[*kept.schema.names, "is_json", "fields"]
        )


_RUNS = pa.schema(
    [
        ("run", pa.int64()),
        ("spec_kind", pa.string()),
        ("producer", pa.string()),
        ("path", pa.string()),
        ("json_type", pa.string()),
        ("verdict", pa.string()),
        ("started_at", pa.timestamp("us", "UTC")),
        ("last_at", pa.timestamp("us", "UTC")),
        ("ended_at", pa.timestamp("us", "UTC")),  # start of the field's next run, if the partition holds it
        ("n_files", pa.int64()),
        ("edge", pa.int32()),  # 1: the partition's first run, 2: its last, 3: both
        ("files", pa.list_(pa.struct([("file", pa.string()), ("received_at", pa.timestamp("us", "UTC"))]))),
    ]
)
_RUNS_DDL = (
    "run BIGINT, spec_kind STRING, producer STRING, path STRING, json_type STRING, verdict STRING, started_at TIMESTAMP, last_at TIMESTAMP, "
    "ended_at TIMESTAMP, n_files BIGINT, edge INT, files ARRAY<STRUCT<file: STRING, received_at: TIMESTAMP>>"
)


def _differs(columns: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before it."""
    new = np.zeros(len(columns[0]), dtype=bool)
    for c in columns:
        new[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False)
    new[:1] = True
    return new


def _run_batches(batches: Iterator[pa.RecordBatch], catalogs: dict[str, Catalog]) -> Iterator[pa.RecordBatch]:
    """Islands of rows sorted by kind, producer, path and arrival: a row each, or one for each ``ISLAND_FILES`` files.

    The files are listed where the type deviates from the catalogue. Columns
    are those of ``_RUNS`` but verdict, edge and run, in the order of the sort.
    """
    number, first = TaskContext.get().partitionId() << 32, True
    rows: list[dict] = []
    run: dict | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i) for i in range(4)]  # kind, producer, path, type
        files, times = batch.column(4).to_pylist(), batch.column(5).cast(pa.int64()).to_pylist()
        starts = np.flatnonzero(_differs(keys)).tolist()
        heads = zip(*(c.take(pa.array(starts)).to_pylist() for c in keys), strict=True)
        for (spec_kind, producer, path, shape), low, high in zip(heads, starts, [*starts[1:], batch.num_rows], strict=True):
            same_field = run is not None and (run["spec_kind"], run["producer"], run["path"]) == (spec_kind, producer, path)
            if not same_field or run["json_type"] != shape:
                if run is not None:
                    rows.append(run | {"ended_at": times[low] if same_field else None, "edge": int(first)})
                    number, first = number + 1, False
                told = verdict(path, shape, catalogs[spec_kind])
                run = {"run": number, "spec_kind": spec_kind, "producer": producer, "path": path, "json_type": shape, "verdict": told}
                run |= {"started_at": times[low], "ended_at": None, "last_at": None, "n_files": 0, "files": []}
            if run["verdict"] in DEVIATING:
                for at in range(low, high):
                    if len(run["files"]) == ISLAND_FILES:  # a part of the island
                        rows.append(run | {"edge": int(first)})
                        run = run | {"n_files": 0, "files": []}
                    run["files"].append({"file": files[at], "received_at": times[at]})
                    run["n_files"] += 1
            else:
                run["n_files"] += high - low
            run["last_at"] = times[high - 1]
        if len(rows) >= 10_000:
            yield pa.RecordBatch.from_pylist(rows, schema=_RUNS)
            rows = []
    if run is not None:
        rows.append(run | {"edge": int(first) + 2})
    yield pa.RecordBatch.from_pylist(rows, schema=_RUNS)


_CHANGE = pa.schema(
    [("file", pa.string()), ("spec_kind", pa.string())]
    + [(n, pa.string()) for n in ("producer", "field_path", "change_kind", "json_type", "alias_path")]
    + [("run", pa.int64()), ("started_at", pa.timestamp("us", "UTC")), ("received_at", pa.timestamp("us", "UTC"))]
)
_CHANGE_DDL = (
    "file STRING, spec_kind STRING, producer STRING, field_path STRING, change_kind STRING, json_type STRING, alias_path STRING, "
    "run BIGINT, started_at TIMESTAMP, received_at TIMESTAMP"
)


def _change_batches(batches: Iterator[pa.RecordBatch], catalogs: dict[str, Catalog], scope: dict) -> Iterator[pa.RecordBatch]:
    """States of the files' deviating fields, of rows file, spec_kind, producer, received_at, fields."""

    @lru_cache(100_000)
    def states(spec_kind: str, fields: tuple) -> dict[str, tuple[str, str | None]]:
        return resolved(fields, catalogs[spec_kind], scope.get(spec_kind, {}))

    for batch in batches:
        out: list[list] = [[] for _ in _CHANGE]
        fields, ends = batch.column(4).flatten(), batch.column(4).offsets.to_pylist()
        parts = list(zip(*(fields.field(n).to_pylist() for n in ("path", "json_type", "verdict", "run")), strict=True))
        starts = fields.field("started_at").cast(pa.int64()).to_pylist()
        heads = zip(*(batch.column(j).to_pylist() for j in range(3)), batch.column(3).cast(pa.int64()).to_pylist(), strict=True)
        for i, (file, spec_kind, producer, received_at) in enumerate(heads):
            own = range(ends[i] - ends[0], ends[i + 1] - ends[0])
            told = states(spec_kind, tuple(sorted(parts[j][:3] for j in own)))
            for j in own:
                path, shape, _, run = parts[j]
                state, shape, alias = _told(told[path], shape)
                row = (file, spec_kind, producer, path.replace(SEP, "."), state, shape, alias, run, starts[j], received_at)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
        arrays = [pa.array(c, f.type) for c, f in zip(out, _CHANGE, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, schema=_CHANGE)


class SpecDrift:
    """Drift of ``files`` (file_id, spec_kind, received_at, raw_json, a producer) against a catalogue.

    The catalogue (spec_kind, field_path, json_type, is_required) is read when
    this is made; everything else but ``lifespans`` and ``log`` is lazy. Of a file delivered again the latest
    row counts. Null or unknown kinds, text that is not JSON and JSON that is
    no object have no fields and so no states; files without an id are told
    apart by their content. Files of a producer that arrive together are ordered
    by id. Texts are read whole, however long; no files give no
    rows. Other columns of ``files``, whatever their names, are not looked at.
    """

    def __init__(self, files: DataFrame, catalog: DataFrame, producer: str = "court_code", scope: dict | None = None):
        self.catalogs = read_catalog(catalog)
        self.scope = scope or DEFAULT_SCOPE
        content = F.concat(F.lit("?"), F.sha2(F.concat_ws(SEP, "spec_kind", F.col(producer), F.col("received_at").cast("string"), "raw_json"), 256))
        self.files = files.select(
            F.coalesce(F.col("file_id").cast("bigint").cast("string"), content).alias("file"),
            "spec_kind",
            F.coalesce(F.col(producer), F.lit("(none)")).alias("producer"),
            F.col("received_at").cast("timestamp").alias("received_at"),
            F.xxhash64("raw_json").alias("content"),
            "raw_json",
        )

    def footers(self) -> DataFrame:
        """One row a file: file (its id, or a hash), spec_kind, producer, received_at, is_json, fields (path, json_type)."""
        catalogs, scope = self.catalogs, self.scope
        parsed = self.files.mapInArrow(
            lambda batches: _footer_batches(batches, catalogs, scope),
            "file STRING, spec_kind STRING, producer STRING, received_at TIMESTAMP, content BIGINT, is_json BOOLEAN, fields ARRAY<STRUCT<path: STRING, json_type: STRING>>",
        )
        return latest(parsed, "file", tie="content").drop("content")  # after the parse, when rows are small

    def islands(self) -> DataFrame:
        """Runs of files of one producer in which a field has one type, as far as a partition holds them.

        The exploded footers are range-partitioned by producer, field and
        arrival, so that a producer with very many files is spread over many
        tasks, and compared with the row before in a scan. ``edge`` tells the
        runs that may go on in the next partition; ``lifespans`` joins these.
        """
        catalogs = self.catalogs
        order = ["spec_kind", "producer", "path", "received_at", "file"]
        rows = self.footers().select("spec_kind", "producer", "file", "received_at", F.inline("fields"))
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        rows = rows.select("spec_kind", "producer", "path", "json_type", "file", "received_at")
        return rows.mapInArrow(lambda batches: _run_batches(batches, catalogs), _RUNS_DDL)

    def states(self) -> DataFrame:
        """What became of every field of every file that is not as agreed: file_id, spec_kind, producer, field_path,
        change_kind, json_type, alias_path, run, started_at, received_at, file.

        The files of the deviating islands meet again by file; ``change_kind`` is a
        state of :func:`resolved`.
        """
        return self._states(self.islands())

    def _states(self, islands: DataFrame) -> DataFrame:
        catalogs, scope = self.catalogs, self.scope
        rows = islands.filter(F.col("verdict").isin(*DEVIATING))
        rows = rows.select("spec_kind", "producer", "path", "json_type", "verdict", "run", "started_at", F.inline("files"))
        fields = F.collect_list(F.struct("path", "json_type", "verdict", "run", "started_at")).alias("fields")
        by_file = rows.groupBy("file", "spec_kind", "producer", "received_at").agg(fields)  # no more than the file's fields
        told = by_file.mapInArrow(lambda batches: _change_batches(batches, catalogs, scope), _CHANGE_DDL)
        return told.withColumn("file_id", F.col("file").try_cast("bigint"))

    def changes(self) -> DataFrame:
        """Every change of every file: file_id, spec_kind, field_path, change_kind, json_type, alias_path, started_at.

        ``change_kind`` is removed, renamed, retyped or added, ``started_at`` the start of the field's island.
        """
        rows = self.states().filter(F.col("change_kind").isin("removed", "renamed", "retyped", "added"))
        return rows.select("file_id", "spec_kind", "field_path", "change_kind", "json_type", "alias_path", "started_at")

    def lifespans(self) -> DataFrame:
        """The column lifespan catalogue: each producer's field in one type, over all files.

        Columns: spec_kind, producer, field_path, state, json_type, alias_path,
        started_at, last_at, ended_at (when the next type was first seen, null
        if none was), n_files. ``state`` is the verdict of the catalogue, for
        deviating fields what became of them in the files (the last by name if
        that differs), ``alias_path`` one of their names then. The islands are
        written to the checkpoint folder, as their numbers must be the same in
        both uses.
        """
        islands = checkpoint(self.islands())
        runs = islands.drop("files")
        known = self._states(islands).groupBy("run").agg(F.max("change_kind").alias("told"), F.max("alias_path").alias("alias_path"))
        keys = ["spec_kind", "producer", "path", "json_type"]
        rest = [F.min("started_at").alias("started_at"), F.max("last_at").alias("last_at"), F.max("ended_at").alias("ended_at")]
        whole = runs.groupBy("run", *keys).agg(F.first("verdict").alias("verdict"), *rest, F.sum("n_files").alias("n_files"), F.max("edge").alias("edge"))
        whole = whole.join(known, "run", "left").withColumn("state", F.coalesce("told", "verdict")).drop("told", "verdict")
        # Runs at the partitions' edges, at most two each, are joined where one goes on in the next.
        edges = whole.filter("edge > 0")
        by = Window.partitionBy(F.lit(0)).orderBy("run")
        same = [F.col(k) == F.lag(k).over(by) for k in keys]
        goes_on = F.coalesce(same[0] & same[1] & same[2] & same[3] & (F.lag("edge").over(by) > 1), F.lit(False))
        edges = edges.withColumn("goes_on", goes_on).withColumn("chain", F.sum((~F.col("goes_on")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
        chains = edges.groupBy("chain", *keys).agg(
            *rest, F.max("state").alias("state"), F.max("alias_path").alias("alias_path"), F.sum("n_files").alias("n_files"), F.max_by("edge", "run").alias("edge")
        )
        after = Window.partitionBy(F.lit(0)).orderBy("chain")
        next_field = F.lead(F.struct(*keys[:3])).over(after) == F.struct(*keys[:3])
        ended = F.coalesce("ended_at", F.when(next_field & (F.col("edge") > 1), F.lead("started_at").over(after)))
        chains = chains.withColumn("ended_at", ended)
        columns = ["spec_kind", "producer", F.translate("path", SEP, ".").alias("field_path"), "state"]
        columns += [F.nullif("json_type", F.lit("absent")).alias("json_type"), "alias_path", "started_at", "last_at", "ended_at", "n_files"]
        return whole.filter("edge = 0").select(*columns).unionByName(chains.select(*columns))

    def log(self) -> DataFrame:
        """Starts and endings of the lifespans, one row each: ..., event (start or end), at."""
        events = F.array(
            F.struct(F.lit("start").alias("event"), F.col("started_at").alias("at")),
            F.struct(F.lit("end").alias("event"), F.col("ended_at").alias("at")),
        )
        return self.lifespans().select(
            "spec_kind", "producer", "field_path", "state", "json_type", "alias_path", "n_files", F.inline(events)
        ).filter("event = 'start' OR at IS NOT NULL")

    def aliases(self) -> DataFrame:
        """The alias table: spec_kind, producer, field_path, alias_path, first_at, last_at, n_files."""
        rows = self.states().filter("change_kind = 'renamed'")
        return rows.groupBy("spec_kind", "producer", "field_path", "alias_path").agg(
            F.min("received_at").alias("first_at"), F.max("received_at").alias("last_at"), F.count("*").alias("n_files")
        )

    def table(self, spec_kind: str) -> DataFrame:
        """All readable files of a family in the catalogued columns and types.

        Columns: file_id, producer, received_at and the catalogue's top-level
        fields; objects without catalogued fields are maps of text, arrays
        without catalogued elements arrays of text. A field that was renamed in a
        file, as its lifespans tell, is read under that file's alias; what stands
        in another place or shape is cast by the rules of ``casts``. What can't
        be cast is null, by itself. A part is null only where the file has none.
        """
        cat = self.catalogs[spec_kind]
        files = latest(self.files.filter(F.col("spec_kind") == spec_kind), "file", tie="content")
        renamed = self.states().filter((F.col("change_kind") == "renamed") & (F.col("spec_kind") == spec_kind))
        moved = renamed.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("field_path", "alias_path"))).alias("moved"))
        joined = files.join(moved, "file", "left").select("file", "producer", "received_at", "raw_json", "moved")
        caster = Caster(cat.types, cat.children)
        schema = ", ".join(f"`{p}` {caster.ddl(p)}" for p in cat.children[""])
        rows = joined.mapInArrow(lambda batches: _table_batches(batches, caster), f"file STRING, producer STRING, received_at TIMESTAMP, {schema}")
        return rows.withColumn("file", F.col("file").try_cast("bigint")).withColumnRenamed("file", "file_id")


def _table_batches(batches: Iterator[pa.RecordBatch], caster: Caster) -> Iterator[pa.RecordBatch]:
    columns = caster.children[""]
    for batch in batches:
        places, values = [], []
        for i, (text, moved) in enumerate(zip(batch.column("raw_json").to_pylist(), batch.column("moved").to_pylist(), strict=True)):
            doc = load(text, literal=True)
            if isinstance(doc, dict):
                places.append(i)
                values.append(caster.row(doc, dict(moved or ())))
        kept = batch.select(["file", "producer", "received_at"]).take(pa.array(places, pa.int64()))
        arrays = [pa.array([v[p] for v in values], caster.arrow(p)) for p in columns]
        yield pa.RecordBatch.from_arrays([*kept.columns, *arrays], names=[*kept.schema.names, *columns])
