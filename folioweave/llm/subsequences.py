"""Frequent subsequences with gaps: level-wise candidate generation.

Equal sequences are counted once and carry a weight. Patterns of one item come
from the items, those of two from the ordered pairs that each sequence holds.
Every later level joins the frequent patterns of the level before, prunes
candidates with an infrequent subpattern, ships the rest in slices to the tasks
as a tree whose inner nodes are hash tables, and counts, for each sequence, the
candidates it contains. Levels are tables in the shared folder; the driver
never holds more than a level or a slice of ``MAX_TREE`` patterns, and joins and
prunes larger levels in Spark.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.llm.frequent import only_frequent
from folioweave.llm.pairs import at_least_one_in
from folioweave.session import checkpoint, discard, forget, scratch

Pattern = tuple[str, ...]
#: So many patterns are held by the driver or shipped to the tasks at once.
MAX_TREE = 100_000
_END = None  # key of a tree node's candidate number
_LEVEL = "field_name STRING, pattern ARRAY<STRING>, n_sequences BIGINT"


def candidates(frequent: set[Pattern]) -> Iterator[Pattern]:
    """Patterns one longer all of whose subpatterns (one element left out) are frequent."""
    by_head: dict[Pattern, list[str]] = defaultdict(list)
    for p in sorted(frequent):
        by_head[p[:-1]].append(p[-1])
    for p in sorted(frequent):
        for last in by_head.get(p[1:], ()):
            c = (*p, last)
            if all(c[:i] + c[i + 1 :] in frequent for i in range(1, len(c) - 1)):
                yield c


def candidate_table(level: DataFrame) -> DataFrame:
    """:func:`candidates` of a level of any size: field_name, pattern.

    The level is joined with itself where the end of one pattern is the
    beginning of another. A candidate stays if as many of its inner subpatterns
    are in the level as it has.
    """
    p = level.select("field_name", F.col("pattern").alias("head"))
    joint = F.slice("head", F.lit(2), F.size("head") - 1)
    q = level.select("field_name", F.slice("pattern", F.lit(1), F.size("pattern") - 1).alias("joint"), F.element_at("pattern", -1).alias("last"))
    found = p.withColumn("joint", joint).join(q, ["field_name", "joint"])
    found = found.select("field_name", F.concat("head", F.array("last")).alias("pattern"))
    inner = F.array_distinct(F.transform(F.sequence(F.lit(2), F.size("pattern") - 1), lambda i: _without("pattern", i)))
    subs = found.withColumn("n_inner", F.size(inner)).select("field_name", "pattern", "n_inner", F.explode(inner).alias("sub"))
    known = subs.join(level.select("field_name", F.col("pattern").alias("sub")), ["field_name", "sub"])
    return known.groupBy("field_name", "pattern", "n_inner").count().filter("count = n_inner").select("field_name", "pattern")


def _without(pattern: str, i: Column) -> Column:
    """A pattern without its i-th item."""
    return F.concat(F.slice(pattern, F.lit(1), i - 1), F.slice(pattern, i + 1, F.size(pattern)))


def tree(patterns: list[Pattern]) -> dict:
    """Hash tree of the patterns; a node maps an item to the next node, ``None`` to the pattern's number."""
    root: dict = {}
    for i, p in enumerate(patterns):
        node = root
        for item in p:
            node = node.setdefault(item, {})
        node[_END] = i
    return root


def contained(root: dict, sequence: list[str]) -> Iterator[int]:
    """Numbers of the patterns that are subsequences of ``sequence``, each once.

    A prefix is matched at its earliest place, so each is looked at once.
    """
    places: dict[str, list[int]] = defaultdict(list)
    for i, item in enumerate(sequence):
        places[item].append(i)
    waiting = [(root, -1)]
    while waiting:
        node, after = waiting.pop()
        if _END in node:
            yield node[_END]
        fewer, more = (node, places) if len(node) < len(places) else (places, node)
        for item in fewer:
            if item is not _END and item in more:
                at = places[item]
                k = bisect_right(at, after)
                if k < len(at):
                    waiting.append((node[item], at[k]))


def ordered_pairs(sequence: list[str]) -> Iterator[Pattern]:
    """Patterns of two items in the sequence, each once."""
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    for i, item in enumerate(sequence):
        first.setdefault(item, i)
        last[item] = i
    for a, i in first.items():
        for b, j in last.items():
            if i < j:
                yield a, b


_ARROW = pa.schema([("field_name", pa.string()), ("pattern", pa.list_(pa.string())), ("n_sequences", pa.int64())])


def _counted(totals: Counter) -> pa.RecordBatch:
    """Counts by (field, pattern) as a batch."""
    fields, patterns = zip(*totals, strict=True) if totals else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((fields, patterns, totals.values()), _ARROW, strict=True)], schema=_ARROW)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: Counter = Counter()
    for batch in batches:
        for f, sequence, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for p in ordered_pairs(sequence):
                totals[f, p] += n
            if len(totals) >= MAX_TREE:
                yield _counted(totals)
                totals.clear()
    yield _counted(totals)


def _count_slice(rows: DataFrame, patterns: list[tuple[str, Pattern]]) -> DataFrame:
    """Supports of at most ``MAX_TREE`` candidates: field_name, pattern, n_sequences."""
    by_field: dict[str, list[Pattern]] = defaultdict(list)
    for f, p in patterns:
        by_field[f].append(tuple(p))
    shipped = rows.sparkSession.sparkContext.broadcast({f: (p, tree(p)) for f, p in by_field.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for f, sequence, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if f in shipped.value:
                    mine = totals[f]
                    for i in contained(shipped.value[f][1], sequence):
                        mine[i] += n
        yield _counted(Counter({(f, shipped.value[f][0][i]): n for f, c in totals.items() for i, n in c.items()}))

    return rows.mapInArrow(count, _LEVEL)


class _Levels:
    """The levels found so far, as tables in the shared folder."""

    def __init__(self, rows: DataFrame, sizes: DataFrame, least: int, one_in: int):
        self.rows, self.sizes, self.least, self.one_in = rows, sizes, least, one_in
        self.spark, self.at, self.paths = rows.sparkSession, scratch(rows.sparkSession), []

    def add(self, level: int, counts: DataFrame) -> None:
        """Sum the counts of patterns and keep the frequent ones of them as (a part of) a level."""
        total = counts.groupBy("field_name", "pattern").agg(F.sum("n_sequences").alias("n_sequences"))
        n = F.col("n_sequences")
        frequent = total.join(self.sizes, "field_name").filter((n >= self.least) & at_least_one_in(n, F.col("n_all"), self.one_in))
        path = f"{self.at}/level={level}"
        frequent.select("field_name", "pattern", "n_sequences", "n_all").write.mode("append").parquet(path)
        if path not in self.paths:
            self.paths.append(path)

    def table(self, level: int) -> DataFrame:
        return self.spark.read.schema(f"{_LEVEL}, n_all BIGINT").parquet(f"{self.at}/level={level}")

    def next(self, level: int) -> bool:
        """Find the level after ``level``; false if there can't be one."""
        known = self.table(level).select("field_name", "pattern")
        few = known.limit(MAX_TREE + 1).collect()
        if not few:
            return False
        if len(few) <= MAX_TREE:
            by_field: dict[str, set[Pattern]] = defaultdict(set)
            for r in few:
                by_field[r.field_name].add(tuple(r.pattern))
            found = ((f, c) for f, patterns in by_field.items() for c in candidates(patterns))
            any_found = False
            while part := list(islice(found, MAX_TREE)):
                self.add(level + 1, _count_slice(self.rows, part))
                any_found = True
            return any_found
        path = scratch(self.spark)
        candidate_table(known).write.parquet(path)
        found = self.spark.read.parquet(path)
        n_slices = -(-found.count() * 2 // MAX_TREE)  # half full, as hashes don't spread evenly
        for i in range(n_slices):
            part = found.filter(F.pmod(F.xxhash64("field_name", "pattern"), F.lit(n_slices)) == i).collect()
            if part:
                self.add(level + 1, _count_slice(self.rows, [(r.field_name, r.pattern) for r in part]))
        discard(self.spark, path)
        return n_slices > 0


def frequent_subsequences(sequences: DataFrame, least: int = 3, one_in: int = 100, shortest: int = 1, closed: bool = False) -> DataFrame:
    """Patterns contained, with gaps, in at least ``least`` and one in ``one_in`` sequences.

    ``sequences`` has field_name and items (an array of strings); null items
    are left out, then sequences without items and null field names; repeated
    rows count each, and other columns are not looked at. Result:
    field_name, pattern (array), n_sequences, n_all; patterns of at least
    ``shortest`` items. With ``closed`` only those that no longer frequent
    pattern of the same support contains: these tell all the others and their
    supports, and of a long sequence that many share there is one. Runs
    one query a level (and slice of its candidates); sequences and levels are
    written to the checkpoint folder. An empty table gives no patterns.
    """
    items = F.array_compact(F.coalesce("items", F.array().cast("array<string>")))
    every = sequences.select(F.col("field_name").cast("string").alias("field_name"), items.alias("items"))
    every = every.filter((F.size("items") > 0) & F.col("field_name").isNotNull())
    every = checkpoint(every.groupBy("field_name", "items").agg(F.count("*").alias("n")))
    sizes = checkpoint(every.groupBy("field_name").agg(F.sum("n").alias("n_all")))

    levels = _Levels(every, sizes, least, one_in)
    single = F.explode(F.array_distinct("items")).alias("item")
    levels.add(1, every.select("field_name", F.col("n").alias("n_sequences"), single).select("field_name", F.array("item").alias("pattern"), "n_sequences"))
    # Items that are in no frequent pattern only cost time; without them more sequences are equal.
    kept = only_frequent(every, levels.table(1).select("field_name", F.col("pattern")[0].alias("item"))).filter(F.size("items") > 1)
    levels.rows = checkpoint(kept.groupBy("field_name", "items").agg(F.sum("n").alias("n")))
    forget(every)
    levels.add(2, levels.rows.mapInArrow(_count_pairs, _LEVEL))
    level = 2
    while levels.next(level):
        level += 1
    forget(levels.rows)

    found = levels.spark.read.schema(f"{_LEVEL}, n_all BIGINT").parquet(*levels.paths)
    return (_closed(found) if closed else found).filter(F.size("pattern") >= shortest)


def _closed(found: DataFrame) -> DataFrame:
    """Patterns without one item more, anywhere, in as many sequences."""
    longer = found.filter(F.size("pattern") > 1)
    subs = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("pattern")), lambda i: _without("pattern", i))))
    best = longer.select("field_name", subs.alias("pattern"), "n_sequences").groupBy("field_name", "pattern").agg(F.max("n_sequences").alias("n_longer"))
    joined = found.join(best, ["field_name", "pattern"], "left").filter("n_longer IS NULL OR n_longer < n_sequences")
    return joined.select("field_name", "pattern", "n_sequences", "n_all")
