"""Items that appear together: a blocked Gram matrix.

Baskets come in record blocks (Arrow batches). In each the items are numbered,
split into item blocks, and the products of the blocks' transposed binary
matrices give the block's pair counts, its diagonal the items' own. The sums
over record blocks are normalised by the counts expected by chance. What is
shuffled is one row a pair and record block, however often the pair occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.llm.frequent import only_frequent
from folioweave.session import checkpoint, forget

ITEM_BLOCK = 1024
_COUNTS = pa.schema([("field_name", pa.string()), ("item_a", pa.string()), ("item_b", pa.string()), ("n_ab", pa.int64())])


def gram(rows: np.ndarray, items: np.ndarray, n_rows: int, n_items: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Non-zero upper triangle of X'X of a binary sparse X, given by its (row, item) cells, in item blocks.

    Only the rows that hold an item of the left block, and only the items in
    these rows, take part in a product, so rare items cost little.
    """
    order = np.argsort(items, kind="stable")
    rows, items = rows[order], items[order]
    by_row = np.argsort(rows, kind="stable")
    row_start = np.searchsorted(rows[by_row], np.arange(n_rows + 1))
    for low in range(0, n_items, ITEM_BLOCK):
        high = min(low + ITEM_BLOCK, n_items)
        cut = slice(*np.searchsorted(items, [low, high]))
        used, at = np.unique(rows[cut], return_inverse=True)
        left = np.zeros((len(used), high - low), dtype=np.float32)
        left[at, items[cut] - low] = 1
        lengths = row_start[used + 1] - row_start[used]
        cells = by_row[np.repeat(row_start[used] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
        their_rows, their_items = np.repeat(np.arange(len(used)), lengths), items[cells]
        keep = their_items >= low
        their_rows, their_items = their_rows[keep], their_items[keep]
        others, column = np.unique(their_items, return_inverse=True)
        for first in range(0, len(others), ITEM_BLOCK):
            last = min(first + ITEM_BLOCK, len(others))
            inside = (column >= first) & (column < last)
            right = np.zeros((len(used), last - first), dtype=np.float32)
            right[their_rows[inside], column[inside] - first] = 1
            product = left.T @ right  # exact: a block has fewer than 2**24 rows
            a, b = np.nonzero(product)
            item_a, item_b = a + low, others[b + first]
            upper = item_a <= item_b
            yield item_a[upper], item_b[upper], product[a[upper], b[upper]].astype(np.int64)


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name in pc.unique(batch.column(0)).to_pylist():
            lists = batch.column(1).filter(pc.equal(batch.column(0), name))
            words = lists.flatten().dictionary_encode()
            if not len(words):
                continue
            vocabulary = words.dictionary.to_pylist()
            # Numbered in the items' own order, so that a < b holds for the items too.
            rank = np.empty(len(vocabulary), dtype=np.int64)
            rank[sorted(range(len(vocabulary)), key=vocabulary.__getitem__)] = np.arange(len(vocabulary))
            ordered = pa.array(sorted(vocabulary), pa.string())
            items = rank[words.indices.to_numpy(zero_copy_only=False)]
            rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            for a, b, n in gram(rows, items, len(lists), len(vocabulary)):
                if len(a):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(a), pa.string()), ordered.take(pa.array(a)), ordered.take(pa.array(b)), pa.array(n)], schema=_COUNTS
                    )


def cooccurrences(baskets: DataFrame, least: int = 1, one_in: int | None = None) -> DataFrame:
    """Pairs of items by the baskets that hold both.

    ``baskets`` has field_name and items (an array of strings); nulls and
    repeats in it don't count, nor do null field names and empty baskets;
    repeated rows are baskets of their own, an empty table gives no pairs, and
    other columns are not looked at.
    Result: field_name, item_a < item_b, n_ab, n_a, n_b, n (baskets with any
    item of the field), lift (n_ab * n / (n_a * n_b)) and pmi (its binary
    logarithm). Only pairs in at least ``least`` baskets and, if given, in at
    least one of ``one_in``. Items that are too rare for that by themselves are
    left out beforehand, by a filter of a fixed size (see ``frequent``), which
    loses no such pair. Writes the baskets, until the pairs are counted, and the
    pairs' sums to the checkpoint folder, and runs queries for these and for
    the frequent items.
    """
    items = F.array_distinct(F.array_compact(F.coalesce("items", F.array().cast("array<string>"))))
    baskets = baskets.select(F.col("field_name").cast("string").alias("field_name"), items.alias("items"))
    baskets = checkpoint(baskets.filter((F.size("items") > 0) & F.col("field_name").isNotNull()))
    sizes = checkpoint(baskets.groupBy("field_name").agg(F.count("*").alias("n")))
    kept = baskets
    if least > 1 or one_in:
        own = baskets.select("field_name", F.explode("items").alias("item")).groupBy("field_name", "item").agg(F.count("*").alias("n_a"))
        own = own.join(sizes, "field_name").filter((F.col("n_a") >= least) & (at_least_one_in(F.col("n_a"), F.col("n"), one_in)))
        kept = only_frequent(baskets.select("field_name", "items"), own.select("field_name", "item"))
    counts = (
        kept.mapInArrow(_gram_batches, "field_name STRING, item_a STRING, item_b STRING, n_ab BIGINT")
        .groupBy("field_name", "item_a", "item_b")
        .agg(F.sum("n_ab").alias("n_ab"))
    )
    # The sums are used three times below; without a cut each use would multiply the blocks again.
    counts = checkpoint(counts.filter(F.col("n_ab") >= least))
    forget(baskets)
    own = counts.filter("item_a = item_b")
    a = own.select("field_name", "item_a", F.col("n_ab").alias("n_a"))
    b = own.select("field_name", F.col("item_b"), F.col("n_ab").alias("n_b"))
    pairs = counts.filter("item_a < item_b").join(a, ["field_name", "item_a"]).join(b, ["field_name", "item_b"]).join(sizes, "field_name")
    pairs = pairs.filter(at_least_one_in(F.col("n_ab"), F.col("n"), one_in))
    lift = F.col("n_ab") * F.col("n").cast("double") / (F.col("n_a") * F.col("n_b").cast("double"))
    return pairs.select("field_name", "item_a", "item_b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"), F.log2(lift).alias("pmi"))


def _exact(n: Column) -> Column:
    """A count that can be multiplied by another: a product of two 64-bit counts fits 38 digits."""
    return n.cast("decimal(19, 0)")


def at_least_one_in(n: Column, of: Column, one_in: int | None) -> Column:
    """Is ``n`` at least one in ``one_in`` of a count; true if None."""
    return F.lit(True) if one_in is None else _exact(n) * _exact(F.lit(one_in)) >= _exact(of)


def beyond_chance(times: int = 2) -> Column:
    """Do the items of a row of :func:`cooccurrences` stand together at least ``times`` as often as by chance; exact."""
    return _exact(F.col("n_ab")) * _exact(F.col("n")) >= _exact(F.col("n_a")) * _exact(F.col("n_b")) * times
