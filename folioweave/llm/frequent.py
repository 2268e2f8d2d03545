"""Leaving rare items out of arrays, by a filter of a fixed size.

The frequent items' hashes set bits of a Bloom filter, which is made in the
tasks, or-ed together in Spark and broadcast. However many items are frequent,
the filter is of the same size: with more of them it lets more rare items
through, which only costs time where the rare are dropped after counting too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter (2 MB), a power of two, and bits set for each item.
FILTER_BITS = 1 << 24
HASHES = 4


def _bits(hashes: np.ndarray) -> np.ndarray:
    """Places of the bits of each hash, one row an item."""
    h = hashes.view(np.uint64)[:, None]
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h + np.arange(HASHES, dtype=np.uint64) * step) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 64-bit words of the filter that the items set bits in."""
    for batch in batches:
        places = _bits(batch.column(0).to_numpy(zero_copy_only=False)).ravel()
        words, at = np.unique(places >> 6, return_inverse=True)
        bits = np.zeros(len(words), dtype=np.uint64)
        np.bitwise_or.at(bits, at, np.uint64(1) << (places & 63).astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(bits.view(np.int64))], names=["word", "bits"])


def only_frequent(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """``rows`` (field_name, items, others) with the items of ``frequent`` (field_name, item), and perhaps a few more.

    Items keep their order and repeats; arrays may become empty. Items must not
    be null. Runs a query for the filter, whose size doesn't grow.
    """
    hashed = frequent.select(F.xxhash64("field_name", "item").alias("h"))
    words = hashed.mapInArrow(_words, "word BIGINT, bits BIGINT").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS >> 6, dtype=np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    shipped = rows.sparkSession.sparkContext.broadcast(table)
    names = rows.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, hashes = batch.column("items"), batch.column("_h").flatten().to_numpy(zero_copy_only=False)
            places = _bits(hashes)
            set_bits = (shipped.value[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)
            inside = pa.array(set_bits.all(axis=1))
            parent = pc.list_parent_indices(lists).filter(inside).to_numpy(zero_copy_only=False)
            ends = np.searchsorted(parent, np.arange(len(lists) + 1)).astype(np.int32)
            kept = pa.ListArray.from_arrays(pa.array(ends), lists.flatten().filter(inside))
            yield pa.RecordBatch.from_arrays([kept if n == "items" else batch.column(n) for n in names], names=names)

    hashes = F.transform("items", lambda x: F.xxhash64("field_name", x))
    return rows.withColumn("_h", hashes).mapInArrow(keep, rows.schema)
