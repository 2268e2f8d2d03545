"""Filling fixed-capacity containers: bounded-space online best-fit.

Items are packed where they are, in the partitions they come in, without a
shuffle. A packer holds a fixed number of open bins; a bitset has a bit for
every free space that some open bin has. An item goes to the bin with the
least space that still holds it; if there is none, a new bin is opened, and if
that is one too many, the fullest is closed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.session import repeatable

OPEN_BINS = 1024


class Packer:
    """Best-fit over at most ``open_bins`` open bins of one capacity."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0  # bit f is set while an open bin has f units free
        self.bins: dict[int, list[int]] = defaultdict(list)
        self.n_open = self.n_bins = 0

    def _take(self, space: int) -> int:
        found = self.bins[space]
        number = found.pop()
        if not found:
            self.free &= ~(1 << space)
        self.n_open -= 1
        return number

    def put(self, size: int) -> int:
        """Number of the bin for an item of ``size``, at most the capacity."""
        fitting = self.free >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.capacity, self.n_bins
            self.n_bins += 1
            if self.n_open >= self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)
        left = space - size
        self.free |= 1 << left
        self.bins[left].append(number)
        self.n_open += 1
        return number


def parts(size: int, capacity: int) -> list[int]:
    """An item's pieces: the whole if it fits, else full ones and the rest."""
    if size <= capacity:
        return [size]
    full, rest = divmod(size, capacity)
    return [capacity] * full + [rest] * bool(rest)


_PACKED = pa.schema(
    [("size_name", pa.string()), ("pack_id", pa.string()), ("item_id", pa.int64()), ("part_no", pa.int32()), ("n_units", pa.int64())]
)


def pack(items: DataFrame, capacities: dict[str, int], open_bins: int = OPEN_BINS) -> DataFrame:
    """Bins of every item for each capacity: size_name, pack_id, item_id, part_no, n_units.

    ``items`` has item_id and size. Every row comes out once for each capacity,
    in part 0, or in as many parts as an item needs that is larger than the
    capacity. Null and negative sizes count as 0, and items of size 0 are packed
    too. Repeated rows and null ids are items of their own. Pack names tell the
    partition and the bin; items that come out of a shuffle are written to the
    checkpoint folder first, so that a task that is run again gives the same.
    """
    if any(c < 1 for c in capacities.values()):
        raise ValueError("capacities must be positive")
    rows = repeatable(
        items.select(
            F.col("item_id").cast("bigint").alias("item_id"),
            F.greatest(F.coalesce(F.col("size").cast("bigint"), F.lit(0)), F.lit(0)).alias("size"),
        )
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id = TaskContext.get().partitionId()
        packers = {name: Packer(c, open_bins) for name, c in capacities.items()}
        for batch in batches:
            out: list[list] = [[] for _ in _PACKED]
            for item, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for name, packer in packers.items():
                    for no, n in enumerate(parts(size, packer.capacity)):
                        for column, x in zip(out, (name, f"{part_id}-{packer.put(n)}", item, no, n), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PACKED, strict=True)], schema=_PACKED)

    return rows.mapInArrow(place, "size_name STRING, pack_id STRING, item_id BIGINT, part_no INT, n_units BIGINT")


def fill_report(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """Use of the packs of each capacity: size_name, n_packs, n_units, max_units, fill (share of the room used)."""
    packs = packed.groupBy("size_name", "pack_id").agg(F.sum("n_units").alias("n"))
    per = packs.groupBy("size_name").agg(F.count("*").alias("n_packs"), F.sum("n").alias("n_units"), F.max("n").alias("max_units"))
    room = F.create_map(*[F.lit(x) for kv in capacities.items() for x in kv])[F.col("size_name")]
    return per.withColumn("fill", F.col("n_units") / (F.col("n_packs") * room))
