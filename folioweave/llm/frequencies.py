"""Frequency of every distinct term: a range-partitioned external sort and a run-length scan.

Pairs of term and record are range-partitioned by (field, term, record), so a
term that is in very many records is spread over many tasks while equal pairs
stay together; Spark's sort spills. A scan of each sorted partition counts the
runs of a term and of a pair. The partial counts of a term, one a partition
that it reaches into, are then added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.session import checkpoint

_RUNS = pa.schema([("field_name", pa.string()), ("term", pa.string()), ("n_occurrences", pa.int64()), ("n_records", pa.int64())])


def _starts(columns: list[pa.Array], before: tuple | None) -> np.ndarray:
    """Where a row differs from the one before it; ``before`` is the row before the first."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    for c in columns:
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    new[0] = before is None or tuple(c[0].as_py() for c in columns) != before
    return new


def scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each run of (field, term) in rows sorted by field, term, record.

    A run cut by the end of a batch gives a row for each part; the distinct
    records of the parts are counted once.
    """
    before: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        field, word, record = (batch.column(i) for i in range(3))
        new_pair = _starts([field, word, record], before)
        new_term = _starts([field, word], before and before[:2])
        new_term[0] = True  # each batch gives its own partial counts
        at = np.flatnonzero(new_term)
        yield pa.RecordBatch.from_arrays(
            [
                field.take(pa.array(at)),
                word.take(pa.array(at)),
                pa.array(np.diff(np.append(at, batch.num_rows)).astype(np.int64)),
                pa.array(np.add.reduceat(new_pair.astype(np.int64), at)),
            ],
            schema=_RUNS,
        )
        before = (field[-1].as_py(), word[-1].as_py(), record[-1].as_py())


def term_frequencies(pairs: DataFrame) -> DataFrame:
    """How often each term occurs and in how many records: field_name, term, n_occurrences, n_records.

    ``pairs`` has field_name, term and record, one row an occurrence; rows with
    a null in any of them don't count, repeated rows count each, an empty table
    gives no rows. Terms may be of any length. Other columns are not looked at.
    """
    keys = ["field_name", "term", "record"]
    rows = pairs.select(F.col("field_name").cast("string"), F.col("term").cast("string"), F.col("record").cast("string"))
    rows = rows.na.drop().repartitionByRange(*keys).sortWithinPartitions(*keys)
    runs = rows.mapInArrow(scan_runs, "field_name STRING, term STRING, n_occurrences BIGINT, n_records BIGINT")
    return runs.groupBy("field_name", "term").agg(
        F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records")
    )


def record_terms(records: DataFrame) -> tuple[DataFrame, Column]:
    """:func:`term_frequencies` of whole records, and the number of all records, as a column.

    ``records`` has record and labels, an array of (field_name, terms); rows
    with a null record don't count. Each record brings one more pair, of no field
    and no term, so that its records are counted in the same pass. Writes the
    counts to the checkpoint folder, as the number is taken from them.
    """
    kind = "ARRAY<STRUCT<field_name: STRING, terms: ARRAY<STRING>>>"
    every = F.array(F.struct(F.lit("").alias("field_name"), F.array(F.lit("")).alias("terms"))).cast(kind)
    labels = F.coalesce(F.col("labels").cast(kind), F.array().cast(kind))
    pairs = records.select("record", F.inline(F.concat(every, labels)))
    counts = checkpoint(term_frequencies(pairs.select("field_name", F.explode("terms").alias("term"), "record")))
    n_all = counts.filter("field_name = '' AND term = ''").agg(F.coalesce(F.max("n_records"), F.lit(0))).scalar()
    return counts.filter("field_name <> ''"), n_all


def marked(
    counts: DataFrame, n_all: Column, least: int = 3, rare_one_in: int = 5000, common_percent: int = 40
) -> DataFrame:
    """``counts`` with ``mark``: rare, common or null.

    Rare: in fewer than ``least`` records or in fewer than one in
    ``rare_one_in`` of ``n_all``. Common: not rare, in more than
    ``common_percent`` percent of them.
    """
    n = F.col("n_records")
    rare = (n < least) | (n * rare_one_in < n_all)
    return counts.withColumn("mark", F.when(rare, "rare").when(n * 100 > n_all * common_percent, "common"))
