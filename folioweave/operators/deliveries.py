"""Repeated deliveries: the row that counts of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, received: str = "received_at", tie: str | None = None) -> DataFrame:
    """The last received row of each key.

    Rows received together are told apart by the column ``tie``, a hash of all
    their columns unless given, so
    the choice doesn't depend on the order of the rows. Rows with a null key
    are kept once for each distinct content. A null time is the earliest; no
    rows give none; the columns may have any names. Only the first row of a key in
    each partition is shuffled (a window group limit), so a key that is
    delivered very often makes no hot task.
    """
    content, alone, n = (_unused(df, c) for c in ("content", "alone", "n"))
    first = Window.partitionBy(key, alone).orderBy(F.col(received).desc_nulls_last(), content)
    return (
        df.withColumn(content, F.xxhash64(*[_hashable(df, c) for c in df.columns]) if tie is None else F.col(tie))
        .withColumn(alone, F.when(F.col(key).isNull(), F.col(content)))
        .withColumn(n, F.row_number().over(first))
        .filter(F.col(n) == 1)
        .drop(n, alone, content)
    )


#: Keys with several rows that are shipped to the tasks; more are joined by a shuffle.
MAX_SHIPPED_KEYS = 100_000


def latest_of_few(df: DataFrame, key: str, received: str = "received_at") -> DataFrame:
    """:func:`latest` where the rows are large and few keys have several.

    Only the rows of such keys, and those without a key, are shuffled; the
    others stay where they are read. Runs a query that reads the keys alone.
    """
    counted = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("n"))
    several = counted.filter("n > 1").select("_k")
    kinds, keys = several.schema, several.limit(MAX_SHIPPED_KEYS + 1).collect()
    if len(keys) <= MAX_SHIPPED_KEYS:
        several = F.broadcast(df.sparkSession.createDataFrame(keys, kinds))
    once = df.filter(F.col(key).isNotNull()).join(several, F.col(key) == F.col("_k"), "left_anti")
    again = df.filter(F.col(key).isNotNull()).join(several, F.col(key) == F.col("_k"), "left_semi")
    return once.unionByName(latest(again.unionByName(df.filter(F.col(key).isNull())), key, received))


def _unused(df: DataFrame, name: str) -> str:
    """A column name that the rows don't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _hashable(df: DataFrame, name: str) -> "F.Column":
    """Maps can't be hashed, so a column that holds any goes in as JSON."""
    col = F.col(f"`{name}`")
    return F.to_json(F.struct(col)) if "map<" in dict(df.dtypes)[name] else col
