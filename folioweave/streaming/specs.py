"""The same parsers over a stream of arriving files (beyond the reference).

All per-spec operators are row-local, so a stream needs no state or watermark.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.sources.specs import parse_format_specs, parse_structure_specs


def stream_specs(spark: SparkSession, path: str | os.PathLike, family: str, files_per_batch: int = 1000) -> DataFrame:
    """Streaming DataFrame of the specs in ``path``; broken files are quarantined.

    ``family`` is ``"format"`` or ``"structure"``.
    """
    parse = {"format": parse_format_specs, "structure": parse_structure_specs}[family]
    texts = (
        spark.readStream.schema("value STRING")
        .option("wholetext", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .text(os.fspath(path))
        .select(F.col("_metadata.file_path").alias("spec_id"), "value")
    )
    return parse(texts, on_error="quarantine")
