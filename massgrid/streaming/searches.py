"""Searches whose masses arrive as a stream: planned in the tasks, joined with the stored peptides, each form answered once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from massgrid.operators.search import search_table
from massgrid.plans.ptm import Ptm


def search_stream(masses: DataFrame, peptides: DataFrame, path: str, checkpoint: str, ptms: list[Ptm] = (), ppm: tuple[int, int] = (10, 10), most_variable: int = 2) -> StreamingQuery:
    """Writes the peptidoforms of the arriving masses (column `mass`) to Parquet under `path`.

    A peptidoform is written once, however many masses, batches and restarts find it: the checkpoint holds what was
    answered, and the file sink takes each batch as a whole or not at all. Each batch scans the peptides once.
    """
    found = search_table(masses, peptides, ptms, ppm, most_variable)
    return found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
