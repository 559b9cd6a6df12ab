"""New scenes as they arrive: the catalog search over a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from inundata.operators import catalog


def arrivals(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """Scene records of Parquet files that are added to a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def watch(stream: DataFrame, where: object, start: str, end: str, handle: Callable[[DataFrame], None], checkpoint: str, max_cloud: float = 30) -> StreamingQuery:
    """Runs the batch search on every lot of new scenes and hands its table to ``handle``; a lot is handled again after a failure."""

    def lot(df: DataFrame, _: int) -> None:
        found, _box = catalog.search(df, where, start, end, max_cloud)
        handle(catalog.as_table(found))

    return stream.writeStream.foreachBatch(lot).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
