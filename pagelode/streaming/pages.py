"""The per-page steps on a stream of new pages.

They keep no state and append: listing products, specification cells, wide products and prices.
Steps that need a whole run (walks over pages, totals, newest captures) are batch steps.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagelode import schema as S


def stream_pages(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a page archive."""
    reader = spark.readStream.schema(S.PAGE_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def spread(rows: DataFrame, tasks: int | None) -> DataFrame:
    """Rows dealt to ``tasks`` tasks; as they are without a number.

    A micro-batch of few files has few tasks, and parsing a page costs far more than moving its text.
    """
    return rows if tasks is None else rows.repartition(tasks)


def append_stream(pages: DataFrame, step: Callable[[DataFrame], DataFrame], out: str,
                  checkpoint: str, available_now: bool = True, tasks: int | None = None) -> StreamingQuery:
    """Run a per-page step over a stream of pages and append its rows as Parquet.

    ``checkpoint`` is a folder that all machines share. ``tasks`` share the pages of a batch, where its files are fewer.
    """
    writer = (step(spread(pages, tasks)).writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start(out)
