"""Walks, counts and newest captures over a stream of pages or outcomes.

Each micro-batch leaves slim rows (the pages of its listing captures, the counts of its items) in a folder that
has the batch's number. A batch that is run again after a failure writes its folder again, so each counts once, however
often it has run. What is asked for is worked out of all folders by the steps that a batch job uses. Older folders can be
merged into one from time to time.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelode.operators import pagination as G
from pagelode.operators import stats as A
from pagelode.plans.storage import path_exists
from pagelode.sources.pages import latest_captures
from pagelode.streaming.pages import spread

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class BatchTables:
    """Tables whose rows are kept by the number of the batch they come from, in a folder that all machines share."""

    spark: SparkSession
    folder: str

    def put(self, name: str, batch: int, rows: DataFrame) -> None:
        """The rows of a batch, in place of those that an earlier attempt has left."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/_of_batch={batch}")

    def _merged_up_to(self, name: str) -> int:
        """The last batch of the newest merged table; -1 without one. A merged table counts once its marker is there."""
        path = f"{self.folder}/{name}.merged.done"
        if not path_exists(self.spark, path):
            return -1
        last = self.spark.read.schema("upto long").parquet(path).agg(F.max("upto")).first()[0]
        return -1 if last is None else last

    def rows(self, name: str) -> DataFrame:
        """All rows of a table, from the merged batches and those after them."""
        merged = self._merged_up_to(name)
        later = self.spark.read.parquet(f"{self.folder}/{name}").where(F.col("_of_batch") > merged).drop("_of_batch")
        if merged < 0:
            return later
        return self.spark.read.parquet(f"{self.folder}/{name}.merged/_upto={merged}").unionByName(later)

    def merge(self, name: str, upto: int, step: Step) -> None:
        """Put the batches up to ``upto`` into one table, reduced by ``step``, which must not change what later steps give.

        Batches that the stream has finished can be merged. Their own folders are no longer read; removing them is up
        to the caller.
        """
        merged = self._merged_up_to(name)
        if upto <= merged:
            return
        parts = self.spark.read.parquet(f"{self.folder}/{name}").where(
            (F.col("_of_batch") > merged) & (F.col("_of_batch") <= upto)).drop("_of_batch")
        if merged >= 0:
            parts = parts.unionByName(self.spark.read.parquet(f"{self.folder}/{name}.merged/_upto={merged}"))
        step(parts).write.mode("overwrite").parquet(f"{self.folder}/{name}.merged/_upto={upto}")
        self.spark.createDataFrame([(upto,)], "upto long").coalesce(1).write.mode("append").parquet(
            f"{self.folder}/{name}.merged.done")


def keep_batches(stream: DataFrame, steps: dict[str, Step], tables: BatchTables, checkpoint: str,
                 available_now: bool = True, tasks: int | None = None) -> StreamingQuery:
    """Run ``steps`` on every micro-batch of a stream and keep what they give, by table and batch.

    ``tasks`` share the rows of a batch, where its files are fewer.
    """
    def handle(batch: DataFrame, number: int) -> None:
        rows = spread(batch, tasks)
        for name, step in steps.items():
            tables.put(name, number, step(rows))

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# --- walks -----------------------------------------------------------------------

def newest_pages(slim: DataFrame) -> DataFrame:
    """The newest capture of each page number, which is all that a walk looks at."""
    return latest_captures(slim, "base_url", "page_no")


def listing_step(listing_of: Step) -> Step:
    """The rows that a batch of pages leaves for walks; ``listing_of`` parses its listing pages."""
    return lambda pages: newest_pages(G.slim_pages(listing_of(pages)))


def walked_pages(tables: BatchTables, name: str, start_page: int = 1) -> DataFrame:
    """L15 over all that the stream has brought so far."""
    return G.walk_slim(tables.rows(name), start_page)


# --- counts ----------------------------------------------------------------------

def statistics_so_far(tables: BatchTables, name: str) -> DataFrame:
    """A1 out of the ``partial_statistics`` of the batches."""
    return A.merged_statistics(tables.rows(name))


def checkpoints_so_far(tables: BatchTables, name: str, by: tuple[str, ...] = (), **options) -> DataFrame:
    """A3 out of the ``batch_sums`` of the stream's batches."""
    return A.checkpoints(A.merged_sums(tables.rows(name), by), by=by, **options)
