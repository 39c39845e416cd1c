"""Counts about a run."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode import schema as S


def partial_statistics(outcomes: DataFrame) -> DataFrame:
    """The counts of A1 for a part of a run."""
    return outcomes.agg(
        F.count("*").alias("total_found"), F.count_if("processed").alias("processed"),
        F.count_if(F.col("outcome") == "ok").alias("successful"), F.count_if(F.col("outcome") != "ok").alias("failed"))


def merged_statistics(parts: DataFrame) -> DataFrame:
    """A1 of a run out of the counts of its parts."""
    names = ("total_found", "processed", "successful", "failed")
    whole = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in names])
    return whole.withColumn("success_rate", F.lit(100.0) * F.col("successful") / F.greatest("processed", F.lit(1)))


def run_statistics(outcomes: DataFrame) -> DataFrame:
    """A1: one row of totals over ``outcome`` and ``processed``.

    A product without a detail URL has failed but was not processed.
    """
    return merged_statistics(partial_statistics(outcomes))


def error_counts(errors: DataFrame, by: str = "error_type") -> DataFrame:
    """A2: errors per known category; categories without any do not show."""
    return errors.where(F.col(by).isin(*S.ERROR_TYPES)).groupBy(by).agg(F.count("*").alias("n"))


def batch_sums(outcomes: DataFrame, ok: Column, position: str = "position",
               batch_size: int = S.BATCH_SIZE, by: tuple[str, ...] = ()) -> DataFrame:
    """The counts of A3: items, good and bad ones of every batch that has any. Those of parts of a run can be added."""
    batch = F.ceil(F.col(position) / batch_size).cast("bigint")
    return outcomes.groupBy(*by, batch.alias("batch")).agg(
        F.count_if(ok).alias("ok"), F.count_if(~ok).alias("bad"), F.count("*").alias("items"))


def merged_sums(parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The counts of every batch out of those of parts of a run."""
    return parts.groupBy(*by, "batch").agg(*[F.sum(c).alias(c) for c in ("ok", "bad", "items")])


def checkpoints(sums: DataFrame, position: str = "position", batch_size: int = S.BATCH_SIZE, by: tuple[str, ...] = (),
                batches_per_chunk: int = 10_000) -> DataFrame:
    """A3 out of the counts of batches.

    Running sums go over chunks of batches, each its own window group, and over the chunk totals, of which there is
    one per half a million items at the defaults.
    """
    chunked = sums.withColumn(
        "chunk", F.floor((F.col("batch") - 1) / batches_per_chunk).cast("bigint"))
    before_chunk = Window.partitionBy(*by).orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    chunks = (chunked.groupBy(*by, "chunk").agg(F.sum("ok").alias("ok_in"), F.sum("bad").alias("bad_in"))
              .withColumn("ok_before", F.coalesce(F.sum("ok_in").over(before_chunk), F.lit(0)))
              .withColumn("bad_before", F.coalesce(F.sum("bad_in").over(before_chunk), F.lit(0)))
              .drop("ok_in", "bad_in"))
    running = Window.partitionBy(*by, "chunk").orderBy("batch").rowsBetween(
        Window.unboundedPreceding, 0)
    totals = (chunked.withColumn("ok_sum", F.sum("ok").over(running))
              .withColumn("bad_sum", F.sum("bad").over(running)))
    # Only the last batch of a run can be short, and a short one is no checkpoint.
    return totals.join(chunks, [*by, "chunk"]).where(F.col("items") == batch_size).select(
        *by, (F.col("batch") * batch_size).alias(position),
        (F.col("ok_before") + F.col("ok_sum")).cast("bigint").alias("successful"),
        (F.col("bad_before") + F.col("bad_sum")).cast("bigint").alias("failed"))


def batch_checkpoints(outcomes: DataFrame, ok: Column, position: str = "position",
                      batch_size: int = S.BATCH_SIZE, by: tuple[str, ...] = (),
                      batches_per_chunk: int = 10_000) -> DataFrame:
    """A3: running totals at the end of every full batch of a run.

    ``position`` counts the items of a run (of every ``by`` group) from 1. Items are summed per
    batch first. No window group holds more than a chunk of batches, and no task sees the items of more than one.
    """
    return checkpoints(batch_sums(outcomes, ok, position, batch_size, by), position, batch_size, by, batches_per_chunk)


def page_counts(listings: DataFrame, by: tuple[str, ...] = ("page_no",)) -> DataFrame:
    """A4: products per page."""
    return listings.groupBy(*by).agg(F.count("*").alias("products"))


def distinct_keys(df: DataFrame, maps: Column) -> DataFrame:
    """A5: the keys that occur in a map column, one row each."""
    return df.select(F.explode(F.map_keys(maps)).alias("key")).distinct()
