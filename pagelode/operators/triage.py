"""Error policy as data."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode import schema as S


def fetch_outcome(status: Column, failure: Column | None = None) -> Column:
    """What to do about a download.

    ``failure`` names what went wrong where there was no answer: 'connection', 'timeout',
    'redirects' or anything else; null where there was an answer.
    """
    failure = F.lit(None).cast("string") if failure is None else failure
    return (
        F.when(failure == "redirects", "fatal")
        .when(failure.isNotNull(), "retry")
        .when(status == 404, "skip")
        .when((status == 429) | status.between(500, 599), "retry")
        .when(status >= 400, "fatal")
        .otherwise("ok"))


def recovery(kind: Column, status: Column) -> Column:
    """Whether a run goes on after an error of a kind."""
    goes_on = ((kind == "network") & F.coalesce(status.isin(404, 429), F.lit(False))
               | kind.isin("parsing", "validation"))
    return F.when(F.coalesce(goes_on, F.lit(False)), "continue").otherwise("stop")


def rejects(*branches: DataFrame) -> DataFrame:
    """All rejected rows in one table of ``url``, ``error_type`` and ``reason``.

    If a branch has a ``context``, the table has one as well: a map of what is known about the place of an error.
    """
    columns = [*S.REJECT_COLUMNS, *(["context"] if any("context" in b.columns for b in branches) else [])]
    none = F.lit(None).cast("map<string,string>").alias("context")
    return reduce(DataFrame.unionByName, [
        b.select(*[none if c == "context" and c not in b.columns else F.col(c) for c in columns]) for b in branches])


def context(**values: Column | str) -> Column:
    """A map of what is known about the place of an error; what is null is left out."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(v).cast("string").alias("value") if isinstance(v, str)
                                 else v.cast("string").alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def product_rejects(outcomes: DataFrame) -> DataFrame:
    """X3 of judged products: why each has failed, with its catalogue, its position and what came of its capture.

    ``capture`` is ``none`` for a detail page that was never captured, else the status of its newest capture.
    """
    capture = F.coalesce(F.concat(F.lit("status "), F.col("status_code").cast("string")), F.lit("none"))
    return outcomes.where(F.col("outcome") == "failed").select(
        F.col("detail_url").alias("url"), "error_type", "reason",
        context(capture=capture, catalogue="base_url", position="position").alias("context"))


def failed_pages(pages: DataFrame) -> DataFrame:
    """Pages that were not fetched well, as rejects."""
    status = F.coalesce(F.col("status_code").cast("string"), F.lit("none"))
    return pages.where(F.coalesce(F.col("status_code") != 200, F.lit(True))).select(
        "url", F.lit("network_errors").alias("error_type"),
        F.concat(F.lit("status "), status).alias("reason"))
