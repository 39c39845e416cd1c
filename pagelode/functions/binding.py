"""Helpers that make Spark evaluate an expensive expression once."""

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)


def first_where(values: Column, test) -> Column:
    """First element of ``values`` for which ``test`` holds, else null."""
    return F.get(F.filter(values, lambda v: test(v)), 0)


def last_where(values: Column, test) -> Column:
    """Last element of ``values`` for which ``test`` holds, else null."""
    return F.try_element_at(F.filter(values, lambda v: test(v)), F.lit(-1))


def words(values) -> Column:
    """Constant array of words, built in one call instead of one per word."""
    return F.split(F.lit("|".join(values)), r"\|")


def evaluate_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``value`` as a column that later steps read instead of computing it again.

    The generator keeps the optimizer from inlining ``value`` into every expression and filter
    that uses it.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def built_once(build):
    """Keep the column that ``build()`` makes for the rest of the session.

    The page expressions are long, and each of their nodes is a call to the JVM to make.
    """
    made: dict[SparkSession, Column] = {}

    @wraps(build)
    def get() -> Column:
        spark = SparkSession.active()
        if spark not in made:
            made.clear()
            made[spark] = build()
        return made[spark]

    return get
