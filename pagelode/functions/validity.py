"""Checks on single values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{8})"
_CLOCK = (r"(?:[01]\d|2[0-3])(?::[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?"
          r"|[0-5]\d(?:[0-5]\d(?:[.,]\d+)?)?)?")
_ZONE = r"(?:Z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:\.\d+)?)?)?)?"


def is_iso_timestamp(text: Column) -> Column:
    """an ISO calendar date, or a date with a time and perhaps a zone (``Z`` included).

    ISO week dates count as invalid.
    """
    shaped = text.rlike(rf"(?s)^{_DATE}(?:.{_CLOCK}{_ZONE})?\z")
    day = F.substr(F.replace(F.substr(text, F.lit(1), F.lit(10)), F.lit("-"), F.lit("")),
                   F.lit(1), F.lit(8))
    real = F.concat_ws("-", F.substr(day, F.lit(1), F.lit(4)), F.substr(day, F.lit(5), F.lit(2)),
                       F.substr(day, F.lit(7), F.lit(2))).try_cast("date")
    return F.coalesce(shaped & real.isNotNull() & (F.substr(day, F.lit(1), F.lit(4)) != "0000"),
                      F.lit(False))
