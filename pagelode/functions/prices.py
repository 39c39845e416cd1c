"""Price text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelode.functions.text import blank_to_null
from pagelode.functions.binding import let


def price_digits(text: Column) -> Column:
    """First run of digits and commas, once the taka sign, points and tags are gone."""
    bare = F.regexp_replace(text, F.lit(r"[৳.]|\(Official\)|\(Unofficial\)"), F.lit(""))
    return let(F.regexp_extract(bare, r"(?U)([\d,]+)", 1), blank_to_null)


def whole_number(text: Column) -> Column:
    """Text of digits only as a number, else null."""
    return F.when(text.rlike(r"^[0-9]+\z"), text.try_cast("bigint"))


def not_whole_number(text: Column) -> Column:
    """What L8 leaves unchanged: text that is no whole number."""
    return F.when(whole_number(text).isNull(), text)
