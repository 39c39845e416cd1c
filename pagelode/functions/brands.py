"""Brand names from product titles."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelode import schema as S
from pagelode.functions.binding import first_where, let, words
from pagelode.functions.text import NOT_SPACE, SPACE, title_case


def brand_from_title(title: Column) -> Column:
    """First known brand, in list order, found in the title, else its first word."""
    def known(lowered: Column) -> Column:
        return first_where(words(S.BRANDS), lambda name: F.contains(lowered, F.lower(name)))

    def renamed(name: Column) -> Column:
        return F.coalesce(*[F.when(name == old, new) for old, new in S.BRAND_ALIASES.items()], name)

    word = F.regexp_extract(title, f"^{SPACE}*({NOT_SPACE}+)", 1)
    return F.coalesce(
        let(let(F.lower(title), known), renamed),
        F.when(F.char_length(word) > 2, title_case(word)),
        F.lit("Unknown"),
    )


def listing_brand(brand: Column, title: Column) -> Column:
    """The brand a record states, unless that is empty or a number."""
    return F.when(brand.isNull() | brand.rlike(r"^\d*\z"), brand_from_title(title)).otherwise(brand)
