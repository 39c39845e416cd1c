"""The price block of a detail page."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode import schema as S
from pagelode.functions import html as H
from pagelode.functions.binding import built_once, evaluate_once, let
from pagelode.functions.prices import price_digits
from pagelode.functions.text import SPACE, strip

_VARIANTS = "array<struct<variant:string,price:string>>"


def main_prices(block: Column) -> Column:
    """Official and unofficial price; the last one that can be read wins."""
    def last_price(prices: Column, official: bool) -> Column:
        fits = F.filter(prices, lambda p: (p["official"] == official) & p["price"].isNotNull())
        return F.try_element_at(fits, F.lit(-1))["price"]

    texts = F.transform(H.elements(block, "span", cls=S.PRICE_CLASS), H.tight_text)
    prices = F.transform(texts, lambda t: F.struct(
        F.when(F.contains(t, F.lit("(Official)")), True)
        .when(F.contains(t, F.lit("(Unofficial)")), False).alias("official"),
        price_digits(t).alias("price")))
    return let(prices, lambda p: F.struct(
        last_price(p, True).alias("price_official"),
        last_price(p, False).alias("price_unofficial")))


def old_price(block: Column) -> Column:
    """The price before a discount."""
    return price_digits(H.tight_text(H.first_element(block, "span", cls=S.OLD_PRICE_CLASS)))


def savings(block: Column) -> Column:
    """Amount saved, with the percentage where there is one."""
    amount = H.tight_text(H.first_element(block, "span", cls=S.SAVED_AMOUNT_CLASS))
    percent = H.tight_text(H.first_element(block, "span", cls=S.SAVED_PERCENT_CLASS))
    return let(amount, lambda a: F.when(a.isNotNull(), F.concat_ws(" ", a, percent)))


def variants(block: Column) -> Column:
    """The variants that have both a name and a price."""
    def variant(link: Column) -> Column:
        return F.struct(
            H.tight_text(H.first_element(link, "span", cls=S.VARIANT_NAME_CLASS)).alias("variant"),
            price_digits(H.tight_text(
                H.first_element(link, "span", cls=S.VARIANT_PRICE_CLASS))).alias("price"))

    links = H.elements(H.first_element(block, "div", cls=S.VARIANT_BLOCK_CLASS), "a",
                       cls=S.VARIANT_LINK_CLASS)
    found = F.filter(F.transform(links, variant),
                     lambda v: (v["variant"] != "") & v["price"].isNotNull())
    return F.coalesce(found, F.array().cast(_VARIANTS))


def price_date(block: Column) -> Column:
    """The text after ``Updated on:``."""
    text = H.tight_text(H.first_element(block, "span", cls=S.PRICE_DATE_CLASS))
    found = F.regexp_extract(text, f"(?d)Updated on:{SPACE}*(.+)", 1)
    return let(found, lambda d: F.when(d != "", strip(d)))


def price_block(markup: Column) -> Column:
    """All prices of a page; nulls and no variants where it has no price block."""
    def prices(block: Column) -> Column:
        return let(main_prices(block), lambda main: F.struct(
            main["price_official"].alias("price_official"),
            main["price_unofficial"].alias("price_unofficial"),
            old_price(block).alias("price_old"),
            savings(block).alias("price_savings"),
            variants(block).alias("price_variants"),
            price_date(block).alias("price_updated")))

    return let(H.first_element(markup, "div", cls=S.PRICE_BLOCK_CLASS), prices)


@built_once
def page_prices() -> Column:
    """The prices of a detail page, from its column ``html``."""
    return let(H.element_markup(F.col("html")), price_block)


def price_table(pages: DataFrame) -> DataFrame:
    """D7-D12 as a table: one row per detail page that was fetched well."""
    parsed = pages.where((F.col("kind") == "detail") & (F.col("status_code") == 200))
    return evaluate_once(parsed.select("url", "html"), "_prices", page_prices()).select(
        "url", "_prices.*")


def variant_table(prices: DataFrame) -> DataFrame:
    """D11 flat: one row per variant, one with nulls for a page that has none."""
    return prices.select("url", F.explode_outer("price_variants").alias("v")).select(
        "url", "v.variant", "v.price")
