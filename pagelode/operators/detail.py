"""Specifications of detail pages: long cells, wide products, conforming and validation.

Like the listing steps, everything up to the wide row works on one page at a time.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode import schema as S
from pagelode.functions import html as H
from pagelode.functions.binding import built_once, evaluate_once, let, words
from pagelode.functions.text import clean_text, iso_text, missing_to_null
from pagelode.functions.urls import is_valid_url
from pagelode.functions.validity import is_iso_timestamp
from pagelode.operators.prices import price_block

_CELL = "array<struct<cat_pos:int,row_pos:int,category:string,label:string,value:string>>"


def spec_section(markup: Column) -> Column:
    """Content of the specification section; null where a page has none."""
    return H.first_element(markup, "section", id=S.SPEC_SECTION_ID)


def spec_blocks(section: Column) -> Column:
    """Contents of the category blocks of the section."""
    return H.elements(section, "div", classes=S.SPEC_BLOCK_CLASSES)


def spec_cells(markup: Column) -> Column:
    """The labelled values of a page in document order.

    Only rows with exactly two cells, a label and a value that is not a missing-value token count.
    """
    def cells_of(block: Column, cat_pos: Column) -> Column:
        heading = H.first_element(block, "h3", cls=S.SPEC_HEADING_CLASS)
        category = F.coalesce(H.tight_text(heading), F.lit("Unknown"))
        rows = H.table_rows(H.first_element(block, "table", cls=S.SPEC_TABLE_CLASS))

        def cell(row: Column, row_pos: Column, name: Column) -> Column:
            return let(H.row_cells(row), lambda c: F.when(F.size(c) == 2, F.struct(
                cat_pos.alias("cat_pos"), row_pos.alias("row_pos"), name.alias("category"),
                H.tight_text(c[0]).alias("label"),
                missing_to_null(H.spaced_text(c[1])).alias("value"))))

        return let(F.struct(category.alias("name"), rows.alias("rows")), lambda b: F.filter(
            F.transform(b["rows"], lambda r, i: cell(r, i, b["name"])),
            lambda c: c["value"].isNotNull() & (c["label"] != "")))

    cells = F.transform(spec_blocks(spec_section(markup)), cells_of)
    kept = F.filter(cells, lambda block: block.isNotNull())
    return F.coalesce(F.flatten(kept), F.array()).cast(_CELL)


def field_of_label(label: Column) -> Column:
    """The column of a label, null for a label that is not on the list."""
    return F.get(words(S.SPEC_FIELDS), F.array_position(words(S.SPEC_LABELS), label) - F.lit(1))


def field_values(cells: Column) -> Column:
    """For every column in turn the last value that a page gives it."""
    def lookup(found: Column) -> Column:
        return F.transform(
            words(S.SPEC_LABELS),
            lambda label: F.get(found["values"], F.array_position(found["labels"], label) - F.lit(1)))

    backwards = F.reverse(cells)
    return let(F.struct(F.transform(backwards, lambda c: c["label"]).alias("labels"),
                        F.transform(backwards, lambda c: c["value"]).alias("values")), lookup)


@built_once
def page_finds() -> Column:
    """All that a detail page gives, from its column ``html``."""
    def finds(markup: Column) -> Column:
        return F.struct(let(spec_cells(markup), field_values).alias("fields"),
                        price_block(markup).alias("prices"))

    return let(H.element_markup(F.col("html")), finds)


@built_once
def page_cells() -> Column:
    """The specification cells of a detail page, from its column ``html``."""
    return let(H.element_markup(F.col("html")), spec_cells)


# --- DataFrame steps -------------------------------------------------------------

def parsable(pages: DataFrame) -> DataFrame:
    """Detail pages that were fetched well."""
    return pages.where((F.col("kind") == "detail") & (F.col("status_code") == 200))


def long_specs(pages: DataFrame) -> DataFrame:
    """One row per specification cell of known label."""
    cells = parsable(pages).select("url", F.explode(page_cells()).alias("cell"))
    return (cells.select("url", "cell.*")
            .select("url", "cat_pos", "row_pos", "category", "label",
                    field_of_label(F.col("label")).alias("field"), "value")
            .where(F.col("field").isNotNull()))


def widen(specs: DataFrame) -> DataFrame:
    """D6 on a long table: one row per URL, the last value of a field wins.

    Values are reduced per task before the shuffle, so a URL with very many rows sends few.
    """
    last = F.max_by("value", F.struct("cat_pos", "row_pos"))
    return specs.groupBy("url").pivot("field", list(S.SPEC_FIELDS)).agg(last)


def parse_details(pages: DataFrame, every_status: bool = False, run_time: Column | None = None) -> DataFrame:
    """Detail pages to wide, conformed rows with a ``valid`` flag.

    ``image_url`` is null here, since only a listing knows it; ``fetched_at`` stays so that
    captures can be told apart. ``every_status`` also gives rows, unparsed, for pages that were not
    fetched well, and the column ``status_code``. ``run_time`` stamps pages without a capture time.
    """
    if every_status:
        ready = pages.where(F.col("kind") == "detail").select(
            "url", "fetched_at", "status_code",
            F.when(F.col("status_code") == 200, F.col("html")).alias("html"))
    else:
        ready = parsable(pages).select("url", "fetched_at", "html")

    found = evaluate_once(ready, "_found", page_finds()).drop("html")
    extra = [c for c in ("fetched_at", "status_code") if c in ready.columns]
    fields = [f"_found.fields[{i}] AS {f}" for i, f in enumerate(S.SPEC_FIELDS)]
    wide = found.selectExpr("url", *extra, *fields, "_found.prices.*")
    # D13. Times come from the archive, so a rerun gives the same rows.
    wide = wide.withColumns({
        **{f: clean_text(F.col(f)) for f in ("price_old", "price_savings", "price_updated")},
        "detail_url": clean_text(F.col("url")),
        "image_url": F.lit(None).cast("string"),
        "scraped_at": iso_text(F.col("fetched_at") if run_time is None else F.coalesce("fetched_at", run_time)),
    }).select(*S.PRODUCT_COLUMNS, *extra)
    return wide.withColumn("valid", is_valid_product())


def conform(df: DataFrame, now: Column | None = None) -> DataFrame:
    """known columns only, text cleaned, the capture time filled in where it is missing."""
    have = set(df.columns)
    now = F.current_timestamp() if now is None else now

    def value(name: str) -> Column:
        if name == "price_variants":
            return (F.col(name) if name in have else F.lit(None)).cast(S.VARIANTS_TYPE)
        if name not in have or df.schema[name].dataType.simpleString() != "string":
            text = F.col(name).cast("string") if name in have else F.lit(None).cast("string")
        else:
            text = clean_text(F.col(name))
        return F.coalesce(text, iso_text(now)) if name == "scraped_at" else text

    return df.select(*[value(c).alias(c) for c in S.PRODUCT_COLUMNS])


#: What ``invalid_reason`` looks at.
CHECKED_COLUMNS = ("brand", "model", "scraped_at", "detail_url", "image_url")


def invalid_reason() -> Column:
    """why a product row is invalid; null where it is valid."""
    def missing(name: str) -> Column:
        return F.col(name).isNull() | (F.col(name) == "")

    checks = [
        ("no brand", missing("brand")),
        ("no model", missing("model")),
        ("bad scraped_at", ~missing("scraped_at") & ~is_iso_timestamp(F.col("scraped_at"))),
        ("bad detail_url", ~missing("detail_url") & ~is_valid_url(F.col("detail_url"))),
        ("bad image_url", ~missing("image_url") & ~is_valid_url(F.col("image_url"))),
    ]
    return reduce(lambda chain, check: chain.when(check[1], F.lit(check[0])),
                  checks, F.when(F.lit(False), F.lit(None).cast("string")))


def is_valid_product() -> Column:
    """F11."""
    return invalid_reason().isNull()


def valid_products(df: DataFrame) -> DataFrame:
    """the valid rows."""
    return df.where(is_valid_product())


def invalid_products(df: DataFrame) -> DataFrame:
    """the other rows, as rejects."""
    return df.select(F.col("detail_url").alias("url"), F.lit("validation_errors").alias("error_type"),
                     invalid_reason().alias("reason")).where(F.col("reason").isNotNull())


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """every row as one JSON object, nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))
