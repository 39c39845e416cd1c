"""Listings joined to their detail pages."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode import schema as S
from pagelode.functions.text import blank_to_null, iso_text
from pagelode.operators.detail import invalid_reason
from pagelode.plans.storage import written

# Product column <- listing column. The detail page wins in the first set, the listing in the second.
FILL_FROM_LISTING = {"brand": "brand", "model": "title"}
TAKE_FROM_LISTING = {
    "ram": "ram", "internal_storage": "storage", "screen_size": "display",
    "primary_camera_resolution": "main_camera", "battery_capacity": "battery",
    "operating_system": "os",
}

# Rows of one key that go to one task.
ROWS_PER_SALT = 100_000


def salted_keys(df: DataFrame, key: str, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Every key with more than ``rows_per_salt`` rows, with as many salts as it takes to stay below that.

    Counting combines rows before its shuffle.
    """
    return (df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > rows_per_salt)
            .select(key, F.ceil(F.col("count") / rows_per_salt).cast("int").alias("_salts")))


def join_many_to_one(many: DataFrame, one: DataFrame, key: str, how: str = "inner",
                     rows_per_salt: int = ROWS_PER_SALT, stored: bool = False) -> DataFrame:
    """Equi join of ``many`` to ``one``, which has each key at most once.

    ``many`` is written first and read twice from there: for the sizes of its keys, and to be joined. A caller who
    gives columns of a table that is ``stored`` already spares the writing.
    The rows of a frequent key go to salts by their content, as many as the key's size asks for, and its
    single partner is copied to each of them; any number of keys may be frequent. Rows without a key
    match nothing and are spread as well. Which keys are frequent decides where rows go, not what comes out.
    The table of frequent keys is joined in the way its size allows, which Spark decides when it is there.
    """
    many = many if stored else written(many)
    salts = salted_keys(many, key, rows_per_salt)
    content = F.xxhash64(*many.columns)
    left = many.join(salts, key, "left").withColumn("_salt", F.when(F.col(key).isNull(), content).otherwise(
        F.pmod(content, F.coalesce("_salts", F.lit(1)).cast("bigint")))).drop("_salts")
    copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_salts", F.lit(1)).cast("bigint") - 1)
    right = one.join(salts, key, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def _renamed(listings: DataFrame) -> DataFrame:
    return listings.select(*[F.col(c) if c == "detail_url" else F.col(c).alias(f"l_{c}")
                             for c in listings.columns])


def enriched(name: str) -> Column:
    """One product column of the joined row."""
    if name in FILL_FROM_LISTING:
        return F.coalesce(blank_to_null(F.col(name)), F.col(f"l_{FILL_FROM_LISTING[name]}"))
    if name in TAKE_FROM_LISTING:
        return F.coalesce(blank_to_null(F.col(f"l_{TAKE_FROM_LISTING[name]}")), F.col(name))
    if name == "image_url":
        return F.coalesce(blank_to_null(F.col("l_image_url")), F.col("image_url"))
    return F.col(name)


def enrich(listings: DataFrame, details: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Products of the listing with the specifications of their detail pages.

    ``details`` has one row per detail URL. A product listed twice comes out twice.
    """
    joined = join_many_to_one(_renamed(listings), details, "detail_url", "inner", rows_per_salt)
    return joined.select(*[enriched(c).alias(c) for c in S.PRODUCT_COLUMNS])


def unmatched(listings: DataFrame, details: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Products of the listing that no detail page was parsed for, as rejects.

    ``details`` has one row per detail URL, and only the URLs travel (``plans.catalogue.parsed_urls`` gives them without
    parsing a page), with a hash of the product that spreads the rows of a frequent one. ``judge`` with the status of captures tells a page
    that failed from one that was never captured.
    """
    with_url = listings.where(F.col("detail_url").isNotNull() & (F.col("detail_url") != ""))
    slim = with_url.select("detail_url", F.xxhash64(*listings.columns).alias("_content"))
    lost = join_many_to_one(slim, details.select("detail_url"), "detail_url", "left_anti",
                            rows_per_salt)
    nowhere = listings.where(F.col("detail_url").isNull() | (F.col("detail_url") == ""))
    return lost.select(
        F.col("detail_url").alias("url"), F.lit("network_errors").alias("error_type"),
        F.lit("no detail page").alias("reason"),
    ).unionByName(nowhere.select(
        F.lit(None).cast("string").alias("url"), F.lit("parsing_errors").alias("error_type"),
        F.lit("no detail url").alias("reason")))


def judge(listings: DataFrame, details: DataFrame, require_valid: bool = True,
          on_error: str = "reject", now: Column | None = None,
          rows_per_salt: int = ROWS_PER_SALT, stored: bool = False) -> DataFrame:
    """J1-J3 in one pass: every product of the listing with its outcome.

    Gives the product columns, ``outcome`` ('ok' or 'failed'), ``processed``, ``error_type`` and
    ``reason``. A detail row is judged before it is enriched, as a listing must not make a bad page
    good; ``require_valid=False`` lets bad pages through to be filled in. ``on_error='skeleton'``
    makes a row of URLs and a time for a product without a detail page, which is then judged too.
    Where ``details`` has a ``status_code``, rows of another status than 200 are captures that failed: they count as no
    detail page, and their status is handed on. ``stored`` tells that the listings are a table already.
    """
    with_status = "status_code" in details.columns
    parsed = details.withColumn("_parsed", F.col("status_code") == 200 if with_status else F.lit(True))
    joined = join_many_to_one(_renamed(listings), parsed, "detail_url", "left", rows_per_salt, stored)
    has_url = F.col("detail_url").isNotNull() & (F.col("detail_url") != "")
    found = F.coalesce(F.col("_parsed"), F.lit(False))
    skeleton = F.lit(on_error == "skeleton")
    if require_valid:
        # The image URL of a product comes from the listing and is part of what is judged.
        judged = joined.withColumn("image_url", enriched("image_url"))
        bad = invalid_reason()
    else:
        judged, bad = joined, F.lit(None).cast("string")
    def failed(kind: str, reason: Column) -> Column:
        return F.struct(F.lit(kind).alias("error_type"), reason.alias("reason"))

    failure = (
        F.when(~has_url, failed("parsing_errors", F.lit("no detail url")))
        .when(~found & ~skeleton, failed("network_errors", F.lit("no detail page")))
        .when(bad.isNotNull(), failed("validation_errors", bad)))
    stamp = F.current_timestamp() if now is None else now
    values = {c: enriched(c) for c in S.PRODUCT_COLUMNS}
    values["scraped_at"] = F.coalesce("scraped_at", F.when(~found, iso_text(stamp)))
    extra = [F.col(f"l_{c}").alias(c) for c in ("base_url", "position") if c in listings.columns]
    extra += [F.col("status_code")] if with_status else []
    return judged.withColumn("_failure", failure).select(
        *extra, *[values[c].alias(c) for c in S.PRODUCT_COLUMNS],
        F.when(F.col("_failure").isNull(), "ok").otherwise("failed").alias("outcome"),
        has_url.alias("processed"), "_failure.error_type", "_failure.reason")
