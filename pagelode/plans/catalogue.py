"""The whole job: discover products, parse their pages, enrich, validate, export, sum up."""

from dataclasses import dataclass
from datetime import datetime
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode import schema as S
from pagelode.functions.text import clean_text
from pagelode.functions.urls import without_query
from pagelode.operators import listing as L
from pagelode.operators import pagination as G
from pagelode.operators.detail import parse_details
from pagelode.operators.enrich import judge
from pagelode.operators.stats import error_counts, run_statistics
from pagelode.operators.triage import product_rejects, rejects
from pagelode.plans.storage import StoredStages, shared_folder
from pagelode.sinks.export import export
from pagelode.sources.captures import newest_wanted
from pagelode.sources.pages import latest_captures


@dataclass
class RunResult:
    """What a run leaves: tables as DataFrames, and whether it reached its end.

    ``stages`` names the stored tables that this attempt has made.
    """

    success: bool
    statistics: DataFrame
    products: DataFrame
    rejects: DataFrame
    error_counts: DataFrame
    exports: DataFrame | None
    stages: list[str]


def _of_catalogue(pages: DataFrame, base_url: str | None) -> DataFrame:
    """Listing pages of one catalogue; the prefix reaches the scan, the exact test follows it."""
    if base_url is None:
        return pages
    return pages.where(F.startswith("url", F.lit(base_url))
                       & (without_query(F.col("url")) == base_url))


def discover_products(pages: DataFrame, max_products: int | None = None, start_page: int = 1,
                      base_url: str | None = None, site: str | None = None) -> DataFrame:
    """W1, first phase: product rows in walk order; ``position`` counts them from 1 per catalogue."""
    listing = L.listing_pages(_of_catalogue(pages, base_url), site)
    return _products_of(G.discover(listing, max_products, start_page))


def _products_of(pages_taken: DataFrame) -> DataFrame:
    taken = G.with_position(pages_taken)
    rows = L.explode_products(taken, ("base_url", "page_no", "products_before"))
    return rows.withColumn("position", F.col("products_before") + F.col("pos") + 1).drop(
        "products_before")


def product_details(pages: DataFrame, listings: DataFrame | None = None,
                    run_time: datetime | None = None, failed: bool = False) -> DataFrame:
    """W1, second phase: one parsed row per detail URL, the newest capture where there are several.

    ``listings``, a stored table, keeps all but the newest captures of its ``detail_url`` from being parsed; rows of some
    other URLs may come along, which a join to the listings drops. ``failed`` adds the newest captures that were not
    fetched well, as rows without values, and the column ``status_code``.
    """
    details = pages.where(F.col("kind") == "detail")
    if listings is not None:
        details = newest_wanted(details, listings)
    stamp = None if run_time is None else F.lit(run_time)
    parsed = parse_details(details, every_status=True, run_time=stamp).drop("valid")
    newest = latest_captures(parsed, "detail_url").drop("fetched_at")
    good = F.col("status_code") == 200
    if failed:
        return newest.withColumn("scraped_at", F.when(good, F.col("scraped_at")))
    return newest.where(good).drop("status_code")


def parsed_urls(pages: DataFrame) -> DataFrame:
    """The ``detail_url`` of every row that ``product_details`` gives, from the columns beside the page text.

    Of captures of the same time, one that was fetched well counts.
    """
    good = F.coalesce(F.col("status_code") == 200, F.lit(False))
    rows = pages.where(F.col("kind") == "detail").select(
        clean_text(F.col("url")).alias("detail_url"), "fetched_at", good.alias("good"))
    newest = rows.groupBy("detail_url").agg(F.max_by("good", F.struct("fetched_at", "good")).alias("good"))
    return newest.where("good").select("detail_url")


def judge_catalogue(pages: DataFrame, max_products: int | None = None, start_page: int = 1,
                    base_url: str | None = None, require_valid: bool = True,
                    on_error: str = "reject", site: str | None = None) -> DataFrame:
    """W1 without its export: every discovered product with its outcome."""
    listings = discover_products(pages, max_products, start_page, base_url, site)
    return judge(listings, product_details(pages), require_valid, on_error)


def run_catalogue(spark: SparkSession, pages: DataFrame, out_dir: str,
                  max_products: int | None = None, start_page: int = 1,
                  base_url: str | None = None, require_valid: bool = True,
                  on_error: str = "reject", site: str | None = None,
                  run_time: datetime | None = None, run_id: str | None = None) -> RunResult:
    """The whole run.

    ``max_products`` (per catalogue; none or 0 for all), ``start_page`` and ``base_url`` choose
    what to discover, ``out_dir`` takes the exports. A run without products, or without one that
    passes, ends without an export. Listing pages are read once, into a table that gives products,
    signals and rejects; rejects are those of the pages that the walk has reached.

    A run with a ``run_id`` that has been broken off goes on, when it is started again, from the tables that it has
    finished; its time stays that of its first attempt. Its parameters have to be the same, and so have the pages.
    """
    given = {"max_products": max_products, "start_page": start_page, "base_url": base_url, "require_valid": require_valid,
             "on_error": on_error, "site": site, "out_dir": out_dir}
    stages = StoredStages(spark, shared_folder(spark, f"runs/{run_id}") if run_id else None,
                          {k: None if v is None else str(v) for k, v in given.items()})
    run_time = datetime.fromisoformat(stages.value("time", lambda: (run_time or datetime.now()).isoformat()))
    listing = stages.table("listing", lambda: G.numbered_listing(
        L.listing_pages(_of_catalogue(pages, base_url), site, rejects=True)))
    reached = cache(lambda: G.reached_pages(listing, start_page))
    listings = stages.table("listings", lambda: _products_of(G.pages_with_products(reached(), max_products)))
    outcomes = stages.table("outcomes", lambda: judge(
        listings, product_details(pages, listings, run_time, failed=True), require_valid, on_error, stored=True))
    products = outcomes.where(F.col("outcome") == "ok").select(*S.PRODUCT_COLUMNS)
    refused = stages.table("rejects", lambda: rejects(product_rejects(outcomes), L.page_rejects(reached())))
    success = not products.isEmpty()
    exports = export(products, out_dir, run_time=run_time) if success else None
    success = success and exports.where(~F.col("success")).isEmpty()
    return RunResult(success, run_statistics(outcomes), products, refused, error_counts(refused),
                     exports, stages.made)
