"""Which listing pages of a catalogue count, and how many products of them.

A catalogue may have any number of pages, so no task sees all of one. Pages with their products are stored once. From
there on only slim rows move, one for each page: windows go over chunks of page numbers, then over the chunks of a
catalogue, of which there is one for a thousand pages. That gives each catalogue the page where its walk
ends, and each page the number of products before it. The pages that count are fetched by their row number at the end.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.plans.storage import written

#: Page numbers of a chunk: what one window holds, in rows of a few numbers.
PAGES_PER_CHUNK = 1024

_ROW, _COUNT, _TIE = "_row", "_products", "_tie"


def numbered_listing(listing: DataFrame) -> DataFrame:
    """Listing pages with row numbers, which hold once the rows are stored, and what walks need of their products."""
    tie = F.xxhash64(*[c for c in listing.columns if c not in ("base_url", "page_no")])
    return listing.select("*", F.monotonically_increasing_id().alias(_ROW),
                          F.size("products").cast("bigint").alias(_COUNT), tie.alias(_TIE))


def slim_pages(listing: DataFrame) -> DataFrame:
    """What a walk needs of listing pages, without their products."""
    return numbered_listing(listing).select("url", "base_url", "page_no", "fetched_at", "next_page_url", _COUNT, _TIE)


def walk_slim(slim: DataFrame, start_page: int = 1, max_pages: int | None = None) -> DataFrame:
    """L15 on the rows of ``slim_pages``, of any number of captures: pages with ``products`` (how many) and
    ``products_before``."""
    stored = written(slim.withColumn(_ROW, F.monotonically_increasing_id()))
    walked = _walk(stored, start_page, _last_page(start_page, max_pages)).where(F.col(_COUNT) > 0)
    return walked.select("url", "base_url", "page_no", F.col(_COUNT).alias("products"), "products_before")


def stored_listing(listing: DataFrame) -> DataFrame:
    """Listing pages as a table whose rows have numbers; as it is if it has them already."""
    return listing if _ROW in listing.columns else written(numbered_listing(listing))


@dataclass
class _Stops:
    """What ends a walk, as the first page number that does not count; null where a page ends none."""

    empty: Column
    last: Column


def _stops(empty_counts: bool, signals: bool) -> _Stops:
    number = F.col("page_no").cast("bigint")
    return _Stops(F.when(F.col(_COUNT) <= 0, number + (1 if empty_counts else 0)),
                  F.when(F.lit(signals) & F.col("_is_last"), number + 1))


def _page_rows(listing: DataFrame, start_page: int, last_page: int | None, stops: _Stops, per_chunk: int) -> DataFrame:
    """One slim row for each page number of each catalogue, its newest capture, with what is before it in its chunk."""
    in_range = listing.where(F.col("page_no") >= start_page)
    if last_page is not None:
        in_range = in_range.where(F.col("page_no") <= last_page)
    slim = in_range.select("base_url", "page_no", "fetched_at", _TIE, _ROW, _COUNT,
                           F.col("next_page_url").isNull().alias("_is_last"))
    # Of captures of one time the content decides, then the row number: equal ones count once.
    newest = F.max_by(F.struct(_ROW, _COUNT, "_is_last"), F.struct("fetched_at", _TIE, _ROW))
    one_each = slim.groupBy("base_url", "page_no").agg(newest.alias("v")).select("base_url", "page_no", "v.*")
    chunk = F.floor((F.col("page_no").cast("bigint") - start_page) / per_chunk)
    in_chunk = Window.partitionBy("base_url", "chunk").orderBy("page_no")
    return one_each.withColumn("chunk", chunk).select(
        "base_url", "chunk", "page_no", _ROW, F.greatest(F.col(_COUNT), F.lit(0).cast("bigint")).alias("n"),
        F.least(stops.empty, stops.last).alias("stop"),
        (F.row_number().over(in_chunk) == F.col("page_no") - start_page - F.col("chunk") * per_chunk + 1).alias("in_turn"),
        F.coalesce(F.sum(F.greatest(F.col(_COUNT), F.lit(0).cast("bigint"))).over(
            in_chunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_in_chunk"))


def _chunk_rows(pages: DataFrame, start_page: int, per_chunk: int) -> DataFrame:
    """One row for each chunk: products before it, and the first page of its catalogue that does not count."""
    chunks = pages.groupBy("base_url", "chunk").agg(
        F.min("stop").alias("stop"), F.sum("n").alias("n"), F.count_if("in_turn").alias("in_turn"))
    # A page number that the archive lacks ends the walk, as a failed download would.
    missing = F.when(F.col("in_turn") < per_chunk, start_page + F.col("chunk") * per_chunk + F.col("in_turn"))
    ordered = Window.partitionBy("base_url").orderBy("chunk")
    before = F.coalesce(F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    absent = F.when(F.row_number().over(ordered) != F.col("chunk") + 1, start_page + (F.row_number().over(ordered) - 1) * per_chunk)
    ends = chunks.select("base_url", "chunk", before.alias("before"), F.least("stop", missing, absent).alias("own_end"))
    return ends.withColumn("end", F.min("own_end").over(Window.partitionBy("base_url")))


def _walk(listing: DataFrame, start_page: int, last_page: int | None, *, empty_counts: bool = True, signals: bool = True,
          ends: bool = True, per_chunk: int = PAGES_PER_CHUNK) -> DataFrame:
    """The pages up to the end of each catalogue's walk, with ``products_before``; all pages if nothing ``ends`` it."""
    listing = stored_listing(listing)
    pages = written(_page_rows(listing, start_page, last_page, _stops(empty_counts, signals), per_chunk))
    chunks = _chunk_rows(pages, start_page, per_chunk).select(
        F.col("base_url").alias("_base"), F.col("chunk").alias("_chunk"), "before", "end")
    met = pages.join(chunks, F.col("base_url").eqNullSafe(F.col("_base")) & (F.col("chunk") == F.col("_chunk")))
    if ends:
        met = met.where(F.col("end").isNull() | (F.col("page_no") < F.col("end")))
    counted = met.select(F.col(_ROW).alias("_kept"),
                         (F.col("before") + F.col("before_in_chunk")).cast("bigint").alias("products_before"))
    return listing.join(counted, F.col(_ROW) == F.col("_kept")).drop("_kept")


def _last_page(start_page: int, max_pages: int | None) -> int | None:
    return None if max_pages is None else start_page + max_pages - 1


def reached_pages(listing: DataFrame, start_page: int = 1, max_pages: int | None = None) -> DataFrame:
    """The pages of a walk with the empty one that has ended it, if the archive has it.

    The pages are stored here, once. ``products_before`` tells how many products of the catalogue come before a page.
    """
    return _walk(listing, start_page, _last_page(start_page, max_pages)).drop(_ROW, _TIE)


def pages_with_products(reached: DataFrame, limit: int | None = None) -> DataFrame:
    """Of the pages that a walk has reached, those with products; ``limit`` products of a catalogue at most."""
    taken = reached.where(F.size("products") > 0).drop(_ROW, _COUNT, _TIE)
    return limit_products(taken, limit) if limit else taken


def take_pages(listing: DataFrame, start_page: int = 1, max_pages: int | None = None) -> DataFrame:
    """Pages in order while each has products and tells of a next one, with ``products_before``.

    ``max_pages`` ends the walk after so many pages of a catalogue; by default nothing but the pages do.
    """
    return pages_with_products(reached_pages(listing, start_page, max_pages))


def take_first(listing: DataFrame, n: int, start_page: int = 1) -> DataFrame:
    """Pages in order until ``n`` products are there; only an empty page ends the walk.

    Every page that counts has a product, so ``n`` pages are enough and only they are read.
    """
    return pages_with_products(_walk(listing, start_page, start_page + n - 1, signals=False), n)


def limit_products(taken: DataFrame, n: int) -> DataFrame:
    """First ``n`` products of every catalogue, cut out of the pages' arrays; no page is read for more than its own."""
    numbered = with_position(taken).where(F.col("products_before") < n)
    return numbered.withColumn("products", F.slice("products", F.lit(1), (F.lit(n) - F.col("products_before")).cast("int")))


def with_position(taken: DataFrame) -> DataFrame:
    """Add how many products of the catalogue come before a page, where a walk has not done so."""
    if "products_before" in taken.columns:
        return taken
    first = taken.agg(F.min("page_no")).first()[0]
    return _walk(taken, 1 if first is None else first, None, ends=False).drop(_ROW, _COUNT, _TIE)


def discover(listing: DataFrame, max_products: int | None = None, start_page: int = 1,
             max_pages: int | None = None) -> DataFrame:
    """Pages of the run: the full walk, cut to size; one rule however many products are asked for."""
    return pages_with_products(reached_pages(listing, start_page, max_pages), max_products)


def pages_by_chunk(listing: DataFrame, start_page: int = 1, per_chunk: int = PAGES_PER_CHUNK) -> DataFrame:
    """How many page rows each window of a walk holds, by catalogue and chunk."""
    rows = _page_rows(stored_listing(listing), start_page, None, _stops(True, True), per_chunk)
    return rows.groupBy("base_url", "chunk").agg(F.count("*").alias("pages"))
