"""Products and next-page signals of listing pages.

Every step works on one page at a time, so nothing here shuffles and all of it also runs on a
stream. Page text is read once and dropped before the products are spread over rows.
"""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode import schema as S
from pagelode.functions import html as H
from pagelode.functions.binding import built_once, evaluate_once, first_where, let
from pagelode.functions.brands import brand_from_title, listing_brand
from pagelode.functions.prices import not_whole_number, whole_number
from pagelode.functions.text import blank_to_null, title_case
from pagelode.functions.urls import image_url, join_url, page_number, site_of, without_query
from pagelode.operators.triage import context

_STRICT_JSON = {"allowSingleQuotes": "false"}
_PAYLOAD = "current_page string, last_page string, total_pages string, data array<string>"


# --- embedded catalogue ------------------------------------------------------

def _script_text(html: Column, pattern: str) -> Column:
    return F.regexp_extract(html, f"(?is){pattern}", 1)


def embedded_payloads(html: Column) -> Column:
    """Parsed catalogue objects of a page, in the order in which they are to be tried.

    The last pattern finds every text that the others find, so a page without it is done after one
    search, and equal texts are parsed once.
    """
    *special, general = S.OBJECT_PATTERNS

    def texts(any_text: Column) -> Column:
        found = F.array(*[_script_text(html, p) for p in special], any_text)
        return F.when(any_text == "", F.array().cast("array<string>")).otherwise(
            F.array_distinct(F.filter(found, lambda t: t != "")))

    return F.transform(let(_script_text(html, general), texts),
                       lambda t: F.from_json(t, _PAYLOAD, _STRICT_JSON))


def embedded_lists(html: Column) -> Column:
    """Parsed catalogue arrays of a page."""
    texts = F.filter(F.array(*[_script_text(html, p) for p in S.LIST_PATTERNS]), lambda t: t != "")
    return F.transform(texts, lambda t: F.from_json(t, "array<string>", _STRICT_JSON))


def is_product(record: Column) -> Column:
    """L4: an embedded record that is a product."""
    kind = F.try_element_at(record, F.lit("type"))
    title = F.try_element_at(record, F.lit("title"))
    words = "|".join(S.PRODUCT_WORDS)
    marked = F.lit(False)
    for key in S.PRODUCT_KEYS:
        marked = marked | F.map_contains_key(record, F.lit(key))
    return F.coalesce(
        F.map_contains_key(record, F.lit("slug"))
        & title.isNotNull()
        & (kind.isNull() | kind.isin("", "mobile"))
        & (F.lower(title).rlike(words) | marked),
        F.lit(False))


def listing_record(record: Column, site: Column) -> Column:
    """An embedded record as a product of the listing."""
    def text(key: str) -> Column:
        return F.try_element_at(record, F.lit(key))

    thumbnail = F.coalesce(blank_to_null(text("thamnail")), text("thumbnail"))
    values = {
        "title": text("title"),
        "slug": text("slug"),
        "detail_url": F.concat(site, F.lit(S.PRODUCT_PATH), text("slug")),
        "image_url": image_url(site, thumbnail),
        "brand": listing_brand(text("brand"), text("title")),
        "price_official": whole_number(text("price_official")),
        "price_unofficial": whole_number(text("price_unofficial")),
        "availability": text("avibility"),
        "price_official_text": not_whole_number(text("price_official")),
        "price_unofficial_text": not_whole_number(text("price_unofficial")),
    }
    return F.struct(*[values.get(name, text(name)).alias(name) for name, _ in S.LISTING_FIELDS])


def records_of(data: Column) -> Column:
    """Elements of a catalogue array as maps; anything but an object is left out."""
    parsed = F.transform(data, lambda t: F.from_json(t, "map<string,string>", _STRICT_JSON))
    return F.filter(parsed, lambda m: m.isNotNull())


def embedded_products(payloads: Column, lists: Column, site: Column) -> Column:
    """L1: products of the first catalogue that has any; null where none has."""
    def products(data: Column) -> Column:
        rows = F.transform(F.filter(records_of(data), is_product),
                           lambda m: listing_record(m, site))
        return F.filter(rows, lambda r: r["slug"] != "")

    catalogues = F.concat(F.transform(payloads, lambda p: p["data"]), lists)
    return first_where(F.transform(catalogues, products), lambda rows: F.size(rows) > 0)


# --- anchors -------------------------------------------------------------------

def page_links(markup: Column) -> Column:
    """Anchors of a page that lead to a product or to a numbered page."""
    def link(piece: Column) -> Column:
        tag, rest = H.tag_and_content(piece)
        body = H.text_before_close(rest, "a")
        return F.struct(
            H.attribute(tag, "href").alias("href"),
            H.attribute(tag, "title").alias("title"),
            body.alias("body"))

    pieces = H.pieces_after(markup, r"<(?i:a)(?=\s)")
    wanted = F.filter(pieces, lambda p: F.contains(p, F.lit(S.PRODUCT_PATH))
                      | F.contains(p, F.lit("page=")))
    return F.filter(F.transform(wanted, link), lambda a: a["href"].isNotNull())


def anchor_products(links: Column, site: Column) -> Column:
    """L2: products of the anchors whose target contains the product path."""
    def slug_of(link: Column) -> Column:
        tail = F.substring_index(link["href"], S.PRODUCT_PATH, -1)
        return F.regexp_replace(tail, F.lit(r"^/+|/+$"), F.lit(""))

    def product(link: Column) -> Column:
        def build(known: Column) -> Column:
            empty = {name: F.lit(None).cast(kind) for name, kind in S.LISTING_FIELDS}
            values = empty | {
                "title": known["title"],
                "slug": known["slug"],
                "detail_url": join_url(site, link["href"]),
                "image_url": known["image_url"],
                "brand": brand_from_title(known["title"]),
            }
            return F.struct(*[values[name].alias(name) for name, _ in S.LISTING_FIELDS])

        slug = slug_of(link)
        tag = F.regexp_extract(link["body"], r"(?s)<(?i:img)(\s.*)", 1)
        return let(
            F.struct(
                slug.alias("slug"),
                F.coalesce(
                    blank_to_null(link["title"]),
                    blank_to_null(H.tight_text(link["body"])),
                    title_case(F.replace(slug, F.lit("-"), F.lit(" ")))).alias("title"),
                let(tag, lambda t: image_url(site, F.coalesce(
                    blank_to_null(H.attribute(t, "src")),
                    H.attribute(t, "data-src")))).alias("image_url")),
            build)

    to_products = F.filter(links, lambda a: F.contains(a["href"], F.lit(S.PRODUCT_PATH))
                           & (slug_of(a) != ""))
    return F.transform(to_products, product)


# --- filters -------------------------------------------------------------------

def is_listed(product: Column) -> Column:
    """A product worth listing, and no advertisement."""
    return F.coalesce(
        (product["slug"] != "")
        & (F.char_length(product["title"]) >= 3)
        & ~F.lower(product["title"]).rlike("|".join(S.AD_WORDS))
        & F.contains(product["detail_url"], F.lit(S.PRODUCT_PATH)),
        F.lit(False))


def first_of_slug(products: Column) -> Column:
    """The first product of every slug of a page."""
    def firsts(rows: Column) -> Column:
        return let(F.transform(rows, lambda r: r["slug"]), lambda slugs: F.filter(
            rows, lambda r, i: F.array_position(slugs, r["slug"]) == i + F.lit(1)))

    return let(products, firsts)


# --- next-page signals -----------------------------------------------------------

def next_in_payload(payloads: Column) -> Column:
    """Whether the catalogue object says that a page follows."""
    def decision(p: Column) -> Column:
        current = p["current_page"].try_cast("bigint")
        last = F.coalesce(F.nullif(p["last_page"].try_cast("bigint"), F.lit(0)),
                          p["total_pages"].try_cast("bigint"))
        has_data = F.size(p["data"]) > 0
        counted = (current != 0) & (last != 0)
        return (F.when(counted, (current < last) & F.coalesce(has_data, F.lit(False)))
                .when(~F.coalesce(has_data, F.lit(False)), F.lit(False)))

    decisions = F.transform(payloads, decision)
    return F.coalesce(first_where(decisions, lambda d: d.isNotNull()), F.lit(False))


def next_in_links(links: Column, page_no: Column, base_url: Column, site: Column) -> Column:
    """Target of the first anchor to the next page; links that start a query come first."""
    def target(mark: str) -> Column:
        return first_where(F.transform(links, lambda a: a["href"]), lambda h: (
            F.contains(h, F.lit(mark))
            & F.contains(h, F.concat(F.lit("page="), (page_no + F.lit(1)).cast("string")))))

    return let(F.coalesce(target("?page="), target("page=")), lambda h: (
        F.when(F.startswith(h, F.lit("/")), join_url(site, h))
        .when(F.startswith(h, F.lit("?")), F.concat(base_url, h))
        .otherwise(h)))


def has_products(payloads: Column, links: Column, has_item_class: Column) -> Column:
    """Whether a page shows products at all."""
    return F.coalesce(
        F.exists(payloads, lambda p: F.size(p["data"]) > 0)
        | F.exists(links, lambda a: F.contains(a["href"], F.lit(S.PRODUCT_PATH)))
        | has_item_class,
        F.lit(False))


def _item_class(markup: Column) -> Column:
    """Whether an element has one of the item classes; the plain search spares most pages the other."""
    any_tag = "[a-z][a-z0-9-]*"
    return reduce(or_, [F.contains(markup, F.lit(c)) & markup.rlike(H.opening(any_tag, cls=c))
                        for c in S.ITEM_CLASSES])


@built_once
def page_finds() -> Column:
    """Catalogues and links of a page, from its column ``html``."""
    def finds(markup: Column) -> Column:
        return F.struct(
            embedded_payloads(F.col("html")).alias("payloads"),
            embedded_lists(F.col("html")).alias("lists"),
            page_links(markup).alias("links"),
            _item_class(markup).alias("has_item_class"))

    return let(H.element_markup(F.col("html")), finds)


@built_once
def page_products() -> Column:
    """Products of a scanned page. Anchors count only where no catalogue has any."""
    scan, site = F.col("scan"), F.col("site")
    found = F.coalesce(embedded_products(scan["payloads"], scan["lists"], site),
                       anchor_products(scan["links"], site))
    return first_of_slug(F.filter(found, is_listed))


def page_signal_up_to(max_guessed_pages: int | None) -> Column:
    """Where a scanned page says that the next one is; guesses end at ``max_guessed_pages``, if any."""
    scan, number, base = F.col("scan"), F.col("page_no"), F.col("base_url")
    following = F.concat(base, F.lit("?page="), (number + F.lit(1)).cast("string"))
    return F.coalesce(
        F.when(next_in_payload(scan["payloads"]), following),
        next_in_links(scan["links"], number, base, F.col("site")),
        F.when((F.lit(True) if max_guessed_pages is None else number < max_guessed_pages)
               & has_products(scan["payloads"], scan["links"], scan["has_item_class"]), following))


@built_once
def page_signal() -> Column:
    return page_signal_up_to(None)


# --- whole pages -------------------------------------------------------------------

def scan_listing_pages(pages: DataFrame, site: str | None = None) -> DataFrame:
    """Read listing pages once: their catalogue, their links and their next-page signals.

    Gives one row per page with ``url``, ``page_no``, ``base_url``, ``site``, ``fetched_at`` and
    the raw finds in ``scan``; the page text is gone. ``site`` sets the scheme and host that
    product links get; by default each page uses its own. A page that was not fetched well counts
    as one without any finds.
    """
    ready = pages.where(F.col("kind") == "listing").select(
        "url",
        F.coalesce("page_no", page_number(F.col("url"))).alias("page_no"),
        without_query(F.col("url")).alias("base_url"),
        (F.lit(site) if site else site_of(F.col("url"))).alias("site"),
        "fetched_at", "status_code",
        F.when(F.col("status_code") == 200, F.col("html")).alias("html"))

    return evaluate_once(ready, "scan", page_finds()).drop("html")


def listing_pages(pages: DataFrame, site: str | None = None, max_guessed_pages: int | None = None,
                  rejects: bool = False) -> DataFrame:
    """One row per listing page with its products and its next-page signal.

    Where nothing on a page tells of a next one, products alone do, up to page ``max_guessed_pages``
    if that is given. ``rejects`` adds what ``page_rejects`` needs: the status and the number of
    records without a title, out of the same scan.
    """
    scanned = scan_listing_pages(pages, site)
    signal = page_signal() if max_guessed_pages is None else page_signal_up_to(max_guessed_pages)
    values = [page_products().alias("products"), signal.alias("next_page_url")]
    if rejects:
        values.append(F.size(untitled_records(F.col("scan"))).alias("untitled"))
    more = ["status_code", F.coalesce("page.untitled", F.lit(0)).alias("untitled")] if rejects else []
    return evaluate_once(scanned, "page", F.struct(*values)).select(
        "url", "page_no", "base_url", "site", "fetched_at",
        F.coalesce("page.products", F.array()).alias("products"), "page.next_page_url", *more)


def explode_products(listing: DataFrame, keep: tuple[str, ...] = ("url", "page_no")) -> DataFrame:
    """Pages to product rows. Equal slugs on different pages stay."""
    renamed = [F.col(c).alias("page_url") if c == "url" else F.col(c) for c in keep]
    return listing.select(
        *renamed, F.posexplode("products").alias("pos", "product")
    ).select(*["page_url" if c == "url" else c for c in keep], "pos", "product.*")


def listing_rejects(pages: DataFrame, site: str | None = None) -> DataFrame:
    """Embedded records without a title, which no product row can be made of."""
    scanned = scan_listing_pages(pages, site)
    return scanned.select("url", F.explode(untitled_records(F.col("scan"))).alias("record")).select(
        "url", F.lit("parsing_errors").alias("error_type"),
        F.lit("record without a title").alias("reason"))


def untitled_records(scan: Column) -> Column:
    """The records of a page's catalogues, objects and arrays, whose title is null."""
    none = F.array().cast("array<map<string,string>>")
    data = F.concat(F.transform(scan["payloads"], lambda p: p["data"]), scan["lists"])
    return F.filter(
        F.flatten(F.transform(data, lambda d: F.coalesce(records_of(d), none))),
        lambda m: F.map_contains_key(m, F.lit("title")) & F.try_element_at(m, F.lit("title")).isNull())


def page_rejects(listing: DataFrame) -> DataFrame:
    """Rejects of pages that ``listing_pages`` has read with ``rejects``: failed pages, untitled records."""
    failed = F.coalesce(F.col("status_code") != 200, F.lit(True))
    status = F.concat(F.lit("status "), F.coalesce(F.col("status_code").cast("string"), F.lit("none")))
    found = F.when(failed, F.array(F.struct(F.lit("network_errors").alias("error_type"), status.alias("reason")))).otherwise(
        F.array_repeat(F.struct(F.lit("parsing_errors").alias("error_type"),
                                F.lit("record without a title").alias("reason")), F.col("untitled")))
    place = context(catalogue="base_url", page="page_no", status="status_code").alias("context")
    return listing.select("url", place, F.explode(found).alias("r")).select("url", "r.error_type", "r.reason", "context")
