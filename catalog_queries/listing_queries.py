"""Queries of the source and listing operators."""

from pyspark.sql import functions as F

from catalog_queries import render as R
from pagelode.functions import html as H
from pagelode.functions.binding import let
from pagelode.functions.brands import brand_from_title
from pagelode.functions.prices import not_whole_number, whole_number
from pagelode.functions.urls import image_url, join_url, page_number, site_of
from pagelode.operators import listing as L
from pagelode.operators import pagination as G
from pagelode.operators.stats import page_counts
from pagelode.plans.catalogue import discover_products
from pagelode.sources.pages import from_page, latest_captures, read_parquet_pages

QUERIES, SQL = {}, {}


def query(sql=None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run
    return register


# What the rendered catalogue holds, straight from part.
ITEMS = f"""
WITH base AS (
  SELECT p_partkey AS k, p_name, p_brand, p_type, p_size,
    CAST(round(p_retailprice * 10) AS BIGINT) AS p10,
    CAST(p_partkey // 200 AS BIGINT) AS shop,
    CAST((p_partkey // 20) % 10 + 1 AS INTEGER) AS page_no,
    CAST(p_partkey % 20 AS INTEGER) AS slot
  FROM part
), items AS (
  SELECT *,
    '{R.BASE}' || shop || CASE WHEN page_no = 1 THEN '' ELSE '?page=' || page_no END AS page_url,
    CASE WHEN k % 25 = 11 THEN NULL
         WHEN k % 10 = 7 OR k % 9 = 0 THEN p_name || ' ' || k
         WHEN k % 15 = 4 THEN 'Special Deal phone ' || k
         ELSE CASE WHEN k % 6 = 0 THEN 'Redmi ' WHEN k % 6 = 1 THEN 'iPhone ' ELSE '' END
              || p_name || ' Phone ' || k END AS title,
    'p-' || CASE WHEN k % 20 = 19 THEN k - 1 ELSE k END AS slug
  FROM base WHERE NOT (shop % 3 = 1 AND page_no = 6)
), products AS (
  SELECT *,
    '{R.SITE}/mobile/' || slug AS detail_url,
    CASE WHEN k % 7 = 0 THEN 'https://img.example.com/' || k || '.png'
         WHEN k % 2 = 0 THEN '{R.SITE}/media/' || k || '.webp'
         ELSE 'https://cdn.example.com/' || k || '.png' END AS image_url,
    CASE WHEN k % 4 = 1 THEN p_brand
         WHEN lower(title) LIKE '%redmi%' THEN 'Redmi'
         WHEN lower(title) LIKE '%iphone%' THEN 'Apple'
         ELSE upper(title[1]) || lower(split_part(title, ' ', 1)[2:]) END AS brand,
    CASE WHEN k % 3 = 0 THEN p10 END AS price_official,
    CASE WHEN k % 3 = 1 THEN p10 END AS price_unofficial,
    CASE WHEN k % 3 = 2 THEN 'TBA' END AS price_official_text,
    'In Stock' AS availability,
    CASE WHEN k % 10 <> 7 THEN p_size || 'GB' END AS ram,
    CASE WHEN k % 10 <> 7 THEN (p_size * 8) || 'GB' END AS storage,
    CASE WHEN k % 10 <> 7 THEN p_size || '.1''''' END AS display,
    CASE WHEN k % 10 <> 7 THEN p_size || 'MP' END AS main_camera,
    CASE WHEN k % 10 <> 7 THEN 'OS ' || p_type END AS os
  FROM items
  WHERE k % 10 <> 3 AND title IS NOT NULL AND NOT (k % 10 = 7)
), listed AS (
  SELECT * FROM products WHERE NOT (lower(title) LIKE '%deal%')
), firsts AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY page_url ORDER BY k) - 1 AS INTEGER) AS pos
  FROM listed
  QUALIFY row_number() OVER (PARTITION BY page_url, slug ORDER BY k) = 1
)
"""
LISTING_COLUMNS = (
    "title, slug, detail_url, image_url, brand, price_official, price_unofficial, availability, "
    "ram, storage, display, main_camera, os, price_official_text"
)
# Pages of a walk: shops with a hole at page 6 stop there, every third shop stops after page 8.
WALKED = """
, walked AS (
  SELECT * FROM firsts
  WHERE (shop % 3 <> 1 OR page_no < 6) AND (shop % 3 <> 2 OR page_no <= 8)
)
"""


def _rows(listing, *keep):
    names = [c.strip() for c in LISTING_COLUMNS.split(",")]
    return L.explode_products(listing).select(*keep, *names)


def _finds(pages):
    """Catalogue products before the listing filters, one row each."""
    scanned = L.scan_listing_pages(pages)
    found = L.embedded_products(F.col("scan.payloads"), F.col("scan.lists"), F.col("site"))
    return scanned.select("url", "page_no", F.posexplode(found).alias("pos", "p")).select(
        F.col("url").alias("page_url"), "page_no", "pos", "p.*")


# --- sources ------------------------------------------------------------------------

@query("SELECT url, CAST(200 AS INTEGER) AS status_code, length(html) AS chars, "
       "html LIKE '%</html>%' AS whole FROM pages")
def s1_page_scan(spark, sf_dir):
    pages = read_parquet_pages(spark, f"{sf_dir}/pages.parquet", kind="detail")
    return pages.select("url", "status_code", F.length("html").cast("bigint").alias("chars"),
                        F.contains("html", F.lit("</html>")).alias("whole"))


@query("SELECT url, CAST(CASE WHEN regexp_matches(url, '[?&]page=[0-9]+') "
       "THEN regexp_extract(url, '[?&]page=([0-9]+)', 1) ELSE '1' END AS INTEGER) AS page_no FROM pages")
def s2_page_number(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("url", page_number(F.col("url")).alias("page_no"))


@query(ITEMS + "SELECT DISTINCT page_url AS url, page_no FROM (SELECT page_url, page_no FROM items "
       f"UNION ALL SELECT '{R.BASE}' || shop || '?page=6', 6 FROM base WHERE shop % 6 = 4) "
       "WHERE page_no >= 4")
def s3_start_page(spark, sf_dir):
    return from_page(R.catalogue_pages(spark, sf_dir), 4).select("url", "page_no")


@query("SELECT 'https://shop.example.com/u/' || user_id AS url, max(epoch_us(ts)) AS newest_us, "
       "count(*) AS captures FROM events GROUP BY user_id")
def s1_latest_captures(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    url = R.text("https://shop.example.com/u/", F.col("user_id").cast("string"))
    rows = events.select(url.alias("url"), F.col("ts").alias("fetched_at"), "event_type")
    newest = latest_captures(rows, "url")
    counts = rows.groupBy("url").agg(F.count("*").alias("captures"))
    return newest.join(counts, "url").select(
        "url", F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("newest_us"), "captures")


# --- products of a page ---------------------------------------------------------------

@query(ITEMS + "SELECT page_url, page_no, CAST(row_number() OVER (PARTITION BY page_url ORDER BY k) - 1 "
       "AS INTEGER) AS pos, title, slug FROM products")
def l1_embedded_products(spark, sf_dir):
    return _finds(R.catalogue_pages(spark, sf_dir)).select(
        "page_url", "page_no", "pos", "title", "slug")


ANCHORS = f"""
WITH anchors AS (
  SELECT p_partkey AS k, 'p-' || p_partkey AS slug,
    '{R.BASE}' || (p_partkey // 200) || CASE WHEN (p_partkey // 20) % 10 = 0 THEN ''
      ELSE '?page=' || ((p_partkey // 20) % 10 + 1) END AS page_url,
    CASE WHEN p_partkey % 3 = 0 THEN p_name || ' & ' || p_partkey
         WHEN p_partkey % 3 = 1 THEN p_type || p_partkey
         ELSE 'P ' || p_partkey END AS title,
    CASE WHEN p_partkey % 4 = 0 THEN 'https://other.example.com' ELSE '{R.SITE}' END
      || '/mobile/p-' || p_partkey || CASE WHEN p_partkey % 4 = 1 THEN '/' ELSE '' END AS detail_url,
    CASE WHEN p_partkey % 5 = 0 THEN '{R.SITE}/media/' || p_partkey || '.png'
         WHEN p_partkey % 5 = 1 THEN 'https://img.example.com/' || p_partkey || '.png'
         ELSE '' END AS image_url
  FROM part
)
"""


@query(ANCHORS + "SELECT page_url, slug, title, detail_url, image_url FROM anchors")
def l2_anchor_products(spark, sf_dir):
    scanned = L.scan_listing_pages(R.anchor_pages(spark, sf_dir))
    found = L.anchor_products(F.col("scan.links"), F.col("site"))
    return scanned.select(F.col("url").alias("page_url"), F.explode(found).alias("p")).select(
        "page_url", "p.slug", "p.title", "p.detail_url", "p.image_url")


@query("SELECT url, n_links, first_link FROM (SELECT url, "
       "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS links, "
       "CAST(len(links) AS BIGINT) AS n_links, links[1] AS first_link FROM pages)")
def l2_page_anchors(spark, sf_dir):
    """All anchors of the given pages, whatever they lead to."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pieces = H.pieces_after(H.element_markup(F.col("html")), r"<(?i:a)(?=\s)")
    links = let(pieces, lambda p: F.transform(
        p, lambda x: H.attribute(H.tag_and_content(x)[0], "href")))
    found = pages.select("url", F.explode(F.array(links)).alias("links"))
    return found.select("url", F.size("links").cast("bigint").alias("n_links"),
                        F.get("links", 0).alias("first_link"))


@query(ITEMS + ANCHORS.replace("WITH anchors", ", anchors") + f"""
, pages_shown AS (SELECT DISTINCT page_url FROM items UNION SELECT DISTINCT '{R.BASE}' || shop || '?page=6' FROM base WHERE shop % 6 = 4),
good AS (SELECT page_url, slug, detail_url FROM anchors WHERE length(title) >= 3 AND NOT lower(title) LIKE '%promo%')
SELECT 'catalogue' AS source, page_url, slug, detail_url FROM firsts
UNION ALL SELECT 'fallback', page_url, slug, detail_url FROM good JOIN pages_shown USING (page_url)
  WHERE page_url NOT IN (SELECT page_url FROM products)
UNION ALL SELECT 'anchors', page_url, slug, detail_url FROM good""")
def l3_source_precedence(spark, sf_dir):
    """Pages that have both, a catalogue and the same page's anchors: the catalogue counts, and anchors where it is empty."""
    anchors = R.anchor_pages(spark, sf_dir)
    both = R.catalogue_pages(spark, sf_dir).alias("c").join(
        anchors.select("url", F.col("html").alias("more")).hint("merge"), "url").select(
        *[F.concat("html", "more").alias("html") if c == "html" else c for c in anchors.columns])
    # Records of a catalogue tell of availability, anchors do not.
    rows = lambda pages, name: L.explode_products(L.listing_pages(pages)).select(
        name.alias("source"), "page_url", "slug", "detail_url")
    in_catalogue = F.when(F.col("availability").isNotNull(), "catalogue").otherwise("fallback")
    return rows(both, in_catalogue).unionByName(rows(anchors, F.lit("anchors")))


@query(ITEMS + "SELECT k, NOT (k % 10 = 3) AND title IS NOT NULL AND k % 10 <> 7 AS is_product "
       "FROM items")
def l4_product_predicate(spark, sf_dir):
    scanned = L.scan_listing_pages(R.catalogue_pages(spark, sf_dir))
    data = F.flatten(F.concat(F.transform("scan.payloads", lambda p: p["data"]), F.col("scan.lists")))
    records = scanned.select(F.explode(L.records_of(data)).alias("m"))
    return records.select(F.col("m")["id"].cast("bigint").alias("k"),
                          L.is_product(F.col("m")).alias("is_product"))


@query(ITEMS + f"SELECT page_url, {LISTING_COLUMNS} FROM products")
def l5_listing_projection(spark, sf_dir):
    names = [c.strip() for c in LISTING_COLUMNS.split(",")]
    return _finds(R.catalogue_pages(spark, sf_dir)).select("page_url", *names)


@query("SELECT url, '/mobile/' || regexp_extract(url, '[^/]*$') AS link, "
       "regexp_extract(url, '^(https?://[^/]+)', 1) || '/mobile/' || regexp_extract(url, '[^/]*$') "
       "AS detail_url FROM pages")
def l6_detail_url(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    link = R.text("/mobile/", F.substring_index("url", "/", -1))
    return pages.select("url", link.alias("link"),
                        join_url(site_of(F.col("url")), link).alias("detail_url"))


@query(f"""SELECT p_partkey, CASE p_partkey % 5
  WHEN 0 THEN '{R.SITE}/media/' || p_partkey WHEN 1 THEN 'https://img.example.com/' || p_partkey
  WHEN 2 THEN 'https://cdn.example.com/' || p_partkey WHEN 3 THEN '{R.SITE}/img/' || p_partkey
  ELSE '' END AS image FROM part""")
def l7_image_url(spark, sf_dir):
    key = R.k().cast("string")
    link = (F.when(R.k() % 5 == 0, R.text("media/", key))
            .when(R.k() % 5 == 1, R.text("https://img.example.com/", key))
            .when(R.k() % 5 == 2, R.text("//cdn.example.com/", key))
            .when(R.k() % 5 == 3, R.text("/img/", key)))
    return R.part(spark, sf_dir).select(
        "p_partkey", image_url(F.lit(R.SITE), link).alias("image"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 100 END AS price,
  CASE p_partkey % 3 WHEN 1 THEN 'TBA ' || p_partkey WHEN 2 THEN CAST(p_partkey AS VARCHAR) || '.5'
  END AS price_text FROM part""")
def l8_price_coercion(spark, sf_dir):
    raw = (F.when(R.k() % 3 == 0, (R.k() * 100).cast("string"))
           .when(R.k() % 3 == 1, R.text("TBA ", R.k().cast("string")))
           .otherwise(R.text(R.k().cast("string"), ".5")))
    return R.part(spark, sf_dir).select(
        "p_partkey", whole_number(raw).alias("price"), not_whole_number(raw).alias("price_text"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'OnePlus' WHEN 1 THEN 'Apple'
  WHEN 2 THEN 'Mi' WHEN 3 THEN upper(p_name[1]) || lower(split_part(p_name, ' ', 1)[2:])
  WHEN 4 THEN 'Unknown' ELSE 'Samsung' END AS brand FROM part""")
def l9_brand_inference(spark, sf_dir):
    key = R.k().cast("string")
    title = (F.when(R.k() % 6 == 0, R.text("new ONEPLUS or redmi ", key))
             .when(R.k() % 6 == 1, R.text("iphone ", key)).when(R.k() % 6 == 2, R.text("Economic ", key))
             .when(R.k() % 6 == 3, F.col("p_name")).when(R.k() % 6 == 4, R.text("X ", key))
             .otherwise(R.text("Nokia against Samsung ", key)))
    return R.part(spark, sf_dir).select("p_partkey", brand_from_title(title).alias("brand"))


@query(ITEMS + "SELECT page_url, slug, title FROM listed")
def l10_junk_filter(spark, sf_dir):
    finds = _finds(R.catalogue_pages(spark, sf_dir))
    return finds.where(L.is_listed(F.struct(*finds.columns))).select("page_url", "slug", "title")


@query(ITEMS + "SELECT page_url, pos, slug, title FROM firsts")
def l11_first_of_slug(spark, sf_dir):
    return L.explode_products(L.listing_pages(R.catalogue_pages(spark, sf_dir))).select(
        "page_url", "pos", "slug", "title")


# --- next pages and walks ----------------------------------------------------------------

# Pages whose script object tells of a next one: those whose number leaves 0, 1 or 2 by 5.
PAYLOAD_PAGES = """
, numbered AS (SELECT DISTINCT shop, page_no, shop % 3 = 1 AND page_no = 6 AS hole FROM base),
shown AS (SELECT *,
    CASE WHEN page_no = 1 THEN '{base}' || shop ELSE '{base}' || shop || '?page=' || page_no END AS url,
    CASE WHEN shop % 3 = 2 AND page_no = 8 THEN 'list'
         WHEN NOT hole AND page_no % 5 > 2 THEN 'list' ELSE 'object' END AS kind
  FROM numbered WHERE NOT (hole AND shop % 2 = 1))
""".replace("{base}", R.BASE)


@query(ITEMS + PAYLOAD_PAGES
       + "SELECT url, kind = 'object' AND NOT hole AND page_no < 10 AS has_next FROM shown")
def l12_next_in_payload(spark, sf_dir):
    scanned = L.scan_listing_pages(R.catalogue_pages(spark, sf_dir))
    return scanned.select("url", L.next_in_payload(F.col("scan.payloads")).alias("has_next"))


@query(f"SELECT DISTINCT '{R.BASE}' || (p_partkey // 200) || CASE WHEN (p_partkey // 20) % 10 = 0 "
       "THEN '' ELSE '?page=' || ((p_partkey // 20) % 10 + 1) END AS url, "
       f"CASE WHEN (p_partkey // 20) % 10 < 9 THEN '{R.BASE}' || (p_partkey // 200) || '?page=' || "
       "((p_partkey // 20) % 10 + 2) END AS next_url FROM part")
def l13_next_in_anchors(spark, sf_dir):
    scanned = L.scan_listing_pages(R.anchor_pages(spark, sf_dir))
    return scanned.select("url", L.next_in_links(
        F.col("scan.links"), F.col("page_no"), F.col("base_url"), F.col("site")).alias("next_url"))


@query(ITEMS + PAYLOAD_PAGES
       + "SELECT url, kind = 'object' AND NOT hole AS has_content FROM shown UNION ALL "
       "SELECT DISTINCT url || '#anchors', true FROM "
       f"(SELECT '{R.BASE}' || shop || CASE WHEN page_no = 1 THEN '' ELSE '?page=' || page_no END AS url "
       "FROM base)")
def l14_page_has_products(spark, sf_dir):
    def content(pages, mark):
        scanned = L.scan_listing_pages(pages)
        return scanned.select(F.concat("url", F.lit(mark)).alias("url"), L.has_products(
            F.col("scan.payloads"), F.col("scan.links"), F.col("scan.has_item_class")
        ).alias("has_content"))

    return content(R.catalogue_pages(spark, sf_dir), "").unionByName(
        content(R.anchor_pages(spark, sf_dir), "#anchors"))


@query(ITEMS + WALKED + "SELECT page_url, page_no, count(*) AS products FROM walked "
       "GROUP BY page_url, page_no")
def l15_pagination_walk(spark, sf_dir):
    taken = G.take_pages(L.listing_pages(R.catalogue_pages(spark, sf_dir)))
    return taken.select(F.col("url").alias("page_url"), "page_no",
                        F.size("products").cast("bigint").alias("products"))


@query(ITEMS + "SELECT page_url, pos, slug FROM firsts WHERE (shop % 3 <> 1 OR page_no < 6) "
       "AND page_no >= 2 QUALIFY row_number() OVER (PARTITION BY shop ORDER BY page_no, pos) <= 35")
def l16_bounded_discovery(spark, sf_dir):
    listing = L.listing_pages(R.catalogue_pages(spark, sf_dir))
    return L.explode_products(G.take_first(listing, 35, start_page=2)).select(
        "page_url", "pos", "slug")


@query(ITEMS + "SELECT CAST(shop AS VARCHAR) AS shop, title, slug FROM (SELECT * FROM firsts "
       "UNION ALL SELECT * FROM firsts)")
def l17_cross_page_append(spark, sf_dir):
    """Every page shown twice under two numbers: the products of both stay."""
    pages = R.catalogue_pages(spark, sf_dir)
    again = pages.withColumn("page_no", F.col("page_no") + 100)
    rows = L.explode_products(L.listing_pages(pages.unionByName(again)), ("base_url", "page_no"))
    return rows.select(F.regexp_extract("base_url", r"list(\d+)$", 1).alias("shop"), "title", "slug")


@query(ITEMS + WALKED + "SELECT page_url, slug, shop, row_number() OVER (PARTITION BY shop ORDER BY "
       "page_no, pos) AS position FROM walked QUALIFY position <= 80")
def w2_discovery_limit(spark, sf_dir):
    """More products than a short walk gives: the full walk, cut to size per catalogue."""
    rows = discover_products(R.catalogue_pages(spark, sf_dir), max_products=80)
    return rows.select(
        F.when(F.col("page_no") == 1, F.col("base_url")).otherwise(
            F.concat("base_url", F.lit("?page="), F.col("page_no").cast("string"))).alias("page_url"),
        "slug", F.regexp_extract("base_url", r"list(\d+)$", 1).cast("bigint").alias("shop"), "position")


@query(ITEMS + "SELECT page_url, count(*) AS products FROM firsts GROUP BY page_url")
def a4_page_counts(spark, sf_dir):
    rows = L.explode_products(L.listing_pages(R.catalogue_pages(spark, sf_dir)))
    return page_counts(rows, ("page_url",))


@query(ITEMS + "SELECT page_url AS url, 'parsing_errors' AS error_type, "
       "'record without a title' AS reason FROM items i WHERE title IS NULL")
def x3_untitled_records(spark, sf_dir):
    return L.listing_rejects(R.catalogue_pages(spark, sf_dir))


# Two catalogues with a page for each part: odd parts in one whose pages tell of the next, even ones in one of anchors.
@query("SELECT CAST(p_partkey % 2 AS BIGINT) AS shop, CAST(p_partkey // 2 + 1 AS INTEGER) AS page_no FROM part")
def l15_long_walk(spark, sf_dir):
    number = F.floor(R.k() / 2) + 1
    payload = R.text('<script>let productDataArray = {"current_page": ', number.cast("string"), ', "last_page": 1000000000, "data": [{"title": "Phone ',
                     R.k().cast("string"), '", "slug": "p-', R.k().cast("string"), '"}]};</script>')
    anchor = R.text("<a href='/mobile/p-", R.k().cast("string"), "' title='Phone ", R.k().cast("string"), "'>x</a>")
    pages = R.part(spark, sf_dir).select(
        R.text(f"{R.BASE}", (R.k() % 2).cast("string"), "?page=", number.cast("string")).alias("url"),
        number.cast("int").alias("page_no"), F.lit("listing").alias("kind"), F.lit(200).alias("status_code"),
        F.when(R.k() % 2 == 1, payload).otherwise(anchor).alias("html"), F.lit(None).cast("timestamp").alias("fetched_at"))
    taken = G.take_pages(L.listing_pages(pages))
    return taken.select(F.regexp_extract("base_url", r"list(\d+)$", 1).cast("bigint").alias("shop"), "page_no")
