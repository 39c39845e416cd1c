"""Queries of the detail-page operators."""

from pyspark.sql import functions as F

from catalog_queries import render as R
from pagelode import schema as S
from pagelode.functions import html as H
from pagelode.functions.binding import evaluate_once, let
from pagelode.functions.prices import price_digits
from pagelode.operators import detail as D
from pagelode.operators import prices as P
from pagelode.plans.storage import written

QUERIES, SQL = {}, {}


def query(sql=None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run
    return register


# What the rendered detail pages hold, straight from part.
DETAILS = f"""
WITH pages_of AS (
  SELECT p_partkey AS k, p_name, p_brand, p_type, p_size,
    CAST(round(p_retailprice * 10) AS BIGINT) AS p10,
    '{R.SITE}/mobile/p-' || p_partkey AS url,
    strftime(make_timestamp((1700000000 + p_partkey) * 1000000), '%Y-%m-%dT%H:%M:%S') AS scraped_at
  FROM part
), parsed AS (
  SELECT *, k % 17 <> 0 AS has_specs, k % 6 <> 0 AS has_price FROM pages_of WHERE k % 19 <> 0
), cells AS (
  SELECT url, k, 0 AS cat_pos, 0 AS row_pos, 'General' AS category, 'Brand' AS label, 'brand' AS field, p_brand AS value FROM parsed WHERE has_specs
  UNION ALL SELECT url, k, 0, 1, 'General', 'Model', 'model', p_name || ' ' || k FROM parsed WHERE has_specs AND k % 11 <> 0
  UNION ALL SELECT url, k, 0, CASE WHEN k % 11 = 0 THEN 1 ELSE 2 END, 'General', 'Device Type', 'device_type', 'Smartphone' FROM parsed WHERE has_specs
  UNION ALL SELECT url, k, 0, CASE WHEN k % 11 = 0 THEN 2 ELSE 3 END, 'General', 'Status', 'status', p_type || ' & sold' FROM parsed WHERE has_specs
  UNION ALL SELECT url, k, 1, 0, 'Hardware & Software', 'Chipset', 'chipset', 'Chip ' || p_size || ' nm' FROM parsed WHERE has_specs AND k % 7 <> 0
  UNION ALL SELECT url, k, 1, 1, 'Hardware & Software', 'CPU', 'cpu', 'Octa core ' || p_type FROM parsed WHERE has_specs
  UNION ALL SELECT url, k, 2, 0, 'Memory', 'RAM', 'ram', p_size || ' GB' FROM parsed WHERE has_specs
  UNION ALL SELECT url, k, 2, 2, 'Memory', 'Internal Storage', 'internal_storage', (p_size * 8) || 'GB' FROM parsed WHERE has_specs
  UNION ALL SELECT url, k, 3, 0, 'Battery', 'Battery Capacity', 'battery_capacity', p10 || ' mAh' FROM parsed WHERE has_specs
  UNION ALL SELECT url, k, 4, 0, 'More', 'RAM', 'ram', p_size || 'GB+' FROM parsed WHERE has_specs AND k % 5 = 0
), wide AS (
  SELECT *,
    CASE WHEN has_specs THEN p_brand END AS brand,
    CASE WHEN has_specs AND k % 11 <> 0 THEN p_name || ' ' || k END AS model,
    CASE WHEN has_specs THEN 'Smartphone' END AS device_type,
    CASE WHEN has_specs THEN p_type || ' & sold' END AS status,
    CASE WHEN has_specs AND k % 7 <> 0 THEN 'Chip ' || p_size || ' nm' END AS chipset,
    CASE WHEN has_specs THEN 'Octa core ' || p_type END AS cpu,
    CASE WHEN has_specs THEN CASE WHEN k % 5 = 0 THEN p_size || 'GB+' ELSE p_size || ' GB' END END AS ram,
    CASE WHEN has_specs THEN (p_size * 8) || 'GB' END AS internal_storage,
    CASE WHEN has_specs THEN p10 || ' mAh' END AS battery_capacity,
    CASE WHEN has_price AND k % 2 = 0 THEN format('{{:,}}', p10) END AS price_official,
    CASE WHEN has_price AND k % 2 = 1 THEN format('{{:,}}', p10) END AS price_unofficial,
    CASE WHEN has_price AND k % 4 = 0 THEN format('{{:,}}', p10 + 1000) END AS price_old,
    CASE WHEN has_price AND k % 4 = 0 THEN 'Save ৳.1,000' || CASE WHEN k % 8 = 0 THEN '' ELSE ' (-5%)' END END AS price_savings,
    CASE WHEN has_price AND k % 10 <> 0 THEN 'June ' || (k % 28 + 1) || ', 2025' END AS price_updated,
    CASE WHEN has_price AND k % 3 = 0 THEN 2 ELSE 0 END AS n_variants
  FROM parsed
)
"""
SPEC_COLUMNS = ("brand", "model", "device_type", "status", "chipset", "cpu", "ram",
                "internal_storage", "battery_capacity")
PRICE_COLUMNS = ("price_official", "price_unofficial", "price_old", "price_savings",
                 "price_updated")
WIDE = ", ".join(SPEC_COLUMNS + PRICE_COLUMNS)


def _markup(spark, sf_dir):
    pages = D.parsable(R.detail_pages(spark, sf_dir)).select("url", "html")
    return pages, H.element_markup(F.col("html"))


@query(DETAILS + "SELECT url, has_specs FROM parsed")
def d1_spec_section(spark, sf_dir):
    pages, markup = _markup(spark, sf_dir)
    return pages.select("url", D.spec_section(markup).isNotNull().alias("has_specs"))


@query(DETAILS + "SELECT url, CAST(CASE WHEN NOT has_specs THEN 0 WHEN k % 5 = 0 OR k % 13 = 0 "
       "THEN 5 ELSE 4 END AS INTEGER) AS blocks FROM parsed")
def d2_category_blocks(spark, sf_dir):
    pages, markup = _markup(spark, sf_dir)
    blocks = D.spec_blocks(D.spec_section(markup))
    return pages.select("url", F.greatest(F.size(blocks), F.lit(0)).alias("blocks"))


@query(DETAILS + "SELECT url, cat_pos, row_pos, category, label, value FROM cells UNION ALL "
       "SELECT url, 0, CASE WHEN k % 11 = 0 THEN 3 ELSE 4 END, 'General', 'Shop Code', "
       "'unknown label' FROM parsed WHERE has_specs UNION ALL "
       "SELECT url, 2, 1, 'Memory', 'InternalStorage', 'joined label is unknown' FROM parsed "
       "WHERE has_specs")
def d3_spec_cells(spark, sf_dir):
    pages, markup = _markup(spark, sf_dir)
    return pages.select("url", F.explode(let(markup, D.spec_cells)).alias("c")).select("url", "c.*")


def _decoded_element(tag):
    """SQL for the text of an element without tags inside, with its character references decoded."""
    text = f"regexp_extract(html, '<{tag}>(.*?)</{tag}>', 1)"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{char}')"
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


@query(f"SELECT url, {_decoded_element('h1')} AS heading FROM pages")
def d4_cell_text(spark, sf_dir):
    """Headings of the given pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("url", H.spaced_text(
        H.first_element(H.element_markup(F.col("html")), "h1")).alias("heading"))


@query(f"SELECT url, {_decoded_element('title')} AS title FROM pages")
def d4_entities(spark, sf_dir):
    """Titles of the given pages, many of which hold character references."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("url", H.spaced_text(
        H.first_element(H.element_markup(F.col("html")), "title")).alias("title"))


@query(DETAILS + "SELECT url, field, value FROM cells")
def d5_label_mapping(spark, sf_dir):
    return D.long_specs(R.detail_pages(spark, sf_dir)).select("url", "field", "value")


@query(DETAILS + f"SELECT url, {', '.join(SPEC_COLUMNS)} FROM wide WHERE has_specs")
def d6_widen_long_table(spark, sf_dir):
    return D.widen(D.long_specs(R.detail_pages(spark, sf_dir))).select("url", *SPEC_COLUMNS)


@query(DETAILS + f"SELECT url, {', '.join(SPEC_COLUMNS)} FROM wide")
def d6_wide_on_page(spark, sf_dir):
    pages, markup = _markup(spark, sf_dir)
    values = let(let(markup, D.spec_cells), D.field_values)
    found = evaluate_once(pages, "v", values)
    at = {f: i for i, f in enumerate(S.SPEC_FIELDS)}
    return found.select("url", *[F.col("v")[at[c]].alias(c) for c in SPEC_COLUMNS])


@query(DETAILS + f"SELECT url, {', '.join(PRICE_COLUMNS)}, CAST(n_variants AS INTEGER) AS n_variants "
       "FROM wide")
def d7_price_block(spark, sf_dir):
    return P.price_table(R.detail_pages(spark, sf_dir)).select(
        "url", *PRICE_COLUMNS, F.size("price_variants").alias("n_variants"))


@query(DETAILS + "SELECT url, price_official, price_unofficial FROM wide")
def d8_main_prices(spark, sf_dir):
    pages, markup = _markup(spark, sf_dir)
    block = H.first_element(markup, "div", cls=S.PRICE_BLOCK_CLASS)
    return evaluate_once(pages, "m", let(block, P.main_prices)).select(
        "url", "m.price_official", "m.price_unofficial")


@query("SELECT o_orderkey, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS digits "
       "FROM orders")
def d9_price_digits(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string")
    shown = R.text("৳. ", F.regexp_replace(cents, r"(\d\d)$", ".$1"), " (Official) 12")
    return orders.select("o_orderkey", price_digits(shown).alias("digits"))


@query(DETAILS + "SELECT url, price_old, price_savings FROM wide")
def d10_discount(spark, sf_dir):
    return P.price_table(R.detail_pages(spark, sf_dir)).select("url", "price_old", "price_savings")


@query(DETAILS + "SELECT url, CASE WHEN n_variants > 0 THEN p_size || 'GB' END AS variant, "
       "CASE WHEN n_variants > 0 THEN format('{:,}', p10) END AS price FROM wide UNION ALL "
       "SELECT url, '512GB', format('{:,}', p10 + 5000) FROM wide WHERE n_variants > 0")
def d11_variants(spark, sf_dir):
    return P.variant_table(P.price_table(R.detail_pages(spark, sf_dir)))


@query(DETAILS + "SELECT url, price_updated FROM wide")
def d12_price_date(spark, sf_dir):
    return P.price_table(R.detail_pages(spark, sf_dir)).select("url", "price_updated")


@query(DETAILS + "SELECT url AS detail_url, CAST(NULL AS VARCHAR) AS image_url, scraped_at FROM wide")
def d13_metadata(spark, sf_dir):
    return D.parse_details(R.detail_pages(spark, sf_dir)).select(*("detail_url", "image_url", "scraped_at"))


@query(DETAILS + "SELECT url, k % 19 <> 0 AS parsed FROM pages_of")
def d14_status_gate(spark, sf_dir):
    pages = R.detail_pages(spark, sf_dir)
    good = D.parsable(pages).select("url", F.lit(True).alias("parsed"))
    return good.unionByName(pages.where("status_code <> 200").select("url", F.lit(False).alias("parsed")))


@query(DETAILS + f"SELECT url AS detail_url, {WIDE}, scraped_at, "
       "has_specs AND k % 11 <> 0 AS valid FROM wide")
def d15_detail_job(spark, sf_dir):
    return D.parse_details(R.detail_pages(spark, sf_dir)).select(
        "detail_url", *SPEC_COLUMNS, *PRICE_COLUMNS, "scraped_at", "valid")


@query(DETAILS + f"SELECT url AS detail_url, {WIDE}, scraped_at FROM wide")
def f10_conform(spark, sf_dir):
    """Raw values with padding and an unknown column, brought into the product schema."""
    parsed = D.parse_details(R.detail_pages(spark, sf_dir))
    names = (*SPEC_COLUMNS, *PRICE_COLUMNS, "detail_url", "scraped_at")
    padded = parsed.select(*[F.concat(F.lit(" \t"), F.coalesce(F.col(c), F.lit(" N/A ")), F.lit("\n ")).alias(c)
                             for c in names], F.lit("x").alias("unknown_column"))
    return D.conform(padded).select(*names)


@query(DETAILS + "SELECT url AS detail_url, has_specs AND k % 11 <> 0 AS valid FROM wide")
def f11_validate(spark, sf_dir):
    return D.parse_details(R.detail_pages(spark, sf_dir)).select(
        "detail_url", D.is_valid_product().alias("valid"))


@query(DETAILS + "SELECT url, CASE WHEN NOT has_specs THEN 'no brand' WHEN k % 11 = 0 THEN 'no model' "
       "ELSE 'valid' END AS reason FROM wide")
def f12_validated_split(spark, sf_dir):
    parsed = written(D.parse_details(R.detail_pages(spark, sf_dir)).select(*D.CHECKED_COLUMNS))
    good = D.valid_products(parsed).select(F.col("detail_url").alias("url"), F.lit("valid").alias("reason"))
    return good.unionByName(D.invalid_products(parsed).select("url", "reason"))


@query("SELECT '{\"p_partkey\":' || p_partkey || ',\"p_name\":\"' || p_name || '\",\"none\":null}' AS json "
       "FROM part")
def f13_record_as_json(spark, sf_dir):
    return D.as_json(R.part(spark, sf_dir).select(
        "p_partkey", "p_name", F.lit(None).cast("string").alias("none")))
