"""Queries of the scalar functions."""

from pyspark.sql import functions as F

from catalog_queries import render as R
from pagelode.functions import html as H
from pagelode.functions import text as X
from pagelode.functions.json_paths import json_path_or_default
from pagelode.functions.urls import is_valid_url
from pagelode.functions.validity import is_iso_timestamp

QUERIES, SQL = {}, {}


def query(sql=None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run
    return register


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name || ' ' || p_type WHEN 1 THEN NULL
  WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN p_brand ELSE 'na na' END AS cleaned FROM part""")
def f1_clean_text(spark, sf_dir):
    raw = (F.when(R.k() % 6 == 0, R.text("  ", F.col("p_name"), " \t\n ", F.col("p_type"), " "))
           .when(R.k() % 6 == 1, F.lit(" Not  Available ")).when(R.k() % 6 == 2, F.lit("   "))
           .when(R.k() % 6 == 3, F.lit("N/a")).when(R.k() % 6 == 4, R.text(" ", F.col("p_brand"), "\x1f"))
           .otherwise(F.lit("na  na")))
    return R.part(spark, sf_dir).select("p_partkey", X.clean_text(raw).alias("cleaned"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No'
  WHEN 2 THEN p_type || ' maybe' WHEN 3 THEN 'No' END AS answer FROM part""")
def f2_normalize_boolean(spark, sf_dir):
    raw = (F.when(R.k() % 5 == 0, F.lit(" SUPPORTED ")).when(R.k() % 5 == 1, F.lit("n"))
           .when(R.k() % 5 == 2, R.text(" ", F.col("p_type"), "   maybe"))
           .when(R.k() % 5 == 3, F.lit("Not Available")).otherwise(F.lit(" - ")))
    return R.part(spark, sf_dir).select("p_partkey", X.normalize_boolean(raw).alias("answer"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || '.5 mAh'
  WHEN 1 THEN 'about ' || p_size || ' MAH or 7' WHEN 2 THEN NULL ELSE p_size || ' mAh' END AS capacity,
  CASE WHEN p_partkey % 4 <> 2 THEN CASE p_partkey % 4 WHEN 0 THEN 'Li-Po ' || p_size || '.5'
  WHEN 1 THEN 'about ' || p_size || ' MAH or 7' ELSE CAST(p_size AS VARCHAR) END END AS plain FROM part""")
def f3_extract_numeric(spark, sf_dir):
    size = F.col("p_size").cast("string")
    raw = (F.when(R.k() % 4 == 0, R.text("Li-Po ", size, ".5"))
           .when(R.k() % 4 == 1, R.text("about  ", size, " MAH or 7"))
           .when(R.k() % 4 == 2, F.col("p_type")).otherwise(size))
    return R.part(spark, sf_dir).select(
        "p_partkey", X.extract_numeric(raw, "mAh").alias("capacity"),
        X.extract_numeric(raw).alias("plain"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN p_size || ' g'
  WHEN 2 THEN p_name ELSE ' - ' END AS value FROM part""")
def f4_normalize_by_field(spark, sf_dir):
    field = (F.when(R.k() % 4 == 0, "usb_otg").when(R.k() % 4 == 1, "weight")
             .when(R.k() % 4 == 2, "model").otherwise("colors"))
    raw = (F.when(R.k() % 4 == 0, F.lit("TRUE")).when(R.k() % 4 == 1, F.col("p_size").cast("string"))
           .when(R.k() % 4 == 2, R.text(F.col("p_name"), "  ")).otherwise(F.lit(" - ")))
    return R.part(spark, sf_dir).select("p_partkey", X.normalize_by_field(field, raw).alias("value"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE 'Smartphone' END AS device_type,
  CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE 'n.a.' END AS with_fallback,
  CAST(p_size AS VARCHAR) AS size_text, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE 'Unknown' END AS other
  FROM part""")
def f5_safe_value(spark, sf_dir):
    raw = F.when(R.k() % 3 == 0, R.text(" ", F.col("p_type"), "\n")).when(R.k() % 3 == 1, F.lit(""))
    return R.part(spark, sf_dir).select(
        "p_partkey", X.safe_value("device_type", raw).alias("device_type"),
        X.safe_value("brand", raw, fallback="n.a.").alias("with_fallback"),
        X.safe_value("size", F.col("p_size")).alias("size_text"),
        X.safe_value("no_such_field", raw).alias("other"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, 'none' AS missing FROM events")
def f6_json_path(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", json_path_or_default(F.col("props"), "k", "none").alias("k"),
                         json_path_or_default(F.col("props"), "k.deeper", "none").alias("missing"))


@query("SELECT url, regexp_extract(html, '<html lang=\"([a-z]*)\"', 1) AS lang, 'Unknown' AS no_section, "
       "regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1) AS charset FROM pages")
def f7_element_or_default(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = H.element_markup(F.col("html"))
    return pages.select(
        "url", H.element_attribute_or_default(html, "html", "lang").alias("lang"),
        H.element_text_or_default(html, "section", id="product-specs").alias("no_section"),
        H.element_attribute_or_default(html, "meta", "charset").alias("charset"))


@query("""SELECT page_id, url, page_id % 4 < 2 AS plain_ok FROM (SELECT page_id, CASE page_id % 4
  WHEN 0 THEN url WHEN 1 THEN 'http://localhost:8080/x' WHEN 2 THEN replace(url, '://', ':/')
  ELSE url || ' x' END AS url FROM pages)""")
def f8_valid_url(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    k = F.col("page_id") % 4
    url = (F.when(k == 0, F.col("url")).when(k == 1, F.lit("http://localhost:8080/x"))
           .when(k == 2, F.replace("url", F.lit("://"), F.lit(":/"))).otherwise(R.text(F.col("url"), " x")))
    return pages.select("page_id", url.alias("url"), is_valid_url(url).alias("plain_ok"))


@query("""SELECT event_id, event_id % 4 < 2 AS valid FROM events""")
def f9_iso_timestamp(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id") % 4
    text = X.iso_text(F.col("ts").cast("timestamp"))
    value = (F.when(k == 0, text).when(k == 1, R.text(F.substr(text, F.lit(1), F.lit(19)), "Z"))
             .when(k == 2, F.regexp_replace(text, "-01-", "-13-")).otherwise(F.regexp_replace(text, "T", "T9")))
    return events.select("event_id", is_iso_timestamp(value).alias("valid"))


@query("""SELECT p_partkey, 'a' || chr(65533) || 'b' || chr(65533) || 'c' || chr(65533) || 'd' || chr(65533) || 'e' || chr(8217)
  || 'f' || chr(160) || 'g' || chr(10003) || 'h' || chr(172) || 'it;' || p_name || 'A' AS decoded FROM part""")
def d4_odd_references(spark, sf_dir):
    """References beyond the characters, of surrogates and of zero, of Windows-1252, of HTML 5, and without a semicolon."""
    text = R.text("a&#x110000;b&#9999999;c&#xD800;d&#0;e&#146;f&nbsp", "g&check;h&notit;", F.col("p_name"), "&#00000000065;")
    return R.part(spark, sf_dir).select("p_partkey", H.decode_entities(text).alias("decoded"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS valid FROM part")
def f8_long_urls(spark, sf_dir):
    """Hosts of some thousand labels, whose last one decides."""
    last = F.when(R.k() % 3 == 0, "com").when(R.k() % 3 == 1, "c0m").otherwise("-x.com")
    url = F.concat(F.lit("https://"), F.repeat(F.lit("ab."), (F.lit(2000) + R.k() % 50).cast("int")), last, F.lit("/"), F.col("p_partkey"))
    return R.part(spark, sf_dir).select("p_partkey", is_valid_url(url).alias("valid"))
