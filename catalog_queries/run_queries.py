"""Queries of joins, counts, triage, exports, jobs and the stream mode."""

from datetime import datetime

from pyspark.sql import functions as F

from catalog_queries import render as R
from catalog_queries.detail_queries import DETAILS
from catalog_queries.listing_queries import ITEMS, WALKED
from pagelode import schema as S
from pagelode.operators import detail as D
from pagelode.operators import enrich as E
from pagelode.operators import listing as L
from pagelode.operators import stats as A
from pagelode.operators import triage as X
from pagelode.plans import catalogue as W
from pagelode.plans.storage import shared_folder, written
from pagelode.sinks import export as K
from pagelode.streaming import state as T
from pagelode.streaming.pages import append_stream, stream_pages

QUERIES, SQL = {}, {}


def query(sql=None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run
    return register


def scratch(spark):
    """A new folder name that all machines share."""
    return shared_folder(spark)


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def all_products(spark, sf_dir):
    return L.explode_products(L.listing_pages(R.catalogue_pages(spark, sf_dir)))


def all_details(spark, sf_dir):
    return W.product_details(R.detail_pages(spark, sf_dir))


BOTH = ITEMS + DETAILS.replace("WITH pages_of", ", pages_of") + WALKED
# A product row of the join; {l} is the listing side, {d} the detail side.
ENRICHED = """
  l.detail_url, coalesce(d.brand, l.brand) AS brand, coalesce(d.model, l.title) AS model,
  coalesce(l.ram, d.ram) AS ram, coalesce(l.storage, d.internal_storage) AS internal_storage,
  l.display AS screen_size, l.main_camera AS primary_camera_resolution, d.battery_capacity,
  l.os AS operating_system, d.chipset, d.price_official, l.image_url
"""
ENRICHED_COLUMNS = (
    "detail_url", "brand", "model", "ram", "internal_storage", "screen_size",
    "primary_camera_resolution", "battery_capacity", "operating_system", "chipset",
    "price_official", "image_url")
REASON = """CASE WHEN d.url IS NULL THEN 'no detail page' WHEN NOT d.has_specs THEN 'no brand'
  WHEN d.k % 11 = 0 THEN 'no model' END"""


# --- joins -----------------------------------------------------------------------------

@query(BOTH + f"SELECT {ENRICHED} FROM firsts l JOIN wide d ON d.url = l.detail_url")
def j1_enrichment(spark, sf_dir):
    return E.enrich(all_products(spark, sf_dir), all_details(spark, sf_dir)).select(*ENRICHED_COLUMNS)


@query(BOTH + "SELECT l.detail_url AS url, 'network_errors' AS error_type, 'no detail page' AS reason "
       "FROM firsts l WHERE l.detail_url NOT IN (SELECT url FROM wide)")
def j2_unmatched(spark, sf_dir):
    return E.unmatched(all_products(spark, sf_dir), W.parsed_urls(R.detail_pages(spark, sf_dir)))


@query(BOTH + f"SELECT {ENRICHED}, d.url IS NULL AS skeleton FROM firsts l LEFT JOIN wide d "
       "ON d.url = l.detail_url")
def j3_skeleton_rows(spark, sf_dir):
    judged = E.judge(all_products(spark, sf_dir), all_details(spark, sf_dir), require_valid=False,
                     on_error="skeleton", now=F.to_timestamp(F.lit("2025-01-01 00:00:00")))
    return judged.where("outcome = 'ok'").select(
        *ENRICHED_COLUMNS, (F.col("scraped_at") == "2025-01-01T00:00:00").alias("skeleton"))


# --- counts ------------------------------------------------------------------------------

@query("""SELECT count(*) AS total_found, count(*) FILTER (event_id % 7 <> 0) AS processed,
  count(*) FILTER (event_id % 7 <> 0 AND event_type <> 'error') AS successful,
  count(*) FILTER (event_id % 7 = 0 OR event_type = 'error') AS failed,
  100.0::DOUBLE * count(*) FILTER (event_id % 7 <> 0 AND event_type <> 'error')
    / greatest(count(*) FILTER (event_id % 7 <> 0), 1) AS success_rate FROM events""")
def a1_run_statistics(spark, sf_dir):
    processed = F.col("event_id") % 7 != 0
    ok = processed & (F.col("event_type") != "error")
    return A.run_statistics(events(spark, sf_dir).select(
        F.when(ok, "ok").otherwise("failed").alias("outcome"), processed.alias("processed")))


ERROR_OF = {"error": "network_errors", "click": "parsing_errors", "purchase": "validation_errors",
            "signup": "warnings", "view": "network"}


def _errors(spark, sf_dir):
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in ERROR_OF.items()])
    return events(spark, sf_dir).select("event_id", kind.alias("error_type"))


@query("""SELECT CASE event_type WHEN 'error' THEN 'network_errors' WHEN 'click' THEN 'parsing_errors'
  WHEN 'purchase' THEN 'validation_errors' ELSE 'warnings' END AS error_type, count(*) AS n
  FROM events WHERE event_type <> 'view' GROUP BY 1""")
def a2_error_counts(spark, sf_dir):
    return A.error_counts(_errors(spark, sf_dir))


@query("""SELECT position, successful, position - successful AS failed FROM (
  SELECT event_id + 1 AS position,
    CAST(count(*) FILTER (event_type <> 'error') OVER (ORDER BY event_id) AS BIGINT) AS successful
  FROM events) WHERE position % 50 = 0""")
def a3_batch_checkpoints(spark, sf_dir):
    numbered = events(spark, sf_dir).withColumn("position", F.col("event_id") + 1)
    return A.batch_checkpoints(numbered, F.col("event_type") != "error", batches_per_chunk=30)


@query("SELECT DISTINCT event_type AS key FROM events UNION SELECT DISTINCT 'k' FROM events "
       "WHERE props LIKE '%\"k\"%'")
def a5_distinct_keys(spark, sf_dir):
    maps = F.map_concat(F.create_map("event_type", F.col("value").cast("string")),
                        F.from_json("props", "map<string,string>"))
    return A.distinct_keys(events(spark, sf_dir), maps)


# --- triage --------------------------------------------------------------------------------

@query("""SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'ok' WHEN 1 THEN 'skip' WHEN 2 THEN 'retry'
  WHEN 3 THEN 'retry' WHEN 4 THEN 'fatal' WHEN 5 THEN 'retry' WHEN 6 THEN 'retry' WHEN 7 THEN 'fatal'
  ELSE 'retry' END AS action FROM events""")
def x1_fetch_outcome(spark, sf_dir):
    k = F.col("event_id") % 9
    status = F.get(F.array(*[F.lit(s) for s in (200, 404, 429, 503, 403)]), k.cast("int"))
    failure = F.when(k == 5, "connection").when(k == 6, "timeout").when(k == 7, "redirects").when(
        k == 8, "chunked encoding")
    return events(spark, sf_dir).select("event_id", X.fetch_outcome(status, failure).alias("action"))


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'continue' WHEN 1 THEN 'continue'
  WHEN 2 THEN 'stop' WHEN 3 THEN 'stop' WHEN 4 THEN 'continue' WHEN 5 THEN 'continue'
  ELSE 'stop' END AS decision FROM events""")
def x2_recovery(spark, sf_dir):
    k = F.col("event_id") % 8
    kind = (F.when(k < 4, "network").when(k == 4, "parsing").when(k == 5, "validation")
            .when(k == 6, "critical").otherwise("odd"))
    status = F.when(k == 0, 404).when(k == 1, 429).when(k == 2, 500)
    return events(spark, sf_dir).select("event_id", X.recovery(kind, status).alias("decision"))


@query(DETAILS + "SELECT url, 'network_errors' AS error_type, 'status 404' AS reason FROM pages_of "
       "WHERE k % 19 = 0 UNION ALL SELECT url, 'validation_errors', CASE WHEN has_specs THEN 'no model' "
       "ELSE 'no brand' END FROM wide WHERE NOT has_specs OR k % 11 = 0")
def x3_rejects(spark, sf_dir):
    pages = R.detail_pages(spark, sf_dir)
    return X.rejects(X.failed_pages(pages), D.invalid_products(D.parse_details(pages)))


@query(BOTH + f""", seen AS (SELECT l.detail_url AS url, l.shop, p.k AS captured, d.url AS parsed, d.has_specs, d.k,
  row_number() OVER (PARTITION BY l.shop ORDER BY l.page_no, l.pos) AS position
  FROM walked l LEFT JOIN pages_of p ON p.url = l.detail_url AND p.k % 23 <> 5 LEFT JOIN wide d ON d.url = p.url)
SELECT url, CASE WHEN parsed IS NULL THEN 'network_errors' ELSE 'validation_errors' END AS error_type,
  CASE WHEN parsed IS NULL THEN 'no detail page' WHEN NOT has_specs THEN 'no brand' ELSE 'no model' END AS reason,
  CASE WHEN captured IS NULL THEN 'none' WHEN captured % 19 = 0 THEN 'status 404' ELSE 'status 200' END AS capture,
  '{R.BASE}' || shop AS catalogue, CAST(position AS VARCHAR) AS position
FROM seen WHERE parsed IS NULL OR NOT has_specs OR k % 11 = 0""")
def x3_reject_context(spark, sf_dir):
    """Where a rejected product was listed, and what came of its capture; some pages were never captured."""
    pages = R.detail_pages(spark, sf_dir).where(F.regexp_extract("url", r"p-(\d+)$", 1).cast("bigint") % 23 != 5)
    listings = written(W.discover_products(R.catalogue_pages(spark, sf_dir)))
    outcomes = E.judge(listings, W.product_details(pages, listings, failed=True), stored=True)
    found = X.product_rejects(outcomes)
    return found.select("url", "error_type", "reason", *[F.col("context")[c].alias(c) for c in ("capture", "catalogue", "position")])


# --- exports ---------------------------------------------------------------------------------

def sample(spark, sf_dir):
    """A table with nulls, quotes, line breaks, booleans and variants to export."""
    key = R.k()
    variants = F.when(key % 3 == 0, F.array(F.struct(F.lit("8GB").alias("variant"), key.cast("string").alias("price"))))
    return R.part(spark, sf_dir).select(
        R.text("৳ \"x\"\n", F.col("p_name")).alias("zeta"), F.when(key % 2 == 0, F.col("p_type")).alias("model"),
        variants.alias("price_variants"), (key % 2 == 0).alias("waterproof"),
        key.cast("string").alias("alpha"), F.col("p_brand").alias("brand"))


@query("""SELECT '{"zeta":"৳ \\"x\\"\\n' || p_name || '","model":'
  || CASE WHEN p_partkey % 2 = 0 THEN '"' || p_type || '"' ELSE 'null' END || ',"price_variants":'
  || CASE WHEN p_partkey % 3 = 0 THEN '[{"variant":"8GB","price":"' || p_partkey || '"}]' ELSE 'null' END
  || ',"waterproof":' || CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END
  || ',"alpha":"' || p_partkey || '","brand":"' || p_brand || '"}' AS line FROM part""")
def k1_json_export(spark, sf_dir):
    path = scratch(spark)
    K.write_json(sample(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("""SELECT 'brand,model,alpha,price_variants,waterproof,zeta' AS line UNION ALL
  SELECT p_brand || ',' || CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END || ',' || p_partkey || ','
  || CASE WHEN p_partkey % 3 = 0 THEN '"[{""variant"":""8GB"",""price"":""' || p_partkey || '""}]"' ELSE '' END || ','
  || CASE WHEN p_partkey % 2 = 0 THEN 'Yes' ELSE 'No' END || ',৳  x  ' || p_name FROM part""")
def k2_csv_column_order(spark, sf_dir):
    """All lines of an export, with the header once."""
    path = scratch(spark)
    K.write_csv(sample(spark, sf_dir).withColumn("zeta", F.translate("zeta", '"\n', "  ")), path)
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    header = F.startswith("line", F.lit("brand,model,alpha"))
    return lines.where(header).distinct().unionByName(lines.where(~header))


#: Records with differing keys: the type of an event, and what its properties hold.
def records(spark, sf_dir):
    maps = F.map_concat(F.create_map("event_type", F.col("event_id").cast("string")), F.from_json("props", "map<string,string>"))
    return events(spark, sf_dir).select(maps.alias("m"))


@query("SELECT " + ", ".join(f"CASE WHEN event_type = '{c}' THEN CAST(event_id AS VARCHAR) ELSE '' END AS {c}"
                             for c in ("click", "error", "purchase", "signup", "view"))
       + ", coalesce(json_extract_string(props, '$.k'), '') AS k FROM events")
def k2_records_to_csv(spark, sf_dir):
    """Maps with differing keys as CSV: a column for every key that occurs."""
    path = scratch(spark)
    K.write_csv_records(records(spark, sf_dir), F.col("m"), path)
    back = K.read_csv_export(spark, path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


@query("""SELECT p_brand AS brand, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS model,
  CAST(p_partkey AS VARCHAR) AS alpha,
  CASE WHEN p_partkey % 3 = 0 THEN '[{"variant":"8GB","price":"' || p_partkey || '"}]' ELSE '' END AS price_variants,
  CASE WHEN p_partkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS waterproof,
  '৳ "x"' || chr(10) || p_name AS zeta FROM part""")
def k3_csv_rows(spark, sf_dir):
    path = scratch(spark)
    K.write_csv(sample(spark, sf_dir), path)
    back = K.read_csv_export(spark, path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


@query("SELECT 'json' AS format, p_brand AS brand, CAST(p_partkey AS VARCHAR) AS alpha FROM part UNION ALL "
       "SELECT 'csv', p_brand, CAST(p_partkey AS VARCHAR) FROM part")
def k4_dual_export(spark, sf_dir):
    out = scratch(spark)
    K.export(sample(spark, sf_dir), out, run_time=datetime(2025, 6, 1, 12, 30, 5))
    json = K.read_json_export(spark, f"{out}/phones_data_20250601_123005.json",
                              schema=sample(spark, sf_dir).schema)
    csv = K.read_csv_export(spark, f"{out}/phones_data_20250601_123005.csv")
    return json.select(F.lit("json").alias("format"), "brand", "alpha").unionByName(
        csv.select(F.lit("csv").alias("format"), "brand", "alpha"))


@query("SELECT p_type, '20250' || (length(p_type) % 9 + 1) || '01_000000' AS run_ts, count(*) AS n "
       "FROM part GROUP BY p_type")
def k5_timestamped_names(spark, sf_dir):
    """One export per part type, found again by the time in its name."""
    out = scratch(spark)
    rows = R.part(spark, sf_dir)
    # One write gives every month its folder; the names are those of the snapshots of that month.
    month = F.length("p_type") % 9 + 1
    months = {m: K.snapshot_name("json", run_time=datetime(2025, m, 1)) for m in range(1, 10)}
    name = F.coalesce(*[F.when(month == m, n) for m, n in months.items()])
    rows.withColumn("kind", F.col("p_type")).withColumn("snapshot", name).write.partitionBy("kind", "snapshot").json(out)
    run_ts = F.regexp_extract(F.input_file_name(), r"_(\d{8}_\d{6})\.json", 1)
    exported = spark.read.json(out).select("p_type", run_ts.alias("run_ts"))
    return exported.groupBy("p_type", "run_ts").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS run_ts, o_orderdate IN (SELECT DISTINCT "
       "o_orderdate FROM orders ORDER BY 1 DESC LIMIT 5) AS kept FROM orders")
def k7_keep_newest(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    runs = orders.select(F.date_format("o_orderdate", "yyyyMMdd").alias("run_ts")).distinct()
    return K.mark_kept(runs, keep=5)


@query("SELECT true AS success, f AS format, count(*) AS record_count, p_brand AS brand, count(*) AS rows_read "
       "FROM part, (VALUES ('json'), ('csv')) t(f) GROUP BY f, p_brand".replace("count(*) AS record_count", "(SELECT count(*) FROM part) AS record_count"))
def k8_export_result(spark, sf_dir):
    """What an export tells of itself, beside the rows by brand that are read back from the files it names."""
    told = K.export(sample(spark, sf_dir), scratch(spark))
    path = {r.format: r.path for r in told.collect()}
    back = K.read_json_export(spark, path["json"], schema=sample(spark, sf_dir).schema).select(
        F.lit("json").alias("format"), "brand").unionByName(
        K.read_csv_export(spark, path["csv"]).select(F.lit("csv").alias("format"), "brand"))
    rows = back.groupBy("format", "brand").agg(F.count("*").alias("rows_read"))
    return told.join(rows, "format").select("success", "format", "record_count", "brand", "rows_read")


@query("SELECT 'negative' AS kind, 0::BIGINT AS exported, true AS refused UNION ALL SELECT 'all', count(*), false FROM part")
def k6_empty_guard(spark, sf_dir):
    """Two exports, one without rows: it is refused, and the other one's rows are there."""
    rows, found = sample(spark, sf_dir), []
    for kind, part in (("negative", rows.where(F.col("alpha").cast("bigint") < 0)), ("all", rows)):
        out = scratch(spark)
        try:
            K.export(part, out)
        except ValueError:
            found.append(spark.range(1).select(F.lit(kind).alias("kind"), F.lit(0).cast("bigint").alias("exported"), F.lit(True).alias("refused")))
        else:
            back = K.read_json_export(spark, K.newest_export(spark, out), schema=rows.schema)
            found.append(back.groupBy(F.lit(kind).alias("kind")).agg(F.count("*").alias("exported")).withColumn("refused", F.lit(False)))
    return found[0].unionByName(found[1])


@query("""SELECT p_brand AS brand, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS model,
  CAST(p_partkey AS VARCHAR) AS alpha, '৳ "x"' || chr(10) || p_name AS zeta FROM part""")
def s4_split_csv(spark, sf_dir):
    """One CSV file with line breaks in its values, read in many ranges."""
    path = scratch(spark)
    K.write_csv(sample(spark, sf_dir).coalesce(1), path)
    back = K.read_csv_export(spark, path, split=True)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("brand", "model", "alpha", "zeta")])


@query("""SELECT p_brand AS brand, CAST(p_partkey AS VARCHAR) AS alpha, '৳ "x"' || chr(10) || p_name AS zeta,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) END AS price FROM part""")
def s4_split_json_array(spark, sf_dir):
    """One file with one JSON array, read in many ranges."""
    path = scratch(spark)
    rows = sample(spark, sf_dir)
    text = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("o")).agg(F.collect_list("o").alias("o"))
    text.select(F.concat(F.lit("[\n"), F.array_join("o", ",\n"), F.lit("]\n"))).write.text(path)
    back = K.read_json_export(spark, path, schema=rows.schema, array=True, split=True)
    return back.select("brand", "alpha", "zeta", F.get("price_variants", 0)["price"].alias("price"))


@query(DETAILS + "SELECT url AS detail_url, brand, model, status, price_savings, "
       "CAST(n_variants AS INTEGER) AS n_variants FROM wide")
def s4_read_export_back(spark, sf_dir):
    out = scratch(spark)
    products = D.parse_details(R.detail_pages(spark, sf_dir)).select(*S.PRODUCT_COLUMNS)
    K.write_json(products, out)
    return K.read_json_export(spark, out).select(
        "detail_url", "brand", "model", "status", "price_savings", F.size("price_variants").alias("n_variants"))


@query("SELECT p_partkey, '2025-03-04T05:06:07' AS scraped_at FROM part WHERE p_partkey % 19 <> 0")
def d13_no_capture_time(spark, sf_dir):
    """Pages of an archive without capture times get the time of the run."""
    pages = R.detail_pages(spark, sf_dir).withColumn("fetched_at", F.lit(None).cast("timestamp"))
    stamp = F.to_timestamp(F.lit("2025-03-04 05:06:07"))
    key = F.regexp_extract("detail_url", r"p-(\d+)$", 1).cast("bigint").alias("p_partkey")
    return D.parse_details(pages, run_time=stamp).select(key, "scraped_at")


# --- jobs --------------------------------------------------------------------------------------

def all_pages(spark, sf_dir):
    return R.catalogue_pages(spark, sf_dir).unionByName(R.detail_pages(spark, sf_dir))


@query(BOTH + f"SELECT {ENRICHED}, CASE WHEN {REASON} IS NULL THEN 'ok' ELSE 'failed' END AS outcome, "
       f"{REASON} AS reason FROM walked l LEFT JOIN wide d ON d.url = l.detail_url")
def w1_catalogue_job(spark, sf_dir):
    judged = W.judge_catalogue(all_pages(spark, sf_dir))
    return judged.select(*ENRICHED_COLUMNS, "outcome", "reason")


@query(BOTH + f", judged AS (SELECT {REASON} AS reason FROM walked l LEFT JOIN wide d ON d.url = l.detail_url) "
       "SELECT count(*) AS total_found, count(*) AS processed, count(*) FILTER (reason IS NULL) AS successful, "
       "count(*) FILTER (reason IS NOT NULL) AS failed, "
       "100.0::DOUBLE * count(*) FILTER (reason IS NULL) / greatest(count(*), 1) AS success_rate FROM judged")
def w1_run_and_export(spark, sf_dir):
    """The whole run with its checkpoints and exports; its statistics."""
    return W.run_catalogue(spark, all_pages(spark, sf_dir), scratch(spark)).statistics


@query(BOTH + f"SELECT {ENRICHED} FROM walked l JOIN wide d ON d.url = l.detail_url "
       f"WHERE l.shop = 3 AND l.page_no >= 2 AND {REASON} IS NULL "
       "AND (l.page_no, l.pos) <= (SELECT (page_no, pos) FROM walked WHERE shop = 3 AND page_no >= 2 "
       "ORDER BY page_no, pos LIMIT 1 OFFSET 39)")
def w2_job_parameters(spark, sf_dir):
    """A run of one catalogue from its second page, for forty products."""
    result = W.run_catalogue(spark, all_pages(spark, sf_dir), scratch(spark), max_products=40,
                             start_page=2, base_url=f"{R.BASE}3")
    return result.products.select(*ENRICHED_COLUMNS)


@query(DETAILS + "SELECT url AS detail_url, brand, model FROM wide WHERE has_specs AND k % 11 <> 0")
def w3_piecewise(spark, sf_dir):
    """Steps chained by the caller: parse, validate, write, read back."""
    out = scratch(spark)
    good = R.detail_pages(spark, sf_dir).transform(D.parse_details).transform(D.valid_products)
    K.write_csv(good.select(*S.PRODUCT_COLUMNS), out)
    return K.read_csv_export(spark, out).select("detail_url", "brand", "model")


@query(DETAILS + "SELECT url, field, value FROM cells")
def t1_stream_of_pages(spark, sf_dir):
    """The specification step over a stream of page files."""
    out = scratch(spark)
    R.detail_pages(spark, sf_dir).write.parquet(f"{out}/pages")
    append_stream(stream_pages(spark, f"{out}/pages", files_per_batch=2), D.long_specs,
                  f"{out}/specs", f"{out}/state", tasks=spark.sparkContext.defaultParallelism).awaitTermination()
    return spark.read.parquet(f"{out}/specs").select("url", "field", "value")


def streamed_twice(spark, rows, steps, files=5, tasks=None):
    """Rows as a stream of files, a micro-batch each; then all batches once more, as after a lost checkpoint."""
    out = scratch(spark)
    rows.repartition(files).write.parquet(f"{out}/in")
    tables = T.BatchTables(spark, f"{out}/kept")
    for attempt in (1, 2):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
        T.keep_batches(stream, steps, tables, f"{out}/state{attempt}", tasks=tasks).awaitTermination()
    return tables


@query(SQL["a3_batch_checkpoints"])
def t2_stream_checkpoints(spark, sf_dir):
    """Running totals over a stream that brings its items in any order, all its batches twice, some of them merged."""
    items = events(spark, sf_dir).select((F.col("event_id") + 1).alias("position"), (F.col("event_type") != "error").alias("ok"))
    tables = streamed_twice(spark, items, {"sums": lambda batch: A.batch_sums(batch, F.col("ok"))})
    tables.merge("sums", 1, A.merged_sums)
    tables.merge("sums", 3, A.merged_sums)
    return T.checkpoints_so_far(tables, "sums", batches_per_chunk=30)


@query(SQL["a1_run_statistics"])
def t2_stream_statistics(spark, sf_dir):
    processed = F.col("event_id") % 7 != 0
    ok = processed & (F.col("event_type") != "error")
    rows = events(spark, sf_dir).select(F.when(ok, "ok").otherwise("failed").alias("outcome"), processed.alias("processed"))
    return T.statistics_so_far(streamed_twice(spark, rows, {"counts": A.partial_statistics}), "counts")


@query(ITEMS + WALKED + "SELECT page_url, page_no, count(*) AS products FROM walked GROUP BY page_url, page_no")
def t2_stream_walk(spark, sf_dir):
    """A walk over pages that a stream brings in any order, among them older captures without products."""
    pages = R.catalogue_pages(spark, sf_dir)
    older = pages.withColumn("html", F.lit("<p>soon</p>")).withColumn("fetched_at", F.to_timestamp(F.lit("2001-01-01 00:00:00")))
    tables = streamed_twice(spark, pages.unionByName(older), {"pages": T.listing_step(L.listing_pages)},
                            tasks=spark.sparkContext.defaultParallelism)
    tables.merge("pages", 2, T.newest_pages)
    return T.walked_pages(tables, "pages").select(F.col("url").alias("page_url"), "page_no", "products")
