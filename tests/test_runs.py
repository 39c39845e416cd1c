import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from catalog_queries import render as R
from pagelode import schema as S
from pagelode.operators import detail as D
from pagelode.operators import enrich as E
from pagelode.operators import listing as L
from pagelode.operators import stats as A
from pagelode.operators import triage as X
from pagelode.plans import catalogue as W
from pagelode.plans.storage import StoredStages, shared_folder, written
from pagelode.sinks import export as K
from pagelode.sources import captures as C
from pagelode.sources import pages as P
from pagelode.streaming import state as T
from pagelode.streaming.pages import append_stream, stream_pages

SITE = "https://shop.example.com"
BASE = f"{SITE}/list"


def detail_html(**fields):
    rows = "".join(f"<tr><td>{k}</td><td>{v}</td></tr>" for k, v in fields.items())
    return ('<section id="product-specs"><div class="row mb-2 pb-2 border-bottom"><h3 class="text-bold">G</h3>'
            f'<table class="spec-grp-tbl">{rows}</table></div></section>')


def listing_html(*records, current=1, last=2):
    data = [{"title": f"Galaxy {slug}", "slug": slug, **more} for slug, more in records]
    return "<script>let productDataArray = " + json.dumps({"current_page": current, "last_page": last, "data": data}) + ";</script>"


@pytest.fixture
def archive(pages):
    """Two listing pages with five products: two good ones, one bad, one failed and one missing."""
    def make(*more):
        return pages(
            (BASE, 1, "listing", 200, listing_html(("a", {"ram": "8GB", "os": "OS 1"}), ("b", {"thamnail": "media/b.png"}), ("c", {"brand": "Cee"}))),
            (f"{BASE}?page=2", 2, "listing", 200, listing_html(("d", {}), ("e", {}), current=2)),
            (f"{SITE}/mobile/a", None, "detail", 200, detail_html(Brand="A1", Model="a", RAM="4GB", GPU="g")),
            (f"{SITE}/mobile/b", None, "detail", 200, detail_html(Brand="B1", Model="b")),
            (f"{SITE}/mobile/c", None, "detail", 200, detail_html(GPU="only")),
            (f"{SITE}/mobile/d", None, "detail", 503, detail_html(Brand="D", Model="d")),
            (f"{SITE}/mobile/z", None, "detail", 200, detail_html(Brand="Z", Model="not listed")), *more)
    return make


# --- joins -------------------------------------------------------------------------------

def test_enrichment_rules(archive):
    table = archive()
    got = {r.detail_url[-1]: r for r in E.enrich(W.discover_products(table), W.product_details(table)).collect()}
    assert sorted(got) == ["a", "b", "c"]
    assert (got["a"].brand, got["a"].ram, got["a"].operating_system, got["a"].gpu) == ("A1", "8GB", "OS 1", "g")
    assert (got["c"].brand, got["c"].model) == ("Cee", "Galaxy c")
    assert got["b"].image_url == f"{SITE}/media/b.png"


def test_unmatched(archive):
    table = archive()
    lost = E.unmatched(W.discover_products(table), W.product_details(table)).collect()
    assert sorted(r.url[-1] for r in lost) == ["d", "e"]


def test_salted_join_equals_plain_join(spark):
    """One key holds a third of the rows, another a tenth; nulls and keys without a partner stay right."""
    n = 30_000
    k = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 10 == 1, 1).when(F.col("id") % 997 == 5, None).otherwise(
        F.col("id") % 500)
    many = spark.range(n).select(k.alias("key"), F.col("id").alias("v"))
    one = spark.range(400).select(F.col("id").alias("key"), (F.col("id") * 7).alias("w"))
    for how in ("inner", "left"):
        plain = many.join(one, "key", how)
        salted = E.join_many_to_one(many, one, "key", how, rows_per_salt=1_000)
        assert salted.columns == plain.columns
        assert salted.exceptAll(plain).isEmpty() and plain.exceptAll(salted).isEmpty()
    assert {r.key for r in E.salted_keys(many, "key", 1_000).collect()} == {0, 1}


def test_salt_spreads_the_hot_key(spark):
    many = spark.range(50_000).select(F.lit(1).alias("key"), "id")
    one = spark.createDataFrame([(1, "x")], "key int, w string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = E.join_many_to_one(many, one, "key", "inner", rows_per_salt=1_000)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 50_000 and len(sizes) > 4 and max(sizes) < 25_000


def test_judge_options(archive):
    table = archive()
    listings, details = W.discover_products(table), W.product_details(table)
    now = F.to_timestamp(F.lit("2025-02-02 00:00:00"))

    def outcomes(**options):
        return {r.detail_url[-1]: (r.outcome, r.reason) for r in E.judge(listings, details, now=now, **options).collect()}

    ok, lost = ("ok", None), ("failed", "no detail page")
    assert outcomes() == {"a": ok, "b": ok, "c": ("failed", "no brand"), "d": lost, "e": lost}
    assert outcomes(require_valid=False) == {"a": ok, "b": ok, "c": ok, "d": lost, "e": lost}
    assert outcomes(require_valid=False, on_error="skeleton") == dict.fromkeys("abcde", ok)
    assert outcomes(on_error="skeleton")["e"] == ("failed", "no brand")
    no_url = listings.withColumn("detail_url", F.lit(None).cast("string"))
    rows = E.judge(no_url, details).collect()
    assert {(r.processed, r.error_type, r.reason) for r in rows} == {(False, "parsing_errors", "no detail url")}


# --- counts and triage ---------------------------------------------------------------------

def test_run_statistics(spark):
    df = spark.createDataFrame([("ok", True), ("failed", True), ("failed", False)], "outcome string, processed boolean")
    assert A.run_statistics(df).first() == (3, 2, 1, 2, 50.0)
    assert A.run_statistics(df.limit(0)).first() == (0, 0, 0, 0, 0.0)


def test_error_counts(spark):
    df = spark.createDataFrame([(k,) for k in ("network_errors", "network", "warnings", "warnings", None)], "error_type string")
    assert {tuple(r) for r in A.error_counts(df).collect()} == {("network_errors", 1), ("warnings", 2)}


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_batch_checkpoints_against_a_loop(spark, chunk):
    n = 517
    df = spark.range(1, n + 1).select(F.col("id").alias("position"), (F.col("id") % 7 != 0).alias("ok"),
                                      (F.col("id") % 2).alias("run"))
    got = sorted(tuple(r) for r in A.batch_checkpoints(df, F.col("ok"), batches_per_chunk=chunk).collect())
    good, want = 0, []
    for i in range(1, n + 1):
        good += i % 7 != 0
        if i % 50 == 0:
            want.append((i, good, i - good))
    assert got == want
    halves = df.withColumn("position", F.ceil(F.col("position") / 2))
    assert A.batch_checkpoints(halves, F.col("ok"), by=("run",), batches_per_chunk=chunk).count() == 5 + 5


def test_distinct_keys(spark):
    df = spark.createDataFrame([({"a": 1, "b": None},), ({"b": 2},), (None,)], "m map<string,int>")
    assert sorted(r.key for r in A.distinct_keys(df, F.col("m")).collect()) == ["a", "b"]


def test_fetch_outcome(spark):
    cases = [(200, None, "ok"), (304, None, "ok"), (404, None, "skip"), (429, None, "retry"), (500, None, "retry"),
             (599, None, "retry"), (403, None, "fatal"), (None, "timeout", "retry"), (None, "connection", "retry"),
             (None, "redirects", "fatal"), (None, "other", "retry")]
    df = spark.createDataFrame(cases, "s int, f string, want string")
    assert all(r.want == r.got for r in df.withColumn("got", X.fetch_outcome(F.col("s"), F.col("f"))).collect())


def test_recovery(spark):
    cases = [("network", 404, "continue"), ("network", 429, "continue"), ("network", 500, "stop"), ("network", None, "stop"),
             ("parsing", None, "continue"), ("validation", None, "continue"), ("critical", None, "stop"), ("x", 404, "stop"), (None, None, "stop")]
    df = spark.createDataFrame(cases, "k string, s int, want string")
    assert all(r.want == r.got for r in df.withColumn("got", X.recovery(F.col("k"), F.col("s"))).collect())


# --- exports ---------------------------------------------------------------------------------

def products(spark, *changes):
    base = dict.fromkeys(S.PRODUCT_COLUMNS)
    return spark.createDataFrame([{**base, **c} for c in changes], S.PRODUCT_SCHEMA)


def test_names():
    when = datetime(2024, 1, 28, 14, 30, 52)
    assert K.snapshot_name("json", run_time=when) == "phones_data_20240128_143052.json"
    assert K.snapshot_name(".csv", "x") == "x.csv"


def test_empty_export_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        K.export(products(spark, {}).limit(0), str(tmp_path))
    assert not list(tmp_path.iterdir())


def test_column_order():
    assert K.csv_columns(["zeta", "status", "model", "alpha", "brand"]) == ["brand", "model", "status", "alpha", "zeta"]
    assert K.csv_columns(list(S.PRODUCT_COLUMNS))[:6] == ["brand", "model", "device_type", "release_date", "status", "architecture"]


def test_csv_text(spark):
    df = spark.createDataFrame([("B", None, True, [1]), ("C", "m", False, None)], "brand string, model string, wet boolean, tags array<int>")
    assert {tuple(r) for r in K.csv_rows(df).collect()} == {("B", "", "[1]", "Yes"), ("C", "m", "", "No")}


def test_export_round_trip(spark, tmp_path):
    rows = products(spark, {"brand": 'Q "uote", Inc', "model": "two\nlines ৳ ©", "price_variants": [{"variant": "8GB", "price": "1,0"}]},
                    {"brand": "B", "price_variants": []})
    done = K.export(rows, str(tmp_path), run_time=datetime(2025, 1, 1))
    assert [(r.success, r.format, r.record_count) for r in done.orderBy("format").collect()] == [(True, "csv", 2), (True, "json", 2)]
    paths = {r.format: r.path for r in done.collect()}
    back = K.read_json_export(spark, paths["json"])
    assert back.exceptAll(rows).isEmpty() and back.count() == 2
    csv = {r.brand: r for r in K.read_csv_export(spark, paths["csv"]).collect()}
    assert csv['Q "uote", Inc'].model == "two\nlines ৳ ©" and csv["B"].model is None
    assert csv['Q "uote", Inc'].price_variants == '[{"variant":"8GB","price":"1,0"}]'
    assert '"ram":null' in spark.read.text(paths["json"]).first()[0]


def test_json_array_files(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"brand": "A",\n "model": null}, {"brand": "B", "extra": 1}]')
    assert sorted(r.brand for r in K.read_json_export(spark, str(tmp_path), array=True).collect()) == ["A", "B"]


def test_snapshots(spark, tmp_path):
    for day in range(1, 8):
        K.write_json(products(spark, {"brand": "x"}), f"{tmp_path}/{K.snapshot_name('json', run_time=datetime(2025, 1, day))}")
    K.write_json(products(spark, {"brand": "x"}), f"{tmp_path}/notes.json")
    runs = K.mark_kept(K.list_snapshots(spark, str(tmp_path)), keep=3).collect()
    assert sorted(r.run_ts for r in runs if r.kept) == ["20250105_000000", "20250106_000000", "20250107_000000"]
    assert sum(not r.kept for r in runs) == 4


def test_an_export_is_whole_or_not_listed(spark, tmp_path):
    rows = products(spark, {"brand": "A"}, {"brand": "B"})
    first, second = datetime(2025, 1, 1), datetime(2025, 1, 2)
    K.export(rows, str(tmp_path), run_time=first)
    (tmp_path / K.snapshot_name("csv", run_time=second)).mkdir()  # in the way of one format
    K.export(rows, str(tmp_path), run_time=second)
    assert {(r.run_ts, r.format, r.record_count) for r in K.whole_exports(spark, str(tmp_path)).collect()} == {
        ("20250101_000000", "json", 2), ("20250101_000000", "csv", 2)}
    assert K.newest_export(spark, str(tmp_path)).endswith("phones_data_20250101_000000.json")
    assert K.newest_export(spark, str(tmp_path / "none")) is None
    # A whole export is left as it is.
    again = K.export(products(spark, {"brand": "C"}), str(tmp_path), run_time=first)
    assert {(r.success, r.format, r.record_count) for r in again.collect()} == {(True, "json", 2), (True, "csv", 2)}
    assert K.read_json_export(spark, K.newest_export(spark, str(tmp_path))).count() == 2


def test_records_with_differing_keys(spark, tmp_path):
    df = spark.createDataFrame([({"zeta": "1", "model": "m"},), ({"brand": 'B "x"', "a b": "two\nlines"},), ({},), (None,)],
                               "m map<string,string>")
    assert K.record_columns(df, F.col("m")) == ["brand", "model", "a b", "zeta"]
    K.write_csv_records(df, F.col("m"), f"{tmp_path}/c")
    back = K.read_csv_export(spark, f"{tmp_path}/c")
    assert back.columns == ["brand", "model", "a b", "zeta"]
    assert {tuple(r) for r in back.collect()} == {(None, "m", None, "1"), ('B "x"', None, "two\nlines", None), (None,) * 4}
    with pytest.raises(ValueError):
        K.record_columns(df, F.col("m"), most=3)


# --- sources -----------------------------------------------------------------------------------

def test_sources(spark, tmp_path):
    (tmp_path / "one.html").write_text("<h1>é</h1>\n<p>x</p>")
    (tmp_path / "two.html").write_text("<h1>2</h1>")
    text = P.read_text_pages(spark, str(tmp_path), kind="detail")
    binary = P.read_binary_pages(spark, str(tmp_path), url=F.concat(F.lit("https://s.example/"), F.element_at(F.split("path", "/"), -1)))
    assert sorted(r.html for r in text.collect()) == ["<h1>2</h1>", "<h1>é</h1>\n<p>x</p>"]
    assert {(r.url, r.status_code, r.page_no) for r in binary.collect()} == {("https://s.example/one.html", 200, 1), ("https://s.example/two.html", 200, 1)}
    types = [df.schema.simpleString() for df in (text, binary)]
    assert types == [S.PAGE_SCHEMA.simpleString()] * 2 and binary.first().fetched_at is not None
    text.write.parquet(f"{tmp_path}/p")
    assert P.read_parquet_pages(spark, f"{tmp_path}/p").count() == 2
    assert "GreaterThanOrEqual(page_no,2)" in P.from_page(spark.read.parquet(f"{tmp_path}/p"), 2)._jdf.queryExecution().toString()


def test_latest_captures(spark):
    t = lambda s: datetime(2025, 1, 1, 0, 0, s)
    df = spark.createDataFrame([("a", t(1), "old"), ("a", t(3), "new"), ("a", t(3), "new"), ("b", None, "only"), ("c", None, "x"), ("c", t(0), "y")],
                               "url string, fetched_at timestamp, v string")
    assert {(r.url, r.v) for r in P.latest_captures(df, "url").collect()} == {("a", "new"), ("b", "only"), ("c", "y")}


# --- jobs ----------------------------------------------------------------------------------------

def test_whole_run(spark, archive, tmp_path):
    newer = (f"{SITE}/mobile/b", None, "detail", 200, detail_html(Brand="B2", Model="b"), datetime(2025, 5, 5))
    older = (f"{SITE}/mobile/a", None, "detail", 404, None, datetime(2024, 5, 5))
    run = W.run_catalogue(spark, archive(newer, older), str(tmp_path), run_time=datetime(2025, 6, 1))
    assert run.success and run.statistics.first() == (5, 5, 2, 3, 40.0)
    assert {(r.brand, r.ram) for r in run.products.collect()} == {("A1", "8GB"), ("B2", None)}
    assert {(r.url[-1], r.error_type) for r in run.rejects.collect()} == {
        ("c", "validation_errors"), ("d", "network_errors"), ("e", "network_errors")}
    assert {tuple(r) for r in run.error_counts.collect()} == {("validation_errors", 1), ("network_errors", 2)}
    assert K.read_json_export(spark, f"{tmp_path}/phones_data_20250601_000000.json").count() == 2


def test_a_broken_run_goes_on(spark, archive, tmp_path, monkeypatch):
    name, table = f"test-{tmp_path.name}-{datetime.now().timestamp()}", archive()

    def broken(*args, **options):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(W, "export", broken)
        with pytest.raises(RuntimeError):
            W.run_catalogue(spark, table, str(tmp_path), run_id=name, run_time=datetime(2025, 6, 1))
    # What is stored is not read from the pages again: they are unreadable by now.
    gone = table.withColumn("html", F.raise_error(F.lit("parsed again")).cast("string"))
    run = W.run_catalogue(spark, gone, str(tmp_path), run_id=name)
    assert run.success and run.stages == [] and run.statistics.first() == (5, 5, 2, 3, 40.0)
    plain = W.run_catalogue(spark, table, f"{tmp_path}/plain", run_time=datetime(2025, 6, 1))
    assert plain.stages == ["listing", "listings", "outcomes", "rejects"]
    for one, other in ((run.products, plain.products), (run.rejects.drop("context"), plain.rejects.drop("context"))):
        assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()
    # After a whole export, too; other parameters would not fit the tables.
    assert W.run_catalogue(spark, gone, str(tmp_path), run_id=name).success
    with pytest.raises(ValueError):
        W.run_catalogue(spark, table, str(tmp_path), run_id=name, max_products=1)


def test_half_written_stages_are_made_again(spark, tmp_path):
    stages = StoredStages(spark, str(tmp_path), {})
    spark.range(3).write.parquet(f"{tmp_path}/numbers")  # without a marker
    assert stages.table("numbers", lambda: spark.range(5)).count() == 5 and stages.made == ["numbers"]
    again = StoredStages(spark, str(tmp_path), {})
    assert again.table("numbers", lambda: spark.range(9)).count() == 5 and again.made == []


def test_rejects_tell_where_and_why(spark, archive, tmp_path):
    run = W.run_catalogue(spark, archive((f"{BASE}?page=3", 3, "listing", 503, None)), str(tmp_path))
    got = {r.url.rsplit("/", 1)[-1]: r for r in run.rejects.collect()}
    assert got["d"].context == {"capture": "status 503", "catalogue": BASE, "position": "4"}
    assert got["e"].context == {"capture": "none", "catalogue": BASE, "position": "5"}
    assert got["c"].context == {"capture": "status 200", "catalogue": BASE, "position": "3"}
    assert got["list?page=3"].context == {"status": "503", "catalogue": BASE, "page": "3"}
    assert {r.reason for r in got.values()} == {"no detail page", "no brand", "status 503"}


def test_only_newest_captures_of_listed_pages_are_parsed(spark, archive):
    when = lambda d: datetime(2025, 2, d)
    more = [(f"{SITE}/mobile/{s}", None, "detail", 200, detail_html(Brand=f"{s}{d}", Model="m"), when(d))
            for s in ("a", "b", *(f"other{i}" for i in range(300))) for d in (1, 2, 3)]
    table = archive(*more)
    listings = written(W.discover_products(table))
    details = table.where("kind = 'detail'")
    passed = C.newest_wanted(details, listings)
    want = {(f"{SITE}/mobile/{s}", t) for s, t in (("a", when(3)), ("b", when(3)), ("c", datetime(2025, 1, 2, 3, 4, 5)),
                                                   ("d", datetime(2025, 1, 2, 3, 4, 5)))}
    got = [(r.url, r.fetched_at) for r in passed.collect()]
    assert want <= set(got) and len(got) <= len(want) + 2 and details.count() > 900
    every, few = W.product_details(table), W.product_details(table, listings)
    join = lambda d: E.judge(listings, d, now=F.to_timestamp(F.lit("2025-01-01 00:00:00")))
    assert join(every).exceptAll(join(few)).isEmpty() and join(few).exceptAll(join(every)).isEmpty()
    plan = passed._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "broadcast" in plan


def test_key_filter_loses_no_key(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("key"))
    others = spark.range(100_000, 300_000)
    for bits in (C.key_bits(20_000), C.PART_BITS):
        parts = C.key_filter(keys, bits)
        assert C.may_have_key(keys, F.col("key"), parts, bits).count() == 20_000
        passed = C.may_have_key(others, F.xxhash64("id"), parts, bits).count()
        assert passed < 200_000 * (0.08 if bits > C.PART_BITS else 0.6)
        assert parts.count() <= bits / C.PART_BITS
    assert C.key_bits(0) == C.PART_BITS and C.key_bits(10 ** 12) == C.MOST_BITS
    assert C.may_have_key(others, F.xxhash64("id"), C.key_filter(keys.limit(0), C.PART_BITS), C.PART_BITS).count() == 0


def test_newest_capture_decides_even_if_it_failed(archive):
    gone = (f"{SITE}/mobile/a", None, "detail", 404, None, datetime(2026, 5, 5))
    assert "a" not in {r.detail_url[-1] for r in W.product_details(archive(gone)).collect()}


def test_run_options(spark, archive, tmp_path):
    small = W.run_catalogue(spark, archive(), f"{tmp_path}/1", max_products=2, base_url=BASE)
    assert small.statistics.first()[:2] == (2, 2) and small.products.count() == 2
    late = W.run_catalogue(spark, archive(), f"{tmp_path}/2", start_page=2)
    assert not late.success and late.exports is None and late.statistics.first() == (2, 2, 0, 2, 0.0)
    none = W.run_catalogue(spark, archive(), f"{tmp_path}/3", base_url=f"{SITE}/other")
    assert not none.success and none.statistics.first() == (0, 0, 0, 0, 0.0)
    loose = W.run_catalogue(spark, archive(), f"{tmp_path}/4", require_valid=False)
    assert sorted(r.brand for r in loose.products.collect()) == ["A1", "B1", "Cee"]


def test_positions_count_products_of_a_catalogue(archive):
    got = [(r.position, r.slug) for r in W.discover_products(archive()).orderBy("position").collect()]
    assert got == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]


def test_shared_folder_follows_the_session():
    class Session:
        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)
        conf = {"spark.checkpoint.dir": "hdfs://shared/", "spark.sql.warehouse.dir": "file:/house"}
    assert shared_folder(Session).startswith("hdfs://shared/pagelode/")
    Session.conf = {"spark.sql.warehouse.dir": "file:/house"}
    assert shared_folder(Session).startswith("file:/house/pagelode/") and shared_folder(Session) != shared_folder(Session)


def test_null_keys_and_many_frequent_keys_fill_several_partitions(spark):
    many = spark.range(30_000).select(F.when(F.col("id") < 15_000, None).otherwise(F.col("id") % 1_100).alias("key"), "id")
    one = spark.range(1_100).select(F.col("id").alias("key"), F.lit("x").alias("w"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = E.join_many_to_one(many, one, "key", "left", rows_per_salt=5)
        parts = joined.groupBy(F.spark_partition_id().alias("p")).agg(
            F.count("*").alias("n"), F.count_if(F.col("key").isNull()).alias("nulls"), F.count_if(F.col("key") == 1_099).alias("last")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(p.n for p in parts) == 30_000 and max(p.nulls for p in parts) < 5_000
    assert sum(p["last"] > 0 for p in parts) > 1


def test_capture_time_from_the_run(archive):
    table = archive().withColumn("fetched_at", F.lit(None).cast("timestamp"))
    stamp = F.to_timestamp(F.lit("2025-03-04 05:06:07"))
    assert {r.scraped_at for r in D.parse_details(table, run_time=stamp).collect()} == {"2025-03-04T05:06:07"}
    assert {r.scraped_at for r in D.parse_details(table).collect()} == {None}


def test_failed_export_is_a_row(spark, archive, tmp_path):
    run_time = datetime(2025, 6, 1)
    (tmp_path / K.snapshot_name("csv", run_time=run_time)).mkdir()  # in the way of one format
    run = W.run_catalogue(spark, archive(), str(tmp_path), run_time=run_time)
    rows = {r.format: r for r in run.exports.collect()}
    assert rows["json"].success and rows["json"].record_count == 2 and rows["json"].error is None
    assert not rows["csv"].success and rows["csv"].record_count == 0 and "already exists" in rows["csv"].error
    assert not run.success and run.statistics.first().total_found == 5


def test_bad_bytes_cost_no_page(spark, tmp_path):
    (tmp_path / "bad.html").write_bytes(b"\x41\xff\xfe\x42")
    assert P.read_binary_pages(spark, str(tmp_path)).first().html == "A\ufffd\ufffdB"
    assert P.read_binary_pages(spark, str(tmp_path), charset="ISO-8859-1").first().html == "Aÿþ" + "B"
    with pytest.raises(ValueError):
        P.read_binary_pages(spark, str(tmp_path), charset="UTF-16")


# --- stream --------------------------------------------------------------------------------------

@pytest.mark.parametrize("step", [
    lambda p: L.explode_products(L.listing_pages(p)), D.long_specs,
    lambda p: D.parse_details(p).drop("price_variants")])
def test_stream_equals_batch(spark, archive, tmp_path, step):
    archive().repartition(3).write.parquet(f"{tmp_path}/in")
    append_stream(stream_pages(spark, f"{tmp_path}/in", 1), step, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    batch, stream = step(archive()), spark.read.parquet(f"{tmp_path}/out")
    assert stream.count() == batch.count() > 0
    assert stream.select(batch.columns).exceptAll(batch).isEmpty()


def test_narrow_steps_do_not_shuffle(archive):
    for step in (lambda p: L.explode_products(L.listing_pages(p)), D.long_specs, D.parse_details):
        assert "Exchange" not in step(archive())._jdf.queryExecution().executedPlan().toString()


def test_scans_read_what_they_need(spark, archive, tmp_path):
    archive().write.parquet(f"{tmp_path}/p")
    stored = spark.read.parquet(f"{tmp_path}/p")

    def explained(df):
        return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")

    plan = explained(D.long_specs(stored))
    assert "EqualTo(kind,detail)" in plan and "EqualTo(status_code,200)" in plan
    assert "ReadSchema: struct<url:string,kind:string,status_code:int,html:string>" in plan
    listing = explained(L.listing_pages(W._of_catalogue(stored, BASE)))
    assert "EqualTo(kind,listing)" in listing and "StringStartsWith(url,https://shop.example.com/list)" in listing


def parts(spark, path, n=60):
    """A ``part`` table of a few rows for the queries that render pages."""
    spark.range(n).selectExpr("id AS p_partkey", "concat('name ', id) AS p_name", "concat('Brand#', id % 5) AS p_brand",
                              "'TYPE' AS p_type", "cast(id % 50 AS int) AS p_size", "900.5 + id AS p_retailprice").write.parquet(
        f"{path}/part.parquet")
    return str(path)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().sparkPlan().toString()


def test_tasks_share_a_batch_of_one_file(spark, tmp_path):
    pages = R.detail_pages(spark, parts(spark, tmp_path))
    pages.coalesce(1).write.parquet(f"{tmp_path}/in")
    marked = lambda rows: rows.select("url", F.spark_partition_id().alias("task"))
    append_stream(stream_pages(spark, f"{tmp_path}/in", 1), marked, f"{tmp_path}/out", f"{tmp_path}/cp", tasks=3).awaitTermination()
    tables = T.BatchTables(spark, f"{tmp_path}/kept")
    T.keep_batches(stream_pages(spark, f"{tmp_path}/in", 1), {"rows": marked}, tables, f"{tmp_path}/cp2", tasks=3).awaitTermination()
    for got in (spark.read.parquet(f"{tmp_path}/out"), tables.rows("rows")):
        assert got.select("task").distinct().count() == 3
        assert sorted(r.url for r in got.collect()) == sorted(r.url for r in pages.collect())


def test_f12_parses_pages_once(spark, tmp_path):
    from catalog_queries.detail_queries import QUERIES
    split = QUERIES["f12_validated_split"](spark, parts(spark, tmp_path))
    assert "product-specs" not in plan_of(split)[0]  # both sides read the parsed rows
    reason = lambda k: "no brand" if k % 17 == 0 else "no model" if k % 11 == 0 else "valid"
    assert {r.url.rsplit("-", 1)[1]: r.reason for r in split.collect()} == {
        str(k): reason(k) for k in range(60) if k % 19}


def test_urls_of_good_captures_need_no_page_text(spark):
    page = lambda url, status, day, html="<p>": (url, None, "detail", status, html, datetime(2025, 1, day))
    pages = spark.createDataFrame(
        [page("a", 200, 1), page("a", 404, 2), page("b", 404, 1), page(" b\n", 200, 2), page("c", 200, 1), page("c", 200, 1),
         page("d", None, 3), page("d", 200, 1), page(None, 200, 1), ("e", 1, "listing", 200, "", datetime(2025, 1, 1))], S.PAGE_SCHEMA)
    got = W.parsed_urls(pages)
    assert "html" not in plan_of(got.where("detail_url <> 'x'"))[0].split("LogicalRDD")[0]
    want = sorted(str(r.detail_url) for r in W.product_details(pages).collect())
    assert sorted(str(r.detail_url) for r in got.collect()) == want == ["None", "b", "c"]


def test_l3_sends_no_pages_to_the_driver(spark, tmp_path):
    from catalog_queries.listing_queries import QUERIES
    assert "Broadcast" not in plan_of(QUERIES["l3_source_precedence"](spark, parts(spark, tmp_path)))[1]


def test_long_texts_are_no_missing_values(spark):
    from pagelode.functions.text import missing_to_null
    texts = ["N/A", "na", "NOT Available", "-", "", "not available!", "a longer text than any token", "x", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", missing_to_null(F.col("t")).alias("v"))
    assert [r.v for r in rows.collect()] == [None] * 5 + texts[5:]
    assert "char_length" in plan_of(rows)[0] or "length(t" in plan_of(rows)[0]
