import json
import random

from pyspark.sql import functions as F

from pagelode.operators import listing as L
from pagelode.operators import pagination as G

SITE = "https://shop.example.com"
BASE = f"{SITE}/list"


def script(data, current=1, last=9, name="let productDataArray"):
    return f"<html><script>\n{name} = " + json.dumps(
        {"current_page": current, "last_page": last, "data": data}) + ";</script></html>"


def record(slug, title=None, **more):
    return {"type": "mobile", "title": title or f"Galaxy {slug}", "slug": slug, **more}


def rows(listing):
    return [r.asDict() for r in L.explode_products(listing).orderBy("page_no", "pos").collect()]


def listing(pages, *htmls):
    return L.listing_pages(pages(*[
        (BASE if i == 0 else f"{BASE}?page={i + 1}", i + 1, "listing", 200, h) for i, h in enumerate(htmls)]))


def test_embedded_catalogue_with_an_advertisement(pages):
    html = script([
        record("nord-9", "OnePlus Nord 9", id=1, avibility="In Stock", thamnail="media/n9.webp", brand=25,
               price_official=21999, price_unofficial=None, ram="8GB"),
        record("zed-1", "Zed One", brand="Zed", thumbnail="https://i.example.com/z.png",
               price_unofficial="18500", battery=None),
        {"type": "advertisement", "title": "Big Offer Phone", "slug": "big"}]) + '<a href="?page=2">Next</a>'
    got = listing(pages, html)
    one, two = rows(got)
    assert (one["title"], one["slug"], one["brand"], one["availability"]) == ("OnePlus Nord 9", "nord-9", "OnePlus", "In Stock")
    assert one["detail_url"] == f"{SITE}/mobile/nord-9" and one["image_url"] == f"{SITE}/media/n9.webp"
    assert (one["price_official"], one["price_unofficial"]) == (21999, None)
    assert (two["brand"], two["price_unofficial"], two["image_url"]) == ("Zed", 18500, "https://i.example.com/z.png")
    assert got.first().next_page_url == f"{BASE}?page=2"


def test_every_script_pattern_and_its_order(pages):
    one = json.dumps([record("list-one")])
    htmls = [script([record("a")], name="VAR productDataArray"), script([record("b")], name="productDataArray"),
             f"<script>let phones = {one};</script>", f"<script>var   phones={one};</script>",
             # The object without products gives way to the list.
             script([]) + f"<script>let phones = {one};</script>",
             # The first pattern with products wins.
             "<script>var productDataArray = " + json.dumps({"data": [record("second")]}) + ";</script>" + script([record("first")])]
    assert [r["slug"] for r in rows(listing(pages, *htmls))] == ["a", "b", "list-one", "list-one", "list-one", "first"]


def test_bad_catalogues_give_nothing_and_do_not_fail(pages):
    broken = '<script>let productDataArray = {"data": [ {"title": "Phone X", "slug": "x" // c\n ] };</script><td>open'
    odd = "<script>let productDataArray = {'data': [{'title': 'Phone', 'slug': 'p'}]};</script>"
    got = listing(pages, broken, script([], 999, 207), "<p>nothing</p>", odd, None)
    assert rows(got) == []
    assert [r.next_page_url for r in got.orderBy("page_no").collect()] == [None] * 5


def test_one_bad_record_does_not_cost_the_page(pages):
    html = script([7, "text", None, {"title": None, "slug": "none", "ram": 1}, record("good"), {"title": "Phone"}, {"slug": "only"}])
    table = pages((BASE, 1, "listing", 200, html))
    assert [r["slug"] for r in rows(L.listing_pages(table))] == ["good"]
    assert [r.reason for r in L.listing_rejects(table).collect()] == ["record without a title"]


def test_product_predicate(spark):
    cases = [({"title": "iPhone X", "slug": "x", "type": "mobile"}, True), ({"title": "iPhone X"}, False),
             ({"title": "iPhone X", "slug": "x", "type": "laptop"}, False), ({"title": "Thing", "slug": "t"}, False),
             ({"title": "Thing", "slug": "t", "ram": None}, True), ({"title": "Thing", "slug": "t", "type": ""}, False),
             ({"title": None, "slug": "t"}, False)]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "i int, m map<string,string>")
    got = {r.i: r.ok for r in df.select("i", L.is_product(F.col("m")).alias("ok")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_filters_and_first_of_slug(pages):
    html = script([record("a"), record("ad", "Sponsored phone"), record("a", "Galaxy again"), record("i", "Ideal phone"),
                   record("s", "LG"), record("b"), record("", "Galaxy none")])
    assert [(r["pos"], r["slug"], r["title"]) for r in rows(listing(pages, html))] == [
        (0, "a", "Galaxy a"), (1, "b", "Galaxy b")]
    # A rejected record does not take the slug.
    html = script([record("d", "Galaxy deal"), record("d", "Galaxy D")])
    assert [r["title"] for r in rows(listing(pages, html))] == ["Galaxy D"]


def test_slugs_repeat_across_pages(pages):
    assert len(rows(listing(pages, script([record("a")]), script([record("a")])))) == 2


def test_anchors(pages):
    html = ('<a href="/about">About</a><!-- <a href="/mobile/hidden">x</a> --><script>"<a href=\'/mobile/js\'>"</script>'
            '<div class="phone-item"><a class="c" href="/mobile/nord-9/"><img src="" data-src="media/n.png">'
            "<h3>OnePlus <b>Nord</b></h3></a></div>"
            "<A HREF='https://o.example.com/mobile/x/mobile/pixel-7' title='Google Pixel &amp; 7'>t</A>"
            "<a href=/mobile/galaxy-s24fe></a><a href='/mobile/'>none</a><a href=\"/mobile/never-closed\">Nokia 1")
    got = rows(listing(pages, html))
    assert [(r["slug"], r["title"], r["brand"]) for r in got] == [
        ("nord-9", "OnePlusNord", "OnePlus"), ("pixel-7", "Google Pixel & 7", "Google"),
        ("galaxy-s24fe", "Galaxy S24Fe", "Galaxy"), ("never-closed", "Nokia 1", "Nokia")]
    assert got[0]["image_url"] == f"{SITE}/media/n.png" and got[1]["detail_url"] == "https://o.example.com/mobile/x/mobile/pixel-7"


def test_catalogue_wins_over_anchors_before_filters(pages):
    # The catalogue's only product is filtered out afterwards; its anchors still do not count.
    html = script([record("d", "Galaxy deal")]) + '<a href="/mobile/nord-9">OnePlus</a>'
    assert rows(listing(pages, html)) == []


def test_next_page_signals(pages):
    data = [record("a")]
    htmls = [
        script(data, 1, 5),                                             # payload says so
        script(data, 2, 2),                                             # last page: products, so it is guessed
        script([], 3, 9),                                               # no data
        "<script>let phones = []</script><a href='/l?page=50&amp;x'>n</a>",   # substring match on page=5
        "<a href='?sort=a&page=6'>a</a><a href='?page=6'>b</a>",        # a link that starts with the page first
        "<div class='x product-item'></div>",                           # item class, so it is guessed
        "<p class='product-items'>no</p>",
        "<a href='https://o.example.com/l?page=9'>n</a>",
    ]
    got = [r.next_page_url for r in listing(pages, *htmls).orderBy("page_no").collect()]
    assert got == [f"{BASE}?page=2", f"{BASE}?page=3", None, f"{SITE}/l?page=50&x", f"{BASE}?page=6",
                   f"{BASE}?page=7", None, "https://o.example.com/l?page=9"]


def test_guesses_have_no_end_of_their_own(pages):
    item = "<div class='phone-item'></div>"
    table = pages(*[(f"{BASE}?page={n}", n, "listing", 200, item) for n in (209, 210, 3000)])

    def ends(**options):
        return [r.next_page_url is None for r in L.listing_pages(table, **options).orderBy("page_no").collect()]
    assert ends() == [False] * 3 and ends(max_guessed_pages=210) == [False, True, True]


def walk(listing_df):
    return [r.page_no for r in listing_df.orderBy("page_no").collect()]


def test_walk_ends_at_gaps_empty_pages_and_missing_signals(pages):
    full = script([record("a"), record("b")], 1, 9)
    make = lambda numbers, **odd: L.listing_pages(pages(*[
        (f"{BASE}?page={n}", n, "listing", odd.get(f"s{n}", 200), odd.get(f"p{n}", full)) for n in numbers]))
    assert walk(G.take_pages(make([1, 2, 3]))) == [1, 2, 3]
    assert walk(G.take_pages(make([1, 2, 4]))) == [1, 2]
    assert walk(G.take_pages(make([2, 3]))) == []
    assert walk(G.take_pages(make([2, 3]), start_page=2)) == [2, 3]
    assert walk(G.take_pages(make([1, 2, 3], p2=script([])))) == [1]
    assert walk(G.take_pages(make([1, 2, 3], s2=503))) == [1]
    no_signal = "<script>let phones = " + json.dumps([record("z")]) + ";</script>"
    assert walk(G.take_pages(make([1, 2, 3], p2=no_signal))) == [1, 2]
    assert walk(G.take_first(make([1, 2, 3], p2=no_signal), 9)) == [1, 2, 3]


def test_long_walks(pages):
    full = script([record("a")], 1, 999)
    table = L.listing_pages(pages(*[(f"{BASE}?page={n}", n, "listing", 200, full) for n in range(1, 301)]))
    assert walk(G.take_pages(table)) == list(range(1, 301))
    assert walk(G.take_pages(table, start_page=260)) == list(range(260, 301))
    assert walk(G.take_pages(table, start_page=10, max_pages=5)) == list(range(10, 15))


def plain_walk(rows, start, signals=True, reached=False):
    """(number, products before) of the pages that count; ``rows``: number to (products, tells of a next one)."""
    out, before, n = [], 0, start
    while n in rows:
        products, more = rows[n]
        if products or reached:
            out.append((n, before))
        before += products
        if not products or (signals and not more):
            break
        n += 1
    return out


def test_walks_by_chunks_equal_a_loop(spark):
    """Catalogues that end in, at and after the bounds of chunks, with gaps, empty pages and repeated captures."""
    rng = random.Random(11)
    catalogues, rows = {}, []
    for c in range(60):
        length = rng.choice([0, 1, 3, 4, 5, 8, 9, 12, 17])
        pages = {n: (rng.randrange(1, 4), True) for n in range(1, length + 1)}
        for n in list(pages):
            kind = rng.random()
            if kind < 0.06:
                del pages[n]
            elif kind < 0.12:
                pages[n] = (0, rng.random() < 0.5)
            elif kind < 0.18:
                pages[n] = (pages[n][0], False)
        base = None if c == 0 else f"c{c}"
        catalogues[base] = pages
        for n, (count, more) in pages.items():
            made = [f"{base}-{n}-{i}" for i in range(count)]
            rows += [(base, n, 2, made, "next" if more else None)] * rng.choice([1, 1, 2]) + [(base, n, 1, ["old"] * 9, None)]
    df = spark.createDataFrame(rows, "base_url string, page_no int, fetched_at int, products array<string>, next_page_url string")
    stored = G.stored_listing(df.repartition(5))
    for start, per_chunk, signals, reached in ((1, 4, True, False), (3, 4, True, True), (1, 1, False, False), (1, 1024, True, True)):
        walked = G._walk(stored, start, None, signals=signals, per_chunk=per_chunk)
        walked = walked if reached else walked.where(F.size("products") > 0)
        got = {}
        for r in walked.collect():
            got.setdefault(r.base_url, []).append((r.page_no, r.products_before))
        want = {b: w for b, p in catalogues.items() if (w := plain_walk(p, start, signals, reached))}
        assert {b: sorted(v) for b, v in got.items()} == want
    taken, n, cut = G.take_pages(stored), 4, {}
    for r in G.limit_products(taken, n).collect():
        cut.setdefault(r.base_url, []).append((r.page_no, len(r.products)))
    for base, p in catalogues.items():
        want, left = [], n
        for number, _ in plain_walk(p, 1):
            if left > 0:
                want.append((number, min(left, p[number][0])))
                left -= p[number][0]
        assert sorted(cut.get(base, [])) == want


def test_a_long_catalogue_is_spread_over_windows_without_products(spark):
    n = 20_000
    df = spark.range(1, n + 1).select(
        F.lit("c").alias("base_url"), F.col("id").cast("int").alias("page_no"), F.lit(1).alias("fetched_at"),
        F.array(F.lit("p"), F.lit("q")).alias("products"), F.lit("x").alias("next_page_url"))
    stored = G.stored_listing(df)
    sizes = [r.pages for r in G.pages_by_chunk(stored).collect()]
    assert sum(sizes) == n and len(sizes) == -(-n // G.PAGES_PER_CHUNK) and max(sizes) == G.PAGES_PER_CHUNK
    walked = G.take_pages(stored)
    assert walked.count() == n and walked.agg(F.max("products_before")).first()[0] == 2 * (n - 1)
    plan = walked._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("products#")[0] and not [x for x in plan.splitlines() if "Window" in x and "products#" in x]


def test_one_stop_rule_for_every_size(pages):
    no_signal = "<script>let phones = " + json.dumps([record(f"z{i}") for i in range(10)]) + ";</script>"
    full = script([record(f"y{i}") for i in range(60)], 2, 9)
    table = listing(pages, no_signal, full)
    assert [sum(len(r.products) for r in G.discover(table, n).collect()) for n in (50, 51, None)] == [10, 10, 10]


def test_rejects_of_reached_pages(pages):
    untitled = {"type": "mobile", "title": None, "slug": "u"}
    odd = "<script>let phones = " + json.dumps([record("b"), untitled]) + "</script><script>var phones = [];</script>"
    odd = odd.replace("]</script>", "];</script>", 1) + "<a href='?page=3'>3</a>"
    make = [(f"{BASE}?page={n}", n, "listing", s, h) for n, s, h in (
        (1, 200, script([record("a"), untitled, untitled])), (2, 200, odd), (3, 503, None), (4, 200, script([untitled])))]
    table = L.listing_pages(pages(*make), rejects=True)
    got = sorted((r.url[-1], r.error_type, r.reason) for r in L.page_rejects(G.reached_pages(table)).collect())
    assert got == [("1", "parsing_errors", "record without a title")] * 2 + [
        ("2", "parsing_errors", "record without a title"), ("3", "network_errors", "status 503")]


def test_limits_cut_in_page_order(pages):
    htmls = [script([record(f"{p}-{i}") for i in range(3)]) for p in range(4)]
    slugs = lambda df: [r["slug"] for r in rows(df)]
    assert slugs(G.take_first(listing(pages, *htmls), 5)) == ["0-0", "0-1", "0-2", "1-0", "1-1"]
    assert slugs(G.discover(listing(pages, *htmls), 4, start_page=2)) == ["1-0", "1-1", "1-2", "2-0"]
    assert len(slugs(G.discover(listing(pages, *htmls), 0))) == 12
    assert len(slugs(G.discover(listing(pages, *htmls), 60))) == 12
    assert slugs(G.limit_products(G.take_pages(listing(pages, *htmls)), 7))[-1] == "2-0"
