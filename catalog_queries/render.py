"""Pages rendered from the columns of ``part``.

The tables hold no product pages, so the queries render some, one per part or twenty parts to a
listing page, and let the operators read them back. The oracle SQL states the answers straight
from the columns of ``part``. Columns used as text, all of a part:

* model   ``<p_name> <p_partkey>``
* slug    ``p-<p_partkey>``
* price   ``p_retailprice * 10`` as a whole number (``p10`` below)
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode import schema as S

SITE = "https://shop.example.com"
BASE = f"{SITE}/list"
PER_PAGE = 20


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts, spread over all cores: the table is one small file, but each part becomes a page."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.repartition(spark.sparkContext.defaultParallelism, "p_partkey")


def text(*parts) -> Column:
    """Concatenate columns and literal strings."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def k() -> Column:
    return F.col("p_partkey")


def model() -> Column:
    return text(F.col("p_name"), " ", k().cast("string"))


def p10() -> Column:
    return F.round(F.col("p_retailprice") * 10).cast("bigint")


def grouped(number: Column) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(number, 0)


def detail_url() -> Column:
    return text(f"{SITE}{S.PRODUCT_PATH}p-", k().cast("string"))


def _row(label: str, value, cls: str = "td2 ss") -> Column:
    return text(f'<tr>\n<td class="td1 ss">{label}</td>\n<td class="{cls}">', value, "</td>\n</tr>\n")


def _block(heading: str, *rows) -> Column:
    return text(
        '<div class="row mb-2 pb-2 border-bottom">\n<div class="col-md-2"><h3 class="text-bold h6">',
        heading, '</h3></div>\n<div class="col-md-10"><table class="spec-grp-tbl"><tbody>\n',
        *rows, "</tbody></table></div>\n</div>\n")


def spec_markup() -> Column:
    """The specification section of a part.

    By the part key: every 11th has no model, every 7th a missing-value token as its chipset,
    every 5th a second RAM row with another value, every 13th a second, empty RAM row, every 3rd an
    svg in front of its status, every 17th no section at all.
    """
    svg = '<svg width="16"><path d="M16 8"/><title>tick</title></svg>'
    general = _block(
        "General",
        _row("Brand", F.col("p_brand")),
        F.when(k() % 11 == 0, F.lit("")).otherwise(_row("Model", model())),
        _row("Device Type", "Smartphone"),
        _row("Status", text(F.when(k() % 3 == 0, F.lit(svg)).otherwise(F.lit("")), "\n  ",
                            F.col("p_type"), " &amp; sold ")),
        _row("Shop Code", "unknown label"),
        '<tr><td class="td1">Colors</td></tr>\n',
    )
    hardware = _block(
        "Hardware &amp; Software",
        _row("Chipset", F.when(k() % 7 == 0, F.lit("N/A")).otherwise(
            text("Chip <b>", F.col("p_size").cast("string"), "</b> nm"))),
        _row("CPU", text("Octa&nbsp;core <!-- c --> <span>", F.col("p_type"), "</span>")),
    )
    memory = _block(
        "Memory",
        _row("RAM", text(F.col("p_size").cast("string"), " GB")),
        _row("Internal <i>Storage</i>", "joined label is unknown"),
        _row("Internal Storage", text((F.col("p_size") * 8).cast("string"), "GB")),
    )
    more = F.when(k() % 5 == 0, _block("More", _row("RAM", text(F.col("p_size").cast("string"), "GB+")))
                  ).when(k() % 13 == 0, _block("More", _row("RAM", " - "))).otherwise(F.lit(""))
    battery = _block("Battery", _row("Battery Capacity", text(p10().cast("string"), " mAh")))
    section = text('<section class="desc-box mt-2" id="product-specs">\n', general, hardware, memory,
                   battery, more, "</section>\n")
    return F.when(k() % 17 == 0, F.lit("<p>nothing</p>")).otherwise(section)


def price_markup() -> Column:
    """The price block of a part.

    By the part key: every 6th has none, every 2nd an official price and otherwise an unofficial
    one, every 4th an old price and savings, every 8th no percentage with them, every 3rd two
    variants and every 9th of them a third one without a price, every 10th no date.
    """
    amount = grouped(p10())
    variant = lambda name, price: text(
        '<a class="btn rounded" href="#"><span class="vtst">', name,
        '</span><span class="ptst">৳.', price, "</span></a>")
    block = text(
        '<div class="col price-and-variant">\n<div><span class="x fw-bold">৳.', amount,
        F.when(k() % 2 == 0, F.lit(" (Official)")).otherwise(F.lit(" (Unofficial)")), "</span></div>\n",
        '<span class="fw-bold">plain</span>',
        F.when(k() % 4 == 0, text(
            '<div><span class="old-price">৳.', grouped(p10() + 1000), '</span><span class="saved-amount">Save ৳.1,000</span>',
            F.when(k() % 8 == 0, F.lit("")).otherwise(F.lit('<span class="saved-percentage">(-5%)</span>')),
            "</div>")).otherwise(F.lit("")),
        F.when(k() % 3 == 0, text(
            '<div class="varsti"><div>',
            variant(text(F.col("p_size").cast("string"), "GB"), grouped(p10())),
            variant("512GB", grouped(p10() + 5000)),
            F.when(k() % 9 == 0, F.lit('<a class="rounded"><span class="vtst">1TB</span></a>')).otherwise(F.lit("")),
            "</div></div>")).otherwise(F.lit("")),
        F.when(k() % 10 == 0, F.lit("")).otherwise(text(
            '<span class="updat">Updated on: June ', (k() % 28 + 1).cast("string"), ", 2025 </span>")),
        "</div>\n")
    return F.when(k() % 6 == 0, F.lit("")).otherwise(block)


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detail page per part; every 19th answered with status 404."""
    html = text("<!DOCTYPE html><html><head><title>", model(), "</title></head><body>\n",
                price_markup(), spec_markup(), '<span class="fw-bold">9 (Official)</span></body></html>')
    return part(spark, sf_dir).select(
        detail_url().alias("url"),
        F.lit(None).cast("int").alias("page_no"),
        F.lit("detail").alias("kind"),
        F.when(k() % 19 == 0, 404).otherwise(200).cast("int").alias("status_code"),
        html.alias("html"),
        F.timestamp_seconds(F.lit(1_700_000_000) + k()).alias("fetched_at"))


# --- listing pages -----------------------------------------------------------------

PAGES = 10


def page_number_of() -> Column:
    return F.floor(k() / PER_PAGE).cast("int") % PAGES + 1


def shop_of() -> Column:
    return F.floor(k() / (PER_PAGE * PAGES)).cast("int")


def title() -> Column:
    """By the part key: some titles name a brand, some no product word, some are advertisements."""
    name = text(F.when(k() % 6 == 0, F.lit("Redmi ")).when(k() % 6 == 1, F.lit("iPhone ")).otherwise(F.lit("")),
                F.col("p_name"))
    return (
        F.when((k() % 10 == 7) | (k() % 9 == 0), text(F.col("p_name"), " ", k().cast("string")))
        .when(k() % 15 == 4, text("Special Deal phone ", k().cast("string")))
        .otherwise(text(name, " Phone ", k().cast("string"))))


def slug() -> Column:
    """Every 20th part repeats the slug of the one before it."""
    return text("p-", F.when(k() % 20 == 19, k() - 1).otherwise(k()).cast("string"))


def catalogue_record() -> Column:
    """One embedded record as JSON text, with its field names as they come."""
    quoted = lambda c: text('"', c, '"')
    size = F.col("p_size").cast("string")
    specs = F.when(k() % 10 == 7, F.lit("")).otherwise(text(
        ',"ram":"', size, 'GB","storage":"', (F.col("p_size") * 8).cast("string"),
        'GB","display":"', size, ".1''\",\"main_camera\":\"", size, 'MP","battery":null,"os":"OS ', F.col("p_type"), '"'))
    image = (
        F.when(k() % 7 == 0, text('"thamnail":"https://img.example.com/', k().cast("string"), '.png"'))
        .when(k() % 2 == 0, text('"thamnail":"media/', k().cast("string"), '.webp"'))
        .otherwise(text('"thamnail":"","thumbnail":"//cdn.example.com/', k().cast("string"), '.png"')))
    brand = (F.when(k() % 4 == 1, quoted(F.col("p_brand"))).when(k() % 4 == 2, F.lit('""'))
             .otherwise(size))
    price = (F.when(k() % 3 == 0, text('"price_official":', p10().cast("string"), ',"price_unofficial":null'))
             .when(k() % 3 == 1, text('"price_official":null,"price_unofficial":"', p10().cast("string"), '"'))
             .otherwise(F.lit('"price_official":"TBA"')))
    return text(
        '{"id":', k().cast("string"), ',"type":"', F.when(k() % 10 == 3, F.lit("advertisement")).otherwise(F.lit("mobile")),
        '","title":', F.when(k() % 25 == 11, F.lit("null")).otherwise(quoted(title())),
        ',"slug":', quoted(slug()), ',"avibility":"In Stock","brand":', brand, ",", price, ",", image, specs,
        ',"colors":["a","b"],"more":{"x":1}}')


def _script(number: Column, records: Column, no_signal: Column) -> Column:
    """The script of a page; which variable holds the catalogue goes by its number."""
    data = text('{"current_page": ', number.cast("string"), f', "last_page": {PAGES}, "data": [\n', records, "]};")
    rows = text("[", records, "];")
    link = text('<div class="pagination"><a href="?page=', (number + 1).cast("string"), '">Next</a></div>')
    return (
        F.when(no_signal, text("<script>var phones = ", rows, "</script>"))
        .when(number % 5 == 0, text("<script>\nlet productDataArray = ", data, "</script>"))
        .when(number % 5 == 1, text("<script>var  productDataArray=", data, "</script>"))
        .when(number % 5 == 2, text("<script>window.productDataArray = ", data, "</script>"))
        .when(number % 5 == 3, text("<script>let phones = ", rows, "</script>", link))
        .otherwise(text("<script>LET PHONES = ", rows, "</script>", link)))


def _grouped_pages(rows: DataFrame, item: Column) -> DataFrame:
    """Twenty items to a page, in key order."""
    items = F.array_sort(F.collect_list(F.struct(k().alias("k"), item.alias("item"))))
    return rows.groupBy(shop_of().alias("shop"), page_number_of().alias("page_no")).agg(
        F.transform(items, lambda i: i["item"]).alias("items"))


def _page_url() -> Column:
    base = text(BASE, F.col("shop").cast("string"))
    return F.when(F.col("page_no") == 1, base).otherwise(
        text(base, "?page=", F.col("page_no").cast("string")))


def _as_listing(grouped: DataFrame, html: Column) -> DataFrame:
    return grouped.select(
        _page_url().alias("url"), F.col("page_no").cast("int").alias("page_no"),
        F.lit("listing").alias("kind"), F.lit(200).cast("int").alias("status_code"), html.alias("html"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_no")).alias("fetched_at"))


def catalogue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten pages of twenty parts to a shop, with embedded catalogues.

    By the shop number: every third shop has an empty (even) or missing (odd) page 6, and every
    third one a page 8 that does not tell of a next one.
    """
    grouped = _grouped_pages(part(spark, sf_dir), catalogue_record())
    shop, number = F.col("shop"), F.col("page_no")
    hole = (shop % 3 == 1) & (number == 6)
    records = F.when(hole, F.lit("")).otherwise(F.array_join("items", ",\n"))
    html = text("<html><head><script>var a = {b: 1};</script></head><body>\n",
                _script(F.when(hole, 10).otherwise(number), records, (shop % 3 == 2) & (number == 8)), "</body></html>")
    return _as_listing(grouped.where(~(hole & (shop % 2 == 1))), html)


def anchor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of anchors only.

    By the part key: a title attribute, a text with a tag or neither; a source, a lazy source or
    no image; absolute, relative and slash-ended targets.
    """
    key = k().cast("string")
    href = (F.when(k() % 4 == 0, text("https://other.example.com/mobile/p-", key))
            .when(k() % 4 == 1, text("/mobile/p-", key, "/")).otherwise(text("/mobile/p-", key)))
    name = (F.when(k() % 3 == 0, text(' title="', F.col("p_name"), ' &amp; ', key, '"')).otherwise(F.lit("")))
    img = (F.when(k() % 5 == 0, text('<img alt="x" src="media/', key, '.png">'))
           .when(k() % 5 == 1, text("<IMG data-src='https://img.example.com/", key, ".png'/>")).otherwise(F.lit("")))
    body = F.when(k() % 3 == 2, F.lit("")).otherwise(text(" <b>", F.col("p_type"), " </b>\n", key, " "))
    anchor = text("<a class=card", name, ' href="', href, '">', img, body, "</a>\n<!-- <a href='/mobile/no'>no</a> -->")
    grouped = _grouped_pages(part(spark, sf_dir), anchor)
    html = text('<html><body><a href="/about">about</a>\n', F.array_join("items", "\n"),
                F.when(F.col("page_no") < PAGES, text('<a href="', BASE, F.col("shop").cast("string"), "?page=", (F.col("page_no") + 1).cast("string"), '">next</a>'))
                .otherwise(F.lit("")), "</body></html>")
    return _as_listing(grouped, html)
