from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagelode import schema as S
from pagelode.operators import detail as D
from pagelode.operators import prices as P

URL = "https://shop.example.com/mobile/zed-one"
BLOCKS = {
    "General": {"Brand": "Zed", "Model": "One 5G", "Device Type": "Smartphone", "Release Date": "3 May 2025",
                "Status": "<svg viewBox='0 0 1 1'><path d='M1'/></svg>\n  Available "},
    "Hardware &amp; Software": {"Operating System": "Android", "OS Version": "v15", "User Interface": "Zed UI",
                                "Chipset": "Dimensity 7300", "CPU": "Octa-core (4x2.5 GHz &amp; 4x2.0 GHz)",
                                "CPU Cores": "8 Cores", "Architecture": "64 bit", "Fabrication": "4 nm", "GPU": "Mali-G615"},
    "Display": {"Screen Size": "<span>6.7 inches</span>\n<small>(17.02 cm)</small>", "Bezel-less display": "Yes"},
    "Cameras": {"Primary Camera Setup": "Dual", "Selfie Camera Resolution": "16&nbsp;MP"},
    "Battery": {"Battery Capacity": "5000 mAh", "USB Type-C": "Yes"},
}


def block(name, cells, heading="text-bold h6"):
    body = "".join(f"<tr>\n<td class='td1 ss'>{k}</td> <td class='td2'>{v}</td>\n</tr>" for k, v in cells.items())
    return (f'<div class="row mb-2 pb-2 border-bottom"><div class="col"><h3 class="{heading}">{name}</h3></div>'
            f'<div class="col-md-10"><table class="spec-grp-tbl"><tbody>{body}</tbody></table></div></div>')


def page(*blocks, before="", after=""):
    return (f"<html><body>{before}<section class='desc-box' id='product-specs'><div><div class='wrap'>"
            + "".join(blocks) + f"</div></div></section>{after}</body></html>")


FULL = page(*[block(n, c) for n, c in BLOCKS.items()])


def parse(pages, html, status=200):
    return D.parse_details(pages((URL, None, "detail", status, html))).first()


def test_full_page(pages):
    row = parse(pages, FULL)
    want = {S.LABEL_TO_FIELD[k]: v for cells in BLOCKS.values() for k, v in cells.items()}
    want |= {"status": "Available", "cpu": "Octa-core (4x2.5 GHz & 4x2.0 GHz)", "screen_size": "6.7 inches (17.02 cm)",
             "selfie_camera_resolution": "16 MP"}
    for field in S.SPEC_FIELDS:
        assert row[field] == want.get(field), field
    assert row["detail_url"] == URL and row["scraped_at"] == "2025-01-02T03:04:05" and row["image_url"] is None
    assert row["price_official"] is None and row["price_variants"] == [] and row["valid"]
    assert list(row.asDict())[:86] == list(S.PRODUCT_COLUMNS)


def test_incomplete_and_broken_pages(pages):
    row = parse(pages, page(block("General", {"Brand": "Zed"}, heading="plain")))
    assert (row["brand"], row["model"], row["valid"]) == ("Zed", None, False)
    for html in ("<p>none</p>", "", None, "<section id='other'>" + block("G", {"Brand": "X"}) + "</section>"):
        row = parse(pages, html)
        assert all(row[f] is None for f in S.SPEC_FIELDS) and not row["valid"]


def test_status_gate(pages):
    table = pages((URL, None, "detail", 404, FULL), (URL + "2", None, "listing", 200, FULL))
    assert D.parse_details(table).count() == 0 and D.long_specs(table).count() == 0
    failed = D.parse_details(table, every_status=True).first()
    assert failed["status_code"] == 404 and failed["brand"] is None


def test_last_non_empty_value_wins(pages):
    html = page(block("A", {"RAM": "4 GB", "GPU": "x"}), block("B", {"RAM": "8 GB"}), block("C", {"RAM": " - ", "GPU": "n/a"}))
    row = parse(pages, html)
    assert (row["ram"], row["gpu"]) == ("8 GB", "x")


def test_what_is_no_cell(pages):
    html = page(
        block("A", {"brand": "lower case label", "Nonsense": "x", "Screen <b>Size</b>": "joined", "": "no label", "GPU": ""})
        + '<div class="row mb-2 pb-2"><table class="spec-grp-tbl"><tr><td>Brand</td><td>other class</td></tr></table></div>',
        block("B", {}).replace("<tbody>", "<tbody><tr><td>Brand</td></tr><tr><td>Brand</td><td>a</td><td>b</td></tr>"
                               "<tr><td>Model</td><td>unclosed row<tr><td>CPU</td><td>kept</td></tr>"),
        '<div class="row mb-2 pb-2 border-bottom"><h3 class="text-bold">C</h3></div>'
        '<table class="spec-grp-tbl"><tr><td>Brand</td><td>outside of a block</td></tr></table>')
    got = D.long_specs(pages((URL, None, "detail", 200, html))).collect()
    assert [(r.category, r.field, r.value) for r in got] == [("B", "cpu", "kept")]


def test_only_the_first_table_of_a_block(pages):
    html = page(block("A", {"Brand": "one"}).replace(
        "</table>", '</table><table class="spec-grp-tbl"><tr><td>Model</td><td>two</td></tr></table>'))
    assert [r.label for r in D.long_specs(pages((URL, None, "detail", 200, html))).collect()] == ["Brand"]


def test_long_and_wide_agree(pages, spark):
    html = page(block("A", {"RAM": "4 GB", "GPU": "x", "Brand": "b"}), block("B", {"RAM": "8 GB"}))
    table = pages((URL, None, "detail", 200, html), (URL + "x", None, "detail", 200, FULL))
    wide = D.parse_details(table).select(F.col("detail_url").alias("url"), *S.SPEC_FIELDS)
    merged = D.widen(D.long_specs(table)).select("url", *S.SPEC_FIELDS)
    assert wide.exceptAll(merged).isEmpty() and merged.exceptAll(wide).isEmpty()


PRICES = """
<div class="box price-and-variant"><div><div><span class="fw-bold text-x">৳.<b>43,999</b> (Official)</span></div>
<span class="fw-bold">৳.41,500.50 (Unofficial)</span><span class="fw-bold">no price (Official)</span>
<span class="old-price">৳.47,999</span><span class="saved-amount">Save ৳.4,000</span><span class="saved-percentage"> (-8%) </span></div>
<div class="row varsti"><div><a href="#" class="btn rounded"><span class="vtst">8GB+128GB</span><span class="ptst">৳.43,999</span></a>
<a class="rounded"><span class="vtst">12GB+256GB</span><span class="ptst">৳.<i>47,999</i></span></a>
<a class="rounded"><span class="vtst">no price</span></a><a class="rounded"><span class="ptst">9</span></a>
<a class="rounded"><span class="vtst">words</span><span class="ptst">soon</span></a><a class="x"><span class="vtst">n</span><span class="ptst">1</span></a></div></div>
<span class="updat">Updated on:  June 6, 2025 </span></div>
<div class="varsti"><a class="rounded"><span class="vtst">late</span><span class="ptst">1</span></a></div>
<span class="fw-bold">1 (Official)</span><span class="old-price">2</span><span class="updat">Updated on: never</span>
"""


def test_price_block(pages):
    row = P.price_table(pages((URL, None, "detail", 200, page(before=PRICES)))).first()
    assert (row.price_official, row.price_unofficial) == ("43,999", "41,50050")
    assert (row.price_old, row.price_savings, row.price_updated) == ("47,999", "Save ৳.4,000 (-8%)", "June 6, 2025")
    assert [(v.variant, v.price) for v in row.price_variants] == [("8GB+128GB", "43,999"), ("12GB+256GB", "47,999")]


def test_price_parts_that_are_missing(pages):
    bare = lambda inner: f'<div class="price-and-variant">{inner}</div>'
    cases = {
        "a": "<p>none</p>", "b": bare(""), "c": bare('<span class="saved-amount">5</span><span class="updat">today</span>'),
        "d": bare('<span class="saved-percentage">-5%</span>'),
        "e": bare('<span class="fw-bold">1 (Official)</span><span class="fw-bold">2 (Official)</span>'
                  '<span class="fw-bold">3 (Official) (Unofficial)</span>'),
    }
    table = pages(*[(k, None, "detail", 200, v) for k, v in cases.items()])
    got = {r.url: r for r in P.price_table(table).collect()}
    nothing = (None, None, None, None, None, [])
    fields = lambda r: (r.price_official, r.price_unofficial, r.price_old, r.price_savings, r.price_updated, r.price_variants)
    assert fields(got["a"]) == fields(got["b"]) == fields(got["d"]) == nothing
    assert got["c"].price_savings == "5" and got["c"].price_updated is None
    assert (got["e"].price_official, got["e"].price_unofficial) == ("3", None)
    flat = P.variant_table(P.price_table(pages((URL, None, "detail", 200, PRICES), ("x", None, "detail", 200, ""))))
    assert sorted((r.url, r.variant) for r in flat.collect()) == [
        (URL, "12GB+256GB"), (URL, "8GB+128GB"), ("x", None)]


def test_conform(spark):
    df = spark.createDataFrame([(" Zed  ", "n/a", "x", 5)], "brand string, model string, other string, ram int")
    row = D.conform(df, now=F.to_timestamp(F.lit("2025-01-01 00:00:00.5"))).first()
    assert (row["brand"], row["model"], row["ram"], row["scraped_at"]) == ("Zed", None, "5", "2025-01-01T00:00:00.500000")
    assert list(row.asDict()) == list(S.PRODUCT_COLUMNS) and row["price_variants"] is None


@pytest.fixture
def product(spark):
    def make(*changes):
        good = {"brand": "Zed", "model": "One", "detail_url": URL, "scraped_at": "2025-01-02T03:04:05"}
        return spark.createDataFrame([{**dict.fromkeys(S.PRODUCT_COLUMNS), **good, **c} for c in changes], S.PRODUCT_SCHEMA)
    return make


def test_validation(product):
    df = product({}, {"brand": None}, {"model": ""}, {"detail_url": "nowhere"}, {"image_url": "x.jpg"},
                 {"scraped_at": "soon"}, {"detail_url": "", "scraped_at": None}, {"scraped_at": "2025-01-02T03:04:05Z"})
    assert D.valid_products(df).count() == 3
    assert sorted(r.reason for r in D.invalid_products(df).collect()) == [
        "bad detail_url", "bad image_url", "bad scraped_at", "no brand", "no model"]


def test_as_json(product):
    text = D.as_json(product({})).first()[0]
    assert '"model":"One"' in text and '"ram":null' in text


def test_scraped_at_keeps_a_fraction(pages):
    row = D.parse_details(pages((URL, None, "detail", 200, FULL, datetime(2025, 1, 2, 3, 4, 5, 67)))).first()
    assert row["scraped_at"] == "2025-01-02T03:04:05.000067"
