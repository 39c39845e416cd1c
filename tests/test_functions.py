from pyspark.sql import functions as F

from pagelode import schema as S
from pagelode.functions import text as X
from pagelode.functions.brands import brand_from_title, listing_brand
from pagelode.functions.json_paths import json_path_or_default
from pagelode.functions.prices import price_digits, whole_number
from pagelode.functions.urls import image_url, is_valid_url, join_url, page_number
from pagelode.functions.validity import is_iso_timestamp


def test_schema_has_86_columns_in_groups():
    assert len(S.SPEC_LABELS) == 77 and len(set(S.SPEC_FIELDS)) == 77
    assert len(S.PRODUCT_COLUMNS) == 86
    assert S.PRODUCT_COLUMNS[:7] == ("brand", "model", "device_type", "release_date", "status",
                                     "price_official", "price_unofficial")
    assert S.PRODUCT_COLUMNS[-3:] == ("image_url", "detail_url", "scraped_at")
    assert S.LABEL_TO_FIELD["Bezel-less display"] == "bezel_less_display"
    assert S.LABEL_TO_FIELD["USB Type-C"] == "usb_type_c"
    assert len(S.DEFAULT_VALUES) == 80


def test_clean_text(values):
    assert values(X.clean_text, [
        "  Nokia G42  ", "Nokia    G42", "", "   ", "N/A", "na", "Not  available", "-", None, "123",
        " tab\there ", "a\x1fb", "nah"]) == [
        "Nokia G42", "Nokia G42", None, None, None, None, None, None, None, "123", "tab here",
        "a b", "nah"]


def test_normalize_boolean(values):
    yes = ["yes", "YES", "y", "true", "1", "Available", "supported", " Yes\n"]
    no = ["no", "NO", "n", "false", "0", "not available", "Not Supported", "No "]
    assert values(X.normalize_boolean, yes) == ["Yes"] * 8
    assert values(X.normalize_boolean, no) == ["No"] * 8
    assert values(X.normalize_boolean, ["Perhaps", None, "", " - "]) == ["Perhaps", None, None, None]


def test_extract_numeric(values):
    assert values(X.extract_numeric, ["256 GB", "6.7 inches", "none", None, ""]) == [
        "256 GB", "6.7 inches", None, None, None]
    assert values(lambda c: X.extract_numeric(c, "GB"), ["256", "8 gb x", "4. of"]) == [
        "256 GB", "8 gb x", "4. GB"]
    assert values(lambda c: X.extract_numeric(c, "inches"), ["৬.৭", "6.7"]) == ["৬.৭ inches", "6.7 inches"]


def test_normalize_by_field(values):
    assert values(lambda c: X.normalize_field("usb_otg", c), ["yes", "- ", ""]) == ["Yes", "- ", ""]
    assert values(lambda c: X.normalize_field("weight", c), ["190", "heavy", None]) == ["190 g", "heavy", ""]
    assert values(lambda c: X.normalize_field("model", c), ["a  b", "n/a"]) == ["a b", "n/a"]
    for field in ("usb_otg", "weight", "refresh_rate", "model"):
        inputs = ["TRUE", "60", "60 hz", "x  y", "", None, "-"]
        assert (values(lambda c: X.normalize_by_field(F.lit(field), c), inputs)
                == values(lambda c: X.normalize_field(field, c), inputs))


def test_safe_value(values):
    assert values(lambda c: X.safe_value("device_type", c), [" x ", None, ""]) == [
        "x", "Smartphone", "Smartphone"]
    assert values(lambda c: X.safe_value("image_url", c), [None]) == [""]
    assert values(lambda c: X.safe_value("brand", c, fallback="None given"), [None]) == ["None given"]
    assert values(lambda c: X.safe_value("whatever", c, defaults={"brand": "B"}), [None]) == ["Unknown"]
    assert values(lambda c: X.safe_value("n", c), [5, None], "int") == ["5", "Unknown"]


def test_json_path(values):
    docs = ['{"a":{"b":"x","n":null,"list":[1]}}', '{"a":"flat"}', "broken", None]
    path = lambda p: values(lambda c: json_path_or_default(c, p, "D"), docs)
    assert path("a.b") == ["x", "D", "D", "D"]
    assert path("a.n") == [None, "D", "D", "D"]
    assert path("a.b.c") == ["D", "D", "D", "D"]
    assert path("a") == ['{"b":"x","list":[1],"n":null}', "flat", "D", "D"]


def test_valid_url(values):
    good = ["https://shop.example.com/x", "http://localhost:80", "https://10.0.0.1:8080/p?q=1",
            "HTTPS://EXAMPLE.COM"]
    bad = ["shop.example.com", "ftp://shop.example.com", "https://", "https://shop.example.com/a b", "", None]
    assert values(is_valid_url, good) == [True] * 4
    assert values(is_valid_url, bad) == [False] * 6


def test_iso_timestamp(values):
    good = ["2024-02-29", "2024-02-29T10:11:12", "2024-02-29 10:11:12.123456", "2024-02-29T10:11:12Z",
            "2024-02-29T10+06:00", "20240229", "2024-02-29T10:11:12.5+0600"]
    bad = ["2023-02-29", "2024-13-01", "2024-02-29T25:00:00", "yesterday", "2024", "", None, "2024-02-29T"]
    assert values(is_iso_timestamp, good) == [True] * len(good)
    assert values(is_iso_timestamp, bad) == [False] * len(bad)


def test_brand_from_title(values):
    # The order of the list decides, so "Mini" is a Mi before it is an iPhone.
    cases = [
        ("iPhone 14 Plus", "Apple"), ("iPhone 14 Mini", "Mi"), ("samsung Galaxy Z", "Samsung"),
        ("Pixel by Google", "Google"), ("oneplus Nord", "OnePlus"), ("Mi Note", "Mi"),
        ("REALME C3", "Realme"), ("OPPO Reno", "Oppo"), ("Redmi 9", "Redmi"), ("Apple iPhone", "Apple"),
        ("Premium Deluxe", "Mi"), ("zed one", "Zed"), ("", "Unknown"), ("XY 1", "Unknown"),
        ("   ", "Unknown"), (None, "Unknown"), ("o'neil s24fe", "O'Neil"),
    ]
    assert values(brand_from_title, [title for title, _ in cases]) == [brand for _, brand in cases]


def test_listing_brand_takes_names_but_not_numbers(values):
    assert values(lambda c: listing_brand(c, F.lit("Vivo Y1")), ["Acme", "28", "", None]) == [
        "Acme", "Vivo", "Vivo", "Vivo"]


def test_title_case(values):
    assert values(X.title_case, ["galaxy s24fe", "ÉTÉ x-ray"]) == ["Galaxy S24Fe", "Été X-Ray"]


def test_price_digits(values):
    assert values(price_digits, ["৳.43,999 (Official)", "৳ 43,999.50", "(Unofficial)", "from 1,2 3", None]) == [
        "43,999", "43,99950", None, "1,2", None]


def test_whole_number(values):
    assert values(whole_number, ["11499", "1 1", "1.5", "", None, "99999999999999999999"]) == [
        11499, None, None, None, None, None]


def test_urls(values):
    site = F.lit("https://shop.example.com")
    links = ["/a", "a/b", "//cdn.example.com/x", "?p=2", "#t", "", "../a", "mailto:x", "http://o.example.com/"]
    assert values(lambda c: join_url(site, c), links) == [
        "https://shop.example.com/a", "https://shop.example.com/a/b", "https://cdn.example.com/x",
        "https://shop.example.com?p=2", "https://shop.example.com#t", "https://shop.example.com",
        "https://shop.example.com/a", "mailto:x", "http://o.example.com/"]
    assert values(lambda c: image_url(site, c), ["media/x.webp", "https://i.example.com/x", None, ""]) == [
        "https://shop.example.com/media/x.webp", "https://i.example.com/x", "", ""]
    assert values(page_number, ["https://s.example/l", "https://s.example/l?page=7", "l?a=1&page=12#x",
                                "l?page=99999999999"]) == [1, 7, 12, 1]


def test_long_urls(values):
    from pagelode.functions.urls import is_valid_url, join_url
    hosts = ["a." * 50_000 + "com", "a." * 50_000 + "c0m", "a" * 63 + ".com", "a" * 64 + ".com", "a..com", "-a.com", "a-.com", "a.b.co.",
             "LOCALHOST:80", "1.2.3.4:8/x", "com", "a.com:x", "a.com/ x", ""]
    assert values(is_valid_url, [f"https://{h}" for h in hosts]) == [
        True, False, True, False, False, False, False, True, True, True, False, False, False, False]
    got = values(lambda v: join_url(F.lit("https://s"), v), ["../" * 40_000 + "x", "./y", ".z", "..."])
    assert got == ["https://s/x", "https://s/y", "https://s/.z", "https://s/..."]
