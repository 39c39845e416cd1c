"""Table schemas and the fixed values that the operators share."""

import re

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These have to be exactly as they are for right results.
# ---------------------------------------------------------------------------

# Specification labels by group, in column order.
GENERAL_LABELS = ("Brand", "Model", "Device Type", "Release Date", "Status")
HARDWARE_LABELS = (
    "Operating System", "OS Version", "User Interface", "Chipset", "CPU", "CPU Cores",
    "Architecture", "Fabrication", "GPU",
)
DISPLAY_LABELS = (
    "Display Type", "Screen Size", "Resolution", "Aspect Ratio", "Pixel Density",
    "Screen to Body Ratio", "Screen Protection", "Bezel-less display", "Touch Screen",
    "Brightness", "Refresh Rate", "Notch",
)
CAMERA_LABELS = (
    "Primary Camera Setup", "Primary Camera Resolution", "Primary Camera Autofocus",
    "Primary Camera Flash", "Primary Camera Image Resolution", "Primary Camera Settings",
    "Primary Camera Zoom", "Primary Camera Shooting Modes", "Primary Camera Features",
    "Primary Camera Video Recording", "Primary Camera Video FPS",
    "Selfie Camera Setup", "Selfie Camera Resolution",
)
DESIGN_LABELS = (
    "Height", "Width", "Thickness", "Weight", "Colors", "Waterproof", "IP Rating", "Ruggedness",
)
BATTERY_LABELS = (
    "Battery Type", "Battery Capacity", "Quick Charging", "Battery Placement", "USB Type-C",
)
MEMORY_LABELS = (
    "Internal Storage", "Storage Type", "Expandable Memory", "USB OTG", "RAM", "RAM Type",
)
NETWORK_LABELS = (
    "Network", "SIM Slot", "SIM Size", "EDGE", "GPRS", "VoLTE", "Speed", "WLAN", "Bluetooth",
    "GPS", "WiFi Hotspot", "USB",
)
SENSOR_LABELS = ("Sensors", "Face Unlock")
MULTIMEDIA_LABELS = ("Loudspeaker", "Audio Jack", "Video")
MORE_LABELS = ("Made by", "Features")

# Words that mark a listing title as a product, and as an advertisement.
PRODUCT_WORDS = (
    "phone", "mobile", "smartphone", "iphone", "galaxy", "pixel", "oneplus", "xiaomi", "realme",
    "oppo", "vivo", "huawei", "honor", "nokia", "samsung", "lg", "sony", "motorola", "asus",
    "infinix", "tecno",
)
AD_WORDS = ("advertisement", "sponsored", "promo", "offer", "deal", "discount")
# Keys of an embedded record that mark it as a product whatever its title.
PRODUCT_KEYS = ("ram", "storage", "battery", "camera", "display")

# Brand names; the first one in this order that occurs in a title wins.
BRANDS = (
    "Apple", "Samsung", "Google", "OnePlus", "Xiaomi", "Realme", "Oppo", "Vivo", "Huawei",
    "Honor", "Nokia", "LG", "Sony", "Motorola", "Asus", "Infinix", "Tecno", "Nothing",
    "Fairphone", "Blackberry", "HTC", "Meizu", "ZTE", "Alcatel", "Lenovo", "TCL", "Poco",
    "Redmi", "Mi", "iPhone",
)
BRAND_ALIASES = {"iPhone": "Apple"}

# Script variables that hold the catalogue, in the order in which they are tried.
OBJECT_PATTERNS = (
    r"let\s+productDataArray\s*=\s*(\{.*?\});",
    r"var\s+productDataArray\s*=\s*(\{.*?\});",
    r"productDataArray\s*=\s*(\{.*?\});",
)
LIST_PATTERNS = (
    r"let\s+phones\s*=\s*(\[.*?\]);",
    r"var\s+phones\s*=\s*(\[.*?\]);",
)

# Page markup.
PRODUCT_PATH = "/mobile/"
ITEM_CLASSES = ("phone-item", "product-item", "mobile-item")
SPEC_SECTION_ID = "product-specs"
SPEC_BLOCK_CLASSES = "row mb-2 pb-2 border-bottom"
SPEC_HEADING_CLASS = "text-bold"
SPEC_TABLE_CLASS = "spec-grp-tbl"
PRICE_BLOCK_CLASS = "price-and-variant"
PRICE_CLASS = "fw-bold"
OLD_PRICE_CLASS = "old-price"
SAVED_AMOUNT_CLASS = "saved-amount"
SAVED_PERCENT_CLASS = "saved-percentage"
VARIANT_BLOCK_CLASS = "varsti"
VARIANT_LINK_CLASS = "rounded"
VARIANT_NAME_CLASS = "vtst"
VARIANT_PRICE_CLASS = "ptst"
PRICE_DATE_CLASS = "updat"

# Value tokens.
MISSING_TOKENS = ("n/a", "na", "not available", "-", "")
YES_TOKENS = ("yes", "y", "true", "1", "available", "supported")
NO_TOKENS = ("no", "n", "false", "0", "not available", "not supported")
BOOLEAN_FIELDS = (
    "waterproof", "usb_type_c", "usb_otg", "wifi_hotspot", "face_unlock", "bezel_less_display",
    "touch_screen",
)
NUMERIC_UNITS = {
    "screen_size": "inches", "pixel_density": "ppi", "brightness": "nits", "refresh_rate": "Hz",
    "battery_capacity": "mAh", "weight": "g", "thickness": "mm", "height": "mm", "width": "mm",
}

# Counters.
BATCH_SIZE = 50
ERROR_TYPES = (
    "network_errors", "parsing_errors", "validation_errors", "critical_errors", "warnings",
)

# Export.
EXPORT_NAME = "phones_data"
CSV_FIRST_COLUMNS = ("brand", "model", "device_type", "release_date", "status")

# ---------------------------------------------------------------------------
# Derived names and schemas
# ---------------------------------------------------------------------------

SPEC_LABELS = (
    GENERAL_LABELS + HARDWARE_LABELS + DISPLAY_LABELS + CAMERA_LABELS + DESIGN_LABELS
    + BATTERY_LABELS + MEMORY_LABELS + NETWORK_LABELS + SENSOR_LABELS + MULTIMEDIA_LABELS
    + MORE_LABELS
)


def field_of(label: str) -> str:
    """Column name of a specification label."""
    return re.sub(r"[ -]", "_", label).lower()


LABEL_TO_FIELD = {label: field_of(label) for label in SPEC_LABELS}
SPEC_FIELDS = tuple(LABEL_TO_FIELD.values())
PRICE_FIELDS = (
    "price_official", "price_unofficial", "price_old", "price_savings", "price_variants",
    "price_updated",
)
META_FIELDS = ("image_url", "detail_url", "scraped_at")
PRODUCT_COLUMNS = (
    SPEC_FIELDS[: len(GENERAL_LABELS)] + PRICE_FIELDS + SPEC_FIELDS[len(GENERAL_LABELS):]
    + META_FIELDS
)

# What a missing value reads as when a caller wants text in every cell.
DEFAULT_VALUES = {
    **dict.fromkeys(SPEC_FIELDS, "Unknown"),
    "device_type": "Smartphone",
    **dict.fromkeys(META_FIELDS, ""),
}

VARIANTS_TYPE = T.ArrayType(
    T.StructType([T.StructField("variant", T.StringType()), T.StructField("price", T.StringType())])
)

PAGE_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("page_no", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("html", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
])

PRODUCT_SCHEMA = T.StructType([
    T.StructField(c, VARIANTS_TYPE if c == "price_variants" else T.StringType())
    for c in PRODUCT_COLUMNS
])

# One product of a listing page. The two *_text fields keep a price that is not a whole number.
LISTING_FIELDS = (
    ("title", "string"), ("slug", "string"), ("detail_url", "string"), ("image_url", "string"),
    ("brand", "string"), ("price_official", "bigint"), ("price_unofficial", "bigint"),
    ("release_date", "string"), ("availability", "string"), ("ram", "string"),
    ("storage", "string"), ("display", "string"), ("main_camera", "string"),
    ("battery", "string"), ("os", "string"),
    ("price_official_text", "string"), ("price_unofficial_text", "string"),
)

REJECT_COLUMNS = ("url", "error_type", "reason")
