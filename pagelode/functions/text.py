"""Text cleaning and normalisation, Column in and Column out."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelode import schema as S
from pagelode.functions.binding import let

# Fixed value: Unicode whitespace and the four separator controls. Spelled out because the regex
# engine is slow with its Unicode classes, and its plain ones know ASCII only.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = f"[{SPACE_CHARS}]"
ASCII_SPACE = r"[\t-\r\x1c-\x20]"
NOT_SPACE = f"[^{SPACE_CHARS}]"


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def strip(text: Column) -> Column:
    """Remove whitespace of any kind at both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def collapse_spaces(text: Column) -> Column:
    """Runs of whitespace become one space, none at the ends.

    The set is far quicker to test without its non-ASCII members, so plain text is spared them.
    """
    def collapsed(t: Column) -> Column:
        return F.when(F.octet_length(t) == F.char_length(t),
                      F.regexp_replace(t, F.lit(f"{ASCII_SPACE}+"), F.lit(" "))
                      ).otherwise(F.regexp_replace(t, F.lit(f"{SPACE}+"), F.lit(" ")))

    return F.trim(let(text, collapsed))


def clean_text(text: Column) -> Column:
    """collapse whitespace; null for empty text and for the missing-value tokens."""
    return let(collapse_spaces(text), missing_to_null)


def missing_to_null(text: Column) -> Column:
    """Null for the missing-value tokens, in any case.

    Lower case is costly and never shorter, so texts longer than every token are spared it.
    """
    longest = max(len(t) for t in S.MISSING_TOKENS)
    return F.when((F.char_length(text) > longest) | ~F.lower(text).isin(*S.MISSING_TOKENS), text)


def normalize_boolean(text: Column) -> Column:
    """yes-like words become ``Yes``, no-like words ``No``, other text is cleaned."""
    word = strip(F.lower(text))
    return (
        F.when(text == "", None)
        .when(word.isin(*S.YES_TOKENS), "Yes")
        .when(word.isin(*S.NO_TOKENS), "No")
        .otherwise(clean_text(text))
    )


def extract_numeric(text: Column, unit: str = "") -> Column:
    """null without a number; ``"<number> <unit>"`` where the unit is missing; else the text."""
    number = F.regexp_extract(text, r"(?U)(\d+\.?\d*)", 1)
    found = F.when(number == "", None)
    if unit:
        found = found.when(~F.contains(F.lower(text), F.lit(unit.lower())),
                           F.concat(number, F.lit(f" {unit}")))
    return found.otherwise(clean_text(text))


def normalize_field(field: str, text: Column) -> Column:
    """F4 for one known column: by its kind, the raw value where that gives nothing."""
    if field in S.BOOLEAN_FIELDS:
        value = normalize_boolean(text)
    elif field in S.NUMERIC_UNITS:
        value = extract_numeric(text, S.NUMERIC_UNITS[field])
    else:
        value = clean_text(text)
    return F.coalesce(value, text, F.lit(""))


def normalize_by_field(field: Column, text: Column) -> Column:
    """F4 for a long table, where the field name is itself a column."""
    value = F.when(field.isin(*S.BOOLEAN_FIELDS), normalize_boolean(text))
    for name, unit in S.NUMERIC_UNITS.items():
        value = value.when(field == name, extract_numeric(text, unit))
    return F.coalesce(value.otherwise(clean_text(text)), text, F.lit(""))


def safe_value(field: str, value: Column, fallback: str | None = None,
               defaults: dict[str, str] | None = None) -> Column:
    """the value as trimmed text, else the fallback, else the default of the field."""
    default = fallback or (defaults or S.DEFAULT_VALUES).get(field, "Unknown")
    text = value.cast("string")
    return F.when(text.isNull() | (text == ""), F.lit(default)).otherwise(strip(text))


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the others."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))),
                                             F.lower(F.substr(r, F.lit(2))))), "")


def iso_text(ts: Column) -> Column:
    """Timestamp as ISO text; the fraction only where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_trunc("second", ts) == ts, whole).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
