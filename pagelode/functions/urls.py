"""URL helpers, Column in and Column out."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelode.functions.binding import let

# What counts as a well-formed URL. A host's labels are tested one by one, since a pattern
# that repeats a group for each of them takes a stack frame for each.
URL_PARTS = r"(?i)^https?://([A-Z0-9.-]++)(?::\d++)?(?:/?|[/?]\S+)$"
PLAIN_HOST = r"(?i)^(?:localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$"
HOST_LABEL = r"(?i)^[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?$"
TOP_LABEL = r"(?i)^[A-Z]{2,6}$"


def page_number(url: Column) -> Column:
    """The ``page`` parameter of a URL; page 1 carries none."""
    digits = F.regexp_extract(url, r"[?&]page=(\d+)", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("int"), F.lit(1))


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, F.lit(r"[?#].*$"), F.lit(""))


def site_of(url: Column) -> Column:
    """Scheme and host of a URL."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)


def join_url(site: Column, link: Column) -> Column:
    """Resolve a link against the root of a site."""
    return (
        F.when(link == "", site)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")),
              F.concat(F.regexp_extract(site, r"^([^:]+:)", 1), link))
        .when(link.rlike(r"^[/?#]"), F.concat(site, link))
        .otherwise(F.concat(site, F.lit("/"),
                            F.regexp_replace(link, F.lit(r"^(?:\.{1,2}/)++"), F.lit(""))))
    )


def image_url(site: Column, link: Column) -> Column:
    """Absolute image links stay, others are resolved; empty text where there is none."""
    return (
        F.when(link.isNull() | (link == ""), F.lit(""))
        .when(F.startswith(link, F.lit("http")), link)
        .otherwise(join_url(site, link))
    )


def is_valid_url(url: Column) -> Column:
    """F8."""
    def named(labels: Column) -> Column:
        inner = F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0)))
        return ((F.size(labels) > 1) & F.get(labels, F.size(labels) - 1).rlike(TOP_LABEL)
                & F.forall(inner, lambda label: label.rlike(HOST_LABEL)))

    def known(host: Column) -> Column:
        return host.rlike(PLAIN_HOST) | let(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), named)

    return F.coalesce(let(F.regexp_extract(url, URL_PARTS, 1), lambda host: (host != "") & known(host)), F.lit(False))
