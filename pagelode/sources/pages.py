"""Page archives as DataFrames of the page schema."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode import schema as S
from pagelode.functions.urls import page_number


def as_pages(df: DataFrame, kind: str | Column | None = None) -> DataFrame:
    """Bring a table with at least ``url`` and ``html`` into the page schema.

    Missing columns are filled in: the page number from the URL, status 200, no capture time.
    """
    if isinstance(kind, str):
        kind = F.lit(kind)
    fill = {
        "page_no": page_number(F.col("url")),
        "kind": kind if kind is not None else F.lit(None),
        "status_code": F.lit(200),
        "fetched_at": F.lit(None),
    }
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else fill[f.name]).cast(f.dataType).alias(f.name)
        for f in S.PAGE_SCHEMA
    ])


def read_parquet_pages(spark: SparkSession, path: str, kind: str | Column | None = None) -> DataFrame:
    """An archive in Parquet."""
    return as_pages(spark.read.parquet(path), kind)


def read_text_pages(spark: SparkSession, path: str, url: Column | None = None,
                    kind: str | Column | None = None) -> DataFrame:
    """One page per text file; ``url`` tells how to get the URL, by default the file path."""
    files = spark.read.text(path, wholetext=True)
    return as_pages(files.select(
        (url if url is not None else F.input_file_name()).alias("url"),
        F.col("value").alias("html")), kind)


def read_binary_pages(spark: SparkSession, path: str, url: Column | None = None,
                      kind: str | Column | None = None, charset: str = "UTF-8") -> DataFrame:
    """One page per binary file; the change time of the file is the capture time.

    A byte that is none of the charset's becomes U+FFFD and costs no page. ``charset`` is UTF-8 or one
    that has a character for every byte.
    """
    if charset.upper() == "UTF-8":
        html = F.make_valid_utf8(F.col("content").cast("string"))
    elif charset.upper() in ("ISO-8859-1", "LATIN1"):
        html = F.decode("content", "ISO-8859-1")
    else:
        raise ValueError(f"charset {charset}: convert the files to UTF-8 first")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return as_pages(files.select(
        (url if url is not None else F.col("path")).alias("url"),
        html.alias("html"),
        F.col("modificationTime").alias("fetched_at")), kind)


def from_page(pages: DataFrame, start_page: int = 1) -> DataFrame:
    """S3: pages from a number on; the bound reaches the Parquet scan."""
    return pages.where(F.col("page_no") >= start_page)


def latest_captures(df: DataFrame, *keys: str, newest: str = "fetched_at") -> DataFrame:
    """Keep the newest capture per key where an archive holds several.

    Use it on parsed rows rather than on pages, so that no page text is shuffled. Each task first
    reduces its own rows to one per key, so a key with very many captures sends one row per task.
    """
    others = [c for c in df.columns if c not in keys]
    row = F.struct(*others)
    # Rows of equal time are told apart by content, so that a rerun keeps the same one.
    best = F.max_by(row, F.struct(F.col(newest), F.xxhash64(*others)))
    return df.groupBy(*keys).agg(best.alias("_row")).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
