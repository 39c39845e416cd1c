"""Captures that are worth parsing, told from slim columns before any page text is read into a parser."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.functions.text import clean_text
from pagelode.plans.storage import written

#: Bits of a part of the filter: one row of it.
PART_BITS = 32_768
#: Bits for each key, up to the bound on the whole filter, which is what is broadcast: 32 MB.
BITS_PER_KEY = 16
MOST_BITS = 1 << 28


def key_bits(keys: int, most_bits: int = MOST_BITS) -> int:
    """Size of a filter for so many keys: a power of two, at least one part and at most ``most_bits``."""
    wanted = max(PART_BITS, keys * BITS_PER_KEY)
    return min(1 << (wanted - 1).bit_length(), most_bits)


def key_filter(keys: DataFrame, bits: int) -> DataFrame:
    """A Bloom filter with one hash over the column ``key``, in parts: rows of ``part`` and ``bitmap``.

    Each task combines its keys to bitmaps, and there are ``bits / 32768`` parts of 4 kB however many keys there are.
    """
    place = F.pmod("key", F.lit(bits))
    at = keys.select(F.floor(place / PART_BITS).cast("int").alias("part"), F.pmod(place, F.lit(PART_BITS)).alias("bit"))
    return at.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def may_have_key(df: DataFrame, key: Column, filter_parts: DataFrame, bits: int) -> DataFrame:
    """Rows whose key may be in the filter: all that are, and of the others a share of keys to bits.

    The filter is broadcast; its size has the bound of ``key_bits``. Rows do not move.
    """
    names = df.columns
    place = F.pmod(key, F.lit(bits))
    bit = F.pmod(F.col("_place"), F.lit(PART_BITS))
    byte = F.conv(F.hex(F.substring("_bitmap", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    parts = filter_parts.select(F.col("part").alias("_part"), F.col("bitmap").alias("_bitmap"))
    met = df.withColumn("_place", place).withColumn("_own", F.floor(F.col("_place") / PART_BITS).cast("int")).join(
        F.broadcast(parts), F.col("_own") == F.col("_part"))
    shifted = F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))).cast("int")
    return met.where(shifted % 2 == 1).select(*names)


def capture_key(url: Column | str, time: Column | str) -> Column:
    return F.xxhash64(url, time)


def newest_wanted(pages: DataFrame, wanted: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Of ``pages``, the newest captures of the URLs in ``wanted`` (``detail_url``), and few others.

    What is newest and wanted is worked out on URLs and times alone; a filter of bounded size then picks rows at
    the scan, so other captures are never parsed. No capture that counts is lost. What passes by chance, at most
    one in sixteen of the others below the bound, is left to the join that follows. Captures of one time all pass.
    """
    url = clean_text(F.col("url"))
    newest = pages.select(url.alias("_url"), "fetched_at").groupBy("_url").agg(F.max("fetched_at").alias("_time"))
    listed = wanted.select(F.col("detail_url").alias("_url")).distinct()
    keys = written(newest.join(listed, "_url", "left_semi").select(capture_key("_url", "_time").alias("key")))
    bits = key_bits(keys.count(), most_bits)
    return may_have_key(pages, capture_key(url, F.col("fetched_at")), key_filter(keys, bits), bits)
