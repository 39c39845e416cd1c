"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of every ``WIDTH`` consecutive hashes of ``GRAM`` words the smallest is kept, in documents and in
benchmark items alike. A shared span of ``WIDTH + GRAM - 1`` words has the same hashes on both sides,
so the same one is kept and the join of the kept hashes cannot miss it. Documents with such a hit are
looked at again: all their windows meet the distinct windows of the items found, and each hit is
extended over the places that adjoin it.

An item of fewer words than a window is one window and is looked up as a whole, all lengths in one pass. Null and empty texts
have no words. Rows that repeat both id and text count once; an id with several texts has a row for
each. Items that occur in many documents, or documents with many items, spread over tasks by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelode.llm.tables import written

# The generators are the outer ones: from the others the optimizer infers filters on arrays, pushes them
# below the projections that build these arrays, and so builds them anew many times over.
GRAM, WIDTH = 4, 7
SPAN = GRAM + WIDTH - 1


def words_of(text: Column | str) -> Column:
    """Words of ASCII letters, digits and anything beyond ASCII, with A-Z in lower case; none of null."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    return F.coalesce(words, F.array().cast("array<string>"))


def _with_next(df: DataFrame, new: str, old: str, step: int, f, other: str | None = None) -> DataFrame:
    """A column that combines each item of ``old`` with that of ``other`` (or its own) ``step`` places on; its tail is not cut."""
    other = other or old
    ahead = F.slice(F.col(other), step + 1, F.greatest(F.size(other) - step, F.lit(0)))
    return df.withColumn(new, F.zip_with(old, ahead, f))


def with_windows(df: DataFrame, lengths: list[int], words: str = "words") -> DataFrame:
    """``windows``: for each length ``n`` the hashes ``gs`` of all its windows of words, by place.

    A window's hash is put together from those of 1, 2, 4 and 8 words, so a text is gone through a few times only,
    however long its windows are.
    """
    both = lambda a, b: F.xxhash64(a, b)
    kept = df.columns
    df = df.withColumn("_g1", F.transform(words, lambda w: F.xxhash64(w)))
    power = 1
    while 2 * power <= max(lengths):
        df = _with_next(df, f"_g{2 * power}", f"_g{power}", power, both)
        power *= 2
    made = {}
    for n in lengths:
        done, name = 0, None
        for part in (1 << k for k in reversed(range(n.bit_length())) if n >> k & 1):
            if name is None:
                name = f"_g{part}"
            else:
                df = _with_next(df, f"_g{n}_{done + part}", name, done, both, f"_g{part}")
                name = f"_g{n}_{done + part}"
            done += part
        made[n] = name
    whole = [F.struct(F.lit(n).alias("n"), F.slice(name, 1, F.greatest(F.size(words) - (n - 1), F.lit(0))).alias("gs"))
             for n, name in made.items()]
    return df.select(*kept, F.array(*whole).alias("windows"))


def window_places(df: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """The columns of ``keep`` with (n, at, g) for each window of ``words`` of these lengths."""
    by_length = with_windows(df, lengths).select(*keep, F.explode_outer("windows").alias("w"))
    return by_length.select(*keep, F.col("w.n").alias("n"), F.posexplode_outer("w.gs").alias("at", "g"))


def with_grams(df: DataFrame, words: str = "words") -> DataFrame:
    """``grams``: the hash of each ``GRAM`` consecutive words; empty where there are fewer."""
    both = lambda a, b: F.xxhash64(a, b)
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    df = _with_next(_with_next(df, "_h2", "_h", 1, both), "_h4", "_h2", 2, both)
    return df.withColumn("grams", F.slice("_h4", 1, F.greatest(F.size(words) - (GRAM - 1), F.lit(0)))).drop("_h", "_h2", "_h4")


def with_fingerprints(df: DataFrame, words: str = "words") -> DataFrame:
    """``prints``: the distinct smallest grams of all windows; empty where no window fits."""
    low = lambda a, b: F.least(a, b)
    df = with_grams(df, words)
    df = _with_next(_with_next(_with_next(df, "_m2", "grams", 1, low), "_m4", "_m2", 2, low), "_m7", "_m4", 3, low)
    n = F.greatest(F.size(words) - (SPAN - 1), F.lit(0))
    return df.withColumn("prints", F.array_distinct(F.slice("_m7", 1, n))).drop("_m2", "_m4", "_m7")


def _row(df: DataFrame) -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def matched_windows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, item_id, start, end): spans of document words, end exclusive, that hold windows of an item.

    ``row`` is the hash of a document's id and text.
    """
    items = benchmark.select("item_id", words_of("text").alias("words")).where(F.size("words") > 0).distinct()
    items = items.withColumn("n", F.size("words")).withColumn("item", F.xxhash64("item_id", "words"))
    texts = docs.select(_row(docs).alias("row"), words_of("text").alias("words"))
    long_items = items.where(F.col("n") >= SPAN)
    keys = with_fingerprints(long_items).select("item", F.explode_outer("prints").alias("f"))
    found = with_fingerprints(texts).select("row", F.explode_outer("prints").alias("f")).join(keys, "f")
    candidates = written(found.select("row", "item").distinct())

    near = texts.join(candidates.select("row").distinct(), "row", "left_semi")
    spans = _spans(window_matches(near, long_items, [SPAN]).join(candidates, ["row", "item"], "left_semi"))
    # Lengths of short items: at most SPAN - 1 values.
    short = sorted(r.n for r in items.where(F.col("n") < SPAN).select("n").distinct().collect())
    if short:
        spans = spans.unionByName(_spans(window_matches(texts, items.where(F.col("n") < SPAN), short)))
    return spans.join(items.select("item", "item_id"), "item").select("row", "item_id", "start", "end")


def window_matches(texts: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    """(row, item, n, at): places of windows of a text that an item has, too.

    An item has a row for each distinct window, so a place meets an item once, however often either repeats itself.
    """
    # An item has windows of its own length only, or of SPAN words.
    own = items.select("item", "words", F.least("n", F.lit(SPAN)).alias("own"))
    wanted = window_places(own, lengths, "item", "own")
    keys = wanted.where(F.col("n") == F.col("own")).select("item", "n", "g").distinct()
    return window_places(texts, lengths, "row").join(keys, ["n", "g"]).select("row", "item", "n", "at")


def _spans(matches: DataFrame) -> DataFrame:
    """(row, item, start, end): windows at adjoining places in one span. Repeated rows of a text change nothing."""
    along = Window.partitionBy("row", "item").orderBy("at")
    return (matches.withColumn("island", F.col("at") - F.dense_rank().over(along))
            .groupBy("row", "item", "n", "island").agg(F.min("at").alias("start"), F.max("at").alias("last"))
            .select("row", "item", "start", (F.col("last") + F.col("n")).alias("end")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit`` (words in matched windows) and ``items`` (sorted ids as text) by document."""
    spans = written(matched_windows(docs, benchmark))
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    union = spans.select("row", "start", "end").distinct().withColumn("seen", F.max("end").over(before))
    covered = union.groupBy("row").agg(F.sum(F.greatest(
        F.lit(0), F.col("end") - F.greatest("start", F.coalesce("seen", F.lit(0))))).cast("long").alias("n_hit"))
    named = spans.groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    rows = docs.select("doc_id", _row(docs).alias("row"), F.size(words_of("text")).cast("long").alias("n_words")).distinct()
    none = F.array().cast("array<string>")
    return rows.join(written(covered.join(named, "row")), "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no window of any item, with the columns they came with."""
    bad = matched_windows(docs, benchmark).select(F.col("row").alias("_row")).distinct()
    return docs.withColumn("_row", _row(docs)).join(bad, "_row", "left_anti").select(*docs.columns)
