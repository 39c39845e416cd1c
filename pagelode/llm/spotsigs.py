"""Document fingerprints by SpotSigs, with DataFrame functions only.

A signature is a common word (the anchor) with the chain of the next content words after it, common
words left out. The set of a text's signatures is its fingerprint: layouts and boilerplate have few
anchors, prose has many. Each text is compared with its edited text and with the next row's, by the
Jaccard of the whole sets; it is exact but for collisions of 64-bit hashes. As only these pairs are
compared and no others searched for, there are no partitions by length.

The fingerprint is the number of signatures with a digest of the whole set. A text without an anchored chain has one signature, of the whole text, so equal
texts have equal fingerprints. Null texts count as empty ones.
Rows are ordered by id, with null first (ids that are texts by their bytes), then by the hash of the text; rows that repeat both have the
same neighbour.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagelode.llm.decontaminate import words_of

#: Common words of the languages the corpus has: fixed values.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his in is it its not of on or she that the their "
    "there they this to was were which will with you "
    "das dem den der des die ein eine einer es für im ist mit nicht sich sie und von war wie zu "
    "au avec ce dans de du elle en est et il je la le les ne ou par pas plus pour qui que se son sur un une vous "
    "al como con del el esta las lo los más no para pero por su una y").split()

CHAIN = 2


def with_sets(df: DataFrame, text: str, out: str) -> DataFrame:
    """``out``: the hashes of the text's distinct signatures."""
    w, stops, content = (f"_{out}_{c}" for c in ("w", "s", "c"))
    df = df.withColumn(w, words_of(text))
    places = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: F.element_at(w, i).isin(ANCHORS))
    df = df.withColumn(stops, F.when(F.size(w) > 0, places).otherwise(F.array().cast("array<int>")))
    df = df.withColumn(content, F.filter(w, lambda x: ~x.isin(ANCHORS)))
    # The anchor with r anchors before it, at place i, has i - r - 1 content words before it.
    enough = F.filter(stops, lambda i, r: i - r + CHAIN - 1 <= F.size(content))
    signature = F.transform(enough, lambda i, r: F.xxhash64(F.element_at(w, i), F.slice(content, i - r, CHAIN)))
    found = F.array_distinct(signature)
    whole = F.array(F.xxhash64(F.coalesce(text, F.lit(""))))
    return df.withColumn(out, F.when(F.size(found) > 0, found).otherwise(whole)).drop(w, stops, content)


def likeness(a: str, b: str) -> Column:
    """Jaccard of two sets of signatures."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def as_text(signatures: str) -> Column:
    """The number of signatures and a digest of the whole set."""
    listed = F.array_join(F.sort_array(signatures).cast("array<string>"), ",")
    return F.concat_ws(":", F.size(signatures).cast("string"), F.sha2(listed.cast("binary"), 256))


def _place(ids: DataFrame) -> Column:
    """A number that grows with ``doc_id``: of a text, its first six bytes."""
    if isinstance(ids.schema["doc_id"].dataType, T.NumericType):
        return F.col("doc_id").cast("double")
    first = F.hex(F.substring(F.col("doc_id").cast("string").cast("binary"), 1, 6))
    return F.conv(F.rpad(first, 12, "0"), 16, 10).cast("double")


def with_next(docs: DataFrame, prepare, columns: list[str], parts: int = 16_384, rows_per_part: int = 32) -> DataFrame:
    """``prepare(docs)`` with ``next_<column>`` of the row that follows in the order of ids; the first follows the last.

    Ids are cut into ranges by approximate quantiles, at most ``parts`` of them; a range is a window's
    partition, and the first row of the next range stands at its end as a guest. So nothing is ordered
    as a whole, and every text moves once; ``prepare`` runs where the text has arrived.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h")]
    ids = docs.select(_place(docs).alias("d")).where("d IS NOT NULL")
    m = max(1, min(parts, ids.count() // rows_per_part))
    cuts = sorted(set(ids.approxQuantile("d", [i / m for i in range(1, m)], 1 / (4 * m)))) if m > 1 else []
    # Ranges are whole numbers: a window over doubles would not take the exchange below as its own.
    ranges = Bucketizer(splits=[-float("inf"), *(cuts or [0.0]), float("inf")], inputCol="_d", outputCol="_r")
    marked = ranges.transform(docs.withColumn("_h", F.xxhash64("text")).withColumn(
        "_d", F.coalesce(_place(docs), F.lit(-1.7e308)))).withColumn("_r", F.col("_r").cast("int")).drop("_d")
    # Of each range the id and hash of the first row; at most as many as there are ranges.
    heads = marked.groupBy("_r").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "_h")).alias("k"))
    along = Window.orderBy("_r")
    first = F.first("k").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = heads.select("_r", F.coalesce(F.lead("k").over(along), first).alias("k")).select(
        F.col("_r").alias("_to"), F.col("k.doc_id").alias("_id"), F.col("k._h").alias("_hh"))
    guests = marked.join(F.broadcast(after), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hh")))
    guests = guests.dropDuplicates(["_to"]).select(*docs.columns, "_h", F.col("_to").alias("_r"), F.lit(1).alias("_guest"))
    everyone = prepare(marked.withColumn("_guest", F.lit(0)).unionByName(guests).repartition("_r"))
    within = Window.partitionBy("_r").orderBy("_guest", *order)
    led = everyone.withColumn("_next", F.lead(F.struct(*columns)).over(within)).where("_guest = 0")
    return led.select(*(c for c in everyone.columns if c not in ("_h", "_r", "_guest")),
                      *(F.col("_next")[c].alias(f"next_{c}") for c in columns))


def edited_text(text: str = "text", following: str = "next_text") -> Column:
    """The text with its last half replaced by as much of the beginning of the next one."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(F.col(text), F.lit(1), n - half), F.substring(F.col(following), F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each row's ``fingerprint``, its edited text and that one's, and how alike they and the next row's are."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = with_next(plain, lambda df: with_sets(df, "text", "own"), ["text", "own"])
    edited = with_sets(own.withColumn("edited", edited_text()), "edited", "changed")
    return edited.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "edited",
        as_text("own").alias("fingerprint"), as_text("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"), likeness("own", "next_own").alias("near_next"))
