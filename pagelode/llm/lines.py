"""Line deduplication with a fixed-depth tree of line templates.

A line goes down the tree by its number of words and its first three words; words with digits are
variable and stand for any other. In the leaf its template is what remains constant: all its other
words, or, in lines of at least ``BRANCHING`` words, those at even or at odd places, so that lines
which differ in a field still meet. A template that occurs in several documents is recurring. It stays
in the document with the smallest id; in the others its lines are dropped.

Templates are hashes, counted with a map side, so one that a third of all lines has sends a row for
each task. Lines of fewer than ``least_words`` words stay. A line repeated within one document only is
no recurring line. Null texts stay null; a null id counts as the largest one, ids that are no numbers go by their
hashes, and rows with the same id count as one document. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.functions.binding import let
from pagelode.llm.words import SPACED, mixed, pieces, split_words, text_array

LEADING, BRANCHING = 3, 8
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ANY = np.uint64(0x2545F4914F6CDD1D)
_BRANCH = mixed(np.arange(2, dtype=np.uint64))


def _row(df: DataFrame) -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def templates_of_piece(texts: pa.Array, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, line of the text from 0, template) for all lines of a piece."""
    words = split_words(texts, SPACED)
    empty = np.zeros(0, np.int64)
    if not len(words.hashes):
        return empty, empty, empty
    # Lines of the piece: a new one after each line feed and at each text.
    line_of_word = np.searchsorted(words.breaks, words.starts) + words.doc
    first = np.flatnonzero(np.concatenate(([True], line_of_word[1:] != line_of_word[:-1])))
    n = np.diff(np.concatenate((first, [len(words.starts)])))
    line, doc = line_of_word[first], words.doc[first]
    digits = np.concatenate(([0], np.cumsum((words.data >= 48) & (words.data <= 57))))
    variable = digits[words.ends] > digits[words.starts]
    place = np.arange(len(words.starts)) - np.repeat(first, n)
    steps = np.uint64(2) * place.astype(np.uint64) + np.uint64(1)
    masked = mixed(np.where(variable, _ANY, words.hashes) + steps * _STEP)
    constant = np.add.reduceat((~variable).astype(np.int64), first)
    mostly = 2 * constant >= n

    def summed(values):
        return np.add.reduceat(values, first)

    nothing = np.uint64(0)
    lead = place < LEADING
    leaf = mixed(summed(np.where(lead, masked, nothing)) + n.astype(np.uint64) * _ANY)
    exact = mixed(words.hashes + steps * _STEP)
    found = []
    whole = np.where(mostly, summed(masked), summed(exact) + _ANY)
    keep = n >= least_words
    found.append((keep, whole))
    for parity in (0, 1):
        some = summed(np.where(lead | (place % 2 == parity), masked, nothing)) + _BRANCH[parity]
        found.append((keep & mostly & (n >= BRANCHING), some))
    # Line feeds before the text: what a line's number in its text is counted from.
    before = np.searchsorted(words.breaks, words.bounds[:-1]) + np.arange(len(words.bounds) - 1)
    number = line - before[doc]
    return (np.concatenate([doc[k] for k, _ in found]), np.concatenate([number[k] for k, _ in found]),
            np.concatenate([mixed(leaf[k] + mixed(t[k])).view(np.int64) for k, t in found]))


def line_templates(docs: DataFrame, least_words: int = 4) -> DataFrame:
    """(row, doc, line, template) for every line; ``row`` is the hash of a document's id and text."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("row", "doc", "line", "template")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            at, line, template = templates_of_piece(text_array(piece.column("text")), least_words)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [piece.column("row").take(take), piece.column("doc").take(take), pa.array(line), pa.array(template)],
                names=["row", "doc", "line", "template"])

    last = F.lit((1 << 63) - 1)
    # Ids that are no numbers come in the order of their hashes.
    number = isinstance(docs.schema["doc_id"].dataType, T.NumericType)
    place = F.col("doc_id").cast("long") if number else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    return docs.select(_row(docs).alias("row"), F.coalesce(place, last).alias("doc"), "text").mapInArrow(run, schema)


def recurring_lines(docs: DataFrame, least_words: int = 4) -> DataFrame:
    """(row, lines): the numbers of the lines to drop, by document, without those of the first document."""
    lines = line_templates(docs, least_words)
    spread = lines.groupBy("template").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    recurring = spread.where(F.col("first") < F.col("last")).drop("last")
    dropped = lines.join(recurring, "template").where(F.col("doc") > F.col("first")).select("row", "line")
    return dropped.groupBy("row").agg(F.collect_set("line").alias("lines"))


def drop_recurring_lines(docs: DataFrame, least_words: int = 4, *, counts: bool = False,
                         drop_emptied: bool = False) -> DataFrame:
    """The documents with recurring lines taken out of ``text``; with ``counts`` also ``n_lines`` and ``n_dropped``.

    Every document stays; with ``drop_emptied`` all but those that lines were taken from and that keep no word.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), _row(docs).alias("row"))
    marked = rows.join(recurring_lines(docs, least_words), "row", "left")
    own = F.col("own").getField
    split = F.split(own("text"), "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(split) - 1).cast("array<long>"), F.col("lines"))
    kept = F.array_join(let(split, lambda s: F.transform(places, lambda i: F.get(s, i.cast("int")))), "\n")
    text = F.when(F.col("lines").isNull(), own("text")).otherwise(kept).alias("text")
    if drop_emptied:
        marked = marked.where(F.col("lines").isNull() | text.rlike(r"\S"))
    columns = [text if c == "text" else own(c).alias(c) for c in docs.columns]
    if counts:
        columns += [F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"),
                    F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_dropped")]
    return marked.select(*columns)
