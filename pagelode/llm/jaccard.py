"""Similarity join of documents on the Jaccard similarity of their word n-grams: a size-aware heavy-light join.

Sets that are small list all their subsets of the sizes that a similar partner must share; two small
sets are similar only if they list the same subset. Large sets go to inverted lists: of a set of s
n-grams, the floor(s / 5) + 1 that come first in one order of all n-grams, since two sets with a
similarity of 4/5 share one of these. Small sets near the boundary go to the lists as well, for large
partners. The boundary is where, by the sizes that occur and the length of lists, listing subsets stops
being cheaper than scanning lists.

The order puts frequent n-grams last. Any order gives the same links, so a sketch of fixed size is enough
to tell which ones are frequent. Copies of the same set are one node from the start. A first round links
each node to the most central one of the list it shares most, and those of long lists to others; lists whose nodes are then in one component
have nothing left to show. A second round compares the nodes of the other lists that are in different
components: the component that most of a list's nodes have meets the others only. They have
to share as many n-grams at the start of the order as any similar pair does, and only the first of a node's lists
can be the first one that such a pair shares. Candidates are checked on whole texts, so the result is exact but for
collisions of 64-bit hashes.

Null texts and texts without words have no set and are linked with nothing. Repeated rows stay repeated, and rows with
one id and several texts are judged each by its own. A null id takes part, but names no component: rows that only
resemble rows with null ids have a null component. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagelode.llm.components import connected_components
from pagelode.llm.tables import written
from pagelode.llm.words import SPACED, mixed, pieces, shingle_hashes, split_words, text_array

#: Similar from 4/5 on: 9 * shared >= 4 * (sum of both sizes).
WORDS = 5
SKETCH_BITS = 18
LARGEST_LIGHT = 12
#: Postings of one list that are looked at together in the first round.
LIST_ROWS = 20_000
#: Lists of so many nodes get a round more before all that is left is compared.
CROWDED = 64
#: Nodes of a list that another node meets in one row.
LIST_BLOCK = 256

_CLASS_BITS = np.uint64(58)
_SALT = np.uint64(0x9E3779B97F4A7C15)


def shared_needed(a: int, b: int) -> int:
    return -(-4 * (a + b) // 9)


def subset_sizes(size: int, light: int) -> list[int]:
    """Sizes of the subsets that a small set shares with similar small sets."""
    return sorted({shared_needed(size, t) for t in range(ceil(4 * size / 5), 5 * size // 4 + 1) if t <= light})


def prefix_length(size: int) -> int:
    return size // 5 + 1


def sets_of_piece(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text, sorted, one text after the other; and where each begins."""
    hashes, offsets = shingle_hashes(split_words(texts, SPACED), words)
    parts = [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return np.concatenate([*parts, np.zeros(0, np.uint64)]), np.concatenate(([0], np.cumsum(sizes)))


def set_ids(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each set, whatever the order of its items."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(hashes + _SALT))))
    return mixed(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64) * _SALT).view(np.int64)


def sketched_sets(docs: DataFrame, words: int) -> DataFrame:
    """One pass over all texts: (doc_id, row, n, set) of each, and (cells) with each task's counts of n-grams by cell."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("row", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("set", T.LongType()), T.StructField("cells", T.BinaryType())])
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["doc_id", "row", "n", "set", "cells"]
        for piece in pieces(batches):
            hashes, offsets = sets_of_piece(text_array(piece.column("text")), words)
            counts += np.bincount((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("row"), pa.array(np.diff(offsets)), pa.array(set_ids(hashes, offsets)),
                 pa.nulls(piece.num_rows, pa.binary())], names=names)
        used = np.flatnonzero(counts)
        if len(used):
            blob = np.concatenate((used, counts[used])).astype(np.uint32).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, to_arrow_type(id_type)), *[pa.nulls(1, pa.int64())] * 3, pa.array([blob], pa.binary())], names=names)

    return docs.select("doc_id", _row(), "text").mapInArrow(run, schema)


def _row() -> Column:
    """What tells rows apart that differ in id or text."""
    return F.xxhash64("doc_id", "text").alias("row")


def merged_sketch(cells: DataFrame, tasks: int = 16) -> np.ndarray:
    """The sum of all tasks' counts: summed in ``tasks`` parts, then on the driver; its size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                at, n = np.split(np.frombuffer(blob.as_py(), np.uint32), 2)
                counts[at] += n
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], names=["cells"])

    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in cells.repartition(tasks).mapInArrow(run, "cells binary").toLocalIterator():
        total += np.frombuffer(r.cells, np.int64)
    return total


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """0 for cells that hold no more than chance puts there, then two classes for each doubling; at most 60."""
    mean = counts.mean()
    over = counts - (mean + 4 * np.sqrt(mean) + 1)
    return np.where(over > 0, np.minimum(60, 1 + 2 * np.log2(np.maximum(over, 1))), 0).astype(np.uint64)


def light_boundary(sizes: dict[int, int], counts: np.ndarray) -> int:
    """The largest size up to which listing subsets costs less than scanning the lists of the prefix.

    A list is as long as what an n-gram met by chance has beyond its cell's chance share.
    """
    mean = counts.mean()
    over = np.maximum(0, counts - mean - 4 * np.sqrt(mean))
    length = 1 + float((over * over).sum()) / max(1.0, float(counts.sum()))
    best, best_cost = 0, 0.0
    cost = 0.0
    for size in range(1, LARGEST_LIGHT + 1):
        listed = sum(comb(size, c) for c in subset_sizes(size, size))
        cost += sizes.get(size, 0) * (listed - prefix_length(size) * length)
        if cost < best_cost:
            best, best_cost = size, cost
    return best


def postings(docs: DataFrame, words: int, light: int, counts: np.ndarray, copied: dict[int, object]) -> DataFrame:
    """(key, part, set, n, central): what each set puts into lists. ``copied``: the row that speaks for a frequent set.

    A list that the sketch expects to be long has several parts, numbered from 1; the only part of another list is 0.
    ``central`` is how many frequent n-grams the prefix of the set has: edited copies have rare ones of their own, what
    they were made from has not.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((frequency_classes(counts), np.maximum(1, -(-counts // LIST_ROWS)), copied))
    names = ["key", "part", "set", "n", "central"]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in names])

    def keys_of(order, size):
        keys = []
        if size > light or 5 * size // 4 > light:
            keys.append(order[:prefix_length(size)])
        if size <= light:
            for c in subset_sizes(size, light):
                picked = np.array(list(combinations(range(size), c)))
                sums = mixed(order)[picked].sum(axis=1, dtype=np.uint64) + mixed(np.array([c]))
                keys.append((np.uint64(62) << _CLASS_BITS) | (mixed(sums) >> np.uint64(6)))
        return np.concatenate(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, cell_parts, copied = shared.value
        for piece in pieces(batches):
            hashes, offsets = sets_of_piece(text_array(piece.column("text")), words)
            ids, sizes = set_ids(hashes, offsets), np.diff(offsets)
            cell = (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
            ordered = (classes[cell] << _CLASS_BITS) | (mixed(hashes) >> np.uint64(6))
            parts = cell_parts[cell]
            out_keys, out_parts, own, central = [], [], [], np.zeros(len(ids), np.int64)
            rows = piece.column("row").to_pylist() if copied else None
            for i in np.flatnonzero(sizes).tolist():
                if copied and copied.get(int(ids[i]), rows[i]) != rows[i]:
                    continue
                a, b = offsets[i], offsets[i + 1]
                order = np.argsort(ordered[a:b])
                keys = keys_of(ordered[a:b][order], b - a)
                split = np.ones(len(keys), np.int64)
                central[i] = np.count_nonzero(classes[cell[a:b][order[:prefix_length(b - a)]]])
                if classes[cell[a:b]].any() and (b - a > light or 5 * (b - a) // 4 > light):
                    first = order[:prefix_length(b - a)]
                    split[:len(first)] = np.where(classes[cell[a:b][first]] > 0, parts[a:b][first], 1)
                out_keys.append(keys)
                out_parts.append(split)
                own.append(np.full(len(keys), i))
            if not own:
                continue
            keys, split, own = np.concatenate(out_keys), np.concatenate(out_parts), np.concatenate(own)
            dealt = (mixed(ids[own].view(np.uint64)) % split.astype(np.uint64)).astype(np.int64) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(np.where(split > 1, dealt, 0)), pa.array(ids[own]),
                 pa.array(sizes[own]), pa.array(central[own])], names=names)

    return docs.select(_row(), "text").mapInArrow(run, schema)


def shared_lists(rows: DataFrame) -> DataFrame:
    """Of the postings, those whose list has several sets; with the most central set of its part of the list."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "set", "n", "pivot", "pivot_n")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [[], [], [], [], []]
        for batch in batches:
            for kept, column in zip(columns, batch.columns):
                kept.append(column.to_numpy())
        if not columns[0]:
            return
        key, part, own, n, central = (np.concatenate(c) for c in columns)
        order = np.lexsort((own, -central, part, key))
        key, part, own, n = key[order], part[order], own[order], n[order]
        begins = np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
        fresh = begins | np.concatenate(([True], own[1:] != own[:-1]))
        key, part, own, n, begins = key[fresh], part[fresh], own[fresh], n[fresh], begins[fresh]
        first = np.flatnonzero(begins)
        size = np.diff(np.concatenate((first, [len(part)])))
        pivot = np.repeat(first, size)
        # A list in parts may have its other sets in another part.
        keep = (np.repeat(size, size) > 1) | (part > 0)
        for i in range(0, len(part), 100_000):
            k = np.flatnonzero(keep[i:i + 100_000]) + i
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[k], own[k], n[k], own[pivot[k]], n[pivot[k]])],
                                             names=["key", "set", "n", "pivot", "pivot_n"])

    return rows.repartition("key", "part").mapInArrow(run, schema)


def verified(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Of ``pairs`` (a, b), those whose whole texts are similar. ``texts``: (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for piece in pieces(batches, "text_b"):
            hashes, offsets = sets_of_piece(text_array(piece.column("text_b")), words)
            keep = []
            a = piece.column("a").to_pylist()
            for i in range(piece.num_rows):
                if a[i] != last:  # rows come sorted by a where Spark merges; else this is only slower
                    last = a[i]
                    last_set = sets_of_piece(text_array(piece.column("text_a").slice(i, 1)), words)[0]
                own = hashes[offsets[i]:offsets[i + 1]]
                both = len(np.intersect1d(own, last_set, assume_unique=True))
                keep.append(both > 0 and 9 * both >= 4 * (len(own) + len(last_set)))
            yield pa.RecordBatch.from_arrays([piece.column("a"), piece.column("b"), pa.array(keep, pa.bool_())],
                                             names=["a", "b", "keep"])

    right = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    full = right.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"], T.StructField("keep", T.BooleanType())])
    return full.select("a", "b", "text_a", "text_b").mapInArrow(run, schema).where("keep").select("a", "b")


def _similar_sizes(a: str, b: str):
    return (F.least(a, b) * 5 >= F.greatest(a, b) * 4)


def _prefix_share(a: str, b: str, light: int):
    """How many n-grams of their prefixes two similar sets of these sizes share at least.

    All that is common up to the end of the prefix that ends first is in both prefixes; beyond it there
    are no more than one set has beyond its prefix. Small sets list subsets, of which one is enough.
    """
    return _share_of(F.col(a), F.col(b), light)


def _share_of(a: Column, b: Column, light: int) -> Column:
    rest = lambda n: n - F.floor(n / 5) - 1
    needed = F.ceil((a + b) * 4 / 9) - F.greatest(rest(a), rest(b))
    return F.when(F.least(a, b) <= light, F.lit(1)).otherwise(F.greatest(needed, F.lit(1)))


def _unsettled(lists: DataFrame, linked: DataFrame, least: int = 2) -> DataFrame:
    """Lists of at least ``least`` nodes (``all``) that are in several components; ``main`` is the one that most are in."""
    grouped = lists.join(connected_components(linked), "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    by_key = grouped.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(
        F.max(F.struct("c", "component")).alias("most"), F.count("*").alias("m"), F.sum("c").alias("all"))
    several = by_key.where((F.col("m") > 1) & (F.col("all") >= least))
    return written(grouped.join(several.select("key", F.col("most.component").alias("main"), "all"), "key"))


def _ranked(mixed_lists: DataFrame) -> DataFrame:
    """The open lists of each node: how many they are (``m``) and their places (``r``) in one order, long ones last."""
    own = Window.partitionBy("node")
    return mixed_lists.withColumn("m", F.count("*").over(own)).withColumn("r", F.row_number().over(own.orderBy("all", "key")))


def _meetings(ranked: DataFrame, light: int, block: int = LIST_BLOCK) -> DataFrame:
    """Pairs (a, b, an, bn) of nodes of different components that meet in one of their first open lists, once each.

    Two similar nodes share a number of open lists at least (``_prefix_share``). In the order of all lists, the first one
    that they share has all the others after it, with either node; it is found even if each node looks at its lists
    only so far. A copy that is too far from its group has too many n-grams of its own, few open lists, and meets hardly any.

    A list meets a node in blocks of about ``block`` nodes, by the nodes' hashes, and what a node has met in all of its lists
    is put together by block before a pair becomes a row.
    """
    blocks = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("all") / block, F.lit(1.0))))).cast("long")
    sight = F.col("m") - F.col("r") + 1
    left = ranked.where(F.col("component") != F.col("main")).select(
        "key", F.col("node").alias("x"), F.col("n").alias("xn"), sight.alias("xs"), F.col("component").alias("xc"))
    member = F.struct(F.col("node").alias("y"), F.col("n").alias("yn"), sight.alias("ys"), F.col("component").alias("yc"))
    right = ranked.groupBy("key", F.pmod("node", blocks).alias("block")).agg(
        F.collect_list(member).alias("members"), F.first("main").alias("main"))

    def may_be_similar(v: Column) -> Column:
        x = {c: F.col(c) for c in ("x", "xn", "xs", "xc", "main")}
        least, most = F.least(x["xn"], v["yn"]), F.greatest(x["xn"], v["yn"])
        return ((x["xc"] != v["yc"]) & ((v["yc"] == x["main"]) | (x["x"] < v["y"])) & (least * 5 >= most * 4)
                & (F.least(x["xs"], v["ys"]) >= _share_of(x["xn"], v["yn"], light)))

    met = left.join(right, "key").withColumn("met", F.transform(
        F.filter("members", may_be_similar), lambda v: F.struct(v["y"].alias("y"), v["yn"].alias("yn")))).where(F.size("met") > 0)
    found = met.groupBy("x", "xn", "block").agg(F.array_distinct(F.flatten(F.collect_list("met"))).alias("met"))
    rows = found.select("x", "xn", F.explode("met").alias("v")).select("x", "xn", "v.y", "v.yn")
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"),
                       F.when(F.col("x") < F.col("y"), F.col("xn")).otherwise(F.col("yn")).alias("an"),
                       F.when(F.col("x") < F.col("y"), F.col("yn")).otherwise(F.col("xn")).alias("bn"))


def _candidates(mixed_lists: DataFrame, light: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that share as many lists as similar ones do.

    Every list that two nodes of different components share is an open one, so the count is whole.
    """
    ranked = written(_ranked(mixed_lists))
    # Two nodes may have met from either side, and in lists of different numbers of blocks.
    pairs = _meetings(ranked, light).distinct()
    keys = ranked.groupBy("node").agg(F.collect_list("key").alias("keys"))  # no more than the n-grams of one text
    met = pairs.join(keys.select(F.col("node").alias("a"), F.col("keys").alias("a_keys")), "a").join(
        keys.select(F.col("node").alias("b"), F.col("keys").alias("b_keys")), "b")
    shared = F.size(F.array_intersect("a_keys", "b_keys"))
    return met.where(shared >= _prefix_share("an", "bn", light)).select("a", "b")


def similar_documents(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (the smallest id that links lead to) of each row."""
    stage = written(sketched_sets(docs, words))
    sets = stage.where(F.col("cells").isNull()).drop("cells")
    counts = merged_sketch(stage.where(F.col("cells").isNotNull()).select("cells"))
    full = sets.where(F.col("n") > 0)
    sizes = {r.n: r.c for r in full.where(F.col("n") <= LARGEST_LIGHT).groupBy("n").agg(
        F.count("*").alias("c")).collect()}
    light = light_boundary(sizes, counts)

    # A node is a set; the row with the smallest hash lends it its text.
    classes = full.groupBy("set").agg(F.min("doc_id").alias("id"), F.min("row").alias("row"), F.count("*").alias("copies"))
    many = max(2, full.count() // 1000)
    # Sets that a thousandth of all documents have: at most a thousand.
    copied = {r.set: r.row for r in classes.where(F.col("copies") >= many).collect()}

    met = written(shared_lists(postings(docs, words, light, counts, copied)))
    lists = met.select("key", F.col("set").alias("node"), "n")
    speakers = classes.join(lists.select(F.col("node").alias("set")).distinct(), "set", "left_semi").select("set", "row")
    texts = docs.select(_row(), "text").join(speakers, "row").select(F.col("set").alias("node"), "text")
    if not full.join(speakers, "row", "left_semi").groupBy("row").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["node"])  # rows of the same id and text
    texts = written(texts)
    # One row for each pair of a set and the most central set of some list of it, before anything is joined.
    stars = met.where((F.col("set") != F.col("pivot")) & _similar_sizes("n", "pivot_n")).groupBy(
        "set", "pivot", "n", "pivot_n").agg(F.count("*").alias("c"))
    # Half of what all their lists would have to show: other lists of the two may have other pivots.
    stars = stars.where(F.col("c") * 2 >= _prefix_share("n", "pivot_n", light))
    first = written(stars.groupBy("set").agg(F.max(F.struct("c", "pivot")).alias("best")).select(
        F.col("best.pivot").alias("a"), F.col("set").alias("b")))
    linked = written(verified(first, texts, words))

    # Members of long lists that are not yet with most of the list try two more of those that are.
    crowded = _unsettled(lists, linked, CROWDED)
    some = crowded.where(F.col("component") == F.col("main")).groupBy("key").agg(
        F.min_by(F.struct("node", "n"), F.xxhash64("key", "node")).alias("y"))
    tries = crowded.where(F.col("component") != F.col("main")).join(some, "key").select(
        F.col("node").alias("b"), F.col("n").alias("bn"), F.col("y.node").alias("a"), F.col("y.n").alias("an")).where(
        _similar_sizes("an", "bn")).groupBy("a", "b").agg(F.count("*").alias("c"))
    best = tries.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("c"), "a"))).where("r <= 2")
    linked = written(linked.union(verified(best.select("a", "b"), texts, words)))

    pairs = _candidates(_unsettled(lists, linked), light)
    seen = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = written(verified(pairs.join(seen, ["a", "b"], "left_anti"), texts, words))

    groups = connected_components(linked.union(more))
    found = written(classes.select(F.col("set").alias("node"), "id").join(groups, "node", "left").select(
        F.col("node").alias("set"), "id", F.coalesce("component", "node").alias("component")))
    names = found.groupBy("component").agg(F.min("id").alias("name"))
    named = found.join(names, "component").select("set", "name")
    own = F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc_id"))
    return sets.join(named, "set", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def without_similar(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The document with the smallest id of each group, and all without words; with the columns they came with."""
    groups = similar_documents(docs, words)
    others = groups.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)
