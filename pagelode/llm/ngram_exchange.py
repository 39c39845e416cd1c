"""Scores by deleted interpolation where the texts to score are known together with those to learn from.

Like ``ngram_model``, with all pairs and triples, but without a table of counts. Texts are packed in parts of some
megabytes. Each part sends its distinct n-grams once, sorted and packed, with its own training counts, to the range of
hashes they are in. A range adds up what all parts have sent and tells a part only what it cannot know: the totals
of its n-grams that other parts have as well. Most n-grams are in one part, and cost no more than their way there. The rows
that weights are learned from are parts of their own, so only those meet their totals twice.

Rows are packed as runs, one for each part and range that has any, so there are never more rows than n-grams. Hashes have as
many bits as keep the n-grams of the whole corpus apart: less than one pair of different ones is expected to meet, as long
as 64 bits are enough for that. Null texts are empty; a null flag is false. Rows are learned and scored each.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.llm import ngram_model as M
from pagelode.llm.tables import written
from pagelode.llm.words import pieces, text_array

#: Text of the documents that are packed together.
PART_BYTES = 5 << 20
#: N-grams of a range.
RANGE_KEYS = 1 << 20
WORDS, LONGER = 0, 1

_CODEC = "zstd"


def packed(values: np.ndarray) -> bytes:
    """Numbers byte by byte, the lowest bytes first, without those that are zero in all; compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = int(np.max(np.flatnonzero(planes.any(axis=1)), initial=-1)) + 1
    return bytes([used]) + pa.compress(planes[:used].tobytes(), codec=_CODEC, asbytes=True)


def unpacked(blob: bytes, n: int) -> np.ndarray:
    used = blob[0]
    planes = np.zeros((8, n), np.uint8)
    if used and n:
        raw = pa.decompress(blob[1:], decompressed_size=used * n, codec=_CODEC, asbytes=True)
        planes[:used] = np.frombuffer(raw, np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def stored_parts(docs: DataFrame, training: Column, deleted: Column) -> DataFrame:
    """``part``, ``size`` (characters as bytes) and ``texts``: the packed rows of neighbouring documents.

    Rows that weights are learned from have parts of their own, with odd numbers.
    """
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("size", T.LongType()),
                           T.StructField("texts", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, [0, 0]
        held: list[list[pa.RecordBatch]] = [[], []]

        def out(learn: int) -> pa.RecordBatch:
            size = sum(piece.column("text").nbytes for piece in held[learn])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[learn][0].schema, options=pa.ipc.IpcWriteOptions(compression=_CODEC)) as stream:
                for piece in held[learn]:
                    stream.write_batch(piece)
            part = first + 2 * made[learn] + learn
            held[learn], made[learn] = [], made[learn] + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                names=["part", "size", "texts"])

        for piece in pieces(batches, size=min(PART_BYTES, 2 << 20)):
            own = piece.column("learn")
            for learn, rows in ((0, piece.filter(pc.invert(own))), (1, piece.filter(own))):
                if rows.num_rows:
                    held[learn].append(rows)
                    if sum(p.column("text").nbytes for p in held[learn]) >= PART_BYTES:
                        yield out(learn)
        for learn in (0, 1):
            if held[learn]:
                yield out(learn)

    rows = docs.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("train"),
                       F.coalesce(training & deleted, F.lit(False)).alias("learn"))
    return written(rows.mapInArrow(run, schema))


class Part:
    """The texts of a part with its distinct n-grams: of words, and of pairs and triples."""

    def __init__(self, texts: bytes, bits: int):
        table = pa.ipc.open_stream(texts).read_all().combine_chunks()
        self.ids = table.column("doc_id").combine_chunks()
        tokens, self.offsets = M.tokens_of(text_array(table.column("text")))
        pair, triple = M.longer_keys(tokens, self.offsets)
        lengths = np.diff(self.offsets)
        train = np.repeat(table.column("train").to_numpy(zero_copy_only=False), lengths)
        inner = np.ones(len(tokens), bool)
        inner[self.offsets[:-1]] = False
        down = np.uint64(64 - bits)
        self.keys, self.at, self.own = [None, None], [None, None], [None, None]
        # The first token of a text has no triple; its place stands for its pair, and is not counted.
        both = np.concatenate((pair.view(np.uint64), triple.view(np.uint64)))
        both >>= down
        del pair, triple, table
        counts = np.concatenate((train, train & inner))
        for kind, keys, n in ((WORDS, tokens >> down, train), (LONGER, both, counts)):
            self.keys[kind], at = np.unique(keys, return_inverse=True)
            self.at[kind] = at.astype(np.int32)
            self.own[kind] = np.bincount(at[n], minlength=len(self.keys[kind]))
        self.end = (np.array([M.END]) >> down)[0]


def range_of(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(bits - 32)) * np.uint64(ranges)) >> np.uint64(32)


def first_of_range(keys: np.ndarray, number: int, bits: int, ranges: int) -> int:
    """The place in sorted keys where a range begins, without a look at all of them."""
    return int(np.searchsorted(keys, np.uint64(-(-(number << 32) // ranges) << (bits - 32))))


def _sent(parts: DataFrame, bits: int, ranges: int) -> DataFrame:
    """What the parts send: for each kind and range the distinct n-grams, and their counts in the part's training texts."""
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("kind", "range", "part", "n")),
                           T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, part = batch.column("part")[i].as_py(), Part(batch.column("texts")[i].as_py(), bits)
                for kind in (WORDS, LONGER):
                    keys, own = part.keys[kind], part.own[kind]
                    where = range_of(keys, bits, ranges)
                    cuts = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), len(keys)]
                    rows = [(kind, int(where[a]), number, b - a, packed(np.diff(keys[a:b], prepend=np.uint64(0))), packed(own[a:b]))
                            for a, b in zip(cuts[:-1], cuts[1:]) if b > a]
                    for j in range(0, len(rows), 256):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(list(x), t) for x, t in zip(zip(*rows[j:j + 256]), [pa.int64()] * 4 + [pa.binary()] * 2)],
                            names=["kind", "range", "part", "n", "keys", "counts"])
                del part
                pa.default_memory_pool().release_unused()

    return parts.select("part", "texts").mapInArrow(run, schema)


def _totals(sent: DataFrame) -> DataFrame:
    """What parts are told: the places of their n-grams that others have too, and the totals of these. A row without a part
    tells how many words a range has and how often they occur."""
    names = ["part", "kind", "range", "n", "at", "totals", "distinct", "tokens"]
    types = [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.int64()] * 2
    schema = T.StructType([T.StructField(c, T.BinaryType() if t == pa.binary() else T.LongType()) for c, t in zip(names, types)])

    def together(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        keys = np.concatenate([np.cumsum(unpacked(r["keys"], r["n"]), dtype=np.uint64) for r in rows])
        own = np.concatenate([unpacked(r["counts"], r["n"]).astype(np.int64) for r in rows])
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        sums = np.add.reduceat(own[order], starts)
        total = np.empty(len(keys), np.int64)
        total[order] = np.repeat(sums, np.diff(np.concatenate((starts, [len(keys)]))))
        out, a = [], 0
        for r in rows:
            b = a + r["n"]
            at = np.flatnonzero(total[a:b] != own[a:b])
            if len(at):
                out.append((r["part"], r["kind"], r["range"], len(at), packed(np.diff(at, prepend=0)), packed(total[a:b][at]), None, None))
            a = b
        if rows[0]["kind"] == WORDS:
            out.append((None, WORDS, rows[0]["range"], 0, None, None, int((sums > 0).sum()), int(sums.sum())))
        return pa.Table.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out) if out else [[]] * len(names), types)], names=names)

    return sent.groupBy("kind", "range").applyInArrow(together, schema)


def _use(joined: DataFrame, bits: int, ranges: int, use, schema: T.StructType) -> DataFrame:
    """What ``use(part, c3, c2, c1, seen3, seen2)`` makes of each part and the counts of its tokens' n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = Part(batch.column("texts")[i].as_py(), bits)
                counts = [part.own[WORDS].copy(), part.own[LONGER].copy()]
                for told in batch.column("told")[i].as_py() or []:
                    kind = told["kind"]
                    first = first_of_range(part.keys[kind], told["range"], bits, ranges)
                    at = np.cumsum(unpacked(told["at"], told["n"]).astype(np.int64))
                    counts[kind][first + at] = unpacked(told["totals"], told["n"]).astype(np.int64)
                c1 = counts[WORDS][part.at[WORDS]]
                c2, c3 = np.split(counts[LONGER][part.at[LONGER]], 2)
                ends = np.searchsorted(part.keys[WORDS], part.end)  # every text has an end
                seen2, seen3, c3 = np.empty_like(c1), np.empty_like(c2), c3.copy()
                seen2[1:], seen3[1:] = c1[:-1], c2[:-1]
                heads = part.offsets[:-1]
                seen2[heads], seen3[heads], c3[heads] = counts[WORDS][ends], 0, 0
                yield use(part, c3, c2, c1, seen3, seen2)
                del part, counts, c1, c2, c3, seen2, seen3
                pa.default_memory_pool().release_unused()

    return joined.select("texts", "told").mapInArrow(run, schema)


def released(spark: SparkSession) -> None:
    """Have Spark's cleaner look for shuffles that nothing refers to any more, so that their files go before more are written."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def interpolated_scores(docs: DataFrame, training: Column, deleted: Column) -> tuple[DataFrame, M.Model]:
    """``doc_id``, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of each row's whole text, and the model.

    The model learns from the rows that are ``training``, and its weights from those of them that are ``deleted``.
    """
    spark = docs.sparkSession
    parts = stored_parts(docs, training, deleted)
    size = parts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n_grams = max(1, size)  # a word and its blank are two bytes at least, and end a pair and a triple
    bits = max(33, min(64, 2 * n_grams.bit_length()))
    ranges = max(1, -(-n_grams // (2 * RANGE_KEYS)))
    told = written(_totals(_sent(parts, bits, ranges)))
    released(spark)
    known = told.where("part IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("distinct", "tokens")]).first()

    def joined(wanted: Column) -> DataFrame:
        by_part = told.where(F.col("part").isNotNull() & wanted).groupBy("part").agg(
            F.collect_list(F.struct("kind", "range", "n", "at", "totals")).alias("told"))
        return parts.where(wanted).select("part", "texts").join(by_part, "part", "left")

    none = np.zeros(0, np.uint64)
    model = M.Model(known.tokens, known.distinct, none, none.astype(np.int64), none, whole=True)
    tokens = model.tokens

    def events(part, c3, c2, c1, seen3, seen2):
        keys, n = np.unique(M.deleted_keys(M.bucket_of(seen3, seen2), c3, c2, c1, seen3, seen2, tokens), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    counted = _use(joined(F.col("part") % 2 == 1), bits, ranges, events, T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())]))
    model.weights = M.mixture_weights(M.sorted_table(counted.groupBy("key").agg(F.sum("n").alias("n"))), [], model)
    score, schema = M.scoring(model, docs.schema["doc_id"])
    return _use(joined(F.lit(True)), bits, ranges, lambda part, *counts: score(part.ids, part.offsets, *counts), schema), model
