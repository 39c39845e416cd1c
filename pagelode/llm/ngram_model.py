"""Language-model scores by deleted interpolation of n-grams.

Words and an end of text are counted over all training documents. The maximum-likelihood estimates of
three, two and one words and a uniform one are mixed with weights that depend on how often the context
was seen; expectation-maximisation learns them from training events whose own count is taken out
(deleted), over a fixed share of the training documents.

All words, pairs and triples of the training documents are in the model, however rare. Their counts are
a table in the shared folder, which grows with the documents. Texts are read in parts of some megabytes;
each part sends its distinct n-grams to the table once and gets their counts back. As every word of a
text is followed by one token, a context's total is its own count. The mixture is a probability over all
texts, with one place for unknown words.

A caller who wants a small model gives ``ngram_share``: n-grams of several words then enter it from that
share of all tokens on, and its tables are broadcast; only rare words are looked up by a join. Its
estimates are over what it keeps.

Null texts are empty and have an end only. A null id counts as the empty text for folds. Without
training documents the uniform estimate over the one unknown word is left, log probability 0. Repeated
rows are learned and scored each. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.llm.tables import written
from pagelode.llm.words import SPACED, mixed, pieces, split_words, text_array

END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)
BUCKETS = 256
#: From this share of all tokens on, words are in the broadcast table of a small model.
COMMON_SHARE = 2e-7
#: Text of the documents whose n-grams are looked up together.
PART_BYTES = 16 << 20


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text followed by its end; and where each text begins."""
    words = split_words(texts, SPACED)
    n = words.counts + 1
    offsets = np.concatenate(([0], np.cumsum(n)))
    out = np.full(offsets[-1], END, np.uint64)
    ends = np.zeros(len(out), bool)
    ends[offsets[1:] - 1] = True
    out[~ends] = words.hashes
    return out, offsets


def found_in(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted value in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


def in_unique(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """``found_in`` for values that repeat a lot."""
    unique, inverse = np.unique(wanted, return_inverse=True)
    return found_in(keys, unique)[inverse]


def bucket_of(seen3: np.ndarray, seen2: np.ndarray) -> np.ndarray:
    level = lambda n: np.where(n > 0, 1 + np.minimum(14, np.log2(np.maximum(n, 1)) // 2), 0).astype(np.int64)
    return 16 * level(seen3) + level(seen2)


def word_keys(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return tokens.view(np.int64)


def longer_keys(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By token: hash of the pair that ends with it, and of the triple; the first of a text has no triple of its own."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[offsets[:-1]] = START
    pair = mixed(mixed(before + START) + tokens)
    triple = np.empty_like(pair)
    triple[1:] = mixed(mixed(pair[:-1] ^ START) + tokens[1:])
    triple[offsets[:-1]] = pair[offsets[:-1]]
    return pair.view(np.int64), triple.view(np.int64)


@dataclass
class Model:
    """Tables of the model, all sorted by key; a word's number is its place in ``words``."""

    tokens: int
    distinct: int
    common: np.ndarray
    common_n: np.ndarray
    words: np.ndarray
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    pairs_n: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    triples: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    triples_n: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 4)))
    whole: bool = False  # all n-grams count, and are not in these tables

    def __post_init__(self):
        self.total()

    @property
    def base(self) -> int:
        return len(self.words) + 1  # the last number is the start of a text

    def total(self):
        """How often each context is followed by something that the model keeps."""
        self.after_word = np.bincount(self.pairs // self.base, weights=self.pairs_n, minlength=self.base)
        self.after_pair = np.bincount(self.triples // self.base, weights=self.triples_n, minlength=len(self.pairs) + 1)

    def word_numbers(self, tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each token and of the one before it; -1 for a word without one."""
        number = in_unique(self.words, tokens)
        before = np.empty_like(number)
        before[1:] = number[:-1]
        before[offsets[:-1]] = self.base - 1
        return number, before

    def pair_keys(self, number, before):
        return np.where((number >= 0) & (before >= 0), before * self.base + number, -1)

    def triple_keys(self, pair, number, offsets):
        context = np.empty_like(pair)
        context[1:] = pair[:-1]
        context[offsets[:-1]] = -1
        return context, np.where((context >= 0) & (number >= 0), context * self.base + number, -1)

    def events(self, tokens: np.ndarray, offsets: np.ndarray):
        """By token: bucket of its context; counts of the triple, the pair and the word, and of their contexts."""
        number, before = self.word_numbers(tokens, offsets)
        pair = in_unique(self.pairs, self.pair_keys(number, before))
        context, keys = self.triple_keys(pair, number, offsets)
        triple = in_unique(self.triples, keys)
        one = in_unique(self.common, tokens)
        pick = lambda table, at: np.where(at >= 0, table[np.maximum(at, 0)] if len(table) else 0, 0)
        seen2, seen3 = pick(self.after_word, before), pick(self.after_pair, context)
        return (bucket_of(seen3, seen2), (pick(self.triples_n, triple), pick(self.pairs_n, pair),
                                                   np.where(one >= 0, pick(self.common_n, one), -1)), (seen3, seen2))


# --- counting ---

def counted(docs: DataFrame, keys_of, most: int = 1 << 22) -> DataFrame:
    """(key, n) over all documents; ``keys_of(tokens, offsets)`` gives the keys of a piece, negative ones are left out.

    Each task adds up what it has before it sends, and holds a bounded number of keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def added():
            keys, n = np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])
            unique, inverse = np.unique(keys, return_inverse=True)
            return unique, np.bincount(inverse, weights=n).astype(np.int64)

        def out(keys, n):
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i:i + 100_000]), pa.array(n[i:i + 100_000])],
                                                 names=["key", "n"])

        for piece in pieces(batches):
            held.append(np.unique(keys_of(*tokens_of(text_array(piece.column("text")))), return_counts=True))
            if sum(len(k) for k, _ in held) > most:
                held[:] = [added()]
                if len(held[0][0]) > most // 2:
                    yield from out(*held.pop())
        if held:
            yield from out(*added())

    sums = docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return sums


def longer_counts(training: DataFrame) -> DataFrame:
    """(key, n) of all pairs and triples."""

    def keys_of(tokens, offsets):
        pair, triple = longer_keys(tokens, offsets)
        inner = np.ones(len(tokens), bool)
        inner[offsets[:-1]] = False
        return np.concatenate((pair, triple[inner]))

    # Hashes take all 64 bits, and none is left out.
    return counted(training, keys_of)


def sorted_table(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A table of bounded size (key, n) as two arrays, sorted by key."""
    table = df.select("key", "n").toArrow()
    keys, n = (table.column(c).to_numpy() for c in ("key", "n"))
    order = np.argsort(keys)
    return keys[order], n[order]


def learned_tables(training: DataFrame, common_share: float, ngram_share: float) -> tuple[Model, DataFrame]:
    """The model without its weights, and the counts of all words as a table in the shared folder."""
    spark = training.sparkSession
    vocabulary = written(counted(training, word_keys))
    size = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    least = max(1, int(np.ceil(ngram_share * size.n)))
    common, common_n = sorted_table(vocabulary.where(F.col("n") >= max(1, int(np.ceil(common_share * size.n)))))
    order = np.argsort(common.view(np.uint64))
    common, common_n = common.view(np.uint64)[order], common_n[order]
    model = Model(size.n, size.v, common, common_n, common[common_n >= least])
    for order in (2, 3):
        shared = spark.sparkContext.broadcast(model)

        def keys_of(tokens, offsets, order=order, shared=shared):
            own = shared.value
            number, before = own.word_numbers(tokens, offsets)
            keys = own.pair_keys(number, before)
            if order == 3:
                pair = in_unique(own.pairs, keys)
                _, keys = own.triple_keys(pair, np.where(pair >= 0, number, -1), offsets)
            return keys[keys >= 0]

        keys, n = sorted_table(counted(training, keys_of).where(F.col("n") >= least))
        if order == 2:
            model.pairs, model.pairs_n = keys, n
        else:
            model.triples, model.triples_n = keys, n
        model.total()
    return model, vocabulary


# --- counts of all n-grams, by parts of the documents ---

def in_parts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``part``: documents that were read together, as a table in the shared folder."""
    schema = T.StructType([docs.schema["doc_id"], docs.schema["text"], T.StructField("part", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = 0, PART_BYTES
        for piece in pieces(batches):
            if size >= PART_BYTES:
                part, size = int.from_bytes(os.urandom(8), "little") >> 1, 0
            size += piece.column("text").nbytes
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("text"), pa.array(np.full(piece.num_rows, part))],
                names=["doc_id", "text", "part"])

    return written(docs.select("doc_id", "text").mapInArrow(run, schema))


def by_counts(docs: DataFrame, counts: DataFrame, use, schema: T.StructType) -> DataFrame:
    """What ``use`` makes of every part: ``use(ids, offsets, c3, c2, c1, seen3, seen2)`` gets the counts by token."""
    stored = in_parts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def out():
            keys = np.unique(np.concatenate(held))
            for i in range(0, len(keys), 100_000):
                k = keys[i:i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), last)), pa.array(k)], names=["part", "key"])
            held.clear()

        for batch in batches:
            parts = batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if held and parts[a] != last:
                    yield from out()
                last = int(parts[a])
                for piece in pieces([batch.slice(a, b - a)]):
                    tokens, offsets = tokens_of(text_array(piece.column("text")))
                    held.append(np.unique(np.concatenate((tokens.view(np.int64), *longer_keys(tokens, offsets)))))
        if held:
            yield from out()

    wanted = stored.select("part", "text").mapInArrow(run, "part long, key long")
    # Most n-grams are seen once: those are not sent back.
    found = wanted.join(counts, "key", "left").select("part", "key", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")

    def together(texts: pa.Table, known: pa.Table) -> pa.Table:
        keys, n = known.column("key").to_numpy(), known.column("n").to_numpy()
        order = np.argsort(keys)
        keys, n = keys[order], n[order]

        def count(wanted):
            at = in_unique(keys, wanted)
            return np.where(at >= 0, n[np.maximum(at, 0)] if len(n) else 0, 1)

        texts_seen = int(count(np.array([END]).view(np.int64))[0])
        made = []
        for piece in pieces(texts.combine_chunks().to_batches()):
            tokens, offsets = tokens_of(text_array(piece.column("text")))
            pair, triple = longer_keys(tokens, offsets)
            c1, c2, c3 = count(tokens.view(np.int64)), count(pair), count(triple)
            seen2, seen3 = np.empty_like(c1), np.empty_like(c2)
            seen2[1:], seen3[1:] = c1[:-1], c2[:-1]
            first = offsets[:-1]
            seen2[first], seen3[first], c3[first] = texts_seen, 0, 0
            made.append(use(piece.column("doc_id"), offsets, c3, c2, c1, seen3, seen2))
        return pa.Table.from_batches(made)

    return stored.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(together, schema)


def whole_events(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """``deleted_events`` with the counts of all n-grams."""
    tokens = model.tokens

    def use(ids, offsets, c3, c2, c1, seen3, seen2):
        keys, n = np.unique(deleted_keys(bucket_of(seen3, seen2), c3, c2, c1, seen3, seen2, tokens), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])
    return by_counts(docs, counts, use, schema).groupBy("key").agg(F.sum("n").alias("n"))


def whole_scores(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``score_texts`` with the counts of all n-grams."""
    return by_counts(docs, counts, *scoring(model, docs.schema["doc_id"]))


def scoring(model: Model, id_field: T.StructField):
    """What scores the texts of a batch out of the counts by token, and the schema of that."""
    uniform = 1 / (model.distinct + 1)
    size = float(np.log10(model.tokens + 0.1 * (model.distinct + 1)))
    weights, tokens = model.weights, model.tokens
    schema = T.StructType([id_field, *(T.StructField(n, t) for n, t in (
        ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())))])
    names = schema.names

    def use(ids, offsets, c3, c2, c1, seen3, seen2):
        w = weights[bucket_of(seen3, seen2)]
        p = (w[:, 0] * c3 / np.maximum(seen3, 1) + w[:, 1] * c2 / np.maximum(seen2, 1)
             + w[:, 2] * c1 / max(1, tokens) + w[:, 3] * uniform)
        at, n = offsets[:-1], np.diff(offsets)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(n), pa.array(np.add.reduceat((c1 > 0).astype(np.int64), at)),
             pa.array(np.add.reduceat(np.log10(c1 + 0.1), at) - n * size), pa.array(np.add.reduceat(np.log10(p), at))],
            names=names)

    return use, schema


# --- weights ---

NONE, RARE = -1, -2


def steps_of(f: np.ndarray) -> np.ndarray:
    """Halves of binary orders of magnitude below 1; -1 for zero."""
    return np.where(f > 0, np.rint(-2 * np.log2(np.maximum(f, 1e-30))), NONE).astype(np.int64)


def deleted_keys(bucket, c3, c2, c1, seen3, seen2, tokens: int) -> np.ndarray:
    """By token: its bucket and the estimates without its own count, in one number."""
    rest = lambda c, seen: np.where((c > 0) & (seen > 1), (c - 1) / np.maximum(seen - 1, 1), 0)
    q1 = np.where(c1 < 0, RARE, steps_of(rest(c1, tokens)))
    q = [steps_of(rest(c3, seen3)) + 2, steps_of(rest(c2, seen2)) + 2, q1 + 2]
    return ((bucket * 256 + q[0]) * 256 + q[1]) * 256 + q[2]


def deleted_events(docs: DataFrame, model: Model) -> DataFrame:
    """(bucket, q3, q2, q1, n): training events by the estimates they have without their own count."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keys_of(tokens, offsets):
        own = shared.value
        bucket, (c3, c2, c1), (seen3, seen2) = own.events(tokens, offsets)
        return deleted_keys(bucket, c3, c2, c1, seen3, seen2, own.tokens)

    return counted(docs, keys_of)


def mixture_weights(events: tuple[np.ndarray, np.ndarray], rare: list[tuple[int, float, float]], model: Model,
                    rounds: int = 40) -> np.ndarray:
    """Weights by bucket of the estimates of three, two, one and no words, by expectation-maximisation.

    ``rare``: by size, (level, tokens, tokens times their deleted count) of the words that are not common.
    """
    keys, n = events
    q1, q2, q3, bucket = keys % 256 - 2, keys // 256 % 256 - 2, keys // 65536 % 256 - 2, keys >> 24
    value = lambda q: np.where(q >= 0, 2.0 ** (-np.maximum(q, 0) / 2), 0.0)
    uniform = 1 / (model.distinct + 1)
    f = np.stack((value(q3), value(q2), value(q1), np.full(len(q1), uniform)), 1)
    weight = n.astype(float)
    is_rare = q1 == RARE
    if is_rare.any():  # spread over how often rare words are seen
        total = sum(t for _, t, _ in rare) or 1.0
        parts, weights, buckets = [f[~is_rare]], [weight[~is_rare]], [bucket[~is_rare]]
        for _, t, deleted in rare or [(0, 1.0, 0.0)]:
            g = f[is_rare].copy()
            g[:, 2] = deleted / t / max(1, model.tokens - 1) if t else 0
            parts.append(g)
            weights.append(weight[is_rare] * t / total if rare else weight[is_rare])
            buckets.append(bucket[is_rare])
        f, weight, bucket = np.concatenate(parts), np.concatenate(weights), np.concatenate(buckets)
    ids = np.arange(BUCKETS)
    able = np.stack((ids // 16 > 0, ids % 16 > 0, np.full(BUCKETS, model.tokens > 0), np.ones(BUCKETS)), 1).astype(float)
    w = able / able.sum(1, keepdims=True)
    for _ in range(rounds):
        share = w[bucket] * f
        share *= (weight / np.maximum(share.sum(1), 1e-300))[:, None]
        new = np.stack([np.bincount(bucket, weights=share[:, k], minlength=BUCKETS) for k in range(4)], 1)
        mass = new.sum(1, keepdims=True)
        w = np.where(mass > 0, new / np.maximum(mass, 1e-300), w)
    w[:, 3] = np.maximum(w[:, 3], 1e-6)  # no text is impossible
    return w / w.sum(1, keepdims=True)


def train_language_scores(training: DataFrame, deleted: Column, common_share: float = COMMON_SHARE,
                          ngram_share: float | None = None) -> tuple[Model, DataFrame]:
    """The model of all ``training`` rows, and its table of counts; ``deleted`` chooses the rows that weights learn from.

    The table has all words and n-grams; with ``ngram_share``, which makes a small model, all words.
    """
    if ngram_share is None:
        vocabulary = written(counted(training, word_keys))
        size = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        counts = vocabulary.unionByName(written(longer_counts(training)))
        none = np.zeros(0, np.uint64)
        model = Model(size.n, size.v, none, none.astype(np.int64), none, whole=True)
        model.weights = mixture_weights(sorted_table(whole_events(training.where(deleted), counts, model)), [], model)
        return model, counts
    model, vocabulary = learned_tables(training, common_share, ngram_share)
    events = sorted_table(deleted_events(training.where(deleted), model))
    common = max(1, int(np.ceil(common_share * model.tokens)))
    rare = [(r.level, float(r.t), float(r.d)) for r in vocabulary.where(F.col("n") < common).groupBy(
        F.floor(F.log2("n")).alias("level")).agg(
            F.sum("n").alias("t"), F.sum(F.col("n") * (F.col("n") - 1)).alias("d")).orderBy("level").collect()]
    model.weights = mixture_weights(events, rare, model)
    return model, vocabulary


# --- scoring ---

def score_texts(docs: DataFrame, model: Model, vocabulary: DataFrame) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of each row's whole text.

    Of a small model, common words are scored where the text is read; the others go to the table of all words, added up
    by document, and come back as one sum. Rows are told apart by the hash of id and text.
    """
    if model.whole:
        return whole_scores(docs, model, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    uniform = 1 / (model.distinct + 1)
    size = float(np.log10(model.tokens + 0.1 * (model.distinct + 1)))
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in (
        ("row", T.LongType()), ("n_tokens", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()),
        ("log", T.DoubleType()), ("key", T.LongType()), ("bucket", T.ShortType()), ("times", T.IntegerType())))])
    names = schema.names
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type
        own = shared.value
        arrow_id = to_arrow_type(id_type)
        for piece in pieces(batches):
            tokens, offsets = tokens_of(text_array(piece.column("text")))
            rows = piece.column("row").to_numpy()
            bucket, (c3, c2, c1), (seen3, seen2) = own.events(tokens, offsets)
            known = c1 >= 0
            w = own.weights[bucket]
            p = (w[:, 0] * c3 / np.maximum(seen3, 1) + w[:, 1] * c2 / np.maximum(seen2, 1)
                 + w[:, 2] * np.maximum(c1, 0) / max(1, own.tokens) + w[:, 3] * uniform)
            log = np.where(known, np.log10(p), 0)
            base = np.where(known, np.log10(np.maximum(c1, 0) + 0.1), 0)
            at = offsets[:-1]
            n = piece.num_rows
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("row"), pa.array(np.diff(offsets)),
                 pa.array(np.add.reduceat(known.astype(np.int64), at)), pa.array(np.add.reduceat(base, at)),
                 pa.array(np.add.reduceat(log, at)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int16()),
                 pa.nulls(n, pa.int32())], names=names)
            rare = np.flatnonzero(~known)
            doc = np.repeat(np.arange(n), np.diff(offsets))[rare]
            order = np.lexsort((bucket[rare], tokens[rare], doc))
            doc, key, b = doc[order], tokens[rare][order], bucket[rare][order]
            first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
                                                   | (b[1:] != b[:-1])))) if len(doc) else np.zeros(0, np.int64)
            times = np.diff(np.concatenate((first, [len(doc)])))
            for i in range(0, len(first), 50_000):
                f = first[i:i + 50_000]
                m = len(f)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(m, arrow_id), pa.array(rows[doc[f]]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()),
                     pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.array(key[f].view(np.int64)),
                     pa.array(b[f].astype(np.int16)), pa.array(times[i:i + 50_000].astype(np.int32))], names=names)

    marked = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    parts = written(marked.mapInArrow(run, schema))
    rare = parts.where(F.col("key").isNotNull()).join(vocabulary, "key", "left")
    count = F.coalesce("n", F.lit(0))
    weights = lambda k: F.element_at(F.array(*(F.lit(float(w)) for w in model.weights[:, k])), F.col("bucket") + 1)
    p = weights(2) * count / max(1, model.tokens) + weights(3) * uniform
    sums = rare.groupBy("row").agg(
        F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("known2"),
        F.sum(F.col("times") * F.log10(count + F.lit(0.1))).alias("base2"),
        F.sum(F.col("times") * F.log10(p)).alias("log2"))
    # A row that stands twice in the input has sent its rare words twice.
    whole = parts.where(F.col("key").isNull())
    twice = whole.groupBy("row").agg(F.count("*").alias("copies"))
    sums = sums.join(twice, "row")
    of = lambda c: F.coalesce(F.col(c) / F.col("copies"), F.lit(0))
    return whole.join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.rint(of("known2"))).cast("long").alias("n_known"),
        (F.col("base") + of("base2") - F.col("n_tokens") * size).alias("base_score"),
        (F.col("log") + of("log2")).alias("score"))
