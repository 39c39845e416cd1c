"""Toxicity scores by a bidirectional gated recurrent network with attention pooling.

A word enters the network twice: as an embedding of its hash, and as the pooled states of a recurrent
encoder over its characters, so endings and stems that were never seen still count. A second
recurrent encoder runs over the words of a window; its pooled states give the logit of the window.
All windows of a text overlap, and the largest logit decides, calibrated with the number of windows.
Training and scoring are numpy; scoring runs inside Spark's tasks over Arrow batches.

Null and empty texts have no window: their score is what calibration gives without evidence.
Without labelled rows of both kinds every score is the share of toxic labels (0 without any).
Repeated rows are scored each; ties and extra columns do not matter.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagelode.llm.words import SPACED, Words, pieces, split_words, text_array

WINDOW, STRIDE = 64, 48
#: A word beyond this many bytes is read as several of this size.
LETTERS = 20
SYMBOLS = 96
EMBEDDINGS = 1 << 13
CHAR_STATES, WORD_STATES, WORD_SIZE, ATTENTION = 10, 8, 6, 8

F32 = np.float32


def sigmoid(x):
    return 1 / (1 + np.exp(-x.clip(-30, 30)))


def tanh(x):
    return 2 * sigmoid(2 * x) - 1


class Encoder:
    """Two gated recurrent layers, one for each direction, each pooled by its own attention.

    Sequences are at the start of their rows in both directions, so what follows a sequence's end
    never reaches a state that attention looks at.
    """

    def __init__(self, params: dict, name: str):
        self.U, self.A, self.v = (params[f"{name}.{k}"] for k in "UAv")
        self.name, self.H = name, params[f"{name}.U"].shape[1]

    @staticmethod
    def created(rng, name: str, states: int) -> dict:
        return {f"{name}.U": (rng.normal(size=(2, states, 3 * states)) / np.sqrt(states)).astype(F32),
                f"{name}.A": (rng.normal(size=(2, states, ATTENTION)) / np.sqrt(states)).astype(F32),
                f"{name}.v": (rng.normal(size=(2, 1, ATTENTION)) / np.sqrt(ATTENTION)).astype(F32)}

    def forward(self, inputs, valid, keep: bool = False):
        """``inputs(t)``: (2, batch, 3 states) at step t; ``valid``: (steps, batch). Gives (2, batch, states)."""
        H, (steps, batch) = self.H, valid.shape
        h = np.zeros((2, batch, H), F32)
        states = np.empty((steps, 2, batch, H), F32)
        kept = []
        for t in range(steps):
            g, a = inputs(t), h @ self.U
            zr = sigmoid(g[..., :2 * H] + a[..., :2 * H])
            n = tanh(g[..., 2 * H:] + zr[..., H:] * a[..., 2 * H:])
            if keep:
                kept.append((h, zr, n, a[..., 2 * H:]))
            h = n + zr[..., :H] * (h - n)
            states[t] = h
        seen = tanh(states @ self.A)
        e = (seen * self.v).sum(-1)
        e = np.where(valid[:, None], e, -1e9)
        e = np.exp(e - e.max(0))
        weight = (e / e.sum(0)) * valid[:, None]
        pooled = (weight[..., None] * states).sum(0)
        return pooled, (kept, states, seen, weight)

    def backward(self, cache, d_pooled):
        """Gradients of the parameters, and (steps, 2, batch, 3 states) of the inputs."""
        kept, states, seen, weight = cache
        H = self.H
        d_weight = (d_pooled * states).sum(-1)
        d_e = weight * (d_weight - (weight * d_weight).sum(0))
        d_v = (d_e[..., None] * seen).sum((0, 2))[:, None]
        d_seen = d_e[..., None] * self.v * (1 - seen * seen)
        d_A = sum(states[t].transpose(0, 2, 1) @ d_seen[t] for t in range(len(states)))
        d_states = weight[..., None] * d_pooled + d_seen @ self.A.transpose(0, 2, 1)
        d_U, carry = np.zeros_like(self.U), np.zeros_like(states[0])
        d_in = np.empty((*states.shape[:3], 3 * H), F32)
        for t in range(len(states) - 1, -1, -1):
            h, zr, n, an = kept[t]
            z, r = zr[..., :H], zr[..., H:]
            dh = d_states[t] + carry
            d_n = dh * (1 - z) * (1 - n * n)
            d_z = dh * (h - n) * z * (1 - z)
            d_r = d_n * an * r * (1 - r)
            d_in[t] = np.concatenate((d_z, d_r, d_n), -1)
            d_a = np.concatenate((d_z, d_r, d_n * r), -1)
            d_U += h.transpose(0, 2, 1) @ d_a
            carry = dh * z + d_a @ self.U.transpose(0, 2, 1)
        return {f"{self.name}.U": d_U, f"{self.name}.A": d_A, f"{self.name}.v": d_v}, d_in


def both_ways(sequences: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(2, batch, steps): each row as it is, and with its first ``lengths`` items reversed."""
    steps = np.arange(sequences.shape[1])
    back = np.where(steps < lengths[:, None], lengths[:, None] - 1 - steps, steps)
    return np.stack((sequences, np.take_along_axis(sequences, back, 1)))


def spelled(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of some words, and their lengths; bytes fall into ``SYMBOLS`` classes."""
    lengths = np.minimum(words.ends[which] - words.starts[which], LETTERS)
    at = np.minimum(words.starts[which, None] + np.arange(LETTERS), len(words.data) - 1)
    return np.where(np.arange(LETTERS) < lengths[:, None], words.data[at] % (SYMBOLS - 1) + 1, 0), lengths


def cut_long_words(words: Words) -> Words:
    """Words of more than ``LETTERS`` bytes become several, so every byte is read."""
    sizes = words.ends - words.starts
    n = np.maximum(1, -(-sizes // LETTERS))
    if not len(n) or n.max() == 1:
        return words
    part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(words.starts, n) + part * LETTERS
    ends = np.minimum(starts + LETTERS, np.repeat(words.ends, n))
    doc = np.repeat(words.doc, n)
    counts = np.bincount(doc, minlength=len(words.counts))
    hashes = np.repeat(words.hashes, n) + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return Words(words.data, starts, ends, doc, counts, np.concatenate(([0], np.cumsum(counts))), hashes,
                 words.breaks, words.bounds)


def words_of_all(texts: list[str]) -> Words:
    """The words of many texts, split in pieces so that what splitting needs stays small."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
    parts = [split_words(piece.column("text"), SPACED) for piece in pieces([batch])]
    bytes_before = np.cumsum([0, *(len(p.data) for p in parts)])
    texts_before = np.cumsum([0, *(len(p.counts) for p in parts)])
    moved = lambda name, before: np.concatenate([getattr(p, name) + b for p, b in zip(parts, before)])
    counts = np.concatenate([p.counts for p in parts])
    return Words(np.concatenate([p.data for p in parts]), moved("starts", bytes_before), moved("ends", bytes_before),
                 moved("doc", texts_before), counts, np.concatenate(([0], np.cumsum(counts))),
                 np.concatenate([p.hashes for p in parts]), moved("breaks", bytes_before), moved("bounds", bytes_before))


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all texts: the window's text, its first word in the text, its number of words."""
    n = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(counts)), n)
    first = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    return doc, first, np.minimum(WINDOW, counts[doc] - first)


class ToxicityModel:
    """Parameters of both encoders, and the calibration of a text's largest logit."""

    def __init__(self, params: dict | None, calibration: tuple[float, float, float], prior: float = 0.0):
        self.params, self.calibration, self.prior = params, calibration, prior

    # --- the network ---

    def char_vectors(self, letters, lengths, keep=False):
        encoder = Encoder(self.params, "char")
        steps = int(lengths.max(initial=1))
        ways = both_ways(letters[:, :steps], lengths)
        table = self.params["char.in"]
        valid = np.arange(steps)[:, None] < lengths
        pooled, cache = encoder.forward(
            lambda t: np.stack((table[0][ways[0, :, t]], table[1][ways[1, :, t]])), valid, keep)
        return np.concatenate(pooled, -1), (encoder, ways, cache)

    def word_inputs(self, letters, lengths, slots, keep=False):
        """What each word adds to the gates of both directions: (words, 2, 3 states)."""
        vectors, cache = self.char_vectors(letters, lengths, keep)
        x = np.concatenate((vectors, self.params["word.emb"][slots]), -1)
        return (x @ self.params["word.in"] + self.params["word.b"]).reshape(len(x), 2, 3 * WORD_STATES), (x, cache)

    def window_logits(self, gates, ids, lengths, keep=False):
        """``ids``: (windows, steps) places in ``gates``."""
        encoder = Encoder(self.params, "word")
        steps = int(lengths.max(initial=1))
        ways = both_ways(ids[:, :steps], lengths)
        pooled, cache = encoder.forward(
            lambda t: np.stack((gates[ways[0, :, t], 0], gates[ways[1, :, t], 1])),
            np.arange(steps)[:, None] < lengths, keep)
        return np.concatenate(pooled, -1) @ self.params["out.w"] + self.params["out.b"], (encoder, ways, pooled, cache)

    # --- scoring ---

    def largest_logits(self, words: Words, batch: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By window: its text, its first word, its logit."""
        unique, first_at, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        gates = np.empty((len(unique), 2, 3 * WORD_STATES), F32)
        sizes = np.minimum(words.ends[first_at] - words.starts[first_at], LETTERS)
        order = np.argsort(sizes, kind="stable")  # words of like length take the same steps
        for i in range(0, len(order), 4 * batch):
            some = order[i:i + 4 * batch]
            gates[some] = self.word_inputs(*spelled(words, first_at[some]), slots_of(unique[some]))[0]
        doc, first, lengths = windows_of(words.counts)
        logits = np.empty(len(doc), F32)
        order = np.argsort(-lengths, kind="stable")
        padded = np.concatenate((inverse, np.zeros(WINDOW, inverse.dtype)))
        begin = words.offsets[:-1][doc] + first
        for i in range(0, len(doc), batch):
            some = order[i:i + batch]
            ids = padded[begin[some, None] + np.arange(WINDOW)]
            logits[some] = self.window_logits(gates, ids, lengths[some])[0]
        return doc, first, logits

    def scores(self, texts: pa.Array) -> np.ndarray:
        n = len(texts)
        if self.params is None:
            return np.full(n, self.prior)
        words = cut_long_words(split_words(texts, SPACED))
        doc, _, logits = self.largest_logits(words)
        return self.calibrated(doc, logits, n)

    def calibrated(self, doc, logits, n) -> np.ndarray:
        largest = np.full(n, -8.0)
        np.maximum.at(largest, doc, logits.clip(-8, 8))
        a, b, c = self.calibration
        return sigmoid(a * largest + b + c * np.log1p(np.bincount(doc, minlength=n)))


def slots_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(EMBEDDINGS)).astype(np.int64)


# --- training ---

class Adam:
    def __init__(self, params: dict, rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.s = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict):
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = F32(min(1.0, 5.0 / max(norm, 1e-9)))
        for k, g in grads.items():
            g = g * scale
            self.m[k] = F32(0.9) * self.m[k] + F32(0.1) * g
            self.s[k] = F32(0.99) * self.s[k] + F32(0.01) * g * g
            m, s = self.m[k] / F32(1 - 0.9 ** self.t), self.s[k] / F32(1 - 0.99 ** self.t)
            self.params[k] -= F32(self.rate) * m / (np.sqrt(s) + F32(1e-6))


def added(shape, at, values):
    """Sums of ``values`` by their place ``at`` in the first axis."""
    flat = values.reshape(len(at), -1)
    order = np.argsort(at, kind="stable")
    keys, starts = np.unique(at[order], return_index=True)
    out = np.zeros((shape[0], flat.shape[1]), F32)
    out[keys] = np.add.reduceat(flat[order], starts)
    return out.reshape(shape)


def char_gradients(model, cache, d_vectors) -> dict:
    encoder, ways, inner = cache
    grads, d_in = encoder.backward(inner, np.stack(np.split(d_vectors, 2, -1)))
    steps = len(d_in)
    grads["char.in"] = np.stack([
        added(model.params["char.in"][d].shape, ways[d, :, :steps].T.ravel(), d_in[:, d].reshape(-1, d_in.shape[-1]))
        for d in (0, 1)])
    return grads


def train_words(model, letters, lengths, target, weight, rng, rounds, optimizer):
    """The character encoder learns how often texts with a word are toxic."""
    w, b = np.zeros(2 * CHAR_STATES, F32), F32(0)
    own = {"w": w, "b": np.zeros(1, F32)}
    side = Adam(own, optimizer.rate)
    order = np.argsort(lengths, kind="stable")
    groups = [order[i:i + 512] for i in range(0, len(order), 512)]
    for _ in range(rounds):
        for g in rng.permutation(len(groups)):
            some = groups[g]
            vectors, cache = model.char_vectors(letters[some], lengths[some], True)
            d = ((sigmoid(vectors @ own["w"] + own["b"]) - target[some]) * weight[some]).astype(F32) / len(some)
            optimizer.step(char_gradients(model, cache, d[:, None] * own["w"]))
            side.step({"w": vectors.T @ d, "b": np.array([d.sum()], F32)})
    return own["w"]


def train_windows(model, words, unique_at, inverse, begin, lengths, target, rng, optimizer, batch=64):
    """One round over windows, through both encoders."""
    padded = np.concatenate((inverse, np.zeros(WINDOW, inverse.dtype)))
    for group in np.array_split(rng.permutation(len(begin)), max(1, len(begin) // batch)):
        group = group[np.argsort(-lengths[group], kind="stable")]
        tokens = padded[begin[group, None] + np.arange(WINDOW)]
        tokens = np.where(np.arange(WINDOW) < lengths[group, None], tokens, tokens[:, :1])
        own, ids = np.unique(tokens, return_inverse=True)
        ids = ids.reshape(tokens.shape)
        at = unique_at[own]
        slots = slots_of(words.hashes[at])
        gates, (x, chars) = model.word_inputs(*spelled(words, at), slots, True)
        logits, (encoder, ways, pooled, cache) = model.window_logits(gates, ids, lengths[group], True)
        d = ((sigmoid(logits) - target[group]) / len(group)).astype(F32)
        p = model.params
        d_pooled = d[:, None] * p["out.w"]
        grads, d_in = encoder.backward(cache, np.stack(np.split(d_pooled, 2, -1)))
        grads["out.w"] = np.concatenate(pooled, -1).T @ d
        grads["out.b"] = np.array([d.sum()], F32)
        steps = len(d_in)
        d_gates = np.stack([added((len(own), 3 * WORD_STATES), ways[k, :, :steps].T.ravel(),
                                  d_in[:, k].reshape(-1, 3 * WORD_STATES)) for k in (0, 1)], 1).reshape(len(own), -1)
        grads["word.in"], grads["word.b"] = x.T @ d_gates, d_gates.sum(0)
        d_x = d_gates @ p["word.in"].T
        grads |= char_gradients(model, chars, d_x[:, :2 * CHAR_STATES])
        grads["word.emb"] = added(p["word.emb"].shape, slots, d_x[:, 2 * CHAR_STATES:]) + F32(1e-4) * p["word.emb"]
        optimizer.step(grads)


def calibration_of(largest, windows, target, weight) -> tuple[float, float, float]:
    """Weighted logistic regression of the label on the largest logit and the number of windows."""
    x = np.stack((largest, np.ones_like(largest), np.log1p(windows)), 1)
    w = np.array([1.0, 0.0, 0.0])
    ridge = np.diag([1e-3, 1e-3, 1.0])
    for _ in range(30):
        p = sigmoid(x @ w)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        w = w - np.linalg.solve(h, x.T @ (weight * (p - target)) + ridge @ (w - [1.0, 0, 0]))
    return tuple(float(v) for v in w)


def fit(texts: list[str], toxic: list[int], prior: float, rounds: int = 4, seed: int = 7) -> ToxicityModel:
    """A model of labelled texts; ``prior`` is the share of toxic ones where texts come from."""
    target = np.array(toxic, np.float64)
    if len(set(toxic)) < 2:
        return ToxicityModel(None, (1, 0, 0), float(prior))
    rng = np.random.default_rng(seed)
    params = (Encoder.created(rng, "char", CHAR_STATES) | Encoder.created(rng, "word", WORD_STATES) | {
        "char.in": (rng.normal(size=(2, SYMBOLS, 3 * CHAR_STATES)) * 0.5).astype(F32),
        "word.emb": np.zeros((EMBEDDINGS, WORD_SIZE), F32),
        "word.in": (rng.normal(size=(2 * CHAR_STATES + WORD_SIZE, 6 * WORD_STATES)) * 0.5).astype(F32),
        "word.b": np.zeros(6 * WORD_STATES, F32),
        "out.w": (rng.normal(size=2 * WORD_STATES) * 0.5).astype(F32), "out.b": np.zeros(1, F32)})
    model = ToxicityModel(params, (1.0, 0.0, 0.0), float(prior))
    words = cut_long_words(words_of_all(texts))
    _, unique_at, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
    pairs = np.unique(inverse.astype(np.int64) * len(texts) + words.doc)
    n_texts = np.bincount(pairs // len(texts), minlength=len(unique_at))
    n_toxic = np.bincount(pairs // len(texts), weights=target[pairs % len(texts)], minlength=len(unique_at))

    share = target.mean()
    # How far a word's texts are from the usual share, and the shrunk odds that its embedding starts with.
    evidence = (n_toxic - n_texts * share) ** 2 / (n_texts * share * (1 - share))
    odds = np.log((n_toxic + 4 * share) / (n_texts - n_toxic + 4 * (1 - share)) * (1 - share) / share)
    slots, strength = slots_of(words.hashes[unique_at]), np.abs(odds) * np.sqrt(n_texts)
    strongest = np.argsort(strength, kind="stable")  # of words that share a slot, the last one written stays
    params["word.emb"][slots[strongest], 0] = odds[strongest]

    order = np.argsort(-evidence, kind="stable")
    some = np.concatenate((order[:15000], rng.choice(order[15000:], min(30000, max(0, len(order) - 15000)), False)))
    optimizer = Adam(params, 0.01)
    own = train_words(model, *spelled(words, unique_at[some]), n_toxic[some] / n_texts[some],
                evidence[some].clip(0.5, 30), rng, 5 if len(some) > 5000 else 15, optimizer)

    doc, first, lengths = windows_of(words.counts)
    begin = words.offsets[:-1][doc] + first
    # The word that looks most toxic to the character encoder begins the choice of a text's window.
    telling = np.empty(len(unique_at))
    order = np.argsort(words.ends[unique_at] - words.starts[unique_at], kind="stable")
    for i in range(0, len(order), 8192):
        part = order[i:i + 8192]
        telling[part] = model.char_vectors(*spelled(words, unique_at[part]))[0] @ own
    padded = np.concatenate((telling[inverse], np.zeros(WINDOW)))
    rank = np.array([padded[b:b + n].max() for b, n in zip(begin, lengths)])
    optimizer.rate = 0.006
    for turn in range(rounds):
        if turn:
            rank = model.largest_logits(words)[2]
            optimizer.rate *= 0.7
        by_text = np.lexsort((-rank, doc))
        top = by_text[np.concatenate(([True], doc[by_text][1:] != doc[by_text][:-1]))]
        clean = np.flatnonzero(target[doc] == 0)
        chosen = np.concatenate((top, rng.choice(clean, min(len(clean), len(top)), False)))
        chosen = np.tile(chosen, max(1, 3000 // len(chosen)))
        train_windows(model, words, unique_at, inverse, begin[chosen], lengths[chosen], target[doc[chosen]], rng,
                      optimizer)
    doc, _, logits = model.largest_logits(words)
    largest = np.full(len(texts), -8.0)
    np.maximum.at(largest, doc, logits.clip(-8, 8))
    weight = np.where(target == 1, prior / share, (1 - prior) / (1 - share))
    model.calibration = calibration_of(largest, np.bincount(doc, minlength=len(texts)), target, weight)
    return model


def give_back_memory() -> None:
    """Return what training has freed to the system: the C library keeps it, and the driver goes on with other work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of most Linux systems has it
    if trim is not None:
        trim(0)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int,
                  chars: int) -> tuple[list[str], list[int], float]:
    """At most ``rows`` labelled texts, half of each kind, each of at most ``chars`` characters; and the share of toxic.

    The ids are chosen among the labels, those with the smallest hashes first, so the bound holds for any
    corpus and the choice is the same in every run. Only then are their texts looked up, in one scan.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.col("doc_id"))
    chosen = [r for kind in (0, 1) for r in
              known.where(F.col("toxic") == kind).orderBy(order, "doc_id").limit(rows).collect()]
    ids = docs.sparkSession.createDataFrame(chosen, known.schema)  # at most 2 * rows
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where(F.length("text") <= chars)
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("toxic").orderBy(order, "doc_id", "text")))
    sample = ranked.where(F.col("r") <= rows // 2).orderBy("toxic", "r").collect()
    total = sum(counts.values())
    return [r.text for r in sample], [r.toxic for r in sample], counts.get(1, 0) / total if total else 0.0


def train_toxicity_model(docs: DataFrame, labels: DataFrame, rows: int = 2560, chars: int = 6000) -> ToxicityModel:
    """A model of ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``toxic``); see ``training_rows``."""
    model = fit(*training_rows(docs, labels, rows, chars))
    give_back_memory()
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, *keep: str, name: str = "toxicity") -> DataFrame:
    """``doc_id``, the columns of ``keep``, and in ``name`` the score (0 to 1) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = ["doc_id", *keep]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            scores = shared.value.scores(text_array(piece.column("text")))
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), pa.array(scores, pa.float64())],
                                             names=[*kept, name])

    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows that score below the threshold, with the columns they came with."""
    scored = score_toxicity(docs, model, *(c for c in docs.columns if c != "doc_id"), name="_toxicity")
    return scored.where(F.col("_toxicity") < threshold).select(*docs.columns)
