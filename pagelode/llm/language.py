"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds a bounded sample of labelled text. A document is cut into
the longest phrases that occur in the sample; the language that needs the fewest phrases per
character wins. The automata are tables of integers, so all documents of a batch walk them together.

Null texts and texts without a letter are ``und`` with score 0, also when nothing could be learned.
Equal phrase counts go to the first language in alphabetical order. Extra columns are ignored, and
repeated rows are each predicted.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pagelode.llm.words import pieces, text_array

#: Characters with a class of their own; the others share the classes after them.
OWN, SHARED = 63, 16
CLASSES = OWN + SHARED + 1
BLANK = 1
#: Longest stretch that is parsed at once; a phrase ends where a stretch ends.
STRETCH = 1024


def training_sample(labelled: DataFrame, texts: int = 64, chars: int = 384) -> list[tuple[str, str]]:
    """At most ``texts`` stretches of at most ``chars`` characters for each label.

    The documents are those with the smallest hashes of their ids; a stretch begins at a place that
    the same hash gives. The bound holds for any size of the corpus. A count finds the share of hashes
    to look at, so no language is sorted as a whole, and only ids are sorted, never texts.
    """
    order = F.xxhash64(F.col("doc_id")).bitwiseAND(F.lit((1 << 40) - 1))
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\S")).withColumn("h", order)
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each label
    if not sizes:
        return []
    share = labelled.sparkSession.createDataFrame(
        [(r.lang, int((1 << 40) * min(1.0, 3 * texts / r.n))) for r in sizes], "lang string, below long")
    near = usable.join(F.broadcast(share), "lang").where(F.col("h") <= F.col("below")).select("lang", "doc_id", "h")
    by = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = near.withColumn("r", F.row_number().over(by)).where(F.col("r") <= texts).select("lang", "doc_id").distinct()
    piece = F.substring(F.col("text"), (F.col("h") % F.greatest(F.length("text") - chars, F.lit(1)) + 1).cast("int"),
                        F.lit(chars))
    chosen = labelled.sparkSession.createDataFrame(ids.collect(), ids.schema)  # at most ``texts`` rows for each label
    sample = usable.join(F.broadcast(chosen), ["lang", "doc_id"]).select("lang", "h", piece.alias("piece"))
    return [(r.lang, r.piece) for r in sample.distinct().orderBy("lang", "h", "piece").collect()]


def is_letter(ch: str) -> bool:
    """Letters and the marks that belong to them."""
    return ch.isalpha() or unicodedata.category(ch)[0] == "M"


def automaton(symbols: list[int]) -> tuple[list[dict[int, int]], int]:
    """Transitions of the suffix automaton of a sequence, and the number of states."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = state
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    return moves, len(moves)


class LanguageModel:
    """Automata of all languages in one table of steps."""

    def __init__(self, sample: list[tuple[str, str]]):
        texts: dict[str, list[str]] = {}
        for lang, text in sample:
            texts.setdefault(lang, []).append(text.lower())
        self.langs = sorted(texts)
        seen = Counter("".join("".join(x) for x in texts.values()))
        own = sorted((ch for ch in seen if is_letter(ch)), key=lambda ch: (-seen[ch], ch))[:OWN - 1]
        # Code points of the first plane; those beyond it go by their lower 16 bits.
        self.classes = (OWN + 1 + np.arange(1 << 16) % SHARED).astype(np.uint8)
        self.classes[[not is_letter(chr(i)) for i in range(1 << 16)]] = BLANK
        for i, ch in enumerate(own, BLANK + 1):
            if ord(ch) < 1 << 16:
                self.classes[ord(ch)] = i
        tables, self.roots, base = [], [], 0
        for lang in self.langs:
            symbols = []
            for text in texts[lang]:
                symbols += [0, *self.encoded([text])[0].tolist()]  # 0 keeps stretches apart
            moves, n = automaton(symbols)
            # A step holds the place of the next state's row, and in its lowest bit whether a phrase began.
            root = np.full(CLASSES, base * CLASSES << 1 | 1, np.int64)
            for c, to in moves[0].items():
                if c:
                    root[c] = (base + to) * CLASSES << 1 | 1
            table = np.tile(root, (n, 1))
            for state in range(1, n):
                for c, to in moves[state].items():
                    if c:
                        table[state, c] = (base + to) * CLASSES << 1
            tables.append(table.astype(np.int32 if (base + n) * CLASSES << 1 < 1 << 31 else np.int64))
            self.roots.append(base * CLASSES)
            base += n
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The classes of all texts in one array, and how many each text has.

        A run of anything but letters counts as one blank, whatever it is made of.
        """
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbols = self.classes[points & 0xFFFF]
        blank = symbols == BLANK
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        keep[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        before = np.concatenate(([0], np.cumsum(keep)))
        ends = np.cumsum(sizes)
        return symbols[keep], before[ends] - before[ends - sizes]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by language and text, and the symbols of each text."""
        symbols, sizes = self.encoded(texts)
        begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        n = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(texts)), n)
        at = begins[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * STRETCH
        span = np.minimum(STRETCH, begins[owner] + sizes[owner] - at)
        order = np.argsort(-span, kind="stable")
        owner, at, span = owner[order], at[order], span[order]
        longest = int(span[0]) if len(span) else 0
        padded = np.concatenate((symbols, np.zeros(STRETCH, np.uint8)))
        steps = np.zeros((longest, len(span)), np.uint8)
        for j in range(0, len(span), 256):
            steps[:, j:j + 256] = padded[at[j:j + 256, None] + np.arange(longest)].T
        active = len(span) - np.searchsorted(span[::-1], np.arange(longest), side="right")
        value = np.repeat(np.array(self.roots, self.table.dtype)[:, None] << 1, len(span), axis=1)
        count = np.zeros_like(value)
        for t in range(longest):
            k = active[t]
            place = (value[:, :k] >> 1).astype(np.intp)
            place += steps[t, :k]
            value[:, :k] = step = self.table.take(place)
            count[:, :k] += step & 1
        # The first step leaves the root without the mark of a new phrase.
        total = np.zeros((len(self.langs), len(texts)), np.int64)
        for i in range(len(self.langs)):
            total[i] = np.bincount(owner, weights=count[i], minlength=len(texts))
        return total, sizes

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        lowered = [t.lower() for t in texts]
        lettered = np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        total, sizes = self.phrases(lowered)
        rate = total / np.maximum(sizes, 1)
        best = rate.argmin(axis=0)
        ranked = np.sort(rate, axis=0)
        second = ranked[1] if len(self.langs) > 1 else np.ones(len(texts))
        score = np.where(lettered, 1 - ranked[0] / np.maximum(second, 1e-9), 0.0).clip(0, 1)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, lettered)], score


def train_language_model(labelled: DataFrame, texts: int = 64, chars: int = 384) -> LanguageModel:
    """A model of the labelled rows (``doc_id``, ``text``, ``lang``); see ``training_sample`` for its bound."""
    return LanguageModel(training_sample(labelled, texts, chars))


def identify_languages(docs: DataFrame, model: LanguageModel, *keep: str) -> DataFrame:
    """``doc_id`` and the columns of ``keep``, with ``lang_pred`` and ``score`` of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in ("doc_id", *keep)] + [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    kept = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            langs, score = shared.value.predict(text_array(piece.column("text")).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(c) for c in kept), pa.array(langs, pa.string()), pa.array(score)],
                names=[*kept, "lang_pred", "score"])

    return docs.select(*kept, "text").mapInArrow(run, schema)
