"""Operators on training text, each against a plain version on small tables with the odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pagelode.llm import (
    decontaminate, jaccard, language, licenses, lines, mixing, ngram_exchange, ngram_model, pii, spotsigs, toxicity)
from pagelode.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, lines int, row int, block string"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALPHANUMERIC = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture
def docs(spark):
    """``docs(texts)``: a table with clashing extra columns; texts may be (id, text) pairs."""
    def make(texts, lang="en", source="a"):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, lang, source, 1, 2, "x") for i, t in rows], SCHEMA)
    return make


def prose(rng, n, words=None):
    words = words or [a + b for a in ("ka", "lo", "mi", "ru", "se", "to", "vu", "na") for b in ("n", "r", "st", "l", "ma", "pi")]
    return " ".join(rng.choice(words) for _ in range(n))


# --- 1 ---

def plain_components(rows):
    sets = {}
    for i, t in rows:
        w = SPACED.findall(low(t))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_similar_documents_match_brute_force(spark, docs):
    rng = random.Random(3)
    rows, n = [], 0
    for size in [3, 4, 5, 6, 7, 9, 12, 13, 14, 15, 18, 20, 40, 80, 300]:
        base = prose(rng, size).split()
        for edits in (0, 0, 1, 1, 2, 3, size // 20, size // 15, size // 8):
            w = list(base)
            for _ in range(edits):
                at = rng.randrange(len(w))
                kind = rng.random()
                w[at:at + 1] = [] if kind < 0.3 else [w[at], "new"] if kind < 0.6 else ["zz"]
            rows.append((n, " ".join(w)))
            n += 1
    shared = prose(rng, 30)
    rows += [(n + k, prose(rng, 20) + "\n" + shared) for k in range(25)]
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "ONE"), (905, "One two"), (906, "x" * 100_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs(rows)).collect()}
    assert got == plain_components(rows)
    kept = {r.doc_id for r in jaccard.without_similar(docs(rows)).collect()}
    assert kept == {i for i, (_, c) in got.items() if c == i}


@pytest.mark.parametrize("list_rows", [2, 3])
def test_similar_documents_of_lists_in_parts_match_brute_force(spark, docs, monkeypatch, list_rows):
    monkeypatch.setattr(jaccard, "LIST_ROWS", list_rows)
    rng = random.Random(14)
    rows = []
    for _ in range(40):
        base = prose(rng, 40)
        rows += [(len(rows) + k, base) for k in range(list_rows)] + [(len(rows) + list_rows, base + " other")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs(rows)).collect()}
    assert got == plain_components(rows)


def test_similar_documents_of_nothing_and_of_odd_rows(spark, docs):
    assert jaccard.similar_documents(docs([])).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (None, "q w e r t y u")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in
                 jaccard.similar_documents(docs(rows)).collect() if r.component_id is not None)
    assert got == [(False, 5, 5), (False, 5, 5), (False, 7, 5), (True, 0, 5)]


def near_group(rng, size, words, own):
    """Texts from one base, with a share of words of their own that makes them similar to it, or just not."""
    base = prose(rng, words).split()
    for i in range(size):
        w = list(base)
        for at in rng.sample(range(words), own(i)):
            w[at] = f"own{i}at{at}"
        yield " ".join(w)


def test_a_group_of_just_not_similar_texts_makes_few_candidates(spark, docs, monkeypatch):
    rng = random.Random(21)
    rows = list(enumerate(near_group(rng, 2_000, 300, lambda i: 10 + i % 6 if i % 20 else 3)))
    made = []

    def spied(ranked, light, real=jaccard._meetings):
        met = real(ranked, light, 64)
        made.append((met.count(), ranked.where("component <> main").select("node").distinct().count()))
        return met

    monkeypatch.setattr(jaccard, "_meetings", spied)
    got = {r.doc_id: r.component_id for r in jaccard.similar_documents(docs(rows)).collect()}
    assert len(got) == 2_000 and got[20] == 0
    (candidates, outsiders), = made
    assert outsiders > 500 and candidates < 40_000  # all pairs of outsiders with the group would be millions
    few = [r for r in rows if r[0] % 5 == 0]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs(few)).collect()}
    assert got == plain_components(few)


def test_ids_with_several_texts_and_links_through_null_ids(spark, docs):
    base = prose(random.Random(22), 60)
    a, b, c = base, " ".join(base.split()[4:] + ["x1", "x2", "x3", "x4"]), " ".join(base.split()[8:] + [f"x{i}" for i in range(1, 9)])
    other = prose(random.Random(23), 40)
    # a is linked to b and b to c, where only a row without an id has b.
    rows = [(4, a), (None, b), (9, c), (4, other), (12, other), (None, "")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.similar_documents(docs(rows)).collect())
    links = {frozenset((x, y)) for x in "abc" for y in "abc" if x < y}
    sets = {k: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} for k, w in (("a", a.split()), ("b", b.split()), ("c", c.split()))}
    near = {p for p in links if 5 * len(sets[min(p)] & sets[max(p)]) >= 4 * len(sets[min(p)] | sets[max(p)])}
    assert near == {frozenset("ab"), frozenset("bc")}
    assert got == [(0, 0, 0), (0, 56, 4), (4, 36, 4), (4, 56, 4), (9, 56, 4), (12, 36, 4)]


def test_components_of_paths_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200, 202: 200}


def test_light_boundary_weighs_subsets_against_lists():
    import numpy as np
    even, long = np.full(1 << 10, 50), np.full(1 << 10, 50)
    long[:20] = 100_000
    assert jaccard.light_boundary({12: 1000}, even) < 12
    assert jaccard.light_boundary({9: 1000, 12: 1000}, long) >= 9
    assert jaccard.subset_sizes(9, 12) == [8, 9, 10] or jaccard.subset_sizes(9, 12) == [8, 9]


# --- 2 ---

def plain_contamination(rows, items):
    windows = {}
    for i, t in items:
        w = ALPHANUMERIC.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add(str(i))
    out = {}
    for d, t in rows:
        w, hit, names = ALPHANUMERIC.findall(low(t)), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    hit.update(range(k, k + size))
                    names |= windows[tuple(w[k:k + size])]
        out[d] = (len(w), len(hit), sorted(names))
    return out


def test_contamination_matches_brute_force(spark, docs):
    rng = random.Random(5)
    few = ["ab", "cd", "ef"]
    items = [(0, prose(rng, 40)), (1, prose(rng, 10)), (2, prose(rng, 9)), (3, "Short One"), (4, "word"), (5, None), (6, ""),
             (7, prose(rng, 30, few)), (10, prose(rng, 25)), (11, "ÉTÉ " + prose(rng, 12))]
    texts = {i: t for i, t in items}
    rows = [(0, prose(rng, 30) + " " + texts[0] + " " + prose(rng, 5)), (1, texts[1].upper()), (2, "x " + texts[2]),
            (3, "a short-one, b"), (4, None), (5, ""), (6, prose(rng, 60, few)), (7, texts[0][5:]), (8, texts[10] + "!" + texts[10]),
            (9, texts[11].lower()), (10, texts[11]), (11, " ".join(texts[0].split()[3:12])),
            (12, " ".join(texts[0].split()[3:13])), (13, "ab " * 500), (14, prose(rng, 3000))]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, row string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in
           decontaminate.contamination(docs(rows), benchmark).collect()}
    want = plain_contamination(rows, items)
    assert got == want
    clean = {r.doc_id for r in decontaminate.without_benchmark(docs(rows), benchmark).collect()}
    assert clean == {d for d, v in want.items() if not v[1]}
    assert decontaminate.contamination(docs([]), benchmark).count() == 0
    none = benchmark.where("false")
    assert all(r.n_hit == 0 for r in decontaminate.contamination(docs(rows), none).collect())


def test_repetitive_texts_meet_each_item_once_a_place(spark, docs):
    text, item = " ".join(["ko"] * 3000), " ".join(["ko"] * 2000)
    words = decontaminate.words_of("text").alias("words")
    texts = docs([text]).select(F.lit(1).alias("row"), words)
    items = spark.createDataFrame([(7, item)], "item long, text string").select("item", words, F.size(words).alias("n"))
    assert decontaminate.window_matches(texts, items, [decontaminate.SPAN]).count() == 3000 - 9
    benchmark = spark.createDataFrame([(7, item), (8, "ko lu"), (9, "ko ko ko"), (10, "")], "item_id long, text string")
    found = decontaminate.contamination(docs([text, text + " lu", "ko ko", None]), benchmark).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found) == [
        (0, 3000, 3000, ("7", "9")), (1, 3001, 3001, ("7", "8", "9")), (2, 2, 0, ()), (3, 0, 0, ())]


def test_windows_of_every_length_have_hashes_of_their_own(spark, docs):
    rng = random.Random(5)
    made = docs([prose(rng, 40, ["a", "b"]), "a b", ""]).select("doc_id", decontaminate.words_of("text").alias("words"))
    lengths = list(range(1, 11))
    rows = decontaminate.window_places(made, lengths, "doc_id", "words").where(F.col("g").isNotNull()).collect()
    assert len(rows) == sum(max(0, m - n + 1) for m in (40, 2) for n in lengths)
    texts = {}
    for r in rows:
        texts.setdefault((r.n, r.g), set()).add(tuple(r.words[r["at"]:r["at"] + r.n]))
    assert all(len(t) == 1 and len(next(iter(t))) == n for (n, _), t in texts.items())
    assert len({t for s in texts.values() for t in s}) == len(texts)


# --- 3 ---

def test_recurring_lines_go_from_all_but_the_first(spark, docs):
    rng = random.Random(7)
    passage = prose(rng, 60)
    one, two, three = (prose(rng, 12) for _ in range(3))
    changed = two.split()
    changed[4] = "other"
    rows = [(3, f"{one}\n{passage}\nshort"), (1, f"{passage}\n{two}"), (2, f"{' '.join(changed)}\nshort\n\n{three}"),
            (4, "Order number 17 was sent today\n" + prose(rng, 12)), (5, "Order number 99 was sent today"),
            (6, f"{one[:-1]}x {prose(rng, 5)}\nsame line here twice\nsame line here twice"), (7, None), (8, ""),
            (9, "12 34 56 78"), (10, "98 76 54 32")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.drop_recurring_lines(docs(rows), counts=True).collect()}
    texts = dict(rows)
    assert got[1] == (texts[1], 2, 0)
    assert got[2] == (f"short\n\n{three}", 4, 1)          # its first line differs from doc 1's in one field
    assert got[3] == (f"{one}\nshort", 3, 1)
    assert got[4] == (texts[4], 2, 0)
    assert got[5] == ("", 1, 1)                           # numbers are variable
    assert got[6][0] == texts[6] and got[9][0] == texts[9] and got[10][0] == texts[10]
    assert got[7] == (None, 0, 0) and got[8] == ("", 1, 0)
    kept = {r.doc_id for r in lines.drop_recurring_lines(docs(rows), drop_emptied=True).collect()}
    assert kept == set(texts) - {5}
    assert lines.drop_recurring_lines(docs([])).count() == 0
    assert lines.drop_recurring_lines(docs(rows)).columns == docs([]).columns


# --- 4 ---

def toxic_corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        text = prose(rng, rng.randint(5, 150)).split()
        bad = rng.random() < 0.4
        if bad:
            for _ in range(rng.randint(1, 2)):
                text.insert(rng.randrange(len(text)), rng.choice(["grumbo", "zwick" + rng.choice("abcdefgh") + rng.choice("xyz")]))
        rows.append((" ".join(text), int(bad)))
    return rows


def test_toxicity_finds_held_out_words(spark, docs):
    train, test = toxic_corpus(500, 1), toxic_corpus(200, 2)
    model = toxicity.fit([t for t, _ in train], [y for _, y in train], 0.4)
    rows = [t for t, _ in test] + [None, "", "a" * 50_000, prose(random.Random(1), 20_000)]
    got = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(docs(rows), model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    right = sum((got[i] >= 0.5) == bool(y) for i, (_, y) in enumerate(test))
    assert right >= 0.9 * len(test)
    clean = toxicity.without_toxic(docs(rows), model)
    assert clean.columns == docs([]).columns and {r.doc_id for r in clean.collect()} == {i for i, s in got.items() if s < 0.5}
    assert toxicity.score_toxicity(docs([]), model).count() == 0


def plain_encoding(params, name, inputs):
    """The pooled states of one sequence, a direction at a time; ``inputs[d]``: what its steps add to the gates."""
    import numpy as np
    out = []
    for d in (0, 1):
        U, A, v = (params[f"{name}.{k}"][d].astype(np.float64) for k in "UAv")
        H = len(U)
        h, states = np.zeros(H), []
        for g in inputs[d] if d == 0 else inputs[d][::-1]:
            z = 1 / (1 + np.exp(-(g[:H] + h @ U[:, :H])))
            r = 1 / (1 + np.exp(-(g[H:2 * H] + h @ U[:, H:2 * H])))
            n = np.tanh(g[2 * H:] + r * (h @ U[:, 2 * H:]))
            h = (1 - z) * n + z * h
            states.append(h)
        e = np.exp([float((np.tanh(s @ A) * v).sum()) for s in states])
        out.append(sum(w * s for w, s in zip(e / e.sum(), states)))
    return np.concatenate(out)


def test_toxicity_logits_agree_with_a_plain_forward_pass():
    import numpy as np
    model = toxicity.fit(*zip(*toxic_corpus(60, 3)), 0.4, rounds=1)
    words = toxicity.words_of_all(["ab", "some words of a text " * 40, "", "x" * 15 + " yz"])
    doc, first, logits = model.largest_logits(words)
    assert set(doc.tolist()) == {0, 1, 3} and len(doc) > 3
    letters, lengths = toxicity.spelled(words, np.arange(len(words.starts)))
    slots, p = toxicity.slots_of(words.hashes), model.params
    begin, ends = words.offsets[:-1], words.offsets[1:]
    for d, f, logit in zip(doc, first, logits):
        inputs = []
        for w in range(begin[d] + f, min(begin[d] + f + toxicity.WINDOW, ends[d])):
            spelt = letters[w, :lengths[w]]
            chars = plain_encoding(p, "char", [p["char.in"][way][spelt].astype(np.float64) for way in (0, 1)])
            x = np.concatenate((chars, p["word.emb"][slots[w]]))
            inputs.append((x @ p["word.in"] + p["word.b"]).reshape(2, -1))
        pooled = plain_encoding(p, "word", [[i[way] for i in inputs] for way in (0, 1)])
        assert abs(float(pooled @ p["out.w"] + p["out.b"].item()) - float(logit)) < 1e-3


def test_toxicity_gradients_agree_with_differences():
    import numpy as np
    rng = np.random.default_rng(1)
    params = {k: v.astype(np.float64) for k, v in toxicity.Encoder.created(rng, "e", 3).items()}
    x = rng.normal(size=(4, 2, 5, 9))
    valid = np.arange(4)[:, None] < np.array([4, 4, 3, 2, 1])
    out = rng.normal(size=(2, 5, 3))

    def loss():
        return float((toxicity.Encoder(params, "e").forward(lambda t: x[t], valid, True)[0] * out).sum())
    encoder = toxicity.Encoder(params, "e")
    grads, d_x = encoder.backward(encoder.forward(lambda t: x[t], valid, True)[1], out)
    for array, grad in [(params[k], grads[k]) for k in params] + [(x, d_x)]:
        for at in [tuple(rng.integers(0, s) for s in array.shape) for _ in range(6)]:
            keep, step = array[at], 1e-3
            array[at] = keep + step
            up = loss()
            array[at] = keep - step
            down = loss()
            array[at] = keep
            assert abs((up - down) / (2 * step) - grad[at]) < 2e-2


def test_toxicity_without_both_labels(spark, docs):
    labels = spark.createDataFrame([(0, 0), (1, 0)], "doc_id long, toxic int")
    model = toxicity.train_toxicity_model(docs(["a b", "c d"]), labels)
    assert [r.toxicity for r in toxicity.score_toxicity(docs(["x", None]), model).collect()] == [0.0, 0.0]
    assert toxicity.train_toxicity_model(docs([]), labels.where("false")).prior == 0.0


# --- 5 ---

def test_pfair_keeps_every_source_within_one_block():
    weights = {"a": 5.0, "b": 3.0, "c": 1.0, "d": 0.4, None: 0.1}
    slots = mixing.shares(weights, 997)
    table = list(mixing.period(slots))
    assert sorted(s for _, _, s in table) == list(range(997)) and sum(slots.values()) == 997
    seen = Counter()
    for source, _, slot in sorted(table, key=lambda r: r[2]):
        seen[source] += 1
        for s, n in slots.items():
            assert abs(seen[s] - n * (slot + 1) / 997) < 1


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_stored_schedules_are_the_same(spark, docs, monkeypatch, chunk):
    rows = [(i, f"t{i}", "en", ("a", "b", None)[i % 7 % 3], 1, 2, "x") for i in range(120)]
    table, weights = spark.createDataFrame(rows, SCHEMA), {"a": 0.1234567890123, "b": 0.7}
    want = sorted(map(tuple, mixing.mix_sources(table, weights, block_rows=4).select("doc_id", "slot", "position", "balanced").collect()))
    made = mixing.schedule_table
    monkeypatch.setattr(mixing, "schedule_table", lambda *a: made(*a, chunk=chunk))
    got = mixing.mix_sources(table, weights, block_rows=4)
    assert sorted(map(tuple, got.select("doc_id", "slot", "position", "balanced").collect())) == want and len(want) == 120


def test_mix_places_every_row_once(spark, docs):
    rng = random.Random(2)
    rows = [(i, f"t{i}", "en", rng.choice("aaaab") if i % 9 else None, 1, 2, "x") for i in range(700)] + [(3, "t3", "en", "a", 1, 2, "x")]
    table = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_sources(table, {"a": 2.0}, block_rows=4, slots=10).collect()
    assert len(got) == len(rows) and len({r.position for r in got}) == len(rows)
    for source in ("a", "b", None):
        own = sorted((r for r in got if r.source == source), key=lambda r: r.position)
        keys = [hashlib.md5(str(r.doc_id).encode()).hexdigest() for r in own]
        assert keys == sorted(keys) and [r.block for r in own] == [i // 4 for i in range(len(own))]
    pattern = {(s, t): slot for s, t, slot in mixing.period(mixing.shares({"a": 2.0, "b": 1.0, None: 1.0}, 10))}
    per = Counter(s for s, _ in pattern)
    assert all(r.slot == r.block // per[r.source] * 10 + pattern[r.source, r.block % per[r.source]] for r in got)
    full = {r.slot for r in got if r.balanced}
    assert full == set(range(max(full) + 1))
    assert mixing.mix_sources(docs([])).count() == 0


@pytest.mark.parametrize("weights", [
    {"a": 100.0} | {f"s{i}": 1.0 for i in range(300)}, {"a": 0.1234567890123457, "b": 0.7, None: 1.0}])
def test_mix_keeps_the_target_weights(spark, weights):
    sources = ["a"] * 400 + [s for s in weights if s != "a"]
    table = spark.createDataFrame([(i, "t", "en", s, 1, 2, "x") for i, s in enumerate(sources)], SCHEMA)
    total = sum(Fraction(str(w)) for w in weights.values())
    got = mixing.mix_sources(table, weights, block_rows=1).collect()
    assert len(got) == len({r.slot for r in got}) == len(sources)
    for r in got:
        one = total / Fraction(str(weights[r.source]))
        assert math.floor(r.block * one) <= r.slot < math.ceil((r.block + 1) * one)
    taken = {r.slot for r in got}
    assert {r.slot for r in got if r.balanced} == set(range(min(set(range(len(got) + 1)) - taken)))


# --- 6 ---

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def test_base_spans_match_brute_force(spark, docs):
    odd = ["a@b.c_d@e.f.g a@b a@@b.c .@-.-", "1.2.3.4.5.6 999.1.1.1 0001.2.3.255 1.2.3", "+1 (507) 555-0453 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
           "4077922580886963 4830511256655766 4111 1111 1111 1111 4111-1111-1111-1111 1 2 3", "é😀 4077922580886963 x😀a@b.co", None, "",
           "1" * 30_000, "a" * 100_000 + "@b.c", "1." * 20_000, "+" + "1 " * 20_000, "a@b" + ".c" * 20_000, "1 " * 20_000 + "4077922580886963"]
    rng = random.Random(4)
    odd += ["".join(rng.choice("0123456789.+-@ ab()") for _ in range(60)) for _ in range(300)]
    got = {r.doc_id: r.base for r in pii.personal_data(docs(odd).withColumn("text", F.col("text")), sample_rows=200)
           .withColumn("base", pii.listed("base")).collect()}
    for i, t in enumerate(odd):
        spans = [(k, m.start(), m.end()) for k, p in PATTERNS.items() if len(t or "") < 25_000
                 for m in re.finditer(p, t or "") if plain_passes(k, m[0])]
        if len(t or "") < 25_000:
            assert got[i] == ",".join("%s:%d:%d" % s for s in spans), (t or "")[:80]
    assert pii.personal_data(docs([])).count() == 0


def test_trees_add_spans_and_redaction_masks_them(spark, docs):
    rng = random.Random(6)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(32))
    texts = [f"{prose(rng, 5)} token = {key()} {prose(rng, 4)} mail x{i}@y.org" for i in range(150)]
    texts += [prose(rng, 9) + f" supercalifragilistic{i} words" for i in range(80)]
    found = {r.doc_id: r.spans for r in pii.personal_data(docs(texts)).collect()}
    secrets = sum(any(s.kind == "secret" for s in v) for v in found.values())
    assert secrets >= 140 and all(any(s.kind == "email" for s in found[i]) for i in range(150))
    masked = {r.doc_id: r.text for r in pii.redacted(docs(texts[:2] + ["no data"] + [None])).collect()}
    assert masked[2] == "no data" and masked[3] is None and masked[0].endswith("mail [email]")


def test_redaction_masks_every_row_with_its_own_spans(spark):
    rows = [(None, "write c@d.org"), (1, "longer@example.org here"), (1, "no data"), (1, "longer@example.org here"), (None, "x y"),
            (2, "ask 10.0.0.1 or a@b.co"), (3, None)]
    table = spark.createDataFrame([(i, t, "spans", "row", "own") for i, t in rows], "doc_id long, text string, spans string, row string, own string")
    got = pii.redacted(table)
    assert got.columns == table.columns
    assert sorted(((r.doc_id or 0, r.text or "") for r in got.collect())) == sorted([
        (0, "write [email]"), (1, "[email] here"), (1, "no data"), (1, "[email] here"), (0, "x y"), (2, "ask [ip] or [email]"), (3, "")])
    assert {(r.spans, r.row, r.own) for r in got.collect()} == {("spans", "row", "own")}


def test_overlaps_of_candidates_match_brute_force(spark):
    rng = random.Random(31)
    kinds = list(pii.GENERATORS)
    loose = [(r, rng.choice(kinds), a, a + rng.randrange(1, 9), "m", "l") for r in range(20) for a in rng.sample(range(80), 15)]
    strict = [(r, "email", a, a + rng.randrange(1, 12)) for r in range(20) for a in rng.sample(range(80), rng.randrange(8))]
    spans = spark.createDataFrame(loose, "row long, kind string, start long, end long, match string, left string")
    base = spark.createDataFrame(strict, "row long, kind string, start long, end long")
    got = {(r.row, r.kind, r.start, r.end): r.crossed for r in pii.candidates_of(spans, base).collect()}
    assert len(got) == len(set(loose)) and got == {
        (r, k, a, b): any(q == r and s < b and e > a for q, _, s, e in strict) for r, k, a, b, _, _ in loose}


def test_thresholds_without_both_labels(spark, docs):
    assert all(not r.spans for r in pii.personal_data(docs(["number 123456789012 only", "serial 99887766554433"])).collect())


def test_text_ids_and_clashing_columns(spark):
    names = ["_row", "_cut", "_lines", "row", "lines", "own", "_key", "_i", "_part", "_own", "_text", "_h", "_d", "_r", "block"]
    texts = ["the same line of words here\nand one of its own a", "the same line of words here\nand another of its own b", None, ""]
    table = spark.createDataFrame([(i, t, "s", *names) for i, t in zip(["b", "a", None, "c"], texts)],
                                  "doc_id string, text string, source string, " + ", ".join(f"{n} string" for n in names))
    lines_out = lines.drop_recurring_lines(table, counts=True).collect()
    assert sorted(r.n_dropped for r in lines_out) == [0, 0, 0, 1] and all(r[n] == n for r in lines_out for n in names)
    mixed = mixing.mix_sources(table, {})
    assert mixed.count() == 4 and all(r[n] == n for r in mixed.collect() for n in names if n != "block")
    near = {r.doc_id: r.edited for r in spotsigs.fingerprints(table).collect()}
    order = [("", None), (texts[1], "a"), (texts[0], "b"), ("", "c")]
    for k, (t, i) in enumerate(order):
        half = len(t) // 2
        assert near[i] == t[:len(t) - half] + order[(k + 1) % 4][0][:half]


def test_fingerprints_tell_different_sets_apart(spark, docs):
    rng = random.Random(32)
    texts = [" ".join(f"the {rng.choice('abcdefgh')}{rng.randrange(99)} word{j}" for j in range(300)) for _ in range(20)]
    found = spotsigs.fingerprints(docs(texts + texts[:3])).collect()
    assert len({r.fingerprint for r in found}) == 20


# --- 7 ---

def test_edited_texts_and_neighbours(spark, docs):
    rng = random.Random(8)
    rows = [(i * 7 % 101, prose(rng, rng.randint(0, 60)) + " é😀 the end of it") for i in range(101)]
    rows[5] = (rows[5][0], None)
    rows[6] = (rows[6][0], "")
    got = {r.doc_id: r for r in spotsigs.fingerprints(docs(rows)).collect()}
    order = sorted(rows)
    for k, (d, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        assert got[d].n_chars == len(t) and got[d].edited == t[:len(t) - half] + following[:half]
    assert spotsigs.fingerprints(docs([])).count() == 0
    one = spotsigs.fingerprints(docs(["the cat of the old house"])).first()
    assert one.near_next == 1.0 and one.edited == "the cat of t" * 2


def test_signatures_match_a_plain_version(spark, docs):
    rng = random.Random(9)
    words = ["the", "of", "und", "Und", "la"] + ["w%d" % i for i in range(40)]
    texts = [prose(rng, n, words) for n in (0, 1, 2, 3, 10, 50, 400)] + ["the of la", "zzz yyy"]

    def plain(text):
        w = ALPHANUMERIC.findall(low(text))
        found = set()
        for i, a in enumerate(w):
            rest = [x for x in w[i + 1:] if x not in spotsigs.ANCHORS][:2]
            if a in spotsigs.ANCHORS and len(rest) == 2:
                found.add((a, *rest))
        return max(1, len(found))
    rows = spotsigs.with_sets(docs(texts), "text", "f").select("text", F.size("f").alias("n")).collect()
    assert all(r.n == plain(r.text) for r in rows)
    same = spotsigs.fingerprints(docs([texts[5], texts[5], texts[6], None])).orderBy("doc_id").collect()
    assert same[0].fingerprint == same[1].fingerprint and same[0].near_next == 1.0 and same[1].near_next < 0.2


def test_likeness_of_large_and_of_unequal_sets_is_exact(spark, docs):
    rng = random.Random(16)
    words = ["the", "of", "und", "la"] + ["w%d" % i for i in range(60)]
    texts = [prose(rng, n, words) for n in (3_000, 3_000, 40)]
    texts += [texts[0] + " the only1 here", texts[2] + " of only2 there " + texts[0], "the w1 w2"]

    def plain(text):
        w = ALPHANUMERIC.findall(low(text))
        chains = ((a, *[x for x in w[i + 1:i + 60] if x not in spotsigs.ANCHORS][:2]) for i, a in enumerate(w))
        return {c for c in chains if c[0] in spotsigs.ANCHORS and len(c) == 3}
    got = {r.doc_id: r for r in spotsigs.fingerprints(docs(texts)).collect()}
    for i, t in enumerate(texts):
        for value, other in ((got[i].near_edited, got[i].edited), (got[i].near_next, texts[(i + 1) % len(texts)])):
            a, b = plain(t), plain(other)
            assert math.isclose(value, len(a & b) / len(a | b), abs_tol=1e-12)
    assert len(plain(texts[0])) > 128 and any(0 < r.near_next < 0.05 for r in got.values())


# --- 8 ---

def test_licence_phrases_and_chains(spark, docs):
    texts = ["x This work is licensed under the GNU General Public License, version 3. y", "cc by cc-by CC_BY", None, "", "mit\nlicense",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files (the \"Software\"), to deal in the Software without restriction", "the of and a general public",
             "gnu general public", "a" * 50_000]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs(texts)).collect()}
    for i, t in enumerate(texts):
        w = ALPHANUMERIC.findall(low(t))
        places = sorted((k, label) for phrase, label in licenses.PHRASES for k in range(len(w))
                        if w[k:k + len(phrase.split())] == phrase.split())
        assert got[i].n_words == len(w) and sorted((p.first_word, p.label) for p in got[i].base_places) == places
    assert {s.label for s in got[0].spans} == {"gpl-3.0"} and {s.label for s in got[5].spans} == {"mit"}
    assert not got[6].spans and not got[7].spans
    assert licenses.scan_licenses(docs([])).count() == 0


def plain_runs(text, template, least):
    """All (first, length, ends) of runs common to both that no neighbour extends, by trying every place."""
    longest = [max(n for n in range(i + 2) if n == 0 or any(
        template[k:k + n] == text[i + 1 - n:i + 1] for k in range(len(template) - n + 1))) for i in range(len(text))]
    return [(i + 1 - n, n, [k + n - 1 for k in range(len(template) - n + 1) if template[k:k + n] == text[i + 1 - n:i + 1]])
            for i, n in enumerate(longest) if n >= least and (i + 1 == len(text) or longest[i + 1] <= n)]


def test_automaton_gives_matching_statistics():
    rng = random.Random(10)
    templates = [("t%d" % k, prose(rng, 14, list("abcd"))) for k in range(3)] + [("same", "a b c d a b c d a b c d")]
    automaton = licenses.LicenseAutomaton(templates)
    text = prose(rng, 200, list("abcde")).split() + "a b c d a b c d".split()
    got = {t: [] for t in range(len(templates))}
    for t, at, n, ends in automaton.runs(text, 0, 3):
        got[t].append((at, n, ends))
    for t, (_, template) in enumerate(templates):
        assert got[t] == plain_runs(text, template.split(), 3)


def test_licence_chains_take_the_best_predecessor():
    def best_of_all(nodes, gap):
        """Most words that any chain of nodes covers, by trying all of them."""
        def longest(i):
            at, end, place = nodes[i]
            ways = [end - at]
            for j in range(i):
                cut = max(0, nodes[j][1] - at, nodes[j][2] - (place - end + at))
                if nodes[j][1] >= at - gap and cut < end - at and at + cut - nodes[j][1] <= gap:
                    ways.append(longest(j) + end - at - cut)
            return max(ways)
        return max(map(longest, range(len(nodes))))

    rng = random.Random(12)
    template = prose(rng, 40, list("abcdef"))
    automaton = licenses.LicenseAutomaton([("t", template)])
    for _ in range(60):
        words = [rng.choice("abcdef") if rng.random() < 0.2 else w for w in template.split()]
        nodes = [(at, at + n, end + 1) for _, at, n, ends in automaton.runs(words, 0, 3) for end in ends]
        if nodes:
            chains = licenses._best_chains(nodes, 8, 1)
            assert max(c for _, _, c in chains) == best_of_all(nodes, 8)
            assert all(a[1] <= b[0] for a, b in zip(chains, chains[1:]))
    # A run of another place in between does not end a chain.
    middle = licenses.LicenseAutomaton([("x", "k l m n o p q r s t u v")])
    runs = list(middle.runs("k l m n z s t u z o p q r s t u v".split(), 0, 3))
    assert middle.chains(runs, 8, 0.75) == [("x", 0, 17, 1.0)]


def test_whole_licence_texts_and_templates_of_a_table(spark, docs):
    filler = "Copyright 2020 by somebody or other, who wrote all of this by hand. " * 3
    named = {t: licenses.TEMPLATES[t][1] for t in range(13)}
    texts = [filler + text + " " + filler for text in named.values()]
    texts += [" ".join([licenses.MIT, licenses.MIT]), licenses.MIT[:600], licenses.BSD_CONDITIONS[:160], licenses.MIT.replace(
        "Software", "Program")]
    got = {r.doc_id: r.spans for r in licenses.scan_licenses(docs(texts)).collect()}
    for t in named:
        assert {s.label for s in got[t]} == {licenses.TEMPLATES[t][0]} and max(s.share for s in got[t]) == 1.0
    n = len(licenses.template_words(licenses.MIT))
    assert [(s.label, s.first_word, s.end_word) for s in got[13]] == [("mit", 0, n), ("mit", n, 2 * n)]
    assert {s.label for s in got[14]} == {"mit"} and {s.label for s in got[15]} == {"bsd"} and {s.label for s in got[16]} == {"mit"}

    table = spark.createDataFrame([("own", "alpha beta gamma delta", 1), ("own", "alpha beta gamma delta", 2), (None, "x y z", 3),
                                   ("no", None, 4)], "label string, text string, extra int")
    assert licenses.read_templates(table) == (("own", "alpha beta gamma delta"),)
    [row] = licenses.scan_licenses(docs(["so ALPHA beta, gamma delta."]), table).collect()
    assert [(s.label, s.first_word, s.end_word, s.share) for s in row.spans] == [("own", 1, 5, 1.0)]
    [none] = licenses.scan_licenses(docs(["alpha beta gamma"]), table.where("false")).collect()
    assert none.spans == []
    with pytest.raises(ValueError):
        licenses.read_templates(table, most_chars=10)


# --- 9 ---

def test_languages_by_fewest_phrases(spark, docs):
    rng = random.Random(11)
    sounds = {"aa": ["kalo", "mira", "seto"], "bb": ["schtu", "pfen", "gluh"], "cc": ["ñoé", "çaí", "üla"]}
    rows = [(f"{lang}", prose(rng, 60, [w + v for w in ws for v in ws])) for lang, ws in sounds.items() for _ in range(30)]
    table = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.train_language_model(table.where("doc_id % 3 != 0"))
    assert model.langs == ["aa", "bb", "cc"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify_languages(table, model).collect()}
    assert sum(got[i][0] == lang for i, (lang, _) in enumerate(rows)) >= 0.97 * len(rows)
    odd = language.identify_languages(docs([None, "", "12 - 34 !", "schtupfen " * 30_000]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in odd] == ["und", "und", "und", "bb"] and all(0 <= r.score <= 1 for r in odd)
    empty = language.train_language_model(table.where("false"))
    assert {r.lang_pred for r in language.identify_languages(docs(["abc"]), empty).collect()} == {"und"}
    assert language.identify_languages(docs([]), model).count() == 0


def test_all_labels_are_learned_and_wide_steps_change_nothing(spark):
    table = spark.createDataFrame([(i, f"ab{i} cd", f"l{i}") for i in range(520)], "doc_id long, text string, lang string")
    assert {lang for lang, _ in language.training_sample(table)} == {f"l{i}" for i in range(520)}
    model = language.LanguageModel([("x", "the cat and the dog"), ("y", "le chat et le chien")])
    texts = ["the dog", "le chien et", "", "zz top"]
    want = model.predict(texts)
    model.table = model.table.astype("int64")
    got = model.predict(texts)
    assert got[0] == want[0] == ["x", "y", "und", got[0][3]] and (got[1] == want[1]).all()


def test_phrases_are_the_longest_in_the_sample():
    sample = "the cat sat on the mat and the dog sat on the cat"
    model = language.LanguageModel([("x", sample)])
    symbols = model.encoded([sample])[0].tolist()
    rng = random.Random(12)
    text = prose(rng, 30, ["the", "cat", "mat", "dogs", "xat"])
    code = model.encoded([text])[0].tolist()
    inside = lambda run: any(symbols[k:k + len(run)] == run for k in range(len(symbols)))
    want, start = 0, 0
    for end in range(1, len(code) + 1):
        if not inside(code[start:end]):
            want += 1 if end - 1 > start or not inside(code[end - 1:end]) else 0
            start = end - 1 if inside(code[end - 1:end]) else end
    total = model.phrases([text])[0][0][0]
    assert abs(total - want) <= 1 + sum(not inside([c]) for c in code)


# --- 10 ---

def test_base_scores_and_probabilities(spark, docs):
    rng = random.Random(13)
    texts = [prose(rng, rng.randint(0, 80)) + (" rare%d" % i if i % 4 == 0 else "") for i in range(120)] + [None, "", "Unseen"]
    table = docs(texts).unionByName(docs([(5, texts[5])]))
    training = table.where("doc_id < 90")
    counts = Counter()
    for i, t in list(enumerate(texts))[:90] + [(5, texts[5])]:
        counts.update(SPACED.findall(low(t)) + ["\0"])
    n, v = sum(counts.values()), len(counts)
    model, vocabulary = ngram_model.train_language_scores(training, F.col("doc_id") % 3 == 0, common_share=0.004, ngram_share=0.004)
    assert (model.tokens, model.distinct) == (n, v) and len(model.common) < v
    rows = ngram_model.score_texts(table, model, vocabulary).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        w = SPACED.findall(low(texts[r.doc_id])) + ["\0"]
        assert r.n_tokens == len(w) and r.n_known == sum(x in counts for x in w)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r.score < 0
    assert abs(model.weights.sum(1) - 1).max() < 1e-9
    # What can follow a context has probability 1 in all: every known word, and one place for all unknown ones.
    for context in ("", "kan", "kan lor"):
        words = [w for w in counts if w != "\0"]
        probe = docs([(i, f"{context} {w}".strip()) for i, w in enumerate(words)] + [(-1, context), (-2, f"{context} unknown".strip())])
        scored = {r.doc_id: r.score for r in ngram_model.score_texts(probe, model, vocabulary).collect()}
        ends = {}
        for tail, key in [(w, i) for i, w in enumerate(words)] + [("unknown", -2)]:
            ends[key] = scored[key] - _end_of(ngram_model, model, vocabulary, f"{context} {tail}".strip())
        before = scored[-1] - _end_of(ngram_model, model, vocabulary, context)
        total = sum(10 ** (p - before) for p in ends.values()) + 10 ** (scored[-1] - before)
        assert math.isclose(total, 1, rel_tol=1e-6)


def _end_of(lm, model, vocabulary, text):
    """Log probability of the end after a text."""
    import numpy as np
    import pyarrow as pa
    tokens, offsets = lm.tokens_of(pa.array([text]))
    bucket, (c3, c2, c1), (s3, s2) = model.events(tokens, offsets)
    w = model.weights[bucket[-1]]
    p = (w[0] * c3[-1] / max(s3[-1], 1) + w[1] * c2[-1] / max(s2[-1], 1) + w[2] * c1[-1] / model.tokens
         + w[3] / (model.distinct + 1))
    return float(np.log10(p))


def test_language_scores_without_training(spark, docs):
    table = docs(["a b", None])
    model, vocabulary = ngram_model.train_language_scores(table.where("false"), F.lit(True))
    got = {r.doc_id: r for r in ngram_model.score_texts(table, model, vocabulary).collect()}
    assert got[0].n_tokens == 3 and got[0].n_known == 0 and got[0].base_score == 0 and got[0].score == 0
    assert ngram_model.score_texts(docs([]), model, vocabulary).count() == 0


def test_all_pairs_and_triples_are_in_the_model(spark, docs, monkeypatch):
    monkeypatch.setattr(ngram_model, "PART_BYTES", 2_000)
    rng = random.Random(15)
    # Every word of the last texts is one in far more than 100,000 tokens.
    texts = [prose(rng, 4_000) for _ in range(60)] + [f"unique{i} pair{i} triple{i} once{i}" for i in range(20)] + [None, "new words"]
    table = docs(texts).unionByName(docs([(3, texts[3])])).repartition(3)
    training = table.where("doc_id < 70")
    model, counts = ngram_model.train_language_scores(training, F.col("doc_id") % 2 == 0)
    grams, total = [Counter(), Counter(), Counter()], 0
    for t in texts[:70] + [texts[3]]:
        w = SPACED.findall(low(t)) + ["\0"]
        total += len(w)
        grams[0].update(w)
        grams[1].update(zip(["\1", *w], w))
        grams[2].update(zip(["\1", *w], w, w[1:]))
    assert model.tokens == total > 200_000 and counts.count() == sum(map(len, grams))
    assert counts.agg(F.sum("n")).first()[0] == sum(sum(g.values()) for g in grams)
    got = ngram_model.score_texts(table, model, counts).collect()
    assert len(got) == len(texts) + 1

    def expected(t):
        w, out = SPACED.findall(low(t)) + ["\0"], 0.0
        for i, x in enumerate(w):
            v = w[i - 1] if i else "\1"
            seen2 = grams[0][v] if i else grams[0]["\0"]
            pair = (w[i - 2] if i > 1 else "\1", v)
            seen3 = grams[1][pair] if i else 0
            level = lambda n: 1 + min(14, int(math.log2(n)) // 2) if n else 0
            a = model.weights[16 * level(seen3) + level(seen2)]
            out += math.log10(a[0] * (grams[2][(*pair, x)] if i else 0) / max(1, seen3) + a[1] * grams[1][v, x] / max(1, seen2)
                              + a[2] * grams[0][x] / total + a[3] / (len(grams[0]) + 1))
        return out
    assert all(math.isclose(r.score, expected(texts[r.doc_id]), rel_tol=1e-9) for r in got)


@pytest.mark.parametrize("part_bytes", [700, 1 << 24])
def test_exchanged_counts_give_the_scores_of_the_table_of_counts(spark, docs, monkeypatch, part_bytes):
    monkeypatch.setattr(ngram_exchange, "PART_BYTES", part_bytes)
    monkeypatch.setattr(ngram_exchange, "RANGE_KEYS", 300)
    rng = random.Random(17)
    texts = [prose(rng, rng.randint(0, 60)) + (" rare%d word" % i if i % 3 == 0 else "") for i in range(90)] + [None, "", "Unseen words"]
    table = docs(texts).unionByName(docs([(5, texts[5]), (None, "no id")])).repartition(3)
    training, deleted = F.col("doc_id") < 60, F.col("doc_id") % 3 == 0
    got, own = ngram_exchange.interpolated_scores(table, training, deleted)
    model, counts = ngram_model.train_language_scores(table.where(training), deleted)
    assert (own.tokens, own.distinct) == (model.tokens, model.distinct) and abs(own.weights - model.weights).max() < 1e-12
    row = lambda r: (r.doc_id is None, r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 7), round(r.score, 7))
    want = ngram_model.score_texts(table, model, counts).collect()
    assert len(want) == len(texts) + 2 and sorted(map(row, got.collect())) == sorted(map(row, want))
    for rows in (table.where("false"), table):
        scored, none = ngram_exchange.interpolated_scores(rows, F.lit(False), F.lit(True))
        assert none.tokens == 0 and all(r.score == 0 and r.n_known == 0 for r in scored.collect())


@pytest.mark.parametrize("bits, ranges", [(33, 1), (40, 7), (64, 412), (64, 24_001)])
def test_ranges_are_found_without_a_look_at_every_key(bits, ranges):
    import numpy as np
    keys = np.unique(np.random.default_rng(5).integers(0, 1 << bits, 5000, np.uint64, endpoint=False))
    where = ngram_exchange.range_of(keys, bits, ranges)
    for number in {*where.tolist()[::50], 0, ranges - 1}:
        assert ngram_exchange.first_of_range(keys, number, bits, ranges) == np.searchsorted(where, np.uint64(number))


def test_numbers_are_packed_without_loss():
    import numpy as np
    for x in ([], [0], [0, 0], [1, 255, 256, 2 ** 63, 2 ** 64 - 1], list(range(5000))):
        values = np.array(x, np.uint64)
        assert (ngram_exchange.unpacked(ngram_exchange.packed(values), len(x)) == values).all()


def test_folds_follow_crc32(spark, docs):
    from pagelode.llm.tables import fold
    rows = docs([(i, "x") for i in [0, 7, -3, 10**12]] + [(None, "x")]).select("doc_id", fold("doc_id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 for r in rows)
