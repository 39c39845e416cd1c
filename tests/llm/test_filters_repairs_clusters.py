"""URL filters, conversation repair and centroid clustering, each against a plain version."""

import hashlib
import math
import random
import re
import zlib
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelode.llm import centroids, conversations, url_filter
from pagelode.llm.queries import QUERIES, SITE_RULES

WHITE = " \t\n\x0b\x0c\r"

# --- 11 ---


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_match(pattern, subject):
    label, start = pattern.startswith("||"), pattern.startswith("|")
    body = pattern[2:] if label else pattern[1:] if start else pattern
    end = body.endswith("|")
    body = body[:-1] if end else body
    regex = "".join({"*": ".*", "^": r"(?:\A|[^A-Za-z0-9]|\Z)"}.get(c, re.escape(c)) for c in body)
    return re.search((r"\A(?:[^/]*\.)?" if label else r"\A" if start else "") + regex + (r"\Z" if end else ""), subject, re.S)


def plain_judgement(url, rules):
    host, path = plain_split(url)
    hits = [r for r in rules if r[2] and r[1] is not None and plain_match(r[2], host + path)]
    best = min(hits, key=lambda r: (-r[3], -len(r[0]), r[1] != "block", r[0], r[2]), default=None)
    return (host, path, best and best[0], best and best[2], best[1] if best else "allow")


RULES = [
    *(url_filter.site_rule(v, r) for r, v in SITE_RULES.items()), *map(url_filter.word_rule, ("casino", "ads")),
    ("start", "block", "|shop.", 0), ("end", "block", "/buy|", 0), ("star", "block", "/a*z/", 0), ("bare", "block", "qq", 0),
    ("odd (chars)", "block", "/x+y(z)[$]", 0), ("tie", "allow", "/tie/", 0), ("tie", "block", "/tie/", 0),
    ("none", None, "example", 0), ("empty", "block", "", 0), ("null", "block", None, 0)]

URLS = [
    None, "", "no scheme", "://", "http://", "http://NET/", "http://net", "http://a.net/x", "http://anet/x", "http://a.net?q=/x",
    "http://example.net/en/1", "http://www.example.net/en/", "http://www.example.net/en", "http://badexample.net/en/1",
    "https://example.com/de/1?x", "https://example.com/DE/1", "https://org/fr/", "https://x.org/fr/z#t", "https://x.org/en/",
    "http://m.casino-win.x/", "http://casinowin.x/", "http://x/casino", "http://x/Casino/", "http://ads", "http://x.ads.y",
    "http://shop.x/", "http://my.shop.x/", "http://x/buy", "http://x/buy/", "http://x/buy?now", "http://x/a/b/z/", "http://x/qqq",
    "http://x/x+y(z)[$]", "http://x/tie/", "http://y/tie/1", "http://example.net:80/en/1", "http://a://b.net/c", "http://ü.net/é/casino",
    "http://x\n.net/y\nz", "http://x/" + "ads/" * 3000, "http://x/" + "k" * 100_000]


def test_urls_are_judged_as_by_every_rule_in_turn(spark):
    rows = [(i, u, "row", "h", 1) for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, row string, host string, subject int")
    rules = spark.createDataFrame(RULES, url_filter.RULE_SCHEMA)
    got = url_filter.judge_urls(pages, rules)
    assert set(got.columns) == {"page_id", "url", "row", "subject", "host", "path", "rule", "pattern", "verdict"}
    found = {r.page_id: (r.host, r.path, r.rule, r.pattern, r.verdict) for r in got.collect()}
    assert len(found) == len(rows)
    for i, u, *_ in rows:
        assert found[i] == plain_judgement(u, RULES), u


def test_rules_are_indexed_by_their_rarest_token(spark):
    subjects = spark.createDataFrame([(f"a.example.com/{'rare' if i == 3 else 'often'}/{i}",) for i in range(20)], "subject string")
    rules = spark.createDataFrame([("one", "block", "||example.com/rare/", 0), ("two", "block", "||example.com/often/", 0),
                                   ("new", "block", "^often^unseen^", 0), ("part", "block", "*xample", 0)], url_filter.RULE_SCHEMA)
    index = {(r.rule, r.token) for r in url_filter.rule_index(rules, subjects).collect()}
    bare = {t for r, t in index if r == "part"}
    assert {(r, t) for r, t in index if r != "part"} == {("one", "rare"), ("two", "often"), ("new", "unseen")}
    assert len(bare) == url_filter.BARE_GROUPS and all(t.startswith("#") for t in bare)


def test_empty_tables_of_urls_and_rules(spark):
    rules, pages = spark.createDataFrame(RULES, url_filter.RULE_SCHEMA), spark.createDataFrame([(1, "http://a.net/x")], "page_id int, url string")
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert [r.verdict for r in url_filter.judge_urls(pages, rules.limit(0)).collect()] == ["allow"]


# --- 12 ---

def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if n == 1:
            text = ""
        if n == 2:
            text = re.sub("[.!?]", "", text)
        if n == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if n == 0 else 2 if n == 3 else 1)
    return out


def plain_faults(rows):
    seen, faults = set(), []
    for _, _, role, text in rows:
        last = text.strip(WHITE)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
        seen.add((role, text))
    return faults


def all_repairs(letters, faults):
    """Every way to edit a few turns into a legal order, as (cost, audit)."""
    found = []

    def legal(out):
        return re.fullmatch("(s?(ua)*u?)?", out)

    def go(i, out, cost, audit, inserted):
        if not legal(out):
            return
        if inserted < len(letters) + 2:
            for role in "ua":
                go(i, out + role, cost + 3, audit + "I", inserted + 1)
        if i == len(letters):
            if re.fullmatch("(s?(ua)+)?", out):
                found.append((cost, audit))
            return
        go(i + 1, out, cost + 4, audit + "D", inserted)
        if faults[i] not in ("blank", "duplicate"):
            cut = 3 * (faults[i] == "truncated")
            go(i + 1, out + letters[i], cost + cut, audit + "K", inserted)
            for role in "ua":
                go(i + 1, out + role, cost + cut + 3, audit + "R", inserted)

    go(0, "", 0, "", 0)
    return min(found)


def forward_repair(letters, faults):
    """The same from left to right, for any number of turns."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def insertions(best):
        for _ in range(3):
            for (p, r), q in step.items():
                if r != "s" and p in best:
                    c = (best[p][0] + 3, best[p][1] + "I")
                    best[q] = min(best.get(q, c), c)
        return best

    best = insertions({0: (0, "")})
    for letter, fault in zip(letters, faults):
        new = {}
        for p, (cost, audit) in best.items():
            options = [(p, cost + 4, "D")]
            if fault not in ("blank", "duplicate"):
                cut = 3 * (fault == "truncated")
                options += [(step[p, letter], cost + cut, "K")] if (p, letter) in step else []
                options += [(step[p, r], cost + cut + 3, "R") for r in "ua" if (p, r) in step]
            for q, c, e in options:
                new[q] = min(new.get(q, (c, audit + e)), (c, audit + e))
        best = insertions(new)
    return min(best[q] for q in (0, 3) if q in best)


def plain_repair(rows):
    """The contract's row for one conversation's damaged rows, with the repaired turns."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    faults = plain_faults(rows)
    initials = [r[2][:1] if r[2][:1] in ("s", "u", "a") else "o" for r in rows]
    cost, audit = forward_repair(initials, faults)
    n, out, i = len(audit) - audit.count("D"), [], 0
    for e in audit:
        role = ("user", "assistant")[(len(out) - n % 2) % 2]
        if e == "I":
            out.append((role, ""))
            continue
        if e != "D":
            out.append(rows[i][2:] if e == "K" else (role, rows[i][3]))
        i += 1
    turns = [r[1] for r in rows if r[1] is not None]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost,
            "audit": audit, "turns": out}


def random_turns(rng, conv, n, hot=False):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "s", "U", None]
    texts = ["Yes.", "Yes.", "and so", "  ", "", "What? \n", "é.", "no\x0b", None, "Well!", ". x"]
    return [(conv, None if rng.random() < 0.05 else rng.choice([i, i, i, rng.randrange(n + 3)]),
             rng.choice(roles[:2] if hot else roles), rng.choice(texts) if not hot else f"Turn {i}.") for i in range(n)]


def test_cells_are_the_cheapest_of_all_repairs():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(5)
        letters = [rng.choice("suao") for _ in range(n)]
        faults = [rng.choice([None, None, "truncated", "blank", "duplicate"]) for _ in range(n)]
        want = all_repairs(letters, faults)
        spelled = "".join("x" if f in ("blank", "duplicate") else c.upper() if f else c for c, f in zip(letters, faults))
        assert conversations.cheapest(conversations.span_cell(spelled)) == want
        assert forward_repair(letters, faults) == want


@pytest.mark.parametrize("chars, turns", [(conversations.BLOCK_CHARS, conversations.BLOCK_TURNS), (40, 3)])
def test_conversations_are_repaired_as_by_the_plain_version(spark, chars, turns):
    rng = random.Random(7)
    rows = [r for conv in [None, *range(60)] for r in random_turns(rng, conv, rng.randrange(1, 14))]
    rows += random_turns(rng, 100, 700) + random_turns(rng, 101, 300, hot=True) + [(102, 0, "user", "Same.")] * 500
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "conv_id long, turn long, role string, text string, block string, task int")
    damaged, copies = conversations.damaged(df.repartition(16))
    report, repaired = conversations.repair_conversations(damaged, copies, chars, turns)
    digests = {r.conv_id: r.sha256 for r in conversations.conversation_digests(repaired).collect()}
    blocks = sorted(repaired.collect(), key=lambda r: (r.conv_id is not None, r.conv_id, r.before))
    texts = {}
    for r in blocks:
        assert r.before == len(texts.setdefault(r.conv_id, []))
        texts[r.conv_id] += [(t.role, t.text) for t in r.turns]
    by = {}
    for r in plain_damage(rows):
        by.setdefault(r[0], []).append(r)
    got = {r.conv_id: r.asDict() for r in report.collect()}
    assert set(got) == {r[0] for r in rows} and report.count() == len(got)
    for conv, found in got.items():
        want = plain_repair(by.get(conv, []))
        out = want.pop("turns")
        assert {k: found[k] for k in want} == want, conv
        assert texts.get(conv, []) == out
        if out:
            assert digests[conv] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        else:
            assert conv not in digests


def test_no_block_of_a_long_conversation_is_large(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    report, repaired = conversations.repair_conversations(df, block_turns=64)
    assert repaired.select(F.max(F.size("turns"))).first()[0] <= 64
    assert report.first().audit == "K" * 3000 and report.first().cost == 0


def test_conversations_without_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    report, repaired = conversations.repair_conversations(none)
    assert report.count() == 0 and repaired.count() == 0 and conversations.conversation_digests(repaired).count() == 0
    gone = spark.createDataFrame([(5, 1, "user", "x")], none.schema)
    report, repaired = conversations.repair_conversations(gone, F.lit(0))
    assert report.first().asDict() == {"conv_id": 5, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0,
                                       "cost": 0, "audit": ""}
    assert repaired.count() == 0


# --- 13 ---

def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        groups = [[] for _ in cents]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        cents = [[sum(col) // len(g) for col in zip(*g)] if g else c for g, c in zip(groups, cents)]
    final = [(i, *nearest(v)) for i, v in kept]
    total = [sum(d for _, d, c in final if c == j) for j in range(len(cents))]
    return sorted(((i, c, d, total[c], sum(total), cents[c]) for i, d, c in final), key=str)


def found_clusters(df):
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, list(r.centroid)) for r in df.collect()), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, b"x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, ids binary")


def test_clusters_are_those_of_the_plain_version(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=64) / 8 + (i % 5)]) for i in range(230)]
    rows += [(i % 7, rows[0][1]) for i in range(40)]                       # repeated ids and rows
    rows += [(None, rows[1][1]), (900, None), (901, []), (902, rows[0][1][:63]), (903, [None, *rows[0][1][1:]]),
             (904, [float("nan"), *rows[0][1][1:]]), (905, [float("-inf"), *rows[0][1][1:]]), (906, [0.0] * 64)]
    got = found_clusters(centroids.cluster_vectors(vectors(spark, rows).repartition(7)))
    assert got == plain_clusters(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_clusters(spark, n):
    rows = [(i, [float(i)] * 64) for i in range(n)] + [(50, None)]
    assert found_clusters(centroids.cluster_vectors(vectors(spark, rows))) == plain_clusters(rows)


def test_ties_go_to_the_smaller_number_and_large_values_stay_exact(spark):
    rows = [(i, [float(i % 3)] * 64) for i in range(40)]
    assert found_clusters(centroids.cluster_vectors(vectors(spark, rows))) == plain_clusters(rows)
    rows = [(i, [float((-1) ** i * (i % 4) * 2 ** 17)] * 64) for i in range(30)]  # beyond 2^27 as integers
    assert found_clusters(centroids.cluster_vectors(vectors(spark, rows))) == plain_clusters(rows)


def test_a_distance_that_is_no_long_is_null(spark):
    rows = [(i, [1e30 * (-1) ** i if i < 9 else 0.0] * 64) for i in range(12)]
    out = centroids.cluster_vectors(vectors(spark, rows), k=2, rounds=1).collect()
    assert len(out) == 12 and all(r.distance is None or r.distance >= 0 for r in out)


def test_blocks_hold_every_vector_once(spark):
    rows = [(i, [float(i)] * 64) for i in range(9000)]
    wide = vectors(spark, rows).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    blocks = centroids.blocks_of(wide.coalesce(1), 64, 1024)
    sizes = [r.n for r in blocks.select(F.size("ids").alias("n")).collect()]
    assert sum(sizes) == 9000 and max(sizes) <= centroids.BLOCK
    assert blocks.select(F.explode("ids")).distinct().count() == 9000


def test_the_queries_run_and_keep_every_row(spark):
    for name, source, key in (("op11_url_filter", "pages", "page_id"), ("op12_conversation_repair", "conversations", "conv_id"),
                              ("op13_centroids", "embeddings", "vec_id")):
        got = QUERIES[name](spark, "/root/testdata/sf0.001")
        want = spark.read.parquet(f"/root/testdata/sf0.001/{source}.parquet").select(key).distinct().count()
        assert got.select(key).distinct().count() == want


def test_the_conversation_query_gives_the_plain_rows(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by = {c: list(g) for c, g in groupby(sorted(plain_damage(rows), key=lambda r: r[0]), key=lambda r: r[0])}
    for r in QUERIES["op12_conversation_repair"](spark, sf).collect():
        want = plain_repair(by.get(r.conv_id, []))
        lines = "\n".join(f"{a}:{b}" for a, b in want.pop("turns"))
        assert r.asDict() == want | {"conv_id": r.conv_id, "repaired_sha256": hashlib.sha256(lines.encode()).hexdigest()}
