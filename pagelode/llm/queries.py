"""One query for each operator, over the whole of its tables, with the digest columns of its contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelode.llm import (
    centroids, conversations, decontaminate, jaccard, language, licenses, lines, mixing, ngram_exchange, pii, spotsigs, toxicity,
    url_filter)
from pagelode.llm.tables import fold

QUERIES, SQL = {}, {}

#: Target weights of the mix: relative to 1.0 for a source that is not named.
SOURCE_WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5}


def query(sql=None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run
    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined_labels(column):
    return F.array_join(F.array_sort(F.array_distinct(F.transform(column, lambda s: s.label))), ",")


@query()
def op1_ngram_jaccard_join(spark, sf_dir):
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


#: A-Z in lower case, words of ASCII letters, digits and anything beyond ASCII.
WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows))),
hits AS (SELECT doc_id, item_id, i, n FROM places JOIN windows USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query(CONTAMINATION_SQL)
def op2_decontamination(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


LINES_SQL = r"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, i - 1 AS line, parts[i] AS s FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM split)),
w AS (SELECT doc_id, line, s, regexp_extract_all(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM l),
m AS (SELECT doc_id, line, w, len(w) AS n, [CASE WHEN regexp_matches(x, '[0-9]') THEN chr(1) ELSE x END FOR x IN w] AS v
  FROM w WHERE len(w) >= 4),
c AS (SELECT *, 2 * len([x FOR x IN v IF x <> chr(1)]) >= n AS mostly FROM m),
keys AS (
  SELECT doc_id, line, CASE WHEN mostly THEN 'm ' || array_to_string(v, ' ')
    ELSE 'e ' || array_to_string(v[1:3], ' ') || chr(2) || array_to_string(w, ' ') END AS key FROM c
  UNION ALL
  SELECT doc_id, line, p || ' ' || n || ' ' || array_to_string(
    [CASE WHEN i <= 3 OR (i - 1) % 2 = p THEN v[i] ELSE '' END FOR i IN range(1, n + 1)], ' ')
  FROM c, (VALUES (0), (1)) t(p) WHERE mostly AND n >= 8),
recurring AS (SELECT key, min(doc_id) AS first FROM keys GROUP BY key HAVING min(doc_id) < max(doc_id)),
dropped AS (SELECT DISTINCT doc_id, line FROM keys JOIN recurring USING (key) WHERE doc_id > first),
kept AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY line) AS text FROM l ANTI JOIN dropped USING (doc_id, line) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM dropped GROUP BY doc_id)
SELECT doc_id, CASE WHEN n IS NULL THEN split.text ELSE coalesce(kept.text, '') END AS text,
  CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_dropped
FROM split LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""


@query(LINES_SQL)
def op3_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_recurring_lines(docs, counts=True)


@query()
def op5_source_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_sources(docs, SOURCE_WEIGHTS).select(
        "doc_id", "source", "block", "slot", "position", "balanced")


@query()
def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    model = toxicity.train_toxicity_model(docs, labels)
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


@query()
def op6_personal_data(spark, sf_dir):
    found = pii.personal_data(table(spark, sf_dir, "documents"))

    def number(kind):
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *(number(k) for k in pii.KINDS),
        F.sha2(pii.listed("base").cast("binary"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


@query()
def op7_spot_signatures(spark, sf_dir):
    found = spotsigs.fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                        "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query()
def op8_license_scan(spark, sf_dir):
    scanned = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform("base_places", lambda s: s.first_word)
    return scanned.select(
        "doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined_labels(F.col("base_places")).alias("base_labels"),
        joined_labels(F.concat("base_places", "spans")).alias("labels"),
        F.least(F.lit(1.0), F.greatest(
            F.when(F.size("base_places") > 0, 0.5).otherwise(0.0),
            F.coalesce(F.array_max(F.transform("spans", lambda s: s.share)), F.lit(0.0)))).alias("score"))


@query()
def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.train_language_model(docs.where(fold("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    return language.identify_languages(docs, model).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query()
def op10_interpolated_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    scored, model = ngram_exchange.interpolated_scores(docs, number % 10 != 0, F.floor(number / 10) % 8 == 0)
    return scored.select(
        "doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


#: Rules of sites; of those that fit, the longest wins.
SITE_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

URLS_SQL = rf"""
WITH p AS (SELECT page_id, lower_host AS host, path FROM (SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)),
rules(rule, verdict) AS (VALUES {", ".join(f"('{r}', '{v}')" for r, v in SITE_RULES.items())}),
parts AS (SELECT rule, verdict, rule[:instr(rule, '/') - 1] AS h, rule[instr(rule, '/'):] AS t FROM rules),
fits AS (SELECT DISTINCT host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) JOIN parts ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, t)
  GROUP BY host, path)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN verdict
  WHEN regexp_matches(host || path, '(^|[^A-Za-z0-9])({"|".join(url_filter.BLOCKED_WORDS)})([^A-Za-z0-9]|$)') THEN 'block'
  ELSE 'allow' END AS verdict
FROM p LEFT JOIN fits USING (host, path)
"""


@query(URLS_SQL)
def op11_url_filter(spark, sf_dir):
    rules = url_filter.rule_table(spark, [
        *(url_filter.site_rule(verdict, rule) for rule, verdict in SITE_RULES.items()),
        *map(url_filter.word_rule, url_filter.BLOCKED_WORDS)])
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path",
                         F.when(F.col("rule").isin(*SITE_RULES), F.col("rule")).alias("rule"), "verdict")


@query()
def op12_conversation_repair(spark, sf_dir):
    rows, copies = conversations.damaged(table(spark, sf_dir, "conversations"))
    report, repaired = conversations.repair_conversations(rows, copies)
    digests = conversations.conversation_digests(repaired).withColumnRenamed("conv_id", "hashed")
    return report.join(digests, F.col("conv_id").eqNullSafe(F.col("hashed")), "left").select(
        *report.columns, F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _cluster_sql(rounds: int) -> str:
    """The rounds one after the other; floors of means without a division of floating point."""
    vectors = """
WITH v AS MATERIALIZED (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len([y FOR y IN embedding IF y IS NOT NULL AND isfinite(y)]) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (
  SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT 8))"""
    near = """,
a{0} AS MATERIALIZED (SELECT v.vec_id, v.x, list_min([struct_pack(d := CAST(list_sum([(v.x[i] - k.x[i]) * (v.x[i] - k.x[i])
    FOR i IN range(1, 65)]) AS BIGINT), c := k.c) FOR k IN (SELECT list(struct_pack(c := c, x := x)) FROM c{0})]) AS best FROM v)"""
    move = """,
m{0} AS (SELECT c, i, (s - ((s % n) + n) % n) // n AS f FROM (
  SELECT best.c AS c, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{0}, range(1, 65) t(i) GROUP BY 1, 2)),
c{1} AS MATERIALIZED (SELECT c, coalesce(y, x) AS x FROM c{0} LEFT JOIN (
  SELECT c, list(CAST(f AS BIGINT) ORDER BY i) AS y FROM m{0} GROUP BY c) USING (c))"""
    steps = "".join(near.format(r) + move.format(r, r + 1) for r in range(rounds))
    return vectors + steps + near.format(rounds) + f"""
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} k ON k.c = best.c
"""


@query(_cluster_sql(10))
def op13_centroids(spark, sf_dir):
    found = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                        F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256).alias("centroid_sha256"))
