"""Personal data: candidates of loose patterns, chosen by gradient-boosted trees; DataFrame functions only.

Strict patterns with their checks give the base spans. Loose generators propose more, overlapping ones
too: anything around an ``@``, any number of seven or more digits, any long token with digits. Boosted
trees score each candidate by its format and by the words before it. They learn from the corpus itself:
a candidate counts as personal data where a base span overlaps it, or where a keyword or a known key
format marks a secret; the checks (Luhn, 255) are no features, so the trees judge by looks. On all candidates
that they have not learned from, the threshold of each generator is set to the lowest score from
which on nine in ten are right. Of candidates that overlap, the best stays; one that overlaps a base
span goes, as base spans always stay.

Null texts are empty and have no spans. Rows that repeat id and text have the same spans. Where all
labels are the same, all candidates are taken or none. Extra columns are ignored.
Places are code points, end exclusive; they come from running sums over a text's matches, by document.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelode.llm.tables import written

#: Kinds in the order of listings; others follow by name.
KINDS = ("email", "ip", "card", "phone")

# Java's matcher recurses on plain repeated groups and starts anew at every place of a run. Possessive
# repeats and starts at the beginning of a run, or where the match before ended, give the same matches.
_MAIL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_MAIL}]))[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "mail-like": r"(?:\G|(?<![^\s@]))[^\s@]++@[^\s@]++",
    "number-like": r"[+(]?+[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+",
    "key-like": r"(?:\G|(?<![A-Za-z0-9+/_-]))(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+",
}
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
CONTEXT = {
    "near_phone": r"(?i)(?:phone|tel|call|fax|mobile|cell)\W*+\w*+\W*+$",
    "near_mail": r"(?i)(?:mail|contact|write)\W*+\w*+\W*+$",
    "near_card": r"(?i)(?:card|visa|credit|account|iban|payment)\W*+\w*+\W*+$",
    "near_host": r"(?i)(?:ip|host|server|address)\W*+\w*+\W*+$",
}
SECRET = r"(?i)(?:password|passwd|pwd|token|secret|api.?key)\s*+[=:]\s*+[\"']?+$"
KEY_FORMAT = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})$"
FEATURES = ("length", "digits", "letters", "upper", "blanks", "dots", "dashes", "ats", "plus", "distinct", "hexadecimal",
            *CONTEXT)


def luhn(digits: Column) -> Column:
    """Whether the digits of a card number add up: from the right, every second one counts double."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c: c.try_cast("int"))
    value = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0))) % 10 == 0


def passes(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return (F.when(kind == "ip", match.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"))
            .when(kind == "card", F.when(n.between(16, 19), luhn(digits)).otherwise(False))
            .when(kind == "phone", n.between(8, 15)).otherwise(True))


def found_spans(docs: DataFrame) -> DataFrame:
    """(row, kind, start, end, match, left) of all patterns' matches, before any check; ``left`` is what stands before."""
    text = F.col("text")

    def of(name: str, pattern: str, mark: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        gaps = F.slice(F.split(text, pattern, -1), 1, 1_000_000_000)
        both = F.zip_with(found, gaps, lambda m, g: F.struct(
            m.alias("match"), F.length(g).alias("gap"), F.right(g, F.lit(32)).alias("left")))
        some = F.filter(both, lambda x: x["match"].isNotNull())  # there is a gap more than matches
        return F.struct(F.lit(name).alias("kind"), F.when(text.rlike(mark), some).alias("found"))

    marks = {"email": "@", "mail-like": "@", "phone": r"\+"}
    groups = F.array(*(of(k, p, marks.get(k, "[0-9]")) for k, p in (BASE | GENERATORS).items()))
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text").where(text.rlike("[0-9@]")).dropDuplicates(["row"])
    each = rows.select("row", F.explode_outer(groups).alias("g")).select(
        "row", "g.kind", F.posexplode_outer("g.found").alias("k", "m")).where(F.col("m").isNotNull())
    before = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    flat = each.select("row", "kind", "k", "m.*").withColumn("size", F.length("match"))
    start = (F.col("gap") + F.coalesce(F.sum(F.col("gap") + F.col("size")).over(before), F.lit(0))).cast("long")
    return flat.withColumn("start", start).select(
        "row", "kind", "start", (F.col("start") + F.col("size")).alias("end"), "match", "left")


def with_features(candidates: DataFrame) -> DataFrame:
    match, left = F.col("match"), F.col("left")
    count = lambda cls: F.length(match) - F.length(F.regexp_replace(match, cls, ""))
    columns = {
        "length": F.length(match), "digits": count("[0-9]"), "letters": count(r"\p{L}"), "upper": count(r"\p{Lu}"),
        "blanks": count(r"\s"), "dots": count(r"\."), "dashes": count("-"), "ats": count("@"), "plus": count(r"\+"),
        "distinct": F.size(F.array_distinct(F.split(match, ""))), "hexadecimal": match.rlike("^[0-9a-f]++$").cast("int"),
    } | {name: left.rlike(pattern).cast("int") for name, pattern in CONTEXT.items()}
    numbers = candidates.withColumns({c: e.cast("double") for c, e in columns.items()})
    coded = numbers.withColumn("generator", F.array_position(F.array(*map(F.lit, GENERATORS)), F.col("kind")).cast("double"))
    return VectorAssembler(inputCols=["generator", *FEATURES], outputCol="features").transform(coded)


def candidates_of(spans: DataFrame, base: DataFrame) -> DataFrame:
    """Candidates with the label that the corpus gives them, and whether a base span overlaps them.

    In the order of base spans' starts and candidates' ends, a candidate is overlapped if the largest end of the base spans
    before it lies behind its start: one pass over a document, whatever it holds.
    """
    loose = spans.where(F.col("kind").isin(*GENERATORS))
    strict = base.select("row", "start", "end").withColumn("strict", F.lit(True))
    both = loose.withColumn("strict", F.lit(False)).unionByName(strict, allowMissingColumns=True)
    upto = Window.partitionBy("row").orderBy(F.when(F.col("strict"), F.col("start")).otherwise(F.col("end")), "strict").rowsBetween(
        Window.unboundedPreceding, -1)
    furthest = F.coalesce(F.max(F.when(F.col("strict"), F.col("end"))).over(upto), F.lit(-1))
    marked = both.withColumn("crossed", furthest > F.col("start")).where(~F.col("strict")).drop("strict")
    secret = (F.col("kind") == "key-like") & (F.col("left").rlike(SECRET) | F.col("match").rlike(KEY_FORMAT))
    return marked.withColumn("label", (F.col("crossed") | secret).cast("double"))


def sampled(candidates: DataFrame, sample_rows: int) -> Column:
    """Whether a candidate is one to learn from: of each generator and label as many as fill its share of ``sample_rows``,
    up to chance, chosen by hash; half of those there are at most, so that the others can set the thresholds."""
    sizes = candidates.groupBy("kind", "label").count().collect()  # two rows for each generator
    most = sample_rows / max(1, 2 * len(GENERATORS))
    part = F.pmod(F.xxhash64(F.lit("sample"), "row", "kind", "start"), F.lit(1_000_000))
    chosen_parts = F.lit(0)
    for r in sizes:
        share = int(1_000_000 * min(0.5, most / r["count"]))
        chosen_parts = F.when((F.col("kind") == r.kind) & (F.col("label") == r.label), share).otherwise(chosen_parts)
    return part < chosen_parts


def chosen(candidates: DataFrame, sample_rows: int, precision: float) -> DataFrame:
    """(row, kind, start, end) of the candidates that the trees and the thresholds select, without overlaps.

    Trees learn from a bounded sample. Thresholds come from the scores of all other candidates: for each generator the least
    score from which on enough of them are right; a generator without any takes that of all together. Where all labels are
    the same there is nothing to tell apart: all candidates are taken, or none.
    """
    ready = written(with_features(candidates).withColumn("learn", sampled(candidates, sample_rows)))
    learn = ready.where("learn").select("label", "features")
    labels = {r.label for r in learn.select("label").distinct().collect()}
    score = F.lit(1.0)
    if labels == {0.0, 1.0}:
        model = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, seed=7).fit(learn)
        ready = model.transform(ready)
        score = F.round(vector_to_array(F.col("probability"))[1], 2)
    scored = written(ready.withColumn("p", score).select("row", "kind", "start", "end", "match", "crossed", "learn", "label", "p"))
    # At most 101 scores for each generator.
    tallies = scored.where(~F.col("learn")).groupBy("kind", "p").agg(
        F.count("*").alias("n"), F.sum("label").alias("good")).orderBy(F.desc("p")).collect()

    def least_score(rows) -> float | None:
        n, good, least = 0, 0.0, None
        by_score: dict[float, tuple[int, float]] = {}
        for r in rows:
            m, g = by_score.get(r.p, (0, 0.0))
            by_score[r.p] = m + r.n, g + r.good
        for p in sorted(by_score, reverse=True):
            n, good = n + by_score[p][0], good + by_score[p][1]
            if good >= precision * n and p > 0:
                least = p
        return least

    bound = F.lit(2.0)
    pooled = least_score(tallies)
    for kind in GENERATORS:
        own = [r for r in tallies if r.kind == kind]
        least = least_score(own) if own else pooled
        if least is not None:
            bound = F.when(F.col("kind") == kind, least).otherwise(bound)
    good = scored.where(~F.col("crossed") & (F.col("p") >= bound))
    # Overlapping candidates form an island; its best one stays.
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.when(F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(0)), 1).otherwise(0)
    islands = good.select("row", "kind", "start", "end", "match", "p").withColumn("f", fresh).withColumn(
        "island", F.sum("f").over(upto))
    best = Window.partitionBy("row", "island").orderBy(F.desc("p"), "start", F.desc("end"))
    digits = F.length(F.regexp_replace("match", "[^0-9]", ""))
    shape = (F.when(F.col("kind") == "mail-like", "email").when(F.col("kind") == "key-like", "secret")
             .when(F.col("match").rlike(r"^[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++$"), "ip")
             .when(F.col("match").startswith("+") | (digits < 12), "phone").otherwise("card"))
    return islands.withColumn("r", F.row_number().over(best)).where("r = 1").select(
        "row", shape.alias("kind"), "start", "end")


def _spans_by_row(docs: DataFrame, sample_rows: int, precision: float) -> DataFrame:
    """(row, base, spans) of the rows that have any; ``row`` is the hash of id and text."""
    spans = written(found_spans(docs))
    base = spans.where(F.col("kind").isin(*KINDS) & passes(F.col("kind"), F.col("match"))).select(
        "row", "kind", "start", "end")
    extra = chosen(written(candidates_of(spans, base)), sample_rows, precision)
    both = base.withColumn("base", F.lit(True)).unionByName(extra.withColumn("base", F.lit(False)))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0)), F.lit(len(KINDS) + 1))
    item = F.struct(place.cast("int").alias("place"), "kind", "start", "end")
    return both.groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("base"), item))).alias("base"),
                                   F.sort_array(F.collect_list(item)).alias("spans"))


_NONE = "array<struct<place:int,kind:string,start:bigint,end:bigint>>"


def personal_data(docs: DataFrame, sample_rows: int = 20_000, precision: float = 0.9) -> DataFrame:
    """Each row's ``doc_id`` with ``base`` and ``spans``: arrays of (place of the kind, kind, start, end), sorted.

    The trees learn from about ``sample_rows`` candidates at most, chosen by hashes.
    """
    lists = _spans_by_row(docs, sample_rows, precision)
    none = F.array().cast(_NONE)
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row")).join(lists, "row", "left").select(
        "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def listed(spans: Column | str) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, mask: str = "[{}]", sample_rows: int = 20_000, precision: float = 0.9) -> DataFrame:
    """The documents with every span of ``personal_data`` replaced by its kind in brackets; overlaps merge into one.

    Rows meet their spans by the hash of id and text, so rows with equal or null ids get their own.
    """
    found = _spans_by_row(docs, sample_rows, precision).select("row", "spans")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.xxhash64("doc_id", "text").alias("row"))
    text = F.col("own").getField("text")
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    head, tail = mask.split("{}")
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    folded = F.aggregate(by_start, empty, lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(
            acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
            F.lit(head), s["kind"], F.lit(tail))).alias("out")))
    whole = F.concat(folded["out"], F.substring(text, (folded["at"] + 1).cast("int"), F.length(text)))
    masked = F.when(F.size("spans") > 0, whole).otherwise(text).alias("text")
    return rows.join(found, "row", "left").select(
        *[masked if c == "text" else F.col("own").getField(c).alias(c) for c in docs.columns])
