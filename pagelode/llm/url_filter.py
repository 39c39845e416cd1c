"""URL filters: pattern rules, each indexed by the rarest of its literal tokens.

A URL's tokens fetch the rules that are indexed by one of them, and only those rules run as regular expressions.
All of it is DataFrame functions.

Patterns are matched against host and path, written one after the other. In a pattern ``*`` is any run of
characters, ``^`` is one character that is no ASCII letter or digit, or the start or end; a leading ``||`` is the
start of the host or of one of its labels, a leading or trailing ``|`` is the start or the end; anything else is
itself. A token is a run of ASCII letters and digits with something else than a letter, a digit or ``*`` on both
sides in the pattern, so a URL that the rule matches has it as a whole token. Rules without a token are tried on
every URL.

The host is what follows the first ``://`` up to ``/``, ``?`` or ``#``, with A-Z in lower case; the path goes on from
there up to ``?`` or ``#``. A null URL and one without ``://`` have an empty host and path, and are judged like others.
Repeated URLs are judged once. Rules with a null or empty pattern or a null verdict are no rules; without rules every
URL is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm.tables import written

RULE_SCHEMA = "rule string, verdict string, pattern string, rank int"

#: Words of hosts and paths that the default patterns block.
BLOCKED_WORDS = (
    "ad", "ads", "adserver", "adult", "bet", "bets", "betting", "casino", "casinos", "doubleclick", "gambling",
    "jackpot", "pills", "poker", "porn", "pornhub", "slots", "spam", "tracker", "viagra", "xxx")

#: Rules without a token go to so many groups, and each URL to one of them.
BARE_GROUPS = 64

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_WORD = "[A-Za-z0-9]"


def site_rule(verdict: str, rule: str) -> tuple[str, str, str, int]:
    """A rule for a host with its subdomains and a path that starts so, like ``example.org/news/``."""
    return (rule, verdict, "||" + rule, 1)


def word_rule(word: str, verdict: str = "block") -> tuple[str, str, str, int]:
    """A rule for a word that stands alone anywhere in host or path; site rules go before it."""
    return (word, verdict, f"^{word}^", 0)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str, int]]) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), CAPITALS, SMALL)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def regex_of(pattern: Column) -> Column:
    """The Java regular expression of a pattern."""
    label, start, end = F.startswith(pattern, F.lit("||")), F.startswith(pattern, F.lit("|")), F.endswith(pattern, F.lit("|"))
    begin = F.when(label, 3).when(start, 2).otherwise(1)
    length = F.length(pattern) - begin + 1 - F.when(end & (F.length(pattern) >= begin), 1).otherwise(0)
    body = F.substring(pattern, begin, F.greatest(length, F.lit(0)))
    body = F.regexp_replace(body, r"([\\.+?()\[\]{}$|])", r"\\$1")
    body = F.regexp_replace(body, r"\^", r"(?:\\A|[^A-Za-z0-9]|\\z)")
    body = F.regexp_replace(body, r"\*+", ".*")
    return F.concat(F.lit("(?s)"), F.when(label, r"\A(?:[^/]*\.)?").when(start, r"\A").otherwise(""), body,
                    F.when(end & (F.length(pattern) >= begin), r"\z").otherwise(""))


def tokens_of(subject: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(subject, F.lit(f"{_WORD}+"), F.lit(0)))


def rule_tokens(pattern: Column) -> Column:
    """The tokens that every match of a pattern has whole."""
    return F.array_distinct(F.regexp_extract_all(
        pattern, F.lit(f"(?<=[^A-Za-z0-9*]){_WORD}+(?=[^A-Za-z0-9*])"), F.lit(0)))


def _group(group: Column) -> Column:
    """A key that no token equals."""
    return F.concat(F.lit("#"), group.cast("string"))


def rule_index(rules: DataFrame, subjects: DataFrame) -> DataFrame:
    """Each rule under the token that the fewest subjects have; rules without a token under every group key."""
    ready = rules.where((F.col("pattern") != "") & F.col("verdict").isNotNull()).select(
        "rule", "verdict", "pattern", F.coalesce("rank", F.lit(0)).alias("rank")).distinct().withColumn(
            "tokens", rule_tokens(F.col("pattern")))
    spelled = ready.select("rule", "verdict", "pattern", "rank", F.explode_outer("tokens").alias("token"))
    wanted = spelled.where(F.col("token").isNotNull()).select("token").distinct()
    # Counted before the join: a token that most URLs have sends one row for each task.
    seen = subjects.select(F.explode(tokens_of(F.col("subject"))).alias("token")).groupBy("token").agg(
        F.count("*").alias("urls")).join(wanted, "token")
    rarest = spelled.join(seen, "token", "left").groupBy("rule", "verdict", "pattern", "rank").agg(
        F.min_by("token", F.struct(F.coalesce("urls", F.lit(0)), "token")).alias("token"))
    groups = F.transform(F.sequence(F.lit(0), F.lit(BARE_GROUPS - 1)), _group)
    keys = F.when(F.col("token").isNull(), groups).otherwise(F.array("token"))
    return rarest.select("rule", "verdict", "pattern", "rank", regex_of(F.col("pattern")).alias("regex"),
                         F.explode(keys).alias("token"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All rows with ``host``, ``path``, ``rule``, ``pattern`` and ``verdict``.

    Of the rules that match, the one with the highest rank wins, then the longest, then a block, then the
    smallest by text; ``rule`` and ``pattern`` are null where none does. Columns of these names are replaced. Select the
    columns that are needed first: rows move once, to meet the verdict of their URL.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host.alias("host"), path.alias("path"))
    subjects = written(rows.select(F.concat("host", "path").alias("subject")).distinct())
    index = written(rule_index(rules, subjects))
    group = _group(F.pmod(F.xxhash64("subject"), F.lit(BARE_GROUPS)))
    fetched = subjects.select("subject", F.explode(F.concat(tokens_of(F.col("subject")), F.array(group))).alias("token"))
    matched = fetched.join(index, "token").where(F.expr("subject RLIKE regex"))
    name = F.coalesce("rule", "pattern")
    best = matched.groupBy("subject").agg(F.min_by(
        F.struct("rule", "pattern", "verdict"),
        F.struct(-F.col("rank"), -F.length(name), F.col("verdict") != "block", name, "pattern")).alias("won"))
    judged = rows.withColumn("subject", F.concat("host", "path")).join(best, "subject", "left")
    own = ("host", "path", "rule", "pattern", "verdict")
    return judged.select(
        *[F.col("row").getField(c).alias(c) for c in pages.columns if c not in own], "host", "path",
        F.col("won.rule").alias("rule"), F.col("won.pattern").alias("pattern"),
        F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
