"""Mixing sources to target weights by Pfair scheduling.

The documents of a source form blocks of equal size, in the order of the md5 of their ids. With weight
w of all slots, block j of a source (from 0) is released at floor(j / w) and due at ceil((j + 1) / w);
of the released blocks the one with the earliest deadline takes the next slot. At any slot a source is
then less than one block away from its share. Weights are exact fractions, as their decimals are given.
With their smallest whole numbers the schedule repeats after as many slots as these add up to. The driver
works out the turns of one period, or only those up to the last block that a source has where the period
is longer, and the place of every block follows. It keeps one turn of each source and at most ``CHUNK`` of those worked
out: a longer schedule goes to a table, chunk by chunk, and joins by shuffle; only one that fits a chunk is broadcast. No document is dropped or repeated: a source that has
run out leaves its slots empty, and ``balanced`` tells which documents come before the first empty slot.
Weights have to be positive and finite. A caller who gives ``slots`` has weights rounded to that period.

Documents are numbered in two steps, by the first hex digits of the md5 within a source and then over
these parts, so no source is sorted as a whole in one task. Null sources form a source of their own;
null ids and repeated rows are documents like others.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelode.llm.tables import shared_folder

#: Turns that the driver holds at once, and rows of a schedule that is broadcast.
CHUNK = 1 << 17


def whole_weights(weights: Mapping[str | None, float]) -> dict[str | None, int]:
    """The smallest whole numbers with the given ratios."""
    if not all(0 < w < float("inf") for w in weights.values()):
        raise ValueError("weights have to be positive and finite")
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    common = lcm(*(f.denominator for f in exact.values()))
    whole = {s: int(f * common) for s, f in exact.items()}
    divisor = gcd(*whole.values())
    return {s: n // divisor for s, n in whole.items()}


def shares(weights: Mapping[str | None, float], slots: int) -> dict[str | None, int]:
    """Slots of each source in a period of this length: by largest remainder, but at least one."""
    whole = whole_weights(weights)
    total = sum(whole.values())
    out = {s: max(1, slots * n // total) for s, n in whole.items()}
    while (left := slots - sum(out.values())) != 0:
        behind = sorted(out, key=lambda s: (out[s] * total - slots * whole[s], s is None, s or ""))
        if left > 0:
            for s in behind[:left]:
                out[s] += 1
        else:
            out[next(s for s in reversed(behind) if out[s] > 1)] -= 1
    return out


def period(slots_of: Mapping[str | None, int],
           needed: Mapping[str | None, int] | None = None) -> Iterator[tuple[str | None, int, int]]:
    """(source, turn, slot) of one period, by slot: earliest deadline first among the released blocks.

    With ``needed``, turns of a source from that number on are left out, and the schedule ends after the last one.
    """
    slots = sum(slots_of.values())
    missing = None if needed is None else sum(1 for n in needed.values() if n > 0)
    names = sorted(slots_of, key=lambda s: (s is None, s or ""))
    waiting = [(0, k, 0) for k in range(len(names))]  # release, source, turn
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # deadline, source, turn
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, k, turn = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(turn + 1) * slots // slots_of[names[k]]), k, turn))
        deadline, k, turn = heapq.heappop(ready)
        assert slot < deadline
        if needed is None or turn < needed[names[k]]:
            yield names[k], turn, slot
        if needed is not None and turn + 1 == needed[names[k]]:
            missing -= 1
            if not missing:
                break
        if turn + 1 < slots_of[names[k]]:
            heapq.heappush(waiting, ((turn + 1) * slots // slots_of[names[k]], k, turn + 1))


def schedule_table(spark: SparkSession, slots_of: Mapping[str | None, int], needed: Mapping[str | None, int],
                   asked: Mapping[str | None, int], chunk: int = CHUNK) -> tuple[DataFrame, dict[str | None, int]]:
    """The turns of ``period`` as (_s, _turn, _slot), with a broadcast hint if one chunk holds them, and the slots of
    the turns that are ``asked`` for, one for each source."""
    names, path, found, rows = "_s string, _turn long, _slot long", None, {}, []
    for source, turn, slot in period(slots_of, needed):
        if len(rows) == chunk:
            path = path or shared_folder(spark)
            spark.createDataFrame(rows, names).write.mode("append").parquet(path)
            rows = []
        rows.append((source, turn, slot))
        if asked[source] == turn:
            found[source] = slot
    last = spark.createDataFrame(rows, names)
    if path is None:
        return F.broadcast(last), found
    last.write.mode("append").parquet(path)
    return spark.read.schema(names).parquet(path), found


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None, default_weight: float = 1.0,
                block_rows: int = 16, slots: int | None = None) -> DataFrame:
    """The documents with ``block`` (of their source), ``slot``, ``position`` in the mix, and ``balanced``.

    ``weights`` are relative; a source that they do not name has ``default_weight``. The sources and the
    turns of a period are the only things the driver sees.
    """
    spark = docs.sparkSession
    docs = docs.drop("block", "slot", "position", "balanced")  # columns of these names give way
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(own, "source", "doc_id", F.xxhash64("text").alias("_text"), key.alias("_key"))
    rows = rows.withColumn("_part", F.substring("_key", 1, 4))
    parts = rows.groupBy("source", "_part").agg(F.count("*").alias("_n"))
    sizes = parts.groupBy("source").agg(F.sum("_n").alias("n")).collect()
    if not sizes:
        return docs.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (
            ("block", "long"), ("slot", "long"), ("position", "long"), ("balanced", "boolean"))))
    wanted = {r.source: (weights or {}).get(r.source, default_weight) for r in sizes}
    slots_of = whole_weights(wanted) if slots is None else shares(wanted, max(slots, len(sizes)))
    # One turn more than a source has blocks: that of its first empty slot.
    turns = {r.source: min(-(-r.n // block_rows) + 1, slots_of[r.source]) for r in sizes}
    # The block after a source's last full or partial one: it has the source's first empty slot.
    beyond = {r.source: -(-r.n // block_rows) for r in sizes}
    schedule, place = schedule_table(spark, slots_of, turns, {s: b % slots_of[s] for s, b in beyond.items()})
    # A number beyond all blocks stands for any larger one.
    length = min(sum(slots_of.values()), 1 << 62)
    slots_of = {s: min(p, 1 << 62) for s, p in slots_of.items()}
    empty = min((b // slots_of[s]) * length + place[s] for s, b in beyond.items())

    # Rows before a part: those of the groups of parts before its own, and those before it in its group.
    # A window holds 256 rows at most, whatever a source has.
    grouped = parts.withColumn("_group", F.substring("_part", 1, 2))
    before = Window.partitionBy("source").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("source", "_group").agg(F.sum("_n").alias("_n")).select(
        F.col("source").alias("_s"), F.col("_group").alias("_g"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("source", "_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = grouped.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(
        groups, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_group") == F.col("_g"))).select(
        "source", "_part", (F.col("_start") + F.col("_inside")).alias("_offset"))
    within = Window.partitionBy("source", "_part").orderBy("_key", "doc_id", "_text")
    numbered = rows.withColumn("_i", F.row_number().over(within)).alias("d").join(
        offsets.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d._part") == F.col("o._part")))
    numbered = numbered.select("d.*", (F.col("_offset") + F.col("_i") - 1).alias("_i0"))
    per_source = spark.createDataFrame([(s, p) for s, p in slots_of.items()], "_s string, _p long")
    per_source = F.broadcast(per_source) if len(slots_of) <= CHUNK else per_source
    blocks = numbered.join(per_source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    blocks = blocks.withColumn("block", F.floor(F.col("_i0") / block_rows))
    placed = blocks.join(schedule, F.col("source").eqNullSafe(F.col("_s"))
                         & (F.col("block") % F.col("_p") == F.col("_turn")))
    slot = F.floor(F.col("block") / F.col("_p")) * length + F.col("_slot")
    return placed.select(
        *[F.col("_own").getField(c).alias(c) for c in docs.columns], "block", slot.alias("slot"), (slot * block_rows + F.col("_i0") % block_rows).alias("position"),
        (slot < empty).alias("balanced"))
