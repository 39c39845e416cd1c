"""Repair of conversations: the cheapest edits that give a legal order of roles, by weighted CYK parsing.

Legal is an optional system turn and then pairs of a user's and an assistant's turn, or nothing. The grammar's
nonterminals ``<p, q>`` derive the turns that lead from role state p to q: ``<p, q> -> <p, r> <r, q>``, and for a
single turn keep, rerole or delete it. Insertions derive nothing, and every cell is closed under them on both
sides. A cell of a span of turns has for each nonterminal the least (cost, audit); audit spells the edits. Cells are
combined bottom-up, spans of one turn, two, four and so on. As a nonterminal names the states at both ends, one
split of a span gives its least cells, and neighbouring spans of any size can be combined: those of one task in its
memory, those of a long conversation over the cluster, 64 spans at a time.

Of two audits of a span with equal cost none begins with the other (what is longer has more insertions), so the
ASCII-least of the whole is made of the ASCII-least of its parts. The audit decides the roles: an odd number of
turns begins with a system turn, and the others alternate.

Null role and text are one space. Turns go by ``turn``, nulls first, then by role and text. A turn's fault is the
first of: blank (nothing but ASCII white space), duplicate (role and text seen earlier in the conversation), truncated
(its last character that is no white space is none of ``.!?``). Roles count by their first letter. Blank and
duplicate turns have to go. A null ``conv_id`` is a conversation as well. Repeated rows are counted, not listed, until
they are spelled as deletions. A conversation is spread over tasks by turn, role and text, and no task holds more of its
texts than some megabytes. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.llm.tables import written

#: ASCII white space.
WHITE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: Texts of a conversation that are held together, in characters, and its turns.
BLOCK_CHARS, BLOCK_TURNS = 1 << 20, 4096
#: Spans that one task combines.
FAN_IN = 64

# States: 0 nothing yet, 1 a system turn, 2 a user's turn, 3 an assistant's turn; 0 and 3 may end.
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
_ENDS = (0, 3)
_INSERTED = {(p, p): (0, "") for p in range(4)} | {
    (0, 2): (INSERT, "I"), (1, 2): (INSERT, "I"), (3, 2): (INSERT, "I"), (2, 3): (INSERT, "I"),
    (0, 3): (2 * INSERT, "II"), (1, 3): (2 * INSERT, "II")}


def joined(left: dict, right: dict) -> dict:
    """The cell of two neighbouring spans."""
    out = {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            more = right.get((r, q))
            if more is not None:
                found = (cost + more[0], audit + more[1])
                if (p, q) not in out or found < out[p, q]:
                    out[p, q] = found
    return out


@lru_cache(maxsize=64)
def turn_cell(letter: str) -> dict:
    """The cell of one turn: x has to go; s, u, a, o are roles, capital where the text is truncated."""
    edits = {(p, p): (DELETE, "D") for p in range(4)}
    if letter != "x":
        cut = CUT if letter.isupper() else 0
        for (p, role), q in _STEP.items():
            if role == letter.lower():
                edits[p, q] = min(edits.get((p, q), (99, "")), (KEEP + cut, "K"))
            if role != "s":
                edits[p, q] = min(edits.get((p, q), (99, "")), (REROLE + cut, "R"))
    return joined(joined(_INSERTED, edits), _INSERTED)


@lru_cache(maxsize=4096)
def _short_cell(letters: str) -> dict:
    if len(letters) == 1:
        return turn_cell(letters)
    half = 1 << (len(letters) - 1).bit_length() - 1
    return joined(_short_cell(letters[:half]), _short_cell(letters[half:]))


def combined(cells: list[dict]) -> dict:
    """Bottom-up: pairs of neighbours, then pairs of pairs, until one cell is left."""
    while len(cells) > 1:
        cells = [joined(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else dict(_INSERTED)


def span_cell(letters: str) -> dict:
    """The cell of a span of turns, given by their letters; short spans recur and are kept."""
    return combined([_short_cell(letters[i:i + 16]) for i in range(0, len(letters), 16)])


def cheapest(cell: dict) -> tuple[int, str]:
    return min(cell[0, q] for q in _ENDS if (0, q) in cell)


def applied(audit: str, turns: list[tuple[str, str]], before: int, odd: bool) -> list[tuple[str, str]]:
    """Turns after the edits of ``audit``, of which ``before`` turns of the result come earlier."""
    out, i = [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        place = before + len(out) - odd
        role = "user" if place % 2 == 0 else "assistant"
        if edit == "I":
            out.append((role, ""))
        else:
            out.append(turns[i] if edit == "K" else (role, turns[i][1]))
            i += 1
    return out


class Span(NamedTuple):
    """What is known about neighbouring turns of a conversation."""

    turns: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first: str            # first letters of the roles at both ends
    last: str
    least: int | None     # turn numbers
    most: int | None
    distinct: int
    cell: dict
    parts: list[tuple[int, int, int]]  # task, block and turns of each block


def spans_joined(a: Span, b: Span, cell: dict) -> Span:
    meet = a.last + b.first not in ("su", "ua", "au")
    same = a.most is not None and a.most == b.least
    return Span(a.turns + b.turns, a.blank + b.blank, a.duplicate + b.duplicate, a.truncated + b.truncated,
                a.illegal + b.illegal + meet, a.first, b.last, b.least if a.least is None else a.least,
                a.most if b.most is None else b.most, a.distinct + b.distinct - same, cell, a.parts + b.parts)


def spans_combined(spans: list[Span]) -> Span:
    whole = spans[0]
    for s in spans[1:]:
        whole = spans_joined(whole, s, {})
    return whole._replace(cell=combined([s.cell for s in spans]))


_COUNTS = ("turns", "blank", "duplicate", "truncated", "illegal")
_PARTS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("task", "block", "turns")]))
_CELL = T.ArrayType(T.StructType([T.StructField("p", T.LongType()), T.StructField("q", T.LongType()),
                                  T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))
_TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def _span_fields(turn_type: T.DataType) -> list[T.StructField]:
    return [*(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("first", T.StringType()),
            T.StructField("last", T.StringType()), T.StructField("least", turn_type), T.StructField("most", turn_type),
            T.StructField("distinct", T.LongType()), T.StructField("cell", _CELL), T.StructField("parts", _PARTS)]


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _span_row(s: Span) -> dict:
    row = s._asdict()
    row["cell"] = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in s.cell.items()]
    row["parts"] = [{"task": t, "block": b, "turns": n} for t, b, n in s.parts]
    return row


def _span_of(row: dict) -> Span:
    values = {f: row[f] for f in Span._fields}
    values["cell"] = {(e["p"], e["q"]): (e["cost"], e["audit"]) for e in row["cell"]}
    values["parts"] = [(e["task"], e["block"], e["turns"]) for e in row["parts"]]
    return Span(**values)


def last_character(text: Column) -> Column:
    """The last character that is no ASCII white space; empty where there is none."""
    return F.right(F.rtrim(text, F.lit(WHITE)), F.lit(1))


def faulty_turns(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """Distinct rows of the conversations with their ``copies``, as a stored table: ``earlier`` tells whether role and text
    were seen before, ``ending`` is the last character."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.lit(1) if copies is None else copies).cast("long").alias("copies")).where("copies > 0")
    listed = written(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn(
        "key", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))
    # A null turn comes before all others, as it does among structs.
    again = written(listed.groupBy("conv_id", "key").agg(F.min(F.struct("turn")).alias("start"), F.count("*").alias("n"))
                    .where("n > 1").select(F.col("conv_id").alias("again_conv"), F.col("key").alias("again_key"), "start"))
    met = listed.join(again, F.col("conv_id").eqNullSafe(F.col("again_conv")) & (F.col("key") == F.col("again_key")), "left")
    earlier = F.col("start").isNotNull() & ~F.col("start.turn").eqNullSafe(F.col("turn"))
    return met.select("conv_id", "turn", "role", "text", "copies", earlier.alias("earlier"),
                      last_character(F.col("text")).alias("ending"))


def parsed(turns: DataFrame, block_chars: int = BLOCK_CHARS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The output of the first pass over turns in order: conversations that are whole in a task, repaired (``open`` false,
    one row), and blocks of those that may go on in another task or are long (``open`` true)."""
    conv_type, turn_type = turns.schema["conv_id"].dataType, turns.schema["turn"].dataType
    schema = T.StructType([
        T.StructField("conv_id", conv_type), T.StructField("open", T.BooleanType()), T.StructField("task", T.LongType()),
        T.StructField("block", T.LongType()), *_span_fields(turn_type), T.StructField("cost", T.LongType()),
        T.StructField("audit", T.StringType()), T.StructField("texts", _TURNS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        rows_out: list[dict] = []
        size_out = 0
        task, conv, started, whole = None, None, False, False
        block, letters, held, chars = 0, [], [], 0
        stats = None

        def fresh():
            return {c: 0 for c in _COUNTS} | {"first": None, "last": None, "least": None, "most": None, "distinct": 0}

        def closed(is_open: bool) -> dict:
            """What is held, as a row."""
            nonlocal block, letters, held, chars, stats
            cell = span_cell("".join(letters))
            stats["turns"] = len(letters)
            span = Span(**stats, cell=cell if is_open else {}, parts=[(task, block, len(letters))])
            cost, audit = cheapest(cell)
            texts = held if is_open else applied(audit, held, 0, (len(audit) - audit.count("D")) % 2 == 1)
            row = _span_row(span) | {"conv_id": conv, "open": is_open, "task": task, "block": block,
                                     "cost": None if is_open else cost, "audit": None if is_open else audit,
                                     "texts": [{"role": r, "text": t} for r, t in texts]}
            block, letters, held, chars, stats = block + 1, [], [], 0, fresh()
            return row

        stats = fresh()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in
                       ("task", "conv_id", "turn", "role", "text", "copies", "earlier", "ending")]
            for own_task, c, turn, role, text, copies, earlier, ending in zip(*columns):
                task = own_task
                if not started or c != conv:
                    if letters:
                        # The first conversation of a task may begin in another one.
                        rows_out.append(closed(not whole or block > 0))
                        size_out += 1 + chars
                    whole, started, conv, block = started, True, c, 0
                initial = role[:1]
                first_letter = initial if initial in ("s", "u", "a") else "o"
                fault = "blank" if not ending else "duplicate" if earlier else "truncated" if ending not in ".!?" else None
                left = copies
                while left:
                    # Copies after the first are duplicates, or blank.
                    n = 1 if fault != "blank" and left == copies and not earlier else min(left, block_turns)
                    gone = fault == "blank" or earlier or left < copies
                    letter = "x" if gone else first_letter.upper() if fault == "truncated" else first_letter
                    letters.extend([letter] * n)
                    held.extend([("", "") if gone else (role, text)] * n)
                    chars += 0 if gone else len(text)
                    kind = "blank" if fault == "blank" else "duplicate" if gone else fault
                    if kind:
                        stats[kind] += n
                    stats["illegal"] += n - 1  # equal neighbours
                    if stats["first"] is None:
                        stats["first"] = first_letter
                    else:
                        stats["illegal"] += stats["last"] + first_letter not in ("su", "ua", "au")
                    stats["last"] = first_letter
                    if turn is not None:
                        if stats["least"] is None:
                            stats["least"] = turn
                        if stats["most"] is None or stats["most"] != turn:
                            stats["distinct"] += 1
                        stats["most"] = turn
                    left -= n
                    if chars >= block_chars or len(letters) >= block_turns:
                        rows_out.append(closed(True))
                        size_out = block_chars
                if size_out >= block_chars or len(rows_out) >= 1000:
                    yield pa.RecordBatch.from_pylist(rows_out, schema=arrow)
                    rows_out, size_out = [], 0
        if letters:
            rows_out.append(closed(True))  # it may go on in another task
        if rows_out:
            yield pa.RecordBatch.from_pylist(rows_out, schema=arrow)

    # Rows of equal keys stay in one task; longer texts would only burden the sample of keys.
    dealt = turns.repartitionByRange("conv_id", "turn", F.left("role", F.lit(8)), F.left("text", F.lit(16)))
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "role", "text").withColumn(
        "task", F.spark_partition_id().cast("long"))
    return ordered.mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """Neighbouring rows with equal keys."""
    group: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if group and any(group[0][k] != row[k] for k in keys):
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def folded(spans: DataFrame) -> DataFrame:
    """Spans (conv_id, task, block, ...) combined to one row for each conversation."""
    schema = T.StructType([f for f in spans.schema if f.name != "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        for group in _runs(batches, ("conv_id", "task")):
            done = _span_row(spans_combined([_span_of(r) for r in group]))
            yield pa.RecordBatch.from_pylist([done | {"conv_id": group[0]["conv_id"], "task": group[0]["task"]}], schema=arrow)

    def level(rows: DataFrame, up: Column, within: str) -> DataFrame:
        keyed = rows.withColumn("within", F.col(within)).withColumn("task", up)
        dealt = keyed.repartition("conv_id", "task").sortWithinPartitions("conv_id", "task", "within").drop("within")
        return written(dealt.mapInArrow(run, schema))

    most_blocks, most_tasks = spans.agg(F.max("block"), F.max("task")).first()
    if most_blocks is None:
        return spans.drop("block")
    # Places in order over all tasks; neighbours among them meet first.
    rows = spans.withColumn("task", F.col("task") * (most_blocks + 1) + F.col("block")).drop("block")
    highest = (most_tasks + 1) * (most_blocks + 1) - 1
    while highest > 0:
        highest //= FAN_IN
        rows = level(rows, F.floor(F.col("task") / FAN_IN).cast("long"), "task")
    return rows


def audited(spans: DataFrame) -> DataFrame:
    """Spans of whole conversations with ``cost`` and ``audit``."""
    ends = F.filter("cell", lambda e: (e.p == 0) & e.q.isin(*_ENDS))
    best = F.array_min(F.transform(ends, lambda e: F.struct(e.cost.alias("cost"), e.audit.alias("audit"))))
    return spans.withColumn("best", best).select("*", "best.cost", "best.audit").drop("best")


def audits_of_blocks(whole: DataFrame) -> DataFrame:
    """The part of a conversation's audit that belongs to each of its blocks, with the turns that come before it."""
    schema = T.StructType([
        T.StructField("conv_id", whole.schema["conv_id"].dataType), T.StructField("task", T.LongType()),
        T.StructField("block", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("before", T.LongType()),
        T.StructField("odd", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        for batch in batches:
            for row in batch.to_pylist():
                audit, at, before, out = row["audit"], 0, 0, []
                odd = (len(audit) - audit.count("D")) % 2 == 1
                for i, part in enumerate(row["parts"]):
                    end, seen = at, 0
                    while seen < part["turns"]:
                        seen += audit[end] != "I"
                        end += 1
                    if i + 1 == len(row["parts"]):
                        end = len(audit)
                    own = audit[at:end]
                    out.append({"conv_id": row["conv_id"], "task": part["task"], "block": part["block"], "audit": own,
                                "before": before, "odd": odd})
                    before, at = before + len(own) - own.count("D"), end
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return whole.select("conv_id", "audit", "parts").mapInArrow(run, schema)


def _repaired_blocks(blocks: DataFrame) -> DataFrame:
    schema = T.StructType([blocks.schema["conv_id"], T.StructField("before", T.LongType()), T.StructField("turns", _TURNS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                turns = applied(row["audit"], [(t["role"], t["text"]) for t in row["texts"]], row["before"], row["odd"])
                yield pa.RecordBatch.from_pylist([{
                    "conv_id": row["conv_id"], "before": row["before"],
                    "turns": [{"role": r, "text": t} for r, t in turns]}], schema=arrow)

    return blocks.select("conv_id", "texts", "audit", "before", "odd").mapInArrow(run, schema)


def repair_conversations(turns: DataFrame, copies: Column | None = None, block_chars: int = BLOCK_CHARS,
                         block_turns: int = BLOCK_TURNS) -> tuple[DataFrame, DataFrame]:
    """Repair conversations of (conv_id, turn, role, text); ``copies`` tells how often a row counts, once by default.

    Gives a report, with ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost`` and ``audit`` for each
    ``conv_id`` of the input, and the repaired turns in blocks: ``conv_id``, ``before`` (turns that come before the block)
    and ``turns``, an array of role and text. A conversation whose rows all count zero times has zeros, an empty audit
    and no block.
    """
    ready = faulty_turns(turns, copies)
    first = written(parsed(ready, block_chars, block_turns))
    whole = first.where(~F.col("open"))
    spans = first.where("open").select("conv_id", "task", "block", *Span._fields)
    long = written(audited(folded(spans)))
    slices = audits_of_blocks(long)
    raw = first.where("open").select(F.col("conv_id").alias("own_conv"), F.col("task").alias("own_task"),
                                     F.col("block").alias("own_block"), "texts")
    blocks = raw.join(slices, F.col("own_conv").eqNullSafe(F.col("conv_id")) & (F.col("own_task") == F.col("task"))
                      & (F.col("own_block") == F.col("block")))
    repaired = whole.select("conv_id", F.lit(0).cast("long").alias("before"), F.col("texts").alias("turns")).unionByName(
        _repaired_blocks(blocks))

    def count(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).cast("long").alias(name)

    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("distinct"), F.lit(0)).cast("long")
    fields = [gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    found = whole.select(F.col("conv_id").alias("found"), *fields).unionByName(
        long.select(F.col("conv_id").alias("found"), *fields))
    everyone = turns.select("conv_id").distinct()
    report = everyone.join(found, F.col("conv_id").eqNullSafe(F.col("found")), "left").select(
        "conv_id", *[count(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"))
    return report, repaired.where(F.size("turns") > 0)


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines.

    A hash of one text goes through it from its start, so the blocks of a conversation stream through one task, in order;
    of each, the task holds one block.
    """
    schema = T.StructType([repaired.schema["conv_id"], T.StructField("sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256
        arrow = _arrow(schema)
        conv, digest, done = None, None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if digest is None or row["conv_id"] != conv:
                    if digest is not None:
                        done.append({"conv_id": conv, "sha256": digest.hexdigest()})
                    conv, digest, joint = row["conv_id"], sha256(), ""
                for turn in row["turns"]:
                    digest.update(f"{joint}{turn['role']}:{turn['text']}".encode())
                    joint = "\n"
                if len(done) >= 1000:
                    yield pa.RecordBatch.from_pylist(done, schema=arrow)
                    done = []
        if digest is not None:
            done.append({"conv_id": conv, "sha256": digest.hexdigest()})
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=arrow)

    # Blocks without turns of their own (all deleted) would tie with the next one; they are not among the repaired.
    return repaired.repartition("conv_id").sortWithinPartitions("conv_id", "before").mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with the faults that the check number of (conv_id, turn) asks for, and the column that counts their copies.

    0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's. Nulls are one space.
    """
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    number = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = filled("text")
    rows = conversations.select(
        "conv_id", "turn", F.when(number == 4, "user").otherwise(filled("role")).alias("role"),
        F.when(number == 1, "").when(number == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(number == 0, 0).when(number == 3, 2).otherwise(1).alias("copies"))
    return rows, F.col("copies")
