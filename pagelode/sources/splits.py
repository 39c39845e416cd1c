"""Large files whose records hold their own separators: read by many tasks, cut where a record ends.

A file is read in pieces, split at a separator by Spark's text source, which cuts files in blocks. Whether a piece is inside
a quoted text, and how deep in brackets, depends on all that comes before it in the file. Each piece tells what it does to
that state; running sums go over the pieces of a block, then over the blocks of a file, of which there are few. With
them every piece knows its record, and records of several pieces are put together.

The pieces are stored once, in the shared folder, with their places. Only numbers go through the windows.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.plans.storage import written

_PLACE = ("file", "block", "id")
_CSV_OPTIONS = {"escape": '"', "multiLine": "true"}


def pieces_of(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """Pieces of files between separators as a stored table: ``value``, and ``file``, ``block`` and ``id`` in file order."""
    text = spark.read.option("lineSep", separator).text(path)
    return written(text.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id")))


def _in_block() -> WindowSpec:
    return Window.partitionBy("file", "block").orderBy("id")


def _before_block(value: Column) -> Column:
    rows = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(rows), F.lit(0))


def _earlier(value: Column) -> Column:
    return F.coalesce(F.sum(value).over(_in_block().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _so_far(value: Column) -> Column:
    return F.sum(value).over(_in_block().rowsBetween(Window.unboundedPreceding, 0))


def _occurrences(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _records(pieces: DataFrame, numbers: DataFrame, separator: str) -> DataFrame:
    """(file, record, value) of every record; ``numbers`` has the places of the pieces with their record.

    Pieces that are a record of their own, most of them, are taken as they are.
    """
    sizes = numbers.groupBy("file", "record").agg(F.count("*").alias("n"))
    known = written(numbers.join(sizes, ["file", "record"]))
    single = pieces.join(known.where("n = 1").drop("n"), list(_PLACE)).select("file", "record", "value")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "id", "value"))), lambda p: p["value"])
    several = pieces.join(known.where("n > 1").drop("n"), list(_PLACE)).groupBy("file", "record").agg(
        F.array_join(parts, separator).alias("value"))
    return single.unionByName(several)


# --- CSV -------------------------------------------------------------------------

def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, value) of CSV files whose quoted values may hold line breaks; ``record`` counts from 1.

    A line begins a record where an even number of quotes comes before it; a doubled quote counts as two.
    """
    lines = pieces_of(spark, path, "\n")
    slim = lines.select(*_PLACE, _occurrences(F.col("value"), '"').alias("quotes")).withColumn(
        "odd", _earlier(F.col("quotes")) % 2)
    # Records that begin up to here, if the block begins outside a quoted value, and if inside one.
    slim = written(slim.select(*_PLACE, "quotes", "odd", *[
        _so_far((F.col("odd") == s).cast("int")).alias(f"begun{s}") for s in (0, 1)]))
    blocks = slim.groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"), *[F.max(f"begun{s}").alias(f"begun{s}") for s in (0, 1)])
    blocks = blocks.withColumn("inside", _before_block(F.col("quotes")) % 2)
    blocks = blocks.withColumn("before", _before_block(F.when(F.col("inside") == 0, F.col("begun0")).otherwise(F.col("begun1"))))
    own = F.when(F.col("inside") == 0, F.col("begun0")).otherwise(F.col("begun1"))
    numbers = slim.join(blocks.select("file", "block", "inside", "before"), ["file", "block"]).select(
        *_PLACE, (F.col("before") + own).alias("record"))
    found = _records(lines, numbers, "\n")
    return found.withColumn("value", F.regexp_replace("value", r"\r\z", "")).where("value <> ''")


def read_csv_split(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV files with a header, each read by many tasks, whatever line breaks their values hold.

    Without a schema the columns are those of the header, as text.
    """
    records = csv_records(spark, path)
    if schema is None:
        first = records.where("record = 1").orderBy("file").first()
        if first is None:
            return spark.createDataFrame([], T.StructType())
        row = spark.range(1).select(F.from_csv(F.lit(first.value), ", ".join(
            f"c{i} string" for i in range(first.value.count(",") + 1)), _CSV_OPTIONS).alias("h")).first().h
        schema = T.StructType([T.StructField(c, T.StringType()) for c in row if c is not None])
    rows = records.where("record > 1").select(F.from_csv("value", _ddl(schema), _CSV_OPTIONS).alias("row"))
    return rows.select("row.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)


# --- JSON ------------------------------------------------------------------------

def _depth_change(bare: Column, inside: int) -> Column:
    """What a piece without escapes adds to the depth of brackets, if it begins ``inside`` a text (1) or not (0).

    Between quotes, text and markup take turns.
    """
    markup = F.array_join(F.filter(F.split(bare, '"'), lambda _, i: i % 2 == inside), "")
    return _occurrences(markup, "{[") - _occurrences(markup, "}]")


def json_array_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, value) of files that each hold one JSON array of objects, as the text of each object.

    Pieces end at closing braces; a record ends with the brace that leads back into the array.
    """
    pieces = pieces_of(spark, path, "}")
    # An escaped character, also an escaped quote, tells nothing; a brace cannot be escaped.
    bare = F.regexp_replace("value", r"\\.", "")
    slim = pieces.select(*_PLACE, bare.alias("bare")).select(
        *_PLACE, (_occurrences(F.col("bare"), '"') % 2).alias("quotes"),
        *[_depth_change(F.col("bare"), s).alias(f"change{s}") for s in (0, 1)])
    slim = slim.withColumn("odd", _earlier(F.col("quotes")) % 2)

    def change(state: Column) -> Column:
        """With its closing brace, which counts where the piece ends outside a text."""
        closing = F.when((state + F.col("quotes")) % 2 == 0, 1).otherwise(0)
        return F.when(state == 0, F.col("change0")).otherwise(F.col("change1")) - closing

    slim = written(slim.select(*_PLACE, "quotes", "odd", *[
        _so_far(change((F.col("odd") + s) % 2)).alias(f"depth{s}") for s in (0, 1)]))
    totals = [F.max_by(f"depth{s}", "id").alias(f"depth{s}") for s in (0, 1)]
    blocks = slim.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), *totals)
    blocks = blocks.withColumn("inside", _before_block(F.col("quotes")) % 2)
    own = F.when(F.col("inside") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    blocks = blocks.withColumn("depth", _before_block(own)).select("file", "block", "inside", "depth")
    state = (F.col("odd") + F.col("inside") + F.col("quotes")) % 2
    ends = ((state == 0) & (F.col("depth") + own == 1)).cast("int")
    ended = written(slim.join(blocks, ["file", "block"]).select(*_PLACE, ends.alias("ends")).select(
        *_PLACE, "ends", _earlier(F.col("ends")).alias("earlier")))
    counts = ended.groupBy("file", "block").agg(F.sum("ends").alias("ends"))
    counts = counts.select("file", "block", _before_block(F.col("ends")).alias("before"), "ends")
    total = counts.groupBy("file").agg(F.sum("ends").alias("total"))
    # What follows the last record is none.
    numbers = ended.drop("ends").join(counts.drop("ends"), ["file", "block"]).join(total, "file").select(
        *_PLACE, (F.col("before") + F.col("earlier") + 1).alias("record"), "total").where("record <= total").drop("total")
    found = _records(pieces, numbers, "}")
    # The array's own bracket and the commas between records come before the first brace.
    return found.select("file", "record", F.concat(F.substring("value", F.instr("value", "{"), F.length("value")), F.lit("}")).alias("value"))


def read_json_array_split(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files that each hold one JSON array of objects, each read by many tasks."""
    rows = json_array_records(spark, path).select(F.from_json("value", schema).alias("row"))
    return rows.select("row.*")
