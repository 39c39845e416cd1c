"""Exports as JSON and CSV, and the snapshots they leave."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode import schema as S
from pagelode.operators.stats import distinct_keys
from pagelode.plans.storage import path_exists
from pagelode.sources.splits import read_csv_split, read_json_array_split

#: The list of an export's files, which is written when all of them are whole.
MANIFEST = "manifest"
MANIFEST_SCHEMA = ("success boolean, format string, path string, record_count bigint, error string, run_ts string")
#: Columns that an export of records may have.
MOST_COLUMNS = 10_000

CSV_OPTIONS = {"header": True, "escape": '"', "encoding": "UTF-8"}


def snapshot_name(fmt: str, base: str = S.EXPORT_NAME, run_time: datetime | None = None) -> str:
    """K5: ``base_YYYYMMDD_HHMMSS.ext``, or ``base.ext`` without a time."""
    stamp = f"_{run_time:%Y%m%d_%H%M%S}" if run_time else ""
    return f"{base}{stamp}.{fmt.lstrip('.')}"


def require_rows(df: DataFrame) -> None:
    """K6: an export without rows is an error."""
    if df.isEmpty():
        raise ValueError("nothing to export: the table has no rows")


def csv_columns(columns: list[str]) -> list[str]:
    """K2: the five leading columns that exist, then the others by name."""
    first = [c for c in S.CSV_FIRST_COLUMNS if c in columns]
    return first + sorted(set(columns) - set(first))


def csv_rows(df: DataFrame) -> DataFrame:
    """K2, K3: every column as CSV text in CSV order.

    Null becomes empty, booleans Yes or No, nested values JSON.
    """
    def text(field: T.StructField) -> Column:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.BooleanType):
            value = F.when(col, "Yes").when(~col, "No")
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(col)
        else:
            value = col.cast("string")
        return F.coalesce(value, F.lit("")).alias(field.name)

    fields = {f.name: f for f in df.schema.fields}
    return df.select(*[text(fields[c]) for c in csv_columns(df.columns)])


def write_json(df: DataFrame, path: str) -> None:
    """K1: one JSON object per row, nulls kept, text in UTF-8."""
    df.write.option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """K2, K3: CSV with a header in every file."""
    (csv_rows(df).write.options(**CSV_OPTIONS).option("emptyValue", "").option("nullValue", "")
     .csv(path))


def export(df: DataFrame, out_dir: str, base: str = S.EXPORT_NAME,
           run_time: datetime | None = None) -> DataFrame:
    """K1-K6, K8: JSON and CSV of one table, and one row about each.

    ``df`` is computed once per format: pass a stored table where that is dear, as the catalogue
    job does. ``run_time`` defaults to now. A format that cannot be written gives a row with the error
    and does not keep the other from being written; ``record_count`` counts the rows as they are written.

    When both are there, a manifest that names them is written last: an export with a manifest is whole. An export whose
    manifest is there is not written again; its rows come from the manifest.
    """
    require_rows(df)
    run_time = run_time or datetime.now()
    spark = df.sparkSession
    manifest = f"{out_dir}/{snapshot_name(MANIFEST, base, run_time)}"
    done = _manifest_rows(spark, manifest)
    if done is not None:
        return done.select("success", "format", "path", "record_count", "error")
    results = []
    for fmt, write in (("json", write_json), ("csv", write_csv)):
        path = f"{out_dir}/{snapshot_name(fmt, base, run_time)}"
        seen = Observation()
        try:
            write(df.observe(seen, F.count(F.lit(1)).alias("n")), path)
            results.append((True, fmt, path, seen.get["n"], None))
        except Exception as e:  # told to the caller as a row
            results.append((False, fmt, path, 0, str(e).splitlines()[0][:500] if str(e) else type(e).__name__))
    told = spark.createDataFrame(
        results, "success boolean, format string, path string, record_count bigint, error string")
    if all(r[0] for r in results):
        told.withColumn("run_ts", F.lit(f"{run_time:%Y%m%d_%H%M%S}")).coalesce(1).write.json(manifest)
    return told


def _manifest_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """What manifests say; null where there is none."""
    return spark.read.schema(MANIFEST_SCHEMA).json(path) if path_exists(spark, path) else None


def whole_exports(spark: SparkSession, out_dir: str, base: str = S.EXPORT_NAME) -> DataFrame:
    """K7, K8: ``run_ts``, ``format``, ``path`` and ``record_count`` of the exports that are whole, from their manifests."""
    found = _manifest_rows(spark, f"{out_dir}/{base}_*.{MANIFEST}")
    rows = spark.createDataFrame([], MANIFEST_SCHEMA) if found is None else found
    return rows.select("run_ts", "format", "path", "record_count")


def newest_export(spark: SparkSession, out_dir: str, fmt: str = "json", base: str = S.EXPORT_NAME) -> str | None:
    """The path of the newest whole export of a format; null where there is none."""
    last = whole_exports(spark, out_dir, base).where(F.col("format") == fmt).orderBy(F.desc("run_ts")).first()
    return last.path if last else None


def record_columns(records: DataFrame, values: Column, most: int = MOST_COLUMNS) -> list[str]:
    """K2 of records with differing keys: the union of the keys of a map column, in CSV order.

    A table cannot have columns without end: more than ``most`` keys are an error, not cut off.
    """
    found = [r.key for r in distinct_keys(records, values).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"the records have more than {most} keys; export them as JSON, or ask for more columns")
    return csv_columns(found)


def records_as_rows(records: DataFrame, values: Column, most: int = MOST_COLUMNS) -> DataFrame:
    """Records in a map column as rows with a column for every key that any of them has; null where one lacks it."""
    return records.select(*[F.try_element_at(values, F.lit(k)).alias(k) for k in record_columns(records, values, most)])


def write_csv_records(records: DataFrame, values: Column, path: str, most: int = MOST_COLUMNS) -> None:
    """K2, K3 for records with differing keys. They are read twice: for their keys, and to be written."""
    write_csv(records_as_rows(records, values, most), path)


def read_json_export(spark: SparkSession, path: str, schema: T.StructType = S.PRODUCT_SCHEMA,
                     array: bool = False, split: bool = False) -> DataFrame:
    """A JSON export; ``array`` reads files that each hold one JSON array.

    Spark reads such a file in one task; ``split`` has many tasks read it, which pays for large files.
    """
    if array and split:
        return read_json_array_split(spark, path, schema)
    return spark.read.schema(schema).option("multiLine", array).json(path)


def read_csv_export(spark: SparkSession, path: str, schema: T.StructType | None = None, split: bool = False) -> DataFrame:
    """A CSV export. Columns are matched by the header where no schema is given.

    As values hold line breaks, Spark reads each file in one task; ``split`` has many tasks read a large one.
    """
    if split:
        return read_csv_split(spark, path, schema)
    reader = spark.read.options(**CSV_OPTIONS).option("multiLine", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def list_snapshots(spark: SparkSession, out_dir: str, base: str = S.EXPORT_NAME,
                   fmt: str = "json") -> DataFrame:
    """K7: the exports of a folder by run time."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", f"*.{fmt}").load(out_dir).select("path"))
    pattern = rf"^(.*/{base}_(\d{{8}}_\d{{6}})\.{fmt})/[^/]+$"
    return files.select(F.regexp_extract("path", pattern, 1).alias("path"),
                        F.regexp_extract("path", pattern, 2).alias("run_ts")
                        ).where(F.col("run_ts") != "").distinct()


def mark_kept(snapshots: DataFrame, keep: int = 5, by: str = "run_ts") -> DataFrame:
    """K7: which runs to keep, the newest ``keep``; removing the others is up to the caller.

    The kept runs are a table of ``keep`` rows, found by each task from its own rows first.
    """
    newest = snapshots.select(by).distinct().orderBy(F.desc(by)).limit(keep)
    kept = F.broadcast(newest.withColumn("kept", F.lit(True)))
    return snapshots.join(kept, by, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
