"""Where a job keeps what it uses more than once."""

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_folder(spark: SparkSession, name: str | None = None) -> str:
    """A folder name that all machines share: under the session's ``spark.checkpoint.dir``, else its warehouse.

    It is a new one where no ``name`` is given. The session's own settings stay as they are.
    """
    top = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
           or spark.conf.get("spark.sql.warehouse.dir"))
    return f"{top.rstrip('/')}/pagelode/{name or uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows as a Parquet table, in a new shared folder if none is given.

    What follows reads files, so a lost executor costs no earlier step again, and only the columns it needs.
    """
    path = folder or shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder of that name, or of that pattern, is there; in whatever store the path names."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return found is not None and len(found) > 0


class StoredStages:
    """The tables of a run by name, each with a marker that is written when the table is whole.

    A run that is started again under the same folder takes the tables that have their marker and makes the others,
    over whatever a broken attempt has left. ``parameters`` are those of the first attempt; other ones are an error, since
    its tables would not fit them. Without a folder the tables go to new ones and need no markers.
    """

    def __init__(self, spark: SparkSession, folder: str | None, parameters: dict[str, str | None]):
        self.spark, self.folder = spark, folder
        self.made: list[str] = []
        known = self.value("run", lambda: json.dumps(parameters))
        if json.loads(known) != parameters:
            raise ValueError(f"the run in {folder} has other parameters: {known}")

    def _marker(self, name: str) -> str | None:
        path = f"{self.folder}/{name}.done"
        if not path_exists(self.spark, path):
            return None
        rows = self.spark.read.schema("value string").json(path).collect()  # one row
        return rows[0].value if rows else None

    def _mark(self, name: str, value: str) -> None:
        self.spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").json(
            f"{self.folder}/{name}.done")

    def value(self, name: str, make: Callable[[], str]) -> str:
        """A small text that stays as the first attempt has made it."""
        known = self._marker(name) if self.folder else None
        if known is None:
            known = make()
            if self.folder:
                self._mark(name, known)
        return known

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of a stage: read if it is whole, else made."""
        known = self._marker(name) if self.folder else None
        if known is None:
            self.made.append(name)
            if not self.folder:
                return written(make())
            df = make()
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
            known = df.schema.json()
            self._mark(name, known)
        return self.spark.read.schema(T.StructType.fromJson(json.loads(known))).parquet(f"{self.folder}/{name}")
