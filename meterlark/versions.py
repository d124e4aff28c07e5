"""Small tables that are rewritten as a whole: each write is a new version, and readers take the newest that is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class VersionedTable:
    """A folder with a folder for each version. A write that fails leaves the version before it in force."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keep: int = 2):
        self.spark, self.path, self.schema, self.keep = spark, path, schema, keep
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the complete versions, ascending."""
        if not self._files.exists(self._path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(self.path))]
        found = [int(n[2:]) for n in names if n.startswith("v-") and n[2:].isdigit()]
        return sorted(n for n in found if self._files.exists(self._path(f"{self.path}/v-{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        """The newest version; no rows where there is none yet."""
        found = self.versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v-{found[-1]}") if found else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame) -> int:
        """Makes ``rows`` (which may come from read()) the newest version and removes those that are ``keep`` versions old."""
        found = self.versions()
        number = found[-1] + 1 if found else 1
        rows.write.mode("overwrite").parquet(f"{self.path}/v-{number}")  # overwrites what a failed write has left
        for old in [n for n in found if n <= number - self.keep]:
            self._files.delete(self._path(f"{self.path}/v-{old}"), True)
        return number
