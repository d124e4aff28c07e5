"""Helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from ..session import new_folder, shared_folder

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables of one operator in the shared folder, each removed once nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` and gives the table to read in its place."""
        path = new_folder(self.spark, "scratch")
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = (kept, path)
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that ``keep`` gave."""
        for table in tables:
            remove_folder(self.spark, self.paths.pop(id(table))[1])

    def drop_all_but(self, *tables: DataFrame) -> None:
        self.drop(*[kept for kept, _ in self.paths.values() if not any(kept is t for t in tables)])


def few_parts(df: DataFrame, rows: int, each: int = 20_000) -> DataFrame:
    """Fewer tasks (and files) for a table that is known to be small; a large one stays as it is."""
    return df.coalesce(max(1, -(-rows // each)))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (upper and lower case taken as one, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_arrow(narrow: DataFrame) -> pa.DataType:
    """The Arrow type of the first column, whatever type the ids have."""
    return to_arrow_type(narrow.schema[0].dataType)


def remove_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: pa.Schema) -> DataFrame:
    """``mapInArrow`` with an Arrow schema; ``fn`` turns one batch into batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, from_arrow_schema(schema))


def null_last_min(*cols: str) -> "F.Column":
    """A sort key on which min() prefers real values to nulls."""
    return F.struct(*[x for c in cols for x in (F.col(c).isNull().alias(f"{c}_null"), F.col(c).alias(c))])
