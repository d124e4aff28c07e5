"""Streams that write to kept tables.

Uploads may bring any old bucket at any time, so these streams have no watermark: a late row is an upsert like any other.
Every write is idempotent, so a batch that is repeated after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.upserts import new_buckets
from ..operators.usage import sums
from ..schema import BUCKET, TOKENS, UPLOAD
from ..store import SnapshotStore

class BucketTable:
    """Half-hour buckets and their daily rollups as a SnapshotStore. An upsert reads and rewrites the touched days alone, and readers see all of it or nothing."""

    #: Versions after which old ones are removed.
    VACUUM_EVERY = 50

    def __init__(self, spark: SparkSession, path: str):
        self.store = SnapshotStore(spark, path)

    def read(self) -> DataFrame:
        return self.store.open().read("buckets")

    def upsert(self, batch: DataFrame) -> None:
        """Takes rows of schema.BUCKET with ``seq``. A batch that is repeated after a failure changes nothing, wherever the failure was."""
        version = self.store.upsert_buckets(batch).version
        if version % self.VACUUM_EVERY == 0:
            self.store.vacuum()


def upload_stream(spark: SparkSession, landing: str) -> DataFrame:
    """JSON uploads (gzip or plain) that land in a folder, with host_id, upload_id and received_at as their sender wrote them."""
    schema = f"upload_id BIGINT, host_id STRING, received_at TIMESTAMP, {UPLOAD.toDDL()}"
    return spark.readStream.schema(schema).json(landing)


def keep_uploads(uploads: DataFrame, table: BucketTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Upserts the buckets of every micro-batch."""
    return keep_rows(new_buckets(uploads).select(*[f.name for f in BUCKET.fields], "seq"), table, checkpoint, **trigger)


def keep_rows(rows: DataFrame, table: BucketTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Upserts a stream of schema.BUCKET with ``seq``; arrival in a later micro-batch counts as later."""
    writer = rows.writeStream.foreachBatch(lambda batch, _: table.upsert(batch)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def windowed_usage(entries: DataFrame, *keys: str, late: str | None = None) -> DataFrame:
    """A running aggregate of a stream of entries: tumbling half hours. Start it in update mode.

    Without ``late`` every half hour is kept for ever, as any may still grow; with it (such as "2 days") older ones leave the state and what comes later is
    dropped. For usage that may come at any time without bound, write to a BucketTable (keep_rows), whose state is the table.
    """
    entries = entries.withWatermark("at", late) if late else entries
    by = [*keys, "source", "model", "project", F.window("at", "30 minutes").alias("w")]
    rows = entries.groupBy(*by).agg(*sums(*TOKENS))
    return rows.withColumn("bucket_start", F.col("w.start")).drop("w")
