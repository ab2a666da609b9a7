"""Index upkeep as a stream: arriving snapshot files re-index the manuals they touch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docfathom.operators import index


def follow_snapshots(spark: SparkSession, source: str, path: str, checkpoint: str, all_rows: Callable[[], DataFrame], schema: str) -> StreamingQuery:
    """A query over the Parquet files under ``source``: each batch re-indexes its manuals from their latest rows.

    ``all_rows`` gives the delivered rows so far. Postings, lengths, frequencies and sums of a manual are written together,
    and again give the same rows, so a batch repeated after a failure does no harm. Late rows only cause their manual to
    be indexed again.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def handle(batch: DataFrame, _: int) -> None:
        touched = batch.select("manual_id").distinct()
        own = all_rows().join(touched, "manual_id", "left_semi")
        index.reindex(index.latest_documents(own).withColumn("doc_id", F.col("row_id")), path)

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
