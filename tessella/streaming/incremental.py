"""Incremental linkage (an extension): new target records arrive as a stream of files
and are joined to the standing queries batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import normalize
from ..operators.blocking import by_pin_number, exact_names
from ..operators.candidates import union
from ..sources.tables import RECORD


def link_stream(spark: SparkSession, path: str, queries: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append (s1_id, cand_id, strategies, batch) for the targets that land in path.

    Within a batch pairs are distinct; a record that is delivered again gives its
    pairs again under another batch, so a reader takes the first batch of a pair.
    """

    def link(batch: DataFrame, number: int) -> None:
        from pyspark.sql import functions as F

        new = normalize(batch.na.fill(""))
        pairs = union({"exact_name": exact_names(queries, new), "address": by_pin_number(queries, new)})
        pairs.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    stream = spark.readStream.schema(RECORD).options(sep="\t", header=True).csv(path)
    return stream.writeStream.foreachBatch(link).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
