"""Incremental runs over pages as they land (Structured Streaming).

The reference has no streaming operators; what streams here is the input:
pages arrive in a folder over time, and each micro-batch is run through the
same batch operators (``foreachBatch``). Dedup over all batches keeps each batch's first rows
(``start_first_wins``); their survivors are read by ``dims.merged_firsts``.

Exactly-once: the stream's progress is in ``checkpoint``, which the caller
names, and every batch overwrites only its own ``batch_id=<n>`` partition, so
a replayed batch rewrites the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dims as D
from ..operators import html as H
from ..operators import links as L
from ..sources.io import PAGE_SCHEMA


def page_links(pages: DataFrame) -> DataFrame:
    """The per-batch job: links of the landed pages, resolved against the
    page URL (L1-L3)."""
    lk = L.extract_links(H.shred(pages))
    return lk.join(pages.select(H.PID, F.col("url").alias("page_url")), H.PID) \
             .withColumn("url", L.resolve_url("page_url", "href"))


def start_landing(spark: SparkSession, landing_dir: str, out_dir: str,
                  job: Callable[[DataFrame], DataFrame] = page_links,
                  *, checkpoint: str, available_now: bool = True,
                  max_files_per_trigger: int = 100):
    """Run ``job`` on every micro-batch of pages landing in ``landing_dir``
    (parquet files with page_id, url, html) and append the result to
    ``out_dir`` partitioned by batch. ``checkpoint`` names the folder of the
    stream's progress in shared storage; a restart must pass the same one.
    Returns the StreamingQuery."""
    src = (spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(landing_dir))

    def run(batch: DataFrame, batch_id: int) -> None:
        out = job(batch).withColumn("batch_id", F.lit(batch_id))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(out_dir))

    w = (src.writeStream.foreachBatch(run)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def start_first_wins(spark: SparkSession, landing_dir: str, schema: str, out_dir: str, keys: list[str], order: list[str],
                     *, checkpoint: str, max_files_per_trigger: int = 100):
    """D1 / L8 on a stream: the first row of each key over all batches. A batch writes its own first rows to its own
    folder, so a replayed batch rewrites the same rows; ``dims.merged_firsts(out_dir)`` gives the survivors so far."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(landing_dir)

    def run(batch: DataFrame, batch_id: int) -> None:
        D.land_firsts(out_dir, batch_id, batch, keys, order)

    return src.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
