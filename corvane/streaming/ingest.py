"""Pages as they arrive: a file stream whose batches are upserted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators import extract, merge
from corvane.sources import pages
from corvane.sources.store import Store, numbered


def page_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """(source_file, source_page, text) of page files as they come."""
    stream = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_a_batch).load(folder)
    files = stream.select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("text"))
    return files.where(F.col("source_file").rlike(pages.PAGE_FILE)).withColumn("source_page", pages.page_number(F.col("source_file")))


def upsert_batch(store: Store, batch: DataFrame) -> None:
    """One change of the companies for one batch of pages. Upserting the same pages again changes no company's values,
    so a batch that is replayed after a failure does no harm."""
    rows = extract.companies(extract.picked(pages.records(batch))).where("accepted").persist()
    try:
        merged, _ = merge.upsert(store.read("companies"), rows)
        known = merged.where("ord.new = 0").withColumn("id", F.col("ord.id")).drop("ord")
        fresh = numbered(merged.where("ord.new = 1"), F.col("ord"), store.next_id("companies")).drop("ord")
        store.write(companies=known.unionByName(fresh))
    finally:
        rows.unpersist()


def start(store: Store, folder: str, checkpoint: str, once: bool = False, files_a_batch: int = 100) -> StreamingQuery:
    """Upserts pages as they arrive; ``once`` takes what there is and ends."""
    writer = page_stream(store.spark, folder, files_a_batch).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: upsert_batch(store, batch))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
