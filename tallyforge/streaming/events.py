"""Streaming forms: windowed sums with a watermark, and payments met with the invoices that they name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import text
from tallyforge.operators.lineage import checkpoint_folder


def read_folder(spark, path: str, schema, files_a_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def windowed_sums(events: DataFrame, late: str | None = "2 days", length: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) per window; a window is final, and its state goes, once the watermark has passed it.

    late: None for a stream that has its watermark already, such as that of first_seen().
    """
    kept = events.withWatermark("ts", late) if late else events
    sums = kept.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def exact_payments(payments: DataFrame, inv: DataFrame) -> DataFrame:
    """Arriving payments with the invoice of their reference and amount; the invoices are a table that each batch reads anew."""
    known = inv.select("record_id", "total", text.norm_identifier(F.col("invoice_no")).alias("key")).where("key <> ''")
    keyed = payments.withColumn("key", text.norm_identifier(F.col("reference")))
    return keyed.join(known, "key").where(F.abs(F.col("total") - F.col("amount")) <= 1).select("txn_id", "record_id")


def first_seen(events: DataFrame, key: str = "event_id", late: str = "2 days") -> DataFrame:
    """Each key's first arrival; keys are forgotten once the watermark has passed them."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A folder's table as a stream of its Parquet files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all that has arrived: its batches' rows, or in the mode `complete` those of the last batch.

    Results and the stream's progress are written to the folder of checkpoints, so a run that broke off goes on there.
    """
    spark = stream.sparkSession
    path = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/{0 if mode == 'complete' else number}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out/*")
