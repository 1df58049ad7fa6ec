"""Incremental maintenance of the activity cube with Structured Streaming.

The cube of ``operators.cube`` is keyed by distances to one ``end`` date, so
it cannot be kept up to date as events arrive.  What can be is the
end-independent *daily* table: per (user, sku, cate, brand, type, calendar
day) the event count, how many of those events were exactly at midnight, both
also for the listed model ids, and the first / last non-midnight time.  For any midnight ``end`` the cube
follows exactly: a day at calendar distance c contributes its midnight events
with elapsed days b = c and the rest with b = c - 1.

The stream is stateless: every micro-batch aggregates only its new files and
writes the partial table under ``batch=<id>`` (overwrite, so a replayed batch
after a failure is idempotent); readers merge partials with one more
aggregate.  No state store grows with the data and no watermark has to hold
a day open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopcast import schemas
from shopcast.functions.timebins import date_lit

DAY_KEYS = ("user_id", "sku_id", "cate", "brand", "type", "day")


def daily_partials(actions: DataFrame) -> DataFrame:
    """Daily aggregate of a batch of actions (batch or micro-batch)."""
    mid = F.col("time") == F.col("day").cast("timestamp_ntz")
    models = [c for v in schemas.MODEL_IDS for c in (
        F.count(F.when(F.col("model_id") == v, 1)).alias(f"m_{v}"),
        F.count(F.when((F.col("model_id") == v) & mid, 1)).alias(f"m_mid_{v}"))]
    return (actions.select("user_id", "sku_id", "cate", "brand", "type", "time", "model_id",
                           F.to_date("time").alias("day"))
                   .groupBy(*DAY_KEYS)
                   .agg(F.count(F.lit(1)).alias("n"),
                        F.count(F.when(mid, 1)).alias("n_mid"),
                        F.min(F.when(~mid, F.col("time"))).alias("t_min_nm"),
                        F.max(F.when(~mid, F.col("time"))).alias("t_max_nm"), *models))


def merge_partials(partials: DataFrame) -> DataFrame:
    """Merge partial daily rows written by different micro-batches."""
    return partials.groupBy(*DAY_KEYS).agg(F.sum("n").alias("n"), F.sum("n_mid").alias("n_mid"),
                                           F.min("t_min_nm").alias("t_min_nm"),
                                           F.max("t_max_nm").alias("t_max_nm"),
                                           *[F.sum(f"{p}_{v}").alias(f"{p}_{v}") for v in schemas.MODEL_IDS
                                             for p in ("m", "m_mid")])


def cube_from_daily(daily: DataFrame, end, start=None, models=()) -> DataFrame:
    """The activity cube for ``[start, end)`` (midnights) from the daily table;
    ``models`` adds the counts of those model ids."""
    cond = F.col("day") < date_lit(end)
    if start is not None:
        cond = cond & (F.col("day") >= date_lit(start))
    d = daily.filter(cond).withColumn("c", F.datediff(date_lit(end), F.col("day")))
    keys = ["user_id", "sku_id", "cate", "brand", "type", "c"]
    later = d.filter(F.col("n") > F.col("n_mid")).select(
        *keys, (F.col("c") - 1).alias("b"), (F.col("n") - F.col("n_mid")).alias("n"),
        F.col("t_min_nm").alias("t_min"), F.col("t_max_nm").alias("t_max"),
        *[(F.col(f"m_{v}") - F.col(f"m_mid_{v}")).alias(f"m_{v}") for v in models])
    midnight = d.filter(F.col("n_mid") > 0).select(
        *keys, F.col("c").alias("b"), F.col("n_mid").alias("n"),
        F.col("day").cast("timestamp_ntz").alias("t_min"), F.col("day").cast("timestamp_ntz").alias("t_max"),
        *[F.col(f"m_mid_{v}").alias(f"m_{v}") for v in models])
    return later.unionByName(midnight)


def start_daily_cube(spark: SparkSession, source_path: str, sink_path: str, checkpoint_path: str,
                     schema=schemas.ACTION, available_now: bool = True, max_files_per_trigger: int | None = None):
    """Run the file-stream -> daily partials job.  ``available_now`` processes
    everything present and stops (scheduled incremental runs); otherwise it
    keeps running on new files."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_path)

    def write_batch(df: DataFrame, batch_id: int) -> None:
        daily_partials(df).write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/batch={batch_id}")

    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_path)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def read_daily(spark: SparkSession, sink_path: str) -> DataFrame:
    return merge_partials(spark.read.parquet(sink_path).drop("batch"))
