"""Live prices and price alerts as Structured Streaming jobs over any tick source.

``live_snapshot`` and ``first_hits`` take any DataFrame and are the finished-table twins of the two streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidemark.functions.signals import price_alert_hit

TICK_SCHEMA = "symbol string, ts timestamp, price double, event_id bigint"


def read_ticks(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Ticks arriving as Parquet files in a folder."""
    reader = spark.readStream.schema(TICK_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def usable(ticks: DataFrame) -> DataFrame:
    """Ticks with a symbol, a time and a price that is a number."""
    return ticks.filter(F.col("symbol").isNotNull() & F.col("ts").isNotNull() & F.col("price").isNotNull() & ~F.isnan("price"))


def live_snapshot(ticks: DataFrame, previous_close: DataFrame) -> DataFrame:
    """Last price per symbol against its previous close; unusable ticks are skipped.

    The aggregate keeps one row of state per symbol; ticks are combined before the shuffle, so
    a symbol with most of the traffic costs no more than the others. Equal times resolve by id.
    """
    last = usable(ticks).groupBy("symbol").agg(F.max_by("price", F.struct("ts", "event_id")).alias("price"), F.max("ts").alias("ts"))
    prev = F.col("previous_close")
    change = F.when(prev > 0, (F.col("price") - prev) / F.when(prev > 0, prev) * 100).otherwise(0.0)
    return last.join(previous_close.select("symbol", "previous_close"), "symbol").select(
        "symbol", F.round("price", 2).alias("price"), F.round(prev, 2).alias("previous_close"), F.round(change, 2).alias("change_pct"), "ts")


SNAPSHOT_PARTS = 64  # folders of the snapshot table; a micro-batch rewrites those of its symbols only


def part_of(symbol: str = "symbol") -> Column:
    return F.pmod(F.xxhash64(symbol), F.lit(SNAPSHOT_PARTS)).cast("int")


def start_snapshot(ticks: DataFrame, previous_close: DataFrame, out: str, checkpoint: str, idle: str | None = None) -> StreamingQuery:
    """Keep the newest row of every symbol in the table ``out``, which is overwritten by symbol.

    A micro-batch brings the symbols whose row changed. It writes ``out/part=<p>/batch=<n>`` with all rows of the parts
    it touches: its own and those of the batch before. ``read_snapshot`` takes each part's last batch, so readers see a
    part whole, and a batch that is repeated after a crash replaces its own folders. With ``idle`` (an interval)
    ticks older than that behind the newest are late, and the state of a symbol without newer ticks is let go; its row stays.
    """
    spark = ticks.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("part", part_of()).persist()
        try:
            before = read_snapshot(spark, out, batch.schema, upto=batch_id - 1)
            rows = batch
            if before is not None:
                touched = before.join(F.broadcast(batch.select("part").distinct()), "part", "left_semi")  # at most SNAPSHOT_PARTS rows
                newest = F.max_by(F.struct(*batch.columns), F.struct("ts", "new")).alias("r")
                both = batch.withColumn("new", F.lit(1)).unionByName(touched.withColumn("new", F.lit(0)))
                rows = both.groupBy("symbol").agg(newest).select("r.*")
            (rows.withColumn("batch", F.lit(batch_id)).repartition("part").write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(out))
        finally:
            batch.unpersist()

    rows = ticks
    if idle:
        rows = ticks.withWatermark("ts", idle)
        last = usable(rows).groupBy("symbol", F.window("ts", idle)).agg(F.max_by("price", F.struct("ts", "event_id")).alias("price"), F.max("ts").alias("ts"))
        stream = last.writeStream.outputMode("update")

        def newest(batch: DataFrame, batch_id: int) -> None:  # a symbol may have a row for each open interval
            top = batch.groupBy("symbol").agg(F.max_by("price", "ts").alias("price"), F.max("ts").alias("ts")).withColumn("event_id", F.lit(0))
            write(live_snapshot(top, previous_close), batch_id)

        return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(newest).start()
    return (live_snapshot(rows, previous_close).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).foreachBatch(write).start())


def read_snapshot(spark: SparkSession, out: str, schema: StructType, upto: int | None = None) -> DataFrame | None:
    """The snapshot table: each part's last batch (not after ``upto``); None before the first one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    fields = [f for f in schema if f.name != "part"] + [StructField("part", IntegerType()), StructField("batch", LongType())]
    rows = spark.read.schema(StructType(fields)).parquet(out)
    if upto is not None:
        rows = rows.filter(F.col("batch") <= upto)
    last = rows.groupBy("part").agg(F.max("batch").alias("batch"))  # no more than SNAPSHOT_PARTS rows
    return rows.join(F.broadcast(last), ["part", "batch"], "left_semi").drop("batch")


def extremes(ticks: DataFrame) -> DataFrame:
    """Ticks that set a new high or low among those of their symbol in one Arrow batch: only these can be the first to
    reach a target. A symbol with most of the ticks goes through all tasks, and few of its ticks are left for the join.
    Nothing is shuffled, so the same function serves streams.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = frame.sort_values(["ts", "event_id"], kind="stable")
            price = rows.groupby("symbol", sort=False)["price"]
            new = ~rows.duplicated("symbol") | (rows["price"] > price.cummax().groupby(rows["symbol"], sort=False).shift()) | (
                rows["price"] < price.cummin().groupby(rows["symbol"], sort=False).shift())
            yield rows[new]

    rows = usable(ticks).select("symbol", "ts", "price", "event_id")
    return rows.mapInPandas(run, rows.schema)


def hits(ticks: DataFrame, alerts: DataFrame) -> DataFrame:
    """(alert_id, ts, price, event_id): ticks that reach the target of a pending alert, the first of each alert among them."""
    pending = alerts.filter(~F.col("triggered")).select("alert_id", F.col("ticker").alias("symbol"), "alert_type", F.col("price").alias("target"))
    return (extremes(ticks).join(pending, "symbol").filter(price_alert_hit(F.col("alert_type"), F.col("price"), F.col("target")))
            .select("alert_id", "ts", "price", "event_id"))


def first_hits(ticks: DataFrame, alerts: DataFrame) -> DataFrame:
    """Earliest tick that satisfies each pending alert (partial minimum per alert, then one row)."""
    first = F.min_by(F.struct("ts", "price"), F.struct("ts", "event_id"))
    return hits(ticks, alerts).groupBy("alert_id").agg(first.alias("f")).select(
        "alert_id", F.col("f.ts").alias("triggered_at"), F.col("f.price").alias("triggered_price"))


FIRED = "alert_id string, triggered_at timestamp, triggered_price double"


class Latch(StatefulProcessor):
    """One row of state per alert, from its first hit on: the alert is spent and later or late ticks change nothing."""

    def init(self, handle) -> None:
        self.spent = handle.getValueState("spent", FIRED.split(", ", 1)[1])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.spent.exists():
            return
        best = None
        for frame in rows:
            first = frame.sort_values(["ts", "event_id"]).iloc[0]
            if best is None or (first["ts"], first["event_id"]) < (best["ts"], best["event_id"]):
                best = first
        self.spent.update((best["ts"].to_pydatetime(), float(best["price"])))
        yield pd.DataFrame({"alert_id": [key[0]], "triggered_at": [best["ts"]], "triggered_price": [float(best["price"])]})

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Keyed state of arbitrary size needs the RocksDB store; a stream keeps the settings of its start."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def start_alert_latch(ticks: DataFrame, alerts: DataFrame | Callable[[], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Fire each alert once, as files of ``FIRED`` rows in ``out``; the file sink's log makes each row appear once.

    ``alerts`` may be a DataFrame over files, or a function that makes one at the start; alerts that are added to such a
    table are seen by the next start from the same checkpoint. Unusable ticks never fire.
    """
    with rocks(ticks.sparkSession):
        fired = hits(ticks, alerts() if callable(alerts) else alerts).groupBy("alert_id").transformWithStateInPandas(
            Latch(), FIRED, outputMode="Append", timeMode="None")
        return (fired.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())
