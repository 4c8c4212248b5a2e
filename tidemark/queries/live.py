"""The streaming jobs over the sample events as a file stream, run to its end."""

import uuid

from pyspark.sql import functions as F

from tidemark.queries.oracle_ctes import CTES
from tidemark.queries.registry import query
from tidemark.streaming import live

CTES["prevclose"] = """
SELECT symbol, max_by(price, epoch_us(ts)*1.0) AS previous_close FROM ticks WHERE CAST(ts AS DATE) < (SELECT max(CAST(ts AS DATE)) FROM ticks) GROUP BY 1"""


def folder(t, name):
    """A new folder in the shared one, for a stream's result and checkpoint."""
    shared = t.spark.conf.get("spark.checkpoint.dir", None) or f"{t.spark.conf.get('spark.sql.warehouse.dir')}/_streams"
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def tick_stream(t):
    """The events table as a stream; a pattern, because a table may be one file and a plain stream path must be a folder."""
    return t.ticks(t.spark.readStream.schema(t.table("events").schema).parquet(f"{t.folder}/events.parque[t]"))


def previous_close(t):
    """Last price before the newest day of the stream."""
    ticks = t.ticks()
    last_day = ticks.agg(F.max(F.to_date("ts"))).scalar()
    return ticks.withColumn("last_day", last_day).filter(F.to_date("ts") < F.col("last_day")).groupBy("symbol").agg(
        F.max_by("price", "ts").alias("previous_close"))


@query("ST1_live_snapshot", "symbol:s price:3 previous_close:3 change_pct:3", """
SELECT symbol, round(p, 2) AS price, round(previous_close, 2) AS previous_close, round(CASE WHEN previous_close > 0 THEN (p - previous_close)/previous_close*100 ELSE 0 END, 2) AS change_pct FROM (
 SELECT symbol, max_by(price, ts) AS p FROM ticks GROUP BY 1) JOIN prevclose USING (symbol)""")
def _(t):
    out = folder(t, "snapshot")
    live.start_snapshot(tick_stream(t), previous_close(t), out, f"{out}-checkpoint").awaitTermination()
    return live.read_snapshot(t.spark, out, live.live_snapshot(t.ticks(), previous_close(t)).schema)


def tick_alerts(t):
    """A pair of pending alerts per event type around its mean value."""
    mean = t.ticks().groupBy("symbol").agg(F.avg("price").alias("m"))
    pair = F.explode(F.array(F.struct(F.lit("above").alias("alert_type"), (F.col("m") * 3).alias("price")),
                             F.struct(F.lit("below").alias("alert_type"), (F.col("m") * 0.001).alias("price")))).alias("a")
    return mean.select("symbol", pair).select(F.concat_ws("-", "symbol", "a.alert_type").alias("alert_id"), F.col("symbol").alias("ticker"), "a.*",
                                              F.lit(False).alias("triggered"))


@query("ST2_alert_latch", "alert_id:s triggered_date:d triggered_price:3", """
WITH m AS (SELECT symbol, avg(price) AS m FROM ticks GROUP BY 1),
a AS (SELECT symbol || '-above' AS alert_id, symbol, 'above' AS k, m*3 AS tg FROM m UNION ALL SELECT symbol || '-below', symbol, 'below', m*0.001 FROM m)
SELECT alert_id, CAST(min(ts) AS DATE) AS triggered_date, min_by(price, ts) AS triggered_price FROM a JOIN ticks t ON t.symbol = a.symbol AND CASE k WHEN 'above' THEN price >= tg ELSE price <= tg END GROUP BY 1""")
def _(t):
    out = folder(t, "fired")
    live.start_alert_latch(tick_stream(t), tick_alerts(t), out, f"{out}-checkpoint").awaitTermination()
    return t.spark.read.schema(live.FIRED).parquet(out).withColumn("triggered_date", F.to_date("triggered_at"))
