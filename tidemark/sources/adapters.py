"""Domain tables derived from the star-schema Parquet tables.

Joins carry no broadcast hint: Catalyst broadcasts a side only when its measured size is below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles both sides, where adaptive
execution splits a hot key. Every aggregation below has a partial (map-side) form, so a symbol
that holds a third of the rows reaches the shuffle as one row per day and map task.
"""

from __future__ import annotations

import datetime as dt

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = dt.date(2001, 11, 5)
BENCHMARK = "STANDARD"
# Target mix of the sample portfolio, by symbol.
TARGETS = {"STANDARD": 0.35, "ECONOMY": 0.25, "MEDIUM": 0.20, "SMALL": 0.10, "LARGE": 0.10, "PROMO": 0.0}
PROFILES = {
    "conservative": {"STANDARD": 0.30, "ECONOMY": 0.30, "MEDIUM": 0.10, "SMALL": 0.20, "LARGE": 0.10},
    "moderate": {"STANDARD": 0.35, "ECONOMY": 0.25, "MEDIUM": 0.20, "SMALL": 0.10, "LARGE": 0.10},
    "aggressive": {"STANDARD": 0.25, "ECONOMY": 0.10, "MEDIUM": 0.45, "SMALL": 0.10, "LARGE": 0.10},
}


def _day(name: str) -> Column:
    return F.col(name).cast("date")


class Domain:
    """Lazy domain tables over one folder of Parquet tables.

    The daily bars are a roll-up (one row per symbol and day, whatever the number of trades) that
    nearly every job reads, most of them several times. They are laid out by symbol and day and
    persisted (memory, then disk), so the raw tables are read once per session and later windows
    need neither a shuffle nor a sort. Lost blocks are recomputed. ``share=False`` turns it off.
    """

    def __init__(self, spark: SparkSession, folder: str, by_brand: bool = False, share: bool = True):
        self.spark = spark
        self.folder = folder
        self.share = share
        self.symbol = (F.concat_ws("/", "p_brand", "p_type") if by_brand else F.col("p_type"))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def bars(self) -> DataFrame:
        bars = self.daily_rollup()
        if not self.share:
            return bars
        laid_out = bars.repartition("symbol").sortWithinPartitions("symbol", "dt")
        if laid_out.storageLevel == StorageLevel.NONE:
            laid_out.persist(StorageLevel.MEMORY_AND_DISK)
        return laid_out

    def release(self) -> None:
        """Drop the persisted bars."""
        self.bars().unpersist()

    def daily_rollup(self) -> DataFrame:
        unit = F.col("l_extendedprice") / F.col("l_quantity")
        lines = self.table("lineitem").select(
            "l_partkey", _day("l_shipdate").alias("dt"), unit.alias("px"), "l_quantity",
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
        parts = self.table("part").select("p_partkey", self.symbol.alias("symbol"))
        return (lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
                .groupBy("symbol", "dt")
                .agg(F.min_by("px", "seq").alias("open"), F.max("px").alias("high"),
                     F.min("px").alias("low"), F.avg("px").alias("close"),
                     F.sum("l_quantity").alias("volume")))

    def prices(self) -> DataFrame:
        return self.bars().select("symbol", "dt", "close")

    def benchmark(self) -> DataFrame:
        return self.prices().filter(F.col("symbol") == BENCHMARK).select("dt", "close")

    def latest(self) -> DataFrame:
        """Latest close per symbol."""
        return self.prices().groupBy("symbol").agg(F.max_by("close", "dt").alias("price"))

    def transactions(self) -> DataFrame:
        is_div = F.col("l_returnflag") == "R"
        fx = F.lit(33.5).cast("double") + F.col("l_tax") * 10
        return (self.table("lineitem")
                .join(self.table("orders").select("o_orderkey", "o_custkey"),
                      F.col("l_orderkey") == F.col("o_orderkey"))
                .join(self.table("part").select("p_partkey", self.symbol.alias("ticker")),
                      F.col("l_partkey") == F.col("p_partkey"))
                .select(
                    F.col("o_custkey").alias("portfolio_id"),
                    F.concat_ws("-", F.col("l_orderkey").cast("string"),
                                F.col("l_linenumber").cast("string")).alias("tx_id"),
                    _day("l_shipdate").alias("date"), "ticker",
                    F.when(is_div, 0.0).otherwise(F.col("l_quantity")).alias("shares"),
                    F.when(is_div, 0.0).otherwise(F.col("l_extendedprice") / F.col("l_quantity")).alias("price_usd"),
                    fx.alias("fx_rate_thb"),
                    (F.col("l_extendedprice") * fx * F.when(is_div, 0.01).otherwise(1.0)).alias("amount_thb"),
                    F.when(F.col("l_linestatus") != "F", F.col("l_extendedprice") * 0.05).alias("fee_thb"),
                    F.when(is_div, "dividend").otherwise("buy").alias("tx_type")))

    def cashflow_tx(self) -> DataFrame:
        income = F.col("o_orderstatus") == "F"
        return self.table("orders").select(
            F.col("o_custkey").alias("household_id"), _day("o_orderdate").alias("date"),
            F.when(income, F.col("o_totalprice")).otherwise(-F.col("o_totalprice")).alias("amount"),
            F.col("o_orderpriority").alias("category"),
            F.when(income, "income").otherwise("expense").alias("type"))

    def sentiment_results(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", "text", "source", "n_chars")
        return docs.join(self.table("labels"), "doc_id").select(
            F.col("source").alias("symbol"), "doc_id", F.col("text").alias("title"),
            F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive")
            .otherwise("neutral").alias("sentiment"),
            F.least(F.lit(1.0), F.col("n_chars") / 5000.0).cast("double").alias("confidence"))

    def ticks(self, events: DataFrame | None = None) -> DataFrame:
        """Price ticks of the events table, or of another table or stream of events."""
        return (self.table("events") if events is None else events).select(
            F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), "event_id")

    def goals(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("goal_id"), key.alias("owner_id"), (key * 100 + 100000).cast("double").alias("target_amount"),
            F.greatest("c_acctbal", F.lit(0.0)).alias("current_amount"),
            (key % 50 * 20 + 500).cast("double").alias("monthly_contribution"),
            (key % 120 + 12).cast("int").alias("months_remaining"),
            F.element_at(F.array(*map(F.lit, ("conservative", "moderate", "aggressive"))),
                         (F.col("c_nationkey") % 3 + 1).cast("int")).alias("risk_profile"))

    def risk_profiles(self) -> DataFrame:
        key = F.col("c_custkey")

        def pick(index: Column, *names: str) -> Column:
            return F.element_at(F.array(*map(F.lit, names)), (index + 1).cast("int"))

        return self.table("customer").select(
            key.alias("household_id"),
            pick(key % 4, "very_stable", "stable", "unstable", "freelance").alias("job_stability"),
            (key % 6).alias("dependents"),
            pick(F.col("c_nationkey") % 4, "salary", "mixed", "freelance", "business").alias("income_type"),
            (key % 2 == 0).alias("has_health_insurance"),
            pick(key % 5, "government", "startup", "self_employed", "other", "other").alias("industry"),
            (key + 1000).cast("double").alias("monthly_expense"),
            F.greatest("c_acctbal", F.lit(0.0)).alias("current_savings"),
            ((key % 7).cast("double") * 100).alias("monthly_saving_capacity"))

    def debts(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            F.col("c_nationkey").alias("household_id"), key.alias("debt_id"),
            (F.abs("c_acctbal") + 1).alias("balance"),
            (key % 20 + 3).cast("double").alias("interest_rate"),
            (key % 30 + 20).cast("double").alias("min_payment"))

    def fundamentals(self) -> DataFrame:
        sym = F.col("symbol")
        return (self.table("part").select(self.symbol.alias("symbol"), "p_type", "p_size", "p_retailprice")
                .groupBy("symbol", "p_type").agg(F.avg("p_size").alias("size"), F.avg("p_retailprice").alias("retail"))
                .select(sym, (F.col("size") / 2).alias("trailing_pe"),
                        (F.col("retail") / 1000).alias("dividend_rate"),
                        F.when(F.col("p_type") == "PROMO", 0.0).otherwise(F.col("size") / 100 + 0.8).alias("beta"),
                        F.when(F.col("p_type") == "SMALL", F.lit(None).cast("double"))
                        .when(F.col("p_type") == "LARGE", 3.5).otherwise(0.025).alias("dividend_yield")))

    def networth_lines(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").alias("household_id"),
            F.trunc(_day("o_orderdate"), "month").alias("snapshot_date"),
            F.col("o_orderkey").alias("snapshot_line_id"), F.col("o_orderpriority").alias("name"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "etf").otherwise("cash").alias("type"),
            F.when(F.col("o_orderstatus") == "P", "liability").otherwise("asset").alias("side"),
            F.col("o_totalprice").alias("value_thb"))

    def macro(self) -> DataFrame:
        """Monthly CPI and policy-rate series plus daily volatility, dollar and ten-year series."""
        orders = self.table("orders").select(
            _day("o_orderdate").alias("day"), "o_totalprice", "o_custkey")
        monthly = (orders.groupBy(F.trunc("day", "month").alias("dt"))
                   .agg(F.avg("o_totalprice").alias("cpi"), (F.avg("o_custkey") / 100).alias("rate"))
                   .select("dt", F.expr("stack(2, 'CPI', cpi, 'FEDFUNDS', rate)").alias("series_id", "value")))
        daily = (orders.groupBy(F.col("day").alias("dt"))
                 .agg((F.count("*") % 31 + 10).cast("double").alias("vix"),
                      (F.avg("o_totalprice") / 1000).alias("dxy"),
                      (F.count("*") % 21 + 30).cast("double").alias("tnx"))
                 .select("dt", F.expr("stack(3, 'VIX', vix, 'DXY', dxy, 'TNX', tnx)").alias("series_id", "value")))
        return monthly.unionByName(daily).select("series_id", "dt", "value")

    def news(self) -> DataFrame:
        pages = self.table("pages").select(
            F.lit("ALL").alias("symbol"), F.col("html").alias("title"), "url",
            (F.col("page_id") % 30).alias("age_days"), "page_id")
        first = pages.withColumn("source_priority", F.lit(1))
        second = pages.filter(F.col("page_id") % 5 == 0).withColumn("source_priority", F.lit(2))
        return first.unionByName(second)

    def alerts(self) -> DataFrame:
        """Two pending alerts per symbol, two percent above and below the latest close."""
        return self.latest().select(F.explode(F.array(
            F.struct(F.concat_ws("-", "symbol", F.lit("above")).alias("alert_id"), F.col("symbol").alias("ticker"),
                     F.lit("above").alias("alert_type"), (F.col("price") * 1.02).alias("price")),
            F.struct(F.concat_ws("-", "symbol", F.lit("below")).alias("alert_id"), F.col("symbol").alias("ticker"),
                     F.lit("below").alias("alert_type"), (F.col("price") * 0.98).alias("price")),
        )).alias("a")).select("a.*").withColumns({
            "triggered": F.lit(False), "triggered_at": F.lit(None).cast("date"),
            "triggered_price": F.lit(None).cast("double")})

    def quotes(self) -> DataFrame:
        """Three quote sources: the first misses PROMO and has a zero for SMALL."""
        source = F.explode(F.array(
            F.struct(F.lit(1).alias("source_priority"),
                     F.when(F.col("symbol") == "SMALL", 0.0).otherwise(F.col("price")).alias("q")),
            F.struct(F.lit(2).alias("source_priority"), (F.col("price") * 1.001).alias("q")),
            F.struct(F.lit(3).alias("source_priority"), (F.col("price") * 1.002).alias("q"))))
        return (self.prices().groupBy("symbol")
                .agg(F.max("dt").alias("ts"), F.max_by("close", "dt").alias("price"))
                .select("symbol", "ts", source.alias("s"))
                .filter(~((F.col("s.source_priority") == 1) & (F.col("symbol") == "PROMO")))
                .select("symbol", "ts", "s.source_priority", F.col("s.q").alias("price")))

    def weights(self) -> DataFrame:
        """Preset mixes as rows (portfolio_id, symbol, weight, ord)."""
        rows = [(p, s, float(w), i) for p, mix in PROFILES.items() for i, (s, w) in enumerate(mix.items())]
        return self.spark.createDataFrame(rows, "portfolio_id string, symbol string, weight double, ord int")

    def targets(self) -> DataFrame:
        rows = [(s, float(w), i) for i, (s, w) in enumerate(TARGETS.items())]
        return self.spark.createDataFrame(rows, "symbol string, weight double, ord int")
