"""Household tables: cash flow, emergency fund, goals, debts and net worth.

Transactions of one household may be very many; they are summed per month (map-side) before any
window, so that windows see at most one row per month and category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import bisect_root, clamp, dbl
from tidemark.operators.ranking import numbered
from tidemark.session import spread

# Risk points, multipliers, return assumptions and thresholds.
JOB_POINTS = {"very_stable": 0, "stable": 20, "unstable": 60, "freelance": 80}
INCOME_POINTS = {"salary": 0, "mixed": 15, "freelance": 35, "business": 40}
INDUSTRY_POINTS = {"government": -10, "startup": 20, "self_employed": 15, "other": 0}
MULTIPLIERS = [(20, 2.5), (40, 3.5), (60, 5.0), (80, 6.5), (100, 8.0)]
EXPECTED_RETURNS = {"conservative": 0.07, "moderate": 0.09, "aggressive": 0.12}
DEFAULT_VOLATILITY, DEFAULT_RETURN = 0.15, 0.09
ANOMALY_PCT, EMERGENCY_MONTHS, ON_TRACK_SHARE = 15.0, 3, 0.85


def monthly_summary(tx: DataFrame) -> DataFrame:
    """Income and expense per household and month; any kind other than income is expense."""
    income = F.col("type") == "income"
    size = F.abs("amount")
    return tx.groupBy("household_id", F.trunc("date", "month").alias("month")).agg(
        F.sum(F.when(income, size).otherwise(0.0)).alias("income"), F.sum(F.when(income, 0.0).otherwise(size)).alias("expense"))


def category_monthly(tx: DataFrame) -> DataFrame:
    return tx.filter(F.col("type") == "expense").groupBy(
        "household_id", "category", F.trunc("date", "month").alias("month")).agg(F.sum(F.abs("amount")).alias("expense"))


def category_anomalies(tx: DataFrame) -> DataFrame:
    """Last month against the mean of all earlier months (a month without the category counts 0)."""
    months = tx.select("household_id", F.trunc("date", "month").alias("month")).groupBy("household_id").agg(
        F.max("month").alias("last_month"), F.count_distinct("month").alias("n_months"))
    rows = category_monthly(tx).join(months.filter("n_months >= 2"), "household_id")
    last = F.col("month") == F.col("last_month")
    agg = rows.groupBy("household_id", "category").agg(
        F.sum(F.when(last, F.col("expense")).otherwise(0.0)).alias("last_value"),
        (F.sum(F.when(last, 0.0).otherwise(F.col("expense"))) / (F.first("n_months") - 1)).alias("avg_monthly"))
    out = agg.filter(F.col("avg_monthly") != 0).withColumn(
        "change_pct", F.round((F.col("last_value") - F.col("avg_monthly")) / F.col("avg_monthly") * 100, 1))
    return out.filter(F.abs("change_pct") >= ANOMALY_PCT)


def cashflow_forecast(households: DataFrame, tx: DataFrame, scenarios: DataFrame, months: int, as_of) -> DataFrame:
    """Projected months per household: averages over observed months, with per-category changes.

    ``households(household_id, balance)``; ``scenarios(household_id, category, change_pct, seq)``,
    the highest ``seq`` of a category wins. A household without history gets flat zeros.
    """
    avg = monthly_summary(tx).groupBy("household_id").agg(
        F.count("*").alias("n_months"), F.avg("income").alias("avg_income"), F.avg("expense").alias("avg_expense"))
    wanted = scenarios.groupBy("household_id", "category").agg(F.max_by("change_pct", "seq").alias("change_pct"))
    spent = category_monthly(tx).groupBy("household_id", "category").agg(F.sum("expense").alias("spent"))
    shift = (spent.join(wanted, ["household_id", "category"]).join(avg, "household_id")
             .groupBy("household_id").agg(F.sum(F.when(
                 F.col("avg_expense") != 0, F.col("spent") / F.col("n_months") / F.when(F.col("avg_expense") != 0, F.col("avg_expense")) * F.col("change_pct") / 100
             ).otherwise(0.0)).alias("delta")))
    base = households.join(avg, "household_id", "left").join(shift, "household_id", "left")
    zero = F.lit(0.0)
    base = base.withColumns({
        "income": F.coalesce("avg_income", zero),
        "expense": F.coalesce("avg_expense", zero) * (1 + F.coalesce("delta", zero)), "avg_expense": F.coalesce("avg_expense", zero)})
    step = F.explode(F.sequence(F.lit(1), F.lit(months)))
    rows = base.withColumn("step", step).withColumn("net", F.col("income") - F.col("expense"))
    return rows.select("household_id", "step", F.add_months(F.trunc(F.lit(as_of).cast("date"), "month"), F.col("step")).alias("month"),
                       "income", "expense", "net", (F.col("balance") + F.col("net") * F.col("step")).alias("ending_balance"), "avg_expense")


def emergency_breach(forecast: DataFrame, threshold: float | None = None) -> DataFrame:
    """First projected month below the threshold (default: three months of average expense)."""
    limit = F.col("avg_expense") * EMERGENCY_MONTHS if threshold is None else dbl(threshold)
    # balances are compared as shown, at two decimals
    below = F.round("ending_balance", 2) < limit
    return forecast.groupBy("household_id").agg(F.min(F.when(below, F.col("month"))).alias("breach_month"))


def _points(col: str, table: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, points in table.items():
        out = F.when(F.col(col) == name, points).otherwise(out)
    return out


def emergency_fund(profiles: DataFrame) -> DataFrame:
    """Risk score, months of expense to hold, target, gap and months until it is reached."""
    raw = (_points("job_stability", JOB_POINTS) + F.least(F.col("dependents"), F.lit(3)) * 10 + _points("income_type", INCOME_POINTS)
           + F.when(F.col("has_health_insurance"), 0).otherwise(20) + _points("industry", INDUSTRY_POINTS))
    out = profiles.withColumn("risk_score", clamp(raw.cast("double"), 0, 100).cast("int"))
    mult = F.lit(MULTIPLIERS[-1][1])
    for bound, value in reversed(MULTIPLIERS):
        mult = F.when(F.col("risk_score") <= bound, value).otherwise(mult)
    out = out.withColumn("multiplier", mult)
    out = out.withColumn("target", F.round(F.col("monthly_expense") * F.col("multiplier"), 2))
    out = out.withColumn("gap", F.round(F.col("target") - F.col("current_savings"), 2))
    saving = F.col("monthly_saving_capacity")
    return out.withColumn("months_to_goal", F.when((F.col("gap") > 0) & (saving > 0), F.ceil(F.col("gap") / F.when(saving > 0, saving))))


def required_rate(months: Column, monthly: Column, current: Column, target: Column, low: float = -0.99, high: float = 1.0) -> Column:
    """Yearly return that turns today's amount plus monthly savings into the target.

    The monthly rate is sought between ``low`` and ``high``; NULL where none lies there (-99 % to 100 % a month by default).
    """
    n = months.cast("double")

    def gap(rate: Column) -> Column:
        grown = F.pow(1 + rate, n)
        annuity = F.when(F.abs(rate) < 1e-12, n).otherwise((grown - 1) / F.when(F.abs(rate) >= 1e-12, rate))
        return current * grown + monthly * annuity - target

    root = bisect_root(gap, low, high, 60)
    return F.when((months > 0) & ((monthly > 0) | (current > 0)), F.pow(1 + root, 12) - 1)


def goal_progress(goals: DataFrame, assumptions: DataFrame | None = None) -> DataFrame:
    """Savings plan check per goal.

    ``assumptions(owner_id, mu)`` replaces the preset return for goals whose owner has a row there, as the
    owner's portfolio gives it (``risk.owner_returns``); ``from_portfolio`` tells which one was used.
    ``shortfall`` is what the monthly saving lacks, for goals off track.
    """
    preset = F.lit(DEFAULT_RETURN)
    for name, value in EXPECTED_RETURNS.items():
        preset = F.when(F.col("risk_profile") == name, value).otherwise(preset)
    # the rate search folds sixty steps per row
    rows = spread(goals, "goal_id").withColumn("preset_return", preset)
    rows = rows.join(assumptions.select("owner_id", "mu"), "owner_id", "left") if assumptions is not None else rows.withColumn("mu", F.lit(None).cast("double"))
    rows = rows.withColumns({"rate": F.coalesce("mu", "preset_return"), "from_portfolio": F.col("mu").isNotNull()})
    m, n = F.col("rate") / 12, F.col("months_remaining").cast("double")
    cur, add, goal = F.col("current_amount"), F.col("monthly_contribution"), F.col("target_amount")
    growth = F.pow(1 + m, n)
    safe_m = F.when(m != 0, m)
    pmt = (F.when(n <= 0, goal - cur).when(m == 0, (goal - cur) / F.when(n > 0, n))
           .otherwise((goal - cur * growth) * safe_m / F.when(growth != 1, growth - 1)))
    rows = rows.withColumns({
        "required_pmt": F.greatest(F.lit(0.0), pmt),
        "projected_value": F.when(m > 0, cur * growth + add * (growth - 1) / safe_m).otherwise(cur + add * n)})
    needed = required_rate(F.col("months_remaining"), add, cur, goal)
    on_track = add >= F.col("required_pmt") * ON_TRACK_SHARE
    lacking = F.when(~on_track, F.col("required_pmt") - add)
    return rows.withColumns({"required_return": needed, "on_track": on_track, "shortfall": lacking}).withColumn(
        "warning", F.coalesce(F.coalesce("required_return", "rate") > F.col("preset_return") * 1.2, F.lit(False)))


def goal_allocation(goals: DataFrame, weights: DataFrame, default: str = "moderate") -> DataFrame:
    """The mix of each goal's risk profile as rows; an unknown profile takes the default's."""
    known = weights.select(F.col("portfolio_id").alias("profile"), "symbol", "weight")
    named = goals.join(known.select(F.col("profile").alias("risk_profile")).distinct().withColumn("known", F.lit(True)), "risk_profile", "left")
    profile = F.when(F.col("known"), F.col("risk_profile")).otherwise(F.lit(default))
    return named.select("goal_id", profile.alias("profile")).join(known, "profile").select("goal_id", "symbol", "weight")


def months_until(target_date: Column, as_of) -> Column:
    """Calendar months left, at least 1 for a valid date and 0 without one."""
    day = target_date.try_cast("date")
    now = F.lit(as_of).cast("date")
    left = (F.year(day) - F.year(now)) * 12 + F.month(day) - F.month(now)
    return F.when(day.isNull(), 0).otherwise(F.greatest(F.lit(1), left))


def goals_summary(progress: DataFrame) -> DataFrame:
    """Names on and off track as rows with the count of their side (lists could grow without bound)."""
    return progress.select("goal_id", "on_track").join(F.broadcast(goals_counts(progress)), "on_track")  # two rows at most


def goals_counts(progress: DataFrame) -> DataFrame:
    return progress.groupBy("on_track").agg(F.count("*").alias("n_goals"))


def debt_order(debts: DataFrame, monthly_budget: float) -> DataFrame:
    """Is the budget enough for all minimums, and each debt's place in the two payoff orders.

    Highest rate first and smallest balance first, equal keys by id; unknown rates and balances come last. Debts
    without a household are one group. One household's debts are never sorted in a single task.
    """
    key, debt = ["household_id"], F.col("debt_id")
    ranked = numbered(debts, key, [F.desc_nulls_last("interest_rate"), debt], "avalanche")
    ranked = numbered(ranked, key, [F.asc_nulls_last("balance"), debt], "snowball")
    total = ranked.groupBy(F.col("household_id").alias("_h")).agg(F.sum("min_payment").alias("total_min"))
    ranked = ranked.join(total, F.col("household_id").eqNullSafe(F.col("_h"))).drop("_h")
    return ranked.withColumn("feasible", F.lit(float(monthly_budget)) >= F.col("total_min"))


def purchase_days(plans: DataFrame, day_col: str = "buy_day") -> DataFrame:
    """Effective purchase day of each plan month (short months clip) and the reminder the day before."""
    last = F.day(F.last_day("month"))
    buy = F.date_add("month", F.least(F.col(day_col), last) - 1)
    return plans.withColumn("buy_dt", buy).withColumn("remind_dt", F.date_sub("buy_dt", 1))


# --- net worth ---------------------------------------------------------------------------


def snapshot_totals(lines: DataFrame) -> DataFrame:
    """Totals per household snapshot from its asset and liability lines."""
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("value_thb")).otherwise(0.0))
    out = lines.groupBy("household_id", "snapshot_date").agg(
        side("asset").alias("total_assets"), side("liability").alias("total_liabilities"), F.max("snapshot_line_id").alias("snapshot_id"))
    return out.withColumn("net_worth", F.col("total_assets") - F.col("total_liabilities"))


def net_worth_now(lines: DataFrame, etf_values: DataFrame) -> DataFrame:
    """Live ETF value plus the other assets of the newest snapshot, less its liabilities."""
    newest = lines.groupBy("household_id").agg(F.max("snapshot_date").alias("snapshot_date"))
    kept = lines.join(newest, ["household_id", "snapshot_date"]).groupBy("household_id").agg(
        F.sum(F.when((F.col("side") == "asset") & (F.col("type") != "etf"), F.col("value_thb")).otherwise(0.0)).alias("other_assets"),
        F.sum(F.when(F.col("side") == "liability", F.col("value_thb")).otherwise(0.0)).alias("liabilities"))
    live = etf_values.groupBy("household_id").agg(F.sum(F.round("value_thb", 2)).alias("etf_assets"))
    zero = F.lit(0.0)
    out = kept.join(live, "household_id", "full_outer").withColumns({
        "etf_live": F.col("etf_assets").isNotNull(), "etf_assets": F.coalesce("etf_assets", zero),
        "other_assets": F.coalesce("other_assets", zero), "liabilities": F.coalesce("liabilities", zero)})
    return out.withColumn("total_assets", F.col("etf_assets") + F.col("other_assets")).withColumn(
        "net_worth", F.col("total_assets") - F.col("liabilities"))


def snapshot_history(snapshots: DataFrame, as_of, months: int = 12) -> DataFrame:
    """One snapshot per household and date (highest id) over the past ``months`` x 30 days."""
    recent = snapshots.filter(F.col("snapshot_date") >= F.date_sub(F.lit(as_of).cast("date"), months * 30))
    value = [c for c in snapshots.columns if c not in ("household_id", "snapshot_date")]
    best = recent.groupBy("household_id", "snapshot_date").agg(F.max_by(F.struct(*value), "snapshot_id").alias("s"))
    return best.select("household_id", "snapshot_date", "s.*")


def net_worth_change(snapshots: DataFrame, as_of) -> DataFrame:
    """Newest snapshot of the past 90 days against the newest other one dated before this month."""
    hist = snapshot_history(snapshots, as_of, 3)
    w = Window.partitionBy("household_id").orderBy(F.desc("snapshot_date"))
    rows = hist.withColumn("r", F.row_number().over(w))
    older = (F.col("r") > 1) & (F.col("snapshot_date") < F.trunc(F.lit(as_of).cast("date"), "month"))
    out = rows.groupBy("household_id").agg(
        F.max(F.when(F.col("r") == 1, F.col("net_worth"))).alias("current_net_worth"),
        F.max_by("net_worth", F.when(older, F.col("snapshot_date"))).alias("previous"))
    out = out.withColumn("previous_net_worth", F.coalesce("previous", "current_net_worth")).drop("previous")
    change = F.col("current_net_worth") - F.col("previous_net_worth")
    return out.withColumns({"change": change, "change_pct": F.coalesce(change / F.when(F.col("previous_net_worth") != 0, F.col("previous_net_worth")) * 100, F.lit(0.0))})
