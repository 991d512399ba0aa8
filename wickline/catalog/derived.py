"""Market tables derived from the ``events`` table, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickline.operators.blocks import running_total
from wickline.params import ReversalParams, Risk, Session
from wickline.sources.bars import build_bars

SESSION = Session()
WIDTH = "30 minutes"
EVENTS = "event_id bigint, ts timestamp_ntz, event_type string, value double"
STRATEGY = ReversalParams(min_rel_volume=0.0, min_volume_sma=0.0)
RISK = Risk(commission_per_trade=1.0)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tick per event: the price walks by 0.01 x (value - 50) per event type.
    Decimal arithmetic, so that every engine and partitioning gives the same."""
    events = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")
    raw = events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp"), "event_id", "value")
    step = F.col("value").cast("decimal(12,2)") - F.lit(50).cast("decimal(12,2)")
    walked = running_total(raw, "walk", step, key="symbol", ts="ts", tie="event_id")
    price = (F.lit(300) + F.col("walk") * F.lit("0.01").cast("decimal(3,2)")).cast("double")
    return walked.select("symbol", "ts", "event_id", price.alias("price"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_bars(ticks(spark, sf_dir), WIDTH, SESSION, price="price", order="event_id")


def option_contracts(bars: DataFrame) -> DataFrame:
    """Listing per symbol and day: 13 strikes around the first open, five expiries,
    calls and puts. Some contracts have no ticker."""
    days = bars.groupBy("symbol", "session_date").agg(F.floor(F.min_by("open", "ts")).alias("atm"))
    listed = (
        days.withColumn("strike", F.explode(F.sequence(F.col("atm") - 6, F.col("atm") + 6)))
        .withColumn("dte", F.explode(F.array(*[F.lit(d) for d in (0, 1, 3, 7, 14)])))
        .withColumn("contract_type", F.explode(F.array(F.lit("call"), F.lit("put"))))
        .withColumn("expiration", F.date_add("session_date", F.col("dte")))
    )
    ticker = F.concat(
        F.lit("O:"),
        F.col("symbol"),
        F.date_format("expiration", "yyMMdd"),
        F.when(F.col("contract_type") == "call", "C").otherwise("P"),
        F.col("strike").cast("string"),
    )
    return listed.select(
        F.col("symbol").alias("underlying"),
        "contract_type",
        F.col("session_date").alias("as_of"),
        F.date_format("expiration", "yyyy-MM-dd").alias("expiration_date"),
        F.col("strike").cast("string").alias("strike_price"),
        F.when(F.col("strike") % 11 != 0, ticker).alias("ticker"),
    )


def option_chain(contracts: DataFrame) -> DataFrame:
    """The same contracts without the day they were listed on."""
    keys = [
        "underlying",
        "contract_type",
        F.col("expiration_date").alias("expiration"),
        F.col("strike_price").alias("strike"),
    ]
    return contracts.groupBy(*keys).agg(F.min("ticker").alias("contractSymbol"))


def option_bars(contracts: DataFrame, bars: DataFrame) -> DataFrame:
    """Bars of the listed contracts in service layout (epoch ms, close): intrinsic
    value plus a premium per day to expiry. Some strikes never trade and some
    hours are missing."""
    priced = contracts.where("ticker is not null").select(
        F.col("underlying").alias("symbol"),
        F.col("as_of").alias("session_date"),
        "contract_type",
        "ticker",
        F.col("strike_price").cast("bigint").alias("strike"),
        F.datediff(F.col("expiration_date").cast("date"), "as_of").alias("dte"),
    )
    spot = bars.select("symbol", "session_date", "ts", "local_ts", F.col("close").alias("spot"))
    joined = priced.where("strike % 5 <> 0").join(spot, ["symbol", "session_date"])
    traded = joined.where((F.hour("local_ts") + F.col("strike")) % 4 != 0)
    inside = F.when(F.col("contract_type") == "call", F.col("spot") - F.col("strike")).otherwise(
        F.col("strike") - F.col("spot")
    )
    close = F.round(1 + 0.1 * F.col("dte") + F.greatest(inside, F.lit(0.0)), 4)
    return traded.select("ticker", F.unix_millis("ts").alias("t"), close.alias("c"))


def odd_contracts(bars: DataFrame) -> DataFrame:
    """Listings with every way to fail: a symbol without any, one whose only expiry is a
    week before the end of the month, Fridays for the others; days without a listing, and days whose
    strikes are all on the wrong side of the price."""
    days = bars.groupBy("symbol", "session_date").agg(F.floor(F.min_by("open", "ts")).alias("atm"))
    friday = F.next_day("session_date", "Fri")
    fridays = F.array(friday, F.date_add(friday, 7), F.date_add(friday, 14))
    once = F.array(F.date_sub(F.last_day("session_date"), 7))
    listed = (
        days.where("symbol <> 'error' and day(session_date) % 5 <> 0")
        .withColumn("expiration", F.explode(F.when(F.col("symbol") == "signup", once).otherwise(fridays)))
        .withColumn("contract_type", F.explode(F.array(F.lit("call"), F.lit("put"))))
        .withColumn("off", F.explode(F.sequence(F.lit(-6), F.lit(6))))
    )
    wrong = F.when(F.dayofmonth("session_date") % 7 == 0, F.when(F.col("contract_type") == "call", -80).otherwise(80)).otherwise(0)
    listed = listed.withColumn("strike", F.col("atm") + F.col("off") + wrong)
    kind = F.when(F.col("contract_type") == "call", "C").otherwise("P")
    ticker = F.concat(F.lit("O:"), "symbol", F.date_format("expiration", "yyMMdd"), kind, F.col("strike").cast("string"))
    return listed.select(
        F.col("symbol").alias("underlying"),
        "contract_type",
        F.col("session_date").alias("as_of"),
        F.date_format("expiration", "yyyy-MM-dd").alias("expiration_date"),
        F.col("strike").cast("string").alias("strike_price"),
        F.when(F.col("strike") % 11 != 0, ticker).alias("ticker"),
    )


def odd_option_bars(contracts: DataFrame, bars: DataFrame) -> DataFrame:
    """Bars of each contract on all days of the fortnight before its expiry: some strikes
    never trade, some trade without a price, some only before eleven."""
    kept = contracts.where("ticker is not null and cast(strike_price as bigint) % 5 <> 0")
    priced = kept.select(
        F.col("underlying").alias("symbol"), "contract_type", "ticker", "expiration_date", F.col("strike_price").cast("bigint").alias("strike")
    ).distinct()
    ahead = priced.withColumn("session_date", F.explode(F.sequence(F.date_sub(F.col("expiration_date").cast("date"), 14), F.col("expiration_date").cast("date"))))
    spot = bars.select("symbol", "session_date", "ts", "local_ts", F.col("close").alias("spot"))
    joined = ahead.join(spot, ["symbol", "session_date"])
    traded = joined.where("if(strike % 3 = 1, hour(local_ts) < 11, (hour(local_ts) + strike) % 4 <> 0)")
    inside = F.when(F.col("contract_type") == "call", F.col("spot") - F.col("strike")).otherwise(F.col("strike") - F.col("spot"))
    left = F.datediff(F.col("expiration_date").cast("date"), "session_date")
    close = F.when(F.col("strike") % 7 != 3, F.round(1 + 0.1 * left + F.greatest(inside, F.lit(0.0)), 4))
    return traded.select("ticker", F.unix_millis("ts").alias("t"), close.alias("c"))
