"""Choice of an option contract per trade.

Contracts and trades meet by *rank*, not by pairing every trade with every
contract: both are sorted together by strike, each trade learns how many
contracts lie before its spot, and the wanted contract is then one equi-join away
on that rank. The work is linear in trades and contracts.

Strikes are signed by contract type (puts negated), so that for calls and puts
alike the out-of-the-money contracts follow the spot and the nearest comes first.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickline.functions.clock import MICROS_PER_DAY, local_date_after, local_midnight
from wickline.functions.pricing import contract_type
from wickline.sources.options import LISTING_DAYS

MAX_EXPIRY_DISTANCE_DAYS = 10


def _signed(kind: Column, amount: Column) -> Column:
    return F.when(kind == "call", amount).otherwise(-amount)


def _steps(otm_steps: int, available: Column) -> Column:
    """Zero-based step, clamped to what is there."""
    return F.least(F.lit(max(otm_steps - 1, 0)), available - 1)


# What a look-up depends on. Trades that agree in it (of two strategies, say) share one
# look-up; those that differ, in the side at one bar for instance, have their own.
KEY = ("symbol", "entry_time", "exit_time", "contract_type", "as_of", "spot")
REQUEST = (*KEY, "wanted")


def with_request(trades: DataFrame, dte_days: int, timezone: str) -> DataFrame:
    """Add what a look-up needs to know of a trade."""
    return trades.withColumns(
        {
            "contract_type": contract_type(F.col("side")),
            "as_of": F.col("session_date"),
            "spot": F.col("entry_price"),
            "wanted": local_date_after(F.col("entry_time"), dte_days, timezone),
        }
    )


def _ranked(contracts: DataFrame, requests: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Contracts and requests of one group in strike order: ``place`` counts the
    contracts up to a row, ``listed`` those of the group. A contract at the spot
    comes after the request, so it still qualifies."""
    kinds = dict(requests.dtypes)
    carried = [c for c in REQUEST if c not in keys]
    offered = contracts.select(
        *keys, _signed(F.col("contract_type"), F.col("strike")).alias("at"), F.lit(1).alias("is_contract"), label,
        *[F.lit(None).cast(kinds[c]).alias(c) for c in carried],
    )
    asked = requests.select(
        *keys, _signed(F.col("contract_type"), F.col("spot")).alias("at"), F.lit(0).alias("is_contract"),
        F.lit(None).cast("string").alias(label), *carried,
    )
    placed = reduce(and_, [F.col(k).isNotNull() for k in keys])
    group = Window.partitionBy(*keys)
    in_order = group.orderBy("at", "is_contract", F.coalesce(label, F.lit("")))
    return offered.unionByName(asked).where(placed).withColumns(
        {
            "place": F.sum("is_contract").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "listed": F.sum("is_contract").over(group),
        }
    )


def _offers(ranked: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Contracts by rank. The conditions hold for every contract; naming all
    columns keeps this reader of ``ranked`` on the shuffle of the requests."""
    nothing = " and ".join(f"{c} is null" for c in REQUEST if c not in keys)
    offers = ranked.where(f"is_contract = 1 and {nothing} and listed >= place")
    return offers.select(*keys, "place", _signed(F.col("contract_type"), F.col("at")).alias("strike"), label)


def contract_candidates(requests: DataFrame, contracts: DataFrame) -> DataFrame:
    """Per request and expiry: how many contracts qualify and the rank of the
    nearest. Expiries without a qualifying contract are left out."""
    return _qualifying(_listed_by_rank(requests, contracts))


def _listed_by_rank(requests: DataFrame, contracts: DataFrame) -> DataFrame:
    requests = requests.select(*REQUEST).distinct()
    listing = ["symbol", "contract_type", "as_of"]
    known = (
        contracts.withColumnRenamed("underlying", "symbol")
        .where(F.col("expiration").isNotNull() & F.col("strike").isNotNull())
        .join(requests.select(*listing).distinct(), listing, "left_semi")
    )
    dates = F.sequence(F.col("as_of"), F.date_add("as_of", LISTING_DAYS))
    asked = requests.withColumn("expiration", F.explode(dates))
    return _ranked(known, asked, [*listing, "expiration"], "ticker")


def _qualifying(ranked: DataFrame) -> DataFrame:
    return ranked.where("is_contract = 0 and listed > place").select(
        *KEY,
        "expiration",
        F.abs(F.datediff("expiration", "wanted")).alias("expiry_gap"),
        (F.col("listed") - F.col("place")).alias("qualifying"),
        (F.col("place") + 1).alias("nearest"),
    )


def pick_contract(requests: DataFrame, contracts: DataFrame, otm_steps: int) -> DataFrame:
    """The k-th contract per request in order of expiry distance, expiry and strike
    distance: the key of the look-up, expiration, strike, ticker. Running past the
    contracts of one expiry goes on in the next best one; past all, the last
    counts. Requests without a qualifying contract have no row."""
    ranked = _listed_by_rank(requests, contracts)
    per_trade = Window.partitionBy(*KEY)
    by_expiry = per_trade.orderBy("expiry_gap", "expiration").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = _qualifying(ranked).withColumns(
        {"upto": F.sum("qualifying").over(by_expiry), "available": F.sum("qualifying").over(per_trade)}
    )
    step = _steps(otm_steps, F.col("available"))
    chosen = counted.where((step < F.col("upto")) & (step >= F.col("upto") - F.col("qualifying"))).select(
        *KEY,
        "expiration",
        (F.col("nearest") + step - (F.col("upto") - F.col("qualifying"))).alias("place"),
    )
    keys = ["symbol", "contract_type", "as_of", "expiration"]
    return chosen.join(_offers(ranked, keys, "ticker"), [*keys, "place"]).select(*KEY, "expiration", "strike", "ticker")


def nearest_expiry(requests: DataFrame, chain: DataFrame, timezone: str) -> DataFrame:
    """Add to each request the earliest listed expiry on or after the wanted date,
    and the whole days from entry to the midnight it starts at.

    Resolved per distinct (symbol, wanted date): both sides are calendar dates of
    a symbol, so their number is bounded however many trades there are.
    ``listed_expiries`` is false where the symbol has no chain at all.
    """
    expiries = chain.where("expiration is not null").select(
        F.col("underlying").alias("symbol"), F.col("expiration").alias("day"), F.lit(True).alias("is_expiry")
    )
    wanted = requests.select("symbol", F.col("wanted").alias("day"), F.lit(False).alias("is_expiry"))
    days = expiries.unionByName(wanted).distinct()
    latest_first = Window.partitionBy("symbol").orderBy(F.desc("day"), F.desc("is_expiry"))
    upcoming = F.last(F.when(F.col("is_expiry"), F.col("day")), ignorenulls=True).over(
        latest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    any_listed = F.bool_or("is_expiry").over(Window.partitionBy("symbol"))
    resolved = (
        days.withColumns({"expiration": upcoming, "listed_expiries": any_listed})
        .where("not is_expiry")
        .select("symbol", F.col("day").alias("wanted"), "expiration", "listed_expiries")
    )
    micros = F.unix_micros(local_midnight(F.col("expiration"), timezone)) - F.unix_micros("entry_time")
    return requests.join(resolved, ["symbol", "wanted"], "left").withColumn(
        "days_to_expiry", F.floor(micros / MICROS_PER_DAY).cast("int")
    )


def within_reach() -> Column:
    return F.abs("days_to_expiry") <= MAX_EXPIRY_DISTANCE_DAYS


def kth_otm_strike(requests: DataFrame, chain: DataFrame, otm_steps: int) -> DataFrame:
    """The k-th distinct strike out of the money per request with an expiry:
    the key of the look-up, expiration, strike, contract. Clamped to the last one there is."""
    keys = ["symbol", "contract_type", "expiration"]
    usable = requests.where("expiration is not null").select(*REQUEST, "expiration").distinct()
    strikes = (
        chain.withColumnRenamed("underlying", "symbol")
        .where("expiration is not null and strike is not null")
        .join(usable.select(*keys).distinct(), keys, "left_semi")
        .groupBy(*keys, "strike")
        .agg(F.min("contract").alias("contract"))
    )
    ranked = _ranked(strikes, usable, keys, "contract")
    step = _steps(otm_steps, F.col("listed") - F.col("place"))
    chosen = ranked.where("is_contract = 0 and listed > place").select(
        *KEY, "expiration", (F.col("place") + 1 + step).alias("place")
    )
    return chosen.join(_offers(ranked, keys, "contract"), [*keys, "place"]).select(*KEY, "expiration", "strike", "contract")
