"""Fees, costs and the time value of a locked position. Doubles, in a fixed order of operations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.values import Thresholds

T = Thresholds()


def total_fee(price: Column, contracts: Column, fee: float = T.fee) -> Column:
    """Taker fee of an order, up to the next cent; 0 outside (0, 1) or without contracts."""
    raw = F.lit(fee) * contracts * price * (F.lit(1.0) - price)
    return F.when((price <= 0) | (price >= 1) | (contracts <= 0), 0.0).otherwise(F.ceil(raw * 100).cast("double") / 100.0)


def fee_rate(price: Column, contracts: Column | None = None, fee: float = T.fee) -> Column:
    """Fee as a share of notional; without contracts the rate that large orders tend to."""
    large = F.lit(fee) * (F.lit(1.0) - price)
    if contracts is None:
        return F.when((price <= 0) | (price >= 1), 0.0).otherwise(large)
    exact = total_fee(price, contracts, fee) / (contracts * price)
    return F.when((price <= 0) | (price >= 1), 0.0).when(contracts.isNull() | (contracts <= 0), large).otherwise(exact)


def round_trip_cost(a: Column, b: Column, target: float | None = T.target, t: Thresholds = T) -> Column:
    """Cost of both legs by one dollar of payout. ``target`` dollars a leg give the number of contracts."""
    contracts = None if not target else F.when(b > 0, F.lit(float(target)) / b)
    return a * (F.lit(1.0) + F.lit(t.a_fee)) + b * (F.lit(1.0) + fee_rate(b, contracts, t.fee))


def time_value(profit: Column, days: Column, capped: Column, t: Thresholds = T) -> Column:
    """struct(ok, required, reason): profit must reach the risk-free return of the holding period. Capped dates count as long."""
    horizon = F.when(capped, F.greatest(days, F.lit(t.long_days))).otherwise(days)
    required = F.lit(t.risk_free) * (horizon / F.lit(365.0))

    def out(ok: Column, need: Column, reason: str) -> Column:
        return F.struct(ok.alias("ok"), need.alias("required"), F.lit(reason).alias("reason"))

    no, none = F.lit(False), F.lit(0.0)
    return (
        F.when(days.isNull() | F.isnan(days), out(no, none, "no_resolution_date"))
        .when(days < t.min_days, out(no, none, "resolves_too_soon"))
        .when(profit < required, out(no, required, "below_risk_free"))
        .otherwise(out(F.lit(True), required, "pass"))
    )


def verdict(cost: Column, t: Thresholds = T) -> Column:
    """loss, suspect (too good to be true) or candidate."""
    return F.when(cost.isNull() | (cost >= 1), "loss").when(F.lit(1.0) - cost > t.suspect, "suspect").otherwise("candidate")
