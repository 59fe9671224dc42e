"""Signals over a replayed log: fan-out to pairs, latest state, cooldown, counters, ledger."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import pricing as P
from gridloom.functions.dates import iso_millis
from gridloom.functions.values import Thresholds
from gridloom.sources.tables import materialize

T = Thresholds()
#: Signals of a pair from which on it is no single task.
HOT_PAIR = 5_000_000


def legs(pairs: DataFrame) -> DataFrame:
    """(book, pair, leg) of ``pairs(pair, a_book, b_book)``."""
    both = F.array(F.struct(F.col("a_book").alias("book"), F.lit("a").alias("leg")), F.struct(F.col("b_book").alias("book"), F.lit("b").alias("leg")))
    return pairs.select("pair", F.explode(both).alias("x")).select("x.book", "pair", "x.leg")


def fan_out(messages: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row for each message and pair that it touches; messages of other books fall away."""
    return messages.join(legs(pairs), "book")


def latest(touched: DataFrame) -> DataFrame:
    """``touched`` with a_ts and b_ts, when each leg was last updated up to the message: an as-of lookup in one window."""
    upto = Window.partitionBy("pair").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return touched.withColumns({f"{k}_ts": F.last(F.when(F.col("leg") == k, F.col("recv_ts")), ignorenulls=True).over(upto) for k in ("a", "b")})


def ages(rows: DataFrame) -> DataFrame:
    """a_ms and b_ms, the legs' ages at the message; null for a leg never seen."""
    return rows.withColumns({f"{k}_ms": F.unix_millis("recv_ts") - F.unix_millis(f"{k}_ts") for k in ("a", "b")})


def cooled(signals: DataFrame, cooldown_ms: int, most: int | None = None, hot: int = HOT_PAIR) -> DataFrame:
    """(pair, at) of the signals that fire: one within ``cooldown_ms`` of the last that fired does not.

    Where a pair has over ``hot`` signals, they are followed by doubling, those of others in order. Unless ``most``, the signals that a
    pair may have, says that none has so many, they are counted first.
    """
    signals = signals.where("pair is not null and at is not null")
    if most is not None and most <= hot:
        return cooled_in_order(signals, cooldown_ms)
    large = materialize(signals.groupBy("pair").count().where(F.col("count") > hot).select("pair"))
    if large.isEmpty():
        return cooled_in_order(signals, cooldown_ms)
    rest = cooled_in_order(signals.join(large, "pair", "left_anti"), cooldown_ms)
    return rest.unionByName(cooled_by_doubling(signals.join(large, "pair", "left_semi"), cooldown_ms))


def successors(signals: DataFrame, cooldown_ms: int) -> DataFrame:
    """(pair, at, to) of ``signals(pair, at)``, distinct: the first signal that is ``cooldown_ms`` later or more, null without one.

    Times are cut into spans of a cooldown. Where the next span has a signal that is late enough it is found there, by a window over
    that span's signals and the places looked for; else it is the first of the next span after that which has any.
    """
    span = F.floor(F.col("at") / cooldown_ms)
    here = signals.select("pair", "at", span.alias("span"))
    firsts = here.groupBy("pair", "span").agg(F.min("at").alias("first"))
    looked = here.select("pair", (F.col("span") + 1).alias("span"), (F.col("at") + cooldown_ms).alias("place"), "at", F.lit(None).cast("bigint").alias("found"))
    there = here.select("pair", "span", F.col("at").alias("place"), F.lit(None).cast("bigint").alias("at"), F.col("at").alias("found"))
    later = Window.partitionBy("pair", "span").orderBy(F.desc("place")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = looked.unionByName(there).withColumn("to", F.min("found").over(later)).where("at is not null").select("pair", "at", "span", "to")
    spans = Window.partitionBy("pair").orderBy("span")  # one row a span
    ahead = firsts.select("pair", (F.col("span") + 1).alias("span"), *(F.lead(c, n).over(spans).alias(name) for name, c, n in (("one", "first", 1), ("one_span", "span", 1), ("two", "first", 2))))
    met = near.join(ahead, ["pair", "span"])
    beyond = F.when(F.col("one_span") == F.col("span"), F.col("two")).otherwise(F.col("one"))
    return met.select("pair", "at", F.coalesce("to", beyond).alias("to"))


def cooled_by_doubling(signals: DataFrame, cooldown_ms: int) -> DataFrame:
    """What ``cooled`` gives, with no pair in one task: from the first signal of each pair along ``successors``, whose jumps double
    their length each round. Only signals that others lead to are kept, of a span at most as many as the span before has."""
    steps = materialize(successors(signals.select("pair", F.col("at").cast("bigint").alias("at")).distinct(), cooldown_ms))
    reached = materialize(steps.groupBy("pair").agg(F.min("at").alias("at")))
    led_to = steps.where("to is not null").select("pair", F.col("to").alias("at")).unionByName(reached).distinct()
    jumps = materialize(steps.where("to is not null").join(led_to, ["pair", "at"], "left_semi"))
    while not jumps.isEmpty():
        on = jumps.select("pair", F.col("at").alias("to"), F.col("to").alias("__to"))
        more = reached.join(jumps, ["pair", "at"]).select("pair", F.col("to").alias("at"))
        reached = materialize(reached.unionByName(more).distinct())
        jumps = materialize(jumps.join(on, ["pair", "to"]).select("pair", "at", F.col("__to").alias("to")))
    return reached


def cooled_in_order(signals: DataFrame, cooldown_ms: int) -> DataFrame:
    """What ``cooled`` gives, a pair in one task: its sorted signals stream through, just the time of the last firing is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, fired = None, None
        for batch in batches:
            keep = []
            for i, (p, at) in enumerate(zip(batch.column("pair").to_pylist(), batch.column("at").to_pylist(), strict=True)):
                if p != pair or fired is None or at - fired >= cooldown_ms:
                    pair, fired = p, at
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    rows = signals.select("pair", F.col("at").cast("bigint").alias("at")).where("pair is not null and at is not null")
    return rows.repartition(F.col("pair")).sortWithinPartitions("pair", "at").mapInArrow(run, rows.schema)


def ledger(trades: DataFrame, target: float = T.target) -> DataFrame:
    """The 19 columns of the ledger as text. Numbers are rounded half-even before they are formatted."""

    def fixed(c: Column, n: int) -> Column:
        return F.format_string(f"%.{n}f", F.bround(c, n))

    days, profit = F.col("days_to_resolution"), F.col("profit")
    contracts = F.when(F.col("b_vwap") > 0, F.lit(float(target)) / F.col("b_vwap"))
    return trades.select(
        iso_millis(F.col("at")).alias("timestamp"),
        *(F.substring(c, 1, 80).alias(c) for c in ("a_event_title", "b_event_title", "a_question")),
        "b_ticker", "direction",
        *(fixed(F.col(c), 4).alias(c) for c in ("a_vwap", "b_vwap", "total_cost")),
        fixed(profit, 4).alias("projected_profit"),
        fixed(F.lit(float(target)), 2).alias("capital_deployed"),
        *(F.col(c).cast("string").alias(c) for c in ("a_staleness_ms", "b_staleness_ms")),
        fixed(days, 2).alias("days_to_resolution"),
        fixed(F.col("required"), 4).alias("required_return_for_period"),
        fixed(F.when(days > 0, profit * (F.lit(365.0) / days)).otherwise(0.0), 4).alias("annualized_return"),
        "resolution_date",
        fixed(F.lit(T.a_fee), 4).alias("a_fee_pct"),
        fixed(P.fee_rate(F.col("b_vwap"), contracts), 4).alias("b_fee_pct"),
    )
