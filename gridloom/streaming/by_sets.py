"""The evaluation of a whole log by sets: what ``engine.replay`` gives, with no event, book or pair in one task.

Books are replayed in pieces and say after each message what a walk of either side gives. What a pair knows at a message is the last
of these of its four books, the over-sum of its event the last change of it: both are carried forward over ranges of messages. So
each evaluation is judged by itself but for cooldowns, and these are followed over the evaluations that would trade.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import pricing as P
from gridloom.functions.values import Thresholds
from gridloom.operators.books import Live, in_pieces, ordered, oversum_of, running_last
from gridloom.operators.signals import cooled
from gridloom.sources.tables import materialize
from gridloom.streaming.engine import OUTPUT, TICKS, UNITS, touching, walk

ROLES = {"ay": ("a_yes", ""), "an": ("a_no", ""), "by": ("b_ticker", "/yes"), "bn": ("b_ticker", "/no")}
WAYS = (("a_yes_b_no", "ay", "by"), ("a_no_b_yes", "an", "bn"))


def quotes(log: DataFrame, t: Thresholds, pieces: int | None = None) -> DataFrame:
    """(book, seq, item, pos, asks, ask_vwap, others, other_vwap, best, before): after each row that says something of a book, how many
    levels each side has and what a walk gives; ``other`` are the asks that the bids amount to. Best bids are those of
    ``best_changes``, so that the log is replayed once for both. A side is walked anew only where a row may have changed it."""

    def emit(state: Live, row: tuple) -> list[tuple]:
        book, seq, item, pos, kind, side, tick, qty = row
        asks, bids = state.levels["ask"], state.levels["bid"]
        told = state.__dict__.setdefault("told", {})
        before = told["bid"][2] if "bid" in told else max(bids, default=None)
        state.apply((seq, item), kind, side, tick, qty)
        if kind == "snapshot":
            told.clear()
            asks, bids = state.levels["ask"], state.levels["bid"]
        elif tick is None or qty is None:
            return []
        else:
            told.pop(side, None)
        if "ask" not in told:
            told["ask"] = len(asks), walk(((k / TICKS, asks[k] / UNITS) for k in sorted(asks)), t.target)
        if "bid" not in told:
            inside = [k for k in sorted(bids, reverse=True) if 0 < k < TICKS]
            told["bid"] = len(inside), walk(((round(1.0 - k / TICKS, 4), bids[k] / UNITS) for k in inside), t.target), max(bids, default=None)
        return [(book, seq, item, pos, *told["ask"], *told["bid"], before)]

    return in_pieces(log, emit, f"book {log.schema['book'].dataType.simpleString()}, seq bigint, item bigint, pos bigint, asks bigint, ask_vwap double, others bigint, other_vwap double, best bigint, before bigint", pieces)


def _known(log: DataFrame, pairs: DataFrame, said_of: DataFrame) -> DataFrame:
    """A row for each pair and message that touches it, with what is known of its four books: depth, vwap and ms of the last update."""
    touched = touching(log, pairs)
    keys = ("pair", "seq", "item")
    base = touched.groupBy("event", *keys).agg(F.first("recv_ms").alias("ms"), *(F.first(c).alias(c) for c in ("days", "capped", "n_markets", "a_yes", "a_no", "b_ticker")))
    last = said_of.groupBy("book", "seq", "item").agg(F.max_by(F.struct("asks", "ask_vwap", "others", "other_vwap"), "pos").alias("q")).select("book", "seq", "item", "q.*")
    said = touched.select("event", *keys, "book", F.col("recv_ms").alias("ms"), "a_yes", "a_no", "b_ticker").distinct().join(last, ["book", "seq", "item"])

    def of(role: str) -> Column:
        column, tail = ROLES[role]
        side = ("asks", "ask_vwap") if role[0] == "a" else ("others", "other_vwap")
        held = F.struct(F.col(side[0]).alias("depth"), F.col(side[1]).alias("vwap"), F.col("ms"))
        return F.max(F.when(F.col("book") == F.concat(F.col(column), F.lit(tail)), held)).alias(role)

    now = said.groupBy("event", *keys).agg(*map(of, ROLES))
    return running_last(base.join(now, ["event", *keys], "left"), "pair", ("seq", "item"), tuple(ROLES))


def _gated(rows: DataFrame, pairs: DataFrame, said_of: DataFrame, t: Thresholds) -> DataFrame:
    """``rows`` with oversum: whether the event's best bids sum up to too much at the message."""
    yes = F.concat("b_ticker", F.lit("/yes"))
    markets = pairs.where(F.coalesce("event", F.lit("")) != "").select("event", yes.alias("book")).distinct()
    steps = said_of.where(~F.col("best").eqNullSafe(F.col("before"))).select("book", "seq", "item", "best", "before")
    changes = oversum_of(steps, markets, round(t.oversum * TICKS, 6), t.oversum_markets).select("event", "seq", "item", F.col("is_oversum").alias("oversum"))
    each = rows.select("event", "seq", "item").distinct().join(changes, ["event", "seq", "item"], "full")
    carried = running_last(each, "event", ("seq", "item"), ("oversum",))
    return rows.join(carried, ["event", "seq", "item"], "left").withColumn("oversum", F.coalesce("oversum", F.lit(False)))


def _with_way(rows: DataFrame, name: str, direction: str, a: str, b: str, t: Thresholds) -> DataFrame:
    """``rows`` with what one direction gives: the outcome, and all that a trade is written with.

    What later steps name more than once is a column of its own step, as an expression in their place would be evaluated each time.
    """
    held = {"a_vwap": F.col(f"{a}.vwap"), "b_vwap": F.col(f"{b}.vwap"), "a_staleness_ms": F.col("ms") - F.col(f"{a}.ms"), "b_staleness_ms": F.col("ms") - F.col(f"{b}.ms")}
    rows = rows.withColumns({f"__{k}": c for k, c in held.items()})
    va, vb, *ages = (F.col(f"__{k}") for k in held)
    cost, profit, value = (F.col(f"__{k}") for k in ("cost", "profit", "value"))
    rows = rows.withColumn("__cost", P.round_trip_cost(va, vb, t.target, t))
    rows = rows.withColumn("__profit", F.lit(1.0) - cost)
    rows = rows.withColumn("__value", P.time_value(profit, F.col("days"), F.col("capped"), t))
    stale = reduce(lambda x, y: x | y, (age.isNull() | (age > t.stale_ms) for age in ages))
    priced = F.coalesce((va > 0) & (vb > 0), F.lit(False))
    outcome = (
        F.when(stale, "stale").when(F.least(f"{a}.depth", f"{b}.depth") < t.levels, "thin").when(~priced | F.coalesce(cost >= 1, F.lit(True)), "no_edge")
        .when(profit > t.suspect, "suspect").when(~value["ok"], "time_value").otherwise("trade")
    )
    rows = rows.withColumn("__outcome", outcome)
    told = {"a_vwap": va, "b_vwap": vb, "cost": cost, "profit": profit, "required": value["required"], "a_staleness_ms": ages[0], "b_staleness_ms": ages[1]}
    only = F.col("__outcome") == "trade"
    rows = rows.withColumn(name, F.struct(F.col("__outcome").alias("outcome"), F.lit(direction).alias("direction"), *(F.when(only, c).alias(n) for n, c in told.items())))
    return rows.withColumn(f"{name}_trades", only).drop(*(c for c in rows.columns if c.startswith("__")))


def replay(messages: DataFrame, pairs: DataFrame, t: Thresholds = Thresholds(), pieces: int | None = None) -> DataFrame:
    """The rows that ``engine.replay`` gives, for logs whose ``recv_ts`` never goes back along a pair's messages.

    The books' pieces, what they say, what pairs know, and the evaluations are written, so building the result runs jobs.
    """
    log = ordered(messages)
    said_of = materialize(quotes(log, t, pieces))
    known = _gated(_known(log, pairs, said_of), pairs, said_of, t)
    judged = known.withColumn("unseen", F.col("ay").isNull() | F.col("by").isNull())
    for name, way in zip(("one", "two"), WAYS, strict=True):
        judged = _with_way(judged, name, *way, t)
    would = ~F.col("unseen") & ~F.col("oversum") & (F.col("one_trades") | F.col("two_trades"))
    rows = materialize(judged.withColumn("would", would).select("event", "pair", "seq", "item", "ms", "unseen", "oversum", "one", "two", "would"))
    fired = cooled(rows.where("would").select("pair", F.col("ms").alias("at")), t.cooldown_ms)
    first = rows.where("would").join(fired, (rows["pair"] == fired["pair"]) & (rows["ms"] == fired["at"])).groupBy(rows["pair"], "ms").agg(F.min(F.struct("seq", "item")).alias("x"))
    fires = first.select("pair", F.col("x.seq").alias("seq"), F.col("x.item").alias("item"), F.col("ms").alias("fired"))
    told = running_last(rows.join(fires, ["pair", "seq", "item"], "left").withColumn("since", F.col("fired")), "pair", ("seq", "item"), ("since",))
    cooling = F.col("fired").isNull() & F.col("since").isNotNull() & (F.col("ms") - F.col("since") < t.cooldown_ms)

    def alone(outcome: str) -> Column:
        return F.array(F.struct(F.lit(outcome).alias("outcome"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema["one"].dataType.fields[1:])))

    both = F.when(F.col("one.outcome") == "trade", F.array("one")).otherwise(F.array("one", "two"))
    says = F.when(cooling, alone("cooling")).when(F.col("unseen"), alone("unseen")).when(F.col("oversum"), alone("oversum")).otherwise(both)
    out = told.select("event", "seq", F.col("item").cast("int").alias("item"), "pair", F.col("ms").alias("at"), F.explode(says).alias("x"))
    return out.select("*", "x.*").select(*(c.split()[0] for c in OUTPUT.split(", ")))
