"""Stateful evaluation of pairs, in a stream or over a log: one class holds the state of an event, both feed it.

State is keyed by the B venue's event, as over-sum needs all its books. Input rows are messages joined with the pairs they
touch: event, seq, item, pos, recv_ms, kind, book, side, tick, qty, pair, a_yes, a_no, b_ticker, days, capped, n_markets, ends_ms.
A message that comes after a later one of its event, or comes again, is late: it changes no book and is not evaluated.

A message reads and writes the books of its pairs, their times and cooldowns, and one row on the event: the number and sum of its
markets' best bids, so that over-sum needs no other book. Where pairs say when they resolve, messages from then on fall away, and
an event's state goes once the watermark has passed the last of its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import attrgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from gridloom.functions.values import Thresholds
from gridloom.operators.books import ordered
from gridloom.operators.signals import ledger

INPUT = ("event", "seq", "item", "pos", "recv_ms", "kind", "book", "side", "tick", "qty", "pair", "a_yes", "a_no", "b_ticker", "days", "capped", "n_markets", "ends_ms")
OUTPUT = "event string, seq bigint, item int, pair string, outcome string, at bigint, direction string, a_vwap double, b_vwap double, cost double, profit double, required double, a_staleness_ms bigint, b_staleness_ms bigint"
TICKS, UNITS = 10_000, 100
#: The outcome of a row that says that a book (in ``pair``) was seen for the first time; streams and replays count it apart.
SEEN = "seen"


def missing(x: object) -> bool:
    return x is None or (isinstance(x, float) and math.isnan(x))


class Held(dict):
    """Values by key that are read when first asked for, None where there is none, and the keys that changed."""

    def __init__(self, read: Callable = lambda key: None) -> None:
        super().__init__()
        self.read, self.changed = read, set()

    def __missing__(self, key: object) -> object:
        self[key] = value = self.read(key)
        return value

    def put(self, key: object, value: object) -> None:
        self[key] = value
        self.changed.add(key)


class Event:
    """Books and cooldowns of one event, its last message, and the sum and number of its markets' best bids."""

    def __init__(self, levels: Callable = lambda key: None, seen: Callable = lambda key: None, fired: Callable = lambda key: None) -> None:
        self.last: tuple[int, int] | None = None
        self.levels, self.seen, self.fired = Held(levels), Held(seen), Held(fired)
        self.tops = self.markets = 0
        self.new: list[str] = []

    def side(self, book: str, side: str) -> dict[int, int]:
        return self.levels[book, side] or {}

    def _count(self, book: str, sign: int) -> None:
        if book.endswith("/yes") and (bids := self.side(book, "bid")):
            self.tops += sign * max(bids)
            self.markets += sign

    def _see(self, book: str, now: int) -> None:
        if self.seen[book] is None:
            self.new.append(book)
        self.seen.put(book, now)

    def apply(self, rows: list) -> None:
        """One message, rows in order. A snapshot clears its books first, and its sizes of 0 say nothing."""
        cleared, touched = set(), {r.book for r in rows}
        for book in touched:
            self._count(book, -1)
        for r in rows:
            if r.kind == "snapshot" and r.book not in cleared:
                cleared.add(r.book)
                self._see(r.book, int(r.recv_ms))
                for side in ("bid", "ask"):
                    self.levels.put((r.book, side), {})
            if missing(r.tick) or missing(r.qty):
                continue
            tick, qty = int(r.tick), int(r.qty)
            if r.kind == "snapshot" and qty <= 0:
                continue
            side = self.side(r.book, r.side)
            size = max(side.get(tick, 0) + qty, 0) if r.kind == "delta" else qty
            if size > 0:
                side[tick] = size
            else:
                side.pop(tick, None)
            self.levels.put((r.book, r.side), side)
            self._see(r.book, int(r.recv_ms))
        for book in touched:
            self._count(book, 1)

    def age(self, book: str, now: int) -> int | None:
        """None for a book never seen."""
        return None if self.seen[book] is None else now - self.seen[book]

    def asks(self, book: str) -> list[tuple[float, float]]:
        return sorted((t / TICKS, q / UNITS) for t, q in self.side(book, "ask").items())

    def complement(self, book: str) -> list[tuple[float, float]]:
        """Asks of the other outcome from this one's bids."""
        out = {round(1.0 - t / TICKS, 4): q / UNITS for t, q in sorted(self.side(book, "bid").items())}
        return sorted((p, q) for p, q in out.items() if 0 < p < 1)

    def oversum(self, n_markets: int, t: Thresholds) -> bool:
        return min(n_markets, self.markets) >= t.oversum_markets and self.tops > round(t.oversum * TICKS, 6)


def walk(asks: list[tuple[float, float]], target: float) -> float | None:
    cost = shares = 0.0
    for price, size in asks:
        if 0 < price < 1:
            if cost >= target:
                break
            take = min(size, (target - cost) / price)
            cost, shares = cost + take * price, shares + take
    return cost / shares if shares else None


def leg_cost(a: float, b: float, t: Thresholds) -> float:
    contracts = t.target / b
    fee = math.ceil(t.fee * contracts * b * (1.0 - b) * 100) / 100.0 if 0 < b < 1 else 0.0
    return a * (1.0 + t.a_fee) + b * (1.0 + fee / (contracts * b))


def evaluate(state: Event, r: object, t: Thresholds) -> Iterator[tuple]:
    """Outcomes of one pair at one message; a trade ends the evaluation and starts the cooldown."""
    now = int(r.recv_ms)

    def row(outcome: str, direction: str | None = None, *rest: object) -> tuple:
        return (r.event, int(r.seq), int(r.item), r.pair, outcome, now, direction, *(rest or (None,) * 7))

    if state.fired[r.pair] is not None and now - state.fired[r.pair] < t.cooldown_ms:
        yield row("cooling")
        return
    yes, no = f"{r.b_ticker}/yes", f"{r.b_ticker}/no"
    if state.seen[r.a_yes] is None or state.seen[yes] is None:
        yield row("unseen")
        return
    if state.oversum(int(r.n_markets), t):
        yield row("oversum")
        return
    for direction, a_book, b_book in (("a_yes_b_no", r.a_yes, yes), ("a_no_b_yes", r.a_no, no)):
        ages = state.age(a_book, now), state.age(b_book, now)
        if None in ages or max(ages) > t.stale_ms:
            yield row("stale", direction)
            continue
        asks, others = state.asks(a_book), state.complement(b_book)
        if min(len(asks), len(others)) < t.levels:
            yield row("thin", direction)
            continue
        a, b = walk(asks, t.target), walk(others, t.target)
        if not a or not b or (cost := leg_cost(a, b, t)) >= 1:
            yield row("no_edge", direction)
            continue
        profit = 1.0 - cost
        if profit > t.suspect:
            yield row("suspect", direction)
            continue
        days = None if missing(r.days) else r.days
        required = t.risk_free * ((max(days, t.long_days) if r.capped else days) / 365.0) if days is not None and days >= t.min_days else None
        if required is None or profit < required:
            yield row("time_value", direction)
            continue
        state.fired.put(r.pair, now)
        yield row("trade", direction, a, b, cost, profit, required, *ages)
        return


def feed(state: Event, rows: pd.DataFrame, t: Thresholds) -> list[tuple]:
    """Outcomes of messages in order. A message's rows come once for each pair that it touches."""
    out: list[tuple] = []
    in_order = rows.sort_values(["seq", "item", "pair", "pos"], kind="stable").itertuples(index=False)
    for at, message in groupby(in_order, key=attrgetter("seq", "item")):
        levels, pairs = {}, {}
        for r in message:
            levels.setdefault((r.pos, r.book, r.side, None if missing(r.tick) else r.tick), r)
            pairs.setdefault(r.pair, r)
        if state.last is not None and at <= state.last:
            out.extend((r.event, int(r.seq), int(r.item), r.pair, "late", int(r.recv_ms), *(None,) * 8) for r in pairs.values())
            continue
        state.last = (int(at[0]), int(at[1]))
        state.apply(sorted(levels.values(), key=attrgetter("pos")))
        for r in pairs.values():
            out.extend(evaluate(state, r, t))
        r = next(iter(pairs.values()))
        out.extend((r.event, int(r.seq), int(r.item), book, SEEN, int(r.recv_ms), *(None,) * 8) for book in state.new)
        state.new.clear()
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])


class Signals(StatefulProcessor):
    """Keeps an event's books, times, cooldowns and last message in state: one row a side of a book, one a book or pair that is
    timed, one for the event. Only the keys that messages touch are read, and only what changed is written."""

    def __init__(self, t: Thresholds) -> None:
        self.t = t

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.books = handle.getMapState("books", "book string, side string", "ticks array<bigint>, sizes array<bigint>")
        self.seen = handle.getMapState("seen", "book string", "ms bigint")
        self.fired = handle.getMapState("fired", "pair string", "ms bigint")
        self.event = handle.getValueState("event", "seq bigint, item bigint, tops bigint, markets bigint, ends bigint")

    def _side(self, key: tuple[str, str]) -> dict[int, int] | None:
        row = self.books.getValue(key)
        return None if row is None else dict(zip(*row, strict=True))

    def _read(self) -> tuple[Event, int | None]:
        def ms(stored: object) -> Callable:
            return lambda key: None if (row := stored.getValue((key,))) is None else row[0]

        state, ends = Event(self._side, ms(self.seen), ms(self.fired)), None
        if (row := self.event.get()) is not None:
            seq, item, state.tops, state.markets, ends = row
            state.last = (seq, item)
        return state, ends

    def _write(self, state: Event, ends: int | None) -> None:
        for key in state.levels.changed:
            if side := state.levels[key]:
                self.books.updateValue(key, (list(side), list(side.values())))
            else:
                self.books.removeKey(key)
        for stored, held in ((self.seen, state.seen), (self.fired, state.fired)):
            for key in held.changed:
                stored.updateValue((key,), (held[key],))
        self.event.update((*state.last, state.tops, state.markets, ends))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, ends = self._read()
        frame = pd.concat(list(rows))
        out = feed(state, frame, self.t)
        due = frame["ends_ms"].iloc[0]
        due = None if missing(due) else int(due)
        if due != ends:  # new, or the pairs say otherwise now
            if ends is not None:
                self.handle.deleteTimer(ends)
            if due is not None:
                self.handle.registerTimer(due)
        self._write(state, due)
        yield _frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """All pairs of the event have resolved: nothing of it is needed any more."""
        for stored in (self.books, self.seen, self.fired, self.event):
            stored.clear()
        return iter(())

    def close(self) -> None:
        pass


def touching(messages: DataFrame, pairs: DataFrame) -> DataFrame:
    """Messages with the pairs they touch: ``pairs(event, pair, a_yes, a_no, b_ticker, days, capped)``, and ends (timestamp) where
    pairs resolve; others fall away, and messages from then on. ends_ms is when the last pair of the event resolves, null if one
    never does."""
    pairs = pairs if "ends" in pairs.columns else pairs.withColumn("ends", F.lit(None).cast("timestamp"))
    named = F.coalesce("event", F.lit("")) != ""
    last = F.when(F.count_if(F.col("ends").isNull()) == 0, F.unix_millis(F.max("ends")))
    markets = pairs.where(named).groupBy("event").agg(F.count_distinct("b_ticker").alias("n_markets"), last.alias("ends_ms"))
    known = pairs.withColumn("event", F.when(named, F.col("event")).otherwise(F.concat(F.lit("pair:"), "pair"))).join(markets, "event", "left")
    known = known.withColumns({"n_markets": F.coalesce("n_markets", F.lit(0)), "ends_ms": F.when(named & ~F.startswith("event", F.lit("pair:")), F.col("ends_ms")).otherwise(F.unix_millis("ends"))})
    of = F.explode(F.array("a_yes", "a_no", F.concat("b_ticker", F.lit("/yes")), F.concat("b_ticker", F.lit("/no"))))
    met = ordered(messages).join(known.withColumn("book", of), "book").where(F.col("ends").isNull() | (F.col("recv_ts") < F.col("ends")))
    return met.withColumn("recv_ms", F.unix_millis("recv_ts"))


def evaluated(messages: DataFrame, pairs: DataFrame, t: Thresholds = Thresholds(), delay: str | None = None) -> DataFrame:
    """All rows of a stream, those that say that a book was seen as well. With ``delay``, how late messages may be (such as "10
    minutes"), the state of resolved events goes; rows later than that are dropped then."""
    if delay is None:
        return touching(messages, pairs).select(*INPUT).groupBy("event").transformWithStateInPandas(Signals(t), OUTPUT, "Append", "None")
    met = touching(messages.withWatermark("recv_ts", delay), pairs).select(*INPUT, "recv_ts")
    return met.groupBy("event").transformWithStateInPandas(Signals(t), OUTPUT, "Append", "EventTime")


def stream(messages: DataFrame, pairs: DataFrame, t: Thresholds = Thresholds(), delay: str | None = None) -> DataFrame:
    """Outcomes of a stream of messages."""
    return evaluated(messages, pairs, t, delay).where(F.col("outcome") != SEEN)


def replay(messages: DataFrame, pairs: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """The same outcomes over a whole log. Rows stream in order, so just the state of one event is held, not its log."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        event, state, held = None, Event(), None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame])
            last = (frame[["event", "seq", "item"]] == frame[["event", "seq", "item"]].iloc[-1]).all(axis=1)
            frame, held = frame[~last], frame[last]  # the last message may go on
            out = []
            for name, part in frame.groupby("event", sort=False):
                if name != event:
                    event, state = name, Event()
                out += feed(state, part, t)
            yield _frame(out)
        if held is not None:
            yield _frame(feed(state if held["event"].iloc[0] == event else Event(), held, t))

    rows = touching(messages, pairs).select(*INPUT).repartition("event").sortWithinPartitions("event", "seq", "item", "pair", "pos")
    return rows.mapInPandas(run, OUTPUT).where(F.col("outcome") != SEEN)


def counters(outcomes: DataFrame) -> DataFrame:
    """(counter, n): evaluations, each outcome's count, late messages and books seen, of a log's outcomes or of a batch of a stream.

    An evaluation ends at once with one row, or looks at one direction or both; the first direction counts it.
    """
    whole = F.col("direction").isNull() & ~F.col("outcome").isin("late", SEEN)
    first = F.when(whole | (F.col("direction") == "a_yes_b_no"), "evaluations")
    return outcomes.select(F.explode(F.array_compact(F.array(F.col("outcome"), first))).alias("counter")).groupBy("counter").agg(F.count("*").alias("n"))


def trades(outcomes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ledger's 19 columns for the trades of ``outcomes``; ``pairs`` has the titles and resolution_date as well."""
    known = pairs.select("pair", "a_event_title", "b_event_title", "a_question", "b_ticker", F.col("days").alias("days_to_resolution"), "resolution_date")
    rows = outcomes.where("outcome = 'trade'").withColumns({"at": F.timestamp_millis("at"), "total_cost": F.col("cost")})
    return ledger(rows.join(known, "pair"))


def to_ledger(outcomes: DataFrame, pairs: DataFrame, path: str, checkpoint: str) -> object:
    """Appends the trades of a stream as ledger files, each once."""
    rows = trades(outcomes, pairs)
    return rows.writeStream.outputMode("append").format("csv").option("header", True).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


OUTCOMES = ("cooling", "unseen", "oversum", "stale", "thin", "no_edge", "suspect", "time_value", "trade", "late")


class Status(StreamingQueryListener):
    """What running engines have done so far, by query name: evaluations, the count of each outcome and active books, observed in
    the query itself. A batch counts once, however often it is run."""

    def __init__(self) -> None:
        self.totals: dict[str, dict[str, int]] = {}
        self._last: dict[str, int] = {}

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        p = event.progress
        seen = p.observedMetrics.get("status")
        if seen is None or p.batchId <= self._last.get(p.name, -1):
            return
        self._last[p.name] = p.batchId
        held = self.totals.setdefault(p.name, {})
        for counter, n in seen.asDict().items():
            held[counter] = held.get(counter, 0) + (n or 0)

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        pass


def observed(rows: DataFrame) -> DataFrame:
    """``evaluated`` rows, counted by outcome where they pass."""
    first = F.col("outcome").isin(*OUTCOMES) & (F.col("outcome") != "late") & (F.col("direction").isNull() | (F.col("direction") == "a_yes_b_no"))
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    return rows.observe("status", F.count_if(first).alias("evaluations"), *counts, F.count_if(F.col("outcome") == SEEN).alias("active_books"))


def run(messages: DataFrame, pairs: DataFrame, folder: str, name: str, t: Thresholds = Thresholds(), delay: str | None = None, **trigger: object) -> object:
    """Starts the engine: one stateful query that keeps ``folder``/outcomes, /ledger and /counters, and counts into ``Status``.

    A batch is evaluated once and written as the partition batch=<id> of the outcomes; ledger and counters are made of that
    partition. A batch that failed half-way is run again under its id and overwrites what it left, so each trade is there once. The
    checkpoint is ``folder``/checkpoint: a new start goes on where the last one ended, books and cooldowns included.
    """
    spark = messages.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        def part(kind: str) -> str:
            return f"{folder}/{kind}/batch={batch_id}"

        batch.write.mode("overwrite").parquet(part("outcomes"))
        done = spark.read.schema(batch.schema).parquet(part("outcomes"))
        trades(done, pairs).write.mode("overwrite").option("header", True).csv(part("ledger"))
        counters(done).coalesce(1).write.mode("overwrite").parquet(part("counters"))

    rows = observed(evaluated(messages, pairs, t, delay))
    return rows.writeStream.foreachBatch(write).queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def kept_counters(spark: SparkSession, folder: str) -> DataFrame:
    """(counter, n) of all batches that ``run`` has written to ``folder``."""
    return spark.read.parquet(f"{folder}/counters").groupBy("counter").agg(F.sum("n").alias("n"))
