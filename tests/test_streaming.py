"""State of running engines: what a message reads, when state goes, restarts, and counts while running."""

import datetime
import os
import time
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions.values import Thresholds
from gridloom.operators import books
from gridloom.plans import queries as engine
from gridloom.streaming import engine as streaming

DATA = "/root/testdata/sf0.001"
TITLES = ("a_event_title", "b_event_title", "a_question", "resolution_date")


def landed(spark, folder, parts):
    """A stream that reads one part after the other."""
    for i, part in enumerate(parts):
        d = folder / f"k={i}"
        part.coalesce(1).write.parquet(str(d))
        for f in d.iterdir():
            os.utime(f, (1_000_000 + 100 * i,) * 2)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))


class Map:
    def __init__(self):
        self.held, self.reads = {}, 0

    def getValue(self, key):  # noqa: N802
        self.reads += 1
        return self.held.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.held[key] = value

    def removeKey(self, key):  # noqa: N802
        self.held.pop(key, None)

    def iterator(self):
        raise AssertionError("all of an event is read")


class Value:
    def __init__(self):
        self.held = None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


def frames(n_markets, messages):
    """Deltas and full books of an event of so many markets, one pair each, a frame a message."""
    for k in range(messages):
        m = k % n_markets
        book = (f"M{m}/yes", f"M{m}/no", f"A{m}y", f"A{m}n")[k // n_markets % 4]
        row = {"event": "E", "seq": k, "item": 0, "pos": 0, "recv_ms": 1000 * k, "kind": "delta" if book[0] == "M" else "absolute", "book": book, "side": "bid" if book[0] == "M" else "ask"}
        row |= {"tick": 3000 + 100 * (k % 7), "qty": 500_000, "pair": f"P{m}", "a_yes": f"A{m}y", "a_no": f"A{m}n", "b_ticker": f"M{m}", "days": 30.0, "capped": False, "n_markets": n_markets, "ends_ms": None}
        yield pd.DataFrame([row])


def test_a_message_reads_what_it_touches():
    """Reads by message don't grow with the event, and what is read back is what one pass over all messages gives."""
    t, most = Thresholds(stale_ms=10**9, oversum=1e6), {}
    for n in (4, 60):
        maps, event = {}, Value()
        handle = SimpleNamespace(getMapState=lambda name, *_, maps=maps: maps.setdefault(name, Map()), getValueState=lambda *_, event=event: event, registerTimer=None)
        state, got, want = streaming.Signals(t), [], streaming.Event()
        state.init(handle)
        expected = []
        for frame in frames(n, 8 * n):
            before = sum(m.reads for m in maps.values())
            got += [tuple(r) for out in state.handleInputRows(("E",), iter([frame]), None) for r in out.itertuples(index=False)]
            most[n] = max(most.get(n, 0), sum(m.reads for m in maps.values()) - before)
            expected += streaming.feed(want, frame, t)
        assert [r[:7] for r in got] == [r[:7] for r in expected] and {r[4] for r in got} >= {"seen", "unseen", "thin"}
        assert event.held[2:4] == (want.tops, want.markets) and want.markets == n
    assert most[4] == most[60] <= 12


def test_state_goes_after_resolution(spark, tmp_path):
    at = lambda s: datetime.datetime(2026, 1, 1, 0, 0, s)
    schema = "seq bigint, recv_ts timestamp, kind string, book string, side string, tick bigint, qty bigint"
    times = [(0, 1, "A0y"), (1, 2, "M0/yes"), (2, 3, "A1y"), (3, 30, "M1/yes"), (4, 31, "A0y"), (5, 40, "M1/yes"), (6, 50, "M1/yes")]
    log = spark.createDataFrame([(k, at(s), "absolute", b, "bid", 4000, 100) for k, s, b in times], schema)
    pairs = spark.createDataFrame([("E0", "P0", "A0y", "A0n", "M0", 9.0, False, at(20)), ("E1", "P1", "A1y", "A1n", "M1", 9.0, False, None)], "event string, pair string, a_yes string, a_no string, b_ticker string, days double, capped boolean, ends timestamp")
    want = sorted((r.seq, r.outcome) for r in streaming.replay(log, pairs).collect())
    assert {k for k, _ in want} == {0, 1, 2, 3, 5, 6}  # message 4 comes after its pair resolved
    source = landed(spark, tmp_path / "in", [log.where("seq < 3"), *(log.where(f"seq = {k}") for k in (3, 4, 5, 6))])
    ck = str(tmp_path / "ck")
    streaming.stream(source, pairs, delay="1 second").writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted((r.seq, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
    for name in ("books", "seen"):
        left = spark.read.format("statestore").option("path", ck).option("stateVarName", name).load()
        assert {r.event for r in left.select("key.*").collect()} == {"E1"}
    early = spark.read.format("statestore").option("path", ck).option("stateVarName", "books").option("batchId", 0).load()
    assert {r.event for r in early.select("key.*").collect()} == {"E0", "E1"}


@pytest.mark.parametrize("fails_after", ["outcomes", "ledger"])
def test_a_restart_gives_each_trade_once(spark, tmp_path, monkeypatch, fails_after):
    """The second batch fails when a part of it is written. The engine starts again from its checkpoint, runs that batch again, and
    goes on with the books and cooldowns it had."""
    log, pairs = engine._feed(spark, DATA)
    pairs = pairs.withColumns({c: F.lit(c) for c in TITLES})
    source = landed(spark, tmp_path / "in", [log.where(f"seq % 1000 >= {lo} and seq % 1000 < {lo + 250}") for lo in (0, 250, 500, 750)])
    folder, step = str(tmp_path / "out"), {"outcomes": "trades", "ledger": "counters"}[fails_after]
    inner, calls = getattr(streaming, step), []

    def failing(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("the driver is lost")
        return inner(*args)

    monkeypatch.setattr(streaming, step, failing)
    with pytest.raises(Exception, match="the driver is lost"):
        streaming.run(source, pairs, folder, f"broken-{fails_after}", engine.FEED_LIMITS).awaitTermination()
    assert len(os.listdir(f"{folder}/counters")) == 1
    streaming.run(source, pairs, folder, f"again-{fails_after}", engine.FEED_LIMITS).awaitTermination()
    want = streaming.replay(log, pairs, engine.FEED_LIMITS)
    ledger = spark.read.option("header", True).csv(f"{folder}/ledger")
    assert sorted(tuple(r) for r in ledger.drop("batch").collect()) == sorted(tuple(r) for r in streaming.trades(want, pairs).collect())
    kept = {r.counter: r.n for r in streaming.kept_counters(spark, folder).collect()}
    kept.pop("seen")
    assert kept == {r.counter: r.n for r in streaming.counters(want).collect()} and kept["trade"] > 1
    streaming.run(source, pairs, folder, f"idle-{fails_after}", engine.FEED_LIMITS).awaitTermination()  # nothing new: nothing changes
    assert ledger.count() == kept["trade"]


def test_status_of_a_running_engine(spark, tmp_path):
    """Counts observed in the query itself equal those of the log, active books included."""
    log, pairs = engine._feed(spark, DATA)
    pairs = pairs.withColumns({c: F.lit(c) for c in TITLES})
    source = landed(spark, tmp_path / "in", [log.where("seq < 500"), log.where("seq >= 500")])
    status = streaming.Status()
    spark.streams.addListener(status)
    try:
        streaming.run(source, pairs, str(tmp_path / "out"), "watched", engine.FEED_LIMITS).awaitTermination()
        for _ in range(100):  # progress comes by another thread
            if status._last.get("watched") == 1:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(status)
    got = {k: n for k, n in status.totals["watched"].items() if n}
    known = pairs.select(F.explode(F.array("a_yes", "a_no", F.concat("b_ticker", F.lit("/yes")), F.concat("b_ticker", F.lit("/no")))).alias("book"))
    assert got.pop("active_books") == books.active(known, log).head().n_active
    assert got == {r.counter: r.n for r in streaming.counters(streaming.replay(log, pairs, engine.FEED_LIMITS)).collect()}


@pytest.mark.parametrize("limit", [1.3, 2.0])
def test_the_timeline_is_the_gate(spark, limit):
    """The over-sum of an event after each message, from the best bids' changes, is what the replay's gate sees."""
    from dataclasses import replace

    log, pairs = engine._feed(spark, DATA)
    out = streaming.replay(log, pairs, replace(engine.FEED_LIMITS, oversum=limit)).where("outcome not in ('cooling', 'unseen')").collect()
    markets = pairs.select("event", F.concat("b_ticker", F.lit("/yes")).alias("book"))
    line = books.oversum_changes(log.where("book like '%/yes'"), markets, round(limit * 10_000), 3, pieces=5).orderBy("seq").collect()
    now = {}
    for r in sorted([*((x.seq, 0, x) for x in line), *((x.seq, 1, x) for x in out)], key=lambda r: r[:2]):
        if r[1] == 0:
            now[r[2].event] = r[2].is_oversum
        else:
            assert (r[2].outcome == "oversum") == now.get(r[2].event, False)
    assert {r.outcome == "oversum" for r in out} == {True, False}


def mixed_log(spark, rng, n):
    """Messages of one hot event and a small one: full books, lists of changes of several books, deltas, of unknown sides too."""
    log = []
    for seq in range(n):
        m = rng.randrange(4) if rng.random() < 0.9 else 4
        at = datetime.datetime(2026, 1, 1) + datetime.timedelta(milliseconds=700 * seq)
        kind = rng.choice(["snapshot", "absolute", "absolute", "delta", "delta"])
        rows = []
        if kind == "delta":
            rows = [(f"M{m}/{rng.choice(['yes', 'no'])}", "bid", rng.choice([None, *range(3000, 6000, 250)]), rng.randrange(-9000, 30_000))]
        elif kind == "absolute":
            rows = [(f"A{m}{rng.choice('yn')}", rng.choice(["ask", "ask", "bid"]), rng.randrange(2000, 6000, 250) + 4000 * (m == 2), rng.choice([0, 9000, 20_000])) for _ in range(rng.choice([1, 2, 3]))]
        else:
            book, side = rng.choice([(f"A{m}y", "ask"), (f"A{m}n", "ask"), (f"M{m}/yes", "bid"), (f"M{m}/no", "bid")])
            rows = [(book, "bid", None, None), *((book, side, tick + 4000 * book.startswith("A2"), rng.choice([0, 15_000, 30_000])) for tick in rng.sample(range(2000, 5000, 250), rng.randrange(5)))]
        item = rng.choice([0, 0, 1])
        log += [(seq, item, pos, at, kind, *r) for pos, r in enumerate(rows)]
    pairs = [("E0", f"P{m}", f"A{m}y", f"A{m}n", f"M{m}", 40.0 * m, m == 1) for m in range(4)] + [(None, "P4", "A4y", "A4n", "M4", None, False), ("E0", "P9", "A0y", "A3n", "M2", 90.0, False)]
    return spark.createDataFrame(log, "seq bigint, item int, pos int, recv_ts timestamp, kind string, book string, side string, tick bigint, qty bigint"), spark.createDataFrame(pairs, "event string, pair string, a_yes string, a_no string, b_ticker string, days double, capped boolean")


@pytest.mark.parametrize("pieces", [1, 7])
def test_sets_give_what_the_replay_gives(spark, pieces):
    import random

    from gridloom.streaming import by_sets

    log, pairs = mixed_log(spark, random.Random(pieces), 700)
    t = Thresholds(stale_ms=60_000, cooldown_ms=5_000, oversum=1.3, suspect=0.25, target=40.0)
    want = streaming.replay(log, pairs, t).collect()
    got = by_sets.replay(log.repartition(3), pairs, t, pieces).collect()
    assert {r.outcome for r in want} >= {"cooling", "unseen", "oversum", "stale", "thin", "no_edge", "suspect", "time_value", "trade"}
    key = lambda r: (r.seq, r.item, r.pair, r.outcome, r.direction or "")
    assert [tuple(r) for r in sorted(got, key=key)] == [tuple(r) for r in sorted(want, key=key)]


def test_sets_replay_the_log_once(spark, monkeypatch):
    """Walks and best bids come from one replay of the books, and the same best bids as from their own."""
    import random

    from gridloom.streaming import by_sets

    log, pairs = mixed_log(spark, random.Random(3), 60)
    t, calls = Thresholds(), []
    said = by_sets.quotes(log, t, 3).where("not best <=> before").select("book", "seq", "item", "best", "before")
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, said.collect()), key=key) == sorted(map(tuple, books.best_changes(log, "bid", 3).collect()), key=key)
    for module in (by_sets, books):
        held = module.in_pieces
        monkeypatch.setattr(module, "in_pieces", lambda *a, held=held: calls.append(1) or held(*a))
    by_sets.replay(log, pairs, t, 3)
    assert len(calls) == 1
