import math
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridloom.plans import queries as engine
from gridloom.streaming import engine as streaming

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(None if x != x else x for x in r) for r in df[columns].astype(object).values.tolist()), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    assert plain(engine.QUERIES[name](spark, DATA).toPandas()) == plain(duck.sql(engine.ORACLE_SQL[name]).df())


def test_entry(spark):
    got = entry.entry(spark)
    assert isinstance(got, DataFrame) and got.count() >= 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    scores = plan_of(engine.QUERIES["scores_s1"](spark, DATA))
    assert "Cartesian" not in scores and "NestedLoop" not in scores
    assert "PushedFilters: [In(c_mktsegment" in plan_of(engine.QUERIES["scan_category"](spark, DATA))
    assert "ReadSchema: struct<user_id" not in plan_of(engine.QUERIES["vwap"](spark, DATA))


@pytest.mark.parametrize("name", ["scores_s1", "scores_s2", "scores_s3", "scores_s4"])
def test_pairs_are_scored_where_events_are_dealt_to(spark, name):
    """Not in the tasks that read one small file, nor with digits looked for once a pair."""
    plan = plan_of(engine.QUERIES[name](spark, DATA))
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "SortMergeJoin [event" in joins[0] and "RLIKE" not in joins[0]
    # a side's titles are dealt out right above their scan, before tokens and entities are found
    assert plan.count("REPARTITION_BY_COL") >= 2


KEYS = ["seq", "pair", "outcome", "direction", "cost", "profit"]


def streamed(spark, tmp_path, parts, pairs):
    """Outcomes of a stream that reads one part after the other."""
    for i, part in enumerate(parts):
        d = tmp_path / "in" / f"k={i}"
        part.coalesce(1).write.parquet(str(d))
        for f in d.iterdir():
            os.utime(f, (1_000_000 + 100 * i,) * 2)
    source = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = streaming.stream(source, pairs, engine.FEED_LIMITS)
    out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def told(df):
    return sorted(map(tuple, df.select(*KEYS).collect()), key=repr)


def test_stream_equals_replay(spark, tmp_path):
    log, pairs = engine._feed(spark, DATA)
    got = streamed(spark, tmp_path, [log.where("seq < 500"), log.where("seq >= 500")], pairs)
    want = streaming.replay(log, pairs, engine.FEED_LIMITS)
    assert told(got) == told(want) and any(r[2] == "trade" for r in told(got))
    status = {r.counter: r.n for r in streaming.counters(got).collect()}
    assert status["trade"] == got.where("outcome = 'trade'").count() and status["evaluations"] == got.select("seq", "item", "pair").distinct().count()


def test_late_messages(spark, tmp_path):
    """The later half first: what comes after it is late, of each event, and changes nothing."""
    log, pairs = engine._feed(spark, DATA)
    early, late = log.where("seq < 500"), log.where("seq >= 500")
    got = told(streamed(spark, tmp_path, [late, early], pairs))
    want = told(streaming.replay(late, pairs, engine.FEED_LIMITS))
    assert [r for r in got if r[2] != "late"] == want
    assert {r[0] for r in got if r[2] == "late"} and all(r[0] < 500 for r in got if r[2] == "late")
    assert len(got) - len(want) == streaming.touching(early, pairs).select("seq", "pair").distinct().count()


def plain_outcomes(log, pairs, t):
    """One loop over all messages with dictionaries of float prices, written apart from the engine."""
    bids, asks, seen, fired, out = {}, {}, {}, {}, Counter()
    for m in sorted(log, key=lambda m: m.seq):
        touched = [p for p in pairs if m.book in (p.a_yes, p.a_no, p.b_ticker + "/yes", p.b_ticker + "/no")]
        if not touched:
            continue
        book = (asks if m.side == "ask" else bids).setdefault(m.book, {})
        size = m.qty if m.kind == "absolute" else max(0, book.get(m.tick, 0) + m.qty)
        book[m.tick] = size
        if size <= 0:
            del book[m.tick]
        now = seen[m.book] = round(m.recv_ts.timestamp() * 1000)
        for p in touched:
            if now - fired.get(p.pair, -math.inf) < t.cooldown_ms:
                out[p.pair, "cooling"] += 1
                continue
            if p.a_yes not in seen or p.b_ticker + "/yes" not in seen:
                out[p.pair, "unseen"] += 1
                continue
            tops = [max(bids[k]) / 10_000 for q in pairs if q.event == p.event and bids.get(k := q.b_ticker + "/yes")]
            if len(tops) >= 3 and sum(tops) > t.oversum:
                out[p.pair, "oversum"] += 1
                continue
            for a, b in ((p.a_yes, p.b_ticker + "/yes"), (p.a_no, p.b_ticker + "/no")):
                if a not in seen or b not in seen or now - seen[a] > t.stale_ms or now - seen[b] > t.stale_ms:
                    out[p.pair, "stale"] += 1
                    continue
                mine = sorted((k / 10_000, q / 100) for k, q in asks.get(a, {}).items())
                theirs = sorted((1 - k / 10_000, q / 100) for k, q in bids.get(b, {}).items() if 0 < k < 10_000)
                if len(mine) < t.levels or len(theirs) < t.levels:
                    out[p.pair, "thin"] += 1
                    continue
                prices = []
                for side in (mine, theirs):
                    money = shares = 0.0
                    for price, q in side:
                        got = max(0.0, min(q, (t.target - money) / price))
                        money, shares = money + got * price, shares + got
                    prices.append(money / shares)
                n = t.target / prices[1]
                cost = prices[0] + prices[1] * (1 + math.ceil(0.07 * n * prices[1] * (1 - prices[1]) * 100) / 100 / (n * prices[1]))
                if cost >= 1:
                    out[p.pair, "no_edge"] += 1
                elif 1 - cost > t.suspect:
                    out[p.pair, "suspect"] += 1
                elif p.days < t.min_days or 1 - cost < t.risk_free * (max(p.days, t.long_days) if p.capped else p.days) / 365:
                    out[p.pair, "time_value"] += 1
                else:
                    out[p.pair, "trade"] += 1
                    fired[p.pair] = now
                    break
    return out


@pytest.mark.parametrize("d", [DATA, "/root/testdata/sf0.01"])
def test_replay_against_a_plain_loop(spark, d):
    log, pairs = engine._feed(spark, d)
    got = {(r.pair, r.outcome): r.n for r in engine.replay_outcomes(spark, d).collect()}
    want = plain_outcomes(log.collect(), pairs.collect(), engine.FEED_LIMITS)
    assert got == dict(want) and len({o for _, o in got}) >= 6
    status = {r.counter: r.n for r in engine.replay_status(spark, d).collect()}
    assert all(status[o] == sum(n for (_, k), n in want.items() if k == o) for o in {k for _, k in want})


def test_ledger_of_a_stream(spark, tmp_path):
    log, pairs = engine._feed(spark, DATA)
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    pairs = pairs.withColumns({c: F.lit(c) for c in ("a_event_title", "b_event_title", "a_question", "resolution_date")})
    run = streaming.to_ledger(streaming.stream(source, pairs, engine.FEED_LIMITS), pairs, str(tmp_path / "out"), str(tmp_path / "ck"))
    run.awaitTermination()
    got = spark.read.csv(str(tmp_path / "out"), header=True)
    assert len(got.columns) == 19 and got.count() == streaming.replay(log, pairs, engine.FEED_LIMITS).where("outcome = 'trade'").count() > 0


def test_other_time_zone(spark, duck):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        for name in ("as_of", "resolution_dates"):
            assert plain(engine.QUERIES[name](spark, DATA).toPandas()) == plain(duck.sql(engine.ORACLE_SQL[name]).df())
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
