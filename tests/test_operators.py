import itertools
import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions.values import STRATEGIES
from gridloom.operators import align, books, merge, signals
from gridloom.sources import feeds, files, markets
from gridloom.sources import schemas as S
from gridloom.streaming import engine as streaming


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_greedy_is_the_sorted_scan(spark):
    pairs = spark.createDataFrame([("e", 0, 0, 1.0), ("e", 0, 1, 0.9), ("e", 1, 0, 0.8), ("e", 1, 1, 0.5)], "event string, a_idx bigint, b_idx bigint, score double")
    assert rows(align.assign(pairs).select("a_idx", "b_idx")) == [(0, 0), (1, 1)]
    rng = random.Random(3)
    many = [(f"e{e}", a, b, rng.choice([0.5, 0.75, 1.0])) for e in range(6) for a in range(7) for b in range(7) if rng.random() < 0.6]
    df = spark.createDataFrame(many, pairs.schema)
    want = []
    for e in {m[0] for m in many}:
        used_a, used_b = set(), set()
        for _, a, b, s in sorted((x for x in many if x[0] == e), key=lambda x: (-x[3], x[1], x[2])):
            if a not in used_a and b not in used_b:
                used_a.add(a)
                used_b.add(b)
                want.append((e, a, b, s))
    assert rows(align.assign(df)) == sorted(want) == rows(align.assign_rounds(df))


def test_entities(spark):
    titles = spark.createDataFrame([("e", "a", 0, "Will Ann Lee win in 2026?"), ("e", "a", 1, "Will Bob Ray win in 2026?"), ("f", "a", 0, "Will 70 seats be won?"), ("g", "a", 0, "Same"), ("g", "a", 1, "same!")], "event string, side string, idx int, title string")
    got = {(r.event, r.idx): r.entity for r in align.with_entities(titles, STRATEGIES["S1"]).collect()}
    assert got == {("e", 0): "ann lee", ("e", 1): "bob ray", ("f", 0): "", ("g", 0): "", ("g", 1): ""}


def test_b_fallbacks(spark):
    b = spark.createDataFrame([("e", 0, "Same", "Ann X", "K-1-AA"), ("e", 1, "same", "Bob X", "K-1-BB"), ("f", 0, "Same", "", "K-1-CC"), ("f", 1, "Same", None, "K-DD")], "event string, idx int, title string, sub_title string, ticker string")
    got = {(r.event, r.idx): r.entity for r in align.b_entities(b, STRATEGIES["S1"]).collect()}
    assert got == {("e", 0): "ann", ("e", 1): "bob", ("f", 0): "cc", ("f", 1): ""}


def test_same_bounds_may_share_a_partner(spark):
    a = spark.createDataFrame([("e", 0, "less than 5"), ("e", 1, "Less than 5?"), ("e", 2, "none")], "event string, idx int, title string")
    b = spark.createDataFrame([("e", 0, "below 5"), ("e", 1, "under 5")], a.schema)
    assert rows(align.same_bounds(a, b, "S4")) == [("e", 0, 0, 1.0, "(None, 5.0)", "(None, 5.0)"), ("e", 1, 0, 1.0, "(None, 5.0)", "(None, 5.0)")]


def test_vwap(spark):
    levels = spark.createDataFrame([("x", 0.4, 50.0), ("x", 0.5, 100.0), ("x", 0.6, 10.0), ("y", 0.2, 10.0), ("z", 1.0, 9.0)], "book string, price double, size double")
    got = {r.book: (round(r.vwap, 9), round(r.cost, 9), r.levels) for r in books.vwap(levels, "book", target=50).collect()}
    assert got == {"x": (round(50 / 110, 9), 50.0, 2), "y": (0.2, 2.0, 1)}


def test_complement(spark):
    bids = spark.createDataFrame([("k", 0.37, 5.0), ("k", 0.0, 1.0), ("k", 0.50001, 1.0), ("k", 0.50004, 2.0)], "book string, price double, size double")
    assert rows(books.complement(bids, "book")) == [("k", 0.5, 2.0), ("k", 0.63, 5.0)]


def test_clamped_deltas(spark):
    log = spark.createDataFrame([("b", i, "delta", "bid", 1, q) for i, q in enumerate([5, -3, -4, 2, 1, -10, 4])], "book string, seq int, kind string, side string, tick int, qty bigint")
    assert [r.size for r in books.delta_sizes(log).orderBy("seq").collect()] == [5, 2, 0, 2, 3, 0, 4]


@pytest.mark.parametrize(("best", "expected"), [([0.4, 0.4, 0.3], True), ([0.6, 0.6], False), ([0.3, 0.3, 0.3], False)])
def test_oversum(spark, best, expected):
    df = spark.createDataFrame([("e", str(i), p) for i, p in enumerate(best)], "event string, book string, price double")
    assert books.oversum(df.select("book", "price"), df.select("event", "book"), 1.05, 3).head().is_oversum is expected


def test_cooldown(spark):
    s = spark.createDataFrame([(1, t) for t in (0, 10, 61, 70, 130)], "pair int, at bigint")
    assert rows(signals.cooled(s, 60)) == [(1, 0), (1, 61), (1, 130)]


def test_dedup_and_verdicts(spark):
    pairs = spark.createDataFrame([("k", None, 1.0, "b"), ("k", "", 1.0, "a"), ("k", "x", 0.6, "a"), ("j", "y", 0.6, "a")], "b_ticker string, a_entity string, score double, a_yes_token string").withColumn("pair_key", F.concat_ws("|", "b_ticker", F.coalesce("a_entity", F.lit(""))))
    once = merge.dedup_pairs(pairs, ["a_yes_token"])
    assert rows(once.select("b_ticker", "score", "a_yes_token")) == [("j", 0.6, "a"), ("k", 0.6, "a"), ("k", 1.0, "a")]
    said = spark.createDataFrame([("k|x", "MATCH", "UNKNOWN?", "q"), ("j|y", "MATCH", "q", "q")], "pair_key string, verdict string, a_identified string, b_identified string")
    assert rows(merge.verified(once, said).select("b_ticker", "score")) == [("j", 0.6), ("k", 1.0)]


def test_landed_json_and_lookup(spark):
    body = '{"markets": [{"question": "Q1", "clobTokenIds": "[\\"1\\", \\"2\\"]", "endDate": "2026-01-01"}, {"question": "Q2", "clobTokenIds": "oops"}, {"question": "x Lower Strikes", "clobTokenIds": "[\\"1\\", \\"2\\"]"}, {"closed": true, "question": "Q3", "clobTokenIds": "[\\"1\\", \\"2\\"]"}]}'
    landed = spark.createDataFrame([("a", body), ("bad", "{")], "event_id string, body string")
    got = markets.a_markets(landed, "S1").collect()
    assert [(r.question, r.yes_token, r.no_token, r.outcomes, r.end_date) for r in got] == [("Q1", "1", "2", ["Yes", "No"], "2026-01-01")]
    assert markets.a_markets(landed, "S4").head().end_date == ""
    b = spark.createDataFrame([("K", '{"event": {"markets": [{"ticker": "K-1", "status": "open"}, {"ticker": "K-2", "status": "closed"}]}}')], landed.schema)
    assert [r.ticker for r in markets.b_markets(b).collect()] == ["K-1"]
    matches = spark.createDataFrame([("a", "K"), ("zz", "K"), ("a", "L")], "a_event_id string, b_event_ticker string")
    ok, errors = markets.lookup(matches, landed, b)
    assert rows(ok) == [("a", "K")] and sorted(r.stage for r in errors.collect()) == ["a_fetch", "b_fetch"]


def test_feed_messages(spark):
    raw = spark.createDataFrame(
        [
            (1, "a", '[{"event_type": "book", "asset_id": "t", "bids": [{"price": "0.4", "size": "5"}], "asks": []}]'),
            (2, "a", '{"event_type": "price_change", "price_changes": [{"asset_id": "t", "price": ".41", "size": "0", "side": "SELL"}]}'),
            (3, "b", '{"type": "orderbook_delta", "msg": {"market_ticker": "K", "price_dollars": "0.3", "delta_fp": "-2.00", "side": "yes"}}'),
            (4, "b", "not json"), (5, "a", None), (6, "b", '{"type": "orderbook_delta", "msg": {"market_ticker": "K", "side": "odd"}}'),
        ], "seq bigint, venue string, body string",
    ).withColumn("recv_ts", F.lit("2026-01-01").cast("timestamp"))
    got = [(r.seq, *tuple(r)[4:]) for r in feeds.decode(raw).orderBy("seq", "item", "pos").collect()]
    assert got == [(1, "snapshot", "t", "bid", None, None), (1, "snapshot", "t", "bid", 4000, 500), (2, "absolute", "t", "ask", 4100, 0), (3, "delta", "K/yes", "bid", 3000, -200), (6, "delta", "K/yes", "bid", None, None)]


def test_files(spark, tmp_path):
    one = str(tmp_path / "s1")
    files.write_csv(spark.createDataFrame([("y", "n", 'q "x", z', "k", "t", "direct_binary", 1.0, "", "", "", "", "e", "E", "k", "K", "c")], S.PAIRS), one, single=True)
    got = files.read_strategies(spark, {"S1": one, "S2": str(tmp_path / "none")}).collect()
    assert [(r.a_question, r.score, r.strategy) for r in got] == [('q "x", z', 1.0, "S1")]
    with pytest.raises(ValueError, match="no strategy"):
        files.read_strategies(spark, {"S2": str(tmp_path / "none")})
    with pytest.raises(ValueError, match="lacks"):
        files.read_manifest(spark, one)


def test_day_bands_and_scores(spark):
    df = spark.createDataFrame([(3.0, False), (10.0, False), (365.0, True), (None, False)], "days_to_resolution double, date_capped boolean")
    got = merge.day_bands(df).head()
    assert (got.below_7, got.below_30, got.missing, got.capped, got.median_days) == (1, 1, 1, 1, 6.5)
    s = spark.createDataFrame([(1.0,), (0.8,), (0.5,)], "score double")
    assert tuple(merge.score_bands(s).head()) == (1, 1, 1)


def test_books_of_messages(spark):
    """An empty book clears, the last value of a level counts, a snapshot's size of 0 says nothing, items follow each other."""
    bodies = [
        '{"event_type": "book", "asset_id": "t", "bids": [{"price": "0.4", "size": "5"}, {"price": "0.4", "size": "7"}, {"price": "0.4", "size": "0"}], "asks": [{"price": "0.6", "size": "1"}]}',
        '[{"event_type": "price_change", "price_changes": [{"asset_id": "t", "price": "0.6", "size": "10", "side": "sell"}, {"asset_id": "t", "price": "0.6", "size": "0", "side": "SELL"}]}, {"event_type": "price_change", "changes": [{"asset_id": "t", "price": "0.3", "size": "2", "side": "buy"}]}]',
        '{"event_type": "book", "asset_id": "u", "bids": [{"price": "0.4", "size": "5"}]}',
        '{"event_type": "book", "asset_id": "u"}',
    ]
    import datetime

    raw = spark.createDataFrame([(i, datetime.datetime(2026, 1, 1), "a", b) for i, b in enumerate(bodies)], "seq bigint, recv_ts timestamp, venue string, body string")
    log = feeds.decode(raw)
    assert rows(books.absolute_state(log)) == [("t", "bid", 3000, 200), ("t", "bid", 4000, 700)]
    state = streaming.Event()
    for _, message in itertools.groupby(log.withColumn("recv_ms", F.unix_millis("recv_ts")).orderBy("seq", "item", "pos").collect(), key=lambda r: (r.seq, r.item)):
        state.apply(list(message))
    assert {k: v for k, v in state.levels.items() if v} == {("t", "bid"): {3000: 200, 4000: 700}} and set(state.seen) == {"t", "u"}
    assert state.age("never", 0) is None
    one_sided = spark.createDataFrame([(0, datetime.datetime(2026, 1, 1), "b", '{"type": "orderbook_snapshot", "msg": {"market_ticker": "K", "yes_dollars_fp": [["0.3", "1"]], "no_dollars_fp": [["0.5", "1"]]}}'), (1, datetime.datetime(2026, 1, 1), "b", '{"type": "orderbook_snapshot", "msg": {"market_ticker": "K", "no_dollars_fp": [["0.6", "2"]]}}')], raw.schema)
    both = feeds.decode(one_sided)
    assert rows(books.absolute_state(both)) == rows(books.delta_state(both)) == [("K/no", "bid", 6000, 200)]


def test_cooldown_streams(spark):
    at = [(p, t) for p in "ab" for t in (5, 1, 9, 12, 30, 31, 1)]
    assert rows(signals.cooled(spark.createDataFrame(at, "pair string, at bigint"), 8)) == [(p, t) for p in "ab" for t in (1, 9, 30)]


def test_union_fills_columns(spark):
    a, b = spark.createDataFrame([("x", 1.0, "e", 1)], "b_ticker string, score double, a_entity string, idx int"), spark.createDataFrame([("x", None, "e"), ("y", 0.5, None)], "b_ticker string, score double, a_entity string")
    got = rows(merge.dedup_pairs(merge.union_all([a, b]), ["idx"]).select("b_ticker", "score", "a_entity", "idx"))
    assert got == [("x", 1.0, "e", 1), ("y", 0.5, None, None)]


def test_verification(spark):
    pairs = spark.createDataFrame([("k", "q" * 300, "t", "A", "B", 0.6, "E", None)], "pair_key string, a_question string, b_title string, a_entity string, b_entity string, score double, a_event_title string, b_event_title string")
    asked = merge.verification_request(pairs).select(F.from_json("request", "a_question string, b_event_title string").alias("x")).head().x
    assert len(asked.a_question) == 200 and asked.b_event_title == ""
    log = merge.verdict_log(pairs, spark.createDataFrame([("k", '{"verdict": "MATCH", "reason": "r", "a_identified": "x", "b_identified": "x"}')], "pair_key string, reply string"))
    assert len(log.columns) == 9 and (log.head().verdict, len(log.head().a_question)) == ("MATCH", 100) and tuple(merge.verdict_counts(log).head()) == (1, 0, 0)


def test_report_sample(spark):
    df = spark.range(50).select(F.concat(F.lit("k"), "id").alias("key"))
    first = [r.key for r in merge.sample(df, "key", 7).collect()]
    assert len(first) == 7 and first == [r.key for r in merge.sample(df.repartition(5), "key", 7).collect()]


def plain_similarity(s):
    from gridloom.functions import text as X

    return lambda df: df.withColumn("score", X.similarity(F.col("a_entity"), F.col("b_entity"), s)).where("score >= 0.5")


@pytest.mark.parametrize("name", list(STRATEGIES))
def test_index_and_all_pairs_agree(spark, name):
    """The inverted index gives what scoring all pairs gives: ties, repeated entities, single tokens, digits, words out of order."""
    rng, s = random.Random(name), STRATEGIES[name]
    words = "ann bob lee ray under over 5 70 2031 north south player x1 bay".split()
    sides = [spark.createDataFrame([(f"e{rng.randrange(3)}", i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 2, 3, 4, 5, 7])))) for i in range(150)], "event string, idx bigint, entity string") for _ in "ab"]
    direct, indexed = (rows(align.candidates(*sides, s, all_pairs=n)) for n in (10**9, 0))
    assert direct == indexed and len(direct) > 100
    a, b = (x.where("entity <> ''").toDF("event", f"{k}_idx", f"{k}_entity") for k, x in zip("ab", sides, strict=True))
    if not s.anonymous:
        assert direct == rows(plain_similarity(s)(a.join(b, "event")).select("event", "a_idx", "b_idx", "a_entity", "b_entity", "score"))


def test_a_large_event_meets_by_its_rare_tokens(spark):
    """20,000 titles a side in one event: 400 million pairs, of which some tens of thousands are looked at."""
    n = 20_000
    ids = spark.range(n).withColumn("event", F.lit("e"))
    name = F.concat_ws(" ", F.concat(F.lit("p"), F.col("id")), F.concat(F.lit("q"), F.col("id") % 9001), F.element_at(F.array(*map(F.lit, ["red", "blue", "green"])), (F.col("id") % 3 + 1).cast("int")))
    a = ids.select("event", F.col("id").alias("idx"), name.alias("entity"))
    b = ids.select("event", F.col("id").alias("idx"), F.concat_ws(" ", name, F.lit("party")).alias("entity"))
    both = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b"))).withColumn("set", F.split("entity", " "))
    assert align.overlapping(*align.ranked_sets(both), 0.5).count() < 5 * n
    found = align.candidates(a, b, STRATEGIES["S2"])
    assert found.where("a_idx = b_idx and score = 1").count() == n
    assert align.assign_skewed(found, at_most=1000).where("a_idx = b_idx").count() == n


@pytest.mark.parametrize("ties", [False, True])
def test_assignment_of_a_large_event(spark, ties):
    """One event holds nearly all pairs. With ties only, rounds would take one pair each, so the stream takes over."""
    rng = random.Random(5)
    many = [("large", a, b, 1.0 if ties else rng.choice([0.5, 0.6, 0.75, 0.9, 1.0])) for a in range(60) for b in range(60)] + [(f"s{e}", a, b, 1.0) for e in range(5) for a in range(3) for b in range(2)]
    df = spark.createDataFrame(many, "event string, a_idx bigint, b_idx bigint, score double").repartition(3)
    want = rows(align.assign(df))
    assert rows(align.assign_skewed(df, at_most=100)) == want == rows(align.assign_skewed(df)) and len(want) == 60 + 5 * 2


def test_shared_folders(spark):
    from gridloom.sources import tables

    assert tables.demand_shared("file:/w", "file", "local[8]") == "file:/w" and tables.demand_shared("hdfs://w", "hdfs", "yarn") == "hdfs://w"
    for master in ("yarn", "spark://m:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            tables.demand_shared("file:/w", "file", master)


def test_one_hot_pair_cools_by_doubling(spark):
    """One pair has nearly all signals, in bursts, with gaps and repeats; doubling gives what the scan in order gives."""
    rng = random.Random(8)
    at = [("hot", base + rng.randrange(40)) for base in (0, 15, 400, 1000, 1001, 5000) for _ in range(300)] + [("hot", 10_000 + 7 * i) for i in range(300)] + [("cold", rng.randrange(2000)) for _ in range(20)] + [("one", 3), (None, 4), ("cold", None)]
    df = spark.createDataFrame(at, "pair string, at bigint").repartition(3)
    for ms in (1, 8, 40, 300):
        want = rows(signals.cooled_in_order(df.where("pair is not null and at is not null"), ms))
        assert rows(signals.cooled_by_doubling(df.where("pair is not null and at is not null"), ms)) == want == rows(signals.cooled(df, ms)) == rows(signals.cooled(df, ms, hot=100))


def hot_log(rng, n, kinds):
    """A log of two books of which one has nearly all messages: snapshots of several rows, absolute messages, deltas."""
    log = []
    for seq in range(n):
        book = "hot" if rng.random() < 0.95 else rng.choice("ab")
        kind = rng.choice(kinds) if rng.random() < 0.97 else "snapshot"
        rows_ = [(None, None), *((rng.randrange(1, 9), rng.choice([0, 3, 5])) for _ in range(rng.randrange(5)))] if kind == "snapshot" else [(rng.randrange(1, 9), rng.randrange(-6, 9)) for _ in range(rng.choice([1, 1, 2]))]
        log += [(book, seq, 0, pos, kind, rng.choice(["bid", "ask"]), tick, qty) for pos, (tick, qty) in enumerate(rows_)]
    return log


LOG = "book string, seq bigint, item int, pos int, kind string, side string, tick bigint, qty bigint"


@pytest.mark.parametrize("pieces", [1, 5, 16])
def test_pieces_of_a_hot_book(spark, pieces):
    """Sizes, books as of a time and best prices of a log cut into pieces are those of one pass over each book."""
    log = hot_log(random.Random(pieces), 900, ["delta"])
    df = spark.createDataFrame(log, LOG).repartition(3)
    columns = ["book", "seq", "pos", "side", "tick", "qty", "size"]
    want = rows(books.sizes_by_windows(df).select(*columns))
    assert rows(books.sizes_in_pieces(df, pieces).select(*columns)) == want == rows(books.delta_sizes(df).select(*columns))
    log = hot_log(random.Random(pieces), 900, ["delta", "absolute"])
    df = spark.createDataFrame(log, LOG).repartition(3)
    best, sides, changes, marks = {}, {}, [], []
    for (book, seq), message in itertools.groupby(sorted(log, key=lambda r: (r[0], r[1], r[3])), key=lambda r: r[:2]):
        live = sides.setdefault(book, {"bid": {}, "ask": {}})
        for i, (*_, kind, side, tick, qty) in enumerate(message):
            if kind == "snapshot" and i == 0:
                live["bid"].clear()
                live["ask"].clear()
            if tick is None or (kind == "snapshot" and qty <= 0):
                continue
            size = live[side].get(tick, 0) + qty if kind == "delta" else qty
            live[side].pop(tick, None)
            if size > 0:
                live[side][tick] = size
        now = max(live["bid"], default=None)
        if now != best.get(book):
            changes.append((book, seq, now))
            best[book] = now
        if seq % 7 == 0:
            marks.append((book, seq, now, len(live["bid"]), min(live["ask"], default=None), len(live["ask"])))
    at = spark.createDataFrame([m[:2] for m in marks], "book string, at bigint")
    assert sorted(map(tuple, books.as_of(df, at, pieces).collect()), key=str) == sorted(marks, key=str)
    found = books.best_changes(df, "bid", pieces).groupBy("book", "seq").agg(F.sum(F.coalesce("best", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("step")).where("step <> 0")
    last, steps = {}, set()
    for book, seq, now in changes:
        steps.add((book, seq, (now or 0) - last.get(book, 0)))
        last[book] = now or 0
    assert {tuple(r) for r in found.collect()} == steps


def test_running_sums_of_a_hot_key(spark):
    rng = random.Random(2)
    data = [("hot" if rng.random() < 0.9 else "b", rng.randrange(300), rng.randrange(-5, 6)) for _ in range(800)]
    got = books.running_sums(spark.createDataFrame(data, "k string, seq int, x bigint").repartition(4), "k", ("seq",), ("x",))
    assert rows(got) == sorted((k, seq, sum(x for j, s, x in data if j == k and s <= seq)) for k, seq, _ in data)
