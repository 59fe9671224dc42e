import pytest
from pyspark.sql import functions as F

from gridloom.functions import dates, numeric, pricing, text
from gridloom.functions.values import STRATEGIES


def value(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(("price", "contracts", "fee"), [(0.5, 100.0, 1.76), (0.0, 100.0, 0.0), (1.0, 100.0, 0.0), (0.5, 0.0, 0.0)])
def test_fee(spark, price, contracts, fee):
    assert value(spark, pricing.total_fee(lit(price), lit(contracts))) == fee


def test_fee_rate_without_contracts(spark):
    assert value(spark, pricing.fee_rate(lit(0.5))) == 0.035


@pytest.mark.parametrize(("a", "b", "cost"), [(0.45, 0.50, 0.9676), (0.60, 0.35, 0.96596), (0.45, 0.30, 0.76476)])
def test_cost(spark, a, b, cost):
    got = value(spark, pricing.round_trip_cost(lit(a), lit(b), 50.0))
    assert got == pytest.approx(cost, abs=1e-9)


@pytest.mark.parametrize(
    ("profit", "days", "capped", "reason", "required"),
    [(0.0324, 365.0, False, "below_risk_free", 0.04), (0.0324, 100.0, False, "pass", 0.010959), (0.11, 365.0, True, "below_risk_free", 0.12), (0.1, None, False, "no_resolution_date", 0.0), (0.1, 0.5, False, "resolves_too_soon", 0.0)],
)
def test_time_value(spark, profit, days, capped, reason, required):
    got = value(spark, pricing.time_value(lit(profit), lit(days).cast("double"), lit(capped)))
    assert (got.reason, round(got.required, 6), got.ok) == (reason, required, reason == "pass")


@pytest.mark.parametrize(("raw", "normal"), [("  José-Ñ  5.5% ", "josé ñ 5 5"), ("", ""), ("½ a_b!", "½ a_b"), ("A\n\tB", "a b")])
def test_normalize(spark, raw, normal):
    assert value(spark, text.normalize(lit(raw))) == normal


@pytest.mark.parametrize(
    ("strategy", "a", "b", "score"),
    [("S1", "ann lee", "ann lee jr", 1.0), ("S1", "ann lee", "ann ray", 0.5), ("S1", "boston", "boston celtics", 0.0), ("S1", "season 10", "season 2", 0.0), ("S4", "a1 b1", "a1 b1 c d e f", 0.0), ("S2", "a1 b1", "a1 b1 c d e f", 1.0), ("S1", "boston", "boston", 1.0), ("S5", "more 5 x", "more 5 y", 0.0)],
)
def test_similarity(spark, strategy, a, b, score):
    assert value(spark, text.similarity(lit(a), lit(b), STRATEGIES[strategy])) == score


@pytest.mark.parametrize(
    ("strategy", "question", "expected"),
    [
        ("S4", "between 1.5% and 2.0%", (1.5, 2.0)), ("S4", "less than 5", (None, 5.0)), ("S4", "at least 3", (3.0, None)), ("S5", "between 1,000 and 2,000", (1000.0, 2000.0)),
        ("S4", "less than 5.5.", None), ("S4", "no number", None), ("S4", "5 or higher", (5.0, None)), ("S5", "10-20 points", (10.0, 20.0)),
    ],
)
def test_bounds(spark, strategy, question, expected):
    got = value(spark, numeric.bounds(lit(question), strategy))
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize(("question", "is_numeric"), [("more than 5", False), ("less than 5", True), ("above 1.5%", True), ("5 or more", True), ("who wins", False), (None, False)])
def test_is_numeric(spark, question, is_numeric):
    assert value(spark, numeric.is_numeric(lit(question).cast("string"), "S4")) is is_numeric


@pytest.mark.parametrize(("question", "ticker", "conflict"), [("win in 2026?", "X-28", True), ("win in 2027?", "X-28", False), ("win?", "X-28", False), ("win in 2026?", "X", False), (None, "X-28", False)])
def test_ticker_year(spark, question, ticker, conflict):
    assert value(spark, text.ticker_year_conflict(lit(question).cast("string"), lit(ticker), 2026)) is conflict


@pytest.mark.parametrize(("said", "year"), [("before 2027", 2026), ("by Dec 31, 2026", 2026), ("in 2026", 2026), ("2028 or 2029", 2028), ("ever", None)])
def test_effective_year(spark, said, year):
    assert value(spark, text.effective_year(lit(said))) == year


def test_guards(spark):
    assert value(spark, text.polarity_inversion(lit("relocated away from X"), lit("played in X")))
    assert not value(spark, text.polarity_inversion(lit("played in X"), lit("held in X")))
    assert value(spark, text.opposing_direction(lit("<70 seats"), lit("above 70 seats"), lit("70 seats"), lit("")))
    assert not value(spark, text.opposing_direction(lit("<70 seats"), lit("above 70 seats"), lit(""), lit("")))
    assert value(spark, text.title_sport(lit("college basketball champion"))) == "NBA"
    assert not value(spark, text.sports_differ(lit("no sport"), lit("KXWC-26")))
    assert value(spark, text.sports_differ(lit("NBA finals"), lit("KXWC-26")))
    assert value(spark, text.is_placeholder(lit("player 7"), "S1")) and not value(spark, text.is_placeholder(lit("another player"), "S3"))


@pytest.mark.parametrize("form", ["2026-11-03T00:00:00Z", "2026-11-03T00:00:00.000000Z", "2026-11-03T02:00:00+02:00", "2026-11-03", " 2026-11-03T00:00:00 "])
def test_dates(spark, form):
    assert value(spark, F.unix_seconds(dates.parse_date(lit(form)))) == 1793664000


def test_resolution(spark):
    def got(a, b, as_of):
        return value(spark, dates.resolution(lit(a).cast("string"), lit(b).cast("string"), lit(as_of).cast("timestamp")))

    assert got("2026-11-03", None, "2026-11-01").days_to_resolution == 2.0
    far = got("2026-11-03", "nan", "2025-09-29")
    assert (far.days_to_resolution, far.date_capped, str(far.resolution_date)) == (365.0, True, "2026-11-03 00:00:00")
    assert got(None, "", "2026-11-01").resolution_date is None and got(None, "", "2026-11-01").date_capped is False
    assert got("2026-10-01", None, "2026-11-01").days_to_resolution == -31.0


def test_bounds_text(spark):
    b = F.struct(F.lit(None).cast("double").alias("lo"), F.lit(1e7).alias("hi"))
    assert value(spark, numeric.bounds_text(b)) == "(None, 10000000.0)"
    assert value(spark, F.bround(lit(0.5625), 3)) == 0.562
