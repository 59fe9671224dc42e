"""Market data derived from the generic tables by whole-number arithmetic, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-01-01 00:00:00"
YEAR = 2026
_UTC: dict[str, SparkSession] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Its times have no zone and mean UTC, so it is read in a session of that zone; the caller's own stays as it is."""
    return in_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def in_utc(spark: SparkSession) -> SparkSession:
    """``spark`` if its zone is UTC, else a copy of it whose zone is."""
    if spark.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC"):
        return spark
    key = spark.sparkContext.applicationId
    if key not in _UTC:
        _UTC[key] = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
        _UTC[key].conf.set("spark.sql.session.timeZone", "UTC")
    return _UTC[key]


def level_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """market, side (a or b asks), tick in cents, size: one row a level."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    m, h = F.col("l_partkey") % 200, F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13
    is_a = F.col("l_linenumber") % 2 == 0
    tick = F.when(is_a, 30 + m % 40 + h % 10).otherwise(50 - m % 40 + (m * 7) % 24 + h % 10)
    return rows.select(m.alias("market"), F.when(is_a, "a").otherwise("b").alias("side"), tick.alias("tick"), F.col("l_quantity").cast("bigint").alias("qty")).groupBy("market", "side", "tick").agg(F.sum("qty").alias("size"))


LEVELS = """levels AS (
  SELECT l_partkey % 200 AS market, CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END AS side,
    CASE WHEN l_linenumber % 2 = 0 THEN 30 + (l_partkey % 200) % 40 + (l_orderkey * 7 + l_linenumber * 13) % 10
      ELSE 50 - (l_partkey % 200) % 40 + ((l_partkey % 200) * 7) % 24 + (l_orderkey * 7 + l_linenumber * 13) % 10 END AS tick,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS size
  FROM lineitem GROUP BY 1, 2, 3)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, t = read(spark, sf_dir, "events"), F.col("event_type")
    kind = F.when(t == "signup", "snapshot").when(t.isin("click", "view"), "absolute").otherwise("delta")
    return e.select(
        F.col("user_id").alias("book"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("recv_ts"), kind.alias("kind"),
        F.when(F.col("event_id") % 2 == 0, "bid").otherwise("ask").alias("side"), (1 + F.col("event_id") % 5).alias("tick"),
        (F.round(F.col("value") * 100).cast("bigint") - 5000).alias("qty"),
    )


MESSAGES = """messages AS (
  SELECT user_id AS book, event_id AS seq, ts AS recv_ts,
    CASE WHEN event_type = 'signup' THEN 'snapshot' WHEN event_type IN ('click', 'view') THEN 'absolute' ELSE 'delta' END AS kind,
    CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, 1 + event_id % 5 AS tick,
    CAST(round(value * 100) AS BIGINT) - 5000 AS qty FROM events)"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event, side, idx, title, ticker: the two venues' market titles of an event."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    title = F.concat(F.lit("Will "), "p_name", F.lit(" "), "p_type", F.lit(" size "), F.col("p_size").cast("string"), F.lit(" win in "), (2025 + k % 4).cast("string"), F.lit("?"))
    event = F.concat("p_brand", F.lit("-"), F.floor(k / 500).cast("string"))
    return p.select(event.alias("event"), F.when(k % 2 == 0, "a").otherwise("b").alias("side"), k.alias("idx"), title.alias("title"), F.concat(F.lit("KX-"), (24 + k % 6).cast("string"), F.lit("-P"), k.cast("string")).alias("ticker"))


TITLES = """titles AS (
  SELECT p_brand || '-' || CAST(p_partkey // 500 AS VARCHAR) AS event, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS side, p_partkey AS idx,
    'Will ' || p_name || ' ' || p_type || ' size ' || CAST(p_size AS VARCHAR) || ' win in ' || CAST(2025 + p_partkey % 4 AS VARCHAR) || '?' AS title,
    'KX-' || CAST(24 + p_partkey % 6 AS VARCHAR) || '-P' || CAST(p_partkey AS VARCHAR) AS ticker FROM part)"""


def brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k, s = read(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size").cast("string")
    between = F.concat(F.lit("Between "), s, F.lit(" and "), (F.col("p_size") + 5).cast("string"), F.lit(" units?"))
    title = F.when(k % 3 == 0, between).when(k % 3 == 1, F.concat(F.lit("Less than "), s, F.lit("?"))).otherwise(F.concat(F.lit("At least "), s, F.lit("?")))
    title = F.when(k % 7 == 6, F.concat(F.lit("Will it be "), "p_name")).otherwise(title)
    return p.select(F.concat("p_brand", F.lit("-"), F.floor(k / 500).cast("string")).alias("event"), F.when(F.floor(k / 3) % 2 == 0, "a").otherwise("b").alias("side"), k.alias("idx"), title.alias("title"))


BRACKETS = """brackets AS (
  SELECT p_brand || '-' || CAST(p_partkey // 500 AS VARCHAR) AS event, CASE WHEN (p_partkey // 3) % 2 = 0 THEN 'a' ELSE 'b' END AS side, p_partkey AS idx, p_size,
    CASE WHEN p_partkey % 7 = 6 THEN 'Will it be ' || p_name
      WHEN p_partkey % 3 = 0 THEN 'Between ' || CAST(p_size AS VARCHAR) || ' and ' || CAST(p_size + 5 AS VARCHAR) || ' units?'
      WHEN p_partkey % 3 = 1 THEN 'Less than ' || CAST(p_size AS VARCHAR) || '?' ELSE 'At least ' || CAST(p_size AS VARCHAR) || '?' END AS title
  FROM part)"""


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order pairs with end dates as text in several formats, some missing."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    d = F.col("o_orderdate")
    text = F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 4 == 1, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).when(k % 4 == 2, F.date_format(d, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))
    late = F.date_format(d + F.expr("INTERVAL 30 DAYS"), "yyyy-MM-dd")
    return o.select(k.alias("idx"), F.when(k % 11 == 0, "nan").otherwise(text).alias("a_end_date"), F.when(k % 3 == 0, late).when(k % 3 == 1, "").alias("b_expiration_time"), (k % 1000 / 1000.0).alias("score"), F.col("o_orderpriority").alias("category"))


DATED = """dated AS (
  SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS a_date,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 30 DAY END AS b_date, (o_orderkey % 1000) / 1000.0::DOUBLE AS score, o_orderpriority AS category
  FROM orders), resolved AS (
  SELECT idx, score, category, later AS resolution_date, CASE WHEN days > 365 THEN 365.0::DOUBLE ELSE round_even(days, 2) END AS days_to_resolution,
    coalesce(days > 365, false) AS date_capped
  FROM (SELECT *, greatest(a_date, b_date) AS later, (epoch_us(greatest(a_date, b_date)) - epoch_us(TIMESTAMP '1998-01-01')) / 86400000000.0::DOUBLE AS days FROM dated))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of five strategies with many repeats of (ticker, entity)."""
    rows = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return rows.select(F.concat(F.lit("S"), (1 + k % 5).cast("string")).alias("strategy"), F.concat(F.lit("KX-"), F.col("o_custkey").cast("string")).alias("b_ticker"), F.when(k % 4 != 0, F.col("o_orderpriority")).alias("a_entity"), ((500 + (k * 37) % 501) / 1000.0).alias("score"), k.alias("idx"))


SCORED = """scored AS (
  SELECT 'S' || CAST(1 + o_orderkey % 5 AS VARCHAR) AS strategy, 'KX-' || CAST(o_custkey AS VARCHAR) AS b_ticker,
    CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS a_entity, (500 + (o_orderkey * 37) % 501) / 1000.0::DOUBLE AS score, o_orderkey AS idx FROM orders)"""
