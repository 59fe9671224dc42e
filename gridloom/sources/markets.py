"""Landed JSON of both venues' events, as markets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import text as X
from gridloom.functions import values as V
from gridloom.sources import schemas as S


def a_markets(landed: DataFrame, strategy: str) -> DataFrame:
    """Markets of ``landed(event_id, body)`` that live, are of a contract type that the strategy aligns, and have two tokens."""
    flag = {c: F.coalesce(F.col(f"m.{c}"), F.lit(False)) for c in ("closed", "active")}
    rows = landed.select("event_id", F.posexplode(F.from_json("body", S.A_EVENT)["markets"]).alias("idx", "m"))
    question = F.coalesce("m.question", F.lit(""))
    tokens = F.coalesce(F.from_json("m.clobTokenIds", "array<string>"), F.array().cast("array<string>"))
    names = F.coalesce(F.from_json("m.outcomes", "array<string>"), F.array(F.lit("Yes"), F.lit("No")))
    end = F.coalesce("m.endDate", F.lit("")) if V.STRATEGIES[strategy].end_date else F.lit("")
    rows = rows.where(~(flag["closed"] & ~flag["active"])).where(~X.dropped_contract(question, strategy)).withColumn("tokens", tokens).where(F.size("tokens") >= 2)
    return rows.select("event_id", "idx", question.alias("question"), F.col("tokens")[0].alias("yes_token"), F.col("tokens")[1].alias("no_token"), names.alias("outcomes"), F.coalesce("m.conditionId", F.lit("")).alias("condition_id"), end.alias("end_date"))


def b_markets(landed: DataFrame) -> DataFrame:
    """Open markets of ``landed(event_id, body)``; the event may be wrapped in an ``event`` field."""
    body = F.coalesce(F.get_json_object("body", "$.event"), F.col("body"))
    rows = landed.select("event_id", F.posexplode(F.from_json(body, S.B_EVENT)["markets"]).alias("idx", "m"))
    text = ("ticker", "title", "yes_sub_title", "no_sub_title", "subtitle", "status", "expiration_time")
    return rows.where(F.col("m.status").isin(V.OPEN_STATUS)).select("event_id", "idx", *(F.coalesce(f"m.{c}", F.lit("")).alias(c) for c in text))


def lookup(matches: DataFrame, a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Event matches that both landings have, and an error row for each of the others. ``a`` and ``b`` have (event_id, body)."""
    x = a.select(F.col("event_id").alias("a_event_id"), F.lit(True).alias("has_a")).distinct()
    y = b.select(F.col("event_id").alias("b_event_ticker"), F.lit(True).alias("has_b")).distinct()
    both = matches.join(x, "a_event_id", "left").join(y, "b_event_ticker", "left")
    stage = F.when(F.col("has_a").isNull(), "a_fetch").when(F.col("has_b").isNull(), "b_fetch")
    errors = both.withColumn("stage", stage).where("stage is not null").select("a_event_id", "b_event_ticker", "stage", F.lit("not landed").alias("error"))
    return both.where("has_a and has_b").select(*matches.columns), errors
