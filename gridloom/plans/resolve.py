"""From event matches and landed markets to a manifest: five strategies over one persisted input, then merge and dates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import text as X
from gridloom.functions import values as V
from gridloom.operators import align, merge
from gridloom.sources import markets
from gridloom.sources.tables import materialize


@dataclass(frozen=True)
class Resolved:
    pairs: DataFrame
    errors: DataFrame


def events_of(matches: DataFrame, s: V.Strategy) -> DataFrame:
    """The event matches that a strategy takes."""
    rows = matches.where(F.col("category").isin(V.CATEGORIES[s.name]))
    if s.split:
        h2h = X.sure(F.contains(F.lower("a_event_title"), F.lit(" vs")))
        rows = rows.where(h2h if s.split == "h2h" else ~h2h)
    rows = merge.dedup_events(rows, s)
    return rows.where(~X.sports_differ(F.col("a_event_title"), F.col("b_event_ticker"))) if s.sport_guard else rows


def resolve(matches: DataFrame, a_landed: DataFrame, b_landed: DataFrame, strategy: str, current_year: int) -> Resolved:
    """Pairs of one strategy and the events that gave none.

    ``matches`` as in ``schemas.MATCHES``; ``a_landed`` and ``b_landed`` have (event_id, body). An event is a match of both ids,
    so one venue's event may take part in several. The markets and the pairs are written to the shared folder here, so building
    the result runs jobs.
    """
    s = V.STRATEGIES[strategy]
    found, errors = markets.lookup(events_of(matches, s), a_landed, b_landed)
    found = found.withColumn("event", F.concat_ws("|", "a_event_id", "b_event_ticker"))
    keys = found.select("event", "a_event_id", "b_event_ticker")
    a = markets.a_markets(a_landed, strategy).withColumnRenamed("event_id", "a_event_id").join(keys, "a_event_id").withColumn("title", F.col("question"))
    b = markets.b_markets(b_landed).withColumnRenamed("event_id", "b_event_ticker").join(keys, "b_event_ticker").withColumn("sub_title", F.col("yes_sub_title"))
    a, b = materialize(a), materialize(b)  # each is read several times below
    counts = a.groupBy("event").agg(F.count("*").alias("n_a")).join(b.groupBy("event").agg(F.count("*").alias("n_b")), "event")
    single = counts.where("n_a = 1 and n_b = 1").select("event")
    many = counts.where("n_a > 1 or n_b > 1").select("event")
    aligned = []
    if s.numeric:
        sides = [align.numeric_sides(x.select("event", F.lit(k).alias("side"), "title"), strategy).where("is_numeric").select("event") for k, x in (("a", a), ("b", b))]
        numeric = sides[0].join(sides[1], "event").distinct()
        by_bounds = align.same_bounds(a.join(numeric, "event", "left_semi"), b.join(numeric, "event", "left_semi"), strategy)
        aligned.append(by_bounds.withColumn("alignment_type", F.lit("exact_boundary")))
        single, many = (x.join(numeric, "event", "left_anti") for x in (single, many))
    one = [x.join(single, "event", "left_semi") for x in (a, b)]
    aligned.append(align.direct(*one, s).withColumn("alignment_type", F.lit("direct_binary")))
    left, right = (x.join(many, "event", "left_semi") for x in (a, b))
    left = align.with_entities(left.withColumn("side", F.lit("a")), s)
    right = align.b_entities(right, s)
    most = align.most_pairs(a, b)
    chosen = align.assign_skewed(align.candidates(left, right, s, most=most), most)
    aligned.append(chosen.select("event", "a_idx", "b_idx", F.bround("score", 3).alias("score"), "a_entity", "b_entity").withColumn("alignment_type", F.lit("entity_match")))
    pairs = merge.union_all(aligned)
    pairs = pairs.join(a.select("event", F.col("idx").alias("a_idx"), F.col("yes_token").alias("a_yes_token"), F.col("no_token").alias("a_no_token"), F.col("question").alias("a_question"), F.col("end_date").alias("a_end_date")), ["event", "a_idx"])
    pairs = pairs.join(b.select("event", F.col("idx").alias("b_idx"), F.col("ticker").alias("b_ticker"), F.col("title").alias("b_title"), F.col("expiration_time").alias("b_expiration_time")), ["event", "b_idx"])
    if s.opposing_direction:
        against = X.opposing_direction(F.col("a_question"), F.col("b_title"), F.col("a_entity"), F.col("b_entity"))
        pairs = pairs.where(~((F.col("alignment_type") == "entity_match") & against))
    pairs = pairs.where(~X.ticker_year_conflict(F.col("a_question"), F.col("b_ticker"), current_year))
    pairs = pairs.join(found, "event")
    if s.category:
        pairs = pairs.withColumn("category", F.lit(s.category))
    pairs = materialize(pairs)
    none = found.join(pairs.select("event").distinct(), "event", "left_anti").select("a_event_id", "b_event_ticker", F.lit("alignment").alias("stage"), F.lit("no pairs").alias("error"))
    if s.pair_dedup:
        pairs = merge.dedup_pairs(pairs, ["a_yes_token"])
    return Resolved(pairs.withColumn("strategy", F.lit(strategy)), errors.unionByName(none))


def build_manifest(pairs: list[DataFrame], verdicts: DataFrame, as_of: Column) -> DataFrame:
    """The manifest of all strategies' pairs: deduplicated, verified, dated, in order."""
    merged = merge.dedup_pairs(merge.union_all(pairs), ["strategy", "a_yes_token"])
    keyed = merged.withColumn("pair_key", F.concat_ws("|", "b_ticker", F.coalesce("a_entity", F.lit(""))))
    return merge.manifest(merge.with_dates(merge.verified(keyed, verdicts), as_of))
