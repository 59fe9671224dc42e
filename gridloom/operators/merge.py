"""Merging the strategies' pairs into a manifest, and the reports on the way."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.dates import resolution
from gridloom.functions.text import sure
from gridloom.functions.values import GDP_DROPS, GDP_TICKER, Strategy, Thresholds

T = Thresholds()
MANIFEST = [
    "a_yes_token", "a_no_token", "a_question", "b_ticker", "b_title", "score", "a_entity", "b_entity", "a_event_id", "a_event_title",
    "b_event_ticker", "b_event_title", "category", "a_end_date", "b_expiration_time", "resolution_date", "days_to_resolution", "date_capped",
]


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; a column that a frame lacks is null there. No frame is an error."""
    if not frames:
        raise ValueError("no strategy gave pairs")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_first(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The row of each group that is least by ``order``, nulls first. An aggregate, which combines before it shuffles."""
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    return rows.groupBy(*named).agg(F.min_by(F.struct("*"), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))).alias("__row")).select("__row.*")


def dedup_pairs(pairs: DataFrame, tie: list[str]) -> DataFrame:
    """The pair with the best score of each (ticker, entity); a missing entity counts as ''. Ties go by the ``tie`` columns."""
    return keep_first(pairs, [F.col("b_ticker"), F.coalesce("a_entity", F.lit(""))], [F.col("score").isNull(), -F.col("score"), *map(F.col, tie)])


def dedup_events(events: DataFrame, s: Strategy) -> DataFrame:
    """Event matches without side markets and foreign GDP titles, the first by ordinal of each ticker."""
    title = F.col("a_event_title")
    if s.more_markets:
        events = events.where(~sure(F.contains(title, F.lit("More Markets"))))
    if s.country_guard:
        events = events.where(~sure((F.col("b_event_ticker") == GDP_TICKER) & title.rlike(GDP_DROPS)))
    return keep_first(events, [F.col("b_event_ticker")], [F.col("ordinal")]) if s.event_dedup else events


def verified(pairs: DataFrame, verdicts: DataFrame, threshold: float = T.auto_accept) -> DataFrame:
    """Pairs from ``threshold`` up, and those below that ``verdicts(pair_key, verdict, a_identified, b_identified)`` call MATCH.

    No verdict, another one, or an identification that says UNKNOWN rejects.
    """
    says = [sure(F.contains(F.upper(c), F.lit("UNKNOWN"))) & sure(F.coalesce(other, F.lit("")) != "") for c, other in ((F.col("a_identified"), F.col("b_identified")), (F.col("b_identified"), F.col("a_identified")))]
    good = verdicts.where((F.col("verdict") == "MATCH") & ~(says[0] | says[1])).select("pair_key").distinct()
    high = pairs.where(F.col("score") >= threshold)
    return high.unionByName(pairs.where(F.col("score") < threshold).join(good, "pair_key", "left_semi"))


def verdict_of(reply: Column) -> Column:
    """struct(verdict, reason, a_identified, b_identified) of a verifier's reply: JSON, in a code fence or not; REJECT if malformed."""
    body = F.trim(F.regexp_replace(F.when(F.trim(reply).startswith("```"), F.try_element_at(F.split(F.trim(reply), "```"), F.lit(2))).otherwise(reply), "^json", ""))
    x = F.from_json(body, "verdict string, reason string, a_identified string, b_identified string")
    unsure = sure(F.contains(F.upper(x["a_identified"]), F.lit("UNKNOWN")) | F.contains(F.upper(x["b_identified"]), F.lit("UNKNOWN")))
    named = (F.coalesce(x["a_identified"], F.lit("")) != "") & (F.coalesce(x["b_identified"], F.lit("")) != "")
    verdict = F.when((x["verdict"] == "MATCH") & named & unsure, "REJECT").otherwise(F.coalesce(x["verdict"], F.lit("REJECT")))
    return F.struct(verdict.alias("verdict"), F.coalesce(x["reason"], F.lit("")).alias("reason"), F.coalesce(x["a_identified"], F.lit("")).alias("a_identified"), F.coalesce(x["b_identified"], F.lit("")).alias("b_identified"))


def verification_request(pairs: DataFrame) -> DataFrame:
    """(pair_key, request): what an external verifier is asked about each pair, as JSON; long texts stop at 200 characters."""
    fields = [F.substring(F.coalesce(c, F.lit("")), 1, 200).alias(c) for c in ("a_question", "b_title", "a_event_title", "b_event_title")]
    entities = [F.coalesce(c, F.lit("")).alias(c) for c in ("a_entity", "b_entity")]
    rules = F.lit("Do both contracts resolve on the same outcome? Identify each entity first, UNKNOWN if unsure. Answer in JSON with verdict MATCH or REJECT, reason, a_identified, b_identified; in doubt REJECT.")
    return pairs.select("pair_key", F.to_json(F.struct(rules.alias("task"), *fields, *entities)).alias("request"))


def verdict_log(pairs: DataFrame, replies: DataFrame, threshold: float = T.auto_accept) -> DataFrame:
    """The nine columns of the log: pairs below ``threshold`` with the verdict of ``replies(pair_key, reply)``; no reply rejects."""
    said = pairs.where(F.col("score") < threshold).join(replies, "pair_key", "left").withColumn("x", verdict_of(F.col("reply")))
    return said.select(*(F.substring(c, 1, 100).alias(c) for c in ("a_question", "b_title")), "a_entity", "b_entity", "x.a_identified", "x.b_identified", "score", "x.verdict", "x.reason")


def verdict_counts(log: DataFrame) -> DataFrame:
    """n_match, n_reject and n_error of a verdict log."""
    return log.agg(*(F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}") for v in ("MATCH", "REJECT", "ERROR")))


def with_dates(pairs: DataFrame, as_of: Column) -> DataFrame:
    x = resolution(F.col("a_end_date"), F.col("b_expiration_time"), as_of)
    return pairs.withColumn("__x", x).select("*", "__x.*").drop("__x")


def manifest(pairs: DataFrame) -> DataFrame:
    """The manifest's columns in its order; the order is total."""
    return pairs.select(*MANIFEST).orderBy("category", F.desc("score"), "b_ticker", "a_yes_token")


def tradable(rows: DataFrame, t: Thresholds = T) -> DataFrame:
    """Manifest rows without spreads, side markets, rows without a date and those that resolve within a day."""
    return rows.where(drop_reason(t).isNull())


def drop_reason(t: Thresholds = T) -> Column:
    """Why a manifest row is not traded, null if it is; the first reason counts."""
    q = F.col("a_question")
    return F.when(sure(q.startswith("Spread:")), "spread").when(sure(F.contains(q, F.lit("More Markets"))), "more_markets").when(F.col("days_to_resolution").isNull(), "no_date").when(F.col("days_to_resolution") < t.min_days, "too_soon")



def value_counts(rows: DataFrame, key: str) -> DataFrame:
    """(key, n): how many rows have each value, most first, ties by value."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)


def resolver_report(events: DataFrame, pairs: DataFrame, errors: DataFrame) -> DataFrame:
    """(section, item, value): what a resolver's run gave, of its ``events``, ``pairs(alignment_type, category, score, a_entity, b_entity)``
    and ``errors(stage)``: totals, errors by stage, pairs by alignment type and category, how many matched entities are equal, and
    the mean, least and median score to three places. One pass over the pairs counts, one measures."""

    def cell(section: str, item: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), item.alias("item"))

    def counted(rows: DataFrame, *cells: Column) -> DataFrame:
        each = rows.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("item is not null")
        return each.groupBy("section", "item").agg(F.count("*").cast("double").alias("value"))

    same = F.when(F.col("alignment_type") == "entity_match", F.when(F.col("a_entity") == F.col("b_entity"), "equal").otherwise("different"))
    scores = pairs.agg(F.bround(F.avg("score"), 3).alias("mean"), F.min("score").alias("least"), F.median("score").alias("median"))
    scores = scores.select(F.explode(F.array(*(F.struct(F.lit(c).alias("item"), F.col(c).alias("value")) for c in scores.columns))).alias("x")).select(F.lit("score").alias("section"), "x.*").where("value is not null")
    tables = [counted(events, cell("total", F.lit("events"))), counted(errors, cell("total", F.lit("errors")), cell("error", F.col("stage"))), counted(pairs, cell("total", F.lit("pairs")), cell("alignment", F.col("alignment_type")), cell("category", F.col("category")), cell("entities", same))]
    return union_all([*tables, scores])


def inspections(pairs: DataFrame, length: int = 65) -> DataFrame:
    """(score, a_entity, b_entity, a_question, b_title) of entity matches whose entities differ, for a look at each; titles are cut."""
    rows = pairs.where((F.col("alignment_type") == "entity_match") & ~F.col("a_entity").eqNullSafe(F.col("b_entity")))
    return rows.select("score", "a_entity", "b_entity", *(F.substring(c, 1, length).alias(c) for c in ("a_question", "b_title")))


def score_bands(pairs: DataFrame) -> DataFrame:
    s = F.col("score")
    return pairs.agg(F.count_if(s == 1).alias("exact"), F.count_if((s >= 0.75) & (s < 1)).alias("high"), F.count_if((s >= 0.5) & (s < 0.75)).alias("low"))


def score_stats(pairs: DataFrame, *keys: str) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.min("score").alias("min_score"), F.median("score").alias("median_score"))


def day_bands(rows: DataFrame) -> DataFrame:
    """Histogram and median of the days of rows that aren't capped, and the counts of missing and capped dates."""
    d, live = F.col("days_to_resolution"), ~F.col("date_capped")
    edges = [(None, 7), (7, 30), (30, 90), (90, 180), (180, 365)]
    counts = [F.count_if(live & (d < hi) & (F.lit(True) if lo is None else d >= lo)).alias(f"below_{hi}") for lo, hi in edges]
    return rows.agg(*counts, F.median(F.when(live, d)).alias("median_days"), F.count_if(d.isNull()).alias("missing"), F.count_if("date_capped").alias("capped"))


def sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows for a report, the same in every run: those whose keys have the least MD5."""
    return rows.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)
