"""Alignment of the two venues' markets within an event: entities, similarity join, one-to-one assignment, bounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import numeric as N
from gridloom.functions import text as X
from gridloom.functions import values as V
from gridloom.sources.tables import materialize

#: Pairs of an event up to which all are scored, and candidate pairs of an event up to which one task assigns them.
ALL_PAIRS, STREAMED = 100_000, 2_000_000


def shared_tokens(titles: DataFrame) -> DataFrame:
    """(event, side, n, shared) of ``titles(event, side, tokens)``: the titles of a side and the tokens that all of them have.

    One scan: an empty token stands for the title itself, so its count is the number of titles, the largest of all. The
    shuffles carry tokens and counts, no titles.
    """
    each = titles.select("event", "side", F.explode(F.array_append(F.array_distinct("tokens"), F.lit(""))).alias("token"))
    counts = each.groupBy("event", "side", "token").agg(F.count("*").alias("df"))
    common = counts.withColumn("n", F.max("df").over(Window.partitionBy("event", "side"))).where(F.col("df") == F.col("n"))
    return common.groupBy("event", "side").agg(F.max("n").alias("n"), F.array_remove(F.sort_array(F.collect_set("token")), "").alias("shared"))


def with_entities(titles: DataFrame, s: V.Strategy) -> DataFrame:
    """``titles(event, side, idx, title, ..)`` with n, the titles of the side, and entity.

    Titles are dealt out first: a small file that is read in one task holds many, each of which takes time.
    """
    titles = titles.repartition("event", "side", "idx").withColumn("tokens", X.tokens(F.col("title")))
    joined = titles.join(shared_tokens(titles), ["event", "side"])
    return joined.withColumn("entity", X.entity(F.col("tokens"), F.col("shared"), F.col("n") == 1, s.stop)).drop("shared", "tokens")


def b_entities(b: DataFrame, s: V.Strategy) -> DataFrame:
    """Entities of the B side ``b(event, idx, title, sub_title, ticker, ..)``. Where all titles of an event are equal, the
    sub-titles give them if they differ, else the tickers' suffixes."""
    by = F.col("event")
    stats = b.groupBy(by).agg(
        F.count("*").alias("many"),
        F.count_distinct(X.normalize(F.col("title"))).alias("titles"),
        F.count_distinct(F.when(F.coalesce("sub_title", F.lit("")) != "", X.normalize(F.col("sub_title")))).alias("subs"),
    )
    mode = F.when((F.col("titles") == 1) & (F.col("many") > 1), F.when(F.col("subs") > 1, "sub").otherwise("suffix")).otherwise("title")
    rows = b.join(stats.withColumn("mode", mode).select("event", "mode"), "event")
    source = F.when(F.col("mode") == "sub", F.coalesce("sub_title", F.lit(""))).otherwise(F.col("title"))
    found = with_entities(rows.withColumns({"own_title": F.col("title"), "title": source, "side": F.lit("b")}), s)
    suffix = X.ticker_suffix(F.col("ticker"), s.suffix_parts)
    return found.withColumns({"entity": F.when(F.col("mode") == "suffix", suffix).otherwise(F.col("entity")), "title": F.col("own_title")}).drop("own_title", "mode", "side")


def ranked_sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of ``rows(event, side, idx, entity, set)`` with the set's rarest tokens in the event first. Entities of fewer than
    two tokens fall away."""
    each = rows.where(F.size("set") > 1).select("event", "side", "idx", "entity", F.explode("set").alias("token"))
    often = each.groupBy("event", "token").agg(F.count("*").alias("df"))
    ranked = each.join(often, ["event", "token"]).groupBy("event", "side", "idx", "entity").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("set"))
    ranked = materialize(ranked.withColumn("set", F.col("set.token")))
    return tuple(_side(ranked, k) for k in ("a", "b"))


def _side(rows: DataFrame, k: str) -> DataFrame:
    return rows.where(F.col("side") == k).select("event", *(F.col(c).alias(f"{k}_{c}") for c in ("idx", "entity", "set")), X.traits(F.col("set")).alias(f"{k}_traits"))


def _met(rows: DataFrame) -> DataFrame:
    """All pairs within events. Both sides are dealt out by event, however small they are: pairs are many more than titles, and a
    broadcast side leaves them to the few tasks that read the other."""
    return _side(rows, "a").hint("merge").join(_side(rows, "b").hint("merge"), "event")


def overlapping(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Pairs of ``ranked_sets`` that may share a ``least`` part of the smaller set, each once: an inverted index of (event, token, the
    larger set's size).

    Of n tokens at least t = ceil(least * n) are shared, so one of the n - t + 1 rarest is: the smaller set looks up these only, for
    each size from its own on that the other side has; the larger one is found by any of its tokens. A pair comes by the first
    shared token of the smaller set.
    """

    def tokens(rows: DataFrame, k: str, direction: int, others: list[int] | None) -> DataFrame:
        held, n = F.col(f"{k}_set"), F.size(f"{k}_set")
        if others is None:  # the larger set
            sizes, looked = F.array(n), held
        else:
            sizes = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda m: (m >= n) if direction == 1 else (m > n))
            looked = F.slice(held, 1, n - F.greatest(F.ceil(n * least - 1e-9), F.lit(1)).cast("int") + 1)
        sized = rows.select("*", F.lit(direction).alias("direction"), F.explode(sizes).alias("size"))
        return sized.select("*", F.posexplode(looked).alias(f"{k}_rank", "token"))

    in_a, in_b = ([r.n for r in rows.select(F.size(f"{k}_set").alias("n")).distinct().collect()] for k, rows in (("a", a), ("b", b)))
    left = tokens(a, "a", 1, in_b).unionByName(tokens(a, "a", 2, None))
    right = tokens(b, "b", 1, None).unionByName(tokens(b, "b", 2, in_a))
    before = F.when(F.col("direction") == 1, F.arrays_overlap(F.slice("a_set", F.lit(1), F.col("a_rank")), "b_set")).otherwise(F.arrays_overlap(F.slice("b_set", F.lit(1), F.col("b_rank")), "a_set"))
    return left.join(right, ["event", "token", "direction", "size"]).where(~before).drop("token", "direction", "size", "a_rank", "b_rank")


def most_pairs(a: DataFrame, b: DataFrame) -> int:
    """How many pairs the event has that has most: what ``candidates`` and ``assign_skewed`` plan by. Takes ``event`` alone."""
    sides = [rows.groupBy("event").agg(F.count("*").alias(k)) for k, rows in (("a", a), ("b", b))]
    return sides[0].join(sides[1], "event").agg(F.max(F.col("a") * F.col("b")).alias("most")).head().most or 0


def candidates(a: DataFrame, b: DataFrame, s: V.Strategy, least: float = V.Thresholds.match, most: int | None = None, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """(event, a_idx, b_idx, a_entity, b_entity, score) of all pairs within an event that reach ``least``, which is above 0.

    Events of at most ``all_pairs`` pairs are joined on the event. In larger ones equal entities meet by their own equi-join and
    all others, which share tokens, by an inverted index. idx is unique within an event's side. Unless ``most`` says that no event
    is that large, the entities are written and the events counted here, so building the result runs jobs.
    """
    left = a.where(F.col("entity") != "").select("event", "idx", "entity")
    if s.anonymous:
        left = left.where(~X.is_placeholder(F.col("entity"), s.name))
    right = b.where(F.col("entity") != "").select("event", "idx", "entity")
    both = left.withColumn("side", F.lit("a")).unionByName(right.withColumn("side", F.lit("b")))
    rows = both.withColumn("set", X.token_set(F.col("entity")))  # token sets are made once a title
    if most is not None and most <= all_pairs:
        return _scored(_met(rows), s, least)
    rows = materialize(rows)
    sizes = rows.groupBy("event").agg((F.count_if(F.col("side") == "a") * F.count_if(F.col("side") == "b")).alias("pairs"))
    large = materialize(sizes.where(F.col("pairs") > all_pairs).select("event"))
    if large.isEmpty():
        return _scored(_met(rows), s, least)
    small, rows = rows.join(large, "event", "left_anti"), rows.join(large, "event", "left_semi")
    sides = [_side(rows, k).withColumn("entity", F.col(f"{k}_entity")) for k in ("a", "b")]
    equal = sides[0].join(sides[1], ["event", "entity"]).drop("entity")
    apart = overlapping(*ranked_sets(rows), least).where(F.col("a_entity") != F.col("b_entity"))
    return _scored(_met(small).unionByName(equal).unionByName(apart), s, least)


def _scored(met: DataFrame, s: V.Strategy, least: float) -> DataFrame:
    score = X.similarity(F.col("a_entity"), F.col("b_entity"), s, tuple(F.col(f"{k}_{c}") for k in ("a", "b") for c in ("set", "traits")))
    return met.withColumn("score", score).where(F.col("score") >= least).select("event", "a_idx", "b_idx", "a_entity", "b_entity", "score")


def assign(pairs: DataFrame) -> DataFrame:
    """One-to-one assignment of ``pairs(event, a_idx, b_idx, score, ..)``: best score first, ties by a_idx, then b_idx; both
    sides are then taken. Other columns stay. The sorted pairs of an event stream through; its taken sides are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        event, used_a, used_b = None, set(), set()
        for batch in batches:
            keep = []
            for i, (e, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("event", "a_idx", "b_idx")), strict=True)):
                if e != event:
                    event, used_a, used_b = e, set(), set()
                if a not in used_a and b not in used_b:
                    used_a.add(a)
                    used_b.add(b)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    return pairs.repartition(F.col("event")).sortWithinPartitions("event", F.desc("score"), "a_idx", "b_idx").mapInArrow(run, pairs.schema)


def assign_rounds(pairs: DataFrame) -> DataFrame:
    """The same result as ``assign`` for events with very many pairs: a pair that is best for both its ends is taken, its ends
    leave, and so on. No event is gathered in one task. When a round frees less than a tenth of what is left, as with long rows of
    ties, ``assign`` takes over: what it takes of the rest is the same."""
    order = [F.desc("score"), "a_idx", "b_idx"]
    left, out = materialize(pairs), None
    many = left.count()
    while many:
        first = [F.row_number().over(Window.partitionBy("event", side).orderBy(*order)) == 1 for side in ("a_idx", "b_idx")]
        taken = materialize(left.withColumns({"p": first[0], "q": first[1]}).where("p and q").drop("p", "q"))
        out = taken if out is None else out.unionByName(taken)
        left = materialize(left.join(taken.select("event", "a_idx"), ["event", "a_idx"], "left_anti").join(taken.select("event", "b_idx"), ["event", "b_idx"], "left_anti").select(*pairs.columns))
        before, many = many, left.count()
        if many and (before - many) * 10 < before:
            return out.unionByName(assign(left))
    return pairs.limit(0) if out is None else out


def assign_skewed(pairs: DataFrame, most: int | None = None, at_most: int = STREAMED) -> DataFrame:
    """The same result: events of at most ``at_most`` pairs stream, the others go through rounds. Unless ``most`` says that no event
    has more, the pairs are written and counted."""
    if most is not None and most <= at_most:
        return assign(pairs)
    pairs = materialize(pairs)
    large = materialize(pairs.groupBy("event").count().where(F.col("count") > at_most).select("event"))
    if large.isEmpty():
        return assign(pairs)
    rest = pairs.join(large, "event", "left_anti").select(*pairs.columns)
    return assign(rest).unionByName(assign_rounds(pairs.join(large, "event", "left_semi").select(*pairs.columns)))


def direct(a: DataFrame, b: DataFrame, s: V.Strategy) -> DataFrame:
    """The pair of an event with one market on each side, ``a(event, idx, title)`` and ``b``, unless a guard speaks against it."""
    sides = [df.withColumn("n", F.count("*").over(Window.partitionBy("event"))).where("n = 1").select("event", F.col("idx").alias(f"{k}_idx"), F.col("title").alias(f"{k}_title")) for k, df in (("a", a), ("b", b))]
    pairs = sides[0].join(sides[1], "event")
    q, r = F.col("a_title"), F.col("b_title")
    guard = X.polarity_inversion(q, r)
    if s.timeframe:
        guard = guard | X.timeframes_differ(q, r)
    return pairs.where(~guard).select("event", "a_idx", "b_idx", F.lit(1.0).alias("score"), F.lit("").alias("a_entity"), F.lit("").alias("b_entity"))


def numeric_sides(titles: DataFrame, strategy: str) -> DataFrame:
    """(event, side, is_numeric): whether over 30 % of a side's titles are numeric. In whole numbers, as 0.3 is no double."""
    yes = F.sum(N.is_numeric(F.col("title"), strategy).cast("int"))
    return titles.groupBy("event", "side").agg((yes * 10 > F.count("*") * 3).alias("is_numeric"))


def same_bounds(a: DataFrame, b: DataFrame, strategy: str) -> DataFrame:
    """For each A question with bounds the first B title of its event with the same ones. A B title may serve several."""
    sides = [df.withColumn("x", N.bounds(F.col("title"), strategy)).where("x is not null").select("event", F.col("idx").alias(f"{k}_idx"), F.col("x.lo").alias(f"{k}_lo"), F.col("x.hi").alias(f"{k}_hi")) for k, df in (("a", a), ("b", b))]
    same = F.col("a_lo").eqNullSafe(F.col("b_lo")) & F.col("a_hi").eqNullSafe(F.col("b_hi")) & (F.col("l.event") == F.col("r.event"))
    met = sides[0].alias("l").join(sides[1].alias("r"), same).select("l.event", "a_idx", "b_idx", F.col("a_lo").alias("lo"), F.col("a_hi").alias("hi"))
    first = met.groupBy("event", "a_idx").agg(F.min("b_idx").alias("b_idx"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    text = N.bounds_text(F.struct("lo", "hi"))
    return first.select("event", "a_idx", "b_idx", F.lit(1.0).alias("score"), text.alias("a_entity"), text.alias("b_entity"))
