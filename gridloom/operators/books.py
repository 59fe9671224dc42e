"""Order books replayed from a log of messages: one row a level, exact whole numbers for ticks and sizes.

A log has (book, seq, kind, side, tick, qty); seq orders it, and item and pos within a seq where the log has them. Rows that
share seq and item are one message. A snapshot replaces its book: of a level that it names twice the last size above 0 counts; a
row without a tick only clears. Absolute messages set a level, and remove it at or below 0. Deltas add to a level, which never
falls below 0.

A book that has most of the log is no single task: ``in_pieces`` cuts logs into ranges of messages. What a piece does to a level is
x -> max(a, x + b), or a fixed size, and such steps compose. So each piece is folded by itself, the folds are scanned book by book,
and each piece is replayed from the levels that the scan brings to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from gridloom.sources.tables import materialize

LEVEL = ("book", "side", "tick")
ORDER = ("seq", "item", "pos")
#: Messages of a book from which on its log is replayed in pieces.
HOT_BOOK = 5_000_000


def ordered(log: DataFrame) -> DataFrame:
    """``log`` with item and pos, 0 where it has none."""
    return log.withColumns({c: F.lit(0) for c in ORDER[1:] if c not in log.columns})


def epochs(log: DataFrame) -> DataFrame:
    """``log`` with epoch, the number of snapshot messages of the book so far."""
    log, upto = ordered(log), Window.partitionBy("book").orderBy(*ORDER)
    same = (F.lag("seq").over(upto) == F.col("seq")) & (F.lag("item").over(upto) == F.col("item")) & (F.lag("kind").over(upto) == "snapshot")
    first = (F.col("kind") == "snapshot") & ~F.coalesce(same, F.lit(False))
    return log.withColumn("first", first.cast("int")).withColumn("epoch", F.sum("first").over(upto.rowsBetween(Window.unboundedPreceding, 0))).drop("first")


def absolute_state(log: DataFrame) -> DataFrame:
    """The levels (book, side, tick, size) that a log of snapshots and absolute messages leaves. Aggregations only."""
    log, message = ordered(log), F.struct("seq", "item")
    since = log.groupBy("book").agg(F.max(F.when(F.col("kind") == "snapshot", message)).alias("since"))
    live = log.join(since, "book").where(F.col("since").isNull() | (message >= F.col("since"))).where(_counts())
    last = live.groupBy(*LEVEL).agg(F.max_by("qty", F.struct(*ORDER)).alias("size"))
    return last.where("size > 0")


def _counts() -> Column:
    """Rows that say something of a level."""
    return F.col("tick").isNotNull() & ((F.col("kind") != "snapshot") | (F.col("qty") > 0))


def delta_sizes(log: DataFrame, hot: int = HOT_BOOK) -> DataFrame:
    """``log`` with size, the level's size after each message, where all quantities are deltas to what the last snapshot left. Of a
    level that a snapshot names twice only the row that counts stays. Counts the books' messages first: a log with a book of over
    ``hot`` messages is replayed in pieces."""
    few = log.groupBy("book").count().where(F.col("count") > hot).isEmpty()
    return sizes_by_windows(log) if few else sizes_in_pieces(log)


def sizes_by_windows(log: DataFrame) -> DataFrame:
    """``log`` with size, the level's size after each message, where all quantities are deltas to what the last snapshot left. A book's log is sorted in one task.

    The clamp at 0 is a reflected sum: with S the plain running sum, the size is S - min(0, the least S so far).
    """
    run = Window.partitionBy(*LEVEL, "epoch").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    of, at, full = Window.partitionBy(*LEVEL, "epoch"), F.struct(*ORDER), F.col("kind") == "snapshot"
    counts = F.coalesce(F.max(F.when(full & (F.col("qty") > 0), at)).over(of), F.max(F.when(full, at)).over(of))
    marked = epochs(log).where("tick is not null").withColumn("counts", counts).where(~full | (at == F.col("counts"))).drop("counts")
    marked = marked.withColumn("qty", F.when(full, F.greatest("qty", F.lit(0))).otherwise(F.col("qty")))
    marked = marked.withColumn("s", F.sum("qty").over(run))
    return marked.withColumn("size", F.col("s") - F.least(F.lit(0), F.min("s").over(run))).drop("s")


def delta_state(log: DataFrame) -> DataFrame:
    """The levels that a log of snapshots and deltas leaves."""
    sizes = delta_sizes(log)
    last = sizes.groupBy(*LEVEL, "epoch").agg(F.max_by("size", F.struct(*ORDER)).alias("size"))
    newest = epochs(log).groupBy("book").agg(F.max("epoch").alias("epoch"))
    return last.join(newest, ["book", "epoch"]).where("size > 0").select(*LEVEL, "size")


_PIECE = ("piece", "book", *ORDER, "kind", "side", "tick", "qty", "plus")


class Live:
    """A book's live levels, message by message."""

    def __init__(self) -> None:
        self.levels: dict[str, dict[int, int]] = {"bid": {}, "ask": {}}
        self.message: tuple | None = None

    def apply(self, at: tuple, kind: str, side: str, tick: int | None, qty: int | None) -> int:
        """The size of the row's level after it."""
        if kind == "snapshot" and self.message != at:
            self.levels = {"bid": {}, "ask": {}}
        self.message = at
        if tick is None or qty is None:
            return 0
        held = self.levels[side]
        if kind == "snapshot" and qty <= 0:
            return held.get(tick, 0)
        size = max(held.get(tick, 0) + qty, 0) if kind == "delta" else max(qty, 0)
        if size > 0:
            held[tick] = size
        else:
            held.pop(tick, None)
        return size


class Fold:
    """What a piece does to a book: whether it clears all levels, and (a, b) by level for x -> max(a, x + b); b is None for a fixed a."""

    def __init__(self) -> None:
        self.cleared, self.steps, self.message = False, {}, None

    def apply(self, at: tuple, kind: str, side: str, tick: int | None, qty: int | None) -> None:
        if kind == "snapshot" and self.message != at:
            self.cleared, self.steps = True, {}
        self.message = at
        if kind == "mark" or tick is None or qty is None or (kind == "snapshot" and qty <= 0):
            return
        if kind == "delta":
            a, b = self.steps.get((side, tick), (0, None if self.cleared else 0))
            self.steps[side, tick] = max(0, a + qty), None if b is None else b + qty
        else:
            self.steps[side, tick] = max(qty, 0), None


def _records(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


def in_pieces(log: DataFrame, emit: Callable[[Live, tuple], list[tuple]], schema: str, pieces: int | None = None, finish: Callable[[Live], list[tuple]] = lambda state: []) -> DataFrame:
    """Rows that ``emit`` gives for each row of ``log`` in order, given the book's levels before it and (book, seq, item, pos, kind,
    side, tick, qty); ``emit`` applies the row. ``finish`` gives what is left at the end of a book's piece. The log is cut into ranges
    of whole messages, as many as shuffles have partitions.

    Rows of kind ``mark`` change nothing. The log is written with its pieces and folds, so building the result runs a job.
    """
    spark = log.sparkSession
    whole = ordered(log).select("book", *(F.col(c).cast("bigint").alias(c) for c in ORDER), "kind", "side", F.col("tick").cast("bigint").alias("tick"), F.col("qty").cast("bigint").alias("qty"))
    book = whole.schema["book"].dataType
    held = pa.schema([("piece", pa.int64()), ("book", to_arrow_type(book)), *((c, pa.int64()) for c in ORDER), ("kind", pa.string()), ("side", pa.string()), *((c, pa.int64()) for c in ("tick", "qty", "plus"))])
    ddl = ", ".join(f"{f.name} {'string' if f.type == pa.string() and f.name != 'book' else book.simpleString() if f.name == 'book' else 'bigint'}" for f in held)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows, and the folds of the first and the last book of the piece: others lie in it whole."""
        last, first, piece, state = None, True, None, Fold()

        def folded() -> list[tuple]:
            head = (piece, last, None, None, None, "cleared" if state.cleared else "went on", None, None, None, None)
            return [head, *((piece, last, None, None, None, "fold", side, tick, a, b) for (side, tick), (a, b) in state.steps.items())]

        for batch in batches:
            if not batch.num_rows:
                continue
            yield pa.RecordBatch.from_arrays(batch.columns, schema=held)
            out, piece = [], batch.column("piece")[0].as_py()
            for b, *at, kind, side, tick, qty in zip(*(batch.column(c).to_pylist() for c in ("book", "seq", "item", "kind", "side", "tick", "qty")), strict=True):
                if b != last:
                    if last is not None and first:
                        out, first = folded(), False
                    last, state = b, Fold()
                state.apply(tuple(at), kind, side, tick, qty)
            if out:
                yield _records(held, out)
        if last is not None:
            yield _records(held, folded())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The levels with which a book comes to each piece but its first."""
        book, piece, levels = None, None, {}
        for batch in batches:
            out = []
            for p, b, kind, side, tick, a, plus in zip(*(batch.column(c).to_pylist() for c in ("piece", "book", "kind", "side", "tick", "qty", "plus")), strict=True):
                if b != book:
                    book, piece, levels = b, None, {}
                if p != piece:
                    out += [(p, b, None, None, None, "carried", *k, x, None) for k, x in levels.items()]
                    piece = p
                if kind == "cleared":
                    levels = {}
                elif kind == "fold":
                    size = a if plus is None else max(a, levels.get((side, tick), 0) + plus)
                    levels.pop((side, tick), None)
                    if size > 0:
                        levels[side, tick] = size
            yield _records(held, out)

    names, result = ("book", *ORDER, "kind", "side", "tick", "qty"), _arrow(spark, schema)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, Live()
        for batch in batches:
            out = []
            for piece, *row in zip(*(batch.column(c).to_pylist() for c in ("piece", *names)), strict=True):
                if (piece, row[0]) != at:
                    out += finish(state)
                    at, state = (piece, row[0]), Live()
                if row[4] == "carried":
                    state.levels[row[5]][row[6]] = row[7]
                else:
                    out += emit(state, tuple(row))
            if out:
                yield _records(result, out)
        yield _records(result, finish(state))

    ranges = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = whole.repartitionByRange(ranges, "book", "seq", "item").sortWithinPartitions("book", *ORDER)
    cut = cut.withColumns({"piece": F.spark_partition_id().cast("bigint"), "plus": F.lit(None).cast("bigint")}).select(*_PIECE)
    rows = materialize(cut.mapInArrow(fold, ddl))
    is_fold = F.col("kind").isin("cleared", "went on", "fold")
    order = F.when(F.col("kind") == "fold", 1).otherwise(0)  # a piece's clearing comes before its levels
    folds = rows.where(is_fold).repartition(F.col("book")).sortWithinPartitions("book", "piece", order)
    all_ = rows.where(~is_fold).unionByName(folds.mapInArrow(scan, ddl))
    return all_.repartition(F.col("piece")).sortWithinPartitions("piece", F.col("book"), F.col("seq").asc_nulls_first(), "item", "pos").mapInArrow(replay, schema)


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in spark.createDataFrame([], schema).schema.fields])


def sizes_in_pieces(log: DataFrame, pieces: int | None = None) -> DataFrame:
    """(book, seq, item, pos, kind, side, tick, qty, size) of the rows that ``delta_sizes`` keeps, with no book in one task."""

    def emit(state: Live, row: tuple) -> list[tuple]:
        book, seq, item, _, kind, side, tick, qty = row
        done = _flush(state) if state.message != (seq, item) else []
        size = state.apply((seq, item), kind, side, tick, qty)
        if kind != "snapshot" or tick is None:
            return done if tick is None else [*done, (*row[:7], qty, size)]
        held = state.__dict__.setdefault("full", {})  # of a level that a snapshot names twice the last above 0 counts, else the last
        if (side, tick) not in held or qty > 0 or held[side, tick][7] <= 0:
            held[side, tick] = (*row[:7], max(qty, 0))
        return done

    def _flush(state: Live) -> list[tuple]:
        return [(*r, r[7]) for r in state.__dict__.pop("full", {}).values()]

    book = log.schema["book"].dataType.simpleString()
    return in_pieces(log, emit, f"book {book}, seq bigint, item bigint, pos bigint, kind string, side string, tick bigint, qty bigint, size bigint", pieces, _flush)


def as_of(log: DataFrame, times: DataFrame, pieces: int | None = None) -> DataFrame:
    """(book, at, best_bid, bids, best_ask, asks) for ``times(book, at)``: best prices (null without one) and numbers of levels of the
    book that its messages up to seq ``at`` leave. The log is replayed in pieces, so no book is one task."""

    def emit(state: Live, row: tuple) -> list[tuple]:
        book, seq, item, _, kind, side, tick, qty = row
        if kind != "mark":
            state.apply((seq, item), kind, side, tick, qty)
            return []
        bids, asks = state.levels["bid"], state.levels["ask"]
        return [(book, seq, max(bids, default=None), len(bids), min(asks, default=None), len(asks))]

    end, none = F.lit(2**62), F.lit(None)
    marks = times.select("book", F.col("at").cast("bigint").alias("seq"), end.alias("item"), end.alias("pos"), F.lit("mark").alias("kind"), none.cast("string").alias("side"), none.cast("bigint").alias("tick"), none.cast("bigint").alias("qty"))
    rows = ordered(log).select(*marks.columns).unionByName(marks)
    return in_pieces(rows, emit, f"book {log.schema['book'].dataType.simpleString()}, at bigint, best_bid bigint, bids bigint, best_ask bigint, asks bigint", pieces)


def best_changes(log: DataFrame, side: str = "bid", pieces: int | None = None) -> DataFrame:
    """(book, seq, item, best, before): each message after which a side's best price is another than before it; null for an empty
    side. Rows of one message follow each other, so each row says what it changed; sums over a message's rows are its change."""
    pick = max if side == "bid" else min

    def emit(state: Live, row: tuple) -> list[tuple]:
        book, seq, item, _, kind, of, tick, qty = row
        known = state.__dict__.get("best", False)
        before = pick(state.levels[side], default=None) if known is False else known  # kept, so that a row costs no look at all levels
        had = before is not None and before in state.levels[side]
        state.apply((seq, item), kind, of, tick, qty)
        now, levels = before, state.levels[side]
        if kind == "snapshot" or not had or before not in levels:
            now = pick(levels, default=None)
        elif of == side and tick in levels:
            now = pick(before, tick)
        state.best = now
        return [(book, seq, item, now, before)] if now != before else []

    return in_pieces(log, emit, f"book {log.schema['book'].dataType.simpleString()}, seq bigint, item bigint, best bigint, before bigint", pieces)


def running_sums(rows: DataFrame, key: str, order: tuple[str, ...], sums: tuple[str, ...]) -> DataFrame:
    """``rows`` with each of ``sums`` replaced by its sum over the rows of ``key`` up to this one; equal ``order`` counts together.

    Rows are cut into ranges; a range's totals are added up first, so that a key which most rows share is no single task. The
    ranges are written, so building the result runs a job.
    """
    cut = materialize(rows.repartitionByRange(key, *order).withColumn("__piece", F.spark_partition_id()))
    upto = Window.partitionBy(key).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(key, "__piece").agg(*(F.sum(c).alias(c) for c in sums))
    ahead = totals.select(key, "__piece", *(F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"__{c}") for c in sums))
    within = Window.partitionBy(key, "__piece").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    added = cut.join(ahead, [key, "__piece"]).withColumns({c: F.sum(c).over(within) + F.col(f"__{c}") for c in sums})
    return added.select(*rows.columns)


def running_last(rows: DataFrame, key: str, order: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """``rows`` with each null of ``columns`` replaced by the last value of ``key`` before it, in ranges as ``running_sums``."""
    cut = materialize(rows.repartitionByRange(key, *order).withColumn("__piece", F.spark_partition_id()))
    at = F.struct(*order)
    ends = cut.groupBy(key, "__piece").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns))
    upto = Window.partitionBy(key).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ends.select(F.col(key).alias("__key"), F.col("__piece").alias("__at"), *(F.last(c, ignorenulls=True).over(upto).alias(f"__{c}") for c in columns))
    within = Window.partitionBy(key, "__piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = cut.join(ahead, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__piece") == F.col("__at")))
    return met.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(within), F.col(f"__{c}")) for c in columns}).select(*rows.columns)


def oversum_changes(log: DataFrame, markets: DataFrame, threshold: int, least: int, pieces: int | None = None) -> DataFrame:
    """(event, seq, item, total, counted, is_oversum): the sum and number of the best bids of an event's markets after each message that
    changes one of them, for ``markets(event, book)``; ``threshold`` is in ticks. A book may be a market of several events."""
    return oversum_of(best_changes(log, "bid", pieces), markets, threshold, least)


def oversum_of(changes: DataFrame, markets: DataFrame, threshold: int, least: int) -> DataFrame:
    """``oversum_changes`` from the ``best_changes`` of bids, those of other books too."""
    named = markets.where(F.coalesce("event", F.lit("")) != "").select("event", "book").distinct()
    many = named.groupBy("event").agg(F.count("*").alias("n_markets"))
    steps = changes.select("book", "seq", "item", (F.coalesce("best", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("total"), (F.col("best").isNotNull().cast("bigint") - F.col("before").isNotNull().cast("bigint")).alias("counted"))
    each = steps.join(named, "book").groupBy("event", "seq", "item").agg(F.sum("total").alias("total"), F.sum("counted").alias("counted"))
    summed = running_sums(each, "event", ("seq", "item"), ("total", "counted")).join(many, "event")
    return summed.withColumn("is_oversum", (F.col("n_markets") >= least) & (F.col("counted") >= least) & (F.col("total") > threshold)).drop("n_markets")


def best(levels: DataFrame, side: str = "bid") -> DataFrame:
    """(book, best, depth): the best price and the number of levels of one side."""
    price = F.max("tick") if side == "bid" else F.min("tick")
    return levels.where(F.col("side") == side).groupBy("book").agg(price.alias("best"), F.count("*").alias("depth"))


def complement(bids: DataFrame, *keys: str) -> DataFrame:
    """The asks that bids of the other outcome amount to: price 1 - bid, inside (0, 1). Bids that meet give the size of the higher bid."""
    ask = F.bround(F.lit(1.0) - F.col("price"), 4)
    rows = bids.withColumn("ask", ask).where((F.col("ask") > 0) & (F.col("ask") < 1))
    return rows.groupBy(*keys, F.col("ask").alias("price")).agg(F.max_by("size", rows["price"]).alias("size"))


def depth(levels: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and depth: how many levels a book has, as the depth gate counts them."""
    return levels.groupBy(*keys).agg(F.count("*").alias("depth"))


def vwap(levels: DataFrame, *keys: str, target: float, ascending: bool = True) -> DataFrame:
    """``keys``, vwap, cost and levels of walking ``levels(keys, price, size)`` until ``target`` dollars are filled.

    Prices outside (0, 1) are skipped. A book that can't fill the target still has a price. Books without shares give no row.
    """
    order = F.col("price") if ascending else F.col("price").desc()
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = levels.where((F.col("price") > 0) & (F.col("price") < 1))
    spent = F.coalesce(F.sum(F.col("price") * F.col("size")).over(before), F.lit(0.0))
    took = inside.withColumn("rest", F.lit(float(target)) - spent).where("rest > 0").withColumn("take", F.least(F.col("size").cast("double"), F.col("rest") / F.col("price")))
    out = took.groupBy(*keys).agg(F.sum(F.col("take") * F.col("price")).alias("cost"), F.sum("take").alias("shares"), F.count("*").alias("levels"))
    return out.where("shares > 0").select(*keys, (F.col("cost") / F.col("shares")).alias("vwap"), "cost", "levels")


def oversum(best_bids: DataFrame, markets: DataFrame, threshold: float, least: int) -> DataFrame:
    """(event, n_markets, counted, total, is_oversum) for ``markets(event, book)`` and ``best_bids(book, price)``; events without a name are none."""
    rows = markets.where(F.coalesce("event", F.lit("")) != "").select("event", "book").distinct().join(best_bids.select("book", "price"), "book", "left")
    out = rows.groupBy("event").agg(F.count("*").alias("n_markets"), F.count("price").alias("counted"), F.coalesce(F.sum("price"), F.lit(0.0)).alias("total"))
    return out.withColumn("is_oversum", (F.col("n_markets") >= least) & (F.col("counted") >= least) & (F.col("total") > threshold))


def active(known: DataFrame, log: DataFrame) -> DataFrame:
    """(n_books, n_active): how many of the ``known(book)`` books the log has updated."""
    seen = log.select("book").distinct().withColumn("seen", F.lit(True))
    return known.select("book").distinct().join(seen, "book", "left").agg(F.count("*").alias("n_books"), F.count_if(F.col("seen").isNotNull()).alias("n_active"))
