"""Feed messages of both venues as one relation: seq, item, pos, recv_ts, kind, book, side, tick, qty. One row a level.

seq, item and pos order the rows: the frame, the message in a list frame, the row in a message. Numbers are whole. A full book
begins with a row without a tick, so that an empty or one-sided book is seen too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRICE, SIZE = 10_000, 100  # ticks in a dollar, units in a contract
_LEVEL = "array<struct<price:string,size:string>>"
_A = f"struct<event_type:string,asset_id:string,bids:{_LEVEL},asks:{_LEVEL},price_changes:array<struct<asset_id:string,price:string,size:string,side:string>>,changes:array<struct<asset_id:string,price:string,size:string,side:string>>>"
_B = "struct<type:string,msg:struct<market_ticker:string,yes_dollars_fp:array<array<string>>,no_dollars_fp:array<array<string>>,price_dollars:string,delta_fp:string,side:string>>"
LEVEL = "array<struct<kind:string,book:string,side:string,tick:bigint,qty:bigint>>"


def _whole(c: Column, unit: int) -> Column:
    return F.round(c.try_cast("decimal(38,10)") * unit).cast("bigint")


def _row(kind: str, book: Column, side: Column, price: Column, size: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), book.alias("book"), side.alias("side"), _whole(price, PRICE).alias("tick"), _whole(size, SIZE).alias("qty"))


def _clear(book: Column) -> Column:
    """The row that begins a full book: all levels of the book go."""
    return _row("snapshot", book, F.lit("bid"), F.lit(None).cast("string"), F.lit(None).cast("string"))


def _or_none(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(LEVEL))


def a_levels(m: Column) -> Column:
    """Rows of one message of the A venue: a full book, or absolute changes. BUY in any case is a bid, all else an ask."""

    def side(name: str) -> Column:
        return F.transform(m[f"{name}s"], lambda x: _row("snapshot", m["asset_id"], F.lit(name), x["price"], x["size"]))

    book = [F.array(_clear(m["asset_id"])), side("bid"), side("ask")]
    changes = F.coalesce(m["price_changes"], m["changes"])
    change = F.transform(changes, lambda x: _row("absolute", F.coalesce(x["asset_id"], m["asset_id"]), F.when(F.upper(x["side"]) == "BUY", "bid").otherwise("ask"), x["price"], x["size"]))
    return F.when(m["event_type"] == "book", F.concat(*map(_or_none, book))).when(m["event_type"] == "price_change", _or_none(change)).otherwise(F.array().cast(LEVEL))


def b_levels(m: Column) -> Column:
    """Rows of one message of the B venue, whose books hold bids: ``ticker/yes`` and ``ticker/no``. A delta of an unknown side changes nothing, but counts as a message (null tick)."""
    x, ticker = m["msg"], m["msg"]["market_ticker"]

    def outcome(name: str) -> Column:
        return F.transform(x[f"{name}_dollars_fp"], lambda v: _row("snapshot", F.concat(ticker, F.lit(f"/{name}")), F.lit("bid"), v[0], v[1]))

    book = [F.array(*(_clear(F.concat(ticker, F.lit(f"/{name}"))) for name in ("yes", "no"))), outcome("yes"), outcome("no")]
    known = x["side"].isin("yes", "no")
    delta = F.array(_row("delta", F.concat(ticker, F.lit("/"), F.when(known, x["side"]).otherwise("yes")), F.lit("bid"), F.when(known, x["price_dollars"]), F.when(known, x["delta_fp"])))
    return F.when(m["type"] == "orderbook_snapshot", F.concat(*map(_or_none, book))).when(m["type"] == "orderbook_delta", delta).otherwise(F.array().cast(LEVEL))


def decode(raw: DataFrame) -> DataFrame:
    """Rows of ``raw(seq, recv_ts, venue, body)``: body is an object or a list of them; what is malformed gives no rows."""
    body = F.trim("body")
    listed = F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    a = F.transform(F.from_json(listed, f"array<{_A}>"), a_levels)
    b = F.transform(F.from_json(listed, f"array<{_B}>"), b_levels)
    items = raw.select("seq", "recv_ts", F.posexplode(F.when(F.col("venue") == "a", a).otherwise(b)).alias("item", "levels"))
    rows = items.select("seq", "recv_ts", "item", F.posexplode("levels").alias("pos", "x"))
    return rows.select("seq", "item", "pos", "recv_ts", "x.kind", "x.book", "x.side", "x.tick", "x.qty")


def landed(spark: SparkSession, path: str) -> DataFrame:
    """A stream of landed JSON lines (seq, recv_ts, venue, body); sockets and their reconnects stay outside the engine."""
    return spark.readStream.schema("seq bigint, recv_ts timestamp, venue string, body string").json(path)
