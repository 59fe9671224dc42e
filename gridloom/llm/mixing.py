"""Mixing sources to target weights, with DataFrame functions only.

The texts of a source, in a pseudorandom order, are one string of words that is cut into blocks of fixed length. The mix is a
list of slots, a block each, cut into output shards. Each slot draws its source by weight, with replacement, so a shard's source
counts are one multinomial draw. A source's draws are numbered over all shards, and the number goes through the source's own
permutation of block indexes. Draws beyond what a source gives, in the last shards, go to the sources that were drawn too
seldom: so the totals come out as wished.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import WORD, few, n_words, row_key, table
from gridloom.sources.tables import materialize

WEIGHTS, MOST = (5, 2, 1), 3
BLOCK, SHARD_SLOTS, SEED = 256, 1024, 17
#: Rows of a source are ordered within such hash buckets, so that a source with a third of all rows is no single task.
BUCKETS = 1024
#: The targets of at most so many sources are broadcast.
BROADCAST_SOURCES = 10_000
_ROUNDS = 12


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of x (0 <= x < n) under a pseudorandom permutation of n places that ``key`` selects.

    Swap-or-not: round r may swap x with its mirror image around a point; both agree by a hash of the larger of the two.
    """

    def step(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.xxhash64(r, *key).bitwiseAND(F.lit((1 << 62) - 1)) - x, n)  # masked: the difference can't overflow
        return F.when(F.xxhash64(F.greatest(x, mirror), r, *key).bitwiseAND(F.lit(1)) == 1, mirror).otherwise(x)

    return F.when(n > 1, F.reduce(F.sequence(F.lit(1), F.lit(_ROUNDS)), x, step)).otherwise(x)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes(source, source_size)``, one row a source, with weight and target.

    Sources by code point, null last, weigh ``weights`` in turn, and share the sum of sizes by weight; a target stops at
    ``most`` times its source's size, and the excess is shared anew by weight until none is above. In one pass: sources stop
    in the order of their size by weight, so the k that stop are the first k for which the common rate lets the k-th stop.
    """
    one = Window.partitionBy(F.lit(0))
    nth = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int")).cast("double"))
    rows = rows.withColumn("most", (F.col("source_size") * most).cast("double"))
    up = one.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"stopped": F.sum("most").over(up), "weights": F.sum("weight").over(up), "total": F.sum("source_size").over(one), "all": F.sum("weight").over(one)})
    rows = rows.withColumn("stops", F.col("most") * (F.col("all") - F.col("weights") + F.col("weight")) <= F.col("weight") * (F.col("total") - F.col("stopped") + F.col("most")))
    rows = rows.withColumns({"rest": F.col("total") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("most"))).over(one), F.lit(0.0)), "share": F.sum(F.when(~F.col("stops"), F.col("weight"))).over(one)})
    target = F.when(F.col("stops"), F.col("most")).otherwise(F.least(F.col("most"), F.col("rest") * F.col("weight") / F.col("share")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def layout(docs: DataFrame, block: int, seed: int) -> DataFrame:
    """Where each row of ``docs(source, size, key...)`` lies in its source's string of words: begin; with the source's size.
    Equal rows lie one after the other, a null source is a source, and an empty table gives no rows."""
    keys = [c for c in docs.columns if c not in ("source", "size")]
    rows = docs.withColumns({"order": F.xxhash64(*keys, F.lit(seed))}).withColumn("bucket", F.pmod("order", F.lit(BUCKETS)))
    cells = rows.groupBy("source", "bucket").agg(F.sum("size").alias("cell"))
    by = Window.partitionBy("source")
    cells = cells.withColumns({"before": F.sum("cell").over(by.orderBy("bucket")) - F.col("cell"), "source_size": F.sum("cell").over(by)}).drop("cell")
    within = Window.partitionBy("source", "bucket").orderBy("order", *keys).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("begin", F.sum("size").over(within) - F.col("size"))
    joined = rows.alias("r").join(cells.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.bucket") == F.col("c.bucket")))
    return joined.select(*(f"r.{c}" for c in docs.columns), (F.col("begin") + F.col("before")).alias("begin"), "source_size")


def held_by(places: DataFrame, line: DataFrame, since: str, size: str) -> DataFrame:
    """``places(x, ..)`` with the columns of the row of ``line`` that holds x: since <= x < since + size. An equi-join on chunks
    of the line; ``line`` is a row a source, broadcast after a check of its number."""
    chunk = 1 << 17
    of = F.explode(F.sequence(F.floor(F.col(since) / chunk).cast("long"), F.floor((F.col(since) + F.col(size) - 1) / chunk).cast("long")))
    cut = line.where(F.col(size) > 0).withColumn("chunk", of)
    cut = F.broadcast(cut) if few(cut, BROADCAST_SOURCES) else cut
    met = places.withColumn("chunk", F.floor(F.col("x") / chunk).cast("long")).join(cut, "chunk")
    return met.where((F.col("x") >= F.col(since)) & (F.col("x") < F.col(since) + F.col(size))).drop("chunk")


def draws(line: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(slot, shard, source, nth): the source that each slot draws, and the draw's number among its source's in the shard.

    ``line(source, first, n, all)`` gives each source n of ``all`` places; a slot draws a place by hash, with replacement.
    """
    chunk = 1 << 17
    parts = line.agg(F.max("all").alias("all")).where("all > 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / chunk).cast("long"))))
    # a fixed number of partitions: these few rows are small, what they make is not
    parts = parts.repartition(int(line.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("part"))
    own = F.explode(F.sequence(F.col("part") * chunk, F.least(F.col("all"), (F.col("part") + 1) * chunk) - 1))
    made = parts.withColumn("slot", own).withColumn("x", F.pmod(F.xxhash64("slot", F.lit(seed)), F.col("all"))).select("slot", "x")
    found = held_by(made, line.select("source", "first", "n"), "first", "n").select("slot", F.floor(F.col("slot") / shard_slots).cast("long").alias("shard"), "source")
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "source").orderBy("slot")) - 1)


def numbered(line: DataFrame, drawn: DataFrame) -> DataFrame:
    """The slots of ``drawn`` with the row of ``line`` they belong to and j, the slot's number in its source, 0 to n - 1.

    The counts by shard are summed up in two steps, by groups of shards, so that no source's shards are one task.
    """
    counts = drawn.groupBy("source", "shard").agg(F.count("*").alias("c")).withColumn("group", F.floor(F.col("shard") / 4096).cast("long"))
    groups = counts.groupBy("source", "group").agg(F.sum("c").alias("g"))
    groups = groups.withColumn("before", F.sum("g").over(Window.partitionBy("source").orderBy("group")) - F.col("g")).drop("g")
    same = F.col("c.source").eqNullSafe(F.col("g.source")) & (F.col("c.group") == F.col("g.group"))
    within = F.sum("c.c").over(Window.partitionBy("c.source", "c.group").orderBy("c.shard")) - F.col("c.c")
    offsets = counts.alias("c").join(groups.alias("g"), same).select("c.source", "c.shard", (F.col("g.before") + within).alias("offset"))
    on = F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.shard") == F.col("o.shard"))
    placed = drawn.alias("d").join(offsets.alias("o"), on).select("slot", "d.shard", "d.source", (F.col("offset") + F.col("nth")).alias("j"))
    # how often each source was drawn, its draws too many (over) and too few (under), each summed up over the sources
    one = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    total = counts.groupBy("source").agg(F.sum("c").alias("drawn"))
    known = line.alias("l").join(total.alias("t"), F.col("l.source").eqNullSafe(F.col("t.source")), "left").select("l.*", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    known = known.withColumns({"over": F.greatest(F.col("drawn") - F.col("n"), F.lit(0)), "under": F.greatest(F.col("n") - F.col("drawn"), F.lit(0))})
    known = materialize(known.withColumns({"over_from": F.sum("over").over(one) - F.col("over"), "under_from": F.sum("under").over(one) - F.col("under")}))
    full = F.broadcast(known) if few(known, BROADCAST_SOURCES) else known
    placed = placed.alias("p").join(full.alias("k"), F.col("p.source").eqNullSafe(F.col("k.source"))).select("slot", "shard", "j", *(f"k.{c}" for c in known.columns))
    fits = placed.where(F.col("j") < F.col("n"))
    moved = placed.where(F.col("j") >= F.col("n")).select("slot", "shard", (F.col("j") - F.col("n") + F.col("over_from")).alias("x"))
    moved = held_by(moved, known, "under_from", "under").withColumn("j", F.col("drawn") + F.col("x") - F.col("under_from")).drop("x")
    return fits.unionByName(moved)


def slots(plan: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix: slot, shard, source, epoch, block index and words taken of it, for ``plan(source, source_size, target)``.

    A source goes through all its blocks once an epoch, in a new order each; its short last block comes last. The last slot
    of a source takes only as many words of its block as its target still wants.
    """
    rows = plan.where("source_size > 0 and target >= 0.5").withColumns({"want": F.round("target").cast("long"), "blocks": F.ceil(F.col("source_size") / block).cast("long")})
    epochs, rest = F.floor(F.col("want") / F.col("source_size")).cast("long"), F.pmod(F.col("want"), F.col("source_size"))
    rows = rows.withColumn("n", epochs * F.col("blocks") + F.ceil(rest / block).cast("long"))
    one = Window.partitionBy(F.lit(0))
    rows = rows.withColumns({"first": F.sum("n").over(one.orderBy(F.col("source").asc_nulls_last())) - F.col("n"), "all": F.sum("n").over(one)})
    rows = materialize(rows)
    drawn = materialize(draws(rows, shard_slots, seed))
    made = numbered(rows, drawn).withColumns({"epoch": F.floor(F.col("j") / F.col("blocks")).cast("long"), "at": F.pmod("j", F.col("blocks"))})
    whole = F.floor(F.col("source_size") / block).cast("long")
    made = made.withColumn("block", F.when(F.col("at") < whole, permuted(F.col("at"), whole, F.lit(seed), F.col("source"), F.col("epoch"))).otherwise(F.col("at")))
    left = F.col("want") - F.col("epoch") * F.col("source_size") - F.col("at") * block
    size = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    return made.select("slot", "shard", "source", "epoch", "block", F.least(size, left).cast("long").alias("words"))


def mix(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, mixture) for ``docs(source, size, key...)``.

    rows: ``docs`` with begin, source_size and target. mixture: slot, shard, epoch, source, key..., from and words: which words
    of a row a slot holds, where the rows of a block follow each other by ``begin``. Rows without words are in no slot. Source
    and begin tell rows with words apart, so equal rows, and one text in several sources, are taken each. A null source is a source, the last. No row is taken more than ``MOST`` times over. Empty in, empty out.
    """
    keys = [c for c in docs.columns if c not in ("source", "size")]
    laid = materialize(layout(docs, block, seed))
    plan = materialize(targets(laid.groupBy("source").agg(F.max("source_size").alias("source_size"))))
    known = F.broadcast(plan) if few(plan, BROADCAST_SOURCES) else plan
    rows = laid.alias("l").join(known.alias("p"), F.col("l.source").eqNullSafe(F.col("p.source")), "left").select("l.*", "p.target")
    first, last = F.floor(F.col("begin") / block).cast("long"), F.floor((F.col("begin") + F.col("size") - 1) / block).cast("long")
    held = laid.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    made = slots(plan, block, shard_slots, seed).hint("merge")  # as many rows as the mix has blocks: never to be broadcast
    met = held.alias("h").join(made.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source")) & (F.col("h.block") == F.col("s.block")))
    met = met.select("slot", "shard", "epoch", "h.source", *(f"h.{c}" for c in keys), "h.begin", (F.greatest(F.col("begin"), F.col("h.block") * block) - F.col("begin")).alias("from"), (F.least(F.col("begin") + F.col("size"), F.col("h.block") * block + F.col("s.words")) - F.col("begin")).alias("until"))
    return rows, met.where(F.col("until") > F.col("from")).withColumn("words", F.col("until") - F.col("from")).drop("until")


def sized(docs: DataFrame) -> DataFrame:
    """source, size and what tells rows apart."""
    return docs.select("source", n_words(F.col("text")).alias("size"), "doc_id", row_key(F.col("text")).alias("key"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    rows, mixture = mix(sized(table(spark, sf_dir, "documents", "doc_id", "text", "source")))
    taken = mixture.groupBy("source", "begin").agg(F.sum("words").alias("taken"))
    same = F.col("r.source").eqNullSafe(F.col("t.source")) & (F.col("r.begin") == F.col("t.begin"))
    out = rows.alias("r").join(taken.alias("t"), same & (F.col("r.size") > 0), "left")
    return out.select("r.doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: a row for each epoch in which it takes words of a document, with those words.

    A document that an epoch takes whole keeps its text as it is; of others the words are joined by a space, in their order.
    n_chars, where it is there, is counted anew. Rows equal in id, text and source are taken each; where their other columns
    differ, which of them takes which part is arbitrary. An empty table gives no rows.
    """
    columns = docs.columns
    keyed = docs.select(F.struct("*").alias("row"), "source", n_words(F.col("text")).alias("size"), "doc_id", row_key(F.col("text")).alias("key"))
    _, mixture = mix(keyed.select("source", "size", "doc_id", "key"))
    taken = mixture.groupBy("source", "doc_id", "key", "begin", "epoch").agg(F.sum("words").alias("words"), F.collect_list(F.struct("from", "words")).alias("parts"))
    # equal rows lie at different places; each of them is paired with one
    nth = Window.partitionBy("source", "doc_id", "key")
    repeats = not keyed.groupBy("source", "doc_id", "key").count().where("count > 1").isEmpty()
    taken = taken.withColumn("nth", F.dense_rank().over(nth.orderBy("begin")) if repeats else F.lit(1))
    keyed = keyed.withColumn("nth", F.row_number().over(nth.orderBy("size")) if repeats else F.lit(1))
    same = F.col("d.source").eqNullSafe(F.col("t.source")) & F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("d.key") == F.col("t.key")) & (F.col("d.nth") == F.col("t.nth"))
    met = keyed.alias("d").join(taken.alias("t"), same)
    # the words are bound once for all parts of a document
    words = F.array(F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0)))
    some = F.transform(words, lambda w: F.flatten(F.transform(F.array_sort("t.parts"), lambda p: F.slice(w, p["from"].cast("int") + 1, p["words"].cast("int")))))[0]
    text = F.when(F.col("t.words") == F.col("d.size"), F.col("row.text")).otherwise(F.array_join(some, " "))
    out = met.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
