"""The feed source: batch and stream reads of what landed by subscription."""

import json
import os

from pyspark.sql import functions as F

from gridloom.plans import queries as engine
from gridloom.sources import feeds, landing

DATA = "/root/testdata/sf0.001"


def frames_of(spark):
    return engine._frames(spark, DATA).withColumn("id", F.concat("venue", (F.col("seq") % 23).cast("string")))


def test_subscriptions(spark):
    ids = spark.createDataFrame([("a", f"t{i:05}") for i in range(1201)] * 2 + [("b", f"k{i:05}") for i in range(250)] + [("c", "x"), (None, "y"), ("a", None)], "venue string, id string")
    got = {r.subscription: (r.n, r.lo, r.hi) for r in landing.subscriptions(ids).groupBy("subscription").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).collect()}
    assert got == {"a-000000": (500, "t00000", "t00499"), "a-000001": (500, "t00500", "t00999"), "a-000002": (201, "t01000", "t01200"), "b-000000": (100, "k00000", "k00099"), "b-000001": (100, "k00100", "k00199"), "b-000002": (50, "k00200", "k00249"), "c-000000": (1, "x", "x")}


def test_batch_reads_what_landed(spark, tmp_path):
    frames, folder = frames_of(spark), f"file://{tmp_path}/in"
    landing.register(spark)
    assert spark.read.format("landed_feed").load(folder).count() == 0
    subs = landing.subscriptions(frames, {"a": 4, "b": 10})
    assert landing.land(frames, subs, folder, rows=50) == frames.count()
    got = spark.read.format("landed_feed").load(folder)
    assert got.rdd.getNumPartitions() == subs.select("subscription").distinct().count() == len(os.listdir(tmp_path / "in")) > 7
    columns = ["seq", "recv_ts", "venue", "body"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, frames.select(*columns).collect()))
    levels = ["seq", "item", "pos", "kind", "book", "side", "tick", "qty"]
    assert sorted(map(str, feeds.decode(got).select(*levels).collect())) == sorted(map(str, feeds.decode(frames).select(*levels).collect()))
    before = {f: f.stat().st_mtime for f in (tmp_path / "in").rglob("*.jsonl")}
    assert landing.land(frames.limit(0), subs, folder) == 0 and {f: f.stat().st_mtime for f in (tmp_path / "in").rglob("*.jsonl")} == before


def test_ranges_read_again(spark, tmp_path):
    """A range between two offsets gives the same rows at any time; offsets of subscriptions move apart."""
    frames, folder = frames_of(spark), str(tmp_path / "in")
    subs = landing.subscriptions(frames, {"a": 8, "b": 8})
    landing.land(frames.where("seq % 1000 < 400"), subs, folder, rows=30)
    reader = landing._Stream(folder)
    first = reader.latestOffset()
    landing.land(frames.where("seq % 1000 >= 400 and id <> 'a1'"), subs, folder, rows=30)
    last = reader.latestOffset()
    assert reader.partitions(last, last) == [] and all(last[s] > first[s] for s in last)

    def read(start, end):
        return sorted(seq for part in reader.partitions(start, end) for batch in reader.read(part) for seq in batch.column("seq").to_pylist())

    one, two = read({}, first), read(first, last)
    assert sorted(one + two) == read({}, last) and read(first, last) == two and not set(one) & set(two)
    half = {s: n - 5 for s, n in last.items()}  # within a file
    assert sorted(read({}, half) + read(half, last)) == read({}, last)


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    frames, folder = frames_of(spark), str(tmp_path / "in")
    subs = landing.subscriptions(frames, {"a": 8, "b": 8})
    landing.register(spark)
    seen = []
    for k, part in enumerate(["seq % 1000 < 300", "seq % 1000 >= 300 and seq % 1000 < 600", "seq % 1000 >= 600"]):
        landing.land(frames.where(part), subs, folder, rows=40)
        source = spark.readStream.format("landed_feed").load(folder)
        run = feeds.decode(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
        run.awaitTermination()
        seen.append(spark.read.parquet(str(tmp_path / "out")).count())
    levels = ["seq", "item", "pos", "kind", "book", "side", "tick", "qty"]
    assert seen[0] < seen[1] < seen[2]
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(*levels).collect())) == sorted(map(str, feeds.decode(frames).select(*levels).collect()))
    offsets = json.loads((tmp_path / "ck" / "offsets" / "2").read_text().splitlines()[-1])
    assert offsets == landing._Stream(folder).latestOffset()
