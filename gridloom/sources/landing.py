"""Feeds as they land by subscription: a batch of ids is one connection, and one partition of whoever reads.

Frames of a subscription land in order, as files of JSON lines that are named by the last seq in them and never change:
``<folder>/<subscription>/<last seq>.jsonl``. An offset is the seq that was read last of each subscription, so a range between two
offsets reads the same rows whenever it is read. Sockets stay outside: what holds a connection writes such files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from gridloom.operators.books import running_sums

#: Ids that one connection of each venue subscribes to.
SUBSCRIBED = {"a": 500, "b": 100}
FRAME = "subscription string, seq bigint, recv_ts timestamp, venue string, body string"
_ARROW = pa.schema([("subscription", pa.string()), ("seq", pa.int64()), ("recv_ts", pa.timestamp("us", tz="UTC")), ("venue", pa.string()), ("body", pa.string())])


def subscriptions(ids: DataFrame, sizes: dict[str, int] = SUBSCRIBED) -> DataFrame:
    """(venue, id, subscription) of the distinct ``ids(venue, id)``: in order of id, so many to a subscription. No venue is one task."""
    ranked = running_sums(ids.where("venue is not null and id is not null").select("venue", "id").distinct().withColumn("nth", F.lit(1).cast("bigint")), "venue", ("id",), ("nth",))
    size = F.coalesce(*(F.when(F.col("venue") == v, n) for v, n in sizes.items()), F.lit(min(sizes.values())))
    return ranked.select("venue", "id", F.concat("venue", F.lit("-"), F.lpad(F.floor((F.col("nth") - 1) / size).cast("string"), 6, "0")).alias("subscription"))


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def land(frames: DataFrame, subscribed: DataFrame, folder: str, rows: int = 10_000) -> int:
    """Writes ``frames(seq, recv_ts, venue, id, body)`` as their subscriptions would land, at most ``rows`` to a file, and says how many.

    Frames of ids that no subscription has don't land. A file is written under another name and then moved, and a task that runs
    again writes the same files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _open(folder)
        held: list[tuple[str, int, str]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                where = f"{top}/{held[0][0]}"
                system.create_dir(where, recursive=True)
                done = f"{where}/{held[-1][1]:020}.jsonl"
                with system.open_output_stream(f"{done}.part") as out:
                    out.write("".join(line for *_, line in held).encode())
                system.move(f"{done}.part", done)
                yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64())], ["n"])
                held.clear()

        for batch in batches:
            for sub, seq, at, venue, body in zip(*(batch.column(c).to_pylist() for c in ("subscription", "seq", "at", "venue", "body")), strict=True):
                if held and (held[0][0] != sub or (len(held) >= rows and held[-1][1] != seq)):
                    yield from flush()
                held.append((sub, seq, json.dumps({"seq": seq, "at": at, "venue": venue, "body": body}) + "\n"))
        yield from flush()

    of = frames.join(subscribed, ["venue", "id"]).select("subscription", "seq", F.unix_micros("recv_ts").alias("at"), "venue", "body")
    placed = of.repartition(F.col("subscription")).sortWithinPartitions("subscription", "seq", "body")
    return placed.mapInArrow(write, "n bigint").agg(F.sum("n").alias("n")).head().n or 0


@dataclass
class Range(InputPartition):
    """Frames of a subscription after ``since`` up to ``until``."""

    subscription: str
    since: int
    until: int


class _Folder:
    """What batch and stream readers share."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def files(self, subscription: str) -> list[int]:
        system, top = _open(self.folder)
        found = system.get_file_info(fs.FileSelector(f"{top}/{subscription}"))
        return sorted(int(f.base_name.removesuffix(".jsonl")) for f in found if f.base_name.endswith(".jsonl"))

    def landed(self) -> dict[str, int]:
        system, top = _open(self.folder)
        found = system.get_file_info(fs.FileSelector(top, allow_not_found=True))
        return {f.base_name: last[-1] for f in found if f.type == fs.FileType.Directory and (last := self.files(f.base_name))}

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        return [Range(s, start.get(s, -(1 << 63)), last) for s, last in sorted(end.items()) if start.get(s, -(1 << 63)) < last]

    def rows(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, top = _open(self.folder)
        before = None
        for last in self.files(part.subscription):
            if last > part.since and (before is None or before < part.until):
                with system.open_input_stream(f"{top}/{part.subscription}/{last:020}.jsonl") as file:
                    lines = [json.loads(x) for x in file.read().decode().split("\n") if x]
                lines = [x for x in lines if part.since < x["seq"] <= part.until]
                yield pa.RecordBatch.from_arrays([pa.array([part.subscription] * len(lines), pa.string()), *(pa.array([x[k] for x in lines], t) for k, t in (("seq", pa.int64()), ("at", pa.timestamp("us", tz="UTC")), ("venue", pa.string()), ("body", pa.string())))], schema=_ARROW)
            before = last


class _Batch(DataSourceReader, _Folder):
    def partitions(self) -> list[Range]:
        return self.ranges({}, self.landed()) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.rows(partition) if partition.subscription else iter(())


class _Stream(DataSourceStreamReader, _Folder):
    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return self.landed()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.ranges(start, end)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is let go: files stay as they landed, for replays."""


class LandedFeed(DataSource):
    """``spark.read`` or ``spark.readStream.format("landed_feed").load(folder)``: the frames that landed, a partition a subscription."""

    @classmethod
    def name(cls) -> str:
        return "landed_feed"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema: object) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options["path"])


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(LandedFeed)
    return spark
