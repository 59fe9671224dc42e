"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the five ASCII control blanks; ``bytes.split()`` splits alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def few(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has at most ``bound`` rows: the check that goes before each broadcast."""
    return df.limit(bound + 1).count() <= bound


def n_words(text: Column) -> Column:
    """Number of words; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(text: Column) -> Column:
    """Tells apart different rows that share an id; equal rows share it."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def pieces(values: list[bytes], at_most: int) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts sum to about ``at_most`` bytes, a longer text alone: bounds what is held at once."""
    start = size = 0
    for i, value in enumerate(values):
        if size and size + len(value) > at_most:
            yield start, i
            start, size = i, 0
        size += len(value)
    if start < len(values):
        yield start, len(values)


MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * MIX1
    x = x ^ (x >> np.uint64(29))
    x = x * MIX2
    return x ^ (x >> np.uint64(32))


def word_hashes(text: bytes, hasher: Callable[[bytes], int]) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(hasher, words), np.uint64, len(words))
