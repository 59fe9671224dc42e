"""Numeric questions and their bounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import values as V


def is_numeric(question: Column, strategy: str) -> Column:
    q = F.lower(question)
    return F.coalesce(reduce(lambda a, b: a | b, (q.rlike(p) for p in [*V.NUMERIC, V.NUMERIC_LAST[strategy]])), F.lit(False))


def bounds(question: Column, strategy: str) -> Column:
    """struct(lo, hi) by the first rule that matches, null without one. A malformed number gives null for all."""
    q = F.lower(question)
    out = F.lit(None).cast("struct<lo:double,hi:double>")
    for kind, pattern in reversed(V.BOUNDS[strategy]):
        comma = "," in pattern.split("(")[1]
        groups = [F.regexp_extract(q, pattern, g) for g in ((1, 2) if kind == "both" else (1,))]
        numbers = [(F.regexp_replace(g, ",", "") if comma else g).try_cast("double") for g in groups]
        none = F.lit(None).cast("double")
        lo, hi = {"both": (numbers[0], numbers[-1]), "lower": (numbers[0], none), "upper": (none, numbers[0])}[kind]
        good = reduce(lambda a, b: a & b, (n.isNotNull() for n in numbers))
        out = F.when(q.rlike(pattern), F.when(good, F.struct(lo.alias("lo"), hi.alias("hi")))).otherwise(out)
    return out


def bounds_text(b: Column) -> Column:
    """``(None, 5.0)`` and the like."""

    def one(x: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,10)").cast("string"), "0+$", ""), r"\.$", ".0")
        return F.coalesce(plain, F.lit("None"))

    return F.concat(F.lit("("), one(b["lo"]), F.lit(", "), one(b["hi"]), F.lit(")"))
