"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame functions only.

A sketch is the ascending array of the k least distinct 64-bit hashes of a text's word shingles. Sketches of parts merge
into the sketch of the whole, and estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import row_key, table

WIDTH, SIZE = 5, 128
BLANKS, GAP = " \t\n\x0b\f\r", r"[\x20\x09-\x0D]+"
#: Ranges of ids within which neighbours are found: cut at quantiles, and these cut evenly where more are needed.
ROWS_A_RANGE, QUANTILES, MOST_PARTS = 500, 1024, 128
#: Rows of an id that many rows share are cut into so many more ranges, by the hash of their text.
SHARED_PARTS = 255
_LEAST = -(2**63)


def sketch(text: Column, size: int = SIZE, width: int = WIDTH) -> Column:
    """The sketch of a text. Fewer words than ``width`` are one shingle; null and a text without words give no hashes."""
    body = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    words = F.array(F.split(body, GAP, -1))  # bound once for all shingles
    hashes = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - width, F.lit(0)) + 1), lambda i: F.xxhash64(F.slice(w, i, width))))[0]
    return F.when(F.length(body) == 0, F.array().cast("array<bigint>")).otherwise(F.slice(F.sort_array(F.array_distinct(hashes)), 1, size))


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimate of the shared share of all distinct shingles, 0 to 1: that of the least hashes of the union which both have.
    Two empty sketches are alike."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union))


def distinct_shingles(a: Column, size: int = SIZE) -> Column:
    """Estimate of the number of distinct shingles; exact below ``size``."""
    span = (F.element_at(a, -1).cast("double") - F.lit(float(_LEAST))) / F.lit(2.0**64)
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) / span)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimate of the share of a's shingles that b has too, 0 to 1; an empty a is contained."""
    j = resemblance(a, b, size)
    shared = j / (1 + j) * (distinct_shingles(a, size) + distinct_shingles(b, size))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, size)))


def merge(parts: DataFrame, *key: str, column: str = "sketch", size: int = SIZE) -> DataFrame:
    """``key`` columns and the sketch of all ``parts`` of that key. Spark limits each group to ``size`` before it shuffles."""
    hashes = parts.select(*key, F.explode(column).alias("h")).distinct()
    least = hashes.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("h"))).where(F.col("nth") <= size)
    full = least.groupBy(*key).agg(F.sort_array(F.collect_list("h")).alias(column))
    empty = parts.where(F.size(column) == 0).select(*key).distinct().select(*key, F.array().cast("array<bigint>").alias("none"))
    return full.join(empty, list(key), "full").select(*key, F.coalesce(column, "none").alias(column))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with range and halo: descending doc_id within a range, each range followed by the row after it.

    Ties go by a hash of the text, null ids come last. The row after the last is the first. The texts move once. Of each
    range the first id is broadcast, for at most ``QUANTILES * (MOST_PARTS + SHARED_PARTS)`` ranges, whatever the input. An id
    (or null) that holds two quantiles or more is cut by the hash of the texts; just rows equal in both share a range always. A doc_id
    of -2**63 counts as null. An empty table gives no rows.
    """
    ids = docs.select("doc_id")
    unique = ids.groupBy("doc_id").count().where("count > 1").isEmpty()
    rows = docs.withColumns({"at": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)), "key": F.lit(0).cast("long") if unique else row_key(F.col("text"))})
    wanted = max(1, ids.count() // ROWS_A_RANGE)
    n, parts = min(QUANTILES, wanted), min(MOST_PARTS, -(-wanted // QUANTILES))
    at = F.col("at")
    cuts, low, high = rows.agg(F.percentile_approx("at", [k / n for k in range(1, n)] or [0.5], F.lit(20 * QUANTILES)), F.min("at"), F.max("at")).head()
    cells_of = [int(c) for c in cuts] if n > 1 and cuts else []
    bounds = sorted(set(cells_of))
    rows = rows.withColumn("cell", F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<bigint>"), lambda c: c < at)))
    if parts > 1:
        edges = F.array(*(F.lit(float(x)) for x in [low, *bounds, high]))
        since, until = edges[F.col("cell")], edges[F.col("cell") + 1]
        part = F.floor((at.cast("double") - since) / (until - since + 1) * parts).cast("int")
        rows = rows.withColumn("range", F.col("cell") * parts + F.greatest(F.lit(0), F.least(F.lit(parts - 1), part)))
    else:
        rows = rows.withColumn("range", F.col("cell"))
    shared = sorted({a for a, b in zip(cells_of, cells_of[1:], strict=False) if a == b})
    if shared and not unique:
        # ranges go down in id, then up in key; ids of the cell below the shared one stay in its first part
        by_key = F.floor((F.col("key").cast("double") / 2.0**64 + 0.5) * SHARED_PARTS).cast("int")
        part = F.when(at.isin(shared), F.lit(SHARED_PARTS) - F.least(by_key, F.lit(SHARED_PARTS - 1))).otherwise(0)
        rows = rows.withColumn("range", F.col("range") * (SHARED_PARTS + 1) + part)
    cells = rows.groupBy("range").agg(F.max(F.struct("at", F.bitwise_not("key").alias("key"))).alias("first"))
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("range"))
    # the first row of a range also follows the last row of the range before it in descending order, round to the first
    to = F.coalesce(F.lag("range").over(down), F.min("range").over(Window.partitionBy(F.lit(0))))
    cells = cells.select("range", F.col("first.at").alias("first_at"), F.bitwise_not("first.key").alias("first_key"), to.alias("to"))
    own = F.struct(F.col("range"), F.lit(False).alias("halo"))
    also = F.struct(F.col("to").alias("range"), F.lit(True).alias("halo"))
    leads = (at == F.col("first_at")) & (F.col("key") == F.col("first_key"))
    rows = rows.join(F.broadcast(cells), "range").withColumn("in", F.explode(F.when(leads, F.array(own, also)).otherwise(F.array(own))))
    return rows.select(*docs.columns, "at", "key", "in.range", "in.halo")


def edited_pairs(docs: DataFrame, size: int = SIZE, width: int = WIDTH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, and the sketches sketch, edited_sketch and next_sketch.

    edited: the last third of the code points replaced by as many first ones (or all) of the next document, in descending
    doc_id, the first following the last. Null is the empty text. A lone document follows itself. Repeated rows follow each
    other. An empty table gives no rows.
    """
    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    order = Window.partitionBy("range").orderBy("halo", F.desc("at"), "key")
    rows = rows.withColumn("next", F.coalesce(F.lead("text").over(order), F.lit("")))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next", F.lit(1), cut))).drop("next")
    rows = rows.withColumns({"sketch": sketch(F.col("text"), size, width), "edited_sketch": sketch(F.col("edited"), size, width)})
    rows = rows.withColumns({"n_chars": n, "edited_sha256": F.sha2("edited", 256)}).drop("edited", "text")
    return rows.withColumn("next_sketch", F.lead("sketch").over(order)).where(~F.col("halo"))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def op9_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    found = edited_pairs(table(spark, sf_dir, "documents", "doc_id", "text"))
    near = [resemblance(F.col("sketch"), F.col(c)).alias(n) for c, n in (("edited_sketch", "near_edited"), ("next_sketch", "near_next"))]
    return found.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"), *near)
