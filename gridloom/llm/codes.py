"""Product quantisation in whole numbers: vectors are cut into parts, each part becomes the index of its codebook's nearest entry.

Each round the driver builds one kd-tree a codebook, whose size the codebook bounds, and broadcasts all. Tasks search whole blocks
of parts at once: each goes to its home leaf first, then to all nodes that are as near as the best so far or nearer; nodes at an
equal bound are visited, so that of equally near entries the one with the lowest index wins. Tasks add up counts and components
by entry, Spark adds up these sums, and only one row an entry comes back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import few, table
from gridloom.sources.tables import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries of a leaf, components of a block that is searched at once, and labels that are broadcast at most.
LEAF, BLOCK, LABELS = 8, 1 << 20, 100_000
#: Whole-number components must stay below this, so that squares and sums are exact in 64 bits.
LARGEST = 1 << 27
_FAR = np.iinfo(np.int64).max


class Tree:
    """A kd-tree over ``entries`` (rows of whole numbers). Nodes have the box of their entries; leaves list theirs in order."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.kids: list[tuple[int, int] | None] = []
        self.leaf: list[np.ndarray] = []
        if len(entries):
            self._grow(np.arange(len(entries)))

    def _grow(self, held: np.ndarray) -> int:
        node, body = len(self.kids), self.entries[held]
        self.low.append(body.min(axis=0))
        self.high.append(body.max(axis=0))
        self.kids.append(None)
        self.leaf.append(np.sort(held))
        if len(held) > LEAF:
            axis = int((self.high[node] - self.low[node]).argmax())
            held = held[np.argsort(body[:, axis], kind="stable")]
            half = len(held) // 2
            self.kids[node] = self._grow(held[:half]), self._grow(held[half:])
        return node

    def bound(self, node: int, points: np.ndarray) -> np.ndarray:
        """The squared distance of each point from the node's box."""
        out = np.maximum(np.maximum(self.low[node] - points, points - self.high[node]), 0)
        return np.einsum("ij,ij->i", out, out)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry of each point, the lowest of equally near ones, and the squared distance."""
        best, index = np.full(len(points), _FAR), np.full(len(points), len(self.entries))
        home = np.zeros(len(points), np.int64)

        def scan(leaf: int, of: np.ndarray) -> None:
            apart = points[of, None, :] - self.entries[self.leaf[leaf]][None]
            far = np.einsum("ijk,ijk->ij", apart, apart)
            at = far.argmin(axis=1)
            near, entry = far[np.arange(len(of)), at], self.leaf[leaf][at]
            better = (near < best[of]) | ((near == best[of]) & (entry < index[of]))
            best[of[better]], index[of[better]] = near[better], entry[better]

        def go_home(node: int, of: np.ndarray) -> None:
            if not len(of):
                return
            if (kids := self.kids[node]) is None:
                home[of] = node
                scan(node, of)
                return
            left = self.bound(kids[0], points[of]) <= self.bound(kids[1], points[of])
            go_home(kids[0], of[left])
            go_home(kids[1], of[~left])

        def search(node: int, of: np.ndarray) -> None:
            of = of[self.bound(node, points[of]) <= best[of]]
            if not len(of):
                return
            if (kids := self.kids[node]) is None:
                scan(node, of[home[of] != node])
                return
            search(kids[0], of)
            search(kids[1], of)

        everyone = np.arange(len(points))
        go_home(0, everyone)
        search(0, everyone)
        return index, best


def whole(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of ``batch`` are kept, those with ``width`` finite components, and these as whole numbers, a row each."""
    vectors = batch.column("embedding")
    size = vectors.value_lengths().fill_null(0).to_numpy()
    flat = vectors.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    begin = np.cumsum(size) - size
    rows = np.flatnonzero(size == width)
    body = values[begin[rows][:, None] + np.arange(width)] if len(rows) else np.empty((0, width))
    fine = np.isfinite(body).all(axis=1)
    body = np.floor(body[fine] * SCALE)
    if len(body) and np.abs(body).max() >= LARGEST:
        raise ValueError(f"components must be below {LARGEST // SCALE} in magnitude")
    return rows[fine], body.astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    step = max(1, BLOCK // width)
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            rows, body = whole(part, width)
            if len(rows):
                yield part, rows, body


def first_vectors(vectors: DataFrame, entries: int) -> np.ndarray:
    """The kept vectors with the least ids as rows of whole numbers: nulls last, equal ids by their components."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % PARTS == 0) & fine)
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    widest = kept.orderBy(*order).select(F.size("embedding").alias("n")).head()
    if widest is None:
        return np.empty((0, 0), np.int64)
    rows = kept.where(F.size(x) == widest.n).orderBy(*order).limit(entries).select(x.cast("array<double>").alias("embedding")).collect()
    return np.floor(np.array([r.embedding for r in rows]) * SCALE).astype(np.int64)


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Entries by part, entry and position, after ``rounds`` of assigning all parts and replacing each entry by its parts' mean,
    rounded down; an entry without parts stays."""
    first = first_vectors(vectors, entries)
    if not len(first):
        return np.empty((parts, 0, 0), np.int64)
    books = first.reshape(len(first), parts, -1).transpose(1, 0, 2)  # part, entry, position
    width, each = first.shape[1], first.shape[1] // parts
    for _ in range(rounds):
        trees = vectors.sparkSession.sparkContext.broadcast([Tree(book) for book in books])  # parts * entries rows

        def add(batches: Iterator[pa.RecordBatch], trees=trees) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            count, total = np.zeros((parts, len(first)), np.int64), np.zeros((parts, len(first), each), np.int64)
            for _, _, body in _blocks(batches, width):
                for p, tree in enumerate(trees.value):
                    points = body[:, p * each : (p + 1) * each]
                    entry, _ = tree.nearest(points)
                    count[p] += np.bincount(entry, minlength=len(first))
                    np.add.at(total[p], entry, points)
            part, entry = np.nonzero(count)
            sums = pa.array(list(total[part, entry]), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), sums], ["part", "entry", "n", "sums"])

        added = vectors.select("embedding").mapInArrow(add, "part int, entry int, n bigint, sums array<bigint>")
        sums = F.array(*(F.sum(F.col("sums")[i]) for i in range(each)))
        books = books.copy()
        for r in added.groupBy("part", "entry").agg(F.sum("n").alias("n"), sums.alias("sums")).collect():
            books[r.part, r.entry] = np.array(r.sums) // r.n
        trees.unpersist()
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def assigned(vectors: DataFrame, books: np.ndarray, keep: tuple[str, ...] = ("vec_id", "label")) -> DataFrame:
    """``keep`` columns of the kept vectors, with code (two hex digits a part) and error (squared distances summed over parts)."""
    schema = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in keep) + ", code string, error bigint"
    parts, _, each = books.shape
    trees = vectors.sparkSession.sparkContext.broadcast([Tree(book) for book in books] if books.size else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not trees.value:
            return
        for part, rows, body in _blocks(batches, parts * each):
            codes, error = np.empty((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
            for p, tree in enumerate(trees.value):
                codes[:, p], far = tree.nearest(body[:, p * each : (p + 1) * each])
                error += far
            text = codes.tobytes().hex()
            names = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(rows)) for c in keep), pa.array(names, pa.string()), pa.array(error)], [*keep, "code", "error"])

    return vectors.select(*keep, "embedding").mapInArrow(run, schema)


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of each kept row of ``vectors(vec_id, embedding, label)``.

    Rows go whose vector is null or empty, holds null or non-finite components, or has another length than the kept vector with
    the least id; that length must be a multiple of ``parts``, of at most 256 ``entries`` each. Repeated rows are coded each; null
    ids come last among the first entries; null labels are one label. Fewer kept rows than ``entries`` make smaller codebooks.
    Components of 524,288 or more in magnitude are refused. An empty table gives no rows.
    """
    books = codebooks(vectors, parts, entries, rounds)
    coded = materialize(assigned(vectors, books))
    errors = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    if few(errors, LABELS):
        errors = F.broadcast(errors)  # else shuffled, where AQE splits a label that most rows share
    met = coded.join(errors, F.col("label").eqNullSafe(F.col("of"))).drop("of")
    return met.withColumn("codebooks_sha256", F.lit(digest(books)))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector."""
    return compressed(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")).drop("label")


ORACLE_SQL = """
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 256) AS BIGINT)) AS v, len(embedding) // 16 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), parts AS (SELECT r, p, list_slice(v, p * w + 1, p * w + w) AS v, w FROM (SELECT *, unnest(range(16)) AS p FROM kept)
), c0 AS (SELECT p, nth - 1 AS e, v AS c FROM parts JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, v) AS nth FROM kept) USING (r) WHERE nth <= 64
), a0 AS (SELECT r, p, arg_min(e, (d, e)) AS e FROM (SELECT r, p, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts JOIN c0 USING (p)) GROUP BY 1, 2
), s0 AS (SELECT p, e, list(CAST(floor(m) AS BIGINT) ORDER BY i) AS c FROM (SELECT p, e, i, (sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM (SELECT p, e, v, unnest(range(1, w + 1)) AS i FROM parts JOIN a0 USING (r, p)) GROUP BY 1, 2, 3) GROUP BY 1, 2
), c1 AS (SELECT p, e, coalesce(s0.c, c0.c) AS c FROM c0 LEFT JOIN s0 USING (p, e)
), a1 AS (SELECT r, p, arg_min(e, (d, e)) AS e FROM (SELECT r, p, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts JOIN c1 USING (p)) GROUP BY 1, 2
), s1 AS (SELECT p, e, list(CAST(floor(m) AS BIGINT) ORDER BY i) AS c FROM (SELECT p, e, i, (sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM (SELECT p, e, v, unnest(range(1, w + 1)) AS i FROM parts JOIN a1 USING (r, p)) GROUP BY 1, 2, 3) GROUP BY 1, 2
), c2 AS (SELECT p, e, coalesce(s1.c, c1.c) AS c FROM c1 LEFT JOIN s1 USING (p, e)
), a2 AS (SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT r, p, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts JOIN c2 USING (p)) GROUP BY 1, 2
), coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY 1
), sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), sha
"""
