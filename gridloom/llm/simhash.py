"""SimHash near-duplicates: binary trie self-join of the fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import row_key, table, texts
from gridloom.llm.components import components
from gridloom.sources.tables import materialize

BITS, BLOCK = 64, 16


def simhash(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash over word shingles, repeats included; fewer words are one shingle, none give 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - size + 1)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[i : i + (1 << 15)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and fp, the SimHash of text as a signed long."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", fp bigint"
    names = [*keep, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((simhash(x, width) for x in texts(batch)), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found)], names)

    return docs.select(*keep, "text").mapInArrow(run, schema)


def trie_roots(group: np.ndarray, value: np.ndarray, budget: int, bits: int, most: int = 1 << 18) -> np.ndarray:
    """For each value the first index that chains of values of its group within ``budget`` differing bits reach.

    ``group`` and then ``value`` ascend, higher bits than the low ``bits`` are equal in a group, and no value repeats in one. A
    trie node is an index range: its values share the bits so far. Node pairs at one depth go down together, a pair of unlike
    children costs a bit, and a pair over the budget is dropped with all below it, as is a pair whose values are all linked
    already. Over ``most`` nodes and pairs at a time are cut in two and go down one after the other: so memory is bounded
    however dense a group is.
    """
    n = len(value)
    root = np.arange(n)
    bounds = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    rank = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)).astype(np.uint64)
    key = (rank << np.uint64(bits)) | (value & np.uint64((1 << bits) - 1))  # ascends over all groups
    lo, hi = bounds[:-1], bounds[1:]
    big = hi - lo > 1
    # nodes to split, and cross pairs: a from, a to, b from, b to, differing bits so far
    stack = [(bits - 1, lo[big], hi[big], np.empty((5, 0), np.int64))]
    while stack:
        bit, lo, hi, cross = stack.pop()
        if len(lo) + cross.shape[1] > most and max(len(lo), cross.shape[1]) > 1:
            i, j = len(lo) // 2, cross.shape[1] // 2
            stack += [(bit, lo[i:], hi[i:], cross[:, j:]), (bit, lo[:i], hi[:i], cross[:, :j])]
            continue
        if cross.shape[1]:
            jumps = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])  # equal over a range: one component
            a0, a1, b0, b1, _ = cross
            done = (jumps[a0] == jumps[a1 - 1]) & (jumps[b0] == jumps[b1 - 1]) & (root[a0] == root[b0])
            cross = cross[:, ~done]
        if bit < 0 or not (len(lo) or cross.shape[1]):
            continue

        def middle(start: np.ndarray, bit: int = bit) -> np.ndarray:
            one = np.uint64(bit)
            return np.searchsorted(key, ((key[start] >> one) | np.uint64(1)) << one)

        mid = middle(lo)
        split = (lo < mid) & (mid < hi)
        new = [np.stack([lo, mid, mid, hi, np.ones_like(lo)])[:, split]]
        lo, hi = np.concatenate([lo, mid]), np.concatenate([np.minimum(mid, hi), hi])
        big = hi - lo > 1
        lo, hi = lo[big], hi[big]
        if cross.shape[1]:
            a0, a1, b0, b1, d = cross
            am, bm = np.clip(middle(a0), a0, a1), np.clip(middle(b0), b0, b1)
            for x0, x1, y0, y1, more in ((a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1)):
                live = (x0 < x1) & (y0 < y1) & (d + more <= budget)
                new.append(np.stack([x0, x1, y0, y1, d + more])[:, live])
        cross = np.concatenate(new, axis=1)
        leaf = (cross[1] - cross[0] == 1) & (cross[3] - cross[2] == 1)
        if leaf.any():
            i, j = cross[0, leaf], cross[2, leaf]
            near = np.bitwise_count(key[i] ^ key[j]) <= budget
            root = spanning(root, i[near], j[near])
            cross = cross[:, ~leaf]
        stack.append((bit - 1, lo, hi, cross))
    return root


def spanning(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root``, the least node that each node is known to reach, after the links i to j have joined what they join."""
    while True:
        a, b = root[i], root[j]
        live = a != b
        if not live.any():
            return root
        i, j, a, b = i[live], j[live], a[live], b[live]
        root = root.copy()
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def rotated(fp: Column, by: int) -> Column:
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def near_links(distinct_fps: DataFrame, budget: int = 3, chunk: int = 1 << 17) -> DataFrame:
    """(a, b) links that connect just those of the distinct ``fp`` that chains of pairs within ``budget`` bits connect.

    With budget 3, two fingerprints agree in one of four blocks of 16 bits. So four tries are built, each with another
    block as its top 16 levels, and their subtrees below those levels are the units of work: within one, no bit is spent yet.
    A unit gives links of a spanning forest, never all its pairs. Fingerprints are neither null nor repeated; none give no links. At most about 2 * ``chunk`` values, or one unit, are held.
    """
    if budget >= BITS // BLOCK:
        raise ValueError("the top levels are shared by all pairs for budgets of at most 3")
    turns = F.explode(F.array(*(F.struct(F.lit(k).alias("turn"), rotated(F.col("fp"), BLOCK * k).alias("value")) for k in range(BITS // BLOCK))))
    units = distinct_fps.select(turns.alias("x")).select(F.col("x.turn").alias("turn"), F.col("x.value").alias("value"))
    units = units.select("value", (F.col("turn") * (1 << BLOCK) + F.shiftrightunsigned("value", BITS - BLOCK)).alias("unit"))
    units = units.repartition(F.col("unit")).sortWithinPartitions("unit")

    def links(unit: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((value, unit))
        unit, value = unit[order], value[order]
        root = trie_roots(unit, value, budget, BITS - BLOCK)
        own = np.flatnonzero(root != np.arange(len(value)))
        by = (unit[own] >> BLOCK).astype(np.uint64) * np.uint64(BLOCK)
        back = [np.where(by == 0, v, (v >> by) | (v << (np.uint64(BITS) - np.maximum(by, np.uint64(1))))).view(np.int64) for v in (value[own], value[root[own]])]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in back], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def all_held() -> tuple[np.ndarray, np.ndarray]:
            return np.concatenate([u for u, _ in held]), np.concatenate([v for _, v in held])

        for batch in batches:
            unit, value = batch.column("unit").to_numpy(), batch.column("value").to_numpy().view(np.uint64)
            # a batch ends what is held up to its last unit, which may go on
            for a in range(0, len(unit), chunk):
                u, v = unit[a : a + chunk], value[a : a + chunk]
                held.append((u, v))
                size += len(u)
                if size >= chunk and held[0][0][0] != u[-1]:
                    units_, values = all_held()
                    cut = np.searchsorted(units_, units_[-1])
                    yield from links(units_[:cut], values[:cut])
                    held, size = [(units_[cut:], values[cut:])], len(units_) - cut
        if held:
            yield from links(*all_held())

    return units.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, fp, component_id, the least doc_id that chains of fingerprints within ``budget`` bits reach, and group, a
    fingerprint that stands for all of the chain.

    Null and empty texts have fingerprint 0 and link like others. Equal rows share a component. A null doc_id is kept and
    never is a component's id, unless no other id is there: then component_id is null. An empty table gives no rows.
    """
    marked = materialize(fingerprints(docs, width, keep))
    own = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(own.select("fp"), budget)).withColumnRenamed("node", "fp")
    linked = own.join(roots, "fp")
    component = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id", "root")
    # written, so that both sides of the last join are plain exchanges: then Spark splits the fingerprint of a large group of copies
    by_fp = materialize(own.join(component, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("group")))
    return marked.join(by_fp, "fp", "left").select(*keep, "fp", "component_id", "group")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 3, budget: int = 3) -> DataFrame:
    """One row of each near-duplicate group of ``docs``: that with the least doc_id, of equal ids that with the least row key.

    Groups are told apart by their fingerprints, so rows of one doc_id with other texts are of several. Rows with a null doc_id stay
    only where their whole group has none. Of rows equal in id and text one stays; where their other columns differ, which one is
    arbitrary. An empty table gives no rows.
    """
    keyed = docs.select(F.struct("*").alias("__row"), "doc_id", "text", row_key(F.col("text")).alias("__key"))
    found = near_duplicates(keyed.select("doc_id", "text", "__key"), width, budget, ("doc_id", "__key"))
    best = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__key")).alias("best"))
    best = best.select("best.doc_id", "best.__key").distinct()
    kept = keyed.alias("d").join(best.alias("b"), F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.__key") == F.col("b.__key")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__key"]).select("__row.*")
