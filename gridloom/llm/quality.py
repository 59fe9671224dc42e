"""Quality rules: n-gram perplexity under modified Kneser-Ney models, with bands by language, and plain text counts.

The n-grams are of UTF-16 code units of lower-case text, four of which are one 64-bit key, so no two differ in nothing. Spark counts
them over all documents, by language, and smooths the counts. A model of bounded size is turned into arrays sorted by a hash of
language and n-gram; beyond the bound the n-grams of the documents are joined with the smoothed table instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import MIX1, few, mixed, pieces, table, texts, word_hashes
from gridloom.sources.tables import materialize

ORDER, UNIT_BITS = 4, 16
#: A model of at most so many n-grams of the highest order is held in arrays, some 200 MB; a larger one is joined.
MODEL_ROWS = 8_000_000
#: A text is rejected if its log perplexity is further from its language's median than so many times the spread.
WIDTH = 2.5
#: The spread counts as this at least.
LEAST_SPREAD = 0.005
#: Bands are wider for shorter texts, whose means vary more: by the root of one more than so many bytes to the text's.
SHORT = 8000
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
ROOM = 4 << 20
#: Bands and discounts of at most so many languages are broadcast.
BROADCAST_BANDS = 10_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes")
_BLANKS = str.maketrans("\t\n\v\f\r", "     ")


def ngrams(bodies: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Key of the n-gram that ends at each unit, blanks standing before the text, and the number of units of each text."""
    blank = " " * (ORDER - 1)
    lower = [x.lower().translate(_BLANKS) for x in bodies]
    units = [x.encode("utf-16-le", "surrogatepass") for x in lower]
    size = np.fromiter(map(len, units), np.int64, len(units)) // 2
    pad = blank.encode("utf-16-le")
    joined = np.frombuffer(pad + pad.join(units), "<u2").astype(np.uint64)
    key = joined[ORDER - 1 :].copy()
    for back in range(1, ORDER):
        key |= joined[ORDER - 1 - back : len(joined) - back] << np.uint64(UNIT_BITS * back)
    own = np.repeat(np.cumsum(size + ORDER - 1) - size - ORDER + 1, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return key[own], size


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, key, n) over all texts; each task sends each of its n-grams once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            by: dict[str | None, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    by.setdefault(lang, []).append(text)
            for lang, bodies in by.items():
                for i, j in pieces(bodies, ROOM):
                    keys, counts = np.unique(ngrams(bodies[i:j])[0], return_counts=True)
                    if lang in known:
                        keys, at = np.unique(np.concatenate([known[lang][0], keys]), return_inverse=True)
                        counts = np.bincount(at, np.concatenate([known[lang][1], counts])).astype(np.int64)
                    known[lang] = keys, counts
        for lang, (keys, counts) in known.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "key", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _last(key: Column, n: int) -> Column:
    """The last n units of a key."""
    return key if n == ORDER else key.bitwiseAND(F.lit((1 << (UNIT_BITS * n)) - 1))


def _same(a: str, b: str, *columns: str) -> Column:
    on = F.col(f"{a}.lang").eqNullSafe(F.col(f"{b}.lang"))
    for c in columns:
        on = on & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return on


def smoothed(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Interpolated modified Kneser-Ney of ``counts(lang, key, n)``, a model a language. For each order, from 1 up: (lang, key, p)
    and (lang, context, weight), the weight that a context leaves to the next lower order."""
    grams = {ORDER: counts}
    for m in range(ORDER - 1, 0, -1):  # lower orders count the units that precede
        grams[m] = grams[m + 1].select("lang", _last(F.col("key"), m).alias("key")).groupBy("lang", "key").agg(F.count("*").alias("n"))
    out: list[tuple[DataFrame, DataFrame]] = []
    for m in range(1, ORDER + 1):
        rows = grams[m].withColumn("context", _before(F.col("key")))
        ones = rows.groupBy("lang").agg(*(F.greatest(F.count_if(F.col("n") == k), F.lit(1)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        off = [F.least(F.lit(most), F.greatest(F.lit(0.0), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"))).alias(f"d{k}") for k, most in ((1, 0.95), (2, 1.9), (3, 2.85))]
        ones = ones.select("lang", *off)
        ones = F.broadcast(ones) if few(ones, BROADCAST_BANDS) else ones
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.alias("r").join(ones.alias("o"), _same("r", "o")).select("r.lang", "key", "n", "context", cut.alias("cut"))
        contexts = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("all"))
        contexts = materialize(contexts.select("lang", "context", "total", F.greatest(F.col("all") / F.col("total"), F.lit(1e-6)).alias("weight")))
        met = rows.alias("r").join(contexts.alias("c"), _same("r", "c", "context"))
        met = met.select("r.lang", "r.key", ((F.col("n") - F.col("cut")) / F.col("total")).alias("own"), "weight", _last(F.col("r.key"), m - 1).alias("rest") if m > 1 else F.lit(0).alias("rest"))
        if out:
            lower = out[-1][0].select("lang", F.col("key").alias("rest"), F.col("p").alias("lower"))
            met = met.alias("m").join(lower.alias("l"), _same("m", "l", "rest")).select("m.lang", "key", "own", "weight", "lower")
        else:
            met = met.withColumn("lower", F.lit(1.0 / (1 << UNIT_BITS)))
        out.append((materialize(met.select("lang", "key", (F.col("own") + F.col("weight") * F.col("lower")).alias("p"))), contexts.select("lang", "context", "weight")))
    return out


def _before(key: Column) -> Column:
    """All units of a key but the last."""
    return F.shiftrightunsigned(key, UNIT_BITS)


class HashArray:
    """Values by 64-bit hash: sorted hashes, and where in them each run of leading bits begins. As hashes are even, a look-up goes
    to the run and a few places on."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.bits = np.uint64(64 - max(1, int(len(hashes)).bit_length()))
        self.hashes = np.append(hashes[order], np.uint64(2**64 - 1))
        self.values = np.append(values[order], 0).astype(np.float32)
        self.begin = np.searchsorted(self.hashes[:-1], np.arange(1 << int(64 - self.bits), dtype=np.uint64) << self.bits).astype(np.int32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each hash, and whether it is there."""
        at = self.begin[hashes >> self.bits]
        behind = np.flatnonzero(self.hashes[at] < hashes)
        while len(behind):
            at[behind] += 1
            behind = behind[self.hashes[at[behind]] < hashes[behind]]
        return self.values[at], self.hashes[at] == hashes


def lang_hash(lang: str | None) -> int:
    return 1 if lang is None else xxhash.xxh3_64_intdigest(lang.encode(), 7)


def smoothed_arrays(keys: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The same as ``smoothed`` for the counts of one language, in arrays: by order, from 1 up, keys, p, contexts and weights."""
    order = np.argsort(keys)
    grams = [(keys[order], counts[order])]
    for m in range(ORDER - 1, 0, -1):
        grams.append(np.unique(grams[-1][0] & np.uint64((1 << (UNIT_BITS * m)) - 1), return_counts=True))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for m, (keys, counts) in enumerate(reversed(grams), 1):
        ones = [max(int((counts == k).sum()), 1) for k in (1, 2, 3, 4)]
        y = ones[0] / (ones[0] + 2 * ones[1])
        off = np.clip([0.0, *(k - (k + 1) * y * ones[k] / ones[k - 1] for k in (1, 2, 3))], 0, [0, 0.95, 1.9, 2.85])
        cut = off[np.minimum(counts, 3)]
        contexts, at = np.unique(keys >> np.uint64(UNIT_BITS), return_inverse=True)
        total = np.bincount(at, counts, len(contexts))
        weight = np.maximum(np.bincount(at, cut, len(contexts)) / total, 1e-6)
        lower = out[-1][1][np.searchsorted(out[-1][0], keys & np.uint64((1 << (UNIT_BITS * (m - 1))) - 1))] if out else 1.0 / (1 << UNIT_BITS)
        out.append((keys, (counts - cut) / total[at] + weight[at] * lower, contexts, weight))
    return out


class KneserNey:
    """The models of all languages as hash arrays, from ``counts(lang, key, n)`` of a checked size. Two n-grams that share a 64-bit
    hash would share a value."""

    def __init__(self, counts: DataFrame) -> None:
        rows = counts.toArrow()
        keys, n = rows.column("key").to_numpy().view(np.uint64), rows.column("n").to_numpy()
        langs = rows.column("lang").to_pandas().astype(object)
        parts: list[list[list[np.ndarray]]] = [[[], [], [], []] for _ in range(ORDER)]
        for lang, at in langs.groupby(langs, dropna=False, sort=False).indices.items():
            name = np.uint64(lang_hash(lang if isinstance(lang, str) else None))
            for m, (k, p, contexts, weight) in enumerate(smoothed_arrays(keys[at], n[at]), 1):
                for held, x in zip(parts[m - 1], (self._hash(name, k, m), p, self._hash(name, contexts, m), weight), strict=True):
                    held.append(x)
        self.levels = []
        for held in parts if len(keys) else []:
            h, p, c, w = map(np.concatenate, held)
            self.levels.append((HashArray(h, p), HashArray(c, w)))

    @staticmethod
    def _hash(langs: np.ndarray | np.uint64, keys: np.ndarray, m: int) -> np.ndarray:
        return mixed(keys ^ (langs + np.uint64(m)))

    def chance(self, langs: np.ndarray, keys: np.ndarray, m: int = ORDER) -> np.ndarray:
        """Probability of the last unit of each n-gram given those before it, in the language with that hash."""
        if m == 0 or not self.levels:
            return np.full(len(keys), 1 / (1 << UNIT_BITS), np.float32)
        chances, contexts = self.levels[m - 1]
        out, hit = chances.find(self._hash(langs, keys, m))
        miss = np.flatnonzero(~hit)
        if len(miss):
            langs, keys = langs[miss], keys[miss]
            weight, known = contexts.find(self._hash(langs, keys >> np.uint64(UNIT_BITS), m))
            lower = self.chance(langs, keys & np.uint64((1 << (UNIT_BITS * (m - 1))) - 1), m - 1)
            out[miss] = np.where(known, weight, 1) * lower
        return out


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])[ends], prepend=0)


def repeated_words(bodies: list[bytes], width: int = REPEAT_WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and of these the words in windows that the text has twice or more."""
    hashed = [word_hashes(x, xxhash.xxh3_64_intdigest) for x in bodies]
    n = np.fromiter(map(len, hashed), np.int64, len(hashed))
    words = np.concatenate([*hashed, np.zeros(width, np.uint64)])
    begin = np.cumsum(n) - n
    many = np.maximum(n - width + 1, 0)
    owner = np.repeat(np.arange(len(n)), many)
    starts = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + begin[owner]
    key = mixed(owner.astype(np.uint64) + MIX1)
    for k in range(width):
        key = mixed(key * MIX1 + words[starts + k])
    order = np.argsort(key)
    new = np.ones(len(key) + 1, bool)
    new[1:-1] = key[order[1:]] != key[order[:-1]]
    again = np.empty(len(key), bool)
    again[order] = ~(new[:-1] & new[1:])
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, starts[again], 1)
    np.add.at(step, starts[again] + width, -1)
    covered = np.cumsum(step[: int(n.sum())]) > 0
    return n, _sums(covered.astype(np.int64), np.cumsum(n))


def measures(bodies: list[bytes]) -> dict[str, np.ndarray]:
    """The base counts and the number of bytes of each text."""
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    size = np.fromiter(map(len, bodies), np.int64, len(bodies))
    ends = np.cumsum(size)
    blank, symbol = np.zeros(256, bool), np.zeros(256, bool)
    blank[list(b" \t\n\v\f\r")] = True
    symbol[list(SYMBOLS)] = True
    in_word = ~blank[raw] & ((raw & 0xC0) != 0x80)
    n_words, n_repeat = repeated_words(bodies)
    dup_lines = []
    for body in bodies:
        lines = [x for x in body.split(b"\n") if x.strip()] if b"\n" in body else []
        dup_lines.append(len(lines) - len(set(lines)))
    return {"n_words": n_words, "word_chars": _sums(in_word.astype(np.int64), ends), "n_symbols": _sums(symbol[raw].astype(np.int64), ends), "n_dup_lines": np.array(dup_lines, np.int64), "n_repeat_words": n_repeat, "n_bytes": size}


def _schema(docs: DataFrame, keep: tuple[str, ...]) -> str:
    return ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", " + ", ".join(f"{c} bigint" for c in COUNTS) + ", log_perplexity double"


def _measured(batch: pa.RecordBatch, bodies: list[bytes], keep: tuple[str, ...], chance: Callable | None) -> pa.RecordBatch:
    """``keep`` columns of a batch with the measures of its texts; ``chance`` gives the probabilities of n-grams."""
    got, cost = measures(bodies), np.zeros(len(bodies))
    if chance is not None:
        keys, size = ngrams([x or "" for x in batch.column("text").to_pylist()])
        langs = np.repeat(np.fromiter(map(lang_hash, batch.column("lang").to_pylist()), np.uint64, len(bodies)), size)
        cost = _sums(-np.log(chance(langs, keys)).astype(float), np.cumsum(size)) / np.maximum(size, 1)
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(got[c]) for c in COUNTS), pa.array(cost)], [*keep, *COUNTS, "log_perplexity"])


def score(docs: DataFrame, model: KneserNey | None, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """``keep`` columns, lang among them, with the measures of each whole text of ``docs(text, lang, ..)``. log_perplexity is the mean
    of minus the natural logarithm of each unit's probability under the language's model; 0 without a model or units. Null is the empty text.
    Repeated rows are scored alike, and an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a checked size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [x or b"" for x in texts(batch)]
            for i, j in pieces(bodies, ROOM):
                yield _measured(batch.slice(i, j - i), bodies[i:j], keep, None if shared.value is None else shared.value.chance)

    return docs.select(*keep, "text").mapInArrow(run, _schema(docs, keep))


def joined_scores(docs: DataFrame, chances: DataFrame) -> DataFrame:
    """``score`` of ``docs(doc_id, text, lang)`` for a model of any size that has all their n-grams.

    The texts are written with the number of their partition. The distinct n-grams of each partition's texts are joined with
    ``chances(lang, key, p)``, a join that Spark splits where one n-gram is in most of them, and meet the texts again: a task holds
    one partition's texts and n-grams. Texts move once, and the n-grams of a partition but once. A null lang is a language, null texts
    score as empty ones, repeated rows score each, and an empty table gives no rows.
    """
    docs = materialize(docs.select("doc_id", "text", "lang").withColumn("batch", F.spark_partition_id()))

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str | None], np.ndarray] = {}
        for batch in batches:
            by: dict[tuple[int, str | None], list[str]] = {}
            for of, lang, text in zip(*(batch.column(c).to_pylist() for c in ("batch", "lang", "text")), strict=True):
                if text:
                    by.setdefault((of, lang), []).append(text)
            for at, bodies in by.items():
                for i, j in pieces(bodies, ROOM):
                    keys = np.unique(ngrams(bodies[i:j])[0])
                    held[at] = np.union1d(held[at], keys) if at in held else keys
        for (of, lang), keys in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), of, np.int32)), pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64))], ["batch", "lang", "key"])

    held = docs.mapInArrow(keys_of, "batch int, lang string, key bigint").distinct()
    known = held.alias("h").join(chances.alias("c"), _same("h", "c", "key")).select("h.batch", "h.lang", "h.key", "p")

    def run(texts_: pa.Table, costs: pa.Table) -> pa.Table:
        names = np.fromiter(map(lang_hash, costs.column("lang").to_pylist()), np.uint64, len(costs))
        model = HashArray(KneserNey._hash(names, costs.column("key").to_numpy().view(np.uint64), ORDER), costs.column("p").to_numpy())
        out = []
        for batch in texts_.to_batches():
            bodies = [x or b"" for x in texts(batch)]
            for i, j in pieces(bodies, ROOM):
                out.append(_measured(batch.slice(i, j - i), bodies[i:j], ("doc_id", "lang"), lambda langs, keys: model.find(KneserNey._hash(langs, keys, ORDER))[0]))
        return pa.Table.from_batches(out)

    return docs.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(run, _schema(docs, ("doc_id", "lang")))


def scored_by_own_model(docs: DataFrame, most: int = MODEL_ROWS) -> DataFrame:
    """``docs(doc_id, text, lang)`` scored under the models of their own languages' texts: in arrays where the model has at most
    ``most`` n-grams, else by a join."""
    counts = materialize(count_ngrams(docs))
    return score(docs, KneserNey(counts)) if few(counts, most) else joined_scores(docs, smoothed(counts)[-1][0])


def judge(scored: DataFrame) -> DataFrame:
    """``scored`` with base_failed, kept, and the bounds lower and upper.

    base_failed: fewer than 10 words, or over 20 % of them in repeated windows of 5. Else the text is kept if its log
    perplexity lies in its language's band, median +- WIDTH * spread, the spread being half the range from the lower to the
    upper quartile. Short texts get wider bands. Documents without a language are a language of their own. An empty table gives
    no rows.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    marked = scored.withColumn("base_failed", failed)
    quartiles = F.percentile_approx(F.when(~F.col("base_failed"), F.col("log_perplexity")), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(10_000))
    bands = marked.groupBy("lang").agg(quartiles.alias("q"))
    bands = bands.select("lang", F.col("q")[1].alias("middle"), F.greatest((F.col("q")[2] - F.col("q")[0]) / 2, F.lit(LEAST_SPREAD)).alias("spread"))
    bands = materialize(bands)
    bands = F.broadcast(bands) if few(bands, BROADCAST_BANDS) else bands  # else a language with a third of all rows were one task
    width = WIDTH * F.col("spread") * F.sqrt(1 + F.lit(float(SHORT)) / F.greatest("n_bytes", F.lit(1)))
    joined = marked.alias("m").join(bands.alias("b"), _same("m", "b"), "left").select("m.*", "middle", "spread")
    inside = F.coalesce(F.abs(F.col("log_perplexity") - F.col("middle")) <= width, F.lit(True))
    return joined.withColumns({"lower": F.col("middle") - width, "upper": F.col("middle") + width, "kept": ~F.col("base_failed") & inside}).drop("middle", "spread")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept; then log_perplexity."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = judge(materialize(scored_by_own_model(docs)))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")
