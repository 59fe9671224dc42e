"""Collocations by level-wise passes: a phrase is counted only where both phrases that it overlaps in are frequent.

The pass of level k counts phrases of k words. Tasks cut their texts into blocks, number the block's words, and add up equal
phrases there, so each phrase leaves a block once; Spark adds up the blocks. What is frequent goes to the next pass as a bitmap of
hashes. Its size is bounded, and a phrase whose bit is set by another one is just counted in vain: the threshold drops it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import mixed, table, texts
from gridloom.llm.substrings import Names, bits_for
from gridloom.sources.tables import materialize

UNKNOWN = "und"
LONGEST, LEAST, TOP = 4, 30, 2000
#: Bytes of a block.
BLOCK = 4 << 20
_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Lower-case ASCII letters, one separator of pieces and one of words.
_PLAIN = bytes(ord("\n") if b in _ENDS else ord(" ") if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def gram_hashes(words: np.ndarray, size: int, seed: np.uint64) -> np.ndarray:
    """Hashes of all runs of ``size`` words, given the words' hashes."""
    out = np.full(max(len(words) - size + 1, 0), seed)
    for j in range(size):
        out = mixed(out + words[j : j + len(out)])
    return out


def seed_of(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang, 1))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def blocks(bodies: Iterator[bytes], size: int, room: int = BLOCK) -> Iterator[bytes]:
    """Texts with ``\\n`` between pieces and blanks between words, in blocks of about ``room`` bytes. A long text is cut before a
    separator, and goes on after the last ``size - 1`` words of the piece that the cut parts: all that a phrase needs."""
    held: list[bytes] = []
    n = 0
    for body in bodies:
        body = body.translate(_PLAIN)
        since, carried = 0, b""
        while len(body) - since > room:
            cut = max(body.rfind(b" ", since + 1, since + room), body.rfind(b"\n", since + 1, since + room))
            if cut < 0:  # a word that long stays whole
                cut = min((i for i in (body.find(b" ", since + 1), body.find(b"\n", since + 1)) if i > 0), default=len(body))
            part = carried + body[since:cut]
            yield part
            last = part[part.rfind(b"\n") + 1 :].rsplit(None, size - 1)
            carried, since = b" ".join(last[1:] if len(last) == size else last) + b" ", cut
        held.append(carried + body[since:])
        n += len(body) - since
        if n >= room:
            yield b"\n".join(held)
            held, n = [], 0
    if held:
        yield b"\n".join(held)


def counted(block: bytes, size: int, seed: np.uint64, frequent: Names | None) -> tuple[list[bytes | None], list[int]]:
    """Phrases of ``size`` words of a block, each once, and their counts. One word: all words, and None with their number. Else
    those whose first and last ``size - 1`` words are among the ``frequent`` ones."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    blank, end = numbers[b""], numbers[b"\n"]
    tokens = block.replace(b"\n", b" \n ").split(b" ")
    ids = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
    ids, words = ids[ids != blank], list(numbers)
    if frequent is None:
        n = np.bincount(ids, minlength=len(words))[2:]
        return [None, *words[2:]], [int(n.sum()), *n.tolist()]
    ends = np.concatenate([[0], np.cumsum(ids == end)])
    shorter = gram_hashes(_hashes(words)[ids], size - 1, seed)
    good = (ends[size - 1 :] == ends[: len(shorter)]) & frequent.has(shorter) if len(shorter) else np.zeros(0, bool)
    starts = np.flatnonzero(good[:-1] & good[1:] & (ends[size:] == ends[: max(len(ids) - size + 1, 0)])) if len(good) > 1 else np.empty(0, np.int64)
    code = ids[starts]
    for j in range(1, size):  # equal phrases get equal numbers, one word at a time
        code = np.unique(code, return_inverse=True)[1] * len(words) + ids[starts + j]
    _, at, n = np.unique(code, return_index=True, return_counts=True)
    of = ids[starts[at][:, None] + np.arange(size)].tolist()
    return [b" ".join([words[i] for i in x]) for x in of], n.tolist()


def _strings(values: list[bytes | None]) -> pa.Array:
    x = pa.array(values, pa.binary())
    return pa.Array.from_buffers(pa.string(), len(x), x.buffers(), x.null_count)


def level(texts_: DataFrame, size: int, least: int, frequent: Names | None, room: int = BLOCK) -> DataFrame:
    """(lang, phrase, n) of the phrases of ``size`` words that ``texts_(lang, text)`` have ``least`` times or more; for one word also
    a row without a phrase, with the number of all words of the lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[bytes]] = defaultdict(list)
            for lang, body in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
                by[lang].append(body or b"")
            for lang, bodies in by.items():
                for block in blocks(iter(bodies), size, room):
                    phrase, n = counted(block, size, seed_of(lang), frequent)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), _strings(phrase), pa.array(n, pa.int64())], ["lang", "phrase", "n"])

    seen = texts_.select("lang", "text").mapInArrow(run, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return materialize(seen.where((F.col("n") >= least) | F.col("phrase").isNull()))


def _names(grams: DataFrame, size: int) -> Names:
    """The bitmap of the hashes of ``grams(lang, phrase)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, bodies = batch.column("lang").to_pylist(), texts(batch, "phrase")
            seeds = np.fromiter(map(seed_of, langs), np.uint64, len(langs))
            words = _hashes([w for x in bodies for w in x.split(b" ")]).reshape(-1, size)
            for j in range(size):
                seeds = mixed(seeds + words[:, j])
            yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64))], ["name"])

    return Names(grams.select("lang", "phrase").mapInArrow(run, "name bigint"), bits_for(grams.count()))


def levels(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, room: int = BLOCK) -> list[DataFrame]:
    """(lang, phrase, n) of the frequent phrases of one word, two, and so on; the first also has each lang's number of words."""
    source = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    out = [level(source, 1, least, None, room)]
    for size in range(2, longest + 1):
        below = out[-1].where("phrase is not null")
        out.append(level(source, size, least, _names(below, size - 1), room))
    return out


def scored(tables: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all phrases of two words or more: each with the cut that scores least, the first of equal
    ones. Both sides of a cut are at least as frequent as the whole, so the tables of the levels have them."""
    parts, every = None, None
    for size, grams in enumerate(tables, 1):
        grams = grams.where("phrase is not null")
        every = grams if every is None else every.unionByName(grams)
        for k in range(1, size):
            left = F.substring_index("phrase", " ", k)
            cut = grams.select("lang", "phrase", F.col("n").alias("a"), F.lit(k).alias("k"), left.alias("left"), F.substring(F.col("phrase"), F.length(left) + 2, F.length("phrase")).alias("right"))
            parts = cut if parts is None else parts.unionByName(cut)
    sides = [every.select("lang", F.col("phrase").alias(name), F.col("n").alias(name[0])) for name in ("left", "right")]
    met = parts.join(sides[0], ["lang", "left"]).join(sides[1], ["lang", "right"])
    score = F.expr("CAST(CAST(a AS DECIMAL(38, 0)) * 2000000 div (CAST(l AS DECIMAL(38, 0)) + r) AS BIGINT)")
    best = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    return met.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), best.alias("x")).select("lang", "phrase", "a", "x.*")


def nested(tables: list[DataFrame]) -> DataFrame:
    """(lang, phrase, within): how often the most frequent longer phrase comes that holds ``phrase``."""
    words, inside = F.split("phrase", " ", -1), None
    for size, grams in enumerate(tables[2:], 3):
        runs = F.array(*(F.array_join(F.slice(words, i + 1, k), " ") for k in range(2, size) for i in range(size - k + 1)))
        rows = grams.where("phrase is not null").select("lang", F.explode(runs).alias("phrase"), F.col("n").alias("within"))
        inside = rows if inside is None else inside.unionByName(rows)
    return inside.groupBy("lang", "phrase").agg(F.max("within").alias("within"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, share: int = 80, room: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the ``top`` phrases of 2 to ``longest`` words of each lang, by score descending, a
    descending, and the bytes of the phrase.

    ``docs(text, lang)``; a null lang is ``und``, a null text has no words. A phrase goes whose words lie in a longer one that comes
    ``share`` per cent as often or more. Repeated rows count each; rows have no ids here. An empty table, or one without frequent
    phrases, gives no rows.
    """
    tables = levels(docs, longest, least, room)
    found = scored(tables)
    if longest > 2:
        found = found.join(nested(tables), ["lang", "phrase"], "left")
        found = found.where(F.expr(f"within IS NULL OR CAST(within AS DECIMAL(38, 0)) * 100 < CAST(a AS DECIMAL(38, 0)) * {share}")).drop("within")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = tables[0].where("phrase is null").select("lang", "n")
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of each lang."""
    return collocations(table(spark, sf_dir, "documents", "text", "lang"))


ORACLE_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece FROM documents
), split AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM pieces
), grams AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(list_slice(ws, i, i + k - 1), ' '))) AS phrase FROM split, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k
), f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY 1, 2, 3
), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1
), cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 30
), cuts AS (SELECT *, array_to_string(list_slice(ws, 1, c), ' ') AS x, array_to_string(list_slice(ws, c + 1, k), ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS c FROM cand)
), scores AS (SELECT u.lang, u.phrase, u.a, p.f AS l, q.f AS r, u.c, 2000000 * u.a // (p.f + q.f) AS score FROM cuts u JOIN f p ON p.lang = u.lang AND p.phrase = u.x JOIN f q ON q.lang = u.lang AND q.phrase = u.y
), least AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), inside AS (SELECT lang, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS phrase, max(a) AS w FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand)) GROUP BY 1, 2
), kept AS (SELECT l.* FROM least l LEFT JOIN inside i ON i.lang = l.lang AND i.phrase = l.phrase WHERE w IS NULL OR 100 * w < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""
