"""Best-fit packing of token pieces into sequences: few-piece patterns by non-negative least squares, then best fit."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.llm.common import table, texts
from gridloom.sources.tables import materialize

#: Piece lengths are ranked within (length, bucket), so that a length that most pieces share is no single task.
RANK_BUCKETS = 1024
#: Triples, and fours, of lengths that are kept beside all pairs.
TRIPLES = 20_000
#: The fit ends when no pattern's use changes by more than this share of the most used one, or after so many steps.
CLOSE, STEPS = 1e-6, 2000
#: The fitted counts are tried whole and less a share, which leaves more to best fit; the least number of sequences wins.
SHARES = (1.0, 0.9)


#: Lower-case words that no normalisation changes and no pattern splits: ASCII and Latin-1 letters.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
_MARKS = b".,!#%&*$|?;:"


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Ids(dict):
    """Token ids of white-space delimited words as little-endian bytes. Two generations bound what it holds."""

    def __init__(self, path: str, room: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.room, self.old = Tokenizer.from_file(path), room, {}
        self.model, letters = self.tokenizer.model, _byte_letters()
        self.letters = {chr(b): letters[b] for b in range(256)}
        probe = "größe"
        self.plain = self._by_model(probe) == self._whole(probe)  # else the vocabulary is written in another way
        self.folds = self._whole("Stone RING") == self._whole("stone ring")  # else upper-case letters have ids of their own
        self.splits = all(self._whole("ring" + m) == self._whole("ring") + self._whole(m) for m in (".", "!?", ",;:", "%&"))

    def __missing__(self, word: bytes) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self._encode(word)
        if len(word) <= 64:
            if len(self) >= self.room:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found

    def _whole(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _by_model(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize("".join([self.letters[c] for c in word.encode().decode("latin-1")]))]

    def _encode(self, word: bytes) -> bytes:
        if b"<|" not in word:  # else a control token may stand in it, in just this case
            low = word.lower() if self.folds else word
            if low != word:
                return self[low]
            body = word.rstrip(_MARKS) if self.splits else word
            if body and body != word and body[-1:].isalpha():  # after an ASCII letter, marks are a token run of their own
                return self[body] + self[word[len(body) :]]
        text = word.decode("utf-8", "replace")
        ids = self._by_model(text) if self.plain and _PLAIN.fullmatch(text) else self._whole(text)
        return np.array(ids, "<u4").tobytes()


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): the tokens of each text and ``end_id``, cut into ``size`` at most.

    The tokenizer must treat words between ASCII white space alike wherever they stand. Null is the empty text: one piece
    with just the end id. Repeated rows give their pieces again.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    names = [f.name for f in T._parse_datatype_string(schema).fields] if with_ids else ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = Ids(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(texts(batch)):
                ids = b"".join([known[w] for w in (text or b"").split()]) + last
                for k in range(0, len(ids), 4 * size):
                    part = ids[k : k + 4 * size]
                    row.append(i)
                    piece.append(k // (4 * size))
                    start.append(k // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(part)
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_ids, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def patterns(counts: np.ndarray, size: int) -> np.ndarray:
    """Rows of four lengths (0: none), longest first, that fill a sequence as far as the lengths there are allow: each of two or three
    pieces with the longest one that still fits, and each piece with its longest partner.

    All pairs; of triples and of fours all where lengths are few, else a fixed pseudorandom series. The ``TRIPLES`` of either stay
    that leave least room, of these those that can be used most.
    """
    here, rng = np.flatnonzero(counts), np.random.default_rng(7)
    if not len(here):
        return np.empty((0, 4), np.int64)
    longest = np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))
    share, found = counts[here] / counts[here].sum(), []
    for many in (1, 2, 3):
        if len(here) ** many <= 4 * TRIPLES:
            some = np.stack([x.ravel() for x in np.meshgrid(*[here] * many, indexing="ij")], 1)
        else:
            some = rng.choice(here, (4 * TRIPLES, many), p=share)
        room = size - some.sum(axis=1)
        last = longest[np.clip(room, 0, len(counts) - 1)]
        rows = np.concatenate([some, last[:, None], np.zeros((len(some), 3 - many), np.int64)], 1)[(room > 0) & (last > 0)]
        rows = np.unique(np.sort(rows, axis=1)[:, ::-1], axis=0)
        if many > 1:
            fewest = np.where(rows > 0, counts[rows], np.iinfo(np.int64).max).min(axis=1)
            rows = rows[np.lexsort((rng.random(len(rows)), -fewest, size - rows.sum(axis=1)))][:TRIPLES]
        found.append(rows)
    return np.concatenate(found)


def fit(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weighted non-negative least squares of how often each pattern is used: multiplicative steps, which keep the sign.

    A residual counts by the square of its length, for short pieces still find room and long ones don't.
    """
    present = (rows > 0).astype(float)
    weight = np.square(np.arange(len(counts)) / len(counts))
    use = np.where(rows[:, 2] == 0, np.where(rows > 0, counts[rows], counts.max()).min(axis=1) * 0.9, 1.0)
    up = ((counts * weight)[rows] * present).sum(axis=1)
    for _ in range(STEPS):
        before = use
        made = np.bincount(rows.ravel(), (present * use[:, None]).ravel(), minlength=len(counts)) * weight
        use = use * (up / np.maximum((made[rows] * present).sum(axis=1), 1e-12))
        if np.abs(use - before).max() <= CLOSE * use.max():
            break
    return use


def plan(counts: np.ndarray, size: int) -> np.ndarray:
    """Rows (length, rank from, sequence from, offset): the pieces of a length, by rank, go to consecutive sequences.

    ``counts`` holds how many pieces have each length below ``size``; the plan's size depends on ``size`` alone. Plans by the patterns
    that leave no room, and by all of them where that adds a tenth or more, each used as fitted or less a share, and the one by best
    fit alone: the first with the fewest sequences is given. So it never takes more than best fit.
    """
    every = patterns(counts, size)
    exact = every[every.sum(axis=1) == size]
    plans = []
    for rows in (exact, every) if len(exact) < 0.9 * len(every) else (exact,):
        if len(rows):
            use = fit(rows, counts)
            plans += [fill(counts, size, rows, np.floor(use * share + 1e-6).astype(np.int64)) for share in SHARES]
    plans.append(fill(counts, size, every[:0], np.empty(0, np.int64)))
    return min(plans, key=lambda p: p[1])[0]


def fill(counts: np.ndarray, size: int, rows: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, int]:
    """The plan that uses each of the patterns ``rows`` ``use`` times and packs what is left by best fit, and its sequences."""
    left, used, out, top = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64), [], 0

    def place(length: int, many: int, sequence: int, offset: int) -> None:
        out.append((length, used[length], sequence, offset))
        used[length] += many
        left[length] -= many

    for k in np.argsort(-use, kind="stable"):
        lengths = [int(x) for x in rows[k] if x]
        many = min(int(use[k]), *(int(left[x]) // lengths.count(x) for x in lengths))
        if many > 0:
            offset = 0
            for x in lengths:
                place(x, many, top, offset)
                offset += x
            top += many
    free: dict[int, list[tuple[int, int]]] = {}
    for length in range(size - 1, 0, -1):
        room = length
        while left[length]:
            while room < size and not free.get(room):
                room += 1
            if room == size:
                sequence, many = top, int(left[length])
                # a new sequence takes one piece now; what still fits goes in by best fit
                per = size // length if length <= size // 2 else 1
                if per > 1:
                    many = -(-many // per)
                top += many
            else:
                sequence, most = free[room].pop()
                many = min(most, int(left[length]))
                if many < most:
                    free[room].append((sequence + many, most - many))
            place(length, many, sequence, size - room)
            if room > length:
                free.setdefault(room - length, []).append((sequence, many))
            room = length
    return np.array(out, np.int64).reshape(-1, 4), top


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset; no sequence holds over ``size`` tokens.

    Full pieces are sequences of their own. The rest is packed by a plan made from the counts of at most ``size`` lengths,
    the only thing that comes to the driver. Ties are ranked by doc_id and piece. No pieces: no rows.
    """
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(RANK_BUCKETS)))
    short = pieces.where(F.col("length") < size)
    cells = materialize(short.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    counts = np.zeros(size, np.int64)
    for row in cells.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    placed = plan(counts, size)
    order = np.lexsort((placed[:, 1], placed[:, 0]))
    placed = placed[order]
    keys = (placed[:, 0] << 44) + placed[:, 1]

    before = cells.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = short.withColumn("nth", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("nth") - 1)
    columns = [c for c in pieces.columns if c != "bucket"]
    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in columns) + ", sequence_id bigint, offset bigint"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (batch.column("length").to_numpy() << 44) + rank, side="right") - 1
            found = [placed[at, 2] + rank - placed[at, 1], placed[at, 3]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *map(pa.array, found)], [*columns, "sequence_id", "offset"])

    full = pieces.where(F.col("length") >= size).select(*columns, (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(ranked.select(*columns, "rank").mapInArrow(assign, schema))


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = 2048) -> DataFrame:
    """The pieces of ``docs`` and where they go. Pieces are written once, for tokens are dear.

    Null and empty texts give one piece with the end id. Repeated rows and ids give their pieces again. Other columns of ``docs``
    are not looked at. An empty table gives no rows.
    """
    return pack(materialize(token_pieces(docs, tokenizer_path, size)), size)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
