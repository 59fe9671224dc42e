"""Exact substring dedup by recompression.

Each text is a string of word symbols. A round names maximal runs of one symbol, or pairs: a hash bit makes each symbol a
left or a right one, and a left one followed by a right one becomes a new symbol. Names are hashes of what they stand for, so
equal substrings get equal names inside, in all partitions, without a dictionary. Every symbol also carries the range of
words that decided it. A window of words chooses as its anchor the first symbol of the highest level that its own words
decide, so equal windows choose equal anchors.

First Spark counts the anchors of all texts: a repeat between documents is revealed by an anchor that several have. Then only
windows with such an anchor meet, and the symbols that they consist of verify them: the sequence of the symbols of a middle level
that a window's own words decide, and of the words before and after these, hashed beside the anchor's name, 128 bits together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import MIX1, MIX2, mixed, pieces, row_key, table, texts, word_hashes
from gridloom.sources.tables import materialize

#: Rounds of naming. A symbol of level r covers about (4/3)**r words.
ROUNDS = 8
#: Rounds after which runs are named.
RUN_ROUNDS = (0, 4)
#: The level whose symbols verify windows.
VERIFY = 4
#: An anchor that so many batches of texts have is hot: its windows are spread by their own hashes.
HOT = 64
#: Sets of names are bitmaps of 16 bits a name, and of at least and at most so many bits (powers of 2; 128 MB). A name that shares
#: its bit with another is taken for one of the set, which costs time and changes nothing.
LEAST_BITS, MOST_BITS = 20, 30
_LAST = np.int64(np.iinfo(np.int64).max)
_P = np.uint64(0xD1342543DE82EF95)
_P_BACK = np.uint64(pow(int(_P), -1, 1 << 64))


class Level:
    """Symbols in order: name, the words [since, until) that decided it, its first word, and whether it is a separator of texts."""

    def __init__(self, name: np.ndarray, since: np.ndarray, until: np.ndarray, begin: np.ndarray, sep: np.ndarray) -> None:
        self.name, self.since, self.until, self.begin, self.sep = name, since, until, begin, sep

    def runs(self, salt: int) -> Level:
        """Name maximal runs. A run, of one symbol too, is decided by its neighbours as well."""
        inner = ~self.sep
        head = np.flatnonzero(np.concatenate([[True], (self.name[1:] != self.name[:-1]) | ~(inner[1:] & inner[:-1])]))
        last = np.append(head[1:], len(self.name)) - 1
        length = (last - head + 1).astype(np.uint64)
        name, sep = self.name[head], self.sep[head]
        name = np.where(length > 1, mixed(name + length * MIX1 + np.uint64(salt)), name)
        since = np.where(sep, self.since[head], self.since[np.maximum(head - 1, 0)])
        until = np.where(sep, self.until[last], self.until[np.minimum(last + 1, len(self.name) - 1)])
        return Level(name, since, until, self.begin[head], sep)

    def pairs(self, salt: int) -> Level:
        """Name pairs of a left and a right symbol. One left alone is decided by the neighbour that it might have joined."""
        right = (mixed(self.name + np.uint64(salt)) & np.uint64(1)).astype(bool)
        first = ~right & ~self.sep
        first[:-1] &= right[1:] & ~self.sep[1:]
        first[-1] = False
        second = np.concatenate([[False], first[:-1]])
        after = np.minimum(np.arange(len(right)) + 1, len(right) - 1)
        before = np.maximum(np.arange(len(right)) - 1, 0)
        name = np.where(first, mixed(mixed(self.name) + self.name[after] * MIX1 + np.uint64(salt)), self.name)
        alone = ~first & ~self.sep
        since = np.where(alone & right, self.since[before], self.since)
        until = np.where(first | (alone & ~right), self.until[after], self.until)
        stay = ~second
        return Level(name[stay], since[stay], until[stay], self.begin[stay], self.sep[stay])


def levels(words: np.ndarray, sep: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    at = np.arange(len(words))
    out = [Level(words, at, at + 1, at, sep)]
    level = out[0]
    for r in range(rounds):
        if r in RUN_ROUNDS:
            level = level.runs(2 * r + 1)
        level = level.pairs(2 * r + 2)
        out.append(level)
    return out


def anchors(found: list[Level], starts: np.ndarray, window: int) -> np.ndarray:
    """The anchor's name for each window that starts at ``starts``."""
    name = np.zeros(len(starts), np.uint64)
    open_ = np.arange(len(starts))
    for depth in [*range(len(found) - 1, 0, -2), 0]:
        level = found[depth]
        p = starts[open_]
        i = np.minimum(np.searchsorted(level.since, p), len(level.since) - 1)
        fits = (level.since[i] >= p) & (level.until[i] <= p + window)
        name[open_[fits]] = mixed(level.name[i[fits]] + MIX1 ^ np.uint64(depth))
        open_ = open_[~fits]
        if not len(open_):
            break
    return name


class Sums:
    """Hashes of any stretches of a sequence: differences of one polynomial's prefix sums."""

    def __init__(self, values: np.ndarray) -> None:
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(values), _P)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[:-1])])
        self.back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(values), _P_BACK)]))

    def of(self, since: np.ndarray, until: np.ndarray) -> np.ndarray:
        return mixed((self.sums[until] - self.sums[since]) * self.back[since] + (until - since).astype(np.uint64))


def window_hashes(words: np.ndarray, level: Level, starts: np.ndarray, window: int) -> np.ndarray:
    """64-bit hashes of what windows consist of: the words before the first symbol of ``level`` that the window decides, these symbols,
    and the words after the last. Equal windows decide the same symbols, so their hashes are equal."""
    ends = starts + window
    first = np.searchsorted(level.since, starts)
    last = np.searchsorted(level.until, ends, side="right")  # one behind the last
    last = np.maximum(last, first)
    after = np.append(level.begin, len(words))
    inner = last > first
    low, high = np.where(inner, after[first], ends), np.where(inner, after[last], ends)
    of_words, of_symbols = Sums(words), Sums(level.name)
    both = mixed(of_words.of(starts, low) + of_symbols.of(first, last) * MIX1)
    return mixed(both + of_words.of(high, ends) * MIX2)


def _stretches(ok: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of maximal stretches with ``ok`` in which the keys stay equal."""
    here = np.flatnonzero(ok)
    if not len(here):
        return here, here
    cut = np.diff(here) != 1
    for key in keys:
        cut |= key[here[1:]] != key[here[:-1]]
    return here[np.concatenate([[True], cut])], here[np.concatenate([cut, [True]])]


class Batch:
    """The words of some texts between separators, and their windows: owner is a window's text, starts its first word."""

    def __init__(self, bodies: list[bytes], window: int) -> None:
        hashed = [word_hashes(x, xxhash.xxh3_64_intdigest) for x in bodies]
        n = np.fromiter(map(len, hashed), np.int64, len(hashed))
        one = np.zeros(1, np.uint64)
        self.words = np.concatenate([one, *(part for x in hashed for part in (x, one))])
        self.begin = np.concatenate([[1], 1 + np.cumsum(n + 1)[:-1]])
        sep = np.zeros(len(self.words), bool)
        sep[0] = True
        sep[self.begin + n] = True
        many = np.maximum(n - window + 1, 0)
        self.owner = np.repeat(np.arange(len(n)), many)
        self.starts = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + self.begin[self.owner]
        found = levels(self.words, sep) if len(self.starts) else []
        self.anchor = anchors(found, self.starts, window) if found else one[:0]
        self.middle = found[VERIFY] if found else None


def _batches(batch: pa.RecordBatch, window: int, at_most: int) -> Iterator[tuple[int, int, Batch]]:
    bodies = [x or b"" for x in texts(batch)]
    for i, j in pieces(bodies, at_most):
        of = Batch(bodies[i:j], window)
        if len(of.starts):
            yield i, j, of


def shared_anchors(keyed: DataFrame, window: int, batch_bytes: int) -> DataFrame:
    """(name, hot): the anchors that several documents have. A batch sends each of its anchors once, with whether several of its
    texts have it: so the counts are of batches, and neither documents nor places travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, of in _batches(batch, window, batch_bytes):
                first, _ = _stretches(np.ones(len(of.starts), bool), of.owner, of.anchor)
                name, owner = of.anchor[first], of.owner[first]
                order = np.lexsort((owner, name))
                name, owner = name[order], owner[order]
                head = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
                several = owner[head] != owner[np.append(head[1:], len(name)) - 1]
                yield pa.RecordBatch.from_arrays([pa.array(name[head].view(np.int64)), pa.array(several)], ["name", "several"])

    seen = keyed.select("text").mapInArrow(run, "name bigint, several boolean").groupBy("name").agg(F.count("*").alias("n"), F.max("several").alias("several"))
    return materialize(seen.where("n > 1 or several").select("name", (F.col("n") >= HOT).alias("hot")))


def bit_of(name: Column, bits: int) -> Column:
    return F.pmod(name, F.lit(1 << bits)) + 1


def bitmap_rows(names: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap) of ``names(name)``: at most 2**bits / 32,768 rows of 4 KB."""
    bit = bit_of(F.col("name"), bits)
    return names.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bitmap"))


def bits_for(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))


class Names:
    """A set of names as a bitmap on every executor, of a bounded size."""

    def __init__(self, names: DataFrame, bits: int) -> None:
        held = np.zeros((1 << bits) // 8, np.uint8)
        for row in bitmap_rows(names, bits).toLocalIterator():
            held[(row["bucket"] - 1) * 4096 :][:4096] = np.frombuffer(row["bitmap"], np.uint8)
        self.bits, self.held = bits, names.sparkSession.sparkContext.broadcast(held)

    def has(self, names: np.ndarray) -> np.ndarray:
        bit = names & np.uint64((1 << self.bits) - 1)
        return (self.held.value[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _sent(of: Batch, doc: np.ndarray, key: np.ndarray, window: int, shared: Names, hot: Names) -> dict[str, pa.Array] | None:
    """What these texts send: stretches of windows by name, and stretches already known to repeat (no hashes).

    Of equal windows of these texts only the first document's travels: a passage or copy that many documents share comes
    to the exchange once from each batch. The name is the anchor's, for a hot anchor one of anchor and words.
    """
    met = shared.has(of.anchor)
    here = np.flatnonzero(met)
    if not len(here):
        return None
    hashes, whose = window_hashes(of.words, of.middle, of.starts[here], window), doc[of.owner[here]]
    anchor = of.anchor[here]
    order = np.lexsort((whose, anchor, hashes))
    h, a = hashes[order], anchor[order]
    head = np.concatenate([[True], (h[1:] != h[:-1]) | (a[1:] != a[:-1])])
    least = whose[order][np.flatnonzero(head)][np.cumsum(head) - 1]
    later = np.empty(len(here), bool)
    later[order] = whose[order] > least
    known, sent = np.zeros(len(met), bool), np.zeros(len(met), bool)
    known[here[later]], sent[here[~later]] = True, True
    name, digest = np.zeros(len(met), np.uint64), np.zeros(len(met), np.uint64)
    digest[here] = hashes
    both = mixed(mixed(hashes) + anchor * MIX1)
    name[here] = np.where(hot.has(anchor), both, anchor)
    first, last = _stretches(sent, of.owner, name)
    k0, k1 = _stretches(known, of.owner)
    size = last - first + 1
    body = np.ascontiguousarray(digest[sent]).tobytes()
    offsets = np.concatenate([[0], np.cumsum(size), np.full(len(k0), size.sum())]) * 8
    valid = np.concatenate([np.ones(len(first), bool), np.zeros(len(k0), bool)])
    held = pa.Array.from_buffers(pa.binary(), len(valid), [pa.array(valid).buffers()[1], pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body)])
    begins, ends = np.concatenate([first, k0]), np.concatenate([last, k1])
    text = of.owner[begins]
    since = of.starts[begins] - of.begin[text]
    # what is known needs no meeting: its name is any value, so that it spreads
    names = np.concatenate([name[first], mixed(of.starts[k0].astype(np.uint64) + digest[k0])])
    return {"name": names.view(np.int64), "doc": doc[text], "key": key[text], "since": since.astype(np.int32), "many": (ends - begins + 1).astype(np.int32), "hashes": held}


def _repeats(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by name and doc: the word ranges whose windows an earlier document has too.

    The windows of one name are held until the next; hot anchors' windows have names of their own, so these are few.
    """
    carried = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)  # name, hash and first doc
    for batch in batches:
        if not batch.num_rows:
            continue
        names, doc, key, since, many = (batch.column(c).to_numpy() for c in ("name", "doc", "key", "since", "many"))
        hashes = batch.column("hashes")
        open_ = hashes.is_valid().to_numpy(zero_copy_only=False)
        row = np.repeat(np.flatnonzero(open_), many[open_])
        digest = np.frombuffer(b"".join(x for x in hashes.to_pylist() if x is not None), np.uint64)
        old = len(carried[0])
        n, h, d = (np.concatenate(x) for x in zip(carried, (names[row].view(np.uint64), digest, doc[row]), strict=True))
        order = np.lexsort((d, h, n))
        head = np.ones(len(order), bool)
        head[1:] = (n[order[1:]] != n[order[:-1]]) | (h[order[1:]] != h[order[:-1]])
        firsts = order[np.flatnonzero(head)]
        hit = np.empty(len(order), bool)
        hit[order] = d[order] > d[firsts][np.cumsum(head) - 1] if len(order) else False
        hit = hit[old:]
        stays = firsts[n[firsts] == names[-1:].view(np.uint64)]  # the last name may go on in the next batch
        carried = n[stays], h[stays], d[stays]
        at = np.arange(len(row)) - np.repeat(np.cumsum(many[open_]) - many[open_], many[open_])
        a, b = _stretches(hit, row)
        rows = np.concatenate([row[a], np.flatnonzero(~open_)])
        lo = np.concatenate([since[row[a]] + at[a], since[~open_]])
        hi = np.concatenate([since[row[a]] + at[b], since[~open_] + many[~open_] - 1]) + window
        yield pa.RecordBatch.from_arrays([pa.array(doc[rows]), pa.array(key[rows]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["doc", "key", "lo", "hi"])


def repeated_ranges(keyed: DataFrame, window: int = 50, batch_bytes: int = 8 << 20) -> DataFrame:
    """(doc, key, lo, hi): word ranges of ``keyed(doc, key, text)`` to remove; all windows in them start in an earlier doc."""
    names = shared_anchors(keyed, window, batch_bytes)
    bits = bits_for(names.count())
    shared, hot = Names(names, bits), Names(names.where("hot"), bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["name", "doc", "key", "since", "many", "hashes"]
        for batch in batches:
            doc, key = batch.column("doc").to_numpy(), batch.column("key").to_numpy()
            for i, j, of in _batches(batch, window, batch_bytes):
                if sent := _sent(of, doc[i:j], key[i:j], window, shared, hot):
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in sent.values()], columns)

    sent = keyed.select("doc", "key", "text").mapInArrow(send, "name bigint, doc bigint, key bigint, since int, many int, hashes binary")
    met = sent.repartition(F.col("name")).sortWithinPartitions("name", "doc")
    return met.mapInArrow(lambda batches: _repeats(batches, window), "doc bigint, key bigint, lo int, hi int")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc: doc_id, null last. key: 0, or what tells rows of one doc_id apart where such rows exist."""
    unique = docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    key: Column = F.lit(0).cast("long") if unique else row_key(F.col("text"))
    return docs.withColumns({"doc": F.coalesce(F.col("doc_id"), F.lit(int(_LAST))), "key": key})


def removals(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, text and ranges (array of lo, hi in words) to remove.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller doc_id; windows are
    those of the input. Null doc_ids, and one of 2**63 - 1, come after all others and don't precede each other. Rows of one doc_id don't precede
    each other; equal rows fare alike. Null and empty texts have no words. An empty table gives no rows.
    """
    keyed = _keyed(docs.select("doc_id", "text"))
    found = materialize(repeated_ranges(keyed, window).groupBy("doc", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")))
    # only documents that may lose words go through the join: their bits are set in a bitmap of bounded size
    name = F.xxhash64("doc", "key")
    bits = bits_for(found.count())
    rows = bitmap_rows(found.select(name.alias("name")), bits)
    bit = bit_of(name, bits)
    marked = keyed.withColumn("bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(rows), "bucket", "left")
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (at % 8 + 1).cast("int"))) > 0, F.lit(False))
    marked = marked.select("doc_id", "text", "doc", "key", hit.alias("hit"))
    met = marked.where("hit").join(found, ["doc", "key"], "left").select("doc_id", "text", "ranges")
    none = F.lit(None).cast("array<struct<lo:int,hi:int>>")
    return met.unionByName(marked.where("not hit").select("doc_id", "text", none.alias("ranges")))


def kept_words(text: bytes | None, ranges: pa.Scalar | None) -> tuple[int, list[bytes]]:
    """Number of words and those that stay."""
    words = (text or b"").split()
    if ranges is None:
        return len(words), words
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, ranges[0], 1)
    np.add.at(step, ranges[1], -1)
    gone = np.cumsum(step[:-1]) > 0
    return len(words), [w for w, x in zip(words, gone.tolist(), strict=True) if not x]


def _each(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    ranges = batch.column("ranges")
    flat = ranges.flatten()
    lo, hi = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
    sizes = ranges.value_lengths().fill_null(0).to_numpy()
    end = np.cumsum(sizes)
    for text, a, b in zip(texts(batch), (end - sizes).tolist(), end.tolist(), strict=True):
        yield kept_words(text, (lo[a:b], hi[a:b]) if b > a else None)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) for n, kept in _each(batch)]
            n, gone, sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return removals(table(spark, sf_dir, "documents", "doc_id", "text")).mapInArrow(digest, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), windows AS (
  SELECT doc_id, p, hash(list_slice(words, p, p + 49)) AS h, md5(array_to_string(list_slice(words, p, p + 49), ' ')) AS m
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS p FROM docs)
), firsts AS (
  SELECT h, m, min(doc_id) AS least FROM windows GROUP BY h, m
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS at FROM windows JOIN firsts USING (h, m) WHERE least < doc_id
), kept AS (
  SELECT doc_id, count(w) AS n_kept, coalesce(string_agg(w, ' ' ORDER BY i), '') AS kept FROM (
    SELECT d.doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM docs d
  ) x ANTI JOIN gone g ON x.doc_id = g.doc_id AND x.i = g.at GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
