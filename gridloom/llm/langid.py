"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language gives the longest match of a text at any place. A whole text is parsed greedily
into longest matches; the language that needs the fewest phrases a symbol wins. The automata are packed tables, and many
stretches of texts go through one at once: the step over a symbol is one lookup for all of them. Stretches of one text start
where the one before ended, so the count is that of the text parsed in one go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import pieces, table, texts
from gridloom.sources.tables import materialize

UNKNOWN = "und"
#: Bound of the labelled sample: at most so many whole texts of each language, of at most so many characters together.
SAMPLE_TEXTS, SAMPLE_CHARS = 48, 40_000
#: Texts of so many characters at most are sampled, if a language has any.
SHORT_CHARS = 4096
#: Languages whose tables, about a megabyte each, are in a worker at once. More are taken in groups of so many.
GROUP = 200
#: Bytes of texts that are parsed at once. A longer text is parsed block by block, each from where the one before ended.
BLOCK = 2 << 20
#: Symbols of a stretch, and after how many of them two parses are compared.
SEGMENT, MEET = 256, 32
_BLANK, NONE = 0, 1 << 62


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton, state 0 being the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


class Alphabet:
    """Classes of the UTF-8 bytes of lower-case text: blank for ASCII characters that are no letters, and one for each
    byte that some labelled text has. All other bytes share the last class, which no automaton knows."""

    def __init__(self, samples: list[bytes]) -> None:
        seen = set().union(*map(set, samples)) if samples else set()
        known = sorted(b for b in seen if b >= 128 or chr(b).isalpha())
        self.size = len(known) + 2
        self.classes = np.full(256, self.size - 1, np.uint8)
        for b in range(128):
            if not chr(b).isalpha():
                self.classes[b] = _BLANK
        for i, b in enumerate(known):
            self.classes[b] = i + 1

    def symbols(self, body: bytes, blank: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Classes with runs of blanks made one, and which bytes they stand for. ``blank``: a blank goes before."""
        x = self.classes[np.frombuffer(body, np.uint8)]
        keep = np.ones(len(x), bool)
        keep[:1] = not blank or x[:1] != _BLANK
        keep[1:] = (x[1:] != _BLANK) | (x[:-1] != _BLANK)
        return x[keep], keep


class Table:
    """The transitions of an automaton in three arrays: state s goes on with class c to target[p], p = base[s] + c, if owner[p] is s.

    Rows with several transitions are placed first fit, those with one fill the gaps, so the table's size follows the number of
    transitions and not that of classes. States hold their base, so a step is two lookups. The last state stands before a text
    and after a symbol that the sample lacks: there any symbol begins a phrase.
    """

    def __init__(self, step: list[dict[int, int]], width: int) -> None:
        n, edges = len(step), sum(map(len, step))
        self.outside, tried = n, np.arange(256)[:, None]
        free = np.ones(3 * edges + 8 * width + 1024, bool)
        base, low = np.zeros(n + 1, np.int32), width
        for s in sorted((s for s in range(n) if len(step[s]) > 1), key=lambda s: (-len(step[s]), s)):
            classes = np.fromiter(step[s], np.int64, len(step[s]))
            while True:
                if low + 256 + width > len(free):
                    free = np.concatenate([free, np.ones(len(free), bool)])
                fits = free[low + tried + classes].all(axis=1)
                p = int(fits.argmax())
                if fits[p]:
                    break
                low += 128
            base[s] = low + p
            free[low + p + classes] = False
            if p > 128:  # what lies so far back is left to the rows with one transition
                low += 64
        single = [s for s in range(n) if len(step[s]) == 1]
        gaps = width + np.flatnonzero(free[width:])
        if len(gaps) < len(single):
            gaps = np.concatenate([gaps, len(free) + np.arange(len(single))])
        for s, p in zip(single, gaps.tolist(), strict=False):
            base[s] = p - next(iter(step[s]))
        # one entry each way: which state holds the place, where it goes
        size = int(base.max()) + width + 1
        self.base, self.owner, self.target = base, np.full(size, -1, np.int32), np.zeros(size, np.int32)
        of = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in step])
        c = np.fromiter((c for x in step for c in x), np.int32, edges)
        self.owner[base[of] + c] = of
        self.target[base[of] + c] = np.fromiter((t for x in step for t in x.values()), np.int32, edges)
        self.begin = np.full(width, self.outside, np.int32)  # where a phrase that begins with each class goes
        for c, to in step[0].items():
            self.begin[c] = to

    def run(self, grid: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state in which each column of symbols ends that begins in ``state``, and the phrases that begin in it.
        ``length`` descends: symbols beyond a column's length are not read."""
        state, count = state.copy(), np.zeros(len(state), np.int32)
        active = np.searchsorted(-length, -np.arange(len(grid)), side="left").tolist()
        for k, row in zip(active, grid, strict=True):
            if not k:
                break
            now, symbol = state[:k], row[:k]
            at = self.base.take(now)
            at += symbol
            new = self.owner.take(at) != now
            to = self.target.take(at)
            np.copyto(to, self.begin.take(symbol), where=new)
            state[:k] = to
            count[:k] += new
        return state, count


def parser(sample: bytes, alphabet: Alphabet) -> Table:
    return Table(automaton(alphabet.symbols(sample)[0].tolist()), alphabet.size)


class Parsers:
    """What a model needs on the executors: names, alphabet and tables, built once on the driver."""

    def __init__(self, model: tuple, alphabet: Alphabet | None = None) -> None:
        self.names = [lang for lang, _ in model]
        self.alphabet = alphabet or Alphabet([sample for _, sample in model])
        self.tables = [parser(sample, self.alphabet) for _, sample in model]


def phrases(bodies: list[bytes], alphabet: Alphabet, tables: list[Table]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases by text and language, and symbols by text."""
    return parses(bodies, alphabet, tables)[:2]


def parses(bodies: list[bytes], alphabet: Alphabet, tables: list[Table], begin: list[int] | None = None, blank: bool = False) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Phrases by text and language, symbols by text, and the states in which the last text ends. ``begin``: the states in which a
    single text begins that goes on, ``blank`` if after a blank.

    All stretches run at once from the state before a text; then those run again that in truth begin in another state, namely
    where the stretch before them ended, until none does. Greedy parses soon meet: a stretch that after ``MEET`` symbols is in
    the state it was in before goes on as before.
    """
    body = b"".join(bodies)
    symbols, keep = alphabet.symbols(body, blank)
    ends = np.concatenate([[0], np.cumsum(keep)])[np.cumsum([len(x) for x in bodies])]
    size = np.diff(ends, prepend=0)
    lanes = -(-size // SEGMENT)
    owner = np.repeat(np.arange(len(bodies)), lanes)
    part = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    length = np.minimum(size[owner] - part * SEGMENT, SEGMENT)
    column = np.empty(len(owner), np.int64)  # columns of the grid in descending length
    column[np.argsort(-length, kind="stable")] = np.arange(len(owner))
    at = np.arange(len(symbols)) - np.repeat(ends - size, size)
    grid = np.zeros((SEGMENT, len(owner)), np.uint8)
    grid[at % SEGMENT, column[np.repeat(np.cumsum(lanes) - lanes, size) + at // SEGMENT]] = symbols
    before = np.full(len(owner), -1)  # the column of the stretch before
    before[column[part > 0]] = column[np.flatnonzero(part > 0) - 1]
    order = np.argsort(column)
    owner, length = owner[order], length[order]
    out, after = np.zeros((len(bodies), len(tables)), np.int64), []
    for k, table in enumerate(tables):
        first = table.outside if begin is None else begin[k]
        start = np.full(len(owner), table.outside, np.int32)
        met, head = table.run(grid[:MEET], length, start)
        state, tail = table.run(grid[MEET:], length - MEET, met)
        while True:
            due = np.where(before < 0, first, state[before]).astype(np.int32) if len(state) else state
            again = np.flatnonzero(due != start)
            if not len(again):
                break
            start = due
            now, head[again] = table.run(grid[:MEET, again], length[again], start[again])
            other = again[now != met[again]]
            met[again] = now
            state[other], tail[other] = table.run(grid[MEET:, other], length[other] - MEET, met[other])
        out[:, k] = np.bincount(owner, head + tail, minlength=len(bodies))
        after.append(int(state[column[-1]]) if len(state) else first)
    return out, size, after


def parsed(body: bytes, alphabet: Alphabet, tables: list[Table], room: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``phrases`` gives for one long text, with the memory of ``room`` bytes of it."""
    count, size, state, blank = np.zeros((1, len(tables)), np.int64), np.zeros(1, np.int64), None, False
    for i in range(0, len(body), room):
        part = body[i : i + room]
        n, m, state = parses([part], alphabet, tables, state, blank)
        count, size, blank = count + n, size + m, alphabet.classes[part[-1]] == _BLANK
    return count, size


def fewest(bodies: list[bytes], model: Parsers, room: int = BLOCK) -> np.ndarray:
    """By text: the place of the language with fewest phrases, the first of equal ones, that number, the next least (``NONE`` where
    there is one language), and symbols."""
    out = np.zeros((4, len(bodies)), np.int64)
    for i, j in pieces(bodies, room):
        long = j == i + 1 and len(bodies[i]) > room
        counts, size = parsed(bodies[i], model.alphabet, model.tables, room) if long else phrases(bodies[i:j], model.alphabet, model.tables)
        order = np.sort(counts, axis=1)
        out[:, i:j] = counts.argmin(axis=1), order[:, 0], order[:, 1] if counts.shape[1] > 1 else np.full(j - i, NONE), size
    return out


def learn(labelled: DataFrame, sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS) -> tuple:
    """((lang, sample), ...) from ``labelled(doc_id, text, lang)``: whole texts with the least hashes, for each lang at most
    ``sample_texts`` of at most ``sample_chars`` characters together. Texts over ``SHORT_CHARS`` characters are left out, but
    where a lang has no other its shortest text is taken. That bounded sample, of any number of languages, is all that comes to the
    driver. Ties of hashes go by text; repeated rows may both be taken."""
    rows = labelled.where("lang is not null and text is not null").withColumns({"h": F.xxhash64("doc_id", "lang"), "n": F.length("text")})
    short = F.col("n") <= SHORT_CHARS
    shortest = F.min_by(F.when(~short, F.col("text")), F.when(~short, F.struct("n", "h")))
    known = rows.groupBy("lang").agg(F.count_if(short).alias("many"), F.when(F.count_if(short) == 0, shortest).alias("only")).collect()
    by: dict[str, list] = {r["lang"]: [] if r["only"] is None else [r["only"].lower()] for r in known}
    share = {r["lang"]: min(1.0, 3 * sample_texts / r["many"]) for r in known if r["many"]}
    if share:
        limits = labelled.sparkSession.createDataFrame([(lang, int((2 * s - 1) * (2**63 - 1024))) for lang, s in share.items()], "lang string, most bigint")
        near = rows.join(F.broadcast(limits), "lang").where(short & (F.col("h") <= F.col("most"))).select("lang", "h", "n", F.lower("text").alias("text"))
        order = Window.partitionBy("lang").orderBy("h", "text")
        near = near.withColumns({"nth": F.row_number().over(order), "sum": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))})
        for r in sorted(near.where((F.col("nth") <= sample_texts) & ((F.col("sum") <= sample_chars) | (F.col("nth") == 1))).collect(), key=lambda r: (r["lang"], r["nth"])):
            by[r["lang"]].append(r["text"])
    return tuple((lang, " ".join(by[lang]).encode()) for lang in sorted(by) if by[lang])


def predict(docs: DataFrame, model: tuple, keep: tuple[str, ...] = ("doc_id",), more: dict[str, Column] | None = None) -> DataFrame:
    """``keep`` columns with lang_pred and score (0 to 1).

    ``und`` and score 0: no text, a text without a letter, or a model that learned nothing. Ties go to the first language by
    code point. Rows are judged one by one, so repeated rows get the same answer, and an empty table gives no rows.
    """
    columns, spark = [*keep, *(more or {})], docs.sparkSession
    carried = {"__best": "bigint", "__other": "bigint", "__size": "bigint", "__lang": "string"}
    source = docs.select(*keep, *(c.alias(n) for n, c in (more or {}).items()), F.lower("text").alias("__text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    types = {f.name: f.dataType.simpleString() for f in source.schema}
    alphabet = Alphabet([sample for _, sample in model])

    def judge(rows: DataFrame, group: tuple, first: bool, last: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(Parsers(group, alphabet))  # about a megabyte a language, of a bounded number
        given = [*columns, *(() if last else ("__text", "__letter"))]
        names = [*given, *(("lang_pred", "score") if last else carried)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lang, best, other, size = _taken(batch, shared.value, first)
                if last:
                    letter = batch.column("__letter").to_numpy(zero_copy_only=False) & (best >= 0)
                    other = np.where(other == NONE, np.maximum(size, 1), other)
                    score = np.where(letter, 1 - best / np.maximum(other, best).clip(1), 0)
                    made = [pa.array([x if y else UNKNOWN for x, y in zip(lang, letter.tolist(), strict=True)], pa.string()), pa.array(score, pa.float64())]
                else:
                    made = [pa.array(best), pa.array(other), pa.array(size), pa.array(lang, pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in given), *made], names)

        out = {**{c: types[c] for c in given}, **({"lang_pred": "string", "score": "double"} if last else carried)}
        return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in out.items()))

    groups = [model[i : i + GROUP] for i in range(0, len(model), GROUP)] or [()]
    rows = source
    for k, group in enumerate(groups[:-1]):
        rows = materialize(judge(rows, group, k == 0, False))  # one group's tables at a time in a worker
    return judge(rows, groups[-1], len(groups) == 1, True)


def _taken(batch: pa.RecordBatch, model: Parsers, first: bool) -> tuple[list[str | None], np.ndarray, np.ndarray, np.ndarray]:
    """The best language so far by text, its phrases (-1: none), the next least number, and symbols; earlier groups win ties."""
    n = batch.num_rows
    if first:
        lang, best, other, size = [None] * n, np.full(n, -1), np.full(n, -1), np.zeros(n, np.int64)
    else:
        lang = batch.column("__lang").to_pylist()
        best, other, size = (batch.column(c).to_numpy() for c in ("__best", "__other", "__size"))
    if not model.names:
        return lang, best, other, size
    place, least, second, size = fewest([x or b"" for x in texts(batch, "__text")], model)
    if first:
        return [model.names[k] for k in place], least, second, size
    wins = least < best
    other = np.minimum(np.minimum(other, second), np.maximum(least, best))
    return [model.names[k] if w else x for k, w, x in zip(place, wins.tolist(), lang, strict=True)], np.minimum(least, best), other, size


#: A text is in another language than it says if the predicted one saves such a share of phrases.
SURE = 0.5


def identified(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """``docs`` without those whose language stays unknown (no text, no letter), and without those that are in another language
    than they say, with a score of ``sure`` or more; a null lang becomes the predicted one.

    The model is learned from the rows of ``docs`` that have a lang. Columns and repeated rows stay as they are. An empty table
    gives no rows.
    """
    model = learn(docs.select("doc_id", "text", "lang"))
    known = docs.select("text", F.struct("*").alias("row"))
    wrong = F.coalesce(F.col("row.lang") != F.col("lang_pred"), F.lit(False)) & (F.col("score") >= sure)
    found = predict(known, model, keep=("row",)).where((F.col("lang_pred") != UNKNOWN) & ~wrong)
    return found.select(*(F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def held_out() -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return predict(docs, learn(docs.where(~held_out())), more={"held_out": held_out()})
