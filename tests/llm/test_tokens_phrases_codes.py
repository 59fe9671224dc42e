"""Token counts, collocations and codes against plain versions of themselves."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm import codes, phrases, tokens
from gridloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(params=["edge", "data"])
def where(request, sf):
    return sf if request.param == "edge" else DATA


# ---- token counts ----


def test_op11(spark, where):
    tok = Tokenizer.from_file(BPE)
    want = Counter()
    for r in spark.read.parquet(f"{where}/documents.parquet").collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        want[r.doc_id, len((r.text or "").encode()), n, n > 1024] += 1
    docs = spark.read.parquet(f"{where}/documents.parquet")
    assert Counter(map(tuple, QUERIES["op11_tokens"](spark, where).collect())) == want
    assert Counter(map(tuple, tokens.counted(docs, BPE, chunk=300, overlap=40).collect())) == want


BITS = ["the", "it's", "we'll", " ", "  ", "\n\n\t", "<|endoftext|>", "<|endo", "12345", "!!!???", "中文字符", "é ü", "😀😀", "a" * 50, "'s", "''", "ab" * 40, "#" * 60, " " * 70, "z'"]


@pytest.mark.parametrize("kind", ["mixed", "few", "run", "letters"])
def test_splices_are_the_whole_encoding(kind):
    """Texts without boundaries, with cut special tokens, contractions, blanks and characters of several bytes, in tiny chunks."""
    rng, whole = random.Random(kind), tokens.Counter(BPE)
    spliced = widened = 0
    for _ in range(150):
        use = {"mixed": BITS, "few": rng.sample(BITS, 2), "run": ["".join(rng.choice("abcdeéf") for _ in range(200))], "letters": list("ab '\n<|endoftx>")}[kind]
        text = "".join(rng.choice(use) for _ in range(rng.randrange(5, 1500 if kind == "letters" else 300)))
        counter = tokens.Counter.__new__(tokens.Counter)
        counter.__dict__ |= whole.__dict__ | {"chunk": rng.choice([48, 100, 200]), "overlap": rng.choice([4, 24, 40]), "spliced": 0, "widened": 0}
        assert counter.huge(text.encode()) == whole.whole([text])[0]
        spliced, widened = spliced + counter.spliced, widened + counter.widened
    assert spliced > 500 and widened > 100


def test_a_splice_needs_a_common_boundary():
    """Chunks of one text whose tokens end at the same places, but not at a boundary of pre-tokens or a common token, don't meet."""
    c = tokens.Counter(BPE, 64, 16)
    data = b"x" * 200
    a, b = c._encode(data, 0, 64), c._encode(data, 60, 124)
    assert c._meet(a, b, 0) is None  # the overlap is no proven run
    a, b = c._encode(b"one two three four five six", 0, 27), c._encode(b"one two three four five six", 5, 27)
    assert c._meet(a, b, 0) is None or c._meet(a, b, 0)[2]


def test_other_tokenizers_are_asked_whole(spark):
    docs = spark.createDataFrame([(1, "Some text. " * 50), (2, None), (None, "x")], "doc_id bigint, text string")
    for name in ("piece_bpe_32k.model", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        counter = tokens.Counter(path, 64, 8)
        assert not counter.resyncs
        got = {r.doc_id: r.n_tokens for r in tokens.counted(docs, path, chunk=64, overlap=8).collect()}
        assert got == {1: counter.whole(["Some text. " * 50])[0], 2: 0, None: counter.whole(["x"])[0]}


# ---- collocations ----


def plain_phrases(rows, longest=4, least=30, top=2000, share=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            ws = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang or "und", *ws[i : i + k]] += 1
    found = {}
    frequent = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    within = Counter()
    for (lang, *ws), a in frequent.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                within[lang, *ws[i : i + k]] = max(within[lang, *ws[i : i + k]], a)
    for (lang, *ws), a in frequent.items():
        cuts = [(2_000_000 * a // (f[lang, *ws[:k]] + f[lang, *ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        if 100 * within[lang, *ws] < share * a:
            found.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), f[lang, *ws[:k]], f[lang, *ws[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, of in found.items() for i, (s, a, p, left, right) in enumerate(sorted(of)[:top])}


@pytest.mark.parametrize(("longest", "least", "top", "room"), [(4, 2, 2000, 1 << 20), (4, 3, 5, 200), (3, 2, 50, 37), (2, 2, 7, 64)])
def test_collocations(spark, longest, least, top, room):
    rng = random.Random(longest * room)
    bits = ["a", "b", "A", "é", "the", "of", "ü", ",", ". ", "\n", "\t", "  ", "!?", "x y", "quick red fox", "of the"]
    rows = [(rng.choice(["en", None, "und", "d e"]), rng.choice(["", None, *[" ".join(rng.choice(bits) for _ in range(rng.randrange(60)))] * 8])) for _ in range(120)] + [("en", "one two three " * 40 + "a" * 300 + " b" * 90)] * 2
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = phrases.collocations(docs, longest, least, top, room=room).collect()
    want = plain_phrases(rows, longest, least, top)
    assert len(got) == len(want) > 4 and {tuple(r) for r in got} == want


def test_op12(spark, where):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    got = QUERIES["op12_phrases"](spark, where).collect()
    assert {tuple(r) for r in got} == plain_phrases(rows) and (len(got) > 10 or where != DATA)


def test_scores_pass_64_bits(spark):
    """Counts whose products need more than 64 bits score exactly."""
    big = 9_000_000_000_000_000
    ones = spark.createDataFrame([("en", "a", big + 1), ("en", "b", big), ("en", None, 2 * big)], "lang string, phrase string, n bigint")
    twos = spark.createDataFrame([("en", "a b", big - 1)], ones.schema)
    r = phrases.scored([ones, twos]).head()
    assert (r.a, r.l, r.r, r.score) == (big - 1, big + 1, big, 2_000_000 * (big - 1) // (2 * big + 1))


# ---- codes ----


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [int(np.floor(np.float64(x) * 256)) for x in v], label) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    each = len(kept[0][1]) // parts
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    books = [[v[p * each : (p + 1) * each] for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            held = {}
            for _, v, _ in kept:
                x = v[p * each : (p + 1) * each]
                held.setdefault(nearest(x, book)[1], []).append(x)
            books[p] = [[sum(c) // len(held[i]) for c in zip(*held[i], strict=True)] if i in held else e for i, e in enumerate(book)]
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out, by = [], Counter()
    for i, v, label in kept:
        found = [nearest(v[p * each : (p + 1) * each], book) for p, book in enumerate(books)]
        by[label] += (error := sum(d for d, _ in found))
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, label))
    return [(i, code, error, by[label], sha) for i, code, error, label in out]


def test_trees_keep_lower_index_ties():
    rng = np.random.default_rng(3)
    for n in (1, 5, 9, 64, 200):
        entries = rng.integers(-3, 4, (n, 3))  # many equal entries and equal distances
        points = rng.integers(-6, 7, (500, 3))
        index, far = codes.Tree(entries).nearest(points)
        every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()


@pytest.mark.parametrize("entries", [3, 64])
def test_codes(spark, entries):
    """Null, empty, short, non-finite and repeated vectors, ties, null ids and labels."""
    rng = random.Random(entries)
    rows = [(rng.randrange(400), [rng.choice([-1.5, 0.0, 0.25, 0.5, rng.uniform(-1, 1)]) for _ in range(32)], rng.choice([1, 2, None])) for _ in range(300)]
    rows += rows[:20] + [(1, None, 1), (2, [], 1), (3, [None] * 32, 1), (4, [float("nan")] * 32, 1), (5, [0.0] * 31 + [float("inf")], 2), (None, [0.5] * 32, None), (6, [1.0] * 16, 7)]
    got = codes.compressed(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3), entries=entries)
    rows = [r for r in rows if r[1] is None or len(r[1]) in (0, 32)]
    assert Counter(map(tuple, got.drop("label").collect())) == Counter(plain_codes(rows, entries=entries))


def test_op13(spark, where):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{where}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert Counter(map(tuple, QUERIES["op13_codes"](spark, where).collect())) == Counter(plain_codes(rows))


def test_labels_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(codes, "LABELS", 1)
    rows = [(i, [i / 7.0] * 16, i % 3 or None) for i in range(40)]
    got = codes.compressed(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    assert Counter(map(tuple, got.drop("label").collect())) == Counter(plain_codes(rows))


def test_large_components_are_refused(spark):
    from pyspark.errors import PythonException

    with pytest.raises((PythonException, ValueError), match="below"):
        codes.compressed(spark.createDataFrame([(1, [1e9] * 16, 1)], "vec_id bigint, embedding array<double>, label int")).collect()
