"""Operators against plain versions of themselves."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import chat, langid, mixing, packing, pii, quality, simhash, sketches, substrings, urls
from gridloom.llm.components import components
from gridloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").collect()


@pytest.fixture(scope="module", params=["edge", "data"])
def case(request, spark, sf):
    d = sf if request.param == "edge" else DATA
    return d, spark.read.parquet(f"{d}/documents.parquet").collect()


def test_op1(spark, case):
    d, rows = case
    got = QUERIES["op1_mixing"](spark, d).collect()
    by, by_size = Counter(), {}
    for r in rows:
        by[r.source] += len(words(r.text))
        by_size.setdefault(r.source, []).append((r.doc_id, len(words(r.text))))
    order = sorted(by, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        left, w = sum(by.values()) - sum(target.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 3 * by[s]]
        if not over:
            break
        target |= {s: 3.0 * by[s] for s in over}
        free -= set(over)
    target |= {s: left * weight[s] / w for s in free}
    want = Counter((i, n, by[s], round(target[s], 6)) for s, of in by_size.items() for i, n in of)
    assert Counter((g.doc_id, g["size"], g.source_size, round(g.target, 6)) for g in got) == want
    assert all(0 <= g.taken <= 3 * g["size"] for g in got)
    assert abs(sum(g.taken for g in got) - sum(target.values())) <= len(order)
    again = QUERIES["op1_mixing"](spark, d).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    # by source, from the operator itself
    docs = spark.read.parquet(f"{d}/documents.parquet")
    taken = {r.source: r.n for r in mixing.mix(mixing.sized(docs))[1].groupBy("source").agg(F.sum("words").alias("n")).collect()}
    assert all(abs(taken.get(s, 0) - target[s]) <= 1 for s in order)


def test_op1_shards_are_multinomial(spark):
    """Shard counts vary as draws with replacement do, totals are exact, every place of a source is taken as often as asked."""
    plan = spark.createDataFrame([("a", 256_000, 256_000.0), ("b", 128_000, 64_000.0), (None, 64_000, 192_000.0)], "source string, source_size bigint, target double")
    made = mixing.slots(plan, 16, 250).collect()
    totals = Counter(r.source for r in made)
    assert totals == {"a": 16_000, "b": 4_000, None: 12_000} and sorted(r.slot for r in made) == list(range(32_000))
    assert all(n == 250 for n in Counter(r.shard for r in made).values())
    counts = Counter((r.shard, r.source) for r in made)
    a = np.array([counts[k, "a"] for k in range(100)])  # the last shards balance the totals
    assert abs(a.mean() - 125) < 3 and 0.6 < a.var() / (250 * 0.5 * 0.5) < 1.6
    blocks = Counter((r.source, r.block) for r in made)
    assert all(blocks["a", b] == 1 for b in range(16_000)) and all(blocks[None, b] == 3 for b in range(4_000)) and max(blocks["b", b] for b in range(8_000)) == 1


def test_op1_one_text_in_two_sources(spark):
    text = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(1, text, s) for s in ("x", "y")], "doc_id bigint, text string, source string")
    rows, mixture = mixing.mix(mixing.sized(docs))
    got = {r.source: (r.target, r.n) for r in rows.join(mixture.groupBy("source").agg(F.sum("words").alias("n")), "source").collect()}
    assert all(abs(t - n) <= 1 for t, n in got.values()) and len(got) == 2
    words_of = Counter()
    for r in mixing.mixed_documents(docs).collect():
        words_of[r.source] += len(r.text.split())
    assert all(words_of[s] == n for s, (_, n) in got.items())


def test_targets_that_stop(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 100), ("e", 0)], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # weights 5, 2, 1, 5 (e), 2 (null): a stops at 30, e at 0, null at 300; c stops at 15; b takes the rest
    assert got == {"a": 30.0, "e": 0.0, None: 300.0, "c": 15.0, "b": 770.0}


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_permutation(spark, n):
    got = [r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p")).collect()]
    assert sorted(got) == list(range(n))


def test_mixture_words(spark, docs):
    """The texts of the mix have the words that the plan says."""
    out = mixing.mixed_documents(docs.where("doc_id is not null"))
    total = sum(len(words(r.text)) for r in out.collect())
    plan = mixing.mix(mixing.sized(docs.where("doc_id is not null")))[1].agg(F.sum("words")).head()[0]
    assert total == plan > 0
    whole = {r.text for r in docs.collect()}
    assert any(r.text in whole for r in out.collect())


def test_op2_rules(spark, sf):
    got = {r.page_id: r for r in QUERIES["op2_urls"](spark, sf).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert (got[2].rule, got[2].verdict) == ("org/es/", "block")
    assert all((got[i].host, got[i].path, got[i].rule) == ("", "", None) for i in (3, 4, 5))
    assert (got[6].host, got[6].path) == ("cheap-pills.biz", "")
    assert (got[7].rule, got[7].verdict, got[8].rule, got[8].verdict) == ("net/de/", "allow", "example.net/de/8", "block")


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


@pytest.mark.parametrize("edge", [True, False])
def test_op2_plain(spark, sf, edge):
    d = sf if edge else "/root/testdata/sf0.01"
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = QUERIES["op2_urls"](spark, d).collect()
    assert {r.page_id for r in got} == set(pages)
    for r in got:
        host, path = plain_parts(pages[r.page_id])
        fits = [(len(rule), rule, says) for rule, says in urls.RULES for of, _, start in [rule.partition("/")] if (host == of or host.endswith("." + of)) and path.startswith("/" + start)]
        _, rule, says = max(fits, default=(0, None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (says or ("block" if r.score > 0.5 else "allow"))


def test_op2_held_out_hosts(spark):
    """Hosts that nothing was learned from: of the URLs that a rule decides the trees know most of either kind, by several features."""
    d = "/root/testdata/sf0.1"
    pages = spark.read.parquet(f"{d}/pages.parquet")
    trees, _ = urls.learned(urls.ruled(pages))
    assert len(trees.splits()) >= 4 and sum(trees.splits().values()) > 20 and "suffix_rate" in trees.splits()
    got = QUERIES["op2_urls"](spark, d).where(urls.unlabelled(F.col("host")) & F.col("rule").isNotNull()).collect()
    # the rule for /en/7 of one host contradicts a wider one by a digit of the path alone, which no lexical feature tells
    block, allow = ([r.score > 0.5 for r in got if r.verdict == v and r.rule != "example.com/en/7"] for v in ("block", "allow"))
    assert len(block) > 50 and len(allow) > 20 and len({r.host for r in got}) > 5
    assert np.mean(block) > 0.95 and np.mean(allow) < 0.05
    assert len({round(r.score, 3) for r in QUERIES["op2_urls"](spark, d).collect()}) > 20


def test_op2_scores_are_the_trees(spark):
    """The column expression gives what the trees give row by row."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    trees, counts = urls.learned(urls.ruled(pages))
    rows = urls.with_suffixes(urls.lexical(pages), counts).withColumn("score", trees.column()).collect()

    def value(tree, r):
        while not isinstance(tree, float):
            tree = tree[2] if r[urls.FEATURES[tree[0]]] <= tree[1] else tree[3]
        return tree

    assert trees.trees and all(abs(r.score - 1 / (1 + np.exp(-trees.base - sum(value(t, r) for t in trees.trees)))) < 1e-12 for r in rows)
    by = {r.page_id: r.score for r in rows}
    assert all(r.score == by[r.page_id] for r in QUERIES["op2_urls"](spark, DATA).collect())


def test_op2_repeated_urls_weigh(spark):
    """A URL that many rows share is one row of the sample, and weighs as many."""
    many = spark.createDataFrame([("http://one.xx/a", 1)] * 500 + [(f"http://h{i}.yy/{i}", i % 2) for i in range(40)], "url string, label int")
    known = urls.lexical(many.withColumnRenamed("label", "__label"))
    trees = urls.fit(known, urls.suffix_counts(known), sample_rows=41)
    assert abs(1 / (1 + np.exp(-trees.base)) - 520 / 540) < 1e-6


def test_op2_suffix_rates_are_of_other_hosts(spark):
    """A row that is learned from gets rates in which no URL of its host's fold takes part; others get those of all."""
    rng = random.Random(6)
    data = [(f"http://h{rng.randrange(9)}.{rng.choice(['xx', 'yy'])}/{i}", rng.randrange(2)) for i in range(60)]
    known = urls.lexical(spark.createDataFrame(data, "url string, __label int"))
    counts = urls.suffix_counts(known)
    fold = {r["__host"]: r.f for r in known.select("__host", urls.fold_of(F.col("__host")).alias("f")).collect()}
    host = lambda u: u.split("/")[2]
    for learning in (True, False):
        for r in urls.with_suffixes(known, counts, learning).collect():
            of = [y for u, y in data if u.split(".")[1][:2] == r["__suffix"] and not (learning and fold[host(u)] == fold[host(r.url)])]
            assert abs(r["__suffix_rate"] - (sum(of) + 1) / (len(of) + 2)) < 1e-12 and abs(r["__suffix_count"] - np.log2(len(of) + 1)) < 1e-12


def test_op2_clashing_columns(spark):
    pages = spark.createDataFrame([("http://X.org/a", "mine", 7.0, 3, 4)], "url string, host string, score double, __n int, label int")
    got = urls.filtered(pages, spark.createDataFrame([("http://x.org", 0)], "url string, label int"))
    assert got.columns == ["url", "__n", "label", *urls.RESULT] and got.head().host == "x.org" and got.head().label == 4


def test_op2_trees_learn(spark):
    """Trained on some spam hosts, the trees know others by their form."""
    rng = random.Random(1)
    rows = []
    for i in range(400):
        bad = i % 2
        host = "-".join("".join(rng.choices("abcdeiou", k=6)) for _ in range(3)) if bad else "".join(rng.choices("abcdeiou", k=7))
        rows.append((i, f"http://{host}.com/{rng.randrange(99)}", bad))
    df = spark.createDataFrame(rows, "page_id int, url string, label int")
    got = urls.filtered(df.where("page_id >= 200"), df.where("page_id < 200").select("url", "label"), rules=()).collect()
    assert np.mean([(r.verdict == "block") == bool(r.label) for r in got]) > 0.95


def test_op3_base(spark, case):
    d, rows = case
    got = Counter(tuple(r)[:7] for r in QUERIES["op3_quality"](spark, d).collect())
    want = Counter()
    for r in rows:
        w = words(r.text)
        counts = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = [0] * len(w)
        for i in range(len(w) - 4):
            if counts[tuple(w[i : i + 5])] > 1:
                again[i : i + 5] = [1] * 5
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        want[r.doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), sum(again), len(w) < 10 or 100 * sum(again) > 20 * len(w)] += 1
    assert got == want


def plain_costs(texts):
    """Mean cost of a unit of each text under one interpolated modified Kneser-Ney model of them all, with dictionaries."""
    def units(t):
        return [int.from_bytes(u, "little") for u in re.findall(rb"(?s)..", ("   " + re.sub(r"[\t-\r]", " ", t.lower())).encode("utf-16-le"))]

    grams = [[tuple(u[i - 3 : i + 1]) for i in range(3, len(u))] for u in map(units, texts)]
    counts = {4: Counter(g for of in grams for g in of)}
    for m in (3, 2, 1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    cut, total, off = {}, {}, {}
    for m, of in counts.items():
        ones = [max(1, sum(n == k for n in of.values())) for k in (1, 2, 3, 4)]
        y = ones[0] / (ones[0] + 2 * ones[1])
        cut[m] = [0, *(min(most, max(0.0, k - (k + 1) * y * ones[k] / ones[k - 1])) for k, most in ((1, 0.95), (2, 1.9), (3, 2.85)))]
        total[m], off[m] = Counter(), Counter()
        for g, n in of.items():
            total[m][g[:-1]] += n
            off[m][g[:-1]] += cut[m][min(n, 3)]

    def chance(g, m):
        if m == 0:
            return 1 / 65536
        c = g[:-1]
        if c not in total[m]:
            return chance(g[1:], m - 1)
        n = counts[m][g]
        return (n - cut[m][min(n, 3)]) / total[m][c] + max(off[m][c] / total[m][c], 1e-6) * chance(g[1:], m - 1)

    return [-np.mean([np.log(chance(g, 4)) for g in of]) if of else 0.0 for of in grams]


@pytest.mark.parametrize("most", [quality.MODEL_ROWS, 10])
def test_op3_whole_method(spark, docs, most):
    """Scores, bands and verdicts against the plain model, by arrays and by the join."""
    df = docs.select("doc_id", "text", "lang").where("length(text) < 20000 or text is null")
    df = df.unionByName(spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 1500").select("doc_id", "text", "lang").limit(60))
    got = Counter((r.doc_id, r.n_words, round(r.log_perplexity, 4), r.kept) for r in quality.judge(quality.scored_by_own_model(df, most)).collect())
    by, want = {}, Counter()
    for r in df.collect():
        by.setdefault(r.lang, []).append(r)
    for of in by.values():
        costs = plain_costs([r.text or "" for r in of])
        base = []
        for r in of:
            w = words(r.text)
            fives = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
            again = {k for i in range(len(w) - 4) if fives[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
            base.append(len(w) < 10 or 100 * len(again) > 20 * len(w))
        good = sorted(c for c, bad in zip(costs, base, strict=True) if not bad)
        q = [good[max(0, -(-len(good) * k // 4) - 1)] for k in (1, 2, 3)] if good else [0, 0, 0]
        for r, c, bad in zip(of, costs, base, strict=True):
            width = 2.5 * max((q[2] - q[0]) / 2, 0.005) * (1 + 8000 / max(1, len((r.text or "").encode()))) ** 0.5
            want[r.doc_id, len(words(r.text)), round(c, 4), not bad and abs(c - q[1]) <= width] += 1
    near = {(i, n, k) for i, n, c, k in got} == {(i, n, k) for i, n, c, k in want}
    assert near and sorted(x[2] for x in got.elements()) == pytest.approx(sorted(x[2] for x in want.elements()), abs=2e-4)


def test_op3_model_sums_to_one(spark, docs):
    model = quality.KneserNey(quality.count_ngrams(docs.where("lang = 'en'")))
    for context in ("rin", "zzz", "   "):
        keys = sum(np.uint64(ord(c)) << np.uint64(16 * (3 - i)) for i, c in enumerate(context)) + np.arange(65536, dtype=np.uint64)
        chances = model.chance(np.full(65536, quality.lang_hash("en"), np.uint64), keys)
        assert chances.astype(float).sum() == pytest.approx(1, abs=1e-4) and (chances > 0).all()


def test_op3_null_is_no_empty_language(spark):
    rows = [(i, "some plain words that stand here for a test of bands " * 1 + str(i), lang) for i, lang in enumerate([None, ""] * 4)] + [(100, "zq xj " * 8 + "zzq qqx", None)]
    got = quality.judge(quality.scored_by_own_model(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))).collect()
    assert len(got) == 9 and {r.lang for r in got} == {None, ""} and len({r.upper for r in got if r.lang == "" and r.n_bytes == got[0].n_bytes}) == 1


def test_op3_keeps_good_text(spark, rows):
    """Labelled good documents stay, most labelled bad ones that pass the base rules go."""
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [r for r in QUERIES["op3_quality"](spark, d).collect() if r.doc_id in labels and not r.base_failed]
    assert np.mean([r.kept for r in got if labels[r.doc_id] == 1]) > 0.99
    assert np.mean([r.kept for r in got if labels[r.doc_id] == 0]) < 0.5


@pytest.mark.parametrize("text", ["", "\\", "###", "</turn>", "\\### Assistant: </turn> ok", "#" * 7, "\\" * 5, "a: b", "</turn", "x\\</turn>\n### user: y"])
@pytest.mark.parametrize("role", ["user", "", "a: b", "###", "x\\"])
def test_op4_round_trip(role, text):
    out, a, b = chat.render(role, text)
    assert chat.parse(out) == [(role, text)] and chat.parse(out * 3) == [(role, text)] * 3
    assert chat._TEXT.sub(r"\\\g<0>", text) == out[a:b] or text == out[a:b]


def test_op4_mask_decides(spark, sf):
    """A mask that covers something else gives another digest or is refused."""
    chunks = chat.formatted(spark.read.parquet(f"{sf}/conversations.parquet").where("conv_id = 1"))
    good = chat.digests(chunks).head()
    short = chat.digests(chunks.withColumn("loss_to", F.col("loss_to") - 1)).head()
    assert (short.turns_sha256, short.formatted_chars) == (good.turns_sha256, good.formatted_chars)
    assert short.loss_sha256 != good.loss_sha256
    with pytest.raises(Exception, match="out of place"):
        chat.digests(chunks.withColumn("loss_from", F.lit(10**6).cast("long")).withColumn("loss_to", F.lit(10**6).cast("long"))).collect()


def test_op4_digests(spark, sf):
    got = {r.conv_id: r for r in QUERIES["op4_chat"](spark, sf).collect()}
    talk = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    for conv, r in got.items():
        if conv == -7:
            continue
        turns = sorted((t for t in talk if t.conv_id == conv), key=lambda t: (t.turn is not None, t.turn or 0, t.role or "", t.text or ""))
        told = "".join(f"{t.role or ''}\n{t.text or ''}\n" for t in turns)
        loss = "".join(t.text or "" for t in turns if t.role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[-7].n_turns == 2 and got[-7].loss_chars == 26
    chunks = chat.formatted(spark.read.parquet(f"{sf}/conversations.parquet")).orderBy("conv_id", "nth").collect()
    ones = [c for c in chunks if c.conv_id == 1]
    joined = "".join(c.chunk for c in ones)
    assert [joined[c.loss_from : c.loss_to] for c in ones if c.loss_from is not None] == ["a\\\\b \\### x \\</turn> \\\\\\###"] * 2


def phrases_of(body, sample):
    """Greedy parse into the longest pieces that the sample has, by search."""
    n, at = 0, 0
    while at < len(body):
        end = at + 1
        while end <= len(body) and body[at:end] in sample:
            end += 1
        at = max(end - 1, at + 1)
        n += 1
    return n


def test_op5_parse():
    rng = random.Random(2)
    samples = ["".join(rng.choices("abcd ", k=300)).encode(), "".join(rng.choices("acde ", weights=[5, 1, 1, 1, 2], k=300)).encode()]
    alphabet = langid.Alphabet(samples)
    tables = [langid.parser(s, alphabet) for s in samples]
    bodies = ["".join(rng.choices("abcdeZé ", k=rng.randrange(1, n))).lower().encode() for n in (200, 3000) for _ in range(30)]
    # a phrase over many stretches, one that the next stretch would begin otherwise, texts without symbols that are known
    bodies += [b"x", b"", b"q" * 700, samples[0] * 3, samples[0][100:] + b"b" * 2 + samples[1], b"a" * 2000]
    counts, size = langid.phrases(bodies, alphabet, tables)
    for body, got, n in zip(bodies, counts, size, strict=True):
        plain = re.sub(rb" +", b" ", body)
        assert list(got) == [phrases_of(plain, re.sub(rb" +", b" ", s)) for s in samples] and n == len(plain)


def test_op5_one_long_phrase():
    """A text of 2,000 symbols that stands in the sample is one phrase."""
    text = "".join(random.Random(1).choices("abcdefgh", k=5000)).encode()
    alphabet = langid.Alphabet([text])
    counts, size = langid.phrases([text[700:2700], text[700:2700] + text[10:40]], alphabet, [langid.parser(text, alphabet)])
    assert counts[:, 0].tolist() == [1, 2] and size.tolist() == [2000, 2030]


def test_op5_sample_bounds(spark, monkeypatch):
    """Whole texts only, within the bound; a language with long texts only gives its shortest."""
    monkeypatch.setattr(langid, "SHORT_CHARS", 50)
    rows = [(i, f"text number {i} of english", "en") for i in range(300)] + [(1000 + i, "lang " * (20 + i), "xx") for i in range(5)] + [(2000, None, "en"), (2001, "no lang", None)]
    got = dict(langid.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), 20, 200))
    texts = {r[1] for r in rows if r[1]}
    assert got["xx"].decode() == "lang " * 20 and 0 < len(got["en"]) <= 220
    assert all(t + " of english" in texts for t in got["en"].decode().replace(" of english", "|").strip("|").replace("| ", "|").split("|"))


def test_op5_whole_query(spark):
    """Every prediction of a small table against the plain parse with the same sample."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.learn(docs.where(~langid.held_out()), 4, 3000)
    alphabet = langid.Alphabet([s for _, s in model])
    samples = [bytes(alphabet.symbols(s)[0]) for _, s in model]
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for r in docs.where("length(text) < 1500").collect():
        body = bytes(alphabet.symbols((r.text or "").lower().encode())[0])
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        counts = [phrases_of(body, s) for s in samples]
        best, second = sorted(counts)[:2]
        assert got[r.doc_id].lang_pred == model[counts.index(best)][0] and got[r.doc_id].score == pytest.approx(1 - best / second)


def test_op5_held_out(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = QUERIES["op5_langid"](spark, d).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) > 0.98


def test_op5_unknown(spark, sf):
    got = [r.lang_pred for r in QUERIES["op5_langid"](spark, sf).collect() if r.doc_id in (5, 6, 7)]
    assert got == ["und"] * 3


def test_op6(spark, case):
    import public_tokenizers
    from tokenizers import Tokenizer

    d, rows = case
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = QUERIES["op6_packing"](spark, d).collect()
    want = Counter()
    for r in rows:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[r.doc_id, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(x)[:5] for x in out) == want
    by = {}
    for x in out:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048


def sequences_of(counts):
    """How full the plan makes each sequence."""
    placed = packing.plan(counts, 2048)
    ranks, fill = {}, Counter()
    for length, rank, _, _ in placed.tolist():
        ranks.setdefault(length, []).append(rank)
    after = {(length, a): b for length, r in ranks.items() for a, b in zip(sorted(r), [*sorted(r)[1:], int(counts[length])], strict=True)}
    for length, rank, sequence, _ in placed.tolist():
        for i in range(after[length, rank] - rank):
            fill[sequence + i] += length
    return fill


def test_op6_plan(monkeypatch):
    rng = np.random.default_rng(5)
    for counts in (rng.integers(0, 400, 2048), rng.integers(0, 2, 2048), np.bincount(rng.integers(300, 1500, 50_000), minlength=2048), np.bincount([900] * 50_000 + [300] * 7, minlength=2048), np.zeros(2048, int)):
        counts[0] = 0
        fill = sequences_of(counts)
        assert sum(fill.values()) == int((counts * np.arange(2048)).sum()) and max(fill.values(), default=0) <= 2048
        with monkeypatch.context() as m:
            m.setattr(packing, "patterns", lambda counts, size: np.empty((0, 3), int))
            assert len(fill) <= len(sequences_of(counts))  # plain best fit


def base_of(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(x := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(x)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]


def test_op7(spark, case):
    d, rows = case
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in QUERIES["op7_pii"](spark, d).collect())
    want = Counter()
    for r in rows:
        found = base_of(r.text or "")
        kinds = Counter(k for k, _, _ in found)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        want[r.doc_id, *(kinds[k] for k in pii.BASE), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want


def test_op7_random_strings():
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choices("ab1 29@._-+()5\n", k=40))
        assert [(k, *s) for k in pii.BASE for s in pii.base_spans(t)[k]] == base_of(t)


def test_op7_method():
    found = pii.spans("IBAN DE89 3704 0044 0532 0130 00, DE88 3704 0044 0532 0130 00; call 555-123-4567, not 555-123-4567")
    assert [len(found[k]) for k in ("iban", "local_phone")] == [1, 2]
    assert not pii.spans("It says 555-123-4567")["local_phone"]
    text = 'token = "0123456789abcdef0123456789abcdef01234567" a@b.co'
    assert pii.redact(text, pii.spans(text)) == 'token = "<SECRET>" <EMAIL>'


THINGS = "part parts sku serial model isbn issn order version build checksum hash sha1 sha256 md5 digest commit uuid".split()


def added_of(t, base):
    """The added kinds, found by plain search: every word near is looked for in both windows, every base span is compared."""
    def near(words, a, b):
        parts = (t[max(0, a - 48) : a], t[b : b + 48])
        found = sum(any(re.search(rf"\b{w}\b", part, re.I) for part in parts) for w in words)
        return [0, 4, 5][min(found, 2)] - 3 * any(re.search(rf"\b{w}\b", part, re.I) for w in THINGS for part in parts)

    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", t):
        s = m[0].replace(" ", "")
        n = int("".join(str(ord(c) - 55) if c.isalpha() else c for c in s[4:] + s[:4]))
        if (7 if n % 97 == 1 else 1) + near("iban account bank konto compte cuenta".split(), *m.span()) >= 6:
            out.append(("iban", *m.span()))
    for m in re.finditer(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", t):
        plain = re.fullmatch(r"\([2-9][0-9]{2}\)[ .-][2-9][0-9]{2}[ .-][0-9]{4}", m[0])
        if (6 if plain else 3) + near("phone call tel telephone mobile fax contact telefon teléfono".split(), *m.span()) >= 6:
            out.append(("local_phone", *m.span()))
    for m in re.finditer(r"[0-9](?:[ -]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 13 <= len(d) <= 15 and (4 if pii.luhn(d) else 1) + near("card visa amex credit karte carte tarjeta".split(), *m.span()) >= 6:
            out.append(("short_card", *m.span()))
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Za-z0-9]{32,}(?![A-Za-z0-9])", t):
        if (4 if re.search("[0-9]", m[0]) else 1) + near("token secret key password apikey passwd bearer".split(), *m.span()) >= 6:
            out.append(("secret", *m.span()))
    return [x for x in out if not any(a < x[2] and x[1] < b for _, a, b in base)]


IBAN, NO_IBAN, CARD, NO_CARD = "DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00", "3782 822463 10005", "3782 822463 10006"
KEY, LETTERS = "0123456789abcdef0123456789abcdef01234567", "abcdefghijklmnopqrstuvwxyzabcdefghijkl"


@pytest.mark.parametrize(
    ("kind", "text", "counts"),
    [
        ("iban", f"see {IBAN} there", True), ("iban", f"part numbers {IBAN}", False), ("iban", f"serial {IBAN}, my account", True),
        ("iban", f"see {NO_IBAN} there", False), ("iban", f"the bank has {NO_IBAN}", False), ("iban", f"bank account {NO_IBAN}", True), ("iban", f"bank account, part {NO_IBAN}", False),
        ("local_phone", "it is 555-723-4567", False), ("local_phone", "call 555-723-4567", True), ("local_phone", "(555) 723-4567", True), ("local_phone", "order (555) 723-4567", False),
        ("local_phone", "sku 555-723-4567, call", False), ("local_phone", "(155) 723-4567", False),
        ("short_card", f"it is {CARD}", False), ("short_card", f"card {CARD}", True), ("short_card", f"card model {CARD}", False), ("short_card", f"credit card model {CARD}", True), ("short_card", f"card {NO_CARD}", False), ("short_card", f"credit card {NO_CARD}", True),
        ("secret", f"it is {KEY}", False), ("secret", f"key {KEY}", True), ("secret", f"sha256 key {KEY}", False), ("secret", f"key {LETTERS}", False), ("secret", f"secret key {LETTERS}", True),
    ],
)
def test_op7_words_move_scores_both_ways(kind, text, counts):
    assert bool(pii.spans(text)[kind]) is counts
    assert [x for x in added_of(text, base_of(text)) if x[0] == kind] == [(kind, *s) for s in pii.spans(text)[kind]]


def test_op7_added(spark, case):
    d, rows = case
    got = Counter((r.doc_id, r.spans) for r in QUERIES["op7_pii"](spark, d).collect())
    want = Counter()
    for r in rows:
        base = base_of(r.text or "")
        found = sorted(base + added_of(r.text or "", base), key=lambda x: (pii.KINDS.index(x[0]), x[1]))
        want[r.doc_id, ",".join(f"{k}:{a}:{b}" for k, a, b in found)] += 1
    assert got == want


def test_op7_many_spans():
    """A long text with many spans of both sorts takes linear time, and windows look both ways."""
    t = "a@b.co call 555-123-4567, DE89 3704 0044 0532 0130 00; " * 4000
    found = pii.spans(t)
    assert [len(found[k]) for k in ("email", "local_phone", "iban")] == [4000] * 3
    assert pii.spans("555-123-4567 is my phone")["local_phone"] and not pii.spans("555-123-4567" + " " * 60 + "phone")["local_phone"]


def simhash_of(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(w)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op8(spark, case):
    d, rows = case
    got = QUERIES["op8_simhash"](spark, d).collect()
    fps = [(r.doc_id, simhash_of(r.text)) for r in rows]
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{f:016x}") for i, f in fps)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    want = Counter((i, least.get(find(k))) for k, (i, _) in enumerate(fps))
    assert Counter((r.doc_id, r.component_id) for r in got) == want


def test_op8_near_links(spark):
    """Fingerprints at 0 to 5 differing bits of many centres, against all pairs."""
    rng = random.Random(4)
    values = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        values.add(centre)
        for _ in range(12):
            v = centre
            for b in rng.sample(range(64), rng.randrange(6)):
                v ^= 1 << b
            values.add(v)
    values = sorted(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint")
    links = [(a % 2**64, b % 2**64) for a, b in simhash.near_links(df).collect()]
    assert all((a ^ b) for a, b in links)
    want = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 3]

    def groups(edges):
        root = {v: v for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        out = {}
        for v in values:
            out.setdefault(find(v), set()).add(v)
        return sorted(map(sorted, out.values()))

    assert groups(links) == groups(want)


def test_op8_dense_unit():
    """Many values in one group: the links of small groups within it are found, and memory stays bounded."""
    import tracemalloc

    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 48, 60_000, dtype=np.uint64))
    near = np.unique(base[::100] ^ (np.uint64(1) << rng.integers(0, 48, len(base[::100])).astype(np.uint64)))
    value = np.unique(np.concatenate([base, near]))
    tracemalloc.start()
    root = simhash.trie_roots(np.zeros(len(value), np.int64), value, 3, 48)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
    at = {int(v): i for i, v in enumerate(value)}
    assert all(root[at[int(v)]] == root[at[int(b)]] for v in near for b in base[::100] if (int(v) ^ int(b)).bit_count() == 1)
    some = rng.integers(0, len(value), 300)
    pairs = np.bitwise_count(value[some][:, None] ^ value[None, :]) <= 3
    assert all(root[i] == root[j] for i, row in zip(some, pairs, strict=True) for j in np.flatnonzero(row))


def test_op8_dense_cluster():
    """Thousands of values within reach of each other become one group without a list of all their pairs."""
    rng, found = random.Random(5), set()
    while len(found) < 3000:
        v = 0xABCDEF012345
        for b in rng.sample(range(48), rng.randrange(4)):
            v ^= 1 << b
        found.add(v)
    root = simhash.trie_roots(np.zeros(3000, np.int64), np.array(sorted(found), np.uint64), 3, 48, most=5000)
    assert not root.any()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100}


def shingles_of(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_op9(spark, rows):
    got = {r.doc_id: r for r in QUERIES["op9_sketches"](spark, DATA).collect()}
    order, errors = sorted(rows, key=lambda r: -r.doc_id), []
    for r, after in zip(order, order[1:] + order[:1], strict=True):
        t, n = r.text or "", len(r.text or "")
        edited = t[: n - n // 3] + (after.text or "")[: n // 3]
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((g.near_edited, edited), (g.near_next, after.text)):
            a, b = shingles_of(t), shingles_of(other)
            errors.append(near - (len(a & b) / len(a | b) if a | b else 1))
        assert (g.fingerprint == got[after.doc_id].fingerprint) == (shingles_of(t) == shingles_of(after.text))
    # 128 hashes: a standard error of 0.044 at most
    assert max(map(abs, errors)) < 0.17 and np.mean(np.abs(errors)) < 0.02 and abs(np.mean(errors)) < 0.01


@pytest.mark.parametrize(("quantiles", "rows_a_range"), [(1024, 500), (1024, 7), (4, 5), (1, 1)])
def test_op9_next(spark, monkeypatch, quantiles, rows_a_range):
    """The row after each, over few and many ranges of uneven ids, ties and a null."""
    monkeypatch.setattr(sketches, "QUANTILES", quantiles)
    monkeypatch.setattr(sketches, "ROWS_A_RANGE", rows_a_range)
    ids = sorted({*random.Random(1).sample(range(-(10**12), 10**12), 150), *range(40), 10**15, -(2**62)}, reverse=True)
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "null")], "doc_id bigint, text string").repartition(3)
    by, after = {}, {}
    for r in sketches.with_next(docs).collect():
        by.setdefault(r.range, []).append(r)
    for found in by.values():
        found.sort(key=lambda r: (r.halo, -r["at"]))
        after |= {a.doc_id: b.doc_id for a, b in zip(found, found[1:], strict=False) if not a.halo}
    order = [*ids, None]
    assert after == dict(zip(order, order[1:] + order[:1], strict=True))


def test_op9_shared_id(spark, monkeypatch):
    """A null id that most rows share is cut into many ranges; rows still follow each other in one ring."""
    monkeypatch.setattr(sketches, "ROWS_A_RANGE", 5)
    docs = spark.createDataFrame([(i if i % 3 == 0 else (None if i % 3 == 1 else 77), f"t{i}") for i in range(600)], "doc_id bigint, text string").repartition(3)
    by, after = {}, {}
    for r in sketches.with_next(docs).collect():
        by.setdefault(r.range, []).append(r)
    assert max(map(len, by.values())) < 60
    for found in by.values():
        found.sort(key=lambda r: (r.halo, -r["at"], r.key))
        after |= {a.text: b.text for a, b in zip(found, found[1:], strict=False) if not a.halo}
    seen, at = [], "t0"
    while at not in seen:
        seen.append(at)
        at = after[at]
    assert len(seen) == 600 and len(set(after.values())) == 600


def test_op9_edges(spark, sf):
    """The edge table: ties and nulls follow each other; digests and sketches agree with the plain ones."""
    got = QUERIES["op9_sketches"](spark, sf).collect()
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((r.doc_id, len(r.text or "")) for r in rows)
    texts, ids = {}, sorted({r.doc_id for r in rows if r.doc_id is not None}, reverse=True) + [None]
    for r in rows:
        texts.setdefault(r.doc_id, set()).add(r.text or "")
    allowed = {}
    for i, after in zip(ids, ids[1:] + ids[:1], strict=True):
        for t in texts[i]:
            n = len(t)
            allowed.setdefault(i, set()).update(hashlib.sha256((t[: n - n // 3] + b[: n // 3]).encode()).hexdigest() for b in texts[i] | texts[after])
    assert all(r.edited_sha256 in allowed[r.doc_id] for r in got)


def test_op9_estimates(spark):
    a, b = " ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(1000, 3000))
    df = spark.createDataFrame([(0, a), (1, b)], "k int, text string").withColumn("sketch", sketches.sketch(F.col("text")))
    x = df.alias("x").join(df.alias("y"), F.lit(True)).where("x.k = 0 and y.k = 1")
    s, t = F.col("x.sketch"), F.col("y.sketch")
    got = x.select(sketches.resemblance(s, t), sketches.containment(t, s), sketches.distinct_shingles(s)).head()
    assert abs(got[0] - 2 / 3) < 0.15 and got[1] > 0.8 and abs(got[2] - 2996) < 900
    whole = df.where("k = 0").head().sketch
    merged = sketches.merge(df.withColumn("g", F.lit(1)), "g").head().sketch
    assert merged == whole


def test_op10(spark, case):
    d, rows = case
    first = {}
    for r in rows:
        i, w = (r.doc_id if r.doc_id is not None else 1 << 62), words(r.text)
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            first[k] = min(i, first.get(k, i))
    want = Counter()
    for r in rows:
        i, w = (r.doc_id if r.doc_id is not None else 1 << 62), words(r.text)
        gone = [0] * len(w)
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < i:
                gone[p : p + 50] = [1] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[r.doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert Counter(map(tuple, QUERIES["op10_substrings"](spark, d).collect())) == want


def test_op10_repeats_and_small_batches(spark):
    """Periodic texts, passages at any place, and a window twice in one document; batches of one text."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(70)]
    texts = []
    for i in range(40):
        w = [rng.choice("abc") for _ in range(rng.randrange(0, 120))] if i % 3 else ["a"] * rng.randrange(30, 200)
        at = rng.randrange(len(w) + 1)
        texts.append((i, " ".join(w[:at] + passage[rng.randrange(15) :] + w[at:] + (passage if i % 7 == 0 else []))))
    keyed = spark.createDataFrame([(i, 0, t) for i, t in texts], "doc bigint, key bigint, text string").repartition(4)
    first = {}
    for i, t in texts:
        w = t.split()
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    got = {i: set() for i, _ in texts}
    for r in substrings.repeated_ranges(keyed, batch_bytes=1).collect():
        got[r.doc] |= set(range(r.lo, r.hi))
    for i, t in texts:
        w = t.split()
        want = {k for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < i for k in range(p, p + 50)}
        assert got[i] == want


def test_op10_hot_anchors(spark, monkeypatch):
    """All anchors hot: windows meet by their own hashes, with the same result."""
    monkeypatch.setattr(substrings, "HOT", 1)
    test_op10_repeats_and_small_batches(spark)


def test_op10_full_bitmaps(spark, monkeypatch):
    """Bitmaps so small that most names share a bit cost time only."""
    monkeypatch.setattr(substrings, "LEAST_BITS", 15)
    monkeypatch.setattr(substrings, "MOST_BITS", 15)
    test_op10_repeats_and_small_batches(spark)


def test_op10_anchors_of_equal_windows():
    """Equal windows have equal anchors wherever they stand, and the anchors of a passage are revealed by all its texts."""
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(200)]
    bodies = [" ".join([f"{k}x{i}" for i in range(rng.randrange(40, 90))] + shared + [f"{k}y{i}" for i in range(rng.randrange(60))]).encode() for k in range(5)]
    of = substrings.Batch(bodies, 50)
    by, of_anchor = {}, {}
    for owner, start, anchor in zip(of.owner.tolist(), of.starts.tolist(), of.anchor.tolist(), strict=True):
        w = tuple(of.words[start : start + 50].tolist())
        assert by.setdefault(w, anchor) == anchor
        of_anchor.setdefault(anchor, set()).add(owner)
    assert sum(len(v) == 5 for v in of_anchor.values()) > 5


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefgh"])
def test_op10_symbols_tell_windows_apart(alphabet):
    """Windows have equal hashes if and only if their words are equal, at any place of any text."""
    rng = random.Random(9)
    part = [rng.choice(alphabet) for _ in range(130)]
    bodies = [" ".join(rng.choices(alphabet, k=rng.randrange(60)) + part[rng.randrange(40) :] + rng.choices(alphabet, k=rng.randrange(60))).encode() for _ in range(30)]
    for window in (50, 7):
        of = substrings.Batch(bodies, window)
        hashes = substrings.window_hashes(of.words, of.middle, of.starts, window)
        texts = [tuple(of.words[s : s + window].tolist()) for s in of.starts.tolist()]
        assert len(set(zip(hashes.tolist(), texts, strict=True))) == len(set(texts)) == len(set(hashes.tolist()))


@pytest.mark.parametrize(("lengths", "most"), [(range(600, 751, 10), 20_015), (range(500, 520), 15_000), (range(690, 830, 7), 30_100), ([1000, 1040], 30_000), ([5], 147)])
def test_packing_without_exact_fills(lengths, most):
    """Lengths of which no few fill a sequence: patterns that leave as little room as they can beat best fit, and no piece is lost."""
    counts = np.zeros(2048, np.int64)
    counts[list(lengths)] = 60_000 // len(lengths)
    plan = packing.plan(counts, 2048)
    none = np.empty(0, np.int64)
    plain = packing.fill(counts, 2048, np.empty((0, 4), np.int64), none)[1]
    many, ends = Counter(), Counter()
    by = {n: np.sort(plan[plan[:, 0] == n][:, 1]) for n in lengths}
    for n, since, sequence, offset in plan.tolist():
        after = by[n][by[n] > since]
        size = int(after[0] if len(after) else counts[n]) - since
        many[n] += size
        for s in range(sequence, sequence + size):
            ends[s] = max(ends[s], offset + n)
    assert all(many[n] == counts[n] for n in lengths) and max(ends.values()) <= 2048
    assert len(ends) <= min(most, plain)


def test_langid_of_many_languages(spark, monkeypatch):
    """203 languages are two groups; smaller groups, of one language too, change nothing."""
    rng = random.Random(4)
    letters = [chr(c) for c in range(0x61, 0x7B)] + [chr(c) for c in range(0x430, 0x450)]
    use = [rng.sample(letters, 6) for _ in range(201)]
    text = lambda k: " ".join("".join(rng.choice(use[k]) for _ in range(rng.randrange(2, 7))) for _ in range(25))
    learned = spark.createDataFrame([(k, text(k), f"l{k:03}") for k in range(201)] + [(900, "equal", "x1"), (901, "equal", "x0")], "doc_id bigint, text string, lang string")
    model = langid.learn(learned)
    assert len(model) == 203
    docs = spark.createDataFrame([(k, text(k)) for k in range(201)] + [(300, "equal"), (301, None), (302, "7"), (303, (text(5) + "  \n ") * 9)], "doc_id bigint, text string").repartition(3)
    found = []
    for group in (200, 1000, 37, 202):
        monkeypatch.setattr(langid, "GROUP", group)
        found.append(sorted(map(tuple, langid.predict(docs, model).collect())))
    assert all(f == found[0] for f in found)
    got = {i: (lang, score) for i, lang, score in found[0]}
    assert got[300][0] == "x0" and got[301] == got[302] == ("und", 0.0) and sum(got[k][0] == f"l{k:03}" for k in range(201)) > 190
    monkeypatch.setattr(langid, "GROUP", 1)
    few = tuple(m for m in model if m[0] in ("l001", "l002", "l003"))
    one = sorted(map(tuple, langid.predict(docs, few).collect()))
    monkeypatch.setattr(langid, "GROUP", 200)
    assert one == sorted(map(tuple, langid.predict(docs, few).collect()))


def test_langid_of_a_long_text_is_bounded():
    """A text parsed in blocks gives the count of one parse, with the memory of a block."""
    import tracemalloc

    sample = " ".join(f"w{i % 97} the {i % 13}" for i in range(4000)).encode()
    model = langid.Parsers((("a", sample), ("b", sample[500:9000])))
    body = b" ".join([sample[i * 7 % 3000 :][:900] for i in range(4000)])
    whole = langid.phrases([body], model.alphabet, model.tables)
    tracemalloc.start()
    parts = langid.parsed(body, model.alphabet, model.tables, 1 << 17)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (parts[0] == whole[0]).all() and (parts[1] == whole[1]).all()
    assert len(body) > 3_000_000 and peak < 20_000_000
