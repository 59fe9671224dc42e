"""The pipeline's stages against plain versions of what each keeps and changes."""

from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from gridloom.llm import langid, packing, pii, simhash

from .test_brute import added_of, base_of, simhash_of, words

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=["edge", "data"])
def given(request, spark, sf):
    return spark.read.parquet(f"{sf if request.param == 'edge' else DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


def test_language_stage(given):
    """What the prediction says decides row by row: unknown and surely other languages go, a missing one is filled in."""
    model = langid.learn(given.select("doc_id", "text", "lang"))
    tables = langid.Parsers(model)
    want = Counter()
    for r in given.collect():
        if not any(c.isalpha() for c in r.text or ""):
            continue
        counts, size = langid.phrases([r.text.lower().encode()], tables.alphabet, tables.tables)
        order = sorted((int(n), lang) for n, lang in zip(counts[0], tables.names, strict=True))
        other = order[1][0] if len(order) > 1 else max(int(size[0]), 1)
        score = 1 - order[0][0] / max(other, order[0][0], 1)
        if r.lang is None or r.lang == order[0][1] or score < langid.SURE:
            want[(r.doc_id, r.text, r.lang or order[0][1], r.source, r.n_chars)] += 1
    assert Counter(map(tuple, langid.identified(given).collect())) == want


def test_near_duplicate_stage(given):
    """All pairs: one row of each group stays, that with the least id; a null id only where its group has no other."""
    rows = given.collect()
    prints, root = [simhash_of(r.text) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    got = simhash.keep_one(given).collect()
    texts = Counter(r.text for r in got)
    assert len(got) == len(groups) and got[0].asDict().keys() == rows[0].asDict().keys()
    for group in groups.values():
        least = min((r.doc_id for r in group if r.doc_id is not None), default=None)
        kept = [r for r in group if r.doc_id == least and r in got]
        assert kept and sum(texts[t] for t in {r.text for r in group}) == 1


def test_personal_data_stage(given):
    """Stretches of spans, found by the plain search, give way to the kind of their first span."""
    want = Counter()
    for r in given.collect():
        text = r.text
        if text is not None:
            base = base_of(text)
            found, end, out = sorted((a, b, k) for k, a, b in base + added_of(text, base)), 0, ""
            while found:
                a, b, k = found.pop(0)
                out += text[end:a] + f"<{k.upper()}>"
                while found and found[0][0] < b:
                    b = max(b, found.pop(0)[1])
                end = b
            text = out + text[end:]
        want[(r.doc_id, text, r.lang, r.source, None if text is None else len(text))] += 1
    assert Counter(map(tuple, pii.redacted(given).collect())) == want


def test_mixture_stage(spark, given, sf):
    """Rows are words of their documents, with their other columns, and n_chars is that of the new text."""
    by = {}
    for r in given.collect():
        by.setdefault((r.doc_id, r.lang, r.source), []).append(words(r.text))
    taken = 0
    for r in corpus_pipeline.mixture(spark, given, sf).collect():
        got = words(r.text)
        taken += len(got)
        assert r.n_chars is None or r.n_chars == len(r.text)
        assert any(not Counter(got) - Counter(of) for of in by[r.doc_id, r.lang, r.source])
    assert taken > 0


def test_packing_stage(spark, given, sf):
    """Every token of every document is in one piece, and sequences are filled from 0 without gaps or overlaps."""
    got = corpus_pipeline.sequences(spark, given, sf).collect()
    ids = packing.Ids(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in given.collect():
        want[r.doc_id] += sum(len(ids[w]) // 4 for w in (r.text or "").encode().split()) + 1
    made, at = Counter(), {}
    for r in got:
        made[r.doc_id] += r.length
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert made == want
    for pieces in at.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048


def test_packing_asks_the_tokenizer():
    """Shortcuts that hold for a folding vocabulary are not taken for another one."""
    folding, cased = (packing.Ids(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    assert folding.folds and folding.splits and not cased.folds
    for ids in (folding, cased):
        for word in ("Stone", "stone,", "RING!?", "Größe"):
            assert ids[word.encode()] == b"".join(i.to_bytes(4, "little") for i in ids.tokenizer.encode(word, add_special_tokens=False).ids)
