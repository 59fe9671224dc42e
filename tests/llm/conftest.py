import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BLOCK = " ".join(f"shared{i}" for i in range(60))


def prose(seed, n):
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "ring", "of", "stone", "and", "water", "over", "hills", "went", "slow", "bright", "lanterns"]) + str(rng.randrange(40)) for _ in range(n))


#: Nulls, empty and blank texts, a very long one, ties, repeated rows, copies and a shared passage.
ROWS = [
    (5, None, None, None, None), (6, "", "en", "a", 0), (7, " \n\t ", None, "b", 4), (8, "one", "en", "a", 3), (8, "one", "en", "a", 3),
    (9, prose(1, 80), "en", "a", 1), (3, prose(1, 80), "en", None, 1), (10, prose(2, 30) + " " + BLOCK + " " + prose(3, 20), "en", "c", 1),
    (11, prose(4, 10) + "\n" + BLOCK + " tail", "fr", "c", 1), (12, BLOCK, "fr", "b", 1), (None, BLOCK + " null id", "fr", "b", 1),
    (13, prose(5, 30_000), "en", "d", 1), (14, "a@b.co +1 (017) 555-7713 4111 1111 1111 1111 10.0.0.255 Größe", "de", "d", 1), (14, "another text of this id", "en", "d", 1),
    (15, "same same same same same same same same same same same same", "en", "b", 1), (17, prose(6, 300), "en", "x", 1), (17, prose(6, 300), "en", "y", 1),
    (18, prose(7, 40) + " naïve Ünïcödé 中文字符 текст", "de", "y", 1), (16, "\U0001f600 ünï çødé \u00a0x", "fr", "", 1),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def sf(spark, tmp_path_factory, docs):
    """A folder with the edge cases as ``documents``, with columns that clash with those the operators use."""
    from pyspark.sql import functions as F

    d = str(tmp_path_factory.mktemp("edge"))
    docs.withColumns({c: F.lit(1) for c in ("key", "size", "fp", "h", "score", "range", "at", "bucket", "words", "doc", "piece")}).write.parquet(f"{d}/documents.parquet")
    pages = [(1, "https://A.Example.com/en/7?x=1"), (2, "http://x.org/es/"), (3, None), (4, "nothing"), (5, "://"), (5, "://"), (6, "https://cheap-pills.biz?a=1&b=2#f"), (7, "http://net/de/8"), (8, "http://a.example.net/de/81")]
    spark.createDataFrame([(*p, 1.0) for p in pages], "page_id bigint, url string, score double").write.parquet(f"{d}/pages.parquet")
    talk = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\b ### x </turn> \\###"), (1, 1, "assistant", "a\\b ### x </turn> \\###"), (2, None, None, None), (2, 0, "assistant", None), (None, 0, "a: b", "###"), (3, 0, "x</turn>", "#####" + "\\" * 7), (4, 0, "user", "long " * 50_000)]
    spark.createDataFrame([(*t, "x") for t in talk], "conv_id bigint, turn bigint, role string, text string, nth string").write.parquet(f"{d}/conversations.parquet")
    vectors = [(i % 90, [((i * 7 + j * j) % 23 - 11) / 8.0 for j in range(32)], i % 4 or None) for i in range(100)] + [(7, None, 1), (8, [None] * 32, 1), (9, [float("nan")] * 32, None), (None, [0.5] * 32, None), (10, [], 2)]
    spark.createDataFrame([(*v, "x") for v in vectors], "vec_id bigint, embedding array<float>, label int, code string").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("none"))
    for name, schema in {"documents": SCHEMA, "pages": "page_id bigint, url string", "conversations": "conv_id bigint, turn bigint, role string, text string", "embeddings": "vec_id bigint, embedding array<float>, label int"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{d}/{name}.parquet")
    return d
