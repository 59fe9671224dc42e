"""URL filters: rules by host and path, and gradient-boosted trees on lexical features where no rule fits."""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import few, table
from gridloom.sources.tables import materialize

#: (rule, verdict). A rule is a host and the start of a path.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Bound of the labelled sample that the trees are fitted on: the URLs with the least hashes.
SAMPLE_ROWS = 20_000
RESULT = ("host", "path", "rule", "verdict", "score")
TREES, DEPTH, RATE, BINS = 20, 3, 0.3, 32
#: Parts of the hosts; a row that is learned from gets the suffix statistics of the other parts.
FOLDS = 4
#: Suffix statistics of at most so many suffixes are broadcast; more are joined by a shuffle.
BROADCAST_SUFFIXES = 10_000
FEATURES = tuple(f"__{c}" for c in ("url_length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio", "entropy", "parameters", "suffix_count", "suffix_rate"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path. Null or no ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does. A rule fits its host and all subdomains."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        of, slash, start = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + start)
        found, verdict = F.when(fits, rule).otherwise(found), F.when(fits, says).otherwise(verdict)
    return found, verdict


def lexical(rows: DataFrame) -> DataFrame:
    """``rows(url, ..)`` with __host, __path, the features that the string alone gives, and __suffix."""
    host, path = parts(F.col("url"))
    rows = rows.withColumns({"__host": host, "__path": path})
    url, host = F.coalesce("url", F.lit("")), F.col("__host")
    size = F.length(host)

    def term(sum_: Column, c: Column) -> Column:
        p = (size - F.length(F.replace(host, c, F.lit("")))) / size
        return sum_ - p * F.log2(p)

    query = F.when(F.instr(url, "?") > 0, F.substring(url, F.instr(url, "?"), F.length(url))).otherwise("")
    return rows.withColumns({
        "__suffix": F.element_at(F.split(host, r"\."), -1),
        "__url_length": F.length(url), "__host_length": size, "__path_length": F.length("__path"),
        "__depth": F.regexp_count("__path", F.lit("/")), "__labels": F.regexp_count(host, F.lit(r"\.")), "__hyphens": F.regexp_count(host, F.lit("-")),
        "__digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / F.greatest(F.length(url), F.lit(1)),
        "__entropy": F.when(size > 0, F.reduce(F.array_distinct(F.split(host, "")), F.lit(0.0), term)).otherwise(0.0),
        "__parameters": F.regexp_count(query, F.lit("=")),
    })


def fold_of(host: Column) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(FOLDS)).cast("int")


def suffix_counts(known: DataFrame) -> DataFrame:
    """(__suffix, __n, __b): the labelled URLs of each suffix and how many of them are blocked, by fold of their hosts."""
    fold, each = fold_of(F.col("__host")), range(FOLDS)
    n = F.array(*(F.count_if(fold == k) for k in each))
    b = F.array(*(F.coalesce(F.sum(F.when(fold == k, F.col("__label"))), F.lit(0)).cast("long") for k in each))
    return materialize(known.groupBy("__suffix").agg(n.alias("__n"), b.alias("__b")))


def with_suffixes(rows: DataFrame, counts: DataFrame, learning: bool = False) -> DataFrame:
    """``rows`` with the count and the smoothed share of blocked URLs of their suffix. ``learning``: of the hosts of other folds only,
    for a rate that a row's own label takes part in would tell it."""
    met = rows.join(F.broadcast(counts) if few(counts, BROADCAST_SUFFIXES) else counts, "__suffix", "left")
    n, b = (F.coalesce(F.reduce(c, F.lit(0).cast("long"), lambda x, y: x + y) - (F.get(c, fold_of(F.col("__host"))) if learning else 0), F.lit(0)) for c in ("__n", "__b"))
    return met.withColumns({"__suffix_count": F.log2(n + 1), "__suffix_rate": (b + 1) / (n + 2)}).drop("__n", "__b")


class Trees:
    """Boosted regression trees of the logistic loss. A tree is nested (feature, threshold, left, right) or a leaf's value."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        self.trees: list = []
        share = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)) if len(y) else 1e-3
        self.base = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
        raw = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            step = np.zeros(len(y))
            self.trees.append(self._grow(bins, cuts, weight * (p - y), weight * p * (1 - p), np.arange(len(y)), DEPTH, step))
            raw += step

    def _grow(self, bins: np.ndarray, cuts: list, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, step: np.ndarray) -> tuple | float:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best: tuple = (1e-6, None, None)
        if depth:
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                left_g = np.bincount(bins[rows, f], g[rows], len(cut) + 1).cumsum()[:-1]
                left_h = np.bincount(bins[rows, f], h[rows], len(cut) + 1).cumsum()[:-1]
                right_g, right_h = total_g - left_g, total_h - left_h
                gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - total_g**2 / (total_h + 1)
                gain[(left_h < 1e-3) | (right_h < 1e-3)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        if best[1] is None:
            value = float(-RATE * total_g / (total_h + 1))
            step[rows] = value
            return value
        _, f, k = best
        left = bins[rows, f] <= k
        return f, float(cuts[f][k]), *(self._grow(bins, cuts, g, h, rows[side], depth - 1, step) for side in (left, ~left))

    def splits(self) -> dict[str, int]:
        """How many splits each feature has, for a report on what the trees look at."""
        found: dict[str, int] = {}

        def walk(tree: tuple | float) -> None:
            if not isinstance(tree, float):
                name = FEATURES[tree[0]].removeprefix("__")
                found[name] = found.get(name, 0) + 1
                walk(tree[2])
                walk(tree[3])

        for tree in self.trees:
            walk(tree)
        return found

    def column(self) -> Column:
        """The chance that a URL is blocked, as an expression over the features: no Python runs on the executors."""

        def walk(tree: tuple | float) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            f, cut, left, right = tree
            return F.when(F.col(FEATURES[f]) <= cut, walk(left)).otherwise(walk(right))

        raw = F.lit(self.base)
        for tree in self.trees:
            raw = raw + walk(tree)
        return 1 / (1 + F.exp(-raw))


def fit(known: DataFrame, counts: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted on the ``sample_rows`` labelled URLs of ``known(url, __label, features)`` with the least hashes, each weighing as
    many rows as it has. Hashes over a limit that leaves about twice as many are dropped first, so no more are ever sorted."""
    each = known.groupBy("url", *(c for c in known.columns if c not in ("url", "__path"))).agg(F.count("*").alias("__weight"))
    share = min(1.0, 2 * sample_rows / max(each.count(), 1))
    near = each.withColumn("__h", F.xxhash64("url")).where(F.col("__h") <= int((2 * share - 1) * (2**63 - 1024)))
    near = with_suffixes(near, counts, learning=True)
    rows = near.orderBy("__h", "url", "__label").limit(sample_rows).select(*(F.col(c).cast("double") for c in (*FEATURES, "__label", "__weight"))).toArrow()
    x = np.stack([rows.column(c).to_numpy() for c in FEATURES], 1) if rows.num_rows else np.empty((0, len(FEATURES)))
    return Trees(x, rows.column("__label").to_numpy(), rows.column("__weight").to_numpy())


def unlabelled(host: Column) -> Column:
    """Hosts that nothing is learned from: crc32 of the host leaves 2 when divided by 4."""
    return F.crc32(host) % 4 == 2


def ruled(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(url, label) of the URLs of ``pages(url)`` that a rule decides, of hosts that are not held out: 1 for block, 0 for allow."""
    host, path = parts(F.col("url"))
    says = rule_of(host, path, rules)[1]
    return pages.where(says.isNotNull() & ~unlabelled(host)).select("url", (says == "block").cast("int").alias("label"))


def learned(labelled: DataFrame) -> tuple[Trees, DataFrame]:
    """The trees of ``labelled(url, label)`` and its suffix statistics."""
    known = lexical(labelled.select("url", F.col("label").alias("__label")))
    counts = suffix_counts(known)
    return fit(known, counts), counts


def filtered(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, cut: float = 0.5) -> DataFrame:
    """``pages(.., url)`` with host, path, rule, verdict and score; columns of ``pages`` with these names give way to them.

    ``labelled(url, label)``: URLs with label 1 for block, 0 for allow. The verdict is that of the longest fitting rule, else
    block where the trees give a chance over ``cut``. Null and malformed URLs have empty host and path, fit no rule, and are
    judged like others. Without labels, or with labels of one kind, all are judged alike. Rows are judged one by one, so
    repeated rows get the same answer, and an empty table gives no rows. A URL that is labelled twice counts twice.
    """
    trees, counts = learned(labelled)
    kept = [c for c in pages.columns if c not in RESULT]
    rows = with_suffixes(lexical(pages.select("url", F.struct(*kept).alias("__row"))), counts)
    rule, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    rows = rows.withColumns({"__score": trees.column(), "__rule": rule, "__says": verdict})
    said = F.coalesce("__says", F.when(F.col("__score") > cut, "block").otherwise("allow"))
    return rows.select(*(F.col(f"__row.`{c}`").alias(c) for c in kept), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), said.alias("verdict"), F.col("__score").alias("score"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page. The tables have no labels but the rules: URLs that a rule decides
    teach the trees, which judge the others."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return filtered(pages, ruled(pages)).select("page_id", *RESULT)
